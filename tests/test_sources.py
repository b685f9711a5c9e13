"""Files, pandas, dumps, the prompt and streams of changes."""

from __future__ import annotations

import pandas as pd
import pytest

from larkspur import cli
from larkspur.engine import Engine
from larkspur.sources import dump, files
from larkspur.streaming import changes


@pytest.fixture()
def small(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE p (_key TEXT, name TEXT, full TEXT GENERATED ALWAYS AS (lower(name)) STORED, emb VECTOR) WITH (hash_index = [name], vector_index = [emb])")
    e.execute("INSERT INTO p (_key, name, emb) VALUES ('a', 'O''Hara', [1, 2.5]), ('b', NULL, NULL)")
    e.execute("INSERT ('p/a')-[:met {since: 2001, how: 'it''s'}]->('p/b')")
    return e


def same(a, b):
    rows = lambda e: (sorted(map(str, e.sql("SELECT _key, name, full, emb FROM p").collect())), sorted(map(str, e.edges().collect())), e.catalog.indexes)
    assert rows(a) == rows(b)


def test_dump_and_restore(spark, small, tmp_path):
    dump.dump(small, str(tmp_path))
    back = dump.restore(Engine(spark), str(tmp_path))
    same(small, back)
    back.execute("INSERT INTO p (_key, name) VALUES ('c', 'X')")
    assert back.get("p/c")["full"] == "x"


def test_sql_text_round_trip(spark, small):
    text = list(dump.dump_sql(small))
    text[0] = text[0].replace("full TEXT", "full TEXT GENERATED ALWAYS AS (lower(name)) STORED")
    back = Engine(spark)
    dump.load_sql(back, iter(text))
    same(small, back)


@pytest.mark.parametrize("form", ["parquet", "csv", "ndjson"])
def test_files(spark, tmp_path, form):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n bigint")
    files.save(df, f"{tmp_path}/{form}", form)
    e = Engine(spark)
    files.load_collection(e, "t", f"{tmp_path}/{form}", "id", form, "id string, n bigint")
    files.load_edges(e, "x", "t", "t", f"{tmp_path}/{form}", "id", "id", form, "id string, n bigint")
    assert e.sql("SELECT SUM(n) AS s FROM t").first()[0] == 3
    assert e.sql("SELECT SUM(r.n) AS s FROM MATCH (a:t)-[r:x]->(b:t)").first()[0] == 3.0


def test_pandas(spark):
    e = Engine(spark)
    e.frames.create_collection("v", {"emb": "VECTOR", "name": "TEXT", "_key": "TEXT PRIMARY KEY"}, hash_index=["name"], fulltext_index=["name"])
    n = e.frames.load_nodes(pd.DataFrame({"id": ["a", "b"], "title": ["x", None], "emb": [[1, 2], [3, 4]]}), "v", id_col="id", mapping={"title": "name"}, vector_cols=["emb"])
    assert n == 2 and e.get_vector("v/b", "emb") == [3.0, 4.0] and e.vector_dim("v", "emb") == 2
    e.frames.load_edges(pd.DataFrame({"s": ["a"], "t": ["b"], "w": [0.5], "m": ['{"k": "z"}'], "r": ["likes"]}), source_col="s", target_col="t", edge_type_col="r", source_collection="v", target_collection="v", weight_col="w", meta_col="m")
    got = e.frames.query("SELECT b._key AS b, r.weight AS w, r.k AS k FROM MATCH (a:v)-[r:likes]->(b:v)", index_col="b")
    assert got.loc["b"].tolist() == [0.5, "z"]
    with pytest.raises(ValueError):
        e.frames.load_edges(pd.DataFrame(), source_col="s", target_col="t")


def test_prompt(small, tmp_path):
    say = lambda line: cli.command(small, line)[1]
    assert "p" in say(".tables") and "met" in say(".edges p") and "CREATE TABLE p" in say(".schema p") and "edges" in say(".stats")
    assert "O'Hara" in say("SELECT name FROM p") and say("DELETE FROM p WHERE _key = 'b'") == "1 changed" and say(".quit") is None
    assert "no command" in say(".nope") and "Plan" in say("EXPLAIN SELECT name FROM p")


def test_change_stream(spark, small, tmp_path):
    log, seen = f"{tmp_path}/log", []
    number = changes.publish(small, log)
    small.put("p/c", {"name": "C"})
    small.execute("BEGIN")
    small.put("p/d", {"name": "D"})
    small.link("p/c", "p/d", "knows")
    small.execute("ROLLBACK")
    small.put("q/1", {"v": 1})
    run = lambda: changes.live(small, "SELECT COUNT(*) AS n FROM p", log, f"{tmp_path}/ck", lambda df, _: seen.append(df.first()[0]), ["p"], once=True).awaitTermination()
    run()
    assert seen == [3]
    run()
    assert seen == [3]
    small.put("p/e", {"name": "E"})
    run()
    assert seen == [3, 4]
    out = changes.activity(changes.feed(spark, log)).writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck2").start()
    out.awaitTermination()
    assert {(r["collection"], r["commits"]) for r in spark.table("act").groupBy("collection").sum("commits").withColumnRenamed("sum(commits)", "commits").collect()} == {("p", 2), ("q", 1)}
    small.unsubscribe_changes(number)
