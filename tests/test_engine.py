"""Dialect, graph, DDL, mutations, transactions, views, feeds: small fixtures with known answers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.errors import QueryError
from larkspur.functions import geo
from larkspur.operators import graph, relational
from larkspur.operators import vector as vector_ops


def keys(df, c="_key"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def nulls(spark):
    """Two rows have a status, two don't."""
    return Engine(spark).register("p", spark.createDataFrame([("a", "open", 1), ("b", "shut", 2), ("c", None, 3), ("d", None, 4)], "_key string, status string, n bigint"))


CONDITIONS = {
    "a": ["n = 1.0", "status ILIKE 'OP__'", "status LIKE 'op%'", "n = 1 OR status = 'none'", "status = 'open'"],
    "b": ["NOT (status LIKE 'op%')", "NOT (status = 'open')", "status NOT IN ('open')", "status != 'open'", "status <> 'open'"],
    "ab": ["NOT (n > 2)", "status IS NOT NULL", "status IN ('shut', 'open')", "n <= 2"],
    "cd": ["n > 2", "status IS NULL"],
    "bc": ["n = 3 OR status != 'open'", "n BETWEEN 2 AND 3"],
    "ad": ["NOT (n BETWEEN 2 AND 3)"],
    "": ["status != NULL", "status = NULL", "status NOT IN ('open', NULL)"],
}


@pytest.mark.parametrize("expected, condition", [(k, c) for k, cs in CONDITIONS.items() for c in cs])
def test_three_valued_logic(nulls, expected, condition):
    assert "".join(keys(nulls.sql(f"SELECT _key FROM p WHERE {condition}"))) == expected


def test_order_of_nulls_and_limits(nulls):
    get = lambda q: [r["_key"] for r in nulls.sql(q).collect()]
    assert get("SELECT _key FROM p ORDER BY status") == list("abcd")
    assert get("SELECT _key FROM p ORDER BY status DESC") == ["c", "d", "b", "a"]
    assert get("SELECT _key FROM p ORDER BY n DESC LIMIT 2 OFFSET 1") == ["c", "b"]
    assert get("SELECT _key FROM p ORDER BY n / 0 LIMIT 1") == ["a"]
    with pytest.raises(QueryError):
        nulls.sql("SELECT _key FROM p ORDER BY n * 2 DESC, status")


@pytest.mark.parametrize("text", ["SELECT", "SELECT x FROM nowhere", "SELECT _key FROM p WHERE BM25(status, 'a') > 0", "SELECT _key FROM p trailing tokens", "SELECT _key FROM other.p", "SELECT status, COUNT(*) FROM p", "SELECT $3 FROM p", "SELECT _key FROM p UNION SELECT _key FROM p", "SELECT (((", "SELECT _key FROM p WHERE SEARCH('x')"])
def test_errors_come_first(nulls, text):
    with pytest.raises(QueryError):
        nulls.sql(text)


@pytest.fixture(scope="module")
def chain(spark):
    e = Engine(spark)
    e.register("stop", spark.createDataFrame([(k, i) for i, k in enumerate("abcd")], "_key string, v bigint"))
    e.register_edges("then", "stop", "stop", spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "s string, d string"), "s", "d")
    e.register_edges("via", "stop", "stop", spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 3), ("c", "d", 4)], "s string, d string, w bigint"), "s", "d")
    return e


@pytest.mark.parametrize("hop, expected", [("-[:then]->{2}", "c"), ("-[:then]->{1,3}", "bcd"), ("-[:then*2..3]->", "cd"), ("-[:via*1..2]->", "bcdd"), ("-[:then*]->", "b"), ("-[:then]->{2,}", "cd"), ("-[:via]-", "bc"), ("-[:then*0..1]->", "ab")])
def test_walks(chain, hop, expected):
    assert "".join(keys(chain.sql(f"SELECT t._key FROM MATCH (s:stop){hop}(t:stop) WHERE s._key = 'a'"))) == expected


def test_walks_backward_distinct_and_counts(chain):
    assert keys(chain.sql("SELECT DISTINCT t._key FROM MATCH (s:stop)-[:via*1..2]->(t:stop) WHERE s._key = 'a'")) == ["b", "c", "d"]
    assert keys(chain.sql("SELECT t._key FROM MATCH (s:stop)<--(t) WHERE s._key = 'd'")) == ["b", "c", "c"]
    assert chain.sql("SELECT COUNT(*) AS n FROM MATCH (s:stop)-[:via*1..2]->(t:stop) WHERE s._key = 'a'").first()["n"] == 4
    assert chain.sql("SELECT COUNT(DISTINCT t._key) AS n FROM MATCH (s:stop)-[:via*1..2]->(t:stop) WHERE s._key = 'a'").first()["n"] == 3
    # undirected walks don't go straight back
    assert keys(chain.sql("SELECT t._key FROM MATCH (s:stop)-[:then*2..2]-(t:stop) WHERE s._key = 'b'")) == ["d"]
    assert chain.sql("SELECT COUNT(*) AS n FROM MATCH (s:stop)-[:then*2..2]-(t:stop) WHERE s._key = 'b'").first()["n"] == 1


def test_merged_counts_agree_with_listed_walks(chain):
    for d in ("-[:via*1..4]->", "<-[:via*1..3]-", "-[:via*1..4]-"):
        listed = {}
        for r in chain.sql(f"SELECT s._key AS x, t._key AS y, nodes(p) AS p FROM MATCH p = (s:stop){d}(t:stop)").collect():
            listed[r["x"], r["y"]] = listed.get((r["x"], r["y"]), 0) + 1
        merged = {(r["x"], r["y"]): r["n"] for r in chain.sql(f"SELECT s._key AS x, t._key AS y, COUNT(*) AS n FROM MATCH (s:stop){d}(t:stop) GROUP BY s._key, t._key").collect()}
        assert listed == merged


def test_paths_and_graphs(chain):
    r = chain.sql("SELECT nodes(p) AS trail, length(p) AS hops, relationships(p) AS rels FROM MATCH p = (s:stop)-[:then*1..3]->(t:stop) WHERE s._key = 'a' ORDER BY hops DESC LIMIT 1").first()
    assert r["hops"] == 3 and r["trail"] == [*(f"stop/{k}" for k in "abcd")] and [x["type"] for x in r["rels"]] == ["then"] * 3
    g = chain.sql("SELECT GRAPH FROM MATCH (s:stop)-[:via*1..2]->(t) WHERE s._key = 'a'").first()
    assert [n["key"] for n in g["nodes"]] == list("abcd") and len(g["edges"]) == 4
    with pytest.raises(QueryError):
        chain.sql("SELECT p.size FROM MATCH p = (s:stop)-[:then]->(t)")


def test_edge_attributes_and_stages(chain):
    rows = chain.sql("SELECT t._key AS k, r.w AS w FROM MATCH (s:stop)-[r:via]->(t:stop) WHERE r.w > 1 ORDER BY w").collect()
    assert [(r["k"], r["w"]) for r in rows] == [("c", 2), ("d", 3), ("d", 4)]
    rows = chain.sql("SELECT z._key AS k, u AS u FROM MATCH (s:stop)-[r:via]->(t:stop) WITH t, SUM(r.w) AS u MATCH (t)-[:via]->(z:stop) ORDER BY u").collect()
    assert [(r["k"], r["u"]) for r in rows] == [("d", 1.0), ("d", 2.0)]
    assert chain.sql("SELECT SUM(r.w) AS s, AVG(r.w) AS a, COUNT(*) AS n FROM MATCH (s:stop {_key: 'zz'})-[r:via]->(t:stop)").first()[:] == (0.0, None, 0)
    assert keys(chain.sql("SELECT t._key FROM MATCH (s:stop)-[:via {w: 3}]->(t:stop)")) == ["d"]


PLACES = [("north", "mid", "bus"), ("north", "hill", "shuttle"), ("mid", "gate", "walk"), ("hill", "gate", "taxi"), ("gate", "south", "ferry"), ("mid", "south", "taxi")]


@pytest.fixture(scope="module")
def places(spark):
    e = Engine(spark)
    e.register("halts", spark.createDataFrame([(k, k.title(), i) for i, k in enumerate(sorted({x for p in PLACES for x in p[:2]}))], "_key string, name string, rank bigint"))
    for t in {p[2] for p in PLACES}:
        e.register_edges(t, "halts", "halts", spark.createDataFrame([p[:2] for p in PLACES if p[2] == t], "s string, d string"), "s", "d")
    return e


def test_shortest_paths(places):
    q = "SELECT f.name AS a, nodes(r) AS trail, length(r) AS hops FROM MATCH SHORTEST (f:halts)-[r*]->(g:halts) WHERE g._key = '{1}' AND f._key = '{0}'"
    assert places.sql(q.format("north", "south")).first()[:] == ("North", ["halts/north", "halts/mid", "halts/south"], 2)
    assert places.sql(q.format("mid", "mid")).first()["hops"] == 0
    assert places.sql(q.format("south", "north")).count() == 0
    assert places.sql(q.format("mid", "nowhere")).count() == 0
    quant = q + " AND {2}(h IN nodes(r) WHERE h.name = 'Mid')"
    assert [places.sql(quant.format("north", "south", k)).count() for k in ("ANY", "ALL", "NONE", "SINGLE")] == [1, 0, 0, 1]
    assert places.bfs_shortest_len("halts/north", "halts/gate") == 2
    for bad in ("-[r:bus*]->", "-[r*1..2]->"):
        with pytest.raises(QueryError):
            places.sql(f"SELECT f.name FROM MATCH SHORTEST (f){bad}(g) WHERE f._key = 'halts/mid' AND g._key = 'halts/hill'")


def test_shortest_paths_against_python(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        edges = sorted({(f"p/{i}", f"p/{rng.randrange(60)}", rng.choice("xy")) for i in range(60) for _ in range(2)})
        df = spark.createDataFrame(edges, "src string, dst string, type string")
        for goal in ("p/0", "p/7", "p/41", "p/none"):
            best, level = {"p/0": (("p/0", ""),)}, {"p/0": (("p/0", ""),)}
            while level and goal not in best:
                grown = {}
                for a, b, t in edges:
                    if a in level and b not in best:
                        grown[b] = min(grown.get(b, ((chr(0x10FFFF), ""),)), (*level[a], (b, t)))
                best, level = best | grown, grown
            want = [([n for n, _ in best[goal]], [t for _, t in best[goal]][1:])] if goal in best else []
            for most in (20_000, 3):
                got = [(r["nodes"], r["types"]) for r in graph.shortest_path(df, "p/0", goal, most=most).collect()]
                assert got == want, (seed, goal, most)


def test_caps_are_errors(spark, chain):
    for text in (f"SELECT _key FROM stop LIMIT {2**31}", "SELECT s._key FROM MATCH (s:stop)-[:then*1..100001]->(t)", "SELECT SUBSTRING(_key, 1, 100000001) AS s FROM stop"):
        with pytest.raises(QueryError):
            chain.sql(text)
    with pytest.raises(QueryError):
        graph.bfs(spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "b")], "src string, dst string"), 100_001)
    e = Engine(spark).register("v", spark.createDataFrame([("a", [1.0])], "_key string, emb array<float>"))
    with pytest.raises(QueryError):
        e.sql("SELECT _key FROM v WHERE VECTOR_NEAR(emb, [1], 1000001)")


def test_every_changed_key_is_published(spark):
    e, events = Engine(spark), []
    e.register("n", spark.range(12_000).selectExpr("cast(id AS string) AS _key", "id AS v"))
    e.execute("UPDATE n SET v = 1 WHERE v < 3")  # nobody listens
    e.subscribe_changes(events.append)
    e.execute("UPDATE n SET v = -1 WHERE v > 1")
    e.execute("DELETE FROM n WHERE v = -1")
    assert [len(x["keys"]) for x in events] == [11_997, 11_997] and "n/11999" in events[0]["keys"]


def test_bfs_against_python(spark):
    import random

    rng = random.Random(3)
    edges = sorted({(f"p/{i}", f"p/{rng.randrange(40)}") for i in range(40) for _ in range(3)})
    df = spark.createDataFrame(edges, "src string, dst string")
    depth, level = {"p/0": 0}, ["p/0"]
    for k in range(1, 5):
        level = sorted({d for s, d in edges if s in level and d not in depth})
        depth |= {d: k for d in level}
    got = {r["node"]: r["depth"] for r in graph.bfs(spark.createDataFrame([("p/0",)], "node string"), df, 4).collect()}
    assert got == depth


def test_multi_from_and_union(chain):
    assert chain.sql("SELECT s._key AS x, m._key AS m FROM MATCH (s:stop)-[:then]->(t:stop), stop AS m").count() == 12
    got = chain.sql("SELECT t._key AS k FROM MATCH (s:stop)-[:then]->(t:stop) UNION SELECT t._key AS k FROM MATCH (s:stop)-[:via]->(t:stop)")
    assert keys(got, "k") == ["b", "c", "d"]


def test_tables_mutations_and_transactions(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (_key TEXT PRIMARY KEY, name TEXT NOT NULL, city TEXT DEFAULT 'x', n INTEGER, full TEXT GENERATED ALWAYS AS (concat_ws(' ', name, city)) STORED)")
    assert e.execute("INSERT INTO t (_key, name, n) VALUES ('a', 'Ann', 1), ('b', 'Bob', 2)") == 2
    assert e.get("t/a")["full"] == "Ann x" and e.get("t/a")["_created_unix"] > 0
    for bad in ("INSERT INTO t (_key, name, n) VALUES ('c', 'C', 'text')", "INSERT INTO t (_key, nope) VALUES ('c', 1)", "INSERT INTO t (_key, n) VALUES ('c', 1)"):
        with pytest.raises(QueryError):
            e.execute(bad)
    assert e.execute("UPDATE t SET n = 5, city = 'y' WHERE name = 'Ann'") == 1
    assert e.get("t/a")["full"] == "Ann y"
    e.execute("BEGIN")
    e.execute("DELETE FROM t WHERE n > 4")
    assert e.node_count() == 1
    e.execute("ROLLBACK")
    assert e.node_count() == 2
    with pytest.raises(QueryError):
        e.execute("COMMIT")
    e.execute("ALTER TABLE t ADD COLUMN z REAL DEFAULT 1.5")
    e.execute("ALTER TABLE t RENAME COLUMN z TO zz")
    assert e.get("t/b")["zz"] == 1.5
    e.execute("ALTER TABLE t DROP COLUMN zz")
    e.execute("ALTER TABLE t RENAME TO u")
    assert e.collection_names() == ["u"] and "u" in e.sql("SHOW CREATE TABLE u").first()[0]
    e.execute("DROP TABLE u")
    e.execute("DROP TABLE IF EXISTS u")
    assert e.collection_names() == []


def test_edges_upsert_update_delete_and_cascade(spark):
    e = Engine(spark)
    e.put_many([("w/one", {"v": 1}), ("w/two", {"v": 2})])
    e.execute("INSERT ('w/one')-[:tie {_key: 'k', w: 1, tag: 'x'}]->('w/two'), ('w/one')-[:tie {w: 2, tag: 'y'}]->('w/two')")
    e.execute("INSERT ('w/one')-[:tie {_key: 'k', w: 7, tag: 'x'}]->('w/two')")
    assert sorted(r["val"] for r in e.sql("SELECT r.w AS val FROM MATCH (f:w)-[r:tie]->(g:w)").collect()) == [2, 7]
    assert e.execute("UPDATE ('w/one')-[:tie {tag: 'y'}]->('w/two') SET w = 9") == 1
    assert e.execute("DELETE ('w/one')-[r:tie]->('w/two') WHERE r.w < 8") == 1
    assert e.edge_count() == 1 and e.edges_from("w/one").count() == 1
    assert e.execute("MATCH (x:w) WHERE x.v > 1 INSERT (x)-[:likes]->('w/one')") == 1
    assert e.edges_between("w", "w").count() == 2
    e.remove("w/two")
    assert e.edge_count() == 0 and e.node_count() == 1


def test_feed_snapshot_and_views(spark):
    e, events = Engine(spark), []
    number = e.subscribe_changes(events.append)
    e.put("s/1", {"title": "Yesterday"})
    e.execute("BEGIN")
    e.put("s/2", {"title": "Help"})
    e.link("s/1", "s/2", "then")
    e.execute("COMMIT")
    with pytest.raises(ZeroDivisionError), e.transaction():
        e.put("s/3", {"title": "Gone"})
        raise ZeroDivisionError
    assert not e.contains("s/3") and e.memory_report() == {"storage": 0}
    assert len(events) == 2 and events[1]["edge_types"] == ["then"] and "s/2" in events[1]["keys"]
    old = e.snapshot()
    e.execute("CREATE MATERIALIZED VIEW v WITH (autoindex = true) AS SELECT a._key AS id, a.title || ' ' || b.title AS text FROM MATCH (a:s)-[:then]->(b:s)")
    assert e.sql("SELECT text FROM v WHERE BM25(text, 'yesterday') > 0").first()[0] == "Yesterday Help"
    e.execute("UPDATE s SET title = 'Today' WHERE _key = '1'")
    assert e.get("v/1")["text"] == "Yesterday Help"
    e.execute("REFRESH MATERIALIZED VIEW v")
    assert e.get("v/1")["text"] == "Today Help"
    assert old.get("s/1")["title"] == "Yesterday"
    with pytest.raises(QueryError):
        old.put("s/9", {})
    e.unsubscribe_changes(number)


def test_scalar_functions(spark):
    e = Engine(spark).register("d", spark.createDataFrame([("a", "2024-07-15T14:30:45Z", "\t Hé x \n", '{"k": {"j": [1, 2]}}', ["p", "q"]), ("b", "junk", None, None, None)], "_key string, at string, s string, j string, tags array<string>"))
    r = e.sql("SELECT YEAR(at) AS y, MONTH(at) AS m, DAY(at) AS d, HOUR(at) AS h, MINUTE(at) AS mi, SECOND(at) AS s, DOW(at) AS w, QUARTER(at) AS q, DATE_TRUNC('month', at) AS t, TRIM(s) AS trim, LENGTH(s) AS n, j->'k'->>'j' AS j, JSON_ARRAY_LENGTH(tags) AS len, SUBSTRING(s, 0, 3) AS sub FROM d ORDER BY _key LIMIT 1").first()
    assert r[:] == (2024, 7, 15, 14, 30, 45, 1, 3, "2024-07-01T00:00:00Z", "Hé x", 8, "[1,2]", 2, "\t H")
    assert e.sql("SELECT YEAR(at) AS y FROM d WHERE _key = 'b'").first()[0] == 0
    assert keys(e.sql("SELECT _key FROM d WHERE tags @> ['p', 'q']")) == ["a"]
    assert keys(e.sql("SELECT _key FROM d WHERE 'q' = ANY(tags)")) == ["a"]
    t = Engine(spark).register("t", spark.sql("SELECT '1' AS _key, current_timestamp() - interval 1 hour AS at, 5 AS ms, 9999999999 AS s"))
    assert keys(t.sql("SELECT _key FROM t WHERE at < NOW() AND ms < NOW() AND s < NOW()")) == ["1"]
    assert t.sql("SELECT x._key FROM MATCH (x:t) WHERE x.s < NOW()").count() == 0
    assert e.sql("SELECT AGE_DAYS(at) AS a FROM d WHERE _key = 'a'").first()[0] > 0
    assert e.sql("SELECT UUIDV5('6ba7b810-9dad-11d1-80b4-00c04fd430c8', 'x') AS u FROM d LIMIT 1").first()[0][14] == "5"


def test_bm25_and_search_against_python(spark):
    docs = {"1": ("Rust language", "Rust is fast and safe"), "2": ("Python", "slow but kind language"), "3": ("Rost", "iron oxide"), "4": ("", None)}
    e = Engine(spark).register("d", spark.createDataFrame([(k, *v) for k, v in docs.items()], "_key string, title string, body string")).index("d", "bm25", "body").index("d", "search", "title", "body")
    toks = {k: [w for w in (b or "").lower().split() if len(w) >= 3] for k, (_, b) in docs.items() if b is not None}
    mean = sum(map(len, toks.values())) / len(toks)
    want = {}
    for k, t in toks.items():
        s = 0.0
        for q in ("rust", "language"):
            df = sum(q in x for x in toks.values())
            tf = t.count(q)
            s += math.log(1 + (len(toks) + 0.5 - df) / (0.5 + df)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) if df else 0
        want[k] = s
    got = {r["_key"]: r["s"] for r in e.sql("SELECT _key, BM25(body, 'rust language rust') AS s FROM d").collect()}
    assert all(abs(got[k] - want.get(k, 0.0)) < 1e-9 for k in docs)
    assert keys(e.sql("SELECT _key FROM d WHERE SEARCH('rust')")) == ["1"]
    assert keys(e.sql("SELECT _key FROM d WHERE SEARCH('rusts')")) == ["1"]  # not known: one edit
    assert keys(e.sql("SELECT _key FROM d WHERE SEARCH('languag fast')")) == ["1"]
    assert keys(e.sql("SELECT _key FROM d WHERE SEARCH('oxade', typo => 0)")) == [] and keys(e.sql("SELECT _key FROM d WHERE SEARCH('oxade', typo => 1)")) == ["3"]
    s = e.sql("SELECT SEARCH_SCORE('rust language') AS s FROM d WHERE _key = '1'").first()[0]
    assert s == 1e12 + 1e9 + 1e6 + 1e3 + 1
    assert [r["_key"] for r in e.bm25_search("d", "body", "language", 5).collect()] == ["2"]


def test_stored_text_indexes_give_the_same_answers(spark):
    from larkspur.operators import postings

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    plain, kept = (Engine(spark).register("d", docs, "doc_id") for _ in range(2))
    plain.index("d", "bm25", "text").index("d", "search", "source", "text")
    kept.execute("CREATE INDEX ON d USING bm25 (text)")
    kept.execute("CREATE INDEX ON d USING search (source, text)")
    asked = [
        "SELECT _key, ROUND_(BM25(text, 'the license than apache')) AS s FROM d WHERE BM25(text, 'the license than apache') > 0.5",
        "SELECT _key, ROUND_(BM25_NORM(text, 'license version')) AS s FROM d",
        "SELECT _key FROM d WHERE SEARCH('license apache')", "SELECT _key FROM d WHERE SEARCH('licensf')", "SELECT _key FROM d WHERE SEARCH('licensf apache', typo => 0)",
        "SELECT _key FROM d WHERE SEARCH('src1')", "SELECT _key FROM d WHERE SEARCH('zzzzzz nothing')", "SELECT _key FROM d ORDER BY BM25(text, 'license') DESC LIMIT 7",
    ]

    def agree():
        for q in asked:
            a, b = (sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in e.sql(q.replace("ROUND_", "")).collect()) for e in (plain, kept))
            assert a == b, q
        a, b = ([(r["_key"], round(r["score"], 6)) for r in e.bm25_search("d", "text", "license version", 9).collect()] for e in (plain, kept))
        assert a == b and len(a) > 1

    agree()
    index = kept.catalog.postings("d", ["text"])
    assert index.rows == docs.count() and "PushedFilters: [In(term" in index.table.filter("term in ('license', 'apache')")._jdf.queryExecution().toString()
    again = Engine(spark).register("d", docs, "doc_id").index("d", "bm25", "text", stored=True)
    assert again.catalog.postings("d", ["text"]) is index  # the same files: built once
    for e in (plain, kept):
        e.execute("UPDATE d SET text = 'license license of nothing' WHERE _key = '3'")
        e.execute("DELETE FROM d WHERE _key = '5'")
        e.execute("INSERT INTO d (_key, text) VALUES ('900', 'apache version')")
    assert kept.catalog.postings("d", ["text"]) is not index
    agree()
    kept.execute("DROP INDEX ON d USING bm25 (text)")
    assert kept.catalog.postings("d", ["text"]) is None
    twice = spark.createDataFrame([("a", "one word"), ("a", "one word")], "_key string, text string")
    assert postings.build(twice, ["text"]) is None  # without one row a key the texts are read
    e = Engine(spark).register("t", twice).index("t", "bm25", "text", stored=True)
    assert e.sql("SELECT _key FROM t WHERE BM25(text, 'word') > 0").count() == 2


def shuffled(spark, run):
    """Bytes that run() shuffles."""
    import uuid

    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = 0
    for job in sc.statusTracker().getJobIdsForGroup(group):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            try:
                total += sc._jsc.sc().statusStore().lastStageAttempt(stage).shuffleWriteBytes()
            except Exception:  # skipped
                pass
    sc.setLocalProperty("spark.jobGroup.id", None)
    return total


def test_a_text_index_is_built_without_moving_its_postings(spark):
    from larkspur.operators import postings

    docs = spark.range(0, 800, 1, 8).selectExpr("cast(id as string) AS _key", "array_join(transform(sequence(0, 499), i -> concat('word', (i * (id + 1)) % 2003)), ' ') AS text")
    size = docs.selectExpr("sum(length(text))").first()[0]
    made = []
    assert shuffled(spark, lambda: made.append(postings.build(docs, ["text"]))) < size / 10
    index = made[0]
    assert index.table.groupBy("term", "key").count().filter("count > 1").count() == 0
    assert index.table.selectExpr("sum(tf)").first()[0] == 800 * 500 and index.mean == 500


def test_text_index_in_small_segments_and_with_many_near_terms(spark, monkeypatch):
    from larkspur.operators import postings

    texts = ["lantern lanterns", "lantern", "lanternz apple", "lenterns apple apple", None, "", "apple " * 50, "lanterna", "x"]
    rows = [(str(i), t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "_key string, text string").coalesce(1)
    monkeypatch.setattr(postings, "CHUNK", 3)
    parts = list(postings._segments(iter([_tokens_of(texts)])))
    assert [sorted(b["term"].to_pylist()) for b in parts] == [b["term"].to_pylist() for b in parts] and len(parts) > 3
    assert sorted(r for b in parts for r in zip(*(b[c].to_pylist() for c in ("term", "key", "tf", "dl")))) == [
        ("apple", "2", 1, 2), ("apple", "3", 2, 3), ("apple", "6", 50, 50), ("lantern", "0", 1, 2), ("lantern", "1", 1, 1), ("lanterna", "7", 1, 1), ("lanterns", "0", 1, 2), ("lanternz", "2", 1, 2), ("lenterns", "3", 1, 3),
    ]
    index = postings.build(docs, ["text"])
    for named in (500, 1):
        monkeypatch.setattr(postings, "NAMED", named)
        found = lambda terms, edits: sorted(r[0] for r in index.matching(terms, edits).collect())
        assert found(["lanternx"], [1]) == ["0", "1", "2", "7"]
        assert found(["lanternx", "apple"], [1, 1]) == ["2"] and found(["apple", "lanternx"], [1, 2]) == ["2", "3"]
        assert found(["lanternx", "nothing"], [1, 1]) == [] and found(["lanternx"], [0]) == []


def _tokens_of(texts):
    import pyarrow as pa

    tokens = [[t for t in (x or "").split() if len(t) > 2] for x in texts]
    return pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(tokens, pa.list_(pa.string()))], ["key", "t"])


def test_search_score_of_a_long_text_takes_each_token_once(spark):
    import time

    text = "rust " + "filler words " * 20_000 + "langage"
    df = spark.createDataFrame([("1", text)], "_key string, text string")
    e = Engine(spark).register("d", df).index("d", "search", "text")
    score = lambda: e.sql("SELECT SEARCH_SCORE('rust language') AS s FROM d").first()[0]
    score()
    t = time.time()
    assert score() == pytest.approx(1e12 + 0.75e9 + 1e6 / (1 + 40_001 // 8) + 1e3 + 2 / 40_002, abs=1)
    assert time.time() - t < 5


def test_reindex_of_one_collection_leaves_the_others(spark):
    docs = spark.createDataFrame([("a", "one word"), ("b", "two words")], "_key string, text string")
    e = Engine(spark).register("d", docs).register("other", docs)
    for c in ("d", "other"):
        e.execute(f"CREATE INDEX ON {c} USING bm25 (text)")
    e.execute("CREATE INDEX ON d USING search (_key, text)")
    built = lambda: [e.catalog.postings(c, f) for c, f in (("d", ["text"]), ("d", ["_key", "text"]), ("other", ["text"]))]
    first = built()
    e.catalog.collection("d").postings.clear()
    e.catalog.collection("other").postings.clear()
    e.execute("REINDEX other")
    assert not e.catalog.collection("d").postings and e.catalog.collection("other").postings
    e.execute("REINDEX ON d USING bm25 (text)")
    assert list(e.catalog.collection("d").postings) == [("text",)]
    e.execute("REINDEX")
    assert len(e.catalog.collection("d").postings) == 2 and all(first)
    with pytest.raises(QueryError):
        e.execute("REINDEX nowhere")


def test_vectors(spark):
    rows = [("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2), ("c", [0.9, 0.1], 3), ("z", [0.0, 0.0], 4), ("n", None, 5)]
    e = Engine(spark).register("v", spark.createDataFrame(rows, "_key string, emb array<float>, n int"))
    assert [r[0] for r in e.sql("SELECT _key FROM v ORDER BY emb <=> [1, 0]").collect()] == ["a", "c", "b", "z", "n"]
    assert [r[0] for r in e.sql("SELECT _key FROM v WHERE VECTOR_NEAR(emb, [1, 0], 2) AND n > 1").collect()] == ["c"]
    assert [r[0] for r in e.sql("SELECT _key FROM v ORDER BY VECTOR_COSINE(emb, [1, 0]) DESC LIMIT 1").collect()] == ["a"]
    with pytest.raises(QueryError):
        e.sql("SELECT _key FROM v WHERE VECTOR_NEAR(emb, [1, 0, 0], 2)")
    df = e.catalog.nodes("v")
    joined = vector_ops.nearest_join(df, "emb", spark.createDataFrame([("q", [1.0, 0.0]), ("no", None)], "query string, vector array<double>"), 2).collect()
    assert [r["_key"] for r in sorted(joined, key=lambda r: r["distance"])] == ["a", "c"]
    bounds = vector_ops.calibrated(df.filter("emb is not null"), "emb")
    assert [r["_key"] for r in vector_ops.nearest_compact(vector_ops.quantised(df, "emb", bounds), "emb", [1.0, 0.0], 2, bounds).collect()] == ["a", "c"]
    fused = relational.reciprocal_rank_fusion([(df.filter("n < 3"), F.asc("n"), 1.0), (df.filter("n < 4"), F.desc("n"), 1.0)], "_key")
    assert {r["_key"]: round(r["score"], 6) for r in fused.collect()} == {"a": round(1 / 61 + 1 / 63, 6), "b": round(1 / 62 + 1 / 62, 6), "c": round(1 / 61, 6)}


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot", "l1"])
def test_nearest_join_against_brute_force(spark, metric):
    import random

    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(6)]) for i in range(90)]
    df = spark.createDataFrame(rows, "k bigint, v array<float>").repartition(3)

    def distance(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        if metric == "dot":
            return -dot
        if metric == "cosine":
            n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
            return round(1 - dot / n, 9) if n else 1.0
        return sum(abs(x - y) if metric == "l1" else (x - y) ** 2 for x, y in zip(a, b))

    want = {(str(q), k) for q, a in rows for _, k in sorted((distance(a, b), k) for k, b in rows)[:4]}
    got = vector_ops.nearest_join(df, "v", df.select(F.col("k").alias("query"), F.col("v").alias("vector")), 4, metric, "k", block_numbers=200)
    assert {(r["query"], r["k"]) for r in got.collect()} == want


def test_geometry(spark):
    pt = lambda x, y: f'{{"coordinates":[{x},{y}],"type":"Point"}}'
    sq = '{"coordinates":[[[144.9,-37.9],[145.0,-37.9],[145.0,-37.8],[144.9,-37.8],[144.9,-37.9]]],"type":"Polygon"}'
    mp = '{"coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[144.9,-37.9],[145.0,-37.9],[145.0,-37.8],[144.9,-37.9]]]],"type":"MultiPolygon"}'
    ln = '{"coordinates":[[144.9,-37.9],[145.0,-37.9]],"type":"LineString"}'
    e = Engine(spark).register("g", spark.createDataFrame([("cbd", pt(144.9631, -37.8136)), ("far", pt(151.2, -33.9)), ("sq", sq), ("mp", mp), ("ln", ln), ("no", None)], "_key string, geometry string"))
    where = lambda c: keys(e.sql(f"SELECT _key FROM g WHERE {c}"))
    assert where("ST_DWithin(geometry, POINT(144.961 -37.812), 5000)") == ["cbd", "mp", "sq"]
    assert where("ST_Contains(geometry, POINT(144.93 -37.85))") == ["sq"]
    assert where("ST_Contains(geometry, POINT(144.99 -37.88))") == ["mp", "sq"]
    assert where("ST_Within(geometry, POLYGON((144 -38, 146 -38, 146 -37, 144 -37, 144 -38)))") == ["cbd", "ln", "sq"]
    assert where("ST_Intersects(geometry, POLYGON((144.95 -38, 144.96 -38, 144.96 -37, 144.95 -37, 144.95 -38)))") == ["ln", "mp", "sq"]
    m = {r["_key"]: r for r in e.sql("SELECT _key, ST_Area(geometry) AS a, ST_Perimeter(geometry) AS p, ST_Length(geometry) AS l, ST_Distance(geometry, POINT(144.9631 -37.8136)) AS d FROM g").collect()}
    assert m["cbd"]["d"] == 0
    # Flinders Peak to Buninyong, the published test line of Vincenty's method
    assert abs(geo.vincenty_m(-37.95103342, 144.42486788, -37.65282114, 143.92649554) - 54_972.271) < 0.01
    assert abs(m["ln"]["l"] - 8_794) < 5 and m["sq"]["l"] == 0 and m["ln"]["p"] is None
    assert abs(m["sq"]["a"] - 97.7e6) < 0.3e6 and abs(m["sq"]["p"] - 39_780) < 30


def test_keys_made_from_numbers_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "id * 2 AS v").write.parquet(f"{tmp_path}/t")
    e = Engine(spark).register("t", lambda: spark.read.parquet(f"{tmp_path}/t"), "k")
    e.register_edges("up", "t", "t", lambda: spark.range(99).selectExpr("id AS a", "id + 1 AS b"), "a", "b", sound=True)
    assert "EqualTo(k,17)" in e.explain("SELECT v FROM t WHERE _key = '17'") and e.sql("SELECT v FROM t WHERE _key = '17'").first()[0] == 34
    assert "EqualTo(k,17)" in e.explain("SELECT y._key FROM MATCH (x:t)-[:up]->(y:t) WHERE x._key = '17'")
    assert e.sql("SELECT v FROM t WHERE _key = '017'").count() == 0
    assert "In(k, [17,4])" in e.explain("SELECT v FROM t WHERE _key IN ('17', '4')") and e.sql("SELECT v FROM t WHERE _key IN ('17', '4', '017')").count() == 2
    assert "isFinalPlan=true" in e.explain("SELECT v, COUNT(*) AS n FROM t GROUP BY v", analyze=True)
    e.execute("INSERT INTO t (_key, v) VALUES ('17', 5), ('500', 6)")
    assert [e.sql(f"SELECT v FROM t WHERE _key = '{k}'").first()[0] for k in (17, 500)] == [5, 6]


def test_cycles_and_mixed_collections(spark, chain):
    e = Engine(spark)
    e.put_many([("a/1", {"v": 1}), ("a/2", {"v": 2}), ("b/1", {"v": 3})])
    e.link_many([("a/1", "a/2", "to"), ("a/2", "a/1", "to"), ("a/1", "b/1", "to"), ("b/1", "a/1", "back")])
    assert keys(e.sql("SELECT y._id AS k FROM MATCH (x:a)-[:to]->(y)"), "k") == ["a/1", "a/2", "b/1"]
    assert keys(e.sql("SELECT y._id AS k FROM MATCH (x:a)-[:to]->(y:b)"), "k") == ["b/1"]
    assert keys(e.sql("SELECT y._id AS k FROM MATCH (x:a)-[:to]->(y)-[]->(x)"), "k") == ["a/1", "a/2", "b/1"]
    assert keys(e.sql("SELECT z._id AS k FROM MATCH (x:b)-[:back]->(y)-[:to*1..2]->(z) WHERE y.v = 1"), "k") == ["a/1", "a/2", "b/1"]
    assert keys(e.sql("SELECT z._id AS k FROM MATCH (x:a)-[:to]->(y) WITH y MATCH (y)-[:back]->(z:a)"), "k") == ["a/1"]
    assert e.sql("SELECT y._id AS k, nodes(p) AS n FROM MATCH (x:b)-[:back]->(y:a) WITH y MATCH p = (y)-[:to]->(z:a)").first()[:] == ("a/1", ["a/1", "a/2"])


def test_builder(chain, nulls):
    q = nulls.collection("p")
    assert q.where_gte("n", 2).where_neq("status", "open").count() == 1
    assert [r["_key"] for r in q.sort("n", descending=True).skip(1).take(2).collect()] == ["c", "b"]
    assert q.like("status", "%").count() == 0 and q.ilike("status", "PE").count() == 1
    assert keys(chain.one("stop/a").forward("via").df) == ["b", "c"] and keys(chain.one("stop/d").backward("via").df) == ["b", "c"]
    assert keys(chain.one("stop/a").hops(1).df) == ["a", "b", "c"] and keys(chain.one("stop/a").hops_typed("then", 2).df) == ["b", "c"]
    assert keys(chain.collection("stop").leaves().df) == ["d"] and keys(chain.collection("stop").roots().df) == ["a"]
    assert keys(chain.many(["stop/a", "stop/c", "stop/zz"]).df) == ["a", "c"] and chain.all().count() == 4


def test_answers_do_not_depend_on_layout(spark, chain):
    q = "SELECT s._key AS x, COUNT(*) AS n FROM MATCH (s:stop)-[:via*1..3]->(t:stop) GROUP BY s._key"
    want = sorted(r[:] for r in chain.sql(q).collect())
    for k, v in (("spark.sql.shuffle.partitions", "1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        old = spark.conf.get(k)
        spark.conf.set(k, v)
        assert sorted(r[:] for r in chain.sql(q).collect()) == want
        spark.conf.set(k, old)


def test_nearest_join_keeps_near_rows_beside_unusable_ones(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [nan, 1.0]), (4, None)]
    df = spark.createDataFrame(rows, "k bigint, v array<double>").coalesce(1)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query string, vector array<double>")
    assert [tuple(r) for r in vector_ops.nearest_join(df, "v", asked, 2, "l2", "k").collect()] == [("q", 1, 0.0)]


def test_nearest_join_looks_only_at_rows_nearer_than_the_kth(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r, seen, real = np.random.default_rng(3), [], np.round
    q, v = r.normal(size=(50, 8)), r.normal(size=(4000, 8))
    monkeypatch.setattr(np, "round", lambda x, n: (seen.append(x.size), real(x, n))[1])
    schema = pa.schema([("query", pa.string()), ("k", pa.int64()), ("distance", pa.float64())])
    shared = type("S", (), {"value": ([str(i) for i in range(50)], q)})
    batches = (pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 500)), pa.array(v[a : a + 500].tolist())], ["k", "_v"]) for a in range(0, 4000, 500))
    got = pa.Table.from_batches(vector_ops._nearest_of(shared, 3, "l2", "k", schema)(batches)).to_pylist()
    want = [np.argsort(((v - x) ** 2).sum(1))[:3].tolist() for x in q]
    assert [[g["k"] for g in got if g["query"] == str(i)] for i in range(50)] == want
    assert sum(seen) < 50 * 4000 / 20
