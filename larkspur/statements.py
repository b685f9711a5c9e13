"""More registered queries: changes to rows, edges and tables, sources and sinks, functions, and a large cyclic graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .functions import geo
from .operators import graph
from .queries import _FROM, _QSQL, _TOK, _V, _ZONE, _L1, _Q, ask, call, vincenty_sql
from .scratch import folder
from .sources import dump, files

# a graph of all orders, with cycles: two edges from each
_FOLLOWS = "n_ AS (SELECT count(*) AS n FROM orders), f AS (SELECT o_orderkey AS s, (o_orderkey * 7 + 3) % n AS d, cast(7 AS double) AS w FROM orders, n_ UNION ALL SELECT o_orderkey, (o_orderkey * 11 + 1) % n, cast(11 AS double) FROM orders, n_)"
_REACH = f"WITH RECURSIVE {_FOLLOWS}, r AS (SELECT {{start}} AS b, 0 AS k UNION SELECT d, k + 1 FROM r JOIN f ON s = b WHERE k < {{depth}})"
ask(
    "graph_walks",
    "SELECT b.o_orderstatus AS status, COUNT(*) AS walks, COUNT(DISTINCT b._key) AS ends FROM MATCH (a:orders)-[:follows*1..3]->(b:orders) WHERE a.o_orderpriority = '1-URGENT' GROUP BY b.o_orderstatus",
    f"WITH {_FOLLOWS}, a AS (SELECT o_orderkey AS b FROM orders WHERE o_orderpriority = '1-URGENT'), w1 AS (SELECT d AS b FROM a JOIN f ON s = b), w2 AS (SELECT d AS b FROM w1 JOIN f ON s = b), w3 AS (SELECT d AS b FROM w2 JOIN f ON s = b), w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) SELECT o_orderstatus AS status, count(*) AS walks, count(DISTINCT b) AS ends FROM w JOIN orders ON o_orderkey = b GROUP BY 1",
)
ask("graph_backward", "SELECT a._key AS a, b._key AS b, r.w AS w FROM MATCH (a:orders)<-[r:follows]-(b:orders) WHERE a.o_totalprice > 400000", f"WITH {_FOLLOWS} SELECT cast(d AS varchar) AS a, cast(s AS varchar) AS b, round(w, 4) AS w FROM f JOIN orders ON o_orderkey = d WHERE o_totalprice > 400000")
_SHORT = "SELECT length(r) AS hops FROM MATCH SHORTEST (a:orders)-[r*]->(b:orders) WHERE a._key = '1' AND b._key = '{}'"
_HOPS = _REACH.format(start=1, depth=14) + " SELECT cast(min(k) AS integer) AS hops FROM r WHERE b = {} HAVING count(*) > 0"
ask("graph_shortest", _SHORT.format(934), _HOPS.format(934))
ask("graph_shortest_all", _SHORT.format(934) + " AND ALL(h IN nodes(r) WHERE h.o_orderkey >= 0)", _HOPS.format(934))
ask("graph_shortest_any", _SHORT.format(934) + " AND ANY(h IN nodes(r) WHERE h.o_orderkey = 934)", _HOPS.format(934))
ask("graph_shortest_none", _SHORT.format(934) + " AND NONE(h IN nodes(r) WHERE h.o_orderkey = 1)", "SELECT cast(1 AS integer) AS hops WHERE false")
ask("graph_shortest_single", _SHORT.format(934) + " AND SINGLE(h IN nodes(r) WHERE h.o_orderkey = 1)", _HOPS.format(934))
ask("path_folds", "SELECT b._key AS b, PATH_AVG(r.w) AS mean, PATH_MIN(r.w) AS lo, PATH_MAX(r.w) AS hi, PATH_FIRST(r.w) AS first FROM MATCH (a:nation)-[r:trades*1..3]->(b:nation)", "WITH RECURSIVE t AS (SELECT n_nationkey AS s, (n_nationkey + 7) % 25 AS d, cast(n_nationkey % 4 AS double) AS w FROM nation), x AS (SELECT d AS b, [w] AS ws, 1 AS k FROM t UNION ALL SELECT d, list_append(ws, w), k + 1 FROM x JOIN t ON s = b WHERE k < 3) SELECT cast(b AS varchar) AS b, round(list_avg(ws), 4) AS mean, list_min(ws) AS lo, list_max(ws) AS hi, ws[1] AS first FROM x")
ask("match_node", "SELECT n.n_name AS name, n.* FROM MATCH (c:customer)-[:in_nation]->(n:nation) WHERE c._key = '7'", "SELECT n_name AS name, cast(n_nationkey AS varchar) AS _key, n_nationkey, n_name, n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 7")
ask("match_coalesce", "SELECT COALESCE(c.c_mktsegment, 'none') AS seg, COUNT(*) AS n FROM MATCH (c:customer)-[:placed]->(o:orders) GROUP BY COALESCE(c.c_mktsegment, 'none')", "SELECT coalesce(c_mktsegment, 'none') AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")


@call("graph_bfs", _REACH.format(start=0, depth=8) + " SELECT 'orders/' || b AS node, cast(min(k) AS integer) AS depth FROM r GROUP BY b")
def _(e: Engine) -> DataFrame:
    return graph.bfs(e.spark.sql("SELECT 'orders/0' AS node"), e.edges(["follows"]).select(F.col("from").alias("src"), F.col("to").alias("dst")), 8)


@call("select_graph", "WITH e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS d FROM nation), w1 AS (SELECT s, d FROM e WHERE s = 7), w2 AS (SELECT e.s, e.d FROM e JOIN w1 ON e.s = w1.d), w AS (SELECT * FROM w1 UNION SELECT * FROM w2) SELECT list_sort((SELECT list(DISTINCT cast(x AS varchar)) FROM (SELECT s AS x FROM w UNION SELECT d FROM w))) AS keys, (SELECT count(*) FROM w) AS edges")
def _(e: Engine) -> DataFrame:
    g = e.sql("SELECT GRAPH FROM MATCH (a:nation)-[:leads*1..2]->(b:nation) WHERE a._key = '7'")
    return g.select(F.array_sort(F.transform("nodes", lambda n: n["key"])).alias("keys"), F.size("edges").cast("bigint").alias("edges"))


@call("bfs_shortest_len", _REACH.format(start=2, depth=12) + " SELECT cast(min(k) AS integer) AS hops FROM r WHERE b = 122 HAVING count(*) > 0")
def _(e: Engine) -> DataFrame:
    return e.shortest_path("orders/2", "orders/122").select(F.col("length").alias("hops"))


# functions and conditions
ask("qualified_alias", "SELECT n.n_name AS name FROM public.nation AS n WHERE n.n_regionkey = 2", "SELECT n_name AS name FROM nation WHERE n_regionkey = 2")
ask("sum_math", "SELECT l_returnflag, SUM(l_extendedprice * (1 - l_discount)) AS revenue, MAX(l_quantity + 1) AS most, AVG(l_quantity / 2) AS half FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, max(l_quantity + 1) AS most, round(avg(l_quantity / 2), 4) AS half FROM lineitem GROUP BY 1")
ask("time_parts", "SELECT event_id, MINUTE(ts) AS mi, SECOND(ts) AS s, DATE_TRUNC('day', ts) AS d, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('year', ts) AS y FROM events", "SELECT event_id, minute(ts) AS mi, second(ts) AS s, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS d, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS h, strftime(date_trunc('year', ts), '%Y-%m-%dT%H:%M:%SZ') AS y FROM events")
ask("now_and_age", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate < NOW() AND AGE_DAYS(o_orderdate) > 365 AND AGE_HOURS(o_orderdate) > 24", "SELECT count(*) AS n FROM orders WHERE o_orderdate < now() AND date_diff('hour', o_orderdate, cast(now() AS timestamp)) > 366 * 24")
ask("uuids", "SELECT n_nationkey, UUIDV5('6ba7b810-9dad-11d1-80b4-00c04fd430c8', 'x') AS five, LENGTH(UUIDV4()) AS four FROM nation", "SELECT n_nationkey, '05b16a01-46c6-56dd-bd6e-c6dfb4a1427a' AS five, cast(36 AS integer) AS four FROM nation")
ask("vector_order_dot", "SELECT vec_id FROM embeddings ORDER BY embedding <#> $1 LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY -list_dot_product({_V}, {_QSQL}), vec_id LIMIT 10", [_Q])
ask("vector_order_l1", "SELECT vec_id FROM embeddings ORDER BY embedding <+> $1 LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {_L1}, vec_id LIMIT 10", [_Q])
ask("order_aggregate", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC LIMIT 3", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC LIMIT 3")

_LIC = f"{_TOK.format('text')}"
_SRC = f"{_TOK.format('source')}"
_SCORE = f"""SELECT doc_id, 1e12 + 1e9 + 1e6 * 1.0 + 1e3 * CASE WHEN list_contains({_SRC}, 'license') THEN 1.0 ELSE 0.0 END
+ CASE WHEN len({_LIC}) = 1 OR len({_SRC}) = 1 THEN 1.0 ELSE 1.0 / CASE WHEN len({_SRC}) > 0 THEN least(len({_LIC}), len({_SRC})) ELSE len({_LIC}) END END AS s FROM documents WHERE list_contains({_LIC}, 'license') OR list_contains({_SRC}, 'license')"""
ask("search_score", "SELECT doc_id, SEARCH_SCORE('license') AS s FROM documents WHERE SEARCH('license')", _SCORE)
ask("search_score_bare", "SELECT doc_id, SEARCH_SCORE() AS s FROM documents WHERE SEARCH('license')", _SCORE)

# space
@call("st_centroid", f"SELECT n_nationkey, round((w + (w + 0.15) + (w + 0.15) + w + w) / 5, 6) AS lon, round((s + s + (s + 0.15) + (s + 0.15) + s) / 5, 6) AS lat FROM ({_ZONE})")
def _(e: Engine) -> DataFrame:
    point = F.from_json("c", "coordinates array<double>")
    return e.sql("SELECT n_nationkey, ST_Centroid(geometry) AS c FROM zones").select("n_nationkey", F.round(F.get(point["coordinates"], F.lit(0)), 6).alias("lon"), F.round(F.get(point["coordinates"], F.lit(1)), 6).alias("lat"))


@call("st_as_geojson", f"SELECT n_nationkey, w AS west FROM ({_ZONE})")
def _(e: Engine) -> DataFrame:
    shape = F.from_json("g", "coordinates array<array<array<double>>>")
    return e.sql("SELECT n_nationkey, ST_AsGeoJSON(geometry) AS g FROM zones").select("n_nationkey", F.get(F.get(F.get(shape["coordinates"], F.lit(0)), F.lit(0)), F.lit(0)).alias("west"))


_H = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat - -8.5) / 2), 2) + cos(radians(-8.5)) * cos(radians(lat)) * pow(sin(radians(lon - 115.5) / 2), 2)))"


@call("haversine", f"SELECT c_custkey, round({_H}, 4) AS m FROM (SELECT c_custkey, 115 + (c_custkey * 37 % 1000) / 1000.0 AS lon, -8 - (c_custkey * 61 % 1000) / 1000.0 AS lat FROM customer)")
def _(e: Engine) -> DataFrame:
    lon, lat = F.expr("115 + cast(c_custkey * 37 % 1000 as double) / 1000"), F.expr("-8 - cast(c_custkey * 61 % 1000 as double) / 1000")
    return e.catalog.nodes("customer").select("c_custkey", geo.haversine(F.lit(115.5), F.lit(-8.5), lon, lat).alias("m"))


# the place lies within one of the polygons
ask("st_dwithin_polygon", "SELECT n_nationkey FROM zones WHERE ST_DWithin(geometry, POINT(115.27 -8.52), 1)", f"SELECT n_nationkey FROM ({_ZONE}) WHERE 115.27 > w AND 115.27 < w + 0.15 AND -8.52 > s AND -8.52 < s + 0.15")

# rows, edges and tables that change
@call("multi_lookup", "SELECT 'orders/' || o_orderkey AS id FROM orders WHERE o_orderkey IN (1, 17) UNION ALL SELECT 'part/' || p_partkey FROM part WHERE p_partkey = 3")
def _(e: Engine) -> DataFrame:
    return e.many(["orders/1", "part/3", "orders/17", "part/none"]).df.select(F.col("_id").alias("id"))


@call("put_many", "SELECT 'note/' || k AS id, v FROM (VALUES ('a', 1), ('b', 7)) t(k, v)")
def _(e: Engine) -> DataFrame:
    e.begin_bulk()
    e.put_many([("note/a", {"v": 1}), ("note/b", '{"v": 2}')])
    e.put("note/b", {"v": 7})
    e.end_bulk()
    return e.catalog.nodes("note").select(F.col("_id").alias("id"), "v")


@call("rollback", "SELECT n_nationkey AS n, n_name AS name FROM nation")
def _(e: Engine) -> DataFrame:
    e.execute("BEGIN")
    e.execute("DELETE FROM nation WHERE n_regionkey > 1")
    e.execute("ROLLBACK")
    return e.sql("SELECT n_nationkey AS n, n_name AS name FROM nation")


_TRADES = "SELECT a._key AS a, b._key AS b, r.w AS w FROM MATCH (a:nation)-[r:trades]->(b:nation)"
_TSQL = "SELECT cast(n_nationkey AS varchar) AS a, cast((n_nationkey + 7) % 25 AS varchar) AS b, {w} AS w FROM nation"


@call("edge_insert", _TSQL.format(w="cast(n_nationkey % 4 AS double)") + " UNION ALL SELECT '1', '2', 0.5 UNION ALL SELECT '2', '1', 1.5")
def _(e: Engine) -> DataFrame:
    e.execute("INSERT ('nation/1')-[:trades {w: 0.5}]->('nation/2'), ('nation/1')<-[:trades {w: 1.5}]-('nation/2')")
    return e.sql(_TRADES)


@call("edge_update", _TSQL.format(w="CASE WHEN n_nationkey = 5 THEN 9.5 ELSE cast(n_nationkey % 4 AS double) END"))
def _(e: Engine) -> DataFrame:
    e.execute("UPDATE ('nation/5')-[:trades]->('nation/12') SET w = 9.5")
    return e.sql(_TRADES)


@call("edge_delete", _TSQL.format(w="cast(n_nationkey % 4 AS double)") + " WHERE n_nationkey NOT IN (5, 6)")
def _(e: Engine) -> DataFrame:
    e.execute("DELETE ('nation/5')-[:trades]->('nation/12')")
    e.unlink("nation/6", "nation/13", "trades")
    return e.sql(_TRADES)


@call("match_insert", "SELECT cast(c_custkey AS varchar) AS c, n_name AS nation FROM customer, nation WHERE c_acctbal > 9000 AND n_nationkey = 1")
def _(e: Engine) -> DataFrame:
    e.execute("MATCH (c:customer) WHERE c.c_acctbal > 9000 INSERT (c)-[:rich]->('nation/1')")
    return e.sql("SELECT c._key AS c, n.n_name AS nation FROM MATCH (c:customer)-[:rich]->(n:nation)")


@call("delete_cascades", "SELECT cast(c_custkey AS varchar) AS c FROM customer WHERE c_nationkey <> 4")
def _(e: Engine) -> DataFrame:
    e.execute("DELETE FROM nation WHERE _key = '4'")
    return e.sql("SELECT c._key AS c FROM MATCH (c:customer)-[:in_nation]->(n:nation)")


@call("create_table", "SELECT * FROM (VALUES ('a', 'Ann', 'x', 'Ann x'), ('b', 'Bob', 'y', 'Bob y')) t(k, name, city, whole)")
def _(e: Engine) -> DataFrame:
    e.execute("CREATE TABLE people (_key TEXT PRIMARY KEY, name TEXT NOT NULL, city TEXT DEFAULT 'x', whole TEXT GENERATED ALWAYS AS (concat_ws(' ', name, city)) STORED)")
    e.execute("INSERT INTO people (_key, name) VALUES ('a', 'Ann')")
    e.execute("INSERT INTO people (_key, name, city) VALUES ('b', 'Bob', 'y')")
    return e.sql("SELECT _key AS k, name, city, whole FROM people")


@call("alter_table", "SELECT cast(r_regionkey AS varchar) AS k, r_name AS title, cast(1.5 AS double) AS z FROM region")
def _(e: Engine) -> DataFrame:
    e.execute("ALTER TABLE region ADD COLUMN zz REAL DEFAULT 1.5")
    e.execute("ALTER TABLE region RENAME COLUMN zz TO z")
    e.execute("ALTER TABLE region RENAME COLUMN r_name TO title")
    e.execute("ALTER TABLE region DROP COLUMN r_regionkey")
    e.execute("ALTER TABLE region RENAME TO area")
    return e.sql("SELECT _key AS k, title, z FROM area")


@call("drop_table", "SELECT 'customer' AS source, 'placed' AS type, 'orders' AS target")
def _(e: Engine) -> DataFrame:
    e.execute("DROP TABLE nation")
    e.execute("DROP TABLE IF EXISTS nation")
    return e.spark.createDataFrame([x for x in e.edge_schema() if x[0] == "customer"], "source string, type string, target string")


@call("refresh_view", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000 AND c_nationkey <> 3")
def _(e: Engine) -> DataFrame:
    e.execute("CREATE MATERIALIZED VIEW rich AS SELECT c._key AS id, n.n_name AS nation FROM MATCH (c:customer)-[:in_nation]->(n:nation) WHERE c.c_acctbal > 9000")
    e.execute("DELETE FROM nation WHERE _key = '3'")
    e.execute("REFRESH MATERIALIZED VIEW rich")
    return e.sql("SELECT COUNT(*) AS n FROM rich")


@call("indexes", "SELECT * FROM (VALUES ('part', 'hash', 'p_brand'), ('part', 'btree', 'p_size')) t(collection, method, fields)")
def _(e: Engine) -> DataFrame:
    e.execute("CREATE INDEX ON part USING hash (p_brand)")
    e.execute("CREATE INDEX ON part (p_size)")
    e.execute("CREATE INDEX gone ON part USING gin (p_name)")
    e.execute("DROP INDEX gone")
    e.execute("REINDEX part")
    return e.sql("SHOW INDEXES").filter("collection = 'part' and method <> 'bm25'").select("collection", "method", "fields")


@call("prepared", "SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 5)")
def _(e: Engine) -> DataFrame:
    p = e.prepare("SELECT c_custkey FROM customer WHERE c_nationkey = $1")
    return e.query_prepared(p, [3]).unionByName(e.query_prepared(p, [5]))


@call("snapshot", "SELECT (SELECT count(*) FROM nation) AS before, (SELECT count(*) FROM nation WHERE n_regionkey <> 2) AS after")
def _(e: Engine) -> DataFrame:
    old = e.snapshot()
    e.execute("DELETE FROM nation WHERE n_regionkey = 2")
    return old.sql("SELECT COUNT(*) AS before FROM nation").crossJoin(e.sql("SELECT COUNT(*) AS after FROM nation"))


@call("change_feed", "SELECT 'nation/' || n_nationkey AS key FROM nation WHERE n_regionkey = 1")
def _(e: Engine) -> DataFrame:
    events: list[dict] = []
    number = e.subscribe_changes(events.append)
    e.execute("UPDATE nation SET n_name = 'x' WHERE n_regionkey = 1")
    e.unsubscribe_changes(number)
    e.execute("UPDATE nation SET n_name = 'y' WHERE n_regionkey = 2")
    return e.spark.createDataFrame([(k,) for v in events for k in v["keys"]], "key string")


@call("watch", "SELECT 1 AS run, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS rows UNION ALL SELECT 2, (SELECT count(*) FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 1)")
def _(e: Engine) -> DataFrame:
    seen: list[int] = []
    end = e.watch("SELECT n_name FROM nation WHERE n_regionkey = 1", lambda rows: seen.append(len(rows)))
    e.execute("UPDATE nation SET n_regionkey = 9 WHERE _key = '1'")
    end()
    return e.spark.createDataFrame(list(enumerate(seen, 1)), "run int, rows int")


@call("vectors_by_key", "SELECT 'v/a' AS id, 2 AS n, cast(0.5 AS double) AS first")
def _(e: Engine) -> DataFrame:
    e.put_vector("v/a", "emb", [0.5, 1.5])
    return e.spark.createDataFrame([("v/a", e.vector_dim("v", "emb"), float(e.get_vector("v/a", "emb")[0]))], "id string, n int, first double")


@call("catalog_counts", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, (SELECT count(*) FROM nation) AS edges")
def _(e: Engine) -> DataFrame:
    own = Engine(e.spark).register("nation", e.catalog.collection("nation").df.drop("_key"), "n_nationkey").register("region", e.catalog.collection("region").df.drop("_key"), "r_regionkey")
    own.register_edges("in_region", "nation", "region", e.catalog.collection("nation").df, "n_nationkey", "n_regionkey")
    return e.spark.createDataFrame([(own.node_count(), own.edge_count())], "nodes bigint, edges bigint")


@call("all_slugs", "SELECT 'nation/' || n_nationkey AS id FROM nation UNION ALL SELECT 'region/' || r_regionkey FROM region")
def _(e: Engine) -> DataFrame:
    return e.all_slugs().select(F.col("_id").alias("id")).filter("id like 'nation/%' or id like 'region/%'")


@call("edges_of_one", "SELECT 'customer/7' AS a, 'orders/' || o_orderkey AS b FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'customer/7', 'nation/' || c_nationkey FROM customer WHERE c_custkey = 7")
def _(e: Engine) -> DataFrame:
    return e.edges_from("customer/7").select(F.col("from").alias("a"), F.col("to").alias("b"))


@call("ilike_api", "SELECT p_partkey FROM part WHERE p_name ILIKE '%ar%'")
def _(e: Engine) -> DataFrame:
    return e.ilike("part", "p_name", "AR").select("p_partkey")


# sources and sinks
@call("files_round_trip", "SELECT 'csv' AS form, s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT 'ndjson', s_suppkey, s_name FROM supplier UNION ALL SELECT 'parquet', s_suppkey, s_name FROM supplier")
def _(e: Engine) -> DataFrame:
    import uuid

    out, base = None, f"{folder(e.spark)}/files-{uuid.uuid4().hex}"
    for form in ("csv", "ndjson", "parquet"):
        files.save(e.catalog.collection("supplier").df.select("s_suppkey", "s_name"), f"{base}/{form}", form)
        files.load_collection(e, f"again_{form}", f"{base}/{form}", "s_suppkey", form, "s_suppkey bigint, s_name string")
        part = e.catalog.collection(f"again_{form}").df.select(F.lit(form).alias("form"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


@call("pandas_round_trip", "SELECT cast(n_nationkey AS varchar) AS k, n_name AS name FROM nation")
def _(e: Engine) -> DataFrame:
    pdf = e.frames.query("SELECT _key, n_name FROM nation")
    e.frames.load_nodes(pdf, "again")
    return e.sql("SELECT _key AS k, n_name AS name FROM again")


@call("dump_restore", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(e: Engine) -> DataFrame:
    import uuid

    small = Engine(e.spark).register("nation", e.catalog.collection("nation").df.drop("_key"), "n_nationkey").register("region", e.catalog.collection("region").df.drop("_key"), "r_regionkey")
    small.register_edges("in_region", "nation", "region", e.catalog.collection("nation").df.select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey")
    path = f"{folder(e.spark)}/dump-{uuid.uuid4().hex}"
    dump.dump(small, path)
    return dump.restore(Engine(e.spark), path).sql("SELECT n.n_name AS nation, r.r_name AS region FROM MATCH (n:nation)-[:in_region]->(r:region)")


@call("dump_sql", "SELECT cast(r_regionkey AS varchar) AS k, r_name AS name FROM region")
def _(e: Engine) -> DataFrame:
    small = Engine(e.spark).register("region", e.catalog.collection("region").df)
    again = Engine(e.spark)
    again.load_sql(small.dump_sql())
    return again.sql("SELECT _key AS k, r_name AS name FROM region")
