"""The registered queries of the engine's own operators, each with the same question as SQL for DuckDB.

Doubles are rounded on both sides, since sums in another order differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import LAT, LON, engine
from .engine import Engine
from .operators import graph, relational
from .operators import text as text_ops
from .operators import vector as vector_ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes])


def ask(name: str, text: str, oracle: str | None, params: list | None = None, digits: int = 4) -> None:
    """A query in the dialect."""
    QUERIES[name] = lambda spark, sf_dir: rounded(engine(spark, sf_dir).sql(text, params), digits)
    if oracle:
        ORACLE_SQL[name] = oracle


def call(name: str, oracle: str | None):
    """A query through the Python interface."""

    def keep(f: Callable[[Engine], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(engine(spark, sf_dir)))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


# scans and filters
ask("point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE _key = '17'", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderkey = 17")
ask("filter_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("filter_neq", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
ask("filter_range", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 90000.5", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 90000.5")
ask("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
ask("filter_in", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9.0) AND p_brand NOT IN ('Brand#11', 'Brand#12')", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
ask("filter_any_param", "SELECT p_partkey FROM part WHERE p_size = ANY($1)", "SELECT p_partkey FROM part WHERE p_size IN (3, 4)", [[3, 4]])
ask("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%_E%'", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%_E%'")
ask("filter_ilike", "SELECT doc_id FROM documents WHERE text ILIKE '%license%'", "SELECT doc_id FROM documents WHERE text ILIKE '%license%'")
ask("filter_null", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND NOT (source IS NULL)", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
ask("filter_not_or", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice < 50000)", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice < 50000)")
ask("filter_date", "SELECT o_orderkey FROM orders WHERE YEAR(o_orderdate) = 1996 AND MONTH(o_orderdate) > 6", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) > 6")
ask("filter_time_text", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
ask("filter_json", "SELECT event_id FROM events WHERE props->>'k' = '7'", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
ask("filter_params", "SELECT c_custkey FROM customer WHERE c_acctbal > $2 AND c_mktsegment = $1", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'MACHINERY'", ["MACHINERY", 5000])
ask("scan_all", "SELECT COUNT(*) AS n FROM ALL", "SELECT 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + 2 * (SELECT count(*) FROM supplier) + 2 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM pages) AS n")

# projection and functions
ask("project_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class FROM customer")
ask("project_strings", "SELECT p_partkey, LENGTH(p_name) AS n, UPPER(p_name) AS up, LOWER(p_brand) AS low, SUBSTRING(p_name, 2, 4) AS sub, REPLACE(p_name, 'a', 'o') AS rep, CONCAT(p_brand, '!') AS con, TRIM(p_name) AS tr FROM part", "SELECT p_partkey, cast(length(p_name) AS integer) AS n, upper(p_name) AS up, lower(p_brand) AS low, substring(p_name, 2, 4) AS sub, replace(p_name, 'a', 'o') AS rep, p_brand || '!' AS con, trim(p_name) AS tr FROM part")
ask("project_dates", "SELECT o_orderkey, YEAR(o_orderdate) AS y, QUARTER(o_orderdate) AS q, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DOW(o_orderdate) AS dow, HOUR(o_orderdate) AS h, DATE_TRUNC('month', o_orderdate) AS mon FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) AS dow, hour(o_orderdate) AS h, strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT00:00:00Z') AS mon FROM orders")
ask("project_json", "SELECT event_id, props->>'k' AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
ask("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")

# aggregation
ask("count_star", "SELECT COUNT(*) AS n FROM lineitem", "SELECT count(*) AS n FROM lineitem")
ask("group_count", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty, AVG(l_extendedprice) AS avg_price, MIN(l_discount) AS lo, MAX(l_discount) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_extendedprice), 7) AS avg_price, round(min(l_discount), 4) AS lo, round(max(l_discount), 4) AS hi FROM lineitem GROUP BY ALL", digits=7)
ask("sum_scan", "SELECT SUM(l_extendedprice) AS total FROM lineitem", "SELECT round(sum(l_extendedprice), 4) AS total FROM lineitem")
ask("count_distinct", "SELECT COUNT(DISTINCT c_mktsegment) AS segments, COUNT(c_name) AS names FROM customer", "SELECT count(DISTINCT c_mktsegment) AS segments, count(c_name) AS names FROM customer")
ask("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND SUM(o_totalprice) > 100000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 100000")
ask("group_function", "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
ask("empty_aggregate", "SELECT COUNT(*) AS n, SUM(c_acctbal) AS total, MAX(c_name) AS last FROM customer WHERE c_custkey < 0", "SELECT count(*) AS n, sum(c_acctbal) AS total, max(c_name) AS last FROM customer WHERE c_custkey < 0")

# order
ask("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 25", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
ask("order_offset", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_name DESC LIMIT 30 OFFSET 10", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_name DESC, 'part/' || p_partkey LIMIT 30 OFFSET 10")
ask("order_score", "SELECT p_partkey FROM part ORDER BY p_retailprice * 0.5 - p_size * 3 DESC LIMIT 20", "SELECT p_partkey FROM part ORDER BY p_retailprice * 0.5 - p_size * 3 DESC, 'part/' || p_partkey LIMIT 20")

# graph
ask("match_forward", "SELECT c._key AS c, o._key AS o, o.o_totalprice AS price FROM MATCH (c:customer)-[:placed]->(o:orders) WHERE o.o_orderstatus = 'F'", "SELECT cast(o_custkey AS varchar) AS c, cast(o_orderkey AS varchar) AS o, round(o_totalprice, 4) AS price FROM orders WHERE o_orderstatus = 'F'")
ask("match_flagship", "SELECT n._key AS nation, COUNT(*) AS orders FROM MATCH (n:nation)<-[:in_nation]-(c:customer)-[:placed]->(o:orders) GROUP BY n._key ORDER BY orders DESC", "SELECT cast(c_nationkey AS varchar) AS nation, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
ask("match_edge_attrs", "SELECT p.p_brand AS brand, SUM(r.quantity) AS qty, AVG(r.price) AS price, COUNT(*) AS n FROM MATCH (o:orders)-[r:contains]->(p:part) WHERE r.discount > 0.05 GROUP BY p.p_brand", "SELECT p_brand AS brand, round(sum(l_quantity), 4) AS qty, round(avg(l_extendedprice), 7) AS price, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.05 GROUP BY 1", digits=7)
ask("match_edge_props", "SELECT o._key AS o, r.price AS price FROM MATCH (o:orders)-[r:contains {flag: 'R'}]->(p:part {p_size: 7})", "SELECT cast(l_orderkey AS varchar) AS o, round(l_extendedprice, 4) AS price FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND p_size = 7")
ask("match_three_hops", "SELECT r.r_name AS region, COUNT(*) AS n, SUM(i.price) AS revenue FROM MATCH (r:region)<-[:in_region]-(n:nation)<-[:in_nation]-(c:customer)-[:placed]->(o:orders)-[i:contains]->(p:part) GROUP BY r.r_name", "SELECT r_name AS region, count(*) AS n, round(sum(l_extendedprice), 4) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
ask("match_undirected", "SELECT a._key AS a, b._key AS b FROM MATCH (a:nation)-[:leads]-(b:nation)", "SELECT cast(x AS varchar) AS a, cast(y AS varchar) AS b FROM (SELECT n_nationkey AS x, (n_nationkey * 3 + 1) % 25 AS y FROM nation UNION ALL SELECT (n_nationkey * 3 + 1) % 25, n_nationkey FROM nation)")
_LEADS = "e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS d FROM nation), t AS (SELECT n_nationkey AS s, (n_nationkey + 7) % 25 AS d FROM nation), both_ AS (SELECT * FROM e UNION ALL SELECT * FROM t)"
_WALKS = f"WITH RECURSIVE {_LEADS}, w AS (SELECT n_nationkey AS a, n_nationkey AS b, 0 AS k FROM nation UNION ALL SELECT a, d, k + 1 FROM w JOIN both_ ON s = b WHERE k < {{}})"
ask("match_varlen", "SELECT a._key AS a, b._key AS b FROM MATCH (a:nation)-[:leads|trades*1..3]->(b:nation)", _WALKS.format(3) + " SELECT cast(a AS varchar) AS a, cast(b AS varchar) AS b FROM w WHERE k >= 1")
ask("match_varlen_count", "SELECT b._key AS b, COUNT(*) AS n FROM MATCH (a:nation)-[:leads|trades]->{2,5}(b:nation) GROUP BY b._key", _WALKS.format(5) + " SELECT cast(b AS varchar) AS b, count(*) AS n FROM w WHERE k >= 2 GROUP BY 1")
ask("match_varlen_distinct", "SELECT DISTINCT b._key AS b FROM MATCH (a:nation)-[:trades*1..4]->(b:nation) WHERE a._key = '3'", f"WITH RECURSIVE {_LEADS}, w AS (SELECT 3 AS b, 0 AS k UNION ALL SELECT d, k + 1 FROM w JOIN t ON s = b WHERE k < 4) SELECT DISTINCT cast(b AS varchar) AS b FROM w WHERE k >= 1")
ask("match_path", "SELECT b._key AS b, nodes(p) AS trail, length(p) AS hops FROM MATCH p = (a:nation)-[:leads*1..3]->(b:nation) WHERE a._key = '5'", f"WITH RECURSIVE {_LEADS}, w AS (SELECT 5 AS b, 0 AS k, ['nation/5'] AS trail UNION ALL SELECT d, k + 1, list_append(trail, 'nation/' || d) FROM w JOIN e ON s = b WHERE k < 3) SELECT cast(b AS varchar) AS b, k AS hops, trail FROM w WHERE k >= 1")
ask("match_path_product", "SELECT b._key AS b, PATH_PRODUCT(r.w) AS product, PATH_SUM(r.w) AS total, PATH_LAST(r.w) AS last FROM MATCH (a:nation)-[r:trades*1..3]->(b:nation)", "WITH RECURSIVE t AS (SELECT n_nationkey AS s, (n_nationkey + 7) % 25 AS d, cast(n_nationkey % 4 AS double) AS w FROM nation), x AS (SELECT n_nationkey AS b, 0 AS k, cast(1 AS double) AS product, cast(0 AS double) AS total, cast(0 AS double) AS last FROM nation UNION ALL SELECT d, k + 1, product * w, total + w, w FROM x JOIN t ON s = b WHERE k < 3) SELECT cast(b AS varchar) AS b, product, total, last FROM x WHERE k >= 1")
ask("match_union", "SELECT b._key AS k FROM MATCH (a:nation)-[:leads]->(b:nation) WHERE a.n_regionkey = 1 UNION SELECT b._key AS k FROM MATCH (a:nation)-[:trades]->(b:nation) WHERE a.n_regionkey = 2", "SELECT cast((n_nationkey * 3 + 1) % 25 AS varchar) AS k FROM nation WHERE n_regionkey = 1 UNION SELECT cast((n_nationkey + 7) % 25 AS varchar) FROM nation WHERE n_regionkey = 2")
ask("match_with", "SELECT n.n_name AS nation, t AS spent FROM MATCH (c:customer)-[:placed]->(o:orders) WITH c, SUM(o.o_totalprice) AS t MATCH (c)-[:in_nation]->(n:nation) WHERE t > 2000000", "SELECT n_name AS nation, round(t, 4) AS spent FROM (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE t > 2000000")
ask("match_with_alias_join", "SELECT c.c_name AS name, seg AS seg FROM MATCH (n:nation)<-[:in_nation]-(x:customer) WHERE n._key = '4' WITH n.n_nationkey AS nk, MAX(x.c_custkey) AS seg MATCH (c:customer WHERE c_custkey = seg)", "SELECT c_name AS name, m AS seg FROM (SELECT max(c_custkey) AS m FROM customer WHERE c_nationkey = 4) JOIN customer ON c_custkey = m")
ask("match_multi_from", "SELECT a._key AS a, r.r_name AS r FROM MATCH (a:nation)-[:leads]->(b:nation), region AS r WHERE b._key = '1' AND r.r_regionkey < 2", "SELECT cast(n_nationkey AS varchar) AS a, r_name AS r FROM nation, region WHERE (n_nationkey * 3 + 1) % 25 = 1 AND r_regionkey < 2")
ask("match_aggregate_empty", "SELECT COUNT(*) AS n, SUM(o.o_totalprice) AS total, AVG(o.o_totalprice) AS mean FROM MATCH (c:customer)-[:placed]->(o:orders) WHERE c._key = 'nobody'", "SELECT 0 AS n, cast(0 AS double) AS total, cast(NULL AS double) AS mean")
ask("match_count_distinct", "SELECT COUNT(*) AS lines, COUNT(DISTINCT p.p_brand) AS brands FROM MATCH (o:orders)-[:contains]->(p:part)", "SELECT count(*) AS lines, count(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey")
ask("match_any_edge", "SELECT b._collection AS c, COUNT(*) AS n FROM MATCH (a:supplier)-->(b) GROUP BY b._collection", "SELECT 'nation' AS c, count(*) AS n FROM supplier")
ask("match_strings", "SELECT a.n_name || ' > ' || b.n_name AS route, CONCAT_WS('-', a._key, b._key) AS ks FROM MATCH (a:nation)-[:leads]->(b:nation)", "SELECT x.n_name || ' > ' || y.n_name AS route, x.n_nationkey || '-' || y.n_nationkey AS ks FROM nation x JOIN nation y ON y.n_nationkey = (x.n_nationkey * 3 + 1) % 25")
ask("shortest_path", "SELECT a.n_name AS a, b.n_name AS b, length(r) AS hops FROM MATCH SHORTEST (a:nation)-[r*]->(b:nation) WHERE a._key = '2' AND b._key = '11'", f"WITH RECURSIVE {_LEADS}, w AS (SELECT 2 AS b, 0 AS k UNION SELECT d, k + 1 FROM w JOIN both_ ON s = b WHERE k < 25) SELECT x.n_name AS a, y.n_name AS b, cast((SELECT min(k) FROM w WHERE b = 11) AS integer) AS hops FROM nation x, nation y WHERE x.n_nationkey = 2 AND y.n_nationkey = 11")


@call("bfs_hops", f"WITH RECURSIVE {_LEADS}, w AS (SELECT 0 AS b, 0 AS k UNION ALL SELECT d, k + 1 FROM w JOIN both_ ON s = b WHERE k < 4) SELECT 'nation/' || b AS node, cast(min(k) AS integer) AS depth FROM w GROUP BY b")
def _(e: Engine) -> DataFrame:
    edges = e.edges(["leads", "trades"]).select(F.col("from").alias("src"), F.col("to").alias("dst"))
    return graph.bfs(e.spark.sql("SELECT 'nation/0' AS node"), edges, 4)


@call("count_walks", _WALKS.format(6) + " SELECT 'nation/' || b AS node, count(*) AS walks FROM w WHERE k >= 3 GROUP BY b")
def _(e: Engine) -> DataFrame:
    edges = e.edges(["leads", "trades"]).select(F.col("from").alias("src"), F.col("to").alias("dst"))
    return graph.count_walks(e.catalog.nodes("nation").select(F.col("_id").alias("node")), edges, 3, 6)


@call("leaves", "SELECT 'customer/' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(e: Engine) -> DataFrame:
    return graph.leaves(e.catalog.nodes("customer").select("_id"), e.edges(["placed"]).select(F.col("from").alias("src"), F.col("to").alias("dst"))).select(F.col("_id").alias("node"))


@call("roots", "SELECT 'part/' || p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def _(e: Engine) -> DataFrame:
    return graph.roots(e.catalog.nodes("part").select("_id"), e.edges(["contains"]).select(F.col("from").alias("src"), F.col("to").alias("dst"))).select(F.col("_id").alias("node"))


@call("edge_collect", "SELECT 'nation/' || (n_nationkey * 3 + 1) % 25 AS node, min('nation/' || n_nationkey) AS via FROM nation GROUP BY 1")
def _(e: Engine) -> DataFrame:
    edges = e.edges(["leads"]).select(F.col("from").alias("src"), F.col("to").alias("dst"), "type")
    return graph.edge_collect(e.catalog.nodes("nation").select(F.col("_id").alias("node")), edges).select(F.col("dst").alias("node"), F.col("edge.src").alias("via"))


@call("set_operations", "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 40) AND p_brand <> 'Brand#11'")
def _(e: Engine) -> DataFrame:
    q = e.collection("part")
    small = q.where_lt("p_size", 10).union(q.where_gt("p_size", 40))
    return small.intersect(q.where_neq("p_brand", "Brand#11")).subtract(q.where_between("p_size", 10, 40)).df.select("p_partkey")


@call("builder_chain", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, 'orders/' || o_orderkey LIMIT 40 OFFSET 5")
def _(e: Engine) -> DataFrame:
    return e.collection("orders").where_eq("o_orderstatus", "O").sort("o_totalprice", descending=True).skip(5).take(40).frame().select("o_orderkey")


# vectors: the query is a fixed vector, as ascending fractions
_Q = [round(((i * 7) % 13 - 6) / 10, 1) for i in range(64)]
_QSQL = "cast([" + ",".join(f"{x}::float" for x in _Q) + "] AS double[])"
_V = "cast(embedding AS double[])"
_COS = f"(1 - list_dot_product({_V}, {_QSQL}) / (sqrt(list_dot_product({_V}, {_V})) * sqrt(list_dot_product({_QSQL}, {_QSQL}))))"
_L2 = f"list_sum(list_transform(list_zip({_V}, {_QSQL}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_L1 = f"list_sum(list_transform(list_zip({_V}, {_QSQL}), lambda z: abs(z[1] - z[2])))"
ask("vector_scores", "SELECT vec_id, VECTOR_COSINE(embedding, $1) AS c, VECTOR_L2(embedding, $1) AS l2, VECTOR_DOT(embedding, $1) AS d, VECTOR_L1(embedding, $1) AS l1 FROM embeddings", f"SELECT vec_id, round(1 - {_COS}, 4) AS c, round({_L2}, 4) AS l2, round(list_dot_product({_V}, {_QSQL}), 4) AS d, round({_L1}, 4) AS l1 FROM embeddings", [_Q])
ask("vector_near_filter", "SELECT vec_id FROM embeddings WHERE VECTOR_NEAR(embedding, $1, 50) AND label < 5", f"SELECT vec_id FROM (SELECT * FROM embeddings ORDER BY {_COS}, cast(vec_id AS varchar) LIMIT 50) WHERE label < 5", [_Q])
ask("vector_order_l2", "SELECT vec_id FROM embeddings ORDER BY embedding <-> $1 ASC LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10", [_Q])
ask("vector_order_cosine", "SELECT vec_id FROM embeddings ORDER BY embedding <=> $1 LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {_COS}, vec_id LIMIT 10", [_Q])


_NORM = "sqrt(list_dot_product({0}, {0}))"


@call("vector_join", f"""WITH v AS (SELECT vec_id, {_V} AS v FROM embeddings), d AS (SELECT cast(a.vec_id AS varchar) AS query, b.vec_id,
round(1 - list_dot_product(a.v, b.v) / ({_NORM.format('a.v')} * {_NORM.format('b.v')}), 9) AS distance FROM v a, v b)
SELECT query, vec_id, round(distance, 4) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS r FROM d) WHERE r <= 5""")
def _(e: Engine) -> DataFrame:
    df = e.catalog.nodes("embeddings")
    queries = df.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return vector_ops.nearest_join(df, "embedding", queries, 5, key="vec_id").withColumn("distance", F.round("distance", 4) + 0.0)


@call("vector_compact", f"SELECT vec_id FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10")
def _(e: Engine) -> DataFrame:
    df = e.catalog.nodes("embeddings")
    bounds = vector_ops.calibrated(df, "embedding")
    return vector_ops.nearest_compact(vector_ops.quantised(df, "embedding", bounds), "embedding", _Q, 10, bounds).select("vec_id")


# text
_TOK = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 3)"


def bm25_sql(table: str, key: str, column: str, query: list[str]) -> str:
    terms = ", ".join(f"('{t}')" for t in query)
    return f"""t AS (SELECT {key} AS k, {_TOK.format(column)} AS toks FROM {table} WHERE {column} IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM t), q(term) AS (VALUES {terms}),
tf AS (SELECT k, term, len(toks) AS dl, len(list_filter(toks, lambda x: x = term)) AS tf FROM t, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
b AS (SELECT k, sum(ln(1 + (n + 0.5 - df) / (0.5 + df)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM tf JOIN df USING (term), s WHERE dl > 0 GROUP BY k)"""


ask("bm25_filter", "SELECT doc_id, BM25(text, 'the license, than apache') AS score FROM documents WHERE BM25(text, 'the license, than apache') > 0.5", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['the', 'license', 'than', 'apache'])} SELECT k AS doc_id, round(score, 4) AS score FROM b WHERE score > 0.5")
ask("bm25_norm", "SELECT p_partkey, BM25_NORM(p_name, 'part 17') AS s FROM part", f"WITH {bm25_sql('part', 'p_partkey', 'p_name', ['part'])} SELECT p_partkey, round(CASE WHEN score > 0 THEN score / (score + 1) ELSE 0 END, 4) AS s FROM part LEFT JOIN b ON k = p_partkey")
ask("bm25_top", "SELECT doc_id, BM25(text, 'license version') AS s FROM documents ORDER BY BM25(text, 'license version') DESC LIMIT 15", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['license', 'version'])} SELECT doc_id, round(coalesce(score, 0), 4) AS s FROM documents LEFT JOIN b ON k = doc_id ORDER BY coalesce(score, 0) DESC, 'documents/' || doc_id LIMIT 15")


@call("tokenize", f"SELECT doc_id, len({_TOK.format('text')}) AS n, {_TOK.format('text')}[1] AS first FROM documents")
def _(e: Engine) -> DataFrame:
    from .functions.text import tokens

    return e.catalog.nodes("documents").select("doc_id", F.size(tokens(F.col("text"))).cast("bigint").alias("n"), F.get(tokens(F.col("text")), F.lit(0)).alias("first"))


ask("search", "SELECT doc_id FROM documents WHERE SEARCH('license apache')", f"SELECT doc_id FROM documents WHERE list_contains({_TOK.format('text')}, 'license') AND list_contains({_TOK.format('text')}, 'apache')")
ask("search_typo", "SELECT doc_id FROM documents WHERE SEARCH('licensf')", f"SELECT doc_id FROM documents WHERE len(list_filter({_TOK.format('text')}, lambda x: levenshtein(x, 'licensf') <= 1)) > 0")


@call("trigrams", "SELECT p_partkey, len(list_distinct([substring(lower(p_name), i, 3) FOR i IN range(1, greatest(length(p_name) - 1, 1))])) AS n FROM part")
def _(e: Engine) -> DataFrame:
    return e.catalog.nodes("part").select("p_partkey", F.size(text_ops.trigrams(F.col("p_name"))).cast("bigint").alias("n"))


# space
def vincenty_sql(source: str, keep: str, lat1: str, lon1: str, lat2: str, lon2: str, steps: int = 8) -> str:
    """CTEs v0, v1, ... of Vincenty's iteration over a source; the last, v, has keep and metres."""
    f, a = "(1 / 298.257223563)", "6378137.0"
    out = [f"v0 AS (SELECT {keep}, atan((1 - {f}) * tan(radians({lat1}))) AS u1, atan((1 - {f}) * tan(radians({lat2}))) AS u2, radians({lon2}) - radians({lon1}) AS dl, radians({lon2}) - radians({lon1}) AS lam FROM {source})"]
    inner = "SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v{}"
    more = "SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa"
    last = "SELECT *, 1 - sa * sa AS ca2, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS c2m"
    for i in range(steps):
        k = f"({f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)))"
        out.append(f"v{i + 1} AS (SELECT * EXCLUDE (lam, ss, cs, sigma, sa, ca2, c2m), dl + (1 - {k}) * {f} * sa * (sigma + {k} * ss * (c2m + {k} * cs * (2 * c2m * c2m - 1))) AS lam FROM ({last} FROM ({more} FROM ({inner.format(i)}))))")
    b = f"({a} * (1 - {f}))"
    u = f"(ca2 * ({a} * {a} - {b} * {b}) / ({b} * {b}))"
    big = f"(1 + {u} / 16384 * (4096 + {u} * (-768 + {u} * (320 - 175 * {u}))))"
    small = f"({u} / 1024 * (256 + {u} * (-128 + {u} * (74 - 47 * {u}))))"
    ds = f"({small} * ss * (c2m + {small} / 4 * (cs * (2 * c2m * c2m - 1) - {small} / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3))))"
    out.append(f"v AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE {b} * {big} * (sigma - {ds}) END AS metres FROM ({last} FROM ({more} FROM ({inner.format(steps)}))))")
    return "WITH " + ", ".join(out)


_FROM = vincenty_sql("customer", "c_custkey, c_mktsegment, c_acctbal", LAT, LON, "-8.5", "115.5")
ask("st_distance", "SELECT c_custkey, ST_Distance(geometry, POINT(115.5 -8.5)) AS m FROM places", _FROM + " SELECT c_custkey, round(metres, 4) AS m FROM v")
ask("st_dwithin", "SELECT c_custkey FROM places WHERE ST_DWithin(geometry, POINT(115.5 -8.5), 25000)", _FROM + " SELECT c_custkey FROM v WHERE metres <= 25000")
ask("st_distance_filter", "SELECT c_custkey FROM places WHERE ST_Distance(geometry, POINT(115.5 -8.5), 30000) AND c_mktsegment = 'BUILDING'", _FROM + " SELECT c_custkey FROM v WHERE metres < 30000 AND c_mktsegment = 'BUILDING'")
ask("st_knn", "SELECT c_custkey FROM places ORDER BY ST_Distance(geometry, POINT(115.5 -8.5)) ASC LIMIT 12", _FROM + " SELECT c_custkey FROM v ORDER BY metres, 'places/' || c_custkey LIMIT 12")
ask("st_within", "SELECT c_custkey FROM places WHERE ST_Within(geometry, POLYGON((115.2013 -8.8017, 115.6013 -8.8017, 115.4007 -8.3017, 115.2013 -8.8017)))", f"SELECT c_custkey FROM (SELECT c_custkey, {LON} AS x, {LAT} AS y FROM customer) WHERE (CASE WHEN ((-8.8017 > y) <> (-8.3017 > y)) AND x < (115.6013 - 115.4007) * (y - -8.3017) / (-8.8017 - -8.3017) + 115.4007 THEN 1 ELSE 0 END + CASE WHEN ((-8.3017 > y) <> (-8.8017 > y)) AND x < (115.4007 - 115.2013) * (y - -8.8017) / (-8.3017 - -8.8017) + 115.2013 THEN 1 ELSE 0 END) % 2 = 1")
_ZONE = "SELECT n_nationkey, 115 + cast(n_nationkey % 5 AS double) * 0.2 AS w, -9 + floor(n_nationkey / 5) * 0.2 AS s FROM nation"
ask("st_contains", "SELECT n_nationkey FROM zones WHERE ST_Contains(geometry, POINT(115.27 -8.52))", f"SELECT n_nationkey FROM ({_ZONE}) WHERE 115.27 > w AND 115.27 < w + 0.15 AND -8.52 > s AND -8.52 < s + 0.15")
ask("st_contains_polygon", "SELECT n_nationkey FROM zones WHERE ST_Contains(geometry, POLYGON((115.22 -8.57, 115.3 -8.57, 115.3 -8.5, 115.22 -8.57)))", f"SELECT n_nationkey FROM ({_ZONE}) WHERE 115.22 > w AND 115.3 < w + 0.15 AND -8.57 > s AND -8.5 < s + 0.15")
ask("st_intersects", "SELECT n_nationkey FROM zones WHERE ST_Intersects(geometry, POLYGON((115.1 -8.9, 115.5 -8.9, 115.5 -8.45, 115.1 -8.45, 115.1 -8.9)))", f"SELECT n_nationkey FROM ({_ZONE}) WHERE w < 115.5 AND w + 0.15 > 115.1 AND s < -8.45 AND s + 0.15 > -8.9")
_SIDES = "(SELECT n_nationkey, s AS a, w AS b, s AS c, w + 0.15 AS d FROM z UNION ALL SELECT n_nationkey, s, w + 0.15, s + 0.15, w + 0.15 FROM z UNION ALL SELECT n_nationkey, s + 0.15, w + 0.15, s + 0.15, w FROM z UNION ALL SELECT n_nationkey, s + 0.15, w, s, w FROM z)"
ask("st_perimeter", "SELECT n_nationkey, ST_Perimeter(geometry) AS m, ST_Length(geometry) AS len FROM zones", vincenty_sql(_SIDES, "n_nationkey", "a", "b", "c", "d").replace("WITH ", f"WITH z AS ({_ZONE}), ", 1) + " SELECT n_nationkey, round(sum(metres), 2) AS m, cast(0 AS double) AS len FROM v GROUP BY 1", digits=2)


def _half(lat: str) -> str:
    """tan of half the authalic latitude, in SQL."""
    e2 = 2 / 298.257223563 - 1 / 298.257223563**2
    e = e2**0.5
    q = lambda x: f"({1 - e2} * ({x} / (1 - {e2} * {x} * {x}) - ln((1 - {e} * {x}) / (1 + {e} * {x})) / {2 * e}))"
    return f"tan(asin({q(f'sin(radians({lat}))')} / {q('1.0')}) / 2)"


ask("st_area", "SELECT n_nationkey, ST_Area(geometry) AS m2 FROM zones", f"SELECT n_nationkey, round(abs(2 * atan2(tan(radians(0.15) / 2) * 2 * lo, 1 + lo * lo) - 2 * atan2(tan(radians(0.15) / 2) * 2 * hi, 1 + hi * hi)) * 6371007.18091847 ** 2, 0) AS m2 FROM (SELECT n_nationkey, {_half('s')} AS lo, {_half('s + 0.15')} AS hi FROM ({_ZONE}))", digits=0)
_K = "cast(s_suppkey % 100 AS double) / 100"
ask("st_length", "SELECT s_suppkey, ST_Length(geometry) AS m FROM routes", vincenty_sql(f"(SELECT s_suppkey, {_K} AS k, -8.5 + {_K} AS a, 115 + {_K} AS b, -8.5 + {_K} AS c, 115.0 AS d FROM supplier UNION ALL SELECT s_suppkey, {_K}, -8.5, 115 + {_K}, -8.5 + {_K}, 115 + {_K} FROM supplier)", "s_suppkey", "a", "b", "c", "d") + " SELECT s_suppkey, round(sum(metres), 4) AS m FROM v GROUP BY 1")

# several models at once
ask("hybrid_geo_graph", "SELECT n.n_name AS nation, COUNT(*) AS n FROM MATCH (c:customer)-[:in_nation]->(n:nation) WHERE c.c_acctbal > 1000 GROUP BY n.n_name ORDER BY n DESC", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 1000 GROUP BY 1")
ask("hybrid_place_rank", "SELECT c_custkey FROM places WHERE ST_DWithin(geometry, POINT(115.5 -8.5), 40000) ORDER BY c_acctbal * 0.01 - ST_Distance(geometry, POINT(115.5 -8.5)) * 0.001 DESC LIMIT 20", _FROM + " SELECT c_custkey FROM v WHERE metres <= 40000 ORDER BY c_acctbal * 0.01 - metres * 0.001 DESC LIMIT 20")


@call("hybrid_rrf", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['license', 'version'])}, l AS (SELECT k, row_number() OVER (ORDER BY score DESC, cast(k AS varchar)) AS r FROM (SELECT * FROM b WHERE score > 0 ORDER BY score DESC, cast(k AS varchar) LIMIT 50)), v AS (SELECT vec_id AS k, row_number() OVER (ORDER BY d, cast(vec_id AS varchar)) AS r FROM (SELECT vec_id, {_COS} AS d FROM embeddings ORDER BY d, cast(vec_id AS varchar) LIMIT 50)) SELECT cast(k AS varchar) AS _key, round(sum(p), 4) AS score FROM (SELECT k, 1.0 / (60 + r) AS p FROM l UNION ALL SELECT k, 2.0 / (60 + r) FROM v) GROUP BY k")
def _(e: Engine) -> DataFrame:
    lexical = e.bm25_search("documents", "text", "license version", 50)
    dense = vector_ops.nearest(e.catalog.nodes("embeddings"), "embedding", _Q, 50)
    return relational.reciprocal_rank_fusion([(lexical, F.desc("score"), 1.0), (dense, F.asc("_distance"), 2.0)], "_key")


@call("bulk_edges", "SELECT 'customer/' || o_custkey AS a, 'orders/' || o_orderkey AS b FROM orders")
def _(e: Engine) -> DataFrame:
    return e.edges_between("customer", "orders").select(F.col("from").alias("a"), F.col("to").alias("b"))


@call("show_edges", "SELECT 'customer' AS \"from\", 'in_nation' AS type, 'nation' AS \"to\", (SELECT count(*) FROM customer) AS count UNION ALL SELECT 'customer', 'placed', 'orders', (SELECT count(*) FROM orders)")
def _(e: Engine) -> DataFrame:
    return e.sql("SHOW EDGES FROM customer")


@call("show_tables", "SELECT 'nation' AS name, count(*) AS count FROM nation")
def _(e: Engine) -> DataFrame:
    return e.sql("SHOW TABLES").filter("name = 'nation'")


@call("mutations", "SELECT n_name AS name, n_nationkey AS n FROM nation WHERE n_regionkey <> 3 AND n_nationkey <> 5 UNION ALL SELECT 'changed', n_nationkey FROM nation WHERE n_nationkey = 5 AND n_regionkey <> 3 UNION ALL SELECT 'new', 99")
def _(e: Engine) -> DataFrame:
    e.execute("BEGIN")
    e.execute("UPDATE nation SET n_name = 'changed' WHERE _key = '5'")
    e.execute("DELETE FROM nation WHERE n_regionkey = 3")
    e.execute("INSERT INTO nation (_key, n_name, n_nationkey) VALUES ('99', 'new', 99)")
    e.execute("COMMIT")
    return e.sql("SELECT n_name AS name, n_nationkey AS n FROM nation")


@call("view", "SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000")
def _(e: Engine) -> DataFrame:
    e.execute("CREATE MATERIALIZED VIEW rich AS SELECT c._key AS id, c.c_name AS name, n.n_name AS nation FROM MATCH (c:customer)-[:in_nation]->(n:nation) WHERE c.c_acctbal > 9000")
    return e.sql("SELECT name, nation FROM rich")


from . import statements  # noqa: E402, F401  it registers more queries here
