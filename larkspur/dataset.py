"""The driver's tables as a multi-model catalog: records, edges, points, polygons, vectors and texts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.geo import point_json

KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "lineitem": "l_orderkey", "pages": "page_id"}
#: lon and lat of customer k, in SQL for Spark and DuckDB alike
LON, LAT = "(115 + (c_custkey * 37 % 1000) / 1000.0)", "(-8 - (c_custkey * 61 % 1000) / 1000.0)"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Nothing is read here: a table's footer is when a query first names it."""
    e = Engine(spark)
    read = lru_cache(None)(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    for name, key in KEYS.items():
        e.register(name, lambda name=name: read(name), key)
    lon = "115 + cast(c_custkey * 37 % 1000 as double) / 1000"
    lat = "-8 - cast(c_custkey * 61 % 1000 as double) / 1000"
    e.register("places", lambda: read("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", point_json(F.expr(lon), F.expr(lat)).alias("geometry")), "c_custkey")
    square = """concat('{"coordinates":[[[', w, ',', s, '],[', w + 0.15, ',', s, '],[', w + 0.15, ',', s + 0.15, '],[', w, ',', s + 0.15, '],[', w, ',', s, ']]],"type":"Polygon"}')"""
    corner = {"w": "115 + cast(n_nationkey % 5 as double) * 0.2", "s": "-9 + cast(floor(n_nationkey / 5) as double) * 0.2"}
    e.register("zones", lambda: read("nation").withColumns({c: F.expr(x) for c, x in corner.items()}).select("n_nationkey", "n_name", F.expr(square).alias("geometry")), "n_nationkey")
    line = """concat('{"coordinates":[[', 115 + k, ',-8.5],[', 115 + k, ',', -8.5 + k, '],[115,', -8.5 + k, ']],"type":"LineString"}')"""
    e.register("routes", lambda: read("supplier").withColumn("k", F.expr("cast(s_suppkey % 100 as double) / 100")).select("s_suppkey", F.expr(line).alias("geometry")), "s_suppkey")
    item = {"l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount", "l_returnflag": "flag"}
    edge = lambda kind, a, b, table, src, dst, *more: e.register_edges(kind, a, b, lambda: read(table).select(src, dst, *more), src, dst, sound=True)
    edge("placed", "customer", "orders", "orders", "o_custkey", "o_orderkey")
    e.register_edges("contains", "orders", "part", lambda: read("lineitem").select("l_orderkey", "l_partkey", *[F.col(c).alias(n) for c, n in item.items()]), "l_orderkey", "l_partkey", sound=True)
    e.register_edges("supplied_by", "part", "supplier", lambda: read("lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey", sound=True)
    edge("in_nation", "customer", "nation", "customer", "c_custkey", "c_nationkey")
    edge("in_nation", "supplier", "nation", "supplier", "s_suppkey", "s_nationkey")
    edge("in_region", "nation", "region", "nation", "n_nationkey", "n_regionkey")
    # a small cyclic graph over nations: k -> (3k + 1) mod 25 and k -> (k + 7) mod 25
    e.register_edges("leads", "nation", "nation", lambda: read("nation").select("n_nationkey", F.expr("(n_nationkey * 3 + 1) % 25").alias("to")), "n_nationkey", "to", sound=True)
    e.register_edges("trades", "nation", "nation", lambda: read("nation").select("n_nationkey", F.expr("(n_nationkey + 7) % 25").alias("to"), F.expr("cast(n_nationkey % 4 as double)").alias("w")), "n_nationkey", "to", sound=True)
    # a cyclic graph over all orders, two edges each: k -> (7k + 3) mod n and k -> (11k + 1) mod n
    def follows():
        n = read("orders").count()
        return read("orders").select("o_orderkey", F.explode(F.array(*[F.struct(F.expr(f"(o_orderkey * {a} + {b}) % {n}").alias("to"), F.lit(float(a)).alias("w")) for a, b in ((7, 3), (11, 1))])).alias("e")).select("o_orderkey", "e.to", "e.w")

    e.register_edges("follows", "orders", "orders", follows, "o_orderkey", "to", sound=True)
    e.index("documents", "bm25", "text", stored=True).index("documents", "search", "source", "text", stored=True).index("part", "bm25", "p_name")
    return e
