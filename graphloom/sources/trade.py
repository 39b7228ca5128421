"""The driver's tables as one property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .graph import Graph


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts, orders, users, events and documents, and what joins them."""

    def table(name: str):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def named(df, prefix: str) -> dict[str, str]:
        return {c.removeprefix(prefix): c for c in df.columns}

    region, nation, customer, supplier, part, orders, lineitem, events = map(table, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
    g = Graph()
    g.add_nodes("Region", region, "r_regionkey", named(region, "r_"))
    g.add_nodes("Nation", nation, "n_nationkey", named(nation, "n_"))
    g.add_nodes("Customer", customer, "c_custkey", named(customer, "c_"))
    g.add_nodes("Supplier", supplier, "s_suppkey", named(supplier, "s_"))
    g.add_nodes("Part", part, "p_partkey", named(part, "p_"))
    g.add_nodes("Order", orders, "o_orderkey", named(orders, "o_"))
    g.add_nodes("User", events.select("user_id").where("user_id is not null").distinct(), "user_id", {"user_id": "user_id"})
    g.add_nodes("Event", events, "event_id", {c: c for c in ("event_id", "ts", "event_type", "value", "props")})
    documents = table("documents").select("doc_id", "lang", "source", "n_chars").join(table("labels"), "doc_id", "left")
    g.add_nodes("Document", documents, "doc_id")

    g.add_rels("IN_REGION", nation, ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey")
    g.add_rels("IN_NATION", customer, ("Customer", "c_custkey"), ("Nation", "c_nationkey"), F.col("c_custkey") * 2)
    g.add_rels("IN_NATION", supplier, ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), F.col("s_suppkey") * 2 + 1)
    g.add_rels("PLACED", orders, ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey")
    # (order, line number) is no key of the lines; a hash of all columns is, and needs no shuffle.
    line = F.xxhash64(*lineitem.columns)
    props = {c.removeprefix("l_"): c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber")}
    g.add_rels("CONTAINS", lineitem, ("Order", "l_orderkey"), ("Part", "l_partkey"), line, props)
    g.add_rels("SUPPLIED_BY", lineitem, ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), line, props)
    g.add_rels("DID", events.where("user_id is not null"), ("User", "user_id"), ("Event", "event_id"), "event_id")
    later = events.where("user_id is not null").select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_id")).where("next_id is not null")
    g.add_rels("NEXT", later, ("Event", "event_id"), ("Event", "next_id"), "event_id")
    return g
