"""Views of the driver tables as a fact graph; the SQL twins are common table expressions of the same names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors are stamped from this time on, a minute apart.
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts: a customer's link to a part, retired when returned; dates stand for all four clocks."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ordered, shipped = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    began, ended = F.least(ordered, shipped), F.when(F.col("l_returnflag") == "R", F.greatest(ordered, shipped))
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"), text(F.col("l_extendedprice").cast("decimal(12,2)")), text(shipped)).alias("uuid"),
        F.concat(F.lit("c"), text("o_custkey")).alias("source"),
        F.concat(F.lit("p"), text("l_partkey")).alias("target"),
        F.col("l_returnflag").alias("name"),
        F.concat(F.lit("project_"), text(F.col("o_custkey") % 20)).alias("group_id"),
        began.alias("created_at"),
        began.alias("valid_at"),
        ended.alias("invalid_at"),
        ended.alias("expired_at"),
        (F.col("l_linenumber") == 7).alias("archived"),
        F.concat(F.lit("e"), text("l_orderkey")).alias("episode"),
        F.col("l_quantity").cast("long").alias("served"),
        F.when(F.col("l_discount") > 0.08, 1).otherwise(0).cast("long").alias("corrected"),
    )


EDGE = """v_edge AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice::DECIMAL(12,2), l_shipdate::DATE) AS uuid,
  'c' || o_custkey AS source, 'p' || l_partkey AS target, l_returnflag AS name, 'project_' || (o_custkey % 20) AS group_id,
  least(o_orderdate::DATE, l_shipdate::DATE) AS created_at, least(o_orderdate::DATE, l_shipdate::DATE) AS valid_at,
  CASE WHEN l_returnflag = 'R' THEN greatest(o_orderdate::DATE, l_shipdate::DATE) END AS invalid_at,
  CASE WHEN l_returnflag = 'R' THEN greatest(o_orderdate::DATE, l_shipdate::DATE) END AS expired_at,
  l_linenumber = 7 AS archived, 'e' || l_orderkey AS episode, l_quantity::BIGINT AS served,
  CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END::BIGINT AS corrected
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities: customers and parts."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    return c.select(F.concat(F.lit("c"), text("c_custkey")).alias("uuid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"), F.concat(F.lit("project_"), text("c_nationkey")).alias("group_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("created_at")).unionAll(
        p.select(F.concat(F.lit("p"), text("p_partkey")), F.col("p_name"), F.col("p_type"), F.concat(F.lit("project_"), F.col("p_brand")), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")))
    )


NODE = """v_node AS (SELECT 'c' || c_custkey AS uuid, c_name AS name, c_mktsegment AS label, 'project_' || c_nationkey AS group_id, (DATE '2020-01-01' + (c_custkey % 365)::INTEGER) AS created_at FROM customer
  UNION ALL SELECT 'p' || p_partkey, p_name, p_type, 'project_' || p_brand, (DATE '2020-01-01' + (p_partkey % 365)::INTEGER) FROM part)"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uuid"), F.col("text").alias("content"), F.concat(F.lit("project_"), F.col("source")).alias("group_id"), F.col("lang").alias("cluster"))


EPISODE = "v_episode AS (SELECT doc_id AS uuid, text AS content, 'project_' || source AS group_id, lang AS cluster FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uuid"), F.concat(F.lit("project_"), text("label")).alias("group_id"), "embedding", (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("vec_id").cast("int"))).alias("created_at"))


FACT = "v_fact AS (SELECT vec_id AS uuid, 'project_' || label AS group_id, embedding, TIMESTAMP '2024-01-01' + to_minutes(vec_id::INTEGER) AS created_at FROM embeddings)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.concat(F.lit("agent_"), text("user_id")).alias("agent"), F.col("event_type").alias("tool"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


LOG = "v_log AS (SELECT event_id, ts AS seen, 'agent_' || user_id AS agent, event_type AS tool, value, (props->>'$.k')::INTEGER AS k FROM events)"
