"""Structured Streaming twins of the telemetry reports; each runs to the end of its input and returns its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import screening
from tidemark.sources.shared import Scratch, remove, shared_dir
from tidemark.sources.views import table
from tidemark.streaming import retry

#: How far behind the newest event a late one still counts.
LATE = "1 day"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, a file at a time."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name}.parque[t]")


def ended(df: DataFrame, mode: str, path: str, state: str) -> StreamingQuery:
    """Run a query to the end of its input; each batch overwrites its own folder, so one that runs again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).queryName(f"q{uuid.uuid4().hex}").start()
    query.awaitTermination()
    return query


def upserted(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last version of each key that the batches at ``path`` have written."""
    values = [c for c in schema.names if c not in keys]
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(f"{path}/*")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in schema.names))


def run(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a query over all there is. With ``keys``: in update mode, of which the last version of each key is the result; else in append mode.

    State is held up to the watermark and removed at the end. A batch holds only what it has changed.
    """
    spark = df.sparkSession
    path, state = shared_dir(spark), shared_dir(spark)
    ended(df, "update" if keys else "append", path, state)
    remove(spark, state)
    return upserted(spark, path, df.schema, keys) if keys else spark.read.schema(df.schema).parquet(f"{path}/*")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)


def by_day(events: DataFrame) -> DataFrame:
    """(day, tool, calls, value) of a stream of events with a watermark on ``at``."""
    g = events.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("tool"), "calls", F.round("value", 4).alias("value"))


def daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(by_day(log(spark, sf_dir)), ["day", "tool"])


def sliding_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of each tool's latencies over a sliding hour; the accuracy keeps small windows exact."""
    p = F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.95)), 10_000)
    g = log(spark, sf_dir).groupBy(F.window("at", "1 hour", "10 minutes"), "event_type").agg(F.count("*").alias("calls"), p.alias("p"))
    return run(g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.col("event_type").alias("tool"), "calls", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95")), ["start", "tool"])


def closed_sessions(events: DataFrame) -> DataFrame:
    """(user_id, start, calls) of the sessions that the watermark has closed."""
    g = events.groupBy(F.session_window("at", "30 minutes"), "user_id").agg(F.count("*").alias("calls"))
    return g.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "calls")


def pieces(events: DataFrame) -> DataFrame:
    """(user_id, start, end, calls): the sessions of a part of a log, as if there were no other part."""
    g = events.groupBy(F.session_window("at", "30 minutes"), "user_id").agg(F.count("*").alias("calls"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "calls")


def joined(parts: DataFrame) -> DataFrame:
    """(user_id, start, calls): the sessions of a whole log from the pieces of its parts, in any order; pieces of a user that overlap are one."""
    per = Window.partitionBy("user_id").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max("end").over(per.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(per))
    g = opened.groupBy("user_id", "_k").agg(F.min("start").alias("start"), F.sum("calls").alias("calls"))
    return g.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "calls")


def all_sessions(events: DataFrame) -> DataFrame:
    """Every session of a stream of events, those still open at its end and late events too. No state is held: each batch
    leaves its pieces, which are joined in the end."""
    spark = events.sparkSession
    path, state = shared_dir(spark), shared_dir(spark)
    schema = pieces(events).schema

    def write(batch: DataFrame, number: int) -> None:
        pieces(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    events.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).queryName(f"q{uuid.uuid4().hex}").start().awaitTermination()
    remove(spark, state)
    return joined(spark.read.schema(schema).parquet(f"{path}/*"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_sessions(stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = log(spark, sf_dir).filter("event_type in ('view', 'error')")
    g = served.groupBy(F.window("at", "1 hour"), "user_id").agg(F.count_if(F.col("event_type") == "view").alias("impressions"), F.count_if(F.col("event_type") == "error").alias("corrections"))
    return run(g.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "impressions", "corrections"), ["user_id", "start"])


def changes(rows: DataFrame) -> DataFrame:
    """(scope, day, op, uuid): an addition of each fact, and a retirement of those that ended."""
    fact = rows.select((F.col("l_suppkey") % 20).alias("scope"), F.col("l_shipdate").cast("date").alias("day"), F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("uuid"), "l_returnflag")
    ops = F.when(F.col("l_returnflag") == "R", F.array(F.lit("added"), F.lit("retired"))).otherwise(F.array(F.lit("added")))
    return fact.select("scope", "day", F.explode(ops).alias("op"), "uuid")


FEED = "scope long, day date, op string, uuid string, additions long, retirements long"


def feed(rows: DataFrame, path: str, state: str, source: Callable[[DataFrame], DataFrame] = changes) -> None:
    """Append every change with its scope's running counts to ``path``/rows; a batch goes on from the counts that those before it have left.

    Counts are kept as one small row of each scope and batch; within a batch changes are counted by day, kind and fact. A batch that runs again
    starts from the same counts and overwrites its own folders.
    """
    spark = rows.sparkSession
    totals = "scope long, batch long, additions long, retirements long"

    def write(batch: DataFrame, number: int) -> None:
        with Scratch(spark) as scratch:
            new = scratch.saved(source(batch))
            counts = [F.count_if(F.col("op") == "added").alias("additions"), F.count_if(F.col("op") == "retired").alias("retirements")]
            new.groupBy("scope").agg(*counts).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
            run = Window.partitionBy("scope").orderBy("day", "op", "uuid")
            out = new.select("*", *(F.count_if(F.col("op") == op).over(run).alias(name) for op, name in (("added", "additions"), ("retired", "retirements"))))
            if number:
                before = spark.read.schema(totals).parquet(f"{path}/counts").filter(F.col("batch") < number).groupBy("scope").agg(F.sum("additions").alias("_a"), F.sum("retirements").alias("_r"))
                out = out.join(before, "scope", "left").withColumns({"additions": F.col("additions") + F.coalesce("_a", F.lit(0)), "retirements": F.col("retirements") + F.coalesce("_r", F.lit(0))})
            out.select("scope", "day", "op", "uuid", "additions", "retirements").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).queryName(f"q{uuid.uuid4().hex}").start().awaitTermination()


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7: every addition and retirement, with the running counts of its scope."""
    path, state = shared_dir(spark), shared_dir(spark)
    feed(stream(spark, sf_dir, "lineitem"), path, state)
    remove(spark, state)
    return spark.read.schema(FEED).parquet(f"{path}/rows").select("scope", F.col("day").cast("string").alias("day"), "op", "uuid", "additions", "retirements")


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents once per scope and content: redacted, screened for instructions, then kept unless an earlier batch has them.

    The stream holds no state: each batch is compared with what the batches before it have kept, by a join on
    the content hash, and overwrites its own folder when it runs again.
    """
    path, state = shared_dir(spark), shared_dir(spark)
    schema = "group_id string, content_hash string"

    def write(batch: DataFrame, number: int) -> None:
        with Scratch(spark) as scratch:
            # redacted once: the rules below name the text several times
            clean = scratch.saved(screening.redact(batch.select(F.col("source").alias("group_id"), "text"), "text").select("group_id", "text"))
            hashed = clean.filter(F.size(screening.instructions("text")) == 0).select("group_id", F.sha2(screening.spaced("text").cast("binary"), 256).alias("content_hash")).distinct()
            if number:
                before = spark.read.schema(f"{schema}, batch long").parquet(path).filter(F.col("batch") < number)
                hashed = hashed.join(before, ["group_id", "content_hash"], "left_anti")
            hashed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream(spark, sf_dir, "documents").writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).queryName(f"q{uuid.uuid4().hex}").start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/*")


def late_retirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8: returns by the day they took effect, in order of arrival; those more than 30 days behind the newest seen so far are set aside.

    Each batch compares its rows with the newest day of the batches before it, which a small table keeps.
    """
    path, state = shared_dir(spark), shared_dir(spark)
    schema = "late boolean, returns long, first string"

    def write(batch: DataFrame, number: int) -> None:
        newest = spark.read.schema(f"{schema}, newest date, batch long").parquet(path).filter(F.col("batch") < number).agg(F.max("newest")).first()[0] if number else None
        day = F.col("l_shipdate").cast("date")
        rows = batch.filter("l_returnflag = 'R'").withColumn("day", day)
        late = F.coalesce(F.col("day") < F.date_sub(F.lit(newest).cast("date"), 30), F.lit(False)) if newest else F.lit(False)
        kept = rows.groupBy(late.alias("late")).agg(F.count("*").alias("returns"), F.min("day").cast("string").alias("first"), F.max("day").alias("newest"))
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream(spark, sf_dir, "lineitem").writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).queryName(f"q{uuid.uuid4().hex}").start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/*").groupBy("late").agg(F.sum("returns").alias("returns"), F.min("first").alias("first"))


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: failed calls of each agent, tried again every ten minutes; the log's column k says how many tries fail."""
    calls = log_rows(stream(spark, sf_dir, "events"))
    found = retry.settle_all(calls)
    return found.select(F.col("item").alias("event_id"), "retry_count", "status", F.date_format("settled_at", "yyyy-MM-dd HH:mm:ss").alias("settled"))


def log_rows(events: DataFrame) -> DataFrame:
    """The failed calls of a log as rows of the retry queue."""
    return events.filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("queue"), F.col("event_id").cast("long").alias("item"), F.col("ts").cast("timestamp").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("fails"))
