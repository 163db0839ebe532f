"""Transcripts from JSON lines: the texts of user and assistant turns, whatever form their content has."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a session that are kept.
LONGEST = 24_000
TURNS = "session string, at struct<batch: long, file: string, block: long, row: long>, role string, text string"
BAD = "file string, line string"
#: White space as Unicode has it.
EDGES = r"(?U)^\s+|\s+$"


def content_text(content: Column) -> Column:
    """A string, or the text blocks of an array joined by spaces; null for other content. Array elements that are no text blocks are skipped."""
    kind = F.schema_of_variant(content)
    blocks = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "text")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))), " ")
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY"), joined)


def parsed(lines: DataFrame) -> DataFrame:
    """Add ``good``, ``role``, ``text`` and ``session`` to lines (value, file): the message's fields, or the line's own where it has no message.

    A line that is no JSON object is not good. Role and text are null where there is no turn: other roles, other content, blank texts. The
    session is the line's, or its file.
    """
    line = F.try_parse_json("value")
    rows = lines.withColumn("_v", line)
    whole = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    message = F.schema_of_variant(F.try_variant_get("_v", "$.message", "variant")).startswith("OBJECT")

    def field(name: str, kind: str) -> Column:
        return F.when(F.coalesce(message, F.lit(False)), F.try_variant_get("_v", f"$.message.{name}", kind)).otherwise(F.try_variant_get("_v", f"$.{name}", kind))

    role = F.coalesce(field("role", "string"), F.try_variant_get("_v", "$.type", "string"))
    text = F.regexp_replace(content_text(field("content", "variant")), EDGES, "")
    turn = whole & role.isin("user", "assistant") & (text != "")
    session = F.coalesce(F.try_variant_get("_v", "$.sessionId", "string"), F.col("file"))
    return rows.withColumns({"good": whole, "role": F.when(turn, role), "text": F.when(turn, text), "session": session}).drop("_v")


def ingest(lines: DataFrame, path: str, state: str) -> None:
    """Read a stream of text (``spark.readStream.text``) to its end: turns to ``path``/turns, lines that are no objects to ``path``/bad.

    ``state`` is the checkpoint: a later run reads the files that are new since, each once. A file that is there counts as complete, so a writer
    adds files. A batch that runs again overwrites its own folders. Blank lines are skipped.
    """
    named = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).filter(F.trim("value") != "")

    def write(batch: DataFrame, number: int) -> None:
        rows = parsed(batch.withColumn("row", F.monotonically_increasing_id()))
        at = F.struct(F.lit(number).cast("long").alias("batch"), "file", "block", "row").alias("at")
        rows.filter("good and text is not null").select("session", at, "role", "text").write.mode("overwrite").parquet(f"{path}/turns/batch={number}")
        rows.filter("not good").select("file", F.col("value").alias("line")).write.mode("overwrite").parquet(f"{path}/bad/batch={number}")

    named.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).queryName(f"q{uuid.uuid4().hex}").start().awaitTermination()


def sessions(turns: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(session, turns, text): the turns of each session in order of arrival, by lines, cut at ``longest`` characters.

    Turns beyond the cut are dropped before a session is put together, so what is collected of one is bounded.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("session").orderBy("at")
    lined = turns.withColumn("_line", F.concat("role", F.lit(": "), "text")).withColumn("_before", F.coalesce(F.sum(F.length("_line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = F.when(F.col("_before") < longest, F.struct("at", F.left("_line", F.lit(longest)).alias("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), "\n")
    return lined.groupBy("session").agg(F.count("*").cast("int").alias("turns"), F.left(joined, F.lit(longest)).alias("text"))
