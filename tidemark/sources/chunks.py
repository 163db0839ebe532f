"""Statements of a project's own documents, as a source of facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import newest

#: Documents that are read first, in this order.
PRIORITY = ["README.md", "ARCHITECTURE.md"]
# Documents that say nothing of their project, the length of a statement, statements of a project, marks of list and table lines.
SKIPPED = ["LICENSE.md", "CHANGELOG.md", "CONTRIBUTING.md", "CODE_OF_CONDUCT.md", "SECURITY.md"]
MIN_CHARS, MOST = 80, 40
MARKS = ["|", "-", "*", ">"]


def chunk_corpus(docs: DataFrame, block: tuple[str, str] | None = None, priority: list[str] = PRIORITY, skipped: list[str] = SKIPPED, min_chars: int = MIN_CHARS, most: int = MOST) -> DataFrame:
    """(project, name, pos, chunk): the first ``most`` statements of each project, documents of ``priority`` first, the others by name.

    ``docs``: (project, name, text), a name once for each project. What stands between the marks of ``block`` (own text that was written into a document) and
    between code fences goes, without an end mark it stays; paragraphs become one line without leading ``#``; those of ``min_chars`` or more that are
    no list, table or quote count. ``pos`` is the paragraph's place in its document. Null texts have none. The limit runs before the shuffle too.
    """
    text = F.coalesce("text", F.lit(""))
    if block:
        text = F.regexp_replace(text, f"(?s){re.escape(block[0])}.*?{re.escape(block[1])}", "")
    text = F.regexp_replace(text, "(?s)```.*?```", "")
    paragraphs = docs.filter(~F.coalesce(F.col("name").isin(skipped), F.lit(False))).select("project", "name", F.posexplode(F.split(text, r"(?U)\n\s*\n")).alias("pos", "chunk"))
    line = F.trim(F.regexp_replace(F.trim(F.regexp_replace("chunk", r"(?U)\s+", " ")), "^#+", ""))
    kept = paragraphs.withColumn("chunk", line).filter((F.length("chunk") >= min_chars) & ~F.substring("chunk", 1, 1).isin(MARKS))
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("name")) if priority else F.lit(0)
    order = [F.asc(F.when(place > 0, place).otherwise(len(priority) + 1)), F.asc("name"), F.asc("pos")]
    return newest(kept, ["project"], order, most)
