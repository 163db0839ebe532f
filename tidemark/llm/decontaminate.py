"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, saved, unused

#: Words of a window; any shared run of so many words is found.
WINDOW = 10
#: Words of a fingerprinted gram. A window of n words holds n - GRAM + 1 of them, and keeps the least hash.
GRAM = 5
#: Fingerprints (8 bytes) and windows (about 80 bytes) of the benchmark up to this number are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: The same for the texts that share something with the benchmark (about 100 bytes each).
MATCHED_ROWS = 200_000
#: Bits of a position in a fingerprint; the rest is hash. An array of 8-byte values that fits Spark's 2 GB has fewer than 2**28.
PLACE_BITS = 28

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII of a lower-cased text."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fingerprints(df: DataFrame, window: int, word_column: str, out: str) -> DataFrame:
    """Add the array ``out``: least gram of each run of ``window`` words, as hash << PLACE_BITS | position; leftmost of equals."""
    gram = min(GRAM, window)
    kept = window - gram + 1

    def packed(_: Column, i: Column) -> Column:
        hashed = F.xxhash64(*(F.get(word_column, i + k) for k in range(gram)))
        return F.shiftleft(F.shiftrightunsigned(hashed, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(i.cast("long"))

    def least(x: Column, i: Column) -> Column:
        return F.least(x, *(F.get("_grams", i + k) for k in range(1, kept))) if kept > 1 else x

    def first(array: str, but: int) -> Column:
        return F.slice(array, 1, F.greatest(F.size(array) - but, F.lit(0)))

    grams = df.withColumn("_grams", F.transform(first(word_column, gram - 1), packed))
    return grams.withColumn(out, F.array_distinct(F.transform(first("_grams", kept - 1), least))).drop("_grams")


def keyed(df: DataFrame, text: str, names: tuple[str, str] = ("_id", "_hash")) -> DataFrame:
    """Add two hashes of the text, which stand for it in joins; equal texts are compared once."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({names[0]: F.xxhash64(F.lit(1), whole), names[1]: F.hash(whole)})


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to broadcast if it has so many rows at most, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def places_met(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(_id, _hash, _at): positions of document fingerprints that an item has too. Every shared run of ``window`` words holds one."""
    # explode_outer: explode would filter on the size first, and work out the fingerprints twice for it
    lowered = docs.select("_id", "_hash", words(ascii_lower(F.col("_text"))).alias("_words"))
    ours = fingerprints(lowered, window, "_words", "_prints").select("_id", "_hash", F.explode_outer("_prints").alias("_print"))
    ours = ours.select("_id", "_hash", F.shiftright("_print", PLACE_BITS).alias("_gram"), F.col("_print").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("_at"))
    theirs = fingerprints(items, window, "words", "_prints").select(F.explode_outer("_prints").alias("_print")).select(F.shiftright("_print", PLACE_BITS).alias("_gram")).distinct()
    return ours.join(bounded(theirs, BROADCAST_ROWS), "_gram").select("_id", "_hash", "_at").distinct()


def hits(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_text: str = "text", item: str = "item_id") -> DataFrame:
    """(_id, _hash, item, starts, length): the windows of ``length`` words of each item in each text, a table in the shared folder.

    Fingerprints that meet are extended to the windows around them, which are compared word by word with those of the
    items: at most WINDOW - GRAM + 1 windows for each fingerprint, however often a text or an item repeats itself.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(ascii_lower(F.coalesce(F.col(item_text), F.lit("")))).alias("words")).filter("size(words) > 0").distinct()
    docs = keyed(df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text")
    # the lengths of shorter items: numbers below ``window``
    short = [r[0] for r in items.filter(F.size("words") < window).select(F.size("words")).distinct().collect()]
    parts = []
    with Scratch(df.sparkSession) as scratch:
        for n in [window, *sorted(short)]:
            own = items.filter(F.size("words") >= n if n == window else F.size("words") == n)
            met = scratch.saved(places_met(docs, own, n))
            # texts that met an item, once each, with the places
            texts = docs.join(bounded(met.select("_id", "_hash").distinct(), MATCHED_ROWS), ["_id", "_hash"]).groupBy("_id", "_hash").agg(F.first(words(ascii_lower(F.col("_text")))).alias("_words"))
            # split above the aggregate and the join, so that no lambda below splits again
            texts = texts.join(met.groupBy("_id", "_hash").agg(F.collect_list("_at").alias("_ats")), ["_id", "_hash"])
            first, last = F.lit(min(GRAM, n) - n), F.size("_words") - n
            around = F.flatten(F.transform("_ats", lambda a: F.sequence(F.greatest(a + first, F.lit(0)), F.least(a, last))))
            windows = texts.select("_id", "_hash", F.explode_outer(F.transform(F.array_distinct(around), lambda s: F.struct(s.alias("start"), F.array_join(F.slice("_words", s + 1, n), " ").alias("run")))).alias("w"))
            theirs = own.select("item", F.explode_outer(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda s: F.array_join(F.slice("words", s, n), " ")))).alias("run")).distinct()
            found = windows.select("_id", "_hash", "w.start", "w.run").join(bounded(theirs, BROADCAST_ROWS), "run")
            parts.append(found.groupBy("_id", "_hash", "item").agg(F.array_sort(F.collect_list("start")).alias("starts")).withColumn("length", F.lit(n)))
        return saved(reduce(DataFrame.unionAll, parts))


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_text: str = "text", item: str = "item_id") -> DataFrame:
    """Add ``n_words`` and ``matches``: array of (item, places), the words inside occurrences of the item's windows.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A-Z are lower-cased.
    Null and empty texts have no words and no matches; items without words match nothing; equal rows give
    equal results; other columns pass through, but columns called like the two new ones are replaced.
    """
    found = hits(df, benchmark, window, text, item_text, item)
    inside = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("length") - 1))))
    rest = [c for c in df.columns if c not in ("n_words", "matches")]
    source, *names = (unused(c, df) for c in ("_text", "_id", "_hash", "_found"))
    found = found.select("_id", "_hash", F.struct("item", inside.alias("places")).alias("_one")).groupBy("_id", "_hash").agg(F.collect_list("_one").alias("_all")).toDF(*names)
    lowered = keyed(df.withColumn(source, F.col(text)), source, names[:2])
    joined = lowered.join(bounded(found, MATCHED_ROWS), names[:2], "left")
    return joined.withColumns({"n_words": F.size(words(ascii_lower(F.coalesce(F.col(source), F.lit(""))))).cast("long"), "matches": F.coalesce(names[2], F.array().cast("array<struct<item:string,places:array<int>>>"))}).select(*rest, "n_words", "matches")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``df`` in whose text no window of an item occurs; null and empty texts stay, columns stay as they are."""
    names = [unused(c, df) for c in ("_id", "_hash")]
    found = hits(df, benchmark, window, text, item_text, item).select("_id", "_hash").distinct().toDF(*names)
    return keyed(df, text, tuple(names)).join(bounded(found, MATCHED_ROWS), names, "left_anti").select(*df.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")).drop("text")
    found = found.withColumn("_items", F.array_sort(F.array_distinct("matches.item"))).withColumn("n_hit", F.size(F.array_distinct(F.flatten("matches.places"))).cast("long"))
    return found.select("doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, (len(w) - least(len(w), {WINDOW}) + 2)::BIGINT)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, item_id, i, n FROM dw JOIN bw USING (n, g)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
          FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
