"""Roll-ups of the graph, the telemetry and the evaluation tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import screening
from tidemark.operators import stats, temporal
from tidemark.sources.views import EDGE, EPISODE, LOG, NODE, edges, episodes, log, nodes, table


def health(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    shared = n.groupBy("name", "label").agg(F.count_distinct("group_id").alias("k")).agg(F.count_if(F.col("k") >= 2).alias("v"))
    one = n.agg(F.count("*").alias("v")).select(F.lit("nodes").alias("metric"), F.col("v").alias("value"))
    types = n.groupBy(F.concat(F.lit("type:"), "label").alias("metric")).agg(F.count("*").alias("value"))
    states = e.agg(F.count_if(F.col("invalid_at").isNull() & ~F.col("archived")).alias("active"), F.count("invalid_at").alias("superseded"))
    return one.unionAll(types).unionAll(states.select(F.expr("stack(2, 'active', active, 'superseded', superseded) as (metric, value)"))).unionAll(shared.select(F.lit("shared_names"), "v"))


HEALTH = f"""WITH {EDGE}, {NODE} SELECT 'nodes' AS metric, count(*) AS value FROM v_node UNION ALL SELECT 'type:' || label, count(*) FROM v_node GROUP BY label
UNION ALL SELECT 'active', count(*) FROM v_edge WHERE invalid_at IS NULL AND NOT archived UNION ALL SELECT 'superseded', count(invalid_at) FROM v_edge
UNION ALL SELECT 'shared_names', count(*) FROM (SELECT name, label FROM v_node GROUP BY ALL HAVING count(DISTINCT group_id) >= 2)"""


def latest_retired(spark, d):
    return edges(spark, d).filter("invalid_at is not null").orderBy(F.desc("invalid_at"), "uuid").limit(10).select("uuid", F.col("invalid_at").cast("string").alias("invalid_at"))


RETIRED = f"WITH {EDGE} SELECT uuid, invalid_at::VARCHAR AS invalid_at FROM v_edge WHERE invalid_at IS NOT NULL ORDER BY v_edge.invalid_at DESC, uuid LIMIT 10"


def project_rollup(spark, d):
    n = nodes(spark, d)
    return n.groupBy("group_id").agg(F.count("*").alias("entities"), F.count_if(F.col("label") == "BUILDING").alias("decisions"), F.count_if(F.col("label") == "ECONOMY").alias("conventions"), F.count_if(F.col("label").isin("PROMO", "SMALL")).alias("lessons"))


ROLLUP = f"WITH {NODE} SELECT group_id, count(*) AS entities, count(*) FILTER (label = 'BUILDING') AS decisions, count(*) FILTER (label = 'ECONOMY') AS conventions, count(*) FILTER (label IN ('PROMO', 'SMALL')) AS lessons FROM v_node GROUP BY 1"


def promotion_candidates(spark, d):
    n = nodes(spark, d).groupBy("name", "label").agg(F.array_sort(F.collect_set("group_id")).alias("g")).filter(F.size("g") >= 2)
    return n.select("name", "label", F.size("g").cast("long").alias("scopes"), F.array_join("g", ",").alias("groups")).orderBy(F.desc("scopes"), "name", "label").limit(40)


PROMOTION = f"WITH {NODE} SELECT name, label, count(DISTINCT group_id) AS scopes, string_agg(DISTINCT group_id, ',' ORDER BY group_id) AS groups FROM v_node GROUP BY 1, 2 HAVING count(DISTINCT group_id) >= 2 ORDER BY scopes DESC, name, label LIMIT 40"


def facets(spark, d):
    return nodes(spark, d).rollup("group_id", "label").agg(F.count("*").alias("n")).select("group_id", "label", "n")


FACETS = f"WITH {NODE} SELECT group_id, label, count(*) AS n FROM v_node GROUP BY ROLLUP (group_id, label)"


def feedback_summary(spark, d):
    e = edges(spark, d).withColumn("served", F.when(F.col("served") > 10, F.col("served")).otherwise(0))
    a = temporal.active(e).agg(F.count("*").alias("facts"), F.count_if(F.col("served") > 0).alias("ever_served"), F.sum("served").alias("impressions"))
    return a.crossJoin(e.agg(F.sum("corrected").alias("corrected"))).select("facts", "ever_served", (F.col("facts") - F.col("ever_served")).alias("never_served"), "impressions", "corrected", F.round(F.try_divide("ever_served", "facts"), 6).alias("coverage"))


FEEDBACK = f"""WITH {EDGE}, e AS (SELECT *, CASE WHEN served > 10 THEN served ELSE 0 END AS s FROM v_edge), a AS (SELECT count(*) AS facts, count(*) FILTER (s > 0) AS ever_served, sum(s)::BIGINT AS impressions FROM e WHERE invalid_at IS NULL AND NOT archived)
SELECT facts, ever_served, facts - ever_served AS never_served, impressions, (SELECT sum(corrected)::BIGINT FROM e) AS corrected, round(ever_served / facts, 6) AS coverage FROM a"""


def top_served(spark, d):
    return temporal.active(edges(spark, d)).orderBy(F.desc("served"), "uuid").limit(15).select("uuid", "served", "corrected")


TOP_SERVED = f"WITH {EDGE} SELECT uuid, served, corrected FROM v_edge WHERE invalid_at IS NULL AND NOT archived ORDER BY served DESC, uuid LIMIT 15"


def top_corrected(spark, d):
    """The facts with most corrections, ended ones as well."""
    return edges(spark, d).filter("corrected > 0").orderBy(F.desc("corrected"), F.desc("served"), "uuid").limit(15).select("uuid", "corrected", "served")


TOP_CORRECTED = f"WITH {EDGE} SELECT uuid, corrected, served FROM v_edge WHERE corrected > 0 ORDER BY corrected DESC, served DESC, uuid LIMIT 15"


def usage_flags(spark, d):
    return edges(spark, d).groupBy("group_id").agg(F.count_if(F.col("corrected") > 0).alias("suspect"), F.count_if(F.col("served") <= 5).alias("dead_weight"), F.count("*").alias("facts"))


USAGE = f"WITH {EDGE} SELECT group_id, count(*) FILTER (corrected > 0) AS suspect, count(*) FILTER (served <= 5) AS dead_weight, count(*) AS facts FROM v_edge GROUP BY 1"


def feedback_counters(spark, d):
    """Impressions of served rows with opt-in (k even), added to the counters of each agent."""
    served = log(spark, d).filter("tool = 'view' and k % 2 = 0").groupBy("agent").agg(F.count("*").alias("impressions"), F.max("at").cast("string").alias("last_at"))
    return log(spark, d).select("agent").distinct().join(served, "agent", "left").select("agent", F.coalesce("impressions", F.lit(0)).alias("impressions"), F.substring("last_at", 1, 19).alias("last_at"))


COUNTERS = f"WITH {LOG}, s AS (SELECT agent, count(*) AS impressions, max(seen) AS last_at FROM v_log WHERE tool = 'view' AND k % 2 = 0 GROUP BY 1) SELECT DISTINCT v_log.agent, coalesce(impressions, 0) AS impressions, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM v_log LEFT JOIN s USING (agent)"


def provenance(spark, d):
    """Per (agent, session day): episodes, facts derived from them, scopes, first and last write."""
    e = edges(spark, d)
    ep = table(spark, d, "orders").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("episode"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("agent"), F.date_format("o_orderdate", "yyyy-MM").alias("session"), F.col("o_orderdate").cast("date").alias("day"))
    joined = ep.join(e.select("episode", "uuid", "group_id"), "episode", "left")
    return joined.groupBy("agent", "session").agg(F.count_distinct("episode").alias("episodes"), F.count_distinct("uuid").alias("facts"), F.array_join(F.array_sort(F.collect_set("group_id")), ",").alias("scopes"), F.min("day").cast("string").alias("first_write"), F.max("day").cast("string").alias("last_write"))


PROVENANCE = f"""WITH {EDGE}, ep AS (SELECT 'e' || o_orderkey AS episode, nullif(o_orderpriority, '5-LOW') AS agent, strftime(o_orderdate, '%Y-%m') AS session, o_orderdate::DATE AS day FROM orders)
SELECT agent, session, count(DISTINCT episode) AS episodes, count(DISTINCT uuid) AS facts, coalesce(string_agg(DISTINCT group_id, ',' ORDER BY group_id), '') AS scopes, min(day)::VARCHAR AS first_write, max(day)::VARCHAR AS last_write FROM ep LEFT JOIN v_edge USING (episode) GROUP BY 1, 2"""

#: Prices per million tokens; the longest prefix of a model's name counts.
PRICES = [("view", 0.4), ("click", 1.0), ("pur", 2.0), ("purchase", 3.0)]


def priced(spark, d):
    """The call log with cost: longest matching price, none flagged as unpriced."""
    calls = log(spark, d).withColumn("tokens", F.round(F.col("value") * 10).cast("long"))
    rows = spark.createDataFrame(PRICES, "model string, price double")
    best = calls.select("tool").distinct().join(F.broadcast(rows), F.expr("startswith(tool, model)")).groupBy("tool").agg(F.max_by("price", F.length("model")).alias("price"))
    return calls.join(F.broadcast(best), "tool", "left").withColumn("cost", F.coalesce(F.col("tokens") * F.col("price") / 1e6, F.lit(0.0)).cast("decimal(18,6)")).withColumn("priced", F.col("price").isNotNull())


_PRICED = f"""{LOG}, pr AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {p})" for m, p in PRICES)}) t(model, price)),
priced AS (SELECT v_log.*, round(value * 10)::BIGINT AS tokens, (SELECT arg_max(price, length(model))::DOUBLE FROM pr WHERE starts_with(tool, model)) AS price FROM v_log),
c AS (SELECT *, coalesce(tokens * price / 1e6, 0)::DECIMAL(18,6) AS cost FROM priced)"""


def cost_summary(spark, d):
    g = priced(spark, d).withColumn("day", F.date_format("at", "yyyy-MM-dd")).groupBy("day", "tool").agg(F.count("*").alias("calls"), F.count_if("priced").alias("priced"), F.sum("tokens").alias("tokens"), F.sum("cost").cast("double").alias("cost"))
    return g.select("day", "tool", "calls", "priced", (F.col("calls") - F.col("priced")).alias("unpriced"), "tokens", F.round("cost", 6).alias("cost"))


COST = f"WITH {_PRICED} SELECT strftime(seen, '%Y-%m-%d') AS day, tool, count(*) AS calls, count(price) AS priced, count(*) - count(price) AS unpriced, sum(tokens)::BIGINT AS tokens, round(sum(cost)::DOUBLE, 6) AS cost FROM c GROUP BY ALL"


def cost_groups(spark, d):
    """Calls and cost in all, by operation, by provider and by day, from one pass; unpriced calls stay apart, also in days that have no others."""
    provider = F.when(F.col("tool").isin("view", "click"), "cloud").otherwise("local")
    sets = {"total": F.lit("all"), "operation": F.col("tool"), "provider": provider, "day": F.date_format("at", "yyyy-MM-dd")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in sets.items())))
    g = priced(spark, d).withColumn("g", each).groupBy("g.kind", "g.name").agg(F.count_if("priced").alias("priced"), F.count_if(~F.col("priced")).alias("unpriced"), F.sum("tokens").alias("tokens"), F.sum("cost").cast("double").alias("cost"))
    return g.select("kind", "name", "priced", "unpriced", "tokens", F.round("cost", 6).alias("cost"))


_SET = "SELECT '{0}' AS kind, {1} AS name, count(price) AS priced, count(*) - count(price) AS unpriced, sum(tokens)::BIGINT AS tokens, round(sum(cost)::DOUBLE, 6) AS cost FROM c GROUP BY 2"
COST_GROUPS = f"WITH {_PRICED} " + " UNION ALL ".join(_SET.format(*x) for x in [("total", "'all'"), ("operation", "tool"), ("provider", "CASE WHEN tool IN ('view', 'click') THEN 'cloud' ELSE 'local' END"), ("day", "strftime(seen, '%Y-%m-%d')")])


def cloud_share(spark, d):
    return log(spark, d).groupBy("agent").agg(F.round(F.try_divide(F.count_if(F.col("tool").isin("view", "click")), F.count("*")), 6).alias("share"), F.count("*").alias("calls"))


CLOUD = f"WITH {LOG} SELECT agent, round(count(*) FILTER (tool IN ('view', 'click')) / count(*), 6) AS share, count(*) AS calls FROM v_log GROUP BY 1"


def extraction_ab(spark, d):
    runs = log(spark, d).groupBy("tool").agg(F.count_if(F.col("k") >= 10).alias("ok"), F.count("*").alias("n"), F.sum("k").alias("edges"), F.avg("value").alias("seconds"))
    base = runs.filter("tool = 'view'").select(F.col("edges").alias("base"))
    return runs.crossJoin(F.broadcast(base)).select("tool", F.round(F.col("ok") / F.col("n"), 6).alias("success"), "edges", F.round("seconds", 4).alias("seconds"), F.round(F.col("edges") / F.col("base"), 6).alias("of_baseline"))


EXTRACTION = f"WITH {LOG}, r AS (SELECT tool, count(*) FILTER (k >= 10) AS ok, count(*) AS n, sum(k)::BIGINT AS edges, avg(value) AS seconds FROM v_log GROUP BY 1) SELECT tool, round(ok / n, 6) AS success, edges, round(seconds, 4) AS seconds, round(edges / (SELECT edges FROM r WHERE tool = 'view'), 6) AS of_baseline FROM r"


def embedding_gaps(spark, d):
    v = table(spark, d, "embeddings").withColumn("e", F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return v.groupBy("label").agg(F.count("*").alias("rows"), F.count_if(F.col("e").isNull()).alias("missing"), F.count_if(F.size("e") != 64).alias("wrong_size"))


GAPS = "SELECT label, count(*) AS rows, count(*) FILTER (vec_id % 11 = 0) AS missing, count(*) FILTER (vec_id % 13 = 0 AND vec_id % 11 <> 0) AS wrong_size FROM embeddings GROUP BY 1"


def provenance_fill(spark, d):
    """Agent by precedence: explicit, hint, default; blanks don't count."""
    def given(x):
        return F.nullif(F.trim(x), F.lit(""))

    l = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 3 == 0, F.lit("  ")).otherwise(F.when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag"))).alias("explicit"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).otherwise("").alias("hint"))
    return l.groupBy(F.coalesce(given("explicit"), given("hint"), F.lit("unknown")).alias("agent")).agg(F.count("*").alias("n"))


FILL = "SELECT coalesce(CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag END, CASE WHEN l_linestatus = 'O' THEN 'O' END, 'unknown') AS agent, count(*) AS n FROM lineitem GROUP BY 1"


def hash_coverage(spark, d):
    e = episodes(spark, d).withColumn("content_hash", content_hash("content"))
    e = e.withColumn("content_hash", F.when(F.col("uuid") % 10 != 0, F.col("content_hash")))
    repeated = e.filter("content_hash is not null").groupBy("group_id", "content_hash").agg(F.count("*").alias("n")).filter("n > 1").groupBy("group_id").agg(F.count("*").alias("repeated"))
    return e.groupBy("group_id").agg(F.count("content_hash").alias("hashed"), F.count_if(F.col("content_hash").isNull()).alias("missing")).join(repeated, "group_id", "left").select("group_id", "hashed", "missing", F.coalesce("repeated", F.lit(0)).alias("repeated"))


def content_hash(column):
    """Canonical content key: white space collapsed, case kept."""
    return F.sha2(screening.spaced(column).cast("binary"), 256)


#: White space as Unicode has it, for DuckDB.
SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_HASH = rf"sha256(trim(regexp_replace(content, '{SPACES}', ' ', 'g'), ' '))"
COVERAGE = f"""WITH {EPISODE}, e AS (SELECT *, CASE WHEN uuid % 10 <> 0 THEN {_HASH} END AS h FROM v_episode), r AS (SELECT group_id, count(*) AS repeated FROM (SELECT group_id, h FROM e WHERE h IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
SELECT e.group_id, count(h) AS hashed, count(*) - count(h) AS missing, coalesce(max(repeated), 0) AS repeated FROM e LEFT JOIN r USING (group_id) GROUP BY 1"""


def exact_dedup(spark, d):
    e = episodes(spark, d).withColumn("h", content_hash("content"))
    return e.groupBy("group_id", "h").agg(F.min("uuid").alias("kept"), F.count("*").alias("copies"))


DEDUP = f"WITH {EPISODE} SELECT group_id, {_HASH} AS h, min(uuid) AS kept, count(*) AS copies FROM v_episode GROUP BY ALL"


def admission_exact(spark, d):
    """Which of a batch (every fifth document) repeat an earlier one of the same scope."""
    e = episodes(spark, d).withColumn("h", content_hash("content"))
    old = e.filter("uuid % 5 <> 0").groupBy("group_id", "h").agg(F.min("uuid").alias("of"))
    return e.filter("uuid % 5 = 0").join(old, ["group_id", "h"], "left").select("uuid", F.col("of").alias("duplicate_of"))


ADMISSION = f"WITH {EPISODE}, e AS (SELECT *, {_HASH} AS h FROM v_episode), o AS (SELECT group_id, h, min(uuid) AS of FROM e WHERE uuid % 5 <> 0 GROUP BY ALL) SELECT uuid, of AS duplicate_of FROM e LEFT JOIN o USING (group_id, h) WHERE uuid % 5 = 0"


def bounded(df, rows=100_000):
    """To broadcast with so many rows at most; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def eval_outcomes(spark, d):
    """Benchmark passages as cases; a document that holds one is a hit, ranked by doc_id."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    # the passage's first four words are looked up in the documents' word quadruples; containment is checked after
    split = docs.select("doc_id", F.split("text", r"\s+").alias("w"))
    probes = split.select("doc_id", F.explode_outer(F.array_distinct(F.transform("w", lambda _, i: F.xxhash64(F.array_join(F.slice("w", i + 1, 4), " "))))).alias("h"))
    own = b.withColumn("w", F.split("q", r"\s+"))
    firsts = own.filter("size(w) >= 6").select("item_id", "q", F.xxhash64(F.array_join(F.slice("w", 2, 4), " ")).alias("h"))
    pairs = probes.join(bounded(firsts), "h").join(docs, "doc_id").filter(F.contains("text", "q")).select("item_id", "doc_id").distinct()
    # shorter passages have no four whole words inside; there are few, and each is looked for in each text
    short = own.filter("size(w) < 6").select("item_id", "q")
    if short.limit(1).count():
        pairs = pairs.unionAll(docs.join(bounded(short), F.contains("text", "q")).select("item_id", "doc_id"))
    hits = pairs.groupBy("item_id").agg(F.count("*").alias("found"), F.min("doc_id").alias("first_doc"))
    return b.join(hits, "item_id", "left").select("item_id", F.col("found").isNotNull().alias("hit"), F.coalesce("found", F.lit(0)).alias("found"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("category"))


_OUT = "o AS (SELECT item_id, count(doc_id) > 0 AS hit, count(doc_id) AS found, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)"


def eval_metrics(spark, d):
    m = eval_outcomes(spark, d).rollup("category").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), F.sum("found").alias("found"))
    return m.withColumn("category", F.coalesce("category", F.lit("OVERALL")))


METRICS = f"WITH {_OUT} SELECT coalesce(category, 'OVERALL') AS category, count(*) AS n, count(*) FILTER (hit) AS hits, round(avg(hit::INTEGER), 6) AS hit_rate, sum(found)::BIGINT AS found FROM o GROUP BY ROLLUP (category)"


def grades(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"))


def kappa(spark, d):
    k = stats.kappa(grades(spark, d))
    return k.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


KAPPA = """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS n, sum(n) FILTER (a = b)::DOUBLE AS same FROM c),
x AS (SELECT sum(na * nb)::DOUBLE AS chance FROM (SELECT a, sum(n) AS na FROM c GROUP BY 1) l JOIN (SELECT b, sum(n) AS nb FROM c GROUP BY 1) r ON a = b)
SELECT n::BIGINT AS n, round(same / n, 6) AS agreement, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 6) AS kappa FROM t, x"""


def agreement(spark, d):
    g = grades(spark, d).withColumn("b", F.when(F.col("doc_id") % 9 == 0, -1).otherwise(F.col("b")))
    real = (F.col("a") >= 0) & (F.col("b") >= 0)
    return g.agg(F.count("*").alias("n"), F.count_if(real).alias("gradeable"), F.count_if(~real).alias("abstained"), F.count_if(real & (F.col("a") == F.col("b"))).alias("same"), F.sum(F.when(F.col("b") < 0, F.col("a")).otherwise(F.least("a", "b"))).alias("consensus_sum"))


AGREEMENT = "WITH g AS (SELECT quality AS a, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE toxic END AS b FROM labels) SELECT count(*) AS n, count(*) FILTER (b >= 0) AS gradeable, count(*) FILTER (b < 0) AS abstained, count(*) FILTER (b >= 0 AND a = b) AS same, sum(CASE WHEN b < 0 THEN a ELSE least(a, b) END)::BIGINT AS consensus_sum FROM g"


def acceptance(spark, d):
    g = grades(spark, d).select(F.expr("stack(2, 'quality', a, 'toxic', b) as (grader, grade)"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.groupBy("grader").agg(F.count_if(F.col("grade") >= 1).alias("k"), F.count("*").alias("n")).select("grader", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_WILSON = "round(greatest(0, (k / n + 1.959963984540054 ^ 2 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 ^ 2 / (4.0 * n * n))) / (1 + 1.959963984540054 ^ 2 / n)), 6) AS low, round(least(1, (k / n + 1.959963984540054 ^ 2 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 ^ 2 / (4.0 * n * n))) / (1 + 1.959963984540054 ^ 2 / n)), 6) AS high"
ACCEPTANCE = f"WITH g AS (SELECT 'quality' AS grader, count(*) FILTER (quality >= 1) AS k, count(*) AS n FROM labels UNION ALL SELECT 'toxic', count(*) FILTER (toxic >= 1), count(*) FROM labels) SELECT grader, k, n, {_WILSON} FROM g"


def bootstrap_ci(spark, d):
    """Intervals of the share of good documents, for each language and for all."""
    rated = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return stats.bootstrap(rated, "quality", "doc_id", "lang").unionAll(stats.bootstrap(rated, "quality", "doc_id"))


def split_queries(spark, d):
    first = F.conv(F.substring(F.sha2(F.lower(F.trim("text")).cast("binary"), 256), 1, 2), 16, 10).cast("int")
    return table(spark, d, "benchmark").select("item_id", F.when(first / 255 < 0.3, "test").otherwise("dev").alias("part"))


SPLIT = "SELECT item_id, CASE WHEN ('0x' || sha256(lower(trim(text)))[1:2])::INTEGER / 255 < 0.3 THEN 'test' ELSE 'dev' END AS part FROM benchmark"


def fingerprint(spark, d):
    """Count and order-free hash of each part's texts: sums of text hashes, combined before the shuffle."""
    return split_queries(spark, d).join(table(spark, d, "benchmark"), "item_id").groupBy("part").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 14), 16, 10).cast("decimal(38,0)")).cast("string").alias("hash"))


FINGERPRINT = f"WITH s AS ({SPLIT}) SELECT part, count(*) AS n, sum(('0x' || sha256(text)[1:14])::BIGINT)::VARCHAR AS hash FROM s JOIN benchmark USING (item_id) GROUP BY 1"


def query_harvest(spark, d):
    t = table(spark, d, "conversations").filter("role = 'user'").withColumn("q", F.trim("text")).filter(F.length("q") >= 8)
    return t.groupBy(F.lower("q").alias("query")).agg(F.min(F.struct("conv_id", "turn")).alias("f"), F.count("*").alias("times")).select(F.sha2(F.col("query").cast("binary"), 256).alias("query_hash"), F.col("f.conv_id").alias("first_conv"), "times")


HARVEST = "SELECT sha256(lower(trim(text))) AS query_hash, min(conv_id) AS first_conv, count(*) AS times FROM conversations WHERE role = 'user' AND length(trim(text)) >= 8 GROUP BY lower(trim(text))"


def admissible_queries(spark, d):
    t = table(spark, d, "conversations").filter("role = 'user'")
    q = F.trim("text")
    ok = ~F.startswith(q, F.lit("/")) & (F.length(F.regexp_replace(q, "[^A-Za-z0-9]", "")) >= 8) & ~F.lower(q).isin("yes", "no", "ok", "continue", "thanks")
    return t.groupBy("conv_id").agg(F.count_if(ok).alias("admissible"), F.count("*").alias("asked"))


ADMISSIBLE = "SELECT conv_id, count(*) FILTER (NOT starts_with(trim(text), '/') AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 8 AND lower(trim(text)) NOT IN ('yes', 'no', 'ok', 'continue', 'thanks')) AS admissible, count(*) AS asked FROM conversations WHERE role = 'user' GROUP BY 1"


def gate(spark, d):
    """Metrics of the newer half of the labels against the older: a relative drop over 5 % fails."""
    g = grades(spark, d).withColumn("new", F.col("doc_id") % 2 == 1)
    m = g.agg(F.avg(F.when(~F.col("new"), F.col("a"))).alias("base"), F.avg(F.when(F.col("new"), F.col("a"))).alias("now"), F.sum(F.when(F.col("new"), F.col("b"))).alias("violations"))
    return m.select(F.round("base", 6).alias("base"), F.round("now", 6).alias("now"), "violations", ((F.col("base") > 0) & ((F.col("base") - F.col("now")) / F.col("base") > 0.05) | (F.col("violations") > 0)).alias("failed"))


GATE = "WITH m AS (SELECT avg(quality) FILTER (doc_id % 2 = 0) AS base, avg(quality) FILTER (doc_id % 2 = 1) AS now, sum(toxic) FILTER (doc_id % 2 = 1)::BIGINT AS violations FROM labels) SELECT round(base, 6) AS base, round(now, 6) AS now, violations, (base > 0 AND (base - now) / base > 0.05) OR violations > 0 AS failed FROM m"


def decoys(spark, d):
    b = numbered(table(spark, d, "benchmark").select("item_id"))
    n = b.agg(F.count("*").alias("n"))
    other = b.select(F.col("i").alias("j"), F.col("item_id").alias("decoy"))
    return b.crossJoin(F.broadcast(n)).withColumn("j", ((F.col("i") + F.floor(F.col("n") / 2)) % F.col("n")).cast("int")).join(other, "j").orderBy("item_id").limit(12).select("item_id", "decoy")


def numbered(b, width=1000):
    """Add the dense place ``i`` of each item: its place in its range of ids, after the counts of the ranges before."""
    b = b.withColumn("_range", F.floor(F.col("item_id") / width))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = b.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = b.join(starts, "_range").withColumn("i", F.col("_start") + F.row_number().over(W.partitionBy("_range").orderBy("item_id")) - 1)
    return own.select("item_id", "i")


DECOYS = "WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) SELECT b.item_id, o.item_id AS decoy FROM b JOIN b o ON o.i = (b.i + b.n // 2) % b.n ORDER BY b.item_id LIMIT 12"

PAIRS = {
    "top_corrected": (top_corrected, TOP_CORRECTED), "cost_groups": (cost_groups, COST_GROUPS),
    "health": (health, HEALTH), "latest_retired": (latest_retired, RETIRED), "project_rollup": (project_rollup, ROLLUP), "promotion_candidates": (promotion_candidates, PROMOTION), "facets": (facets, FACETS),
    "feedback_summary": (feedback_summary, FEEDBACK), "top_served": (top_served, TOP_SERVED), "usage_flags": (usage_flags, USAGE), "feedback_counters": (feedback_counters, COUNTERS), "provenance": (provenance, PROVENANCE),
    "cost_summary": (cost_summary, COST), "cloud_share": (cloud_share, CLOUD), "extraction_ab": (extraction_ab, EXTRACTION), "embedding_gaps": (embedding_gaps, GAPS), "provenance_fill": (provenance_fill, FILL),
    "hash_coverage": (hash_coverage, COVERAGE), "exact_dedup": (exact_dedup, DEDUP), "admission_exact": (admission_exact, ADMISSION), "eval_metrics": (eval_metrics, METRICS), "kappa": (kappa, KAPPA), "agreement": (agreement, AGREEMENT),
    "acceptance": (acceptance, ACCEPTANCE), "bootstrap_ci": (bootstrap_ci, None), "split_queries": (split_queries, SPLIT), "fingerprint": (fingerprint, FINGERPRINT), "query_harvest": (query_harvest, HARVEST), "admissible_queries": (admissible_queries, ADMISSIBLE),
    "gate": (gate, GATE), "decoys": (decoys, DECOYS),
}
