"""Relation vocabulary, document chunks, runbook versions, feedback counters, settled captures and recent facts of briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import relations
from tidemark.operators import feedback, retrieve, runbooks
from tidemark.plans.brief_queries import SECTIONS, entities, seats
from tidemark.sources.chunks import MIN_CHARS, MOST, chunk_corpus
from tidemark.sources.views import LOG, log, table
from tidemark.sources.views import vectors as v_fact


def vocabulary_report(spark, d):
    """A10: what becomes of every relation name; names are the first words of documents, in turn as they stand and folded."""
    word = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    docs = table(spark, d, "documents").select(F.when(word == "", "used in").when(F.length(word) == 2, F.lit("Uses")).when(F.length(word) == 3, F.lit("built-with")).otherwise(word).alias("name"))
    return relations.vocabulary_report(docs)


VOCABULARY = """WITH w AS (SELECT regexp_extract(text, '^([A-Za-z]+)', 1) AS w FROM documents), n AS (SELECT CASE WHEN coalesce(w, '') = '' THEN 'used in' WHEN length(w) = 2 THEN 'Uses' WHEN length(w) = 3 THEN 'built-with' ELSE w END AS old, count(*) AS n FROM w GROUP BY 1)
SELECT CASE WHEN old IN ('used in', 'built-with') THEN 'rename' WHEN old = 'Uses' THEN 'canonical' WHEN n = 1 THEN 'one-off' ELSE 'residual' END AS kind, old, CASE old WHEN 'used in' THEN 'UsedIn' WHEN 'built-with' THEN 'Uses' ELSE old END AS new, n FROM n"""


def project_chunks(spark, d):
    """The first statements of each host's pages; block tags part paragraphs, code stands between fences."""
    html = F.col("html")
    for tag in ("script", "style"):
        html = F.regexp_replace(html, f"(?is)<{tag}[ >].*?</{tag}>", "")
    html = F.regexp_replace(F.regexp_replace(html, r"(?i)</?pre[^>]*>", "```"), r"(?i)</?(p|div|br|li|h[1-6]|tr)( [^>]*)?/?>", "\n\n")
    docs = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("project"), F.format_string("%09d", F.col("page_id").cast("long")).alias("name"), F.regexp_replace(html, r"<[^>]*>", "").alias("text"))
    return chunk_corpus(docs, ("&lt;!--", "--&gt;"), []).select("project", "name", "pos", F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_sha256"))


CHUNKS = rf"""WITH s AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?is)<script[ >].*?</script>', '', 'g'), '(?is)<style[ >].*?</style>', '', 'g') AS h FROM pages),
t AS (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS project, printf('%09d', page_id) AS name, regexp_replace(regexp_replace(regexp_replace(h, '(?i)</?pre[^>]*>', '```', 'g'), '(?i)</?(p|div|br|li|h[1-6]|tr)( [^>]*)?/?>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM s),
u AS (SELECT project, name, regexp_replace(regexp_replace(coalesce(text, ''), '(?s)&lt;!--.*?--&gt;', '', 'g'), '(?s)```.*?```', '', 'g') AS text FROM t),
p AS (SELECT project, name, unnest(regexp_split_to_array(text, '\n\s*\n')) AS c, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) - 1 AS pos FROM u),
l AS (SELECT project, name, pos, trim(regexp_replace(trim(regexp_replace(c, '[\s\v\x85\p{{Z}}]+', ' ', 'g'), ' '), '^#+', ''), ' ') AS chunk FROM p)
SELECT project, name, pos::INTEGER AS pos, sha256(chunk) AS chunk_sha256 FROM l WHERE length(chunk) >= {MIN_CHARS} AND left(chunk, 1) NOT IN ('|', '-', '*', '>') QUALIFY row_number() OVER (PARTITION BY project ORDER BY name, pos) <= {MOST}"""


def runbook_versions(spark, d):
    """M9: the first turn of each conversation is what is known of a runbook, the last one restates it; long first turns are prose without steps."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    ends = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"), F.max("turn").alias("turn"))
    name = F.concat(F.lit("runbook "), F.col("conv_id").cast("string"))
    old = ends.filter("turn < 6").select(F.col("conv_id").cast("string").alias("uuid"), name.alias("name"), F.lit("global").alias("scope"), F.when(F.length("first") < 400, F.filter(F.transform(F.split("first", r"\."), runbooks.one_line), lambda s: s != "")).alias("steps"), F.lit(False).alias("archived"))
    given = ends.select(F.concat(F.lit(" "), F.replace(name, F.lit(" "), F.lit("  "))).alias("name"), F.lit("global").alias("scope"), F.split("last", r"\.").alias("steps"), F.lit(None).cast("string").alias("purpose"), F.col("turn").alias("at"))
    told = runbooks.upsert(old, given, F.lit("2024-01-01").cast("date"))
    return told.select("name", "outcome", F.size("steps").alias("steps"), F.size("previous_steps").alias("previous"), "verified_at")


_STEPS = r"list_filter(list_transform(string_split({x}, '.'), lambda s: trim(regexp_replace(s, '[\s\v\x85\p{{Z}}]+', ' ', 'g'), ' ')), lambda s: s <> '')"
VERSIONS = f"""WITH e AS (SELECT conv_id, max(turn) AS turn, arg_min(coalesce(text, ''), turn) AS first, arg_max(coalesce(text, ''), turn) AS last FROM conversations GROUP BY 1),
s AS (SELECT conv_id, turn, turn < 6 AS known, CASE WHEN turn < 6 AND length(first) < 400 THEN {_STEPS.format(x='first')} ELSE [] END AS old, {_STEPS.format(x='last')} AS new FROM e),
o AS (SELECT *, CASE WHEN len(new) = 0 OR len(new) > {runbooks.MOST_STEPS} OR len(list_filter(new, lambda x: length(x) > {runbooks.STEP_CHARS})) > 0 THEN 'rejected' WHEN NOT known THEN 'created' WHEN len(old) = 0 THEN 'adopted' WHEN old <> new THEN 'updated' ELSE 'verified' END AS outcome FROM s)
SELECT 'runbook ' || conv_id AS name, outcome, len(new)::INTEGER AS steps, (CASE WHEN outcome = 'updated' THEN len(old) ELSE 0 END)::INTEGER AS previous, CASE WHEN outcome <> 'rejected' THEN turn END AS verified_at FROM o"""


def fact_counters(spark, d):
    """Views of a fact are impressions, those over the middle value asked to be counted; errors correct it."""
    events = log(spark, d).withColumn("uuid", F.col("k").cast("long"))
    facts = v_fact(spark, d).select("uuid", F.lit(1).alias("recalled_n"))
    told = feedback.apply_feedback(facts, events.filter("tool = 'view'").select("uuid", "at", (F.col("value") > 50).alias("opted_in")), events.filter("tool = 'error'").select("uuid", "at"))
    return told.select("uuid", "recalled_n", "corrected_n", F.date_format("last_recalled_at", "yyyy-MM-dd HH:mm:ss").alias("last_recalled_at"))


FACT_COUNTERS = f"WITH {LOG}, v AS (SELECT k, count(*) AS n, max(seen) AS at FROM v_log WHERE tool = 'view' AND value > 50 GROUP BY 1), c AS (SELECT k, count(*) AS n FROM v_log WHERE tool = 'error' GROUP BY 1) SELECT vec_id AS uuid, 1 + coalesce(v.n, 0) AS recalled_n, coalesce(c.n, 0) AS corrected_n, strftime(v.at, '%Y-%m-%d %H:%M:%S') AS last_recalled_at FROM embeddings LEFT JOIN v ON v.k = vec_id LEFT JOIN c ON c.k = vec_id"


def settled_captures(spark, d):
    """Documents that wait; a label of good quality approves, any other label dismisses; the unlabelled ones' hashes are known already."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uuid"), F.concat(F.lit("project_"), "source").alias("group_id"), "text", F.md5(F.col("text").cast("binary")).alias("hash"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    decisions = labels.select(F.col("doc_id").alias("uuid"), F.when(F.col("q") == 1, "approve").otherwise("dismiss").alias("action"))
    statuses, facts = feedback.settle_pending(docs, decisions, docs.join(decisions, "uuid", "left_anti").select("group_id", "hash"))
    return statuses.groupBy(F.col("status").alias("what")).agg(F.count("*").alias("n"), F.lit("").alias("least")).unionAll(facts.groupBy("group_id").agg(F.count("*").alias("n"), F.min("uuid").alias("least")))


CAPTURES = """WITH p AS (SELECT doc_id AS uuid, 'project_' || source AS g, md5(text) AS h, q FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)),
f AS (SELECT g, h, min(uuid) AS uuid FROM p WHERE q = 1 AND (g, h) NOT IN (SELECT g, h FROM p WHERE q IS NULL AND g IS NOT NULL AND h IS NOT NULL) GROUP BY 1, 2)
SELECT CASE WHEN q = 1 THEN 'approved' ELSE 'dismissed' END AS what, count(*) AS n, '' AS least FROM p WHERE q IS NOT NULL GROUP BY 1 UNION ALL SELECT g, count(*), min(sha256('capture|' || uuid)) FROM f GROUP BY 1"""


def brief_recent(spark, d):
    """The recent facts of all seats' briefs; documents are facts of their source's seat, every tenth source's are global."""
    docs = table(spark, d, "documents")
    n = F.regexp_extract("source", "([0-9]+)", 1)
    scope = F.when(n.endswith("0"), "global").otherwise(F.concat(F.lit("project_"), n))
    return retrieve.recent(seats(spark, d), entities(spark, d), docs.select(F.col("doc_id").alias("uuid"), scope.alias("scope"), F.col("doc_id").alias("created_at"), F.col("text").alias("fact")), SECTIONS)


PAIRS = {
    "vocabulary_report": (vocabulary_report, VOCABULARY), "project_chunks": (project_chunks, CHUNKS), "runbook_versions": (runbook_versions, VERSIONS), "fact_counters": (fact_counters, FACT_COUNTERS), "settled_captures": (settled_captures, CAPTURES), "brief_recent": (brief_recent, None),
}
