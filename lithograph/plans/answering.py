"""Queries on answers, their checks, conversations, runs and keyed tables, registered beside those of stored."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithograph.functions import text as T
from lithograph.operators import answers, extraction, ingest, keyed, review, search
from lithograph.plans import catalogue
from lithograph.plans.stored import query
from lithograph.sources.files import table
from lithograph.sources.shared import new_path

# --- what a run does with each file --------------------------------------------------------------

_LISTED = """
d AS (SELECT doc_id AS id, source || '/' || doc_id AS source_ref, sha256(text) AS sha256, CASE doc_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'duplicate' ELSE 'indexed' END AS status, doc_id % 9 = 0 AS gone FROM documents WHERE doc_id % 3 <> 0),
l AS (SELECT source || '/' || doc_id AS source_ref, sha256(CASE WHEN doc_id % 4 = 0 THEN text || 'x' ELSE text END) AS sha256,
  CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'partial' ELSE 'ok' END AS extract_status, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE doc_id % 5 + 1 END AS n_chunks FROM documents),
a AS (SELECT * FROM d WHERE NOT gone)"""


@query(f"""WITH {_LISTED},
r AS (SELECT l.*, a.id AS previous_id, a.status AS old_status, coalesce(a.sha256 = l.sha256, false) AS same, extract_status IN ('ok', 'partial') AS usable, row_number() OVER (PARTITION BY l.sha256 ORDER BY l.source_ref) AS place,
  l.sha256 IN (SELECT sha256 FROM a e WHERE e.status = 'indexed' AND e.source_ref <> l.source_ref) AS elsewhere FROM l LEFT JOIN a USING (source_ref))
SELECT source_ref, CASE WHEN same AND old_status <> 'failed' THEN 'skipped_unchanged' WHEN NOT usable AND same THEN 'retried' WHEN NOT usable AND previous_id IS NOT NULL THEN 'kept_previous' WHEN NOT usable THEN extract_status
  WHEN elsewhere OR place > 1 THEN 'duplicate' WHEN n_chunks = 0 AND previous_id IS NOT NULL AND NOT same THEN 'kept_previous' WHEN n_chunks = 0 THEN 'failed'
  WHEN previous_id IS NOT NULL AND NOT same THEN 'replaced' WHEN extract_status = 'partial' THEN 'partial' ELSE 'indexed' END AS action, previous_id FROM r""")
def ingest_actions(spark, d):
    """Of all documents two thirds are known, some as failed, as copies or retired; all are listed, a quarter with new contents."""
    docs = table(spark, d, "documents").withColumn("source_ref", F.concat("source", F.lit("/"), "doc_id"))
    status = F.when(F.col("doc_id") % 6 == 0, "failed").when(F.col("doc_id") % 6 == 1, "duplicate").otherwise("indexed")
    gone = F.when(F.col("doc_id") % 9 == 0, F.timestamp_seconds(F.lit(0)))
    known = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "source_ref", F.sha2("text", 256).alias("sha256"), status.alias("status"), gone.alias("deactivated_at"))
    sha = F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)
    tried = F.when(F.col("doc_id") % 10 == 0, "failed").when(F.col("doc_id") % 10 == 1, "unsupported").when(F.col("doc_id") % 10 == 2, "partial").otherwise("ok")
    chunks = F.when(F.col("doc_id") % 8 == 0, 0).otherwise(F.col("doc_id") % 5 + 1)
    listing = docs.select("source_ref", sha.alias("sha256"), tried.alias("extract_status"), chunks.alias("n_chunks"))
    return ingest.actions(listing, known).select("source_ref", "action", "previous_id")


# --- answers -------------------------------------------------------------------------------------

_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _cut(n: int) -> str:
    """SQL of an excerpt of the column c."""
    h = f"left(c, {n})"
    line = f"CASE WHEN strpos(reverse({h}), chr(10)) > 0 THEN length({h}) - strpos(reverse({h}), chr(10)) ELSE -1 END"
    end = f"CASE WHEN strpos(reverse({h}), ' .') > 0 THEN length({h}) - strpos(reverse({h}), ' .') - 1 ELSE -1 END"
    last = f"greatest({line}, {end})"
    return rf"CASE WHEN length(c) <= {n} THEN c ELSE regexp_replace(CASE WHEN {last} > {n / 2} THEN left({h}, {last} + 1) ELSE {h} END, '\s+$', '') || ' …' END"


_NEAREST = f"""
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings JOIN q ON vec_id <> query_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s QUALIFY place <= 6),
x AS (SELECT doc_id, source, {_TRIM} AS c, {catalogue._CODES} AS codes FROM documents),
k AS (SELECT doc_id AS query_id, {catalogue._CODES.replace('all(text,', 'all(left(text, 200),')} AS asked FROM documents),
p AS (SELECT query_id, vec_id, score, source, c, list_has_any(codes, asked) AS shared, row_number() OVER (PARTITION BY query_id ORDER BY place) AS i
  FROM n JOIN x ON doc_id = vec_id JOIN k USING (query_id)),
t AS (SELECT query_id, CASE WHEN max(score) FILTER (WHERE i = 1) >= 0.4 THEN 'first' WHEN bool_or(shared) FILTER (WHERE i <= 5) THEN 'code' ELSE 'none' END AS reason,
  CASE WHEN max(score) FILTER (WHERE i = 1) >= 0.4 THEN 1 ELSE min(i) FILTER (WHERE shared AND i <= 5) END AS top FROM p GROUP BY query_id),
o AS (SELECT p.*, reason, top, row_number() OVER (PARTITION BY query_id ORDER BY i) AS rest FROM p JOIN t USING (query_id) WHERE top IS NULL OR i <> top),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) AS best FROM o WHERE reason <> 'none' AND score >= 0.4),
v AS (SELECT query_id, string_agg(vec_id, ',' ORDER BY best) AS supporting, string_agg(chr(10) || '*' || source || '*' || chr(10) || {_cut(400)}, chr(10) ORDER BY best) AS quoted FROM u WHERE best <= 3 GROUP BY query_id),
w AS (SELECT query_id, string_agg(vec_id, ',' ORDER BY rest) FILTER (WHERE rest <= 4) AS others, string_agg(vec_id, ',' ORDER BY rest) FILTER (WHERE rest <= 3) AS unsure FROM o GROUP BY query_id),
h AS (SELECT query_id, vec_id AS top_id, {_cut(900)} AS head FROM p JOIN t USING (query_id) WHERE i = top)"""


@query(f"""WITH {_NEAREST}
SELECT query_id, CAST(top_id AS BIGINT) AS top_id, reason, CASE WHEN reason = 'none' THEN unsure ELSE top_id || coalesce(',' || others, '') END AS citations, coalesce(supporting, '') AS supporting,
  sha256(CASE WHEN reason = 'none' THEN '{answers.NOTHING_SURE}' ELSE '{answers.FROM_ALL}' || chr(10) || chr(10) || head || CASE WHEN quoted IS NULL THEN '' ELSE chr(10) || chr(10) || '{answers.MORE}' || chr(10) || quoted END END) AS answer_sha256
FROM t LEFT JOIN h USING (query_id) LEFT JOIN v USING (query_id) LEFT JOIN w USING (query_id)""")
def extractive_answer(spark, d):
    """What the nearest documents of every fiftieth vector answer: the beginning of its own document is the question."""
    vectors, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    found = search.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 6)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    asked = docs.select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 200).alias("question"))
    held = docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), F.col("source").alias("filename"))
    passages = found.withColumn("place", place).join(held, "vec_id").join(asked, "query_id")
    passages = passages.select("query_id", "question", "place", F.col("vec_id").alias("chunk_id"), "content", F.lit("text").alias("chunk_type"), F.col("score").alias("vector_score"), "filename")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return answers.decide(passages, 0.4).select("query_id", F.col("top_id").cast("long").alias("top_id"), "reason", joined("citations").alias("citations"), joined("supporting").alias("supporting"), F.sha2("answer", 256).alias("answer_sha256"))


@query(r"""SELECT item_id AS query_id, item_id % 6 IN (0, 3, 5) AS valid,
CASE item_id % 6 WHEN 0 THEN '- ' || trim(left(text, 60)) || chr(10) || chr(10) || '**Steps:**' || chr(10) || '1. ' || trim(substr(text, 61, 40)) WHEN 3 THEN 'Nothing says so.' WHEN 5 THEN '**Steps:**' || chr(10) || '1. ' || trim(left(text, 50)) END AS answer,
CASE item_id % 6 WHEN 0 THEN '2,1' WHEN 5 THEN '2' END AS cited FROM benchmark WHERE length(text) > 110""")
def validate_answers(spark, d):
    """Responses made of every item: two that its text bears out, one with a number that stands nowhere, one that cites what is not there, one without an answer, one broken."""
    items = table(spark, d, "benchmark").filter("length(text) > 110")
    case = F.col("item_id") % 6
    entry = lambda text, *cites: F.struct(text.alias("text"), F.array(*[F.lit(c) for c in cites]).alias("cited_excerpt_numbers"))
    none = F.array().cast("array<struct<text:string,cited_excerpt_numbers:array<int>>>")
    first, second = F.substring("text", 1, 60), F.substring("text", 61, 40)
    claims = F.when(case == 0, F.array(entry(first, 2))).when(case == 1, F.array(entry(F.concat(first, F.lit(" needs 98765 parts")), 2))).when(case == 2, F.array(entry(first, 7))).otherwise(none)
    steps = F.when(case == 0, F.array(entry(second, 1, 2))).when(case == 5, F.array(entry(F.substring("text", 1, 50), 2))).otherwise(none)
    body = F.struct((case == 3).alias("is_no_answer"), F.when(case == 3, F.lit("Nothing says so.")).otherwise(F.lit("")).alias("no_answer_explanation"), claims.alias("claims"), steps.alias("steps"), none.alias("warnings"))
    raw = F.when(case == 4, F.lit('Here it is: {"claims": [')).otherwise(F.concat(F.lit("Sure. "), F.to_json(body)))
    checked = answers.validate(items.select(F.col("item_id").alias("query_id"), raw.alias("raw"), F.array(F.lit("another excerpt"), "text").alias("excerpts")))
    return checked.select("query_id", "valid", "answer", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"))


_TOKENS_OF = catalogue.ORACLES["material_tokens"].rsplit("SELECT doc_id, string_agg", 1)[0]
_PLAIN = r"upper(trim(regexp_replace({}, '\s+', ' ', 'g')))"


@query(rf"""{_TOKENS_OF}, y AS (SELECT a.doc_id, left(a.text, 30) AS said, {_PLAIN.format('b.text')} AS hay FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
z AS (SELECT doc_id, bool_and(contains(hay, token)) AS held FROM y JOIN m USING (doc_id) WHERE token IS NOT NULL GROUP BY doc_id)
SELECT doc_id, coalesce(held, true) AS claim, CASE WHEN {_PLAIN.format('said')} = '' THEN false ELSE contains(hay, {_PLAIN.format('said')}) END AS warning FROM y LEFT JOIN z USING (doc_id)""")
def claim_checks(spark, d):
    """Whether the next document holds all numbers and codes of each document, and its first words verbatim."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cited = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("cited"))
    return docs.join(cited, "doc_id").select("doc_id", T.claim_supported(T.material_tokens(F.col("text")), F.col("cited")).alias("claim"), T.warning_supported(F.substring("text", 1, 30), F.col("cited")).alias("warning"))


# --- conversations and runs ----------------------------------------------------------------------


@query("""WITH c AS (SELECT *, role = 'assistant' AND length(text) % 3 = 0 AS asks FROM conversations),
w AS (SELECT a.conv_id, a.turn, b.turn AS t, b.role || ': ' || left(b.text, 800) AS h, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS back
  FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn AND NOT b.asks WHERE a.role = 'assistant')
SELECT conv_id, turn, CAST(count(h) AS INTEGER) AS n_history, coalesce(string_agg(h, chr(10) ORDER BY t), '') AS history FROM w WHERE back <= 3 GROUP BY conv_id, turn""")
def history_answered(spark, d):
    """The last three turns before each answer, without those that only ask back."""
    asks = (F.col("role") == "assistant") & (F.length("text") % 3 == 0)
    return answers.history(table(spark, d, "conversations").withColumn("is_clarifying", asks), 3)


@query("SELECT user_id AS conv_id, min(ts) AS started_at, max(ts) AS updated_at FROM events GROUP BY user_id ORDER BY updated_at DESC, conv_id LIMIT 20")
def recent_conversations(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"))
    return review.recent_conversations(rows)


@query("""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, min(ts) AS started_at, max(ts) AS finished_at FROM events GROUP BY 1 ORDER BY started_at DESC, run_id DESC LIMIT 10),
c AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT run_id, started_at, finished_at, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts FROM r JOIN c USING (run_id) GROUP BY 1, 2, 3""")
def newest_runs(spark, d):
    """The days of the events stand in for runs: the last ten, with their counts."""
    events = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_type").alias("event"), "ts")
    runs = events.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")).withColumn("status", F.lit("completed"))
    listed = ingest.newest_runs(runs, events)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return listed.select("run_id", "started_at", "finished_at", counts.alias("counts"))


@query("SELECT conv_id AS doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE trim(text) = '') AS empty_pages FROM conversations GROUP BY conv_id")
def page_counts(spark, d):
    """Turns stand in for the pages of a document."""
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return extraction.page_counts(pages)


# --- keyed tables --------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 1000 <> 9
UNION ALL SELECT -1 - o_orderkey, 'X', 0 FROM orders WHERE o_orderkey % 1000 = 7""")
def keyed_changes(spark, d):
    """All orders as a keyed table: a thousandth changes, as many come, as many go, each rewriting its buckets alone."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    root = new_path(spark, "keyed")
    keyed.create_table(orders, root, ["o_orderkey"])
    some = orders.filter("o_orderkey % 1000 = 7")
    new = some.withColumn("o_orderstatus", F.lit("X")).unionByName(some.select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.lit(0).cast(orders.schema["o_totalprice"].dataType).alias("o_totalprice")))
    keyed.merge(new, root, ["o_orderstatus"])
    keyed.remove(orders.filter("o_orderkey % 1000 = 9").select("o_orderkey"), root)
    return keyed.read_table(spark, root)
