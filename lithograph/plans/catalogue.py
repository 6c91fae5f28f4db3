"""Named queries over the driver tables, each with its DuckDB counterpart.

documents stand in for chunks and their documents, embeddings for their vectors (vec_id = doc_id, label = scope),
labels.quality = 1 for the review gate, conversations for messages, pages for raw files, benchmark for known texts,
and nation, supplier, lineitem and orders for makers, models, links and documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.functions import text as T
from lithograph.operators import answers, chunking, dedup, embedding, extraction, index, ingest, metadata, reports, review, search
from lithograph.sources.files import state, table
from lithograph.sources.shared import new_path, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TERMS = ["the", "hessan", "of"]
QUESTION = "how to replace the part with error code 233"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents for costly work in the row."""
    return spread(table(spark, d, "documents"))


# --- scans, hashes, types ------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY lang")
def doc_char_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query("""SELECT page_id, CASE WHEN upper(left(html, 9)) = '<!DOCTYPE' THEN 'html' WHEN left(html, 5) = '%PDF-' THEN 'pdf' ELSE 'unknown' END AS kind FROM pages""")
def sniff_type(spark, d):
    kind = F.when(F.upper(F.substring("html", 1, 9)) == "<!DOCTYPE", "html").otherwise(F.coalesce(metadata.sniffed_type(F.col("html").cast("binary")), F.lit("unknown")))
    return table(spark, d, "pages").select("page_id", kind.alias("kind"))


@query(r"""SELECT page_id, regexp_extract(lower(url), '(\.[^./?#]+)(?:[?#].*)?$', 1) AS extension FROM pages""")
def url_extension(spark, d):
    return table(spark, d, "pages").select("page_id", metadata.extension(F.col("url")).alias("extension"))


@query(r"""
WITH f AS (SELECT page_id, regexp_extract_all(html, '(?is)(<h[1-6][^>]*>.*?</h[1-6]>)', 1) AS tags FROM pages),
u AS (SELECT page_id, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM f)
SELECT page_id, CAST(pos AS INTEGER) AS pos, CAST(substr(tag, 3, 1) AS INTEGER) - 1 AS rank,
       trim(regexp_replace(tag, '<[^>]*>', '', 'g')) AS heading FROM u""")
def page_headings(spark, d):
    return metadata.headings(table(spark, d, "pages"))


# --- duplicates ----------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_SHINGLES = f"""
n AS (SELECT doc_id, {_NORM} AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM n),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""
_PAIRS = f"""
{_SHINGLES},
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b, shared, x.n AS na, y.n AS nb FROM o JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b)"""


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS s FROM documents), k AS (SELECT s, min(doc_id) AS kept_id FROM h GROUP BY s)
SELECT kept_id, doc_id AS dup_id, CAST(1.0 AS DOUBLE) AS similarity FROM h JOIN k USING (s) WHERE doc_id > kept_id""")
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(table(spark, d, "documents"))


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS s, source FROM documents), k AS (SELECT s, min(doc_id) AS kept_id FROM h GROUP BY s)
SELECT kept_id, a.source AS kept_source, h.doc_id AS dup_id, h.source AS dup_source FROM h JOIN k USING (s) JOIN documents a ON a.doc_id = kept_id WHERE h.doc_id > kept_id""")
def dup_pairs_named(spark, d):
    docs = table(spark, d, "documents")
    pairs = dedup.exact_duplicates(docs)
    kept = docs.select(F.col("doc_id").alias("kept_id"), F.col("source").alias("kept_source"))
    dup = docs.select(F.col("doc_id").alias("dup_id"), F.col("source").alias("dup_source"))
    return pairs.join(kept, "kept_id").join(dup, "dup_id").select("kept_id", "kept_source", "dup_id", "dup_source")


@query(f"SELECT doc_id, {_NORM} AS normalized FROM documents")
def normalize_text(spark, d):
    return _texts(spark, d).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


_CLASSES = f"""{_SHINGLES},
own AS (SELECT doc_id, list_sort(list(shingle)) AS own FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY own) AS class_id FROM own)"""
_FIRST_PAIRS = f"""{_CLASSES},
s1 AS (SELECT s.* FROM s JOIN k USING (doc_id) WHERE doc_id = class_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s1 a JOIN s1 b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b, shared, x.n AS na, y.n AS nb FROM o JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b)"""


@query(f"WITH {_SHINGLES} SELECT doc_id, n AS shingles FROM c")
def shingle_counts(spark, d):
    return dedup.shingle_sets(_texts(spark, d)).select("doc_id", F.col("n").cast("long").alias("shingles"))


@query(f"WITH {_CLASSES} SELECT doc_id, class_id FROM k")
def shingle_classes(spark, d):
    return dedup.shingle_classes(_texts(spark, d))


@query(f"WITH {_FIRST_PAIRS} SELECT a, b, round(shared / least(na, nb), 6) AS containment FROM p WHERE shared >= 0.55 * least(na, nb)")
def containment_pairs(spark, d):
    return dedup.containment_pairs(_texts(spark, d))


@query(f"WITH {_FIRST_PAIRS} SELECT a, b, round(shared / (na + nb - shared), 6) AS jaccard FROM p WHERE shared / (na + nb - shared) >= 0.55")
def jaccard_pairs(spark, d):
    return dedup.jaccard_pairs(_texts(spark, d))


@query(f"""WITH {_PAIRS}, q AS (SELECT a, b, round(shared / least(na, nb), 6) AS containment FROM p WHERE shared >= 0.55 * least(na, nb)),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY containment DESC, a) AS place FROM q)
SELECT b AS dup_id, a AS kept_id, containment FROM r WHERE place = 1""")
def near_duplicates(spark, d):
    return dedup.near_duplicates(_texts(spark, d))


_TOP3 = f"""{_SHINGLES},
i AS (SELECT item_id, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS w FROM benchmark),
j AS (SELECT item_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM i),
m AS (SELECT item_id, count(*) AS n FROM j GROUP BY 1),
o AS (SELECT item_id, doc_id, count(*) AS shared FROM j JOIN s USING (shingle) GROUP BY 1, 2),
p AS (SELECT item_id, doc_id, round(shared / least(m.n, c.n), 6) AS containment FROM o JOIN m USING (item_id) JOIN c USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY containment DESC, doc_id) AS place FROM p)"""


@query(f"WITH {_TOP3} SELECT item_id, doc_id, containment, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3")
def near_dup_top3(spark, d):
    return dedup.best_matches(table(spark, d, "benchmark").select("item_id", "text"), _texts(spark, d))


@query(f"WITH {_TOP3} SELECT item_id, doc_id, containment FROM r WHERE place <= 3 ORDER BY containment DESC, item_id, doc_id LIMIT 10")
def calibration_top10(spark, d):
    return dedup.calibration(table(spark, d, "benchmark").select("item_id", "text"), _texts(spark, d))


# --- search --------------------------------------------------------------------------------------

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _bm25_sql(name: str, eligible: str = "") -> str:
    return f"""
{name}_t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
{name}_f AS (SELECT doc_id, len(t) AS dl, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM {name}_t, (VALUES {", ".join(f"('{t}')" for t in TERMS)}) q(term)),
{name}_n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_t),
{name}_d AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM {name}_f GROUP BY term),
{name}_s AS (SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_f JOIN {name}_d USING (term), {name}_n WHERE tf > 0 GROUP BY doc_id),
{name} AS (SELECT doc_id, score FROM {name}_s {eligible} ORDER BY score DESC, doc_id LIMIT 50)"""


_VECTOR = """
{name}_q AS (SELECT embedding::DOUBLE[] AS q, label AS l FROM embeddings WHERE vec_id = 0),
{name} AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, {name}_q {where} ORDER BY score DESC, vec_id LIMIT 50)"""
_APPROVED = "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


_INDEXES: dict[tuple, index.Index] = {}


def _index(spark, d, stemmed: bool = False) -> index.Index:
    """The stored index of the documents as they are: built by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, state(spark, f"{d}/documents.parquet"), stemmed)
    if key not in _INDEXES:
        _INDEXES[key] = index.build_index(_texts(spark, d).select("doc_id", "text"), new_path(spark, "index"), stemmed)
    return _INDEXES[key]


def _approved(spark, d):
    return table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()


def _query_vector(spark, d) -> tuple[list[float], int]:
    row = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding", "label").first()  # one vector
    return list(row["embedding"]), row["label"]


@query(f"WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '[\"''()*:^-]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS term FROM benchmark) SELECT item_id, term, count(*) AS n FROM t GROUP BY 1, 2")
def query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.query_terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def postings(spark, d):
    return index.term_statistics(_index(spark, d))


@query(f"WITH {_bm25_sql('x')} SELECT * FROM x")
def bm25_topk(spark, d):
    return index.search(_index(spark, d), " ".join(TERMS))


@query(f"WITH {_bm25_sql('x')} SELECT * FROM x")
def bm25_scan(spark, d):
    """The same without an index, for texts that are searched once."""
    return search.bm25(_texts(spark, d), TERMS)


_PHRASE_SQL = f"""
t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
f AS (SELECT doc_id, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS f0, len(list_filter(t, lambda x: x = 'thing')) AS f1 FROM t),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM f),
w AS (SELECT doc_id, f0, f1, 1.2 * (1 - 0.75 + 0.75 * dl / avgdl) AS k, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) AS i0, greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) AS i1 FROM f, n WHERE f0 + f1 > 0)"""


@query(f"WITH {_PHRASE_SQL} SELECT doc_id, round(2 * i0 * (f0 * 2.2) / (f0 + k) + i1 * (f1 * 2.2) / (f1 + k), 6) AS score FROM w ORDER BY score DESC, doc_id LIMIT 50")
def phrase_topk(spark, d):
    """A term with a mark inside is a phrase; one that is said twice counts twice, and one without letters not at all."""
    return index.search(_index(spark, d), "of/the thing / of/the")


@query()
def stemmed_topk(spark, d):
    return index.search(_index(spark, d, stemmed=True), "Things doing")


@query(f"WITH {_bm25_sql('x', _APPROVED)} SELECT * FROM x")
def bm25_scoped(spark, d):
    return index.search(_index(spark, d), " ".join(TERMS), _approved(spark, d))


@query(f"WITH {_VECTOR.format(name='x', where='')} SELECT * FROM x")
def vector_topk(spark, d):
    return search.vector_search(table(spark, d, "embeddings"), _query_vector(spark, d)[0])


@query(f"WITH {_VECTOR.format(name='x', where='WHERE label = l')} SELECT * FROM x")
def vector_topk_scoped(spark, d):
    vector, label = _query_vector(spark, d)
    return search.vector_search(table(spark, d, "embeddings").filter(F.col("label") == label), vector)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_embeddings(spark, d):
    docs = table(spark, d, "documents")
    return docs.join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings JOIN q ON vec_id <> query_id)
SELECT query_id, max(score) AS best, max(score) >= 0.4 AS relevant FROM p GROUP BY query_id""")
def vector_gate(spark, d):
    vectors = table(spark, d, "embeddings")
    return search.vector_gate(vectors, vectors.filter("vec_id % 50 = 0"), 0.4)


_FUSED = f"""{_bm25_sql('x')}, {_VECTOR.format(name='y', where='')},
u AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM x
      UNION ALL SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) FROM y),
f AS (SELECT doc_id, CAST(sum(part) AS DOUBLE) AS fused FROM u GROUP BY doc_id)"""
_KIND = "CASE doc_id % 5 WHEN 0 THEN 'error_code' WHEN 1 THEN 'table' WHEN 2 THEN 'procedure' WHEN 3 THEN 'warning' ELSE 'text' END"
_BOOST = f"(CASE WHEN doc_id % 7 = 0 THEN -0.20 ELSE 0.0 END + CASE {_KIND} WHEN 'error_code' THEN 0.35 WHEN 'table' THEN 0.25 WHEN 'procedure' THEN 0.25 ELSE 0.0 END)"


def _fused(spark, d):
    lexical = index.search(_index(spark, d), " ".join(TERMS))
    vector = search.vector_search(table(spark, d, "embeddings"), _query_vector(spark, d)[0]).withColumnRenamed("vec_id", "doc_id")
    return lexical, vector


def _chunks(spark, d):
    kind = F.expr(_KIND)
    return table(spark, d, "documents").select("doc_id", "text", "source", kind.alias("chunk_type"), F.lit("unknown").alias("doc_type"), (F.col("doc_id") % 7 != 0).alias("is_current"))


@query(f"WITH {_FUSED} SELECT doc_id, round(fused, 6) AS fused FROM f")
def rrf_fusion(spark, d):
    return search.reciprocal_rank_fusion(*_fused(spark, d)).select("doc_id", F.round("fused", 6).alias("fused"))


@query(f"WITH {_FUSED} SELECT doc_id, round(fused, 6) AS fused, lang, source, quality FROM f JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)")
def hydrate(spark, d):
    fused = search.reciprocal_rank_fusion(*_fused(spark, d)).select("doc_id", F.round("fused", 6).alias("fused"))
    docs = table(spark, d, "documents").join(F.broadcast(fused), "doc_id")  # at most two lists of 50
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "fused", "lang", "source", "quality")


@query(f"SELECT doc_id, round(CAST({_BOOST} AS DOUBLE), 6) AS boost FROM documents")
def rerank_boost(spark, d):
    boost = search.rerank_boost(QUESTION, F.col("chunk_type"), F.col("doc_type"), F.col("is_current"))
    return _chunks(spark, d).select("doc_id", F.round(boost, 6).alias("boost"))


@query(f"""WITH {_FUSED} SELECT doc_id, source, {_KIND} AS chunk_type, round(fused, 6) AS fused, round(fused + {_BOOST}, 6) AS combined
FROM f JOIN documents USING (doc_id) WHERE length(trim(text)) >= 4 ORDER BY combined DESC, doc_id LIMIT 6""")
def hybrid_topk(spark, d):
    found = search.hybrid_search(*_fused(spark, d), _chunks(spark, d), QUESTION)
    return found.select("doc_id", "source", "chunk_type", "fused", "combined")


# Documents of the search scope: reviewed by labels, tied to the machine that is the label of their vector.
_SCOPE = """e AS (SELECT doc_id FROM documents JOIN embeddings ON vec_id = doc_id WHERE label = 3 AND vec_id % 11 <> 0 {current}
  AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""


def _scoped_sql(current: str) -> str:
    scope = _SCOPE.format(current=current)
    fused = _FUSED.replace("x AS (SELECT doc_id, score FROM x_s ", "x AS (SELECT doc_id, score FROM x_s WHERE doc_id IN (SELECT doc_id FROM e) ").replace("FROM embeddings, y_q ", "FROM embeddings, y_q WHERE vec_id IN (SELECT doc_id FROM e) ")
    return f"""WITH {scope}, {fused} SELECT doc_id, {_KIND} AS chunk_type, round(fused, 6) AS fused, round(fused + {_BOOST}, 6) AS combined
FROM f JOIN documents USING (doc_id) WHERE length(trim(text)) >= 4 ORDER BY combined DESC, doc_id LIMIT 6"""


def _scoped(spark, d, include_superseded: bool):
    reviewed = table(spark, d, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, "approved")).alias("review_status"))
    docs = table(spark, d, "documents").select("doc_id").join(reviewed, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.lit("indexed").alias("status"), F.lit(None).cast("timestamp").alias("deactivated_at"),
        F.coalesce("review_status", F.lit("pending")).alias("review_status"), (F.col("doc_id") % 7 != 0).alias("is_current_revision"),
    )
    links = table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("label").alias("machine_id"), F.when(F.col("vec_id") % 11 != 0, "approved").otherwise("rejected").alias("review_status"))
    allowed = ingest.eligible(docs, links, 3, include_superseded).select(F.col("id").alias("doc_id"))
    lexical = index.search(_index(spark, d), " ".join(TERMS), allowed)
    vector = search.scoped_vectors(table(spark, d, "embeddings"), allowed, _query_vector(spark, d)[0])
    return search.hybrid_search(lexical, vector, _chunks(spark, d), QUESTION).select("doc_id", "chunk_type", "fused", "combined")


@query(_scoped_sql("AND doc_id % 7 <> 0"))
def hybrid_scoped(spark, d):
    """Only approved, current documents of one machine."""
    return _scoped(spark, d, False)


@query(_scoped_sql(""))
def hybrid_superseded(spark, d):
    """The same with superseded revisions, which rank lower."""
    return _scoped(spark, d, True)


@query()
def embed_documents(spark, d):
    return embedding.embed(_texts(spark, d), "doc_id")


# --- chunks --------------------------------------------------------------------------------------

_LINES = r"""l0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM l0)"""


@query(rf"""WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(line, '(?i)^(WARNING|CAUTION|DANGER|NOTICE|IMPORTANT|LOCKOUT[/ ]TAGOUT)\b') THEN 'warning'
WHEN regexp_matches(line, '^\d{{1,2}}[\.\)]\s+\S') THEN 'procedure' ELSE 'text' END AS kind FROM l""")
def line_classify(spark, d):
    return chunking.lines(_texts(spark, d)).select("doc_id", "pos", chunking.line_type(F.col("line")).alias("kind"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b[A-Z]{{1,3}}-?\d{{1,3}}\b')) AS INTEGER) AS codes FROM documents")
def code_token_count(spark, d):
    return _texts(spark, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(rf"({T.ERROR_CODE_TOKEN})"), 1)).alias("codes"))


@query(rf"""WITH RECURSIVE {_LINES},
n AS (SELECT doc_id, pos, line, length(line) AS len FROM l),
r AS (SELECT doc_id, pos, len AS held, 0 AS chunk FROM n WHERE pos = 0
  UNION ALL SELECT n.doc_id, n.pos, CASE WHEN r.held > 1200 THEN n.len ELSE r.held + n.len END, CASE WHEN r.held > 1200 THEN r.chunk + 1 ELSE r.chunk END
  FROM r JOIN n ON n.doc_id = r.doc_id AND n.pos = r.pos + 1),
c AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY pos) AS content FROM r JOIN n USING (doc_id, pos) GROUP BY 1, 2),
g AS (SELECT doc_id, chunk, content, sum(CASE WHEN chunk = 0 OR length(content) >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk) AS grp FROM c),
m AS (SELECT doc_id, grp, string_agg(content, chr(10) ORDER BY chunk) AS content FROM g GROUP BY 1, 2)
SELECT doc_id, CAST(grp - 1 AS INTEGER) AS ordinal, CAST(length(content) AS INTEGER) AS char_count, sha256(content) AS content_hash FROM m""")
def chunk_documents(spark, d):
    chunks = chunking.chunk_documents(chunking.plain_pages(_texts(spark, d)))
    return chunks.select("doc_id", "ordinal", "char_count", F.sha2("content", 256).alias("content_hash"))


@query(rf"""WITH {_LINES},
g AS (SELECT doc_id, pos, line, sum(CASE WHEN pos = 0 OR length(line) >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM l)
SELECT doc_id, CAST(grp AS BIGINT) AS "group", 'text' AS type, string_agg(line, chr(10) ORDER BY pos) AS content FROM g GROUP BY doc_id, grp""")
def merge_small_chunks(spark, d):
    rows = chunking.lines(_texts(spark, d))
    return chunking.merge_small(rows.select("doc_id", "pos", chunking.line_type(F.col("line")).alias("type"), F.col("line").alias("content")))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id")
def reassemble_text(spark, d):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 256).alias("sha256"))


# --- answers -------------------------------------------------------------------------------------

_CODES = r"list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9-]+'), lambda w: length(w) >= 2 AND regexp_matches(w, '\d') AND regexp_matches(w, '^[A-Za-z]{0,4}-?\d[\dA-Za-z-]*$')), lambda w: upper(w)))"


@query(f"SELECT doc_id, array_to_string(list_sort({_CODES}), ' ') AS codes FROM documents")
def code_tokens(spark, d):
    return _texts(spark, d).select("doc_id", F.array_join(F.array_sort(T.code_tokens(F.col("text"))), " ").alias("codes"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents WHERE list_contains({_CODES}, '233')")
def code_rescue(spark, d):
    rows = _texts(spark, d).filter(F.arrays_overlap(T.code_tokens(F.lit(QUESTION)), T.code_tokens(F.col("text"))))
    return rows.agg(F.min("doc_id").alias("doc_id"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS c FROM documents), h AS (SELECT *, left(c, 500) AS h FROM t),
b AS (SELECT *, CASE WHEN strpos(reverse(h), chr(10)) > 0 THEN length(h) - strpos(reverse(h), chr(10)) ELSE -1 END AS x, CASE WHEN strpos(reverse(h), ' .') > 0 THEN length(h) - strpos(reverse(h), ' .') - 1 ELSE -1 END AS y FROM h)
SELECT doc_id, CASE WHEN length(c) <= 500 THEN c ELSE regexp_replace(CASE WHEN greatest(x, y) > 250 THEN left(h, greatest(x, y) + 1) ELSE h END, '\s+$', '') || ' …' END AS excerpt FROM b""")
def excerpts(spark, d):
    return _texts(spark, d).select("doc_id", T.excerpt(F.col("text"), 500).alias("excerpt"))


@query(r"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9./-]*'), lambda x: regexp_replace(x, '^[./-]+|[./-]+$', '', 'g')) AS ws FROM documents WHERE regexp_matches(text, '\d')),
u AS (SELECT doc_id, unnest(ws) AS c FROM w),
m AS (SELECT DISTINCT doc_id, CASE WHEN c = '' OR NOT regexp_matches(c, '\d') THEN NULL WHEN regexp_matches(c, '^(\d+(?:\.\d+)?)[A-Za-z°%]{1,4}$') THEN regexp_extract(c, '^(\d+(?:\.\d+)?)[A-Za-z°%]{1,4}$', 1)
  WHEN regexp_matches(c, '^[A-Za-z]{0,4}-?\d[\dA-Za-z-]*$') AND regexp_matches(c, '[A-Za-z]') THEN upper(c) WHEN length(regexp_replace(c, '[^\d]', '', 'g')) >= 2 THEN upper(c) END AS token FROM u)
SELECT doc_id, string_agg(token, ' ' ORDER BY token) AS tokens FROM m WHERE token IS NOT NULL GROUP BY doc_id""")
def material_tokens(spark, d):
    rows = _texts(spark, d).filter(F.col("text").rlike(r"\d")).select("doc_id", T.material_tokens(F.col("text")).alias("m"))
    return rows.filter(F.size("m") > 0).select("doc_id", F.array_join(F.array_sort("m"), " ").alias("tokens"))


@query(r"""
WITH n AS (SELECT doc_id, upper(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents), b AS (SELECT item_id, upper(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS i FROM benchmark)
SELECT item_id, doc_id FROM n JOIN b ON contains(t, i)""")
def claim_support(spark, d):
    return answers.supporting_documents(table(spark, d, "benchmark"), _texts(spark, d), empty=True)


@query("SELECT source, bool_or(quality = 0) AND count(DISTINCT doc_id) >= 2 AS conflict FROM documents JOIN labels USING (doc_id) GROUP BY source")
def revision_conflict(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    passages = rows.select(F.col("source").alias("query_id"), F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("is_current"))
    return answers.revision_conflict(passages).withColumnRenamed("query_id", "source")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, string_agg('[' || i || '] ' || role || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS context FROM n GROUP BY conv_id""")
def context_block(spark, d):
    return answers.context_blocks(table(spark, d, "conversations"))


@query("""WITH w AS (SELECT a.conv_id, a.turn, b.turn AS t, b.role || ': ' || left(b.text, 800) AS h, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS back
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'assistant')
SELECT conv_id, turn, CAST(count(h) AS INTEGER) AS n_history, coalesce(string_agg(h, chr(10) ORDER BY t), '') AS history FROM w WHERE back <= 8 GROUP BY conv_id, turn""")
def history_window(spark, d):
    return answers.history(table(spark, d, "conversations"))


# --- relational reports --------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_approved(spark, d):
    return table(spark, d, "documents").join(_approved(spark, d), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unlabeled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT n_name, s_name, s_suppkey, count(DISTINCT o_orderkey) AS linked FROM supplier JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'
GROUP BY ALL HAVING linked >= 1 ORDER BY n_name, s_name, s_suppkey LIMIT 25""")
def machine_picker(spark, d):
    suppliers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("s_suppkey", "l_suppkey")
    found = reports.linked_counts(suppliers, table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", F.col("l_returnflag") == "R", table(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "F")
    return found.select("n_name", "s_name", F.col("l_suppkey").alias("s_suppkey"), "linked").orderBy("n_name", "s_name", "s_suppkey").limit(25)


@query("""SELECT 'on' AS place, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
UNION ALL SELECT 'where', count(*) FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def left_join_on_filter(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    key = F.col("o_custkey") == F.col("c_custkey")
    on = customers.join(orders.filter("o_orderstatus = 'F'"), key, "left").agg(F.lit("on").alias("place"), F.count(F.lit(1)).alias("n"))
    where = customers.join(orders, key, "left").filter("o_orderstatus = 'F'").agg(F.lit("where").alias("place"), F.count(F.lit(1)).alias("n"))
    return on.union(where)


@query("""SELECT a.conv_id, a.turn, (SELECT text FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'user' AND b.turn < a.turn ORDER BY b.turn DESC LIMIT 1) AS question
FROM conversations a WHERE a.role = 'assistant'""")
def previous_user_turn(spark, d):
    return reports.previous_user_turn(table(spark, d, "conversations"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, d):
    return reports.status_counts(table(spark, d, "events"), "event_type")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_docs(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("""WITH f AS (SELECT user_id, event_type, min(struct_pack(ts := ts, event_id := event_id)) AS first FROM events GROUP BY 1, 2)
SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INTEGER) AS place FROM f""")
def ordered_distinct(spark, d):
    return reports.ordered_distinct(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("""WITH c AS (SELECT conv_id, turn AS rank, CASE WHEN turn % 3 = 0 THEN NULL ELSE 10 - turn END AS ordinal FROM conversations)
SELECT conv_id, rank, ordinal, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(ordinal, rank), rank) AS INTEGER) AS place FROM c""")
def citation_order(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("rank"), F.when(F.col("turn") % 3 != 0, 10 - F.col("turn")).alias("ordinal"))
    return reports.citation_order(rows, "conv_id")


@query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def rate_limit_breaches(spark, d):
    found = reports.rate_breaches(table(spark, d, "events"), 3, "1 hour")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_EVAL = """n AS (SELECT doc_id, source, upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents),
b AS (SELECT item_id, upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS i FROM benchmark),
h AS (SELECT item_id, bool_or(contains(source, '1')) AS one, bool_or(contains(source, '2')) AS two FROM b LEFT JOIN n ON contains(t, i) GROUP BY item_id),
r AS (SELECT item_id AS id, item_id % 5 = 4 AS silent, CASE WHEN item_id % 5 <> 4 THEN coalesce(one, false) END AS hit, CASE WHEN item_id % 5 <> 4 THEN NOT coalesce(two, false) END AS isolated, one IS NULL AS none FROM h),
o AS (SELECT *, CASE WHEN silent THEN none ELSE NOT none AND hit AND isolated END AS ok FROM r)"""


def _cases(spark, d):
    """Items as questions, answered by the documents that hold them, if any; every fifth expects that there is none."""
    texts = F.array().cast("array<string>")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("1").alias("expected_filename_contains"), texts.alias("expected_keywords"), F.array(F.lit("2")).alias("must_not_come_from"), (F.col("item_id") % 5 == 4).alias("expect_no_answer"))
    held = claim_support(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    names = held.groupBy(F.col("item_id").alias("id")).agg(F.collect_set("source").alias("filenames"))  # at most the sources
    found = items.select("id").join(names, "id", "left").select("id", F.coalesce("filenames", texts).alias("filenames"), F.lit("").alias("content"), F.col("filenames").isNull().alias("is_no_answer"))
    return items, found.filter("NOT is_no_answer OR id % 5 = 4")


@query(f"WITH {_EVAL} SELECT id, hit, isolated, ok FROM o")
def eval_cases(spark, d):
    return reports.case_results(*_cases(spark, d)).select("id", "hit", "isolated", "ok")


@query(f"""WITH {_EVAL} SELECT count(*) AS cases, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS passed, sum(CAST(hit AS INTEGER)) / count(hit) AS hit_rate,
sum(CAST(isolated AS INTEGER)) / count(isolated) AS isolation_rate, sum(CAST(ok AND silent AS INTEGER)) / sum(CAST(silent AS INTEGER)) AS no_answer_rate FROM o""")
def eval_summary(spark, d):
    return reports.evaluate(*_cases(spark, d)).select("cases", "passed", "hit_rate", "isolation_rate", "no_answer_rate")


@query("""WITH p AS (SELECT p_partkey, p_name, list_filter(string_split(p_name, ' '), lambda x: length(x) >= 2) AS parts FROM part)
SELECT DISTINCT p_partkey, unnest(list_append(parts, p_name)) AS variant FROM p""")
def name_variants(spark, d):
    return reports.name_variants(table(spark, d, "part"), "p_partkey", "p_name", " ")


@query(r"""SELECT doc_id, name FROM documents, (VALUES ('token'), ('license'), ('version')) n(name) WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || name || '($|[^\p{L}\p{N}_])')""")
def mention_exact(spark, d):
    return reports.mentions(table(spark, d, "documents"), ["token", "license", "version"])


@query("""SELECT doc_id, coalesce(source || ' | ', '') || 'note' AS reason FROM documents""")
def append_note(spark, d):
    return table(spark, d, "documents").select("doc_id", ingest.append_note(F.col("source"), F.lit("note")).alias("reason"))


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events)
SELECT user_id, event_type, event_id, value FROM e WHERE place = 1""")
def latest_wins(spark, d):
    return ingest.latest(table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


# --- a library of documents, machines and conversations, made of the driver tables -----------------

#: name: (table, keys or columns, aggregates), in SQL that both engines read.
LIBRARY = {
    "docs": ("customer", [
        "c_custkey AS id", "c_name AS original_filename", "c_mktsegment AS doc_type", "c_mktsegment AS title", "CAST(c_nationkey AS BIGINT) AS manufacturer_id",
        "CASE c_custkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'indexed' END AS status", "CASE c_custkey % 3 WHEN 0 THEN 'pending' ELSE 'approved' END AS review_status",
        "CASE WHEN c_acctbal < 0 THEN 1 END AS deactivated_at", "c_custkey % 7 <> 0 AS is_current_revision", "c_custkey % 100 AS created_at", "c_custkey % 90 AS ingested_at",
    ], None),
    "makers": ("nation", ["CAST(n_nationkey AS BIGINT) AS id", "n_name AS name"], None),
    "machines": ("supplier", ["s_suppkey AS id", "CAST(s_nationkey AS BIGINT) AS manufacturer_id", "s_name AS model_name", "CASE s_suppkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS family"], None),
    "links": ("orders", ["o_custkey AS document_id", "o_orderkey % 10 AS machine_id"], [
        "CASE WHEN count(*) > 1 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS confidence",
        "CASE min(o_orderstatus) WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS review_status",
    ]),
    "messages": ("conversations", ["conv_id * 1000 + turn AS id", "conv_id AS conversation_id", "role", "text AS content", "(conv_id + turn) % 4 = 0 AS is_no_answer", "(conv_id * 7 + turn) % 100 AS created_at"], None),
    "talks": ("conversations", ["conv_id AS id", "conv_id % 3 AS user_id"], []),
    "users": ("customer", ["c_custkey AS id", "c_name AS email"], None),
    "feedback": ("events", ["event_id AS id", "user_id", "(event_id % 40) * 1000 + 1 AS message_id", "event_type AS rating", "event_id % 70 AS created_at"], None),
    "recent": ("events", ["user_id", "event_id % 10 AS machine_id"], ["max(event_id) AS last_used_at", "max(event_id) % 3 = 0 AS is_favorite"]),
    "saved": ("events", ["user_id", "(event_id % 40) * 1000 + 1 AS message_id"], ["max(event_id) AS saved_at"]),
    "chunks": ("documents", ["doc_id AS id", "doc_id % 100 AS document_id", "source AS content"], None),
    "sources": ("conversations", ["conv_id AS message_id", "(conv_id * 7 + turn) % 150 AS chunk_id", "turn AS rank", "turn % 2 = 0 AS is_citation", "CASE WHEN turn % 3 <> 0 THEN 10 - turn END AS citation_ordinal"], None),
    "matches": ("orders", ["o_orderkey AS id", "o_custkey AS kept_document_id", "o_custkey % 50 AS duplicate_document_id", "o_orderpriority AS match_type", "o_orderkey AS detected_at"], None),
    "corrections": ("customer", ["c_custkey AS id", "CASE c_custkey % 2 WHEN 0 THEN 'fixed' END AS doc_type", "CASE c_custkey % 11 WHEN 0 THEN 'new title' END AS title", "'admin' AS corrected_by", "'why' AS reason"], None),
    "guesses": ("orders", ["o_custkey AS document_id", "o_orderkey % 5 AS machine_id"], ["CAST(0.9 AS DOUBLE) AS confidence"]),
    "overrides": ("customer", ["c_custkey - c_custkey % 13 AS document_id", "'machine_links' AS field"], []),
}


def lib(spark, d, *names: str) -> list[DataFrame]:
    out = []
    for name in names:
        base, columns, aggregates = LIBRARY[name]
        rows = table(spark, d, base)
        out.append(rows.selectExpr(*columns) if aggregates is None else rows.groupBy(*map(F.expr, columns)).agg(*map(F.expr, aggregates)) if aggregates else rows.selectExpr(*columns).distinct())
    return out


def lib_sql(*names: str) -> str:
    """The same tables as common table expressions."""
    parts = []
    for name in names:
        base, columns, aggregates = LIBRARY[name]
        parts.append(f"{name} AS (SELECT {'' if aggregates is None or aggregates else 'DISTINCT '}{', '.join([*columns, *(aggregates or [])])} FROM {base}{' GROUP BY ALL' if aggregates else ''})")
    return "WITH " + ", ".join(parts)


_OK = "status IN ('indexed', 'partial') AND deactivated_at IS NULL AND docs.review_status = 'approved' AND is_current_revision"
_COUNTS = f"(SELECT count(DISTINCT docs.id) FROM links JOIN docs ON docs.id = document_id WHERE machine_id = machines.id AND links.review_status = 'approved' AND {_OK})"


@query(lib_sql("docs", "makers") + " SELECT docs.id, original_filename, status, name AS manufacturer FROM docs LEFT JOIN makers ON makers.id = manufacturer_id WHERE deactivated_at IS NULL AND status = 'indexed' AND original_filename ILIKE '%1%'")
def list_documents(spark, d):
    return review.list_documents(*lib(spark, d, "docs", "makers"), status="indexed", q="1").select("id", "original_filename", "status", "manufacturer")


@query(lib_sql("links", "machines") + " SELECT document_id, string_agg(printf('%s (%.2f)', model_name, confidence), '; ' ORDER BY model_name, machines.id) AS machines FROM links JOIN machines ON machines.id = machine_id GROUP BY document_id")
def machine_labels(spark, d):
    return review.machine_labels(*lib(spark, d, "links", "machines")).select("document_id", F.array_join("machines", "; ").alias("machines"))


@query(lib_sql("docs", "makers", "links") + """ SELECT DISTINCT docs.id, original_filename, doc_type, name AS manufacturer, status, docs.review_status, ingested_at FROM docs
LEFT JOIN makers ON makers.id = manufacturer_id LEFT JOIN links ON document_id = docs.id WHERE deactivated_at IS NULL AND (docs.review_status <> 'approved' OR links.review_status <> 'approved')""")
def review_queue(spark, d):
    return review.review_queue(*lib(spark, d, "docs", "makers", "links"))


@query(lib_sql("links", "machines", "makers") + """ SELECT document_id, machine_id, model_name, name AS manufacturer, confidence, review_status,
CAST(row_number() OVER (PARTITION BY document_id ORDER BY review_status, model_name, machine_id) AS INTEGER) AS place FROM links JOIN machines ON machines.id = machine_id JOIN makers ON makers.id = manufacturer_id""")
def queue_links(spark, d):
    return review.queue_links(*lib(spark, d, "links", "machines", "makers"))


@query(lib_sql("docs", "makers", "links", "machines") + f""" SELECT * FROM (SELECT machines.id, name AS manufacturer, model_name, family, {_COUNTS} AS document_count FROM machines JOIN makers ON makers.id = manufacturer_id)
WHERE document_count > 0 AND (model_name ILIKE '%eve%' OR family ILIKE '%eve%' OR manufacturer ILIKE '%eve%') ORDER BY manufacturer, model_name, id LIMIT 25""")
def picker_filtered(spark, d):
    return review.pick_machines(*lib(spark, d, "machines", "makers", "links", "docs"), q="eve")


@query(lib_sql("docs", "makers", "links", "machines", "recent") + f""" SELECT machines.id, name AS manufacturer, model_name, {_COUNTS} AS document_count, is_favorite, last_used_at
FROM recent JOIN machines ON machines.id = machine_id JOIN makers ON makers.id = manufacturer_id WHERE user_id = 5 ORDER BY is_favorite DESC, last_used_at DESC, machines.id LIMIT 10""")
def recent_machines(spark, d):
    return review.recent_machines(*lib(spark, d, "recent", "machines", "makers", "links", "docs"), user_id=5)


@query(lib_sql("matches", "docs") + " SELECT matches.id, match_type, k.original_filename AS kept_name, x.original_filename AS duplicate_name FROM matches JOIN docs k ON k.id = kept_document_id JOIN docs x ON x.id = duplicate_document_id")
def duplicate_list(spark, d):
    return review.duplicate_list(*lib(spark, d, "matches", "docs")).select("id", "match_type", "kept_name", "duplicate_name")


@query(lib_sql("feedback", "users", "messages") + " SELECT feedback.id, rating, feedback.created_at, email AS user, sha256(content) AS content FROM feedback JOIN users ON users.id = user_id JOIN messages ON messages.id = message_id ORDER BY feedback.created_at DESC, feedback.id LIMIT 100")
def feedback_report(spark, d):
    return review.feedback_report(*lib(spark, d, "feedback", "users", "messages")).select("id", "rating", "created_at", "user", F.sha2("content", 256).alias("content"))


@query(lib_sql("messages") + """, q AS (SELECT m.conversation_id, m.id, m.created_at, (SELECT content FROM messages p WHERE p.conversation_id = m.conversation_id AND p.role = 'user' AND p.id < m.id ORDER BY p.id DESC LIMIT 1) AS question
FROM messages m WHERE m.role = 'assistant' AND m.is_no_answer) SELECT conversation_id, id, question, created_at FROM q WHERE question IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 50""")
def unanswered(spark, d):
    return review.unanswered(*lib(spark, d, "messages"))


@query(lib_sql("messages", "talks") + " SELECT messages.id, role FROM messages JOIN talks ON talks.id = conversation_id WHERE user_id = 1")
def own_messages(spark, d):
    return review.own_messages(*lib(spark, d, "messages", "talks"), user_id=1).select("id", "role")


@query(lib_sql("saved", "messages") + " SELECT messages.id, saved_at FROM saved JOIN messages ON messages.id = message_id WHERE user_id = 5")
def saved_answers(spark, d):
    return review.saved_answers(*lib(spark, d, "saved", "messages"), user_id=5).select("id", "saved_at")


@query(lib_sql("chunks", "docs") + " SELECT chunks.id, original_filename, is_current_revision FROM chunks JOIN docs ON docs.id = document_id WHERE deactivated_at IS NULL AND review_status = 'approved'")
def evidence(spark, d):
    return review.evidence(*lib(spark, d, "chunks", "docs")).select("id", "original_filename", "is_current_revision")


@query(lib_sql("chunks", "docs") + " SELECT chunks.id, original_filename FROM chunks JOIN docs ON docs.id = document_id WHERE deactivated_at IS NULL")
def evidence_administrator(spark, d):
    return review.evidence(*lib(spark, d, "chunks", "docs"), administrator=True).select("id", "original_filename")


@query(lib_sql("sources", "chunks", "docs") + """ SELECT message_id, chunk_id, document_id, original_filename, CAST(row_number() OVER (PARTITION BY message_id ORDER BY coalesce(citation_ordinal, rank), rank) AS INTEGER) AS place
FROM sources JOIN chunks ON chunks.id = chunk_id JOIN docs ON docs.id = document_id WHERE is_citation""")
def cited_sources(spark, d):
    return review.cited_sources(*lib(spark, d, "sources", "chunks", "docs"))


_FIELDS = ("doc_type", "title")


@query(lib_sql("docs", "corrections") + " SELECT docs.id, coalesce(c.doc_type, docs.doc_type) AS doc_type, coalesce(c.title, docs.title) AS title, status FROM docs LEFT JOIN corrections c ON c.id = docs.id")
def correct_documents(spark, d):
    return review.correct(*lib(spark, d, "docs", "corrections"), _FIELDS).select("id", "doc_type", "title", "status")


@query(lib_sql("docs", "corrections") + """ SELECT docs.id AS document_id, 'doc_type' AS field, docs.doc_type AS previous_value, c.doc_type AS corrected_value, corrected_by, reason FROM docs JOIN corrections c ON c.id = docs.id WHERE c.doc_type IS NOT NULL
UNION ALL SELECT docs.id, 'title', docs.title, c.title, corrected_by, reason FROM docs JOIN corrections c ON c.id = docs.id WHERE c.title IS NOT NULL""")
def override_rows(spark, d):
    return review.override_rows(*lib(spark, d, "docs", "corrections"), _FIELDS)


@query(lib_sql("links") + """ SELECT * FROM links WHERE document_id % 4 <> 0 UNION ALL SELECT DISTINCT document_id, unnest([1, 2]) AS machine_id, CAST(1.0 AS DOUBLE), 'approved' FROM links WHERE document_id % 4 = 0""")
def replace_links(spark, d):
    (links,) = lib(spark, d, "links")
    corrected = links.filter("document_id % 4 = 0").select("document_id").distinct().withColumn("machine_ids", F.expr("array(1L, 2L, 1L)"))
    return review.replace_links(links, corrected)


_CHANGED = lib_sql("docs", "links", "machines", "guesses", "overrides") + f""",
scan AS (SELECT id FROM docs WHERE status IN ('indexed', 'partial') AND deactivated_at IS NULL AND id NOT IN (SELECT document_id FROM overrides)),
old AS (SELECT document_id AS id, string_agg(model_name, ';' ORDER BY model_name) AS names FROM links JOIN machines ON machines.id = machine_id WHERE confidence < 1 GROUP BY 1),
new AS (SELECT document_id AS id, string_agg(model_name, ';' ORDER BY model_name) AS names FROM guesses JOIN machines ON machines.id = machine_id GROUP BY 1),
changed AS (SELECT id, coalesce(old.names, '') AS old_names, coalesce(new.names, '') AS new_names FROM scan LEFT JOIN old USING (id) LEFT JOIN new USING (id) WHERE coalesce(old.names, '') <> coalesce(new.names, ''))"""


def _reindexed(spark, d):
    docs, links, machines, guesses, overrides = lib(spark, d, "docs", "links", "machines", "guesses", "overrides")
    named = guesses.join(machines.select(F.col("id").alias("machine_id"), "model_name"), "machine_id")
    return review.reindex(docs, links, machines, named, overrides)


@query(_CHANGED + " SELECT id, old_names, new_names FROM changed")
def reindex_changes(spark, d):
    return _reindexed(spark, d)[0].select("id", F.array_join("old_names", ";").alias("old_names"), F.array_join("new_names", ";").alias("new_names"))


@query(_CHANGED + """, stay AS (SELECT * FROM links WHERE document_id NOT IN (SELECT id FROM changed) OR confidence >= 1)
SELECT document_id, machine_id, confidence, review_status FROM stay UNION ALL SELECT g.document_id, g.machine_id, g.confidence, 'pending' FROM guesses g JOIN machines ON machines.id = g.machine_id
WHERE g.document_id IN (SELECT id FROM changed) AND NOT EXISTS (SELECT 1 FROM stay s WHERE s.document_id = g.document_id AND s.machine_id = g.machine_id)""")
def reindex_links(spark, d):
    return _reindexed(spark, d)[1]


@query(lib_sql("recent") + """, new AS (SELECT user_id, machine_id + 5 AS machine_id, true AS is_favorite FROM recent WHERE user_id % 2 = 0)
SELECT user_id, machine_id, last_used_at, coalesce(n.is_favorite, r.is_favorite) AS is_favorite FROM recent r FULL JOIN new n USING (user_id, machine_id)""")
def favourite_merge(spark, d):
    """Setting favourites inserts what is missing and leaves the time of last use alone."""
    (recent,) = lib(spark, d, "recent")
    new = recent.filter("user_id % 2 = 0").selectExpr("user_id", "machine_id + 5 AS machine_id", "true AS is_favorite")
    return ingest.merge_columns(recent, new, ["user_id", "machine_id"], ["is_favorite"])


@query(lib_sql("docs") + """ SELECT id, CASE WHEN id % 9 = 0 AND deactivated_at IS NULL THEN 2 ELSE deactivated_at END AS deactivated_at, CASE WHEN id % 9 = 0 AND deactivated_at IS NULL THEN status || ' | gone' ELSE status END AS status FROM docs""")
def deactivate_documents(spark, d):
    (docs,) = lib(spark, d, "docs")
    where = (F.col("id") % 9 == 0) & F.col("deactivated_at").isNull()
    return ingest.update(docs, where, deactivated_at=F.lit(2), status=ingest.append_note(F.col("status"), F.lit("gone"))).select("id", "deactivated_at", "status")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM c GROUP BY 1""")
def event_map(spark, d):
    found = ingest.event_map(table(spark, d, "events"), "user_id", "event_type")
    return found.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("counts"))


@query(lib_sql("sources") + " SELECT message_id, chunk_id, rank, is_citation, CASE WHEN is_citation AND citation_ordinal IS NULL THEN rank ELSE citation_ordinal END AS citation_ordinal FROM sources")
def citation_backfill(spark, d):
    return ingest.with_ordinals(*lib(spark, d, "sources"))


@query("""WITH l AS (SELECT l_orderkey AS page_id, l_linenumber AS pos, l_returnflag AS text, l_quantity AS size FROM lineitem),
m AS (SELECT page_id, list_sort(list(size)) AS s FROM l GROUP BY page_id), b AS (SELECT page_id, s[len(s) // 2 + 1] AS body FROM m)
SELECT page_id, pos, text, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY size DESC) - 1 AS INTEGER) AS rank FROM l JOIN b USING (page_id) WHERE size > body + 0.5""")
def headings_by_size(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("text"), F.col("l_quantity").alias("size"))
    return extraction.headings_by_size(lines)


@query("SELECT count(*) AS n FROM (SELECT 1 FROM customer)")
def user_count(spark, d):
    return table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
