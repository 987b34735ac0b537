"""The registered queries of the engine's own operators, each beside its SQL.

Documents stand for files (path ``/corpus/<source>/<lang>/doc-<id>.<ext>``) and
for chunks; embeddings are chunk vectors with ``vec_id = doc_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions.vectors import pack_float32, unpack_float32
from tidewater.operators import chunker, fusion, index, lines, match, vector
from tidewater.sources import extract, web
from tidewater.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]

KEYWORDS = "rest heed"
PHRASE = ["of", "the"]
LINE_QUERY = "rest heed the"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- tables that stand for files -------------------------------------------------

_EXTS = ("md", "txt", "html", "csv", "bin")


def doc_path() -> F.Column:
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 17 == 0, "/.git").when(F.col("doc_id") % 19 == 0, "/vendor").otherwise("")
    return F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", folder, F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit("."), ext)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", doc_path().alias("path"), (F.col("doc_id") * 1_000_003).alias("mtime_ns"), F.octet_length("text").cast("long").alias("size"), "text")


SQL_FILES = """files AS (SELECT doc_id, '/corpus/' || source || '/' || lang
  || CASE WHEN doc_id % 17 = 0 THEN '/.git' WHEN doc_id % 19 = 0 THEN '/vendor' ELSE '' END
  || '/doc-' || doc_id || '.' || (['md','txt','html','csv','bin'])[CAST(doc_id % 5 + 1 AS INT)] AS path,
  doc_id * 1000003 AS mtime_ns, CAST(strlen(text) AS BIGINT) AS size, text FROM documents)"""

_FOLDED = f"translate(lower(text), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
SQL_TOKENS = f"toks AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[\\p{{L}}\\p{{N}}]+') AS t FROM documents)"
SQL_BM25 = f"""{SQL_TOKENS},
d AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'rest')) AS f0, len(list_filter(t, lambda x: x = 'heed')) AS f1 FROM toks),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1 FROM d),
w AS (SELECT n, avgdl, CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END AS i0,
  CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END AS i1 FROM s),
bm AS (SELECT doc_id, round(-(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM d, w WHERE f0 > 0 AND f1 > 0)"""
SQL_COSINE = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
co AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q)"""
SQL_HYBRID = f"""{SQL_BM25}, {SQL_COSINE},
legs AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score, doc_id) AS rank FROM bm QUALIFY rank <= 50
  UNION ALL SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM co QUALIFY rank <= 50),
fused AS (SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM legs GROUP BY id ORDER BY score DESC, id LIMIT 10)"""


# --- full text -------------------------------------------------------------------


@query(f"WITH {SQL_TOKENS} SELECT doc_id, CAST(len(t) AS INT) AS n_tokens FROM toks")
def tokenize(spark, sf_dir):
    return match.tokenize(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {SQL_TOKENS}, x AS (SELECT doc_id, unnest(t) AS term FROM toks) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM x GROUP BY term")
def term_stats(spark, sf_dir):
    return match.term_stats(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {SQL_TOKENS} SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avgdl FROM toks")
def corpus_stats(spark, sf_dir):
    return match.corpus_stats(read(spark, sf_dir, "documents"), "text").withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {SQL_TOKENS}, x AS (SELECT doc_id, unnest(t) AS term FROM toks) SELECT term, doc_id, CAST(count(*) AS INT) AS tf FROM x GROUP BY term, doc_id")
def postings(spark, sf_dir):
    found = match.postings(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("term", "doc_id", F.size("positions").alias("tf"))


@query(
    f"""WITH {SQL_TOKENS}, x AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM toks),
    y AS (SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM x)
    SELECT doc_id, CAST(count(*) AS INT) AS freq FROM y WHERE term = 'of' AND after = 'the' GROUP BY doc_id"""
)
def phrase_search(spark, sf_dir):
    return match.phrase_search(read(spark, sf_dir, "documents"), "doc_id", "text", PHRASE)


@query(f"WITH {SQL_BM25} SELECT doc_id, score FROM bm")
def bm25_scores(spark, sf_dir):
    return match.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS).withColumn("score", F.round("score", 6))


@query(f"WITH {SQL_BM25} SELECT doc_id, score FROM bm ORDER BY score, doc_id LIMIT 10")
def keyword_search(spark, sf_dir):
    return match.keyword_search(read(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS, 10)


@query(f"WITH {SQL_BM25} SELECT doc_id, score FROM bm ORDER BY score, doc_id LIMIT 10")
def keyword_search_postings(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = match.index_postings(docs, "doc_id", "text")
    return match.search_postings(found, match.corpus_size(docs, "text"), KEYWORDS, 10).withColumnRenamed("id", "doc_id")


@query(f"WITH {SQL_BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def keyword_search_ref_order(spark, sf_dir):
    return match.keyword_search(read(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS, 10, "reference")


# --- vectors, fusion, rerank -----------------------------------------------------


def _query_vector(spark, sf_dir) -> list[float]:
    return read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"WITH {SQL_COSINE} SELECT vec_id, score FROM co ORDER BY score DESC, vec_id LIMIT 10")
def vector_search(spark, sf_dir):
    return vector.top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 10)


@query(
    f"""WITH {SQL_TOKENS}, x AS (SELECT doc_id, CAST(('0x' || substr(md5(unnest(t)), 1, 8))::UBIGINT % 64 AS INT) AS dim FROM toks),
    c AS (SELECT doc_id, dim, count(*) AS v FROM x GROUP BY doc_id, dim)
    SELECT doc_id, dim, round(v / sqrt(sum(CAST(v * v AS DOUBLE)) OVER (PARTITION BY doc_id)), 6) AS value FROM c"""
)
def hash_embed(spark, sf_dir):
    return vector.hash_embed(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dim, CAST(len(embedding) * 4 AS INT) AS n_bytes, true AS same FROM embeddings")
def vector_codec(spark, sf_dir):
    packed = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", pack_float32("embedding").alias("blob"))
    back = packed.select("vec_id", "embedding", "blob", unpack_float32("blob").alias("back"))
    return back.select("vec_id", F.size("back").alias("dim"), F.octet_length("blob").alias("n_bytes"), (F.col("back") == F.col("embedding")).alias("same"))


def _legs(spark, sf_dir) -> list[DataFrame]:
    docs, vectors = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    words = match.keyword_search(docs, "doc_id", "text", KEYWORDS, fusion.POOL)
    near = vector.top_k(vectors, "vec_id", "embedding", _query_vector(spark, sf_dir), fusion.POOL)
    return [fusion.ranked(words, "doc_id", F.asc("score")), fusion.ranked(near, "vec_id", F.desc("score"))]


@query(f"WITH {SQL_HYBRID} SELECT id, score FROM fused")
def rrf_fusion(spark, sf_dir):
    return fusion.rrf(_legs(spark, sf_dir))


_SNIPPET = "CASE WHEN strlen(trim(text)) <= 300 THEN trim(text) ELSE decode(encode(trim(text))[1:300]) || '...' END"


@query(
    f"""WITH {SQL_HYBRID}, {SQL_FILES} SELECT id, string_split(path, '/')[-1] || ':1' AS title, path, score, 'local' AS source
    FROM fused JOIN files ON id = doc_id"""
)
def hybrid_search(spark, sf_dir):
    hits = fusion.rrf(_legs(spark, sf_dir))
    found = fusion.hydrate(hits, read(spark, sf_dir, "documents"), "doc_id", "text", doc_path())
    return found.select("id", "title", "path", "score", "source")


@query(
    f"""WITH {SQL_BM25}, {SQL_FILES}, h AS (SELECT doc_id, score FROM bm ORDER BY score, doc_id LIMIT 20)
    SELECT h.doc_id AS id, path, score, sha256(text) AS hash FROM h JOIN files USING (doc_id)"""
)
def late_materialize(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    hits = match.keyword_search(docs, "doc_id", "text", KEYWORDS, 20)
    rows = docs.select("doc_id", doc_path().alias("path"), "text").join(F.broadcast(hits), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), "path", "score", T.content_hash(F.col("text")).alias("hash"))


@query(
    f"""WITH {SQL_BM25}, h AS (SELECT doc_id FROM bm ORDER BY score, doc_id LIMIT 20)
    SELECT doc_id AS id, round(len(list_intersect(list_distinct(t), ['and', 'heed', 'of', 'rest', 'shard'])) / 5.0, 6) AS score
    FROM h JOIN toks USING (doc_id) ORDER BY score DESC, id LIMIT 10"""
)
def rerank(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    hits = match.keyword_search(docs, "doc_id", "text", KEYWORDS, 20).withColumnRenamed("doc_id", "id")
    return fusion.lexical_rerank(hits, docs, "doc_id", "text", "rest heed of and shard", 10)


# --- line search -----------------------------------------------------------------

SQL_LINES = """l AS (SELECT doc_id, unnest(string_split(rtrim_one, chr(10))) AS line_text, generate_subscripts(string_split(rtrim_one, chr(10)), 1) AS line
    FROM (SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END AS rtrim_one FROM documents WHERE length(text) > 0)),
  c AS (SELECT doc_id, line, lower(line_text) AS t FROM l),
  k AS (SELECT doc_id, line, CAST((length(t) - length(replace(t, 'rest', ''))) / 4 AS INT) AS a, CAST((length(t) - length(replace(t, 'heed', ''))) / 4 AS INT) AS b,
    CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INT) AS d FROM c),
  m AS (SELECT doc_id, CAST(line AS INT) AS line, a + b + d + CASE WHEN a > 0 AND b > 0 AND d > 0 THEN 2 ELSE 0 END AS score,
    CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(d > 0 AS INT) AS n_terms FROM k WHERE a + b + d > 0)"""


@query(f"WITH {SQL_LINES} SELECT doc_id, line, score, n_terms FROM m ORDER BY score DESC, n_terms DESC, line, doc_id LIMIT 50")
def line_search(spark, sf_dir):
    return lines.line_search(read(spark, sf_dir, "documents"), "doc_id", "text", LINE_QUERY, 50)


@query(f"WITH {SQL_LINES} SELECT doc_id, line, score, n_terms, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n_terms DESC, line) AS INT) AS place FROM m) WHERE place <= 3")
def line_search_per_doc_topk(spark, sf_dir):
    return lines.line_search(read(spark, sf_dir, "documents"), "doc_id", "text", LINE_QUERY, per_doc=3)


# --- extraction and chunks -------------------------------------------------------


@query()
def html_to_text(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.concat("url", F.lit(".html")).alias("path"), "html")
    return extract.extract_files(pages, "path", "html").select("path", "status", "text")


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'gs'), '<[^>]*>', ' ', 'gs') AS text FROM pages"""
)
def html_visible_text_sql(spark, sf_dir):
    cleaned = F.regexp_replace("html", r"(?s)<!--.*?-->", " ")
    cleaned = F.regexp_replace(cleaned, r"(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(cleaned, r"(?s)<[^>]*>", " ").alias("text"))


@query("SELECT 'part-' || p_partkey || '.csv' AS path, 'ok' AS status, p_name || chr(9) || p_brand || chr(9) || p_size AS text FROM part")
def csv_to_text(spark, sf_dir):
    row = F.concat(F.lit('"'), "p_name", F.lit('",'), "p_brand", F.lit(","), F.col("p_size").cast("string"), F.lit("\n"))
    source = read(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("path"), row.alias("content"))
    return extract.extract_files(source, "path", "content").select("path", "status", "text")


@query(
    f"""WITH {SQL_FILES} SELECT path, CASE regexp_extract(path, '\\.[a-z]+$') WHEN '.md' THEN 'text' WHEN '.txt' THEN 'text'
    WHEN '.html' THEN 'html' WHEN '.csv' THEN 'csv' END AS format FROM files"""
)
def ext_dispatch(spark, sf_dir):
    return extract.dispatch(files(spark, sf_dir), "path")


@query(f"WITH {SQL_FILES} SELECT path, 'ok' AS status, sha256(text) AS hash FROM files WHERE path LIKE '%.md' OR path LIKE '%.txt'")
def extract_text(spark, sf_dir):
    source = files(spark, sf_dir).where(T.extension(F.col("path")).isin(".md", ".txt"))
    return extract.extract_files(source, "path", "text").select("path", "status", T.content_hash(F.col("text")).alias("hash"))


@query()
def chunk_documents(spark, sf_dir):
    return chunker.chunk_documents(files(spark, sf_dir), "path", "text")


@query()
def chunk_stats(spark, sf_dir):
    return chunker.chunk_stats(chunk_documents(spark, sf_dir))


# --- index maintenance -----------------------------------------------------------

_IN_SKIPPED = "(path LIKE '%/.git/%' OR path LIKE '%/vendor/%')"


@query(
    f"""WITH {SQL_FILES} SELECT path, size, CASE WHEN size > 10000 THEN 'larger than 10000 bytes' ELSE 'ok' END AS status FROM files
    WHERE path LIKE '/corpus/%' AND path NOT LIKE '%.bin' AND NOT {_IN_SKIPPED}"""
)
def walk_filter(spark, sf_dir):
    return index.walk_filter(files(spark, sf_dir), "/corpus", [".md", ".txt", ".html", ".csv"], 10_000)


@query(f"WITH {SQL_FILES} SELECT path FROM files WHERE path LIKE '/corpus/src1/%' OR path LIKE '/corpus/src2/en/%'")
def allowlist(spark, sf_dir):
    return files(spark, sf_dir).where(index.under_any(F.col("path"), ["/corpus/src1", "/corpus/src2/en"])).select("path")


@query(f"WITH {SQL_FILES} SELECT path FROM files WHERE path LIKE '/corpus/src3/de/%'")
def list_prefix(spark, sf_dir):
    return index.list_prefix(files(spark, sf_dir), "/corpus/src3/de")


@query(f"WITH {SQL_FILES} SELECT regexp_replace(path, '/[^/]+$', '') AS folder, count(*) AS n_files FROM files GROUP BY folder")
def folder_counts(spark, sf_dir):
    return index.folder_counts(files(spark, sf_dir))


@query(f"WITH {SQL_FILES} SELECT path, mtime_ns, size FROM files")
def file_manifest(spark, sf_dir):
    return files(spark, sf_dir).select("path", "mtime_ns", "size")


def _indexed(spark, sf_dir) -> DataFrame:
    """An older state: every seventh size differs, every eleventh file is new."""
    size = F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))
    return files(spark, sf_dir).where("doc_id % 11 <> 0").select("doc_id", "path", "mtime_ns", size.alias("size"))


_SQL_STATUS = f"""{SQL_FILES}, st AS (SELECT doc_id, path, CASE WHEN doc_id % 11 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM files)"""


@query(f"WITH {_SQL_STATUS} SELECT path, status FROM st")
def incremental_diff(spark, sf_dir):
    return index.incremental_diff(files(spark, sf_dir).select("path", "mtime_ns", "size"), _indexed(spark, sf_dir).drop("doc_id"))


@query(f"WITH {SQL_FILES} SELECT path, mtime_ns, size FROM files")
def upsert_files(spark, sf_dir):
    now = files(spark, sf_dir).select("path", "mtime_ns", "size")
    old = _indexed(spark, sf_dir).drop("doc_id")
    changed = now.join(index.incremental_diff(now, old).where("status <> 'unchanged'"), "path").drop("status")
    return index.upsert(old, changed, "path")


@query(
    f"""WITH {SQL_FILES}, o AS (SELECT path AS file_path, i AS chunk_index, 'old' AS state FROM files, range(3) r(i)),
    n AS (SELECT path AS file_path, i AS chunk_index, 'new' AS state FROM files, range(70) r(i) WHERE doc_id % 10 = 0)
    SELECT file_path, CAST(chunk_index AS INT) AS chunk_index, state FROM o ANTI JOIN (SELECT DISTINCT file_path FROM n) g USING (file_path)
    UNION ALL SELECT file_path, CAST(chunk_index AS INT), state FROM n WHERE chunk_index < 64"""
)
def replace_chunks(spark, sf_dir):
    base = files(spark, sf_dir).select("doc_id", F.col("path").alias("file_path"))

    def chunks(df: DataFrame, n: int, state: str) -> DataFrame:
        return df.select("file_path", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk_index"), F.lit(state).alias("state"))

    return index.replace_chunks(chunks(base, 3, "old"), chunks(base.where("doc_id % 10 = 0"), 70, "new"))


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def upsert_vectors(spark, sf_dir):
    old = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return index.upsert(old, old.where("chunk_id % 3 = 0").withColumn("label", F.col("label") + 100), "chunk_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_backfill(spark, sf_dir):
    return vector.backfill(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "embeddings"), "doc_id", "vec_id")


@query(f"WITH {SQL_FILES} SELECT path FROM files WHERE NOT (path LIKE '/corpus/src4/%' OR path LIKE '/corpus/src5/en/%')")
def remove_paths(spark, sf_dir):
    return index.remove_paths(files(spark, sf_dir), ["/corpus/src4", "/corpus/src5/en"]).select("path")


@query(
    f"""WITH {SQL_FILES} SELECT path, CASE WHEN path NOT LIKE '/corpus/src1%' THEN 'outside' ELSE 'missing' END AS reason FROM files
    WHERE NOT (path LIKE '/corpus/src1/%' OR path LIKE '/corpus/src10/%' OR path LIKE '/corpus/src11/%') AND path NOT LIKE '/corpus/src1%'
    OR (path LIKE '/corpus/src1/%' OR path LIKE '/corpus/src10/%' OR path LIKE '/corpus/src11/%') AND doc_id % 13 = 0"""
)
def prune_orphans(spark, sf_dir):
    indexed = files(spark, sf_dir).where(~T.under(F.col("path"), "/corpus/src12") & ~F.col("path").rlike("^/corpus/src1[3-9]/"))
    on_disk = files(spark, sf_dir).where("doc_id % 13 <> 0")
    return index.prune_orphans(indexed, on_disk, ["/corpus/src1", "/corpus/src10", "/corpus/src11"])


@query(
    f"""WITH {SQL_FILES} SELECT count(*) AS file_count, count(DISTINCT regexp_replace(path, '/[^/]+$', '')) AS folder_count, CAST(sum(size) AS BIGINT) AS total_bytes,
    max(mtime_ns) AS last_index_change, (SELECT count(*) FROM embeddings) AS vector_chunk_count FROM files"""
)
def index_stats(spark, sf_dir):
    return index.index_stats(files(spark, sf_dir).withColumn("indexed_at", F.col("mtime_ns")), read(spark, sf_dir, "embeddings"))


@query(
    """SELECT count(*) AS file_count, count(*) AS chunk_count, (SELECT count(*) FROM embeddings) AS vector_count,
    count(*) > 0 AND (SELECT count(*) FROM embeddings) = count(*) AS vector_ready,
    CASE WHEN count(*) = 0 THEN 'index is empty' WHEN (SELECT count(*) FROM embeddings) = count(*) THEN 'ready' ELSE 'vectors incomplete' END AS message FROM documents"""
)
def index_status(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return index.index_status(docs, docs, read(spark, sf_dir, "embeddings"))


@query(
    f"""WITH {_SQL_STATUS}, o AS (SELECT path, CASE WHEN doc_id % 23 = 0 THEN 'error' ELSE status END AS status FROM st)
    SELECT count(*) FILTER (WHERE status = 'new') AS indexed, count(*) FILTER (WHERE status = 'changed') AS updated,
    count(*) FILTER (WHERE status = 'unchanged') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors,
    (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM o WHERE status = 'error' ORDER BY path LIMIT 20)) AS messages FROM o"""
)
def index_report(spark, sf_dir):
    diff = incremental_diff(spark, sf_dir)
    doc_id = F.regexp_extract("path", r"doc-(\d+)\.", 1).cast("long")
    return index.index_report(diff.withColumn("status", F.when(doc_id % 23 == 0, "error").otherwise(F.col("status"))))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY sha256(text)")
def dedupe_exact(spark, sf_dir):
    hashed = read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


# --- web and watch ---------------------------------------------------------------


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'id-' || page_id END AS id, 'page ' || page_id AS title, url,
    CASE WHEN page_id % 2 = 0 THEN 'sum' ELSE 'snip' END AS snippet, round(1.0 / (i + 1), 6) AS score, 'web' AS source
    FROM pages, range(2) r(i) WHERE page_id % 5 <> 0"""
)
def web_results(spark, sf_dir):
    one = F.struct(
        F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("id-"), F.col("page_id").cast("string"))).alias("id"),
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"), "url",
        F.lit("snip").alias("snippet"), F.when(F.col("page_id") % 2 == 0, "sum").otherwise(" ").alias("summary"),
    )
    body = F.struct(F.when(F.col("page_id") % 5 == 0, 500).otherwise(200).alias("code"), F.struct(F.struct(F.array(one, one).alias("value")).alias("webPages")).alias("data"))
    return web.decode(read(spark, sf_dir, "pages").select("page_id", F.to_json(body).alias("raw")), "raw", "page_id")


def _fs_events(spark, sf_dir) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("error", "remove", "signup", "create", "purchase", "write", "click", "write", "view", "chmod")])
    return read(spark, sf_dir, "events").select("ts", F.concat(F.lit("/w/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.element_at(kinds, F.col("event_type")).alias("kind"))


SQL_OPS = """ops AS (SELECT ts, '/w/' || user_id || '.md' AS path, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'index' END AS op
    FROM events WHERE event_type IN ('error', 'signup', 'purchase', 'click'))"""


@query(f"WITH {SQL_OPS} SELECT ts, path, op FROM ops")
def watch_ops(spark, sf_dir):
    return watch.watch_ops(_fs_events(spark, sf_dir), "ts", "path", "kind")


@query(
    f"""WITH {SQL_OPS}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM ops WINDOW w AS (PARTITION BY path ORDER BY ts)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
    SELECT path, CASE WHEN max(CAST(op = 'remove' AS INT)) = 1 THEN 'remove' ELSE 'index' END AS op, max(ts) + INTERVAL 2 HOUR AS fired_at, count(*) AS n_events FROM b GROUP BY path, burst"""
)
def watch_debounce(spark, sf_dir):
    return watch.debounce(watch_ops(spark, sf_dir), "2 hours")


@query(
    """SELECT item_id, doc_id, CAST(strlen(text_d) AS INT) AS n_bytes FROM (SELECT item_id, text AS text_b FROM benchmark) b
    JOIN (SELECT doc_id, text AS text_d FROM documents) d ON contains(text_d, text_b)"""
)
def batch_line_search(spark, sf_dir):
    """Documents that hold a benchmark passage word for word: the bounded set of
    passages (checked by the optimizer's size estimate) meets all documents."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("text_b"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_d"))
    return docs.join(items, F.col("text_d").contains(F.col("text_b"))).select("item_id", "doc_id", F.octet_length("text_d").alias("n_bytes"))
