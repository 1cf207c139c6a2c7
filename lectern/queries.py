"""The registered queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import text as T
from .operators import answers, blockmax, chunking, export, fusion, lexical, tables, vectors, versions
from .operators.rerank import boost
from .plans.search import search
from .sources import html

QUERY = "the quick license termination of thing"
LICENSE_QUERY = "released under the mit license"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    meta = F.create_map(F.lit("lang"), F.concat(F.lit('"'), F.col("lang"), F.lit('"')), F.lit("source"), F.concat(F.lit('"'), F.col("source"), F.lit('"')))
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.lit("txt").alias("format"), F.col("text").alias("content"), meta.alias("metadata"))


def _chunks(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Sliding windows of all documents, with ids that SQL can make as well; or of those that hold the few `found` chunks."""
    docs = _extracted(spark, sf_dir)
    if found is not None:
        docs = docs.join(F.broadcast(found.select(F.substring_index("chunk_id", "#", 1).alias("path")).distinct()), "path", "left_semi")
    out = chunking.chunk(docs)
    return out.withColumn("chunk_id", F.concat(F.col("document_path"), F.lit("#"), F.lpad(F.col("chunk_index").cast("string"), 8, "0")))


def _search(spark: SparkSession, sf_dir: str, *args, **options) -> DataFrame:
    """The windows of all documents searched."""
    return search(_chunks(spark, sf_dir), *args, holding=lambda found: _chunks(spark, sf_dir, found), **options)


def _stored(df: DataFrame, **options: str) -> DataFrame:
    """`df` written to a new folder in the shared place, and read from there."""
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="lectern-")
    path = f"{place.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _one(spark: SparkSession, query: str, vector: list[float] | None = None) -> DataFrame:
    return spark.createDataFrame([(0, query, vector)], "query_id long, query string, vector array<double>")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# queries


def detect_format(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", T.detect_format(F.col("url")).alias("format"), T.is_url(F.col("url")).alias("is_url"), T.supported(F.col("url")).alias("supported"))


def chunk_sliding(spark, sf_dir):
    return _chunks(spark, sf_dir).select("document_path", "chunk_index", F.md5("content").alias("digest"), F.length("content").alias("n_chars"))


def chunk_by_heading(spark, sf_dir):
    return chunking.chunk(_extracted(spark, sf_dir), "by-heading").select("document_path", "chunk_index", "heading", "content")


def chunk_by_heading_markdown(spark, sf_dir):
    return chunking.chunk(_extracted(spark, sf_dir).withColumn("format", F.lit("md")), "by-heading").select("document_path", "chunk_index", "heading", F.md5("content").alias("digest"))


def term_stats(spark, sf_dir):
    return lexical.document_frequencies(_table(spark, sf_dir, "documents"), "text")


def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(_table(spark, sf_dir, "documents"), "text").select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_top(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return lexical.bm25(docs, _one(spark, QUERY), 10, "doc_id", "text").select("doc_id", "score", "rank")


def bm25_batch(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return lexical.bm25(docs, _benchmark(spark, sf_dir), 5, "doc_id", "text").select("query_id", "doc_id", "score", "rank")


def bm25_conversations(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    asked = _table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return lexical.bm25(docs, asked, 3, "doc_id", "text").select("query_id", "doc_id", "score", "rank")


def bm25_chunks(spark, sf_dir):
    return _search(spark, sf_dir, _one(spark, QUERY), 10).select("chunk_id", "rank", F.round("score", 6).alias("score"))


def vector_top(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    first = v.where("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.nearest(v, first, 10, "vec_id").select("vec_id", "score", "rank")


def vector_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.nearest(v, asked, 5, "vec_id").select("query_id", "vec_id", "score", "rank")


def vector_grid(spark, sf_dir):
    """Every twentieth vector against all, block by block on the executors."""
    v = _vectors(spark, sf_dir).where("embedding IS NOT NULL").withColumn("list", F.lit(0))
    asked = v.where("vec_id % 20 = 0").select("list", F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return lexical.top(vectors.grid(v, asked, 5, "vec_id"), 5, "vec_id").select("query_id", "vec_id", "score", "rank")


def vector_approximate(spark, sf_dir):
    """Every twentieth vector against all, in the lists of the nearest 40 of 64 centroids (the vectors have hardly any structure)."""
    v = _vectors(spark, sf_dir)
    centroids = vectors.fit_centroids(v, 64, "vec_id")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.nearest_in_lists(vectors.inverted_lists(v, centroids, "vec_id"), centroids, asked, 5, 40, "vec_id").select("query_id", "vec_id", "score", "rank")


def cosine_pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def hybrid_rrf(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    v = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "id")
    left = lexical.bm25(docs, _one(spark, QUERY), 30, "id", "text")
    right = vectors.nearest(v, v.where("id = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector")), 30, "id")
    return fusion.fuse(left, right, 10, 0.5, "id").select("id", "score", "rank")


def _filtered(spark, sf_dir, stage):
    found = _search(spark, sf_dir, _one(spark, QUERY), 10, {"lang": "en", "source": "src3"}, Config(filter_stage=stage))
    return found.select("chunk_id", "rank", F.round("score", 6).alias("score"))


def search_filter_after(spark, sf_dir):
    return _filtered(spark, sf_dir, "post")


def search_filter_before(spark, sf_dir):
    return _filtered(spark, sf_dir, "pre")


def search_reranked(spark, sf_dir):
    return _search(spark, sf_dir, _one(spark, LICENSE_QUERY), 5, config=Config(rerank=True)).select("chunk_id", "rank", F.round("score", 6).alias("score"))


def rerank_boost(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.round(boost(F.lit("the of and"), F.col("text")), 6).alias("boost"))


def table_candidates(spark, sf_dir):
    found = F.size(tables.candidate_lines(F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", found.cast("long").alias("n_lines"))


def table_extract(spark, sf_dir):
    found = tables.extract_tables(_table(spark, sf_dir, "documents").withColumnRenamed("text", "content"))
    return found.select("doc_id", "table_index", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


def html_text(spark, sf_dir):
    return html.parse_pages(_table(spark, sf_dir, "pages")).select("page_id", "content")


def html_title(spark, sf_dir):
    return html.parse_pages(_table(spark, sf_dir, "pages")).select("page_id", "title")


def html_links(spark, sf_dir):
    """Links of the pages, each paragraph of which ends in a relative one; those in dropped parts don't count."""
    more = F.concat(F.lit('<a href="/next/'), F.col("page_id").cast("string"), F.lit('">more</a></p>'))
    pages = _table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("</p>"), more))
    return html.parse_pages(pages).select("page_id", F.posexplode("links").alias("position", "link"))


def dedupe_exact(spark, sf_dir):
    return versions.first_copies(_table(spark, sf_dir, "documents")).select("doc_id", "copies")


def _edited(spark, sf_dir):
    """Each document's text with its first line gone and a line more, for two in three."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    other = F.concat(F.regexp_replace("content", "^[^\n]*\n", ""), F.lit("\nEdited line."))
    return docs, docs.withColumn("content", F.when(F.col("path").cast("long") % 3 > 0, other).otherwise(F.col("content")))


def upsert_changed(spark, sf_dir):
    old, new = _edited(spark, sf_dir)
    known = old.select("path", F.lit(1).alias("version"), "content", F.lit(0).cast("long").alias("ts"))
    return versions.changed(new, known).select("path", F.length("content").cast("long").alias("n_chars"))


def document_diff(spark, sf_dir):
    old, new = _edited(spark, sf_dir)
    both = old.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2)))
    return versions.diff(both).select("path", "version_a", "version_b", F.array_join("additions", "|").alias("additions"), F.array_join("removals", "|").alias("removals"))


def remove_document_stats(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    left = docs.join(docs.where("source = 'src0'").select("doc_id"), "doc_id", "left_anti")
    return lexical.corpus_stats(left, "text").select("n", F.round("avgdl", 6).alias("avgdl"))


def _asked(spark, sf_dir):
    return _search(spark, sf_dir, _benchmark(spark, sf_dir), 5)


def ask_context(spark, sf_dir):
    return answers.contexts(_asked(spark, sf_dir)).select("query_id", F.md5("context").alias("digest"), F.size("sources").cast("long").alias("n_sources"))


def fallback_answer(spark, sf_dir):
    return answers.fallbacks(_asked(spark, sf_dir)).select("query_id", "answer")


def agentic_sources(spark, sf_dir):
    found = _search(spark, sf_dir, _benchmark(spark, sf_dir), 3).withColumnRenamed("query_id", "sub")
    return answers.union_sources(found).select("chunk_id", "sub", "rank", F.round("score", 6).alias("score"))


def schema_batches(spark, sf_dir):
    out = answers.schema_batches(_extracted(spark, sf_dir).select("path", "content"))
    return out.select("path", "batch", F.size("excerpts").cast("long").alias("n_excerpts"), F.md5(F.array_join("excerpts", "|")).alias("digest"))


def export_rows(spark, sf_dir):
    found = _search(spark, sf_dir, _one(spark, QUERY), 100)
    return export.export_rows(found).select("document", "heading", F.md5("content").alias("digest"), F.round("score", 6).alias("score"))


def snippets(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def highlights(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", T.highlight(F.col("text"), "the and thing").alias("marked"))


def highlights_overlapping(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", T.highlight(F.col("text"), "the hen her ere ing ngs").alias("marked"))


def bm25_blocks(spark, sf_dir):
    """The benchmark's passages asked of an index of blocks of all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n, mean = lexical.corpus_stats(docs, "text").first()
    index = _stored(blockmax.indexed(docs, n, "doc_id", "text"), **blockmax.WRITE_OPTIONS)
    asked = _benchmark(spark, sf_dir)
    some = lexical.broadcast_if_small(lexical.query_terms(asked).select("term").distinct())
    df = index.join(some, "term", "left_semi").groupBy("term").agg(F.sum(F.size("hits.tf")).alias("df"))
    found = blockmax.search(index, asked, n, mean, df, 5, "doc_id")
    return found.select("query_id", "doc_id", "score", "rank")


def _chunk_vectors(spark, sf_dir):
    """The vectors as those of the first chunks of the documents with their numbers."""
    return _vectors(spark, sf_dir).select(F.concat(F.lpad(F.col("vec_id").cast("string"), 12, "0"), F.lit("#00000000")).alias("chunk_id"), "embedding")


def _searched(spark, sf_dir, mode):
    asked = _vectors(spark, sf_dir).where("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.lit(QUERY).alias("query"), F.col("embedding").alias("vector"))
    found = _search(spark, sf_dir, asked, 10, config=Config(mode=mode), embeddings=_chunk_vectors(spark, sf_dir))
    return found.select("chunk_id", "rank", F.round("score", 6).alias("score"))


def search_vector(spark, sf_dir):
    return _searched(spark, sf_dir, "vector")


def search_hybrid(spark, sf_dir):
    return _searched(spark, sf_dir, "hybrid")


def library_lifecycle(spark, sf_dir):
    """All documents indexed, indexed again with two in three of them edited, and one removed: what the library then holds."""
    from .plans.library import Library

    library = Library(spark)
    old, new = _edited(spark, sf_dir)
    for docs in (old, new):
        library.add(docs.select("path", F.lit("txt").alias("format"), "content", F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("string").alias("error")))
    library.remove("7")
    held = library.table("versions").groupBy("path").agg(F.max("version").alias("versions"))
    found = library.table("chunks").groupBy(F.col("document_path").alias("path")).agg(F.count(F.lit(1)).alias("chunks"))
    return library.documents().join(held, "path").join(found, "path", "left").select("path", "size", "versions", (F.col("chunk_count") == F.coalesce("chunks", F.lit(0))).alias("counted"))


def watch_ingest(spark, sf_dir):
    """The documents as text files of a hundred each, come to a folder in two halves, each followed by a watch that goes on from the
    other's checkpoint: what the library holds of each file."""
    from .plans.library import Library

    docs = _table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    library = Library(spark)
    inbox = f"{library.path}-inbox"
    for half in (0, 1):
        some = docs.where(F.col("part") % 2 == half).repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id")
        some.write.mode("append").partitionBy("part").text(inbox)
        library.watch(inbox, once=True).awaitTermination()
    return library.documents().select(F.regexp_extract("path", "part=(\\d+)", 1).cast("long").alias("part"), "size")


# SQL

_TOKENS = r"list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9''-]+', ' ', 'g'), ' '), lambda t: length(t) > 1 AND length(t) < 50)"
_SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"



def _windows(size: int, step: int) -> str:
    return f"""w AS (SELECT path, doc_id, lang, source, (s // {step})::INT AS chunk_index, {_trim(f"substr(text, s + 1, {size})")} AS content
FROM (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, doc_id, lang, source, text, unnest(CASE WHEN length({_trim("text")}) > 0 THEN range(0, length(text), {step}) ELSE [] END) AS s FROM documents)),
c AS (SELECT *, path || '#' || lpad(chunk_index::VARCHAR, 8, '0') AS chunk_id FROM w)"""


def _bm25(items: str, key: str, content: str, queries: str, k: int, where: str = "TRUE", prefix: str = "") -> str:
    """CTEs that end in `found` (query_id, key, score, rank)."""
    return f"""{prefix}q AS ({queries}),
qt AS (SELECT DISTINCT query_id, unnest({_TOKENS.format("query")}) AS term FROM q),
tok AS (SELECT {key} AS key, {_TOKENS.format(content)} AS t FROM {items}),
tot AS (SELECT count(*)::DOUBLE AS n, coalesce(avg(len(t)), 1)::DOUBLE AS avgdl FROM tok),
post AS (SELECT key, term, dl, count(*) AS tf FROM (SELECT key, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
sc AS (SELECT query_id, key, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM post JOIN df USING (term) JOIN qt USING (term), tot GROUP BY ALL),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank FROM sc WHERE {where} QUALIFY rank <= {k})"""


_ONE = f"SELECT 0::BIGINT AS query_id, '{QUERY}' AS query"
_BENCH = "SELECT item_id AS query_id, text AS query FROM benchmark"
_NEAREST = """SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id)::INT AS rank
FROM embeddings v, (SELECT * FROM embeddings WHERE {0}) q QUALIFY rank <= {1}"""
_ASKED = "WITH " + _windows(1500, 1300) + ", " + _bm25("c", "chunk_id", "content", _BENCH, 10)
_EDIT = r"CASE WHEN doc_id % 3 > 0 THEN regexp_replace(text, '^[^\n]*\n', '') || chr(10) || 'Edited line.' ELSE text END"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')"



def _only(a: str, b: str) -> str:
    return f"array_to_string(list_transform(list_filter(list_transform({a}, lambda x, i: CASE WHEN list_position({a}, x) = i AND NOT list_contains({b}, x) THEN substr(x, 1, 200) END), lambda x: x IS NOT NULL)[1:50], lambda x: x), '|')"


def _headings(kinds: str) -> str:
    """Parts of the documents that the lines of kind 2, and those of kind 1 after more than two lines, begin."""
    return f"""WITH l AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, string_split(text, chr(10)) AS lines, list_transform(string_split(text, chr(10)), lambda x: {_trim('x')}) AS bare FROM documents),
k AS (SELECT *, {kinds} AS kind FROM l),
s AS (SELECT *, list_reduce(list_concat([[0]], list_transform(range(1, len(lines) + 1), lambda i: [i])), lambda acc, x: CASE WHEN kind[x[1]] = 2 OR kind[x[1]] = 1 AND x[1] - 1 - acc[len(acc)] > 2 THEN list_concat(acc, [x[1] - 1]) ELSE acc END) AS starts FROM k),
p AS (SELECT path, j, CASE WHEN j > 1 THEN CASE WHEN kind[starts[j] + 1] = 2 THEN regexp_extract(bare[starts[j] + 1], '^(?s:#+{_SPACE}+(.+))$', 1) ELSE bare[starts[j] + 1] END END AS heading,
  {_trim("array_to_string(lines[starts[j] + 1 : coalesce(starts[j + 1], len(lines))], chr(10))")} AS content FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS j FROM s))
SELECT path AS document_path, (row_number() OVER (PARTITION BY path ORDER BY j) - 1)::INT AS chunk_index, heading, """


_MARK = f"regexp_full_match(x, '(?s)#{{1,6}}{_SPACE}+.+')"
_PLAIN_KINDS = f"""list_transform(bare, lambda x, i: CASE WHEN x = '---' OR len(list_filter(bare[1:i], lambda y: y = '---')) % 2 = 1 THEN 0 WHEN {_MARK} THEN 2
  WHEN regexp_matches(x, '^\\d+(\\.\\d+)*{_SPACE}+[A-Z]') OR length(x) > 2 AND length(x) < 120 AND x = upper(x) AND regexp_matches(x, '[A-Z]([A-Z]|{_SPACE}){{2,}}') THEN 1 ELSE 0 END)"""
_MARKDOWN_KINDS = f"""list_transform(bare, lambda x, i: CASE WHEN bare[1] = '---' AND (len(list_filter(bare[1:i], lambda y: y = '---')) < 2 OR x = '---') THEN 0 WHEN {_MARK} THEN 2 ELSE 0 END)"""

_RULE_SQL = _SPACE[:-1] + "|:-]+"
_GAP_SQL = _SPACE + "{2,}"


def _without(html: str, *tags: str) -> str:
    for tag in tags:
        html = f"regexp_replace({html}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    return html


_BODY = _without("regexp_replace(html, '(?is)<!--.*?-->', '', 'g')", "script", "style", "nav", "footer", "header", "iframe", "noscript", "head")
_UNESCAPED = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')"
_BOOSTED = f"score * (1 + 0.2::DOUBLE * len(held) + coalesce(CASE WHEN gap < 500 THEN 0.3::DOUBLE * (1 - gap / 500.0::DOUBLE) END, 0) + CASE WHEN contains(t, '{LICENSE_QUERY}') THEN 0.4::DOUBLE ELSE 0 END)"


SQL = {
    "table_extract": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
g AS (SELECT *, coalesce(length(x) >= 40 AND (n >= 2 OR CASE WHEN n > 0 THEN 15.0 * n ELSE 20.0 * len(regexp_extract_all(x, ' +')) END / length(x) > 0.6), FALSE) AS good FROM (SELECT *, {_trim('line')} AS x, length(line) - length(replace(line, '|', '')) AS n FROM l)),
b AS (SELECT doc_id, min(i) AS first, list(line ORDER BY i) AS lines FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, good ORDER BY i) AS block FROM g) WHERE good GROUP BY doc_id, block HAVING count(*) >= 3),
p AS (SELECT *, list_filter(lines, lambda x: contains(x, '|')) AS piped FROM b),
r AS (SELECT doc_id, first, len(piped) >= 2 AS pipes, CASE WHEN len(piped) >= 2 THEN list_transform(list_filter(piped, lambda x: NOT regexp_full_match(x, '{_RULE_SQL}')), lambda x: list_filter(list_transform(string_split(x, '|'), lambda c: {_trim('c')}), lambda c: c <> ''))
  ELSE list_transform(lines, lambda x: regexp_split_to_array({_trim('x')}, '{_GAP_SQL}')) END AS rows FROM p),
m AS (SELECT *, list_sort(list_transform(rows, lambda r: len(r)))[len(rows) // 2 + 1] AS middle FROM r)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS table_index, coalesce(array_to_string(rows[1], '|'), '') AS headers,
  array_to_string(list_transform(list_filter(rows[2:], lambda r: pipes OR len(r) >= middle - 1), lambda r: array_to_string(r, '|')), chr(10)) AS rows FROM m WHERE pipes OR middle >= 2""",
    "chunk_by_heading": _headings(_PLAIN_KINDS) + "content FROM p WHERE content <> ''",
    "chunk_by_heading_markdown": _headings(_MARKDOWN_KINDS) + "md5(content) AS digest FROM p WHERE content <> ''",
    "search_reranked": "WITH " + _windows(1500, 1300) + ", " + _bm25("c", "chunk_id", "content", f"SELECT 0::BIGINT AS query_id, '{LICENSE_QUERY}' AS query", 10)
    + f""", t AS (SELECT key, score, path, chunk_index, lower(content) AS t, list_filter(string_split('{LICENSE_QUERY}', ' '), lambda w: contains(lower(content), w)) AS held FROM found JOIN c ON key = chunk_id),
g AS (SELECT *, list_sort(flatten(list_transform(held, lambda w: list_filter(range(1, length(t) + 1), lambda i: substr(t, i, length(w)) = w)))) AS p FROM t),
b AS (SELECT *, list_min(list_transform(range(2, len(p) + 1), lambda i: p[i] - p[i - 1])) AS gap FROM g)
SELECT key AS chunk_id, round({_BOOSTED}, 6) AS score, row_number() OVER (ORDER BY round({_BOOSTED}, 6) DESC, path, chunk_index)::INT AS rank FROM b QUALIFY rank <= 5""",
    "search_vector": "WITH " + _windows(1500, 1300) + f", v AS ({_NEAREST.format('vec_id = 0', 20)}) SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, v.rank)::INT AS rank FROM v JOIN c ON chunk_id = lpad(vec_id::VARCHAR, 12, '0') || '#00000000' QUALIFY row_number() OVER (ORDER BY score DESC, v.rank) <= 10",
    "search_hybrid": "WITH " + _windows(1500, 1300) + ", " + _bm25("c", "chunk_id", "content", _ONE, 30)
    + f""", v AS (SELECT lpad(vec_id::VARCHAR, 12, '0') || '#00000000' AS id, rank FROM ({_NEAREST.format('vec_id = 0', 30)})), f AS (SELECT coalesce(key, id) AS chunk_id, round(coalesce(0.5::DOUBLE / (60 + found.rank), 0) + coalesce(0.5::DOUBLE / (60 + v.rank), 0), 8) AS score, coalesce(found.rank, 2147483647) AS a, coalesce(v.rank, 2147483647) AS b FROM found FULL JOIN v ON key = id),
h AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b, chunk_id) AS place FROM f QUALIFY place <= 10)
SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY h.score DESC, place)::INT AS rank FROM h JOIN c USING (chunk_id)""",
    "library_lifecycle": f"""WITH d AS (SELECT doc_id::VARCHAR AS path, text, {_EDIT} AS n FROM documents)
SELECT path, length(n) AS size, CASE WHEN n <> text THEN 2 ELSE 1 END::INT AS versions, TRUE AS counted FROM d WHERE path <> '7'""",
    "html_text": rf"SELECT page_id, trim(regexp_replace({_UNESCAPED.format("regexp_replace(" + _BODY + ", '(?s)<[^>]*>', '', 'g')")}, '{_SPACE}+', ' ', 'g'), ' ') AS content FROM pages",
    "detect_format": r"""SELECT page_id, CASE e WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'xlsx' THEN 'xlsx' WHEN 'pptx' THEN 'pptx' ELSE CASE WHEN e IN ('png','jpg','jpeg','tiff','tif','bmp','gif','webp') THEN 'image' ELSE 'txt' END END AS format,
regexp_matches(url, '^\s*(?i:https?):/*[^/\s]') AS is_url, e IN ('md','markdown','html','htm','pdf','docx','xlsx','pptx','png','jpg','jpeg','tiff','tif','bmp','gif','webp','txt','csv','json','log','xml') AS supported
FROM (SELECT page_id, url, lower(regexp_extract(url, '[^/.][^/]*\.([^./]*)$', 1)) AS e FROM pages)""",
    "chunk_sliding": "WITH " + _windows(1500, 1300) + " SELECT path AS document_path, chunk_index, md5(content) AS digest, length(content)::INT AS n_chars FROM c",
    "term_stats": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len({_TOKENS.format('text')})), 6) AS avgdl FROM documents",
    "remove_document_stats": f"SELECT count(*) AS n, round(avg(len({_TOKENS.format('text')})), 6) AS avgdl FROM documents WHERE source <> 'src0'",
    "bm25_top": _bm25("documents", "doc_id", "text", _ONE, 10, prefix="WITH ") + " SELECT key AS doc_id, score, rank FROM found",
    "bm25_batch": _bm25("documents", "doc_id", "text", _BENCH, 5, prefix="WITH ") + " SELECT query_id, key AS doc_id, score, rank FROM found",
    "bm25_conversations": _bm25("documents", "doc_id", "text", "SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'", 3, prefix="WITH ") + " SELECT query_id, key AS doc_id, score, rank FROM found",
    "bm25_chunks": "WITH " + _windows(1500, 1300) + ", " + _bm25("c", "chunk_id", "content", _ONE, 10) + " SELECT key AS chunk_id, score, rank FROM found",
    "vector_top": f"SELECT vec_id, score, rank FROM ({_NEAREST.format('vec_id = 0', 10)})",
    "vector_batch": _NEAREST.format("vec_id % 20 = 0", 5),
    "vector_grid": _NEAREST.format("vec_id % 20 = 0", 5),
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "hybrid_rrf": _bm25("documents", "doc_id", "text", _ONE, 30, prefix="WITH ")
    + f""", v AS ({_NEAREST.format('vec_id = 0', 30)}), f AS (SELECT coalesce(key, vec_id) AS id, round(coalesce(0.5::DOUBLE / (60 + found.rank), 0) + coalesce(0.5::DOUBLE / (60 + v.rank), 0), 8) AS score, coalesce(found.rank, 2147483647) AS a, coalesce(v.rank, 2147483647) AS b FROM found FULL JOIN v ON key = vec_id)
SELECT id, score, row_number() OVER (ORDER BY score DESC, a, b, id)::INT AS rank FROM f QUALIFY rank <= 10""",
    "search_filter_after": "WITH " + _windows(1500, 1300) + ", " + _bm25("c", "chunk_id", "content", _ONE, 20) + " SELECT key AS chunk_id, score, row_number() OVER (ORDER BY score DESC, rank)::INT AS rank FROM found JOIN c ON key = chunk_id WHERE lang = 'en' AND source = 'src3' ORDER BY rank LIMIT 10",
    "search_filter_before": "WITH " + _windows(1500, 1300) + ", " + _bm25("c", "chunk_id", "content", _ONE, 10, "key IN (SELECT chunk_id FROM c WHERE lang = 'en' AND source = 'src3')") + " SELECT key AS chunk_id, score, rank FROM found",
    "table_candidates": f"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trim('x')}), lambda x: length(x) >= 40 AND (length(x) - length(replace(x, '|', '')) >= 2 OR CASE WHEN contains(x, '|') THEN 15.0 * (length(x) - length(replace(x, '|', ''))) ELSE 20.0 * len(regexp_extract_all(x, ' +')) END / length(x) > 0.6))) AS n_lines FROM documents",
    "html_links": r"SELECT page_id, 0 AS position, regexp_extract(url, '^https?://[^/]+') || '/next/' || page_id AS link FROM pages WHERE contains(regexp_replace(html, '(?is)<(script|style|nav|footer|header)\b.*?</(script|style|nav|footer|header)\s*>', '', 'g'), '</p>')",
    "html_title": r"SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), chr(9) || chr(10) || chr(13) || ' '), ''), url) AS title FROM (SELECT page_id, url, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', ''''), '&amp;', '&') AS html FROM pages)",
    "dedupe_exact": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "upsert_changed": f"SELECT doc_id::VARCHAR AS path, length(n) AS n_chars FROM (SELECT doc_id, text, {_EDIT} AS n FROM documents) WHERE n <> text",
    "document_diff": f"SELECT path, 1 AS version_a, 2 AS version_b, {_only('b', 'a')} AS additions, {_only('a', 'b')} AS removals FROM (SELECT doc_id::VARCHAR AS path, {_lines('text')} AS a, {_lines(_EDIT)} AS b FROM documents)",
    "ask_context": _ASKED + " SELECT query_id, md5(string_agg('[' || rank || '] ' || path || chr(10) || substr(content, 1, 2000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest, count(*) AS n_sources FROM found JOIN c ON key = chunk_id WHERE rank <= 5 GROUP BY query_id",
    "fallback_answer": _ASKED + " SELECT query_id, 'Found ' || count(*) || ' relevant chunks. Top match from ' || arg_min(path, rank) || ':' || chr(10) || chr(10) || substr(arg_min(content, rank), 1, 800) || chr(10) || chr(10) || 'Configure a language model to get an answer.' AS answer FROM found JOIN c ON key = chunk_id WHERE rank <= 5 GROUP BY query_id",
    "agentic_sources": _ASKED + " SELECT key AS chunk_id, arg_min(query_id, (query_id, rank)) AS sub, arg_min(rank, (query_id, rank)) AS rank, arg_max(score, (query_id, rank)) AS score FROM found WHERE rank <= 3 GROUP BY key",
    "schema_batches": "WITH " + _windows(4000, 4000) + " SELECT path, (chunk_index // 3)::INT AS batch, count(*) AS n_excerpts, md5(string_agg(content, '|' ORDER BY chunk_index)) AS digest FROM c GROUP BY ALL",
    "export_rows": "WITH " + _windows(1500, 1300) + ", " + _bm25("c", "chunk_id", "content", _ONE, 100) + " SELECT path AS document, NULL::VARCHAR AS heading, md5(substr(content, 1, 2000)) AS digest, score FROM found JOIN c ON key = chunk_id",
    "snippets": "SELECT doc_id, replace(substr(text, 1, 200), chr(10), ' ') || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS snippet FROM documents",
    "watch_ingest": "SELECT doc_id // 100 AS part, sum(coalesce(length(text), 0) + 1)::BIGINT AS size FROM documents GROUP BY part",
    "highlights_overlapping": """WITH c AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark),
m AS (SELECT item_id, i, substr(text, i, 1) AS ch, list_bool_or(list_transform(range(0, 3), lambda d: i > d AND lower(substr(text, i - d, 3)) IN ('the', 'hen', 'her', 'ere', 'ing', 'ngs'))) AS hit FROM c),
e AS (SELECT *, coalesce(lag(hit) OVER w, false) AS before, coalesce(lead(hit) OVER w, false) AS after FROM m WINDOW w AS (PARTITION BY item_id ORDER BY i))
SELECT item_id, string_agg(CASE WHEN hit AND NOT before THEN '<mark>' ELSE '' END || ch || CASE WHEN hit AND NOT after THEN '</mark>' ELSE '' END, '' ORDER BY i) AS marked FROM e GROUP BY item_id""",
    "highlights": "SELECT item_id, regexp_replace(text, '(?i)((?:thing|and|the)+)', '<mark>\\1</mark>', 'g') AS marked FROM benchmark",
    "rerank_boost": """SELECT item_id, round(0.2::DOUBLE * (contains(t, 'the')::INT + contains(t, 'of')::INT + contains(t, 'and')::INT) + coalesce(CASE WHEN g < 500 THEN 0.3::DOUBLE * (1 - g / 500.0::DOUBLE) END, 0) + CASE WHEN contains(t, 'the of and') THEN 0.4::DOUBLE ELSE 0 END, 6) AS boost
FROM (SELECT item_id, t, list_min(list_transform(range(2, len(p) + 1), lambda i: p[i] - p[i - 1])) AS g FROM (SELECT item_id, lower(text) AS t, list_sort(list_filter(list_concat(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN substr(lower(text), i, 3) = 'the' THEN i END), list_transform(range(1, length(text) + 1), lambda i: CASE WHEN substr(lower(text), i, 2) = 'of' THEN i END), list_transform(range(1, length(text) + 1), lambda i: CASE WHEN substr(lower(text), i, 3) = 'and' THEN i END)), lambda x: x IS NOT NULL)) AS p FROM benchmark))""",
}

SQL["bm25_blocks"] = SQL["bm25_batch"]

QUERIES = {
    f.__name__: f
    for f in (
        detect_format, chunk_sliding, chunk_by_heading, chunk_by_heading_markdown, term_stats, corpus_stats, bm25_top, bm25_batch, bm25_conversations, bm25_chunks, bm25_blocks,
        vector_top, vector_batch, vector_grid, vector_approximate, cosine_pairs, hybrid_rrf, search_filter_after, search_filter_before, search_reranked, rerank_boost, table_candidates, table_extract,
        html_text, html_title, html_links, dedupe_exact, upsert_changed, document_diff, remove_document_stats, ask_context, fallback_answer, agentic_sources,
        schema_batches, export_rows, snippets, highlights, highlights_overlapping, search_vector, search_hybrid, library_lifecycle, watch_ingest,
    )
}
