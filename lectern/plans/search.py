"""One plan from a table of queries to ranked chunks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import fusion, lexical, vectors
from ..operators.literals import among, fetched
from ..operators.rerank import Reranker, rerank


#: A lexical search: (queries, k, the chunk ids that may be found, or None for all) -> query_id, chunk_id, score, rank.
Ranked = Callable[[DataFrame, int, "DataFrame | None"], DataFrame]
#: From found rows (chunk_id and others) to the chunks among which these are, made at less cost than all.
Holding = Callable[[DataFrame], DataFrame]
#: Most queries whose results (a few times k rows each) and texts are sent to every executor, and most found rows that pass the driver.
MOST_QUERIES, MOST_FOUND = 2000, 20_000


def json_value(value) -> str:
    """A filter's value as the metadata hold it: JSON, so that 1, "1" and true differ; 1.0 is 1."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def matches(wanted: dict | None, metadata: str = "metadata") -> Column:
    """All given keys are there with equal values of the same type; lists and objects never match, nor does null."""
    out = F.lit(True)
    for key, value in (wanted or {}).items():
        ok = value is not None and not isinstance(value, (list, dict))
        out = out & (F.coalesce(F.col(metadata)[key] == json_value(value), F.lit(False)) if ok else F.lit(False))
    return out


def search(chunks: DataFrame, queries: DataFrame, k: int = 10, wanted: dict | None = None, config: Config | None = None, index: DataFrame | None = None, stats: DataFrame | None = None, embeddings: DataFrame | None = None, reranker: Reranker | None = None, ranked: Ranked | None = None, holding: Holding | None = None) -> DataFrame:
    """query_id, query, rank, score and the chunk's columns: the k best chunks of each query.

    `queries` has query_id, query and, for the vector and hybrid modes, vector. `index` and `stats` are
    the postings and the corpus row of `chunks` if they are at hand; `ranked` searches an index of blocks in their place, and
    then `chunks` is a stored table, of which only the found rows are read. If chunks aren't stored, `holding` makes few found
    ones without making all again. With filter_stage "post" candidates
    (2k, or 3k of either side) are cut before the filter, so fewer than k may come back; "pre" filters first,
    with the statistics of the whole corpus. With config.rerank the candidates go to `reranker` (the words' own if none is given).
    """
    config = config or Config()
    if k < 1:
        raise ValueError("k must be at least 1")
    if config.mode != "bm25" and embeddings is None:
        raise ValueError(f"mode {config.mode} needs embeddings")
    pre = bool(wanted) and config.filter_stage == "pre"
    allowed = chunks.where(matches(wanted)).select("chunk_id") if pre else None
    keep = (lambda df: df.join(allowed, "chunk_id", "left_semi")) if pre else (lambda df: df)
    lexical_top = vector_top = None
    if config.mode != "vector" and ranked:
        lexical_top = ranked(queries, (3 if config.mode == "hybrid" else 2) * k, allowed)
    elif config.mode != "vector" and index is None:
        lexical_top = lexical.bm25(chunks, queries, (3 if config.mode == "hybrid" else 2) * k, findable=chunks.where(matches(wanted)) if pre else None)
    elif config.mode != "vector":
        scored = keep(lexical.scores(index, lexical.corpus_stats(chunks) if stats is None else stats, queries))
        lexical_top = lexical.top(scored, (3 if config.mode == "hybrid" else 2) * k, "chunk_id")
    if config.mode != "bm25":
        vector_top = vectors.nearest(keep(embeddings), queries, (3 if config.mode == "hybrid" else 2) * k)
    if config.mode == "hybrid":
        found = fusion.fuse(lexical_top, vector_top, k, config.alpha)
    else:
        found = lexical_top if vector_top is None else vector_top
    found = found.select("query_id", "chunk_id", "score", F.col("rank").alias("place"))
    if ranked:
        found, rows = fetched(found)
        if rows is not None:
            chunks = chunks.where(among("chunk_id", [r["chunk_id"] for r in rows]))
    few = queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES  # then so are the found rows, and chunks needn't move to them
    if holding and few and not ranked:
        found, rows = fetched(found, MOST_FOUND)
        chunks = chunks if rows is None else holding(found)
    rows = chunks.join(F.broadcast(found) if few else found, "chunk_id").join(F.broadcast(queries.select("query_id", "query")) if few else queries.select("query_id", "query"), "query_id")
    if wanted:
        rows = rows.where(matches(wanted))
    out = (reranker or rerank)(rows, k, "document_path", "chunk_index") if config.rerank else lexical.top(rows, k, "place", digits=8)
    return out.drop("place")
