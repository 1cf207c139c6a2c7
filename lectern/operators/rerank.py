"""Re-ranking by the query's words in the text: which occur, how near, and as a phrase."""

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import top

WORD_BONUS, NEAR_BONUS, NEAR_WITHIN, PHRASE_BONUS = 0.2, 0.3, 500, 0.4


def boost(query: Column, content: Column) -> Column:
    """What is added to 1 before the score is multiplied: for each word (white space between, longer than
    one character, repeats counted) found anywhere; for the smallest gap between any two places, down
    from 0.3 to nothing at 500; and if the words stand together with single spaces."""
    words = F.filter(F.split(F.lower(query), r"[\s\x{a0}\x{feff}]+"), lambda w: F.length(w) > 1)
    text = F.lower(content)
    held = F.filter(words, lambda w: F.contains(text, w))
    # Texts are split before every place of a held word, so the lengths of the inner pieces are the gaps.
    quoted = F.array_join(F.transform(held, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    pieces = F.split(text, F.concat(F.lit("(?="), quoted, F.lit(")")))
    skipped = F.when(F.exists(held, lambda w: F.startswith(text, w)), 0).otherwise(1)
    inner = F.slice(pieces, skipped + 1, F.greatest(F.size(pieces) - 1 - skipped, F.lit(0)))
    at_once = F.size(F.filter(held, lambda w: F.size(F.filter(held, lambda v: F.startswith(v, w))) > 1)) > 0  # repeated words, and beginnings of others
    gap = F.when(F.size(held) == 0, None).when(at_once, 0).otherwise(F.array_min(F.transform(inner, F.length)))
    near = F.when(gap < NEAR_WITHIN, F.lit(NEAR_BONUS) * (F.lit(1.0) - gap / F.lit(float(NEAR_WITHIN)))).otherwise(0.0)
    phrase = F.when((F.size(words) > 0) & F.contains(text, F.array_join(words, " ")), PHRASE_BONUS).otherwise(0.0)
    return F.lit(WORD_BONUS) * F.size(held) + F.coalesce(near, F.lit(0.0)) + phrase


class Reranker(Protocol):
    """Takes results (query_id, query, content, score, place and the chunk's columns), gives the k best of each query with a new score and rank."""

    def __call__(self, results: DataFrame, k: int, *ties: str) -> DataFrame: ...


def rerank(results: DataFrame, k: int, *ties: str, query: str = "query", content: str = "content") -> DataFrame:
    """`results` (query_id, query, content, score) by score * (1 + boost). A query without words leaves its scores as they are."""
    scored = results.withColumn("score", F.col("score") * (F.lit(1.0) + boost(F.col(query), F.coalesce(F.col(content), F.lit("")))))
    return top(scored.drop("rank") if "rank" in scored.columns else scored, k, *ties)
