"""Reciprocal rank fusion of two result lists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top

DAMPING = 60


def fuse(lexical: DataFrame, vector: DataFrame, k: int, alpha: float = 0.5, key: str = "chunk_id") -> DataFrame:
    """Both lists have query_id, <key>, rank. Rows of one list only stay, with nothing from the other side, even at an alpha that gives them 0."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    share = lambda rank, weight: F.coalesce(F.lit(float(weight)) / (F.lit(float(DAMPING)) + F.col(rank)), F.lit(0.0))
    left = lexical.select("query_id", key, F.col("rank").alias("lexical_rank"))
    right = vector.select("query_id", key, F.col("rank").alias("vector_rank"))
    both = left.join(right, ["query_id", key], "full_outer")
    scored = both.withColumn("score", share("lexical_rank", 1 - alpha) + share("vector_rank", alpha))
    far = F.lit(2**31 - 1)
    ordered = scored.withColumn("by_lexical", F.coalesce("lexical_rank", far)).withColumn("by_vector", F.coalesce("vector_rank", far))
    return top(ordered, k, "by_lexical", "by_vector", key, digits=8).drop("by_lexical", "by_vector")
