"""Calls of outside providers that are made once: results are kept by what was asked, and a run goes on where another broke off.

What is asked is named by a digest of the model's name and the text. Known digests are joined away before any call; each
other text is asked once, however many rows have it, in batches, by a bounded number of tasks. A batch that fails is tried
again with growing pauses, and is then reported without stopping the others; what the others gave is written, so the
next run asks for the failed batch alone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts in one call, tasks that call at once, tries of a batch, and the first pause between them in seconds.
BATCH, AT_ONCE, TRIES, PAUSE = 20, 8, 4, 0.5


class Failed(RuntimeError):
    """Some batches failed; what the others gave is kept."""


def asked(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\n"), F.coalesce(text, F.lit(""))), 256)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def answered(rows: DataFrame, text: str, model: str, call: Callable[[list[str]], list], kind: str, store: str, batch: int = BATCH, at_once: int = AT_ONCE, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """`rows` with `result` (of the SQL type `kind`): what `call` gives for `text`, kept in the table `store`.

    Raises Failed if a batch fails at its last try, after the others' results are written. A null text is asked as an empty one."""
    spark, schema = rows.sparkSession, f"digest string, result {kind}"
    keyed = rows.withColumn("digest", asked(model, F.col(text)))
    missing = keyed.select("digest", F.coalesce(text, F.lit("")).alias("asked"))
    if _there(spark, store):
        missing = missing.join(spark.read.schema(schema).parquet(store).select("digest"), "digest", "left_anti")
    missing = missing.dropDuplicates(["digest"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                for n in range(tries):
                    try:
                        got = call(some["asked"].tolist())
                        if len(got) != len(some):
                            raise ValueError(f"{len(got)} results for {len(some)} texts")
                        yield pd.DataFrame({"digest": some["digest"], "result": got, "error": None})
                        break
                    except Exception as e:
                        if n + 1 == tries:  # this batch alone is lost
                            yield pd.DataFrame({"digest": some["digest"], "result": None, "error": f"{type(e).__name__}: {e}"})
                        else:
                            time.sleep(pause * 2**n)

    made = missing.repartition(at_once, "digest").mapInPandas(run, f"{schema}, error string")
    place = f"{store}-new-{uuid.uuid4().hex}"
    # One pass of calls: results and failures go to one table, of which the results then are the store's.
    made.withColumn("failed", F.col("error").isNotNull()).write.partitionBy("failed").parquet(place)
    got = spark.read.schema(f"{schema}, error string, failed boolean").parquet(place)
    got.where("NOT failed").select("digest", "result").write.mode("append").parquet(store)
    bad = got.where("failed").agg(F.count(F.lit(1)), F.first("error")).first()
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if bad[0]:
        raise Failed(f"{bad[0]} texts have no result, as of: {bad[1]}")
    return keyed.join(spark.read.schema(schema).parquet(store).dropDuplicates(["digest"]), "digest").drop("digest")
