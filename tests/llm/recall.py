"""Recall of near duplicates on whole tables: python -m tests.llm.recall FOLDER...

The texts of all documents whose id is divisible by 20 are held against all texts of the table through an inverted index
of all their labelled shingles, without sketches, prefixes or parities. Pairs that share enough are aligned; each link found is to be
within one class of `neardup.digest`. One line of JSON for each folder.
"""

from __future__ import annotations

import json
import sys
import time
from multiprocessing import Pool

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from lectern.llm import neardup
from lectern.llm.common import table
from lectern.llm.tokens import Remembered

held: dict = {}


def cut(texts: list[str]) -> list[np.ndarray]:
    known = Remembered(neardup.word_hash)
    return [neardup.shingles(t, known) for t in texts]


def links_of(queries: list[int]) -> list[tuple[int, int]]:
    shingles, sizes, values, owners = (held[k] for k in ("shingles", "sizes", "values", "owners"))
    out = []
    for q in queries:
        own = neardup.labels(shingles[q])
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        shared = np.bincount(np.concatenate([owners[a:b] for a, b in zip(low, high, strict=True)]), minlength=len(sizes))
        enough = shared >= neardup.SIMILARITY / (1 + neardup.SIMILARITY) * (sizes + sizes[q]) - 1e-9
        out += [(q, int(k)) for k in np.flatnonzero(enough) if k != q and neardup.aligned(shingles[q], shingles[k])]
    return out


def measure(spark: SparkSession, folder: str) -> dict:
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    ids, texts = docs["doc_id"].to_pylist(), [t or "" for t in docs["text"].to_pylist()]
    number: dict[str, int] = {}
    of = [number.setdefault(t, len(number)) for t in texts]
    different = list(number)
    with Pool(8) as pool:
        parts = pool.map(cut, [different[a : a + 1000] for a in range(0, len(different), 1000)])
    shingles = [h for part in parts for h in part]
    sizes = np.array([len(h) for h in shingles])
    values = np.concatenate([neardup.labels(h) for h in shingles])
    order = np.argsort(values)
    held.update(shingles=shingles, sizes=sizes, values=values[order], owners=np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order])
    queries = sorted({k for i, k in zip(ids, of, strict=True) if i % 20 == 0})
    with Pool(8) as pool:  # forked: the index is shared
        links = [x for part in pool.map(links_of, [queries[a::200] for a in range(200)], 1) for x in part]
    held.clear()
    began = time.perf_counter()
    found = {r["doc_id"]: r["class_id"] for r in neardup.digest(table(spark, folder, "documents")).toArrow().to_pylist()}
    classes = {k: found[i] for i, k in zip(ids, of, strict=True)}
    lost = sorted((a, b) for a, b in links if classes[a] != classes[b])
    return {"folder": folder, "texts": len(different), "queries": len(queries), "links": len(links), "lost": len(lost), "first lost": lost[:5], "seconds": round(time.perf_counter() - began, 1)}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "32").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[1:]:
        print(json.dumps(measure(session, name)), flush=True)
    session.stop()
