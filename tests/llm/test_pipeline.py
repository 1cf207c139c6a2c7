import re
from collections import Counter

import corpus_pipeline

from .helpers import documents, edge_rows, prose


def test_stages(spark, tmp_path):
    rows = [(i, prose(i, 70), f"s{i % 3}") for i in range(60)] + [(100 + i, prose(i, 70), "s0") for i in range(10)] + [(200 + i, "short text", "s1") for i in range(5)]
    rows += [(300 + i, prose(300 + i, 70) + " you blockhead.", "s2") for i in range(30)]
    labels = [(i, 1, 0) for i in range(60)] + [(300 + i, 1, 1) for i in range(30)]
    sf_dir = f"file://{tmp_path}"
    documents(spark, rows).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{sf_dir}/{name.replace(' ', '_')}")
        seen.append(docs)
        if name != "packing":
            assert docs.columns == documents(spark, []).columns
    ids = [sorted(r[0] for r in d.select("doc_id").collect()) for d in seen]
    clean = [*range(60), *range(100, 110)]
    assert ids[0] == [*clean, *range(300, 330)]
    assert ids[1] == clean and ids[2] == [*range(60)]
    assert set(ids[3]) <= set(ids[2]) and 80 <= len(ids[3]) <= 100
    assert set(ids[4]) == set(ids[3])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(ids[4])


def test_stages_bear_edges(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for rows in (edge_rows(), []):
        docs = documents(spark, rows)
        found = {name: stage(spark, docs, f"file://{tmp_path}") for name, stage in corpus_pipeline.STAGES}
        for name, out in list(found.items())[:-1]:
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        ids = {name: sorted(Counter(r.doc_id for r in out.collect()).items(), key=str) for name, out in found.items()}
        all_ids = sorted(Counter(i for i, _, _ in rows).items(), key=str)
        assert [i for i, _ in ids["quality rules"]] == ([5, 7, None] if rows else [])  # short ones and repeats go
        assert ids["toxicity"] == all_ids  # no labels: none goes
        assert ids["near duplicates"] == ([(1, 1), *((i, 1) for i in (4, 5, 6, 7, 8)), (None, 1)] if rows else [])
        assert all(n <= 2 * dict(all_ids)[i] for i, n in ids["mixing"]) and (not rows or 4 in dict(ids["mixing"]))
        assert {i: n for i, n in ids["packing"] if i != 7} == {i: n for i, n in all_ids if i != 7}  # one piece for each but the long one


def test_shape():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5 and all(re.fullmatch(r"[a-z -]+", n) for n in names)
