"""Provider calls that resume: no text is sent twice, a failing batch alone is lost."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import calls
from lectern.plans.library import Library

from .test_library_index import docs


class Recording:
    """An embedder that writes down what it is sent, and fails on a word while a file says so."""

    dimensions, model = 2, "recording"

    def __init__(self, folder):
        self.folder = str(folder)

    def embed(self, texts):
        import os

        with open(f"{self.folder}/sent", "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if os.path.exists(f"{self.folder}/broken") and any("bad" in t for t in texts):
            raise OSError("out of order")
        return [[float(len(t)), 1.0] for t in texts]

    def sent(self):
        try:
            with open(f"{self.folder}/sent") as f:
                return f.read().split("\n")[:-1]
        except FileNotFoundError:
            return []


def asked(spark, rows):
    return spark.createDataFrame(rows, "id int, text string")


def held(df):
    return sorted((r.id, r.result[0]) for r in df.collect())


def test_resumes(spark, tmp_path):
    provider, store = Recording(tmp_path), f"file://{tmp_path}/store"
    ask = lambda rows: calls.answered(asked(spark, rows), "text", "m", provider.embed, "array<float>", store, batch=2, at_once=3, tries=2, pause=0.01)
    rows = [(i, f"text {i % 7}") for i in range(20)] + [(20, None)]
    assert held(ask(rows)) == sorted((i, float(len(t or ""))) for i, t in rows)
    assert sorted(provider.sent()) == sorted({t or "" for _, t in rows})
    assert held(ask(rows)) == sorted((i, float(len(t or ""))) for i, t in rows) and len(provider.sent()) == 8
    (tmp_path / "broken").touch()
    more = [(100 + i, f"other {i}") for i in range(9)] + [(200, "bad")]
    before = len(provider.sent())
    with pytest.raises(calls.Failed, match="out of order"):
        ask(more)
    lost = 10 - spark.read.parquet(store).count() + 8
    assert 1 <= lost <= 2  # the batch that fails, sent twice
    assert len(provider.sent()) - before == 10 + lost
    (tmp_path / "broken").unlink()
    before = len(provider.sent())
    assert len(held(ask(more))) == 10 and len(provider.sent()) - before == lost
    other = calls.answered(asked(spark, rows[:1]), "text", "another model", provider.embed, "array<float>", store)
    assert held(other) == [(0, 6.0)] and len(provider.sent()) - before == lost + 1
    assert held(ask([])) == []


def test_a_library_embeds_each_text_once(spark, tmp_path):
    provider = Recording(tmp_path)
    library = Library(spark, f"file://{tmp_path}/index", embedder=provider)
    library.add(docs(spark, {"a": "one text", "b": "one text", "c": "two"}))
    library.add(docs(spark, {"a": "two", "d": "one text"}))
    assert sorted(provider.sent()) == ["one text", "two"]
    got = {r.document_path: r.embedding[0] for r in library.table("embeddings").join(library.table("chunks").select("chunk_id", "document_path"), "chunk_id").collect()}
    assert got == {"a": 3.0, "b": 8.0, "c": 3.0, "d": 8.0}
    library.configure(mode="vector")
    assert library.search("x", 4).where(F.col("document_path") == "c").count() == 1


def test_providers_by_name(spark, tmp_path):
    from lectern.operators import answers, vectors

    library = Library(spark, f"file://{tmp_path}/index", embedder=("hashing", {"dimensions": 8}), model=("service", {"url": "http://localhost", "model": "m"}))
    assert library.embedder.dimensions == 8 and library.model.name == "m" and Library(spark, f"file://{tmp_path}/index").embedder is None
    with pytest.raises(ValueError, match="no such provider: other; there are hashing, service"):
        Library(spark, f"file://{tmp_path}/index", embedder="other")
    before = dict(answers.MODELS), dict(vectors.EMBEDDERS)
    vectors.register("mine", lambda: Recording(tmp_path))
    assert Library(spark, f"file://{tmp_path}/index", embedder="mine").embedder.model == "recording"
    vectors.EMBEDDERS.pop("mine")
    assert (dict(answers.MODELS), dict(vectors.EMBEDDERS)) == before
