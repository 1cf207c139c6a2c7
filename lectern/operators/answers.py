"""Question answering over search results; language models are plug-ins."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.remote import ServiceModel
from .chunking import windows

NOTHING_FOUND = "No relevant documents found."
CONTEXT_CHARS, SOURCE_CHARS, FALLBACK_CHARS, PLAN_CHARS = 2000, 500, 800, 1500
SEPARATOR = "\n\n---\n\n"
SYSTEM = "Answer from the numbered excerpts alone. Cite the excerpts in square brackets. If they don't hold the answer, say so."


class LanguageModel(Protocol):
    name: str

    def generate(self, prompt: str, system: str | None = None) -> str: ...


#: Name -> maker of a language model; register your own.
MODELS: dict[str, object] = {"service": ServiceModel}


def register(name: str, maker) -> None:
    MODELS[name] = maker


def contexts(results: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, context (numbered excerpts in rank order) and sources of ranked results with document_path, heading, content, score."""
    title = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("document_path"), F.coalesce(F.concat(F.lit(" > "), F.col("heading")), F.lit("")))
    block = F.concat(title, F.lit("\n"), F.substring("content", 1, chars))
    source = F.struct("document_path", "score", F.substring("content", 1, SOURCE_CHARS).alias("content"), "heading")
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), source.alias("source"))))
    return results.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.array_join(F.transform("rows", lambda r: r["block"]), SEPARATOR).alias("context"), F.transform("rows", lambda r: r["source"]).alias("sources"))


def fallbacks(results: DataFrame) -> DataFrame:
    """query_id, answer: what is said without a language model."""
    first = F.min_by(F.struct("document_path", "heading", "content"), "rank")
    found = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    where = F.concat(F.col("first.document_path"), F.coalesce(F.concat(F.lit(" ("), F.col("first.heading"), F.lit(")")), F.lit("")))
    text = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" relevant chunks. Top match from "), where, F.lit(":\n\n"), F.substring("first.content", 1, FALLBACK_CHARS), F.lit("\n\nConfigure a language model to get an answer."))
    return found.select("query_id", text.alias("answer"))


def _unfenced(text: str):
    return json.loads(re.sub(r"^```[a-z]*\s*|\s*```$", "", text.strip()))


def plan_questions(question: str, model: LanguageModel) -> list[str]:
    """Two to four sub-questions; the question itself if the model's plan can't be used."""
    try:
        parts = _unfenced(model.generate(f"Split into 2 to 4 search questions, as a JSON array of strings: {question}"))
    except ValueError:
        return [question]
    return parts if isinstance(parts, list) and parts and all(isinstance(p, str) and p for p in parts) else [question]


def hypothetical(question: str, model: LanguageModel) -> str:
    """The question and a made-up passage that answers it, as text to search with; a failing model adds nothing."""
    try:
        return f"{question}\n{model.generate(f'Write a short passage that answers: {question}')}"
    except Exception as e:
        warnings.warn(f"the model failed: {e}", stacklevel=2)
        return question


def union_sources(results: DataFrame) -> DataFrame:
    """Results of sub-queries (sub, rank, chunk_id, …): each chunk once, at its first place, with its last values."""
    order = Window.partitionBy("chunk_id").orderBy("sub", "rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = [c for c in results.columns if c not in ("chunk_id", "sub", "rank")]
    out = results.withColumn("first", F.row_number().over(order)).select("chunk_id", "sub", "rank", "first", *(F.last(c).over(whole).alias(c) for c in values))
    return out.where("first = 1").drop("first")


def schema_batches(docs: DataFrame, key: str = "path", content: str = "content", size: int = 4000, per_batch: int = 3) -> DataFrame:
    """<key>, batch, excerpts: windows of a document, three in each prompt."""
    parts = docs.select(key, F.posexplode(windows(F.col(content), size, 0)).alias("i", "part"))
    grouped = parts.groupBy(key, F.floor(F.col("i") / per_batch).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("parts"))
    return grouped.select(key, "batch", F.transform("parts", lambda p: p["part"]).alias("excerpts"))


def extract_fields(docs: DataFrame, fields: list[dict], model: LanguageModel, key: str = "path", content: str = "content", null_overwrites: bool = True) -> DataFrame:
    """<key>, fields (map of JSON values) that the model reads from each document; later batches win."""
    wanted = "\n".join(f"- {f['name']} ({f.get('type', 'string')}): {f.get('description', '')}" for f in fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for excerpts in frame["excerpts"]:
                try:
                    got = _unfenced(model.generate("Read these fields as one JSON object:\n" + wanted + "\n\n" + SEPARATOR.join(excerpts)))
                    found.append(json.dumps(got) if isinstance(got, dict) else None)
                except ValueError:
                    found.append(None)
            yield pd.DataFrame({key: frame[key], "batch": frame["batch"], "found": found})

    @F.pandas_udf("map<string,string>")
    def merged(rows: pd.Series) -> pd.Series:
        out = []
        for texts in rows:
            held: dict[str, str] = {}
            for t in texts:
                held |= {k: json.dumps(v) for k, v in json.loads(t).items() if v is not None or null_overwrites or k not in held}
            out.append(held)
        return pd.Series(out)

    kind = docs.schema[key].dataType.simpleString()
    read = schema_batches(docs, key, content).mapInPandas(run, f"{key} {kind}, batch int, found string").where("found IS NOT NULL")
    ordered = read.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("batch", "found"))).alias("rows"))
    return ordered.select(key, merged(F.transform("rows", lambda r: r["found"])).alias("fields"))
