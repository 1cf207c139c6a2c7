"""python -m lectern.cli COMMAND …: index, search, ask, diff, extract, watch over an index folder."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession

from .config import Config
from .functions.text import snippet
from .operators import export
from .plans.library import Library


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    parser.add_argument("--index", required=True, help="folder of the index")
    parser.add_argument("--model", help="module:function that makes a language model")
    parser.add_argument("--embedder", help="module:function that makes an embedder")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for a in arguments:
            sub.add_argument(a)
        return sub

    index = command("index")
    index.add_argument("paths", nargs="+")
    index.add_argument("--metadata", type=json.loads, default={}, help="a JSON object")
    index.add_argument("--strategy", default="sliding-window")
    index.add_argument("--size", type=int, default=1500)
    index.add_argument("--overlap", type=int, default=200)
    for name in ("search", "ask"):
        sub = command(name, "query")
        sub.add_argument("-k", type=int, default=10 if name == "search" else 5)
        sub.add_argument("--filter", type=json.loads, default={}, help="a JSON object")
        sub.add_argument("--mode", default="bm25")
        sub.add_argument("--alpha", type=float, default=0.5)
        sub.add_argument("--rerank", action="store_true")
        sub.add_argument("--hyde", action="store_true")
        sub.add_argument("--json", action="store_true")
    commands.choices["search"].add_argument("--csv", help="folder to export to, as CSV")
    commands.choices["ask"].add_argument("--multi", action="store_true", help="plan sub-questions")
    command("diff", "path")
    command("remove", "path")
    command("stats")
    fields = command("extract")
    fields.add_argument("fields", nargs="+", help="name[:type[:description]]")
    command("watch", "path").add_argument("--once", action="store_true")
    return parser


def field(text: str) -> dict:
    name, kind, description = (*text.split(":", 2), "", "")[:3]
    return {"name": name, "type": kind or "string", "description": description}


def _made(place: str | None):
    if not place:
        return None
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> object:
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    chosen = {k: getattr(a, k) for k in ("strategy", "size", "overlap", "mode", "alpha", "rerank", "hyde") if hasattr(a, k)}
    library = Library(spark, a.index, Config(**chosen), _made(a.embedder), _made(a.model))
    if a.command == "index":
        out = vars(library.index(a.paths, a.metadata))
    elif a.command == "search":
        found = library.search(a.query, a.k, a.filter)
        if a.csv:
            export.write_csv(found, a.csv)
        out = [r.asDict() for r in found.orderBy("rank").select("rank", "score", "document_path", "heading", snippet(found["content"]).alias("snippet")).collect()]
    elif a.command == "ask":
        out = library.research(a.query) if a.multi else library.ask(a.query, a.k, a.filter)
    elif a.command == "diff":
        row = library.diff(a.path).first()
        out = row.asDict() if row else None
    elif a.command == "remove":
        out = library.remove(a.path)
    elif a.command == "stats":
        out = library.stats()
    elif a.command == "extract":
        out = [r.asDict() for r in library.extract_schema([field(f) for f in a.fields]).collect()]
    else:
        library.watch(a.path, lambda done: print(json.dumps(vars(done))), a.once).awaitTermination()
        out = library.stats()
    if a.command == "search" and not a.json:
        for r in out:
            print(f"{r['rank']}. [{r['score']:.2f}] {r['document_path']}" + (f" > {r['heading']}" if r["heading"] else "") + f"\n   {r['snippet']}")
    else:
        print(json.dumps(out, indent=2, ensure_ascii=False))
    return out


if __name__ == "__main__":
    main()
