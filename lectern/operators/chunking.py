"""Documents to chunks."""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, SPACES, let, trim

_SPACE = f"[{SPACES}]"
HEADING = re.compile(rf"(#{{1,6}}){_SPACE}+(.+)", re.DOTALL)
CAPITALS = re.compile(rf"[A-Z](?:[A-Z]|{_SPACE}){{2,}}")
NUMBERED = re.compile(rf"\d+(?:\.\d+)*{_SPACE}+[A-Z]")


def windows(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Array of overlapping windows, trimmed; a blank text has none."""
    if size > 0 and not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    if size <= 0:
        return F.array().cast("array<string>")
    # Texts are cut into pieces of a step in one pass, and a window is put together from the few that it covers, so that a long
    # text takes no longer than many short ones; the possessive quantifier takes no stack, whatever the characters.
    step = size - overlap
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}+"), F.lit(0))
    joined = lambda p, x, i: x if not overlap else F.substring(F.array_join(F.slice(p, i + 1, -(-size // step)), ""), 1, size)
    made = let(pieces, lambda p: F.transform(p, lambda x, i: trim(joined(p, x, i))))
    return F.when(text.rlike(f"[^{SPACE_CLASS[1:]}"), made).otherwise(F.array().cast("array<string>"))


def sections(text: str, markdown: bool) -> list[tuple[str | None, str]]:
    """(heading, content) of each part that a heading begins.

    Markdown: only # lines count, and none inside front matter, which is what stands between a first
    line --- and the next such line (all, if there's no next). Other texts: lines --- switch headings
    off and on again; besides # lines, lines in capitals and numbered lines begin a part if the part
    before them has more than two lines.
    """
    lines = text.split("\n")
    bare = [line.strip(SPACES) for line in lines]
    rules = [i for i, b in enumerate(bare) if b == "---"]
    if markdown:
        end = (rules[1] if len(rules) > 1 else len(lines)) if rules[:1] == [0] else -1
        open_ = [i > end for i in range(len(lines))]
    else:
        open_ = [b != "---" and n % 2 == 0 for b, n in zip(bare, accumulate(b == "---" for b in bare), strict=True)]
    begins: list[tuple[int, str]] = [(0, "")]
    for i, (b, ok) in enumerate(zip(bare, open_, strict=True)):
        if not ok:
            continue
        if m := HEADING.fullmatch(b):
            begins.append((i, m[2]))
        elif not markdown and i - begins[-1][0] > 2 and (NUMBERED.match(b) or (2 < len(b) < 120 and b == b.upper() and CAPITALS.search(b))):
            begins.append((i, b))
    ends = [i for i, _ in begins[1:]] + [len(lines)]
    parts = [(heading or None, "\n".join(lines[a:z]).strip(SPACES)) for (a, heading), z in zip(begins, ends, strict=True)]
    return [(h, c) for h, c in parts if c]


def section_arrays(text: Column, markdown: Column) -> Column:
    @F.pandas_udf("array<struct<heading:string,content:string>>")
    def run(texts: pd.Series, flags: pd.Series) -> pd.Series:
        return pd.Series([[{"heading": h, "content": c} for h, c in sections(t or "", bool(m))] for t, m in zip(texts, flags, strict=True)])

    return run(text, markdown)


def chunk_id(path: Column, index: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("#"), index.cast("string")), 256)


def chunk(docs: DataFrame, strategy: str = "sliding-window", size: int = 1500, overlap: int = 200) -> DataFrame:
    """path, format, content, other columns -> the other columns, chunk_id, document_path, document_format, content, chunk_index, heading."""
    others = [c for c in docs.columns if c not in ("path", "format", "content")]
    if strategy == "by-heading":
        made = F.transform(section_arrays(F.col("content"), F.col("format") == "md"), lambda x: F.struct(x["heading"].alias("heading"), x["content"].alias("content")))
    else:
        made = F.transform(windows(F.col("content"), size, overlap), lambda x: F.struct(F.lit(None).cast("string").alias("heading"), x.alias("content")))
    out = docs.select(*others, "path", "format", F.posexplode(made).alias("chunk_index", "part"))
    return out.select(chunk_id(F.col("path"), F.col("chunk_index")).alias("chunk_id"), F.col("path").alias("document_path"), F.col("format").alias("document_format"), "part.content", "chunk_index", "part.heading", *others)
