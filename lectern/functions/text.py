"""Text functions: Column to Column, and the plain versions that Python-side operators use.

Lengths and places count code points. White space is that of ECMAScript's trim and \\s.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, for Java regular expressions and as characters.
SPACE_CLASS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SPACES = "\t\n\x0b\x0c\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"

#: Extensions and their formats; others are plain text.
FORMATS = {
    "md": ["md", "markdown"],
    "html": ["html", "htm"],
    "pdf": ["pdf"],
    "docx": ["docx"],
    "xlsx": ["xlsx"],
    "pptx": ["pptx"],
    "image": ["png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif", "webp"],
}
PLAIN = ["txt", "csv", "json", "log", "xml"]


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(text, f"{SPACE_CLASS}+", " ")


def terms(text: Column) -> Column:
    """Lower-case words of letters a-z, digits, apostrophes and hyphens, of 2 to 49 characters, with repeats."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9'-]+", " "), " ")
    return F.filter(words, lambda t: (F.length(t) > 1) & (F.length(t) < 50))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def detect_format(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, found in FORMATS.items():
        out = out.when(extension(path).isin(found), F.lit(kind))
    return out.otherwise(F.lit("txt"))


def supported(path: Column) -> Column:
    return extension(path).isin([x for found in FORMATS.values() for x in found] + PLAIN)


def is_url(text: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(text, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):/*[^/\s]", 1)).isin("http", "https"), F.lit(False))


def snippet(text: Column, size: int = 200) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, size), "\n", " ")
    return F.when(F.length(text) > size, F.concat(cut, F.lit("..."))).otherwise(cut)


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def highlight(text: Column, query: str, mark: str = "mark") -> Column:
    """Marks each occurrence of the query's words of more than two characters, in any case, overlapping ones as well; runs that
    overlap or touch are marked as one.

    A sign is set before each occurrence by a pattern that takes no characters, so the k-th sign's place less k is where it is
    in the text; the places of all words together, sorted, are the runs, and the text is put together from its characters."""
    words = sorted({w for w in query.lower().split() if len(w) > 2})
    if not words:
        return text
    sign = next(chr(c) for c in range(1, 128) if not any(chr(c) in w for w in words))
    bare = F.replace(text, F.lit(sign), F.lit(" "))  # no word holds white space

    def covered(word: str) -> Column:
        quoted = "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        signed = F.split(F.regexp_replace(bare, f"(?iu)(?={quoted})", sign if sign not in "\\$" else "\\" + sign), "")
        at = F.filter(F.transform(signed, lambda c, i: F.when(c == sign, i).otherwise(-1)), lambda i: i >= 0)
        return F.flatten(F.transform(at, lambda i, k: F.sequence(i - k, i - k + len(word) - 1)))

    def built(chars: Column, hit: Column) -> Column:
        begins = F.filter(hit, lambda x, i: ~F.coalesce(F.get(hit, i - 1) == x - 1, F.lit(False)))
        ends = F.filter(hit, lambda x, i: ~F.coalesce(F.get(hit, i + 1) == x + 1, F.lit(False)))
        cut = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
        runs = F.zip_with(begins, ends, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))
        parts = let(runs, lambda r: F.concat(F.transform(r, lambda x, i: F.concat(cut(F.coalesce(F.get(r, i - 1)["e"], F.lit(0)), x["s"]), F.lit(f"<{mark}>"), cut(x["s"], x["e"]), F.lit(f"</{mark}>"))), F.array(cut(F.element_at(r, -1)["e"], F.size(chars)))))
        return F.array_join(parts, "")

    hits = F.array_sort(F.array_distinct(F.concat(*map(covered, words))))
    return F.when(text.isNull(), None).otherwise(let(hits, lambda hit: F.when(F.size(hit) == 0, text).otherwise(let(F.split(text, ""), lambda chars: built(chars, hit)))))
