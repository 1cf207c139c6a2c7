"""Tables that stand as lines in plain text.

Lines that look like a table's form islands; an island of three lines or more is read as one table. All of it is
expressions over the array of a text's lines, in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, SPACES, let, trim

LEAST_LENGTH, LEAST_RATIO = 40, 0.6
MARKER = "<!-- extracted tables -->"
_GAP = SPACE_CLASS + "{2,}"
#: A text without pipes needs one of these for a wide gap within a line.
_GAPS = ["  ", *(c for c in SPACES if c not in " \n")]
_RULE = r"\A" + SPACE_CLASS[:-1] + r"|:-]+\z"


def _good(bare: Column) -> Column:
    """Whether a trimmed line looks like one of a table."""
    n = F.length(bare)
    pipes = n - F.length(F.replace(bare, F.lit("|"), F.lit("")))
    spaces = F.when(F.contains(bare, F.lit("  ")), F.regexp_count(bare, F.lit(" +"))).otherwise(n - F.length(F.replace(bare, F.lit(" "), F.lit(""))))
    by_gaps = 20.0 * spaces / n > LEAST_RATIO
    return F.when(n < LEAST_LENGTH, False).when(~F.contains(bare, F.lit("|")), by_gaps).otherwise((pipes >= 2) | (15.0 * pipes / n > LEAST_RATIO))


def _at_gaps(bare: Column) -> Column:
    """A trimmed line's parts between wide gaps. Most lines have none, which ASCII ones show without a pattern."""
    plain = F.length(bare) == F.octet_length(bare)
    for white in ("  ", "\t", "\r", "\x0b", "\x0c"):
        plain &= ~F.contains(bare, F.lit(white))
    return F.when(plain, F.array(bare)).otherwise(F.split(bare, _GAP))


def _islands(lines: Column) -> Column:
    """The runs of three or more candidates among trimmed lines, as arrays of lines."""

    def cut(good: Column) -> Column:
        places = lambda step: F.filter(F.transform(good, lambda g, i: F.when(g & ~F.coalesce(F.get(good, i + step), F.lit(False)), i)), lambda i: i.isNotNull())
        return F.zip_with(places(-1), places(1), lambda first, last: F.slice(lines, first + 1, last - first + 1))

    return F.filter(let(F.transform(lines, _good), cut), lambda block: F.size(block) >= 3)


def _read(lines: Column) -> Column:
    """An island -> (headers, rows): split at pipes if two lines have one, else at wide gaps; null if it isn't a table."""

    def table(rows: Column, kept: Column) -> Column:
        return F.struct(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")).alias("headers"), kept.alias("rows"))

    def piped(lines: Column) -> Column:
        cells = F.transform(F.filter(lines, lambda x: ~x.rlike(_RULE)), lambda x: F.filter(F.transform(F.split(x, "[|]"), trim), lambda c: c != ""))
        return let(cells, lambda rows: table(rows, F.filter(rows, lambda r, i: i > 0)))

    def gapped(rows: Column) -> Column:
        widths = F.array_sort(F.transform(rows, lambda r: F.size(r)))
        return let(F.get(widths, F.floor(F.size(rows) / 2).cast("int")), lambda middle: F.when(middle >= 2, table(rows, F.filter(rows, lambda r, i: (i > 0) & (F.size(r) >= middle - 1)))))

    with_pipe = F.filter(lines, lambda x: F.contains(x, F.lit("|")))
    by_gaps = let(F.transform(lines, _at_gaps), gapped)
    return let(with_pipe, lambda some: F.when(F.size(some) >= 2, piped(some)).otherwise(by_gaps))


def table_arrays(text: Column) -> Column:
    """The tables (headers, rows) of a text, in order; a null text has none."""
    bare = F.coalesce(text, F.lit(""))
    found = let(F.transform(F.split(bare, "\n"), trim), lambda lines: F.transform(_islands(lines), _read))
    possible = F.contains(bare, F.lit("|"))
    for gap in _GAPS:
        possible |= F.contains(bare, F.lit(gap))
    return F.when(possible, F.filter(found, lambda t: t.isNotNull())).otherwise(F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>>>"))


def to_markdown(table: Column) -> Column:
    """A table in Markdown; one without cells is empty."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.concat(F.array(table["headers"], F.array_repeat(F.lit("---"), F.size(table["headers"]))), table["rows"])
    return F.when((F.size(table["headers"]) == 0) & (F.size(table["rows"]) == 0), "").otherwise(F.array_join(F.transform(lines, line), "\n"))


def augmented(text: Column) -> Column:
    """The text (null: empty), and after it a marker and its tables in Markdown, if it has any."""
    bare = F.coalesce(text, F.lit(""))
    made = lambda found: F.array_join(F.filter(F.transform(found, to_markdown), lambda m: m != ""), "\n\n")
    return let(table_arrays(text), lambda found: F.when(F.size(found) == 0, bare).otherwise(F.concat(bare, F.lit(f"\n\n{MARKER}\n\n"), made(found))))


def extract_tables(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """<key>, table_index, headers, rows."""
    return docs.select(key, F.posexplode(table_arrays(F.col(content))).alias("table_index", "t")).select(key, "table_index", "t.headers", "t.rows")


def candidate_lines(text: Column) -> Column:
    """The lines of a text that look like a table's."""
    return F.filter(F.split(text, "\n"), lambda line: let(trim(line), _good))
