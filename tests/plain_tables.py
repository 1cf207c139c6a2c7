"""Tables of a text, line by line in Python: what the expressions are held against."""

import re
from itertools import groupby

from lectern.functions.text import SPACES
from lectern.operators.tables import LEAST_LENGTH, LEAST_RATIO, MARKER

_GAP = re.compile(f"[{SPACES}]{{2,}}")
_RULE = re.compile(f"[{SPACES}|:-]+")

Table = dict[str, list]


def is_candidate(line: str) -> bool:
    bare = line.strip(SPACES)
    if len(bare) < LEAST_LENGTH:
        return False
    pipes = bare.count("|")
    ratio = 15 * pipes / len(bare) if pipes else 20 * len(re.findall(" +", bare)) / len(bare)
    return pipes >= 2 or ratio > LEAST_RATIO


def read_block(lines: list[str]) -> Table | None:
    """A run of candidate lines -> a table: split at pipes if two lines have one, else at wide gaps."""
    if len(lines) < 3:
        return None
    piped = [line for line in lines if "|" in line]
    if len(piped) >= 2:
        rows = [[c for x in line.split("|") if (c := x.strip(SPACES))] for line in piped if not _RULE.fullmatch(line)]
        return {"headers": rows[0] if rows else [], "rows": rows[1:]}
    rows = [_GAP.split(line.strip(SPACES)) for line in lines]
    middle = sorted(map(len, rows))[len(rows) // 2]
    return {"headers": rows[0], "rows": [r for r in rows[1:] if len(r) >= middle - 1]} if middle >= 2 else None


def find_tables(text: str) -> list[Table]:
    blocks = (list(lines) for good, lines in groupby(text.split("\n"), is_candidate) if good)
    return [t for b in blocks if (t := read_block(b)) is not None]


def to_markdown(table: Table) -> str:
    if not table["headers"] and not table["rows"]:
        return ""
    rows = [table["headers"], ["---"] * len(table["headers"]), *table["rows"]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def with_tables(text: str) -> str:
    """The text, and after it a marker and its tables in Markdown, if it has any."""
    found = find_tables(text)
    if not found:
        return text
    return f"{text}\n\n{MARKER}\n\n" + "\n\n".join(m for t in found if (m := to_markdown(t)))
