"""Text of office files, from their zipped XML, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from ..functions.text import SPACES


def _name(element) -> str:
    return element.tag.rpartition("}")[2]


def docx(data: bytes) -> tuple[str, dict]:
    """Paragraphs, each followed by a blank line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    paragraphs = ["".join((e.text or "") if _name(e) == "t" else marks.get(_name(e), "") for e in p.iter()) for p in root.iter() if _name(p) == "p"]
    return "".join(f"{p}\n\n" for p in paragraphs), {"size": len(data), "warnings": []}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(data: bytes) -> tuple[str, dict]:
    """Each sheet with rows: a line with its name, then its rows that aren't blank, cells between tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _name(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _name(si) == "si"]
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _name(e) == "sheet"]
        parts, sheets = [], []
        for sheet in book:
            target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            sheets.append(sheet.get("name"))
            rows = []
            for row in (e for e in root.iter() if _name(e) == "row"):
                cells: list[str] = []
                for c in (e for e in row if _name(e) == "c"):
                    value = next((e.text or "" for e in c if _name(e) == "v"), "")
                    if c.get("t") == "s":
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(e.text or "" for e in c.iter() if _name(e) == "t")
                    elif c.get("t") == "b":
                        value = "true" if value == "1" else "false"
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells)) + [value]
                rows.append("\t".join(cells))
            rows = [r for r in rows if r.strip(SPACES)]
            if rows:
                parts.append("\n".join([f"--- Sheet: {sheet.get('name')} ---", *rows]))
    text = "\n\n".join(parts)
    return text, {"sheets": sheets, "size": len(text)}


def pptx(data: bytes, numeric_order: bool = True) -> tuple[str, dict]:
    """Slides' text; tags go with nothing in their place. Slides stand in the order of their numbers, or of their names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        names.sort(key=(lambda n: (int(re.search(r"\d+", n)[0]), n)) if numeric_order else None)
        slides = [re.sub(f"[{SPACES}]+", " ", re.sub("<[^>]+>", "", z.read(n).decode("utf-8"))).strip(" ") for n in names]
    return "\n\n".join(s for s in slides if s), {"slides": len(names), "size": len(data)}
