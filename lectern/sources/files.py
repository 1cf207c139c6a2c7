"""Files to extracted documents."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import SPACES, detect_format, is_url, supported
from ..operators.literals import among
from . import html, office, pdf

#: A format's extractor takes a file's bytes and gives its text and metadata.
Extractor = Callable[[bytes], tuple[str, dict]]
#: Gives the words of a picture or of a scanned document.
Ocr = Callable[[bytes], str | None]
#: Gives a URL's text, alone or with its content type.
Fetch = Callable[[str], "str | tuple[str, str]"]
OCR_UNDER = 50
FILES = "path string, modificationTime timestamp, length long, content binary"


def headings(text: str) -> list[dict]:
    """Markdown headings of the top level of a text: # lines and underlined ones, not those in fenced code."""
    out, fence, before = [], None, ""
    for line in text.split("\n"):
        bare = line.strip(SPACES)
        mark = re.match(r"(`{3,}|~{3,})", bare)
        if fence:
            fence = None if mark and bare.startswith(fence) and not bare.strip(fence[0]) else fence
            before = ""
        elif mark:
            fence, before = mark[1], ""
        elif m := re.fullmatch(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t\r]*", line):
            out.append({"level": len(m[1]), "text": (m[2] or "").strip()})
            before = ""
        elif before and re.fullmatch(r"=+|-+", bare):
            out.append({"level": 1 if bare[0] == "=" else 2, "text": before})
            before = ""
        else:
            before = bare if not re.match(r"[>|*+-]|\d+[.)]\s|$", bare) else ""
    return out


def _text(data: bytes) -> tuple[str, dict]:
    text = data.decode("utf-8", "replace")
    return text, {"size": len(text)}


def _markdown(data: bytes) -> tuple[str, dict]:
    text = data.decode("utf-8", "replace")
    return text, {"headings": headings(text), "size": len(text)}


def _html(data: bytes) -> tuple[str, dict]:
    raw = data.decode("utf-8", "replace")
    found = html.read(raw)
    return found["content"], {"title": found["title"], "size": len(raw)}


def _missing(kind: str) -> Extractor:
    def fail(data: bytes):
        raise NotImplementedError(f"no extractor for {kind}; register one")

    return fail


#: Format -> extractor. Reading pictures needs a library of the user's choice: EXTRACTORS["image"] = ….
EXTRACTORS: dict[str, Extractor] = {"txt": _text, "md": _markdown, "html": _html, "docx": office.docx, "xlsx": office.xlsx, "pptx": office.pptx, "pdf": pdf.read, "image": _missing("image")}


def image_reader(ocr: Ocr) -> Extractor:
    """An extractor of pictures: what the OCR reads."""
    return lambda data: (ocr(data) or "", {"ocr": True, "size": len(data)})


def with_ocr(pdf: Extractor, ocr: Ocr) -> Extractor:
    """A PDF extractor that reads scans: a document of several pages and hardly any text gets the OCR's text if that is longer."""

    def read(data: bytes) -> tuple[str, dict]:
        text, metadata = pdf(data)
        if len(text.strip(SPACES)) < OCR_UNDER and metadata.get("pages", 0) > 1:
            other = ocr(data)
            if other and len(other) > len(text):
                return other, metadata | {"ocr": True}
        return text, metadata

    return read


def scan(spark: SparkSession, paths: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """(path, content bytes, modification time and length of each supported file, paths that aren't there).

    Directories are read as deep as they go. A single file also counts if it has no extension. Content is read only
    if it is asked for, and never moves: inputs within other inputs are left out by name before anything is read, so
    no file is there twice.
    """
    missing, folders, single = [], set(), set()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            missing.append(path)
            continue
        status = fs.getFileStatus(p)
        (folders if status.isDirectory() else single).add(status.getPath().toString().rstrip("/"))
    within = lambda path: any(path.startswith(f"{f}/") for f in folders)
    inputs = sorted(p for p in folders | single if not within(p))
    if not inputs:
        return spark.createDataFrame([], FILES), missing
    kept = supported(F.col("path")) | among("path", [p for p in single - folders if not re.search(r"[^/.][^/]*\.[^./]*$", p)])
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs).where(kept), missing


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """path, content bytes -> path, format, content, metadata (JSON values), error (else null)."""
    table = dict(extractors or EXTRACTORS)

    def run(frames):
        for frame in frames:
            rows = []
            for path, kind, data in zip(frame["path"], frame["format"], frame["content"], strict=True):
                try:
                    text, metadata = table[kind](data)
                    rows.append((path, kind, text, {k: json.dumps(v, ensure_ascii=False) for k, v in metadata.items()}, None))
                except Exception as e:  # one bad file doesn't fail the batch; it is reported
                    rows.append((path, kind, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "content", "metadata", "error"])

    return files.select("path", detect_format(F.col("path")).alias("format"), "content").mapInPandas(run, schemas.EXTRACTED)


def fetched(urls: DataFrame, fetch: Fetch, at_once: int = 64) -> DataFrame:
    """url, html, content_type, error of each URL, fetched by the workers, `at_once` tasks at most."""

    def run(frames):
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    got = fetch(url)
                    rows.append((url, *((got, None) if isinstance(got, str) else got), None))
                except Exception as e:  # one bad page doesn't fail the batch; it is reported
                    rows.append((url, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "html", "content_type", "error"])

    return urls.select("url").repartition(at_once).mapInPandas(run, "url string, html string, content_type string, error string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages (url, html and, if at hand, content_type and error) -> extracted documents."""
    kind = F.coalesce("content_type", F.lit("text/html")) if "content_type" in pages.columns else F.lit("text/html")
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    parsed = html.parse_pages(pages.select("url", "html", kind.alias("kind"), error.alias("error")).where(is_url(F.col("url"))))
    metadata = F.create_map(*(x for k, v in {"url": F.col("url"), "title": F.col("title"), "links": F.col("links"), "contentType": F.col("kind"), "charset": F.lit("utf-8")}.items() for x in (F.lit(k), _json(v))), F.lit("size"), F.length("content").cast("string"))
    return parsed.select(F.col("url").alias("path"), F.lit("url").alias("format"), "content", metadata.alias("metadata"), "error")


def _json(value):
    """A value as JSON text."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$|^\{$', "")
