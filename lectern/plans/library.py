"""The library: a catalog of documents, chunks, postings, versions and embeddings as Parquet tables.

A change writes one generation: a folder with its new rows only and the paths that it replaces or removes
(`gone`), and then a mark. Readers scan the marked generations as one table, without the rows of paths that a
later generation names; a failed change leaves nothing half done. The cost of a change is that of what changes;
`compact`, by itself after `MOST_GENERATIONS`, writes what is live as one generation. Reads are lazy DataFrames;
a search also runs small jobs over its queries' terms and the heads of their blocks.

Statistics merge: a generation holds the change of each term's number of chunks, of the number of chunks and of their
total length, with what its replaced paths had taken off. Sums over the marked generations, at most `MOST_GENERATIONS` rows
a term and no chunk, give what a search needs.

Several writers may work at once. A writer stages its tables, claims the next number by creating a file that must not be
there yet, waits for lower numbers to be settled, and looks at what they changed: if that touches its own paths,
it gives its number up and makes its change anew; else it moves its tables into place and settles its number. A number
that stays unsettled for `PATIENCE` seconds is given up for its writer, which then can't settle it any more.
"""

from __future__ import annotations

import tempfile
import time
import uuid
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config, provider
from ..functions.text import is_url
from ..operators import answers, blockmax, cells, chunking, lexical, tables, vectors, versions
from ..operators.literals import among, fetched
from ..sources import files, remote
from . import search as searching

TABLES = {"documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "postings": schemas.POSTINGS, "versions": schemas.VERSIONS, "embeddings": schemas.EMBEDDINGS}
#: What a generation holds. Beside the columns above: a chunk's number of terms, the document of a row, a text's digest.
#: Postings are stored as blocks; `terms` and `totals` are changes of statistics.
STORED = {
    "documents": schemas.DOCUMENTS,
    "chunks": schemas.CHUNKS + ", dl bigint",
    "blocks": "term string, block bigint, peaks array<struct<tf:bigint,dl:bigint>>, hits array<struct<chunk_id:string,tf:bigint,dl:bigint,document_path:string>>",
    "versions": schemas.VERSIONS + ", digest string",
    "embeddings": schemas.EMBEDDINGS + ", document_path string",
    "gone": "path string",
    "terms": "term string, df bigint",
    "totals": "n bigint, length bigint",
}
#: The column that names a row's document, in the tables that lose rows.
PATHS = {"documents": "path", "chunks": "document_path", "postings": "document_path", "embeddings": "document_path"}
#: Parquet settings of tables that are read by key: bloom filters of the keys, and small pages.
KEYED = {"chunks": {"parquet.bloom.filter.enabled#chunk_id": "true", "parquet.bloom.filter.enabled#document_path": "true", "parquet.page.row.count.limit": "64"}, "blocks": blockmax.WRITE_OPTIONS}
MOST_GENERATIONS = 32
#: Seconds after which a number that its writer hasn't settled is given up, and times that a change is made anew.
PATIENCE, RETRIES = 600, 20
#: Most errors of one batch that are given back one by one; `failed` counts all.
MOST_ERRORS = 1000


class Conflict(Exception):
    """Another writer changed the same paths meanwhile."""


@dataclass(frozen=True)
class Indexed:
    documents: int
    chunks: int
    failed: int
    time: int
    errors: tuple[tuple[str, str], ...] = ()
    missing: tuple[str, ...] = ()


class Library:
    def __init__(self, spark: SparkSession, path: str | None = None, config: Config | None = None, embedder: vectors.Embedder | str | tuple[str, dict] | None = None, model: answers.LanguageModel | str | tuple[str, dict] | None = None, fetch: files.Fetch | None = None, extractors: dict[str, files.Extractor] | None = None, ocr: files.Ocr | None = None, reranker: searching.Reranker | None = None):
        embedder, model = provider(embedder, vectors.EMBEDDERS), provider(model, answers.MODELS)  # by name: see `register` there
        self.spark, self.config, self.embedder, self.model, self.fetch, self.ocr, self.reranker = spark, config or Config(), embedder, model, fetch or remote.Get(), ocr, reranker
        self.own_extractors = extractors
        self.path = (path or spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lectern-")).rstrip("/") + ("" if path else f"/library-{time.time_ns()}")
        self.watches: list = []

    # generations of tables

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        """The marked generations that count, ascending: the last complete one and those after it."""
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(p))
        there = sorted(int(n[11:]) for n in names if n.startswith("generation-") and n[11:].isdigit())
        marked = [n for n in there if fs.exists(self._fs(f"{self.path}/generation-{n}/_DONE")[0])]
        whole = [n for n in marked if fs.exists(self._fs(f"{self.path}/generation-{n}/_WHOLE")[0])]
        return [n for n in marked if n >= max(whole, default=0)]

    def generation(self) -> int:
        return max(self._generations(), default=0)

    def _scan(self, name: str, generations: list[int]) -> DataFrame | None:
        """The table's rows of all these generations in one scan, with their generation."""
        fs = self._fs(self.path)[1]
        found = [p for n in generations if fs.exists(self._fs(p := f"{self.path}/generation-{n}/{name}")[0])]
        if not found:
            return None
        number = F.regexp_extract("_metadata.file_path", r"/generation-(\d+)/", 1).cast("long")
        return self.spark.read.schema(STORED[name]).parquet(*found).select("*", number.alias("generation"))

    def _live(self, name: str, generations: list[int] | None = None) -> DataFrame:
        """The table's stored columns without the rows of paths that a later generation replaces or removes."""
        generations = self._generations() if generations is None else generations
        rows = self._scan("blocks" if name == "postings" else name, generations)
        if rows is None:
            return self.spark.createDataFrame([], STORED[name] if name in STORED else schemas.POSTINGS + ", document_path string")
        if name == "postings":
            rows = rows.select("term", F.explode("hits").alias("hit"), "generation").select("term", "hit.*", "generation")
        return self._without_gone(rows, generations, PATHS.get(name)).drop("generation")

    def _without_gone(self, rows: DataFrame, generations: list[int], path: str | None) -> DataFrame:
        """Rows (with their generation) whose document no later generation replaces or removes."""
        gone = self._scan("gone", generations) if path else None
        if gone is None:
            return rows
        last = gone.groupBy(F.col("path").alias("gone_path")).agg(F.max("generation").alias("gone_at"))
        return rows.join(last, (F.col(path) == F.col("gone_path")) & (F.col("generation") < F.col("gone_at")), "left_anti")

    def table(self, name: str, generations: list[int] | None = None) -> DataFrame:
        return self._live(name, generations).select(*schemas.names(TABLES[name]))

    # commits

    def _create(self, path: str, text: str = "") -> bool:
        """Creates a file unless it is there; whether it did. File systems do this in one step."""
        p, fs = self._fs(path)
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _numbers(self, folder: str) -> list[int]:
        p, fs = self._fs(f"{self.path}/{folder}")
        return sorted(int(n) for f in (fs.listStatus(p) if fs.exists(p) else []) if (n := f.getPath().getName()).isdigit())

    def _settle(self, number: int, done: bool) -> bool:
        """Settles a number as done or given up, unless that has been done; whether it did."""
        return self._create(f"{self.path}/settled/{number}", "done" if done else "void")

    def _wait(self, number: int) -> None:
        """Until `number` is settled; gives it up for its writer after PATIENCE."""
        began = time.monotonic()
        while number not in self._numbers("settled"):
            if time.monotonic() - began > PATIENCE:
                self._settle(number, False)
            time.sleep(0.05)
        place = f"{self.path}/generation-{number}"
        p, fs = self._fs(f"{self.path}/settled/{number}")
        began = time.monotonic()
        while not fs.getFileStatus(p).getLen() and time.monotonic() - began < 5:  # its one word is being written
            time.sleep(0.05)
        if fs.getFileStatus(p).getLen() and self.spark.read.text(f"{self.path}/settled/{number}").first()[0] == "done":
            if fs.exists(self._fs(place)[0]):  # or a later whole one has replaced it
                self._create(f"{place}/_DONE")  # its writer may have died before this last step

    def _touched(self, place: str) -> DataFrame:
        """path: the documents that a generation's tables add, replace or remove."""
        fs = self._fs(place)[1]
        parts = [self.spark.read.schema(STORED[n]).parquet(f"{place}/{n}").select("path") for n in ("documents", "gone") if fs.exists(self._fs(f"{place}/{n}")[0])]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], "path string")

    def _write(self, new: dict[str, DataFrame], place: str) -> None:
        for name, df in new.items():
            df = df.select(*schemas.names(STORED[name]))
            if name == "chunks":
                df = df.sortWithinPartitions("chunk_id")
            elif name == "terms":
                df = df.sortWithinPartitions("term")
            df.write.options(**KEYED.get(name, {})).parquet(f"{place}/{name}")

    def _commit(self, new: dict[str, DataFrame], base: list[int], whole: bool = False) -> None:
        """Writes a generation that was made of the generations `base`; a `whole` one replaces all before it. Raises Conflict
        if another one that touches its paths, or any if it is a whole one, came between."""
        stage = f"{self.path}/stage-{uuid.uuid4().hex}"
        p, fs = self._fs(stage)
        fs.mkdirs(p)
        try:
            self._write(new, stage)
            if whole:
                fs.create(self._fs(f"{stage}/_WHOLE")[0]).close()
            number = max([*self._numbers("claims"), *base], default=0) + 1
            while not self._create(f"{self.path}/claims/{number}"):
                number += 1
            before = max(base, default=0)
            for other in self._numbers("claims"):
                if before < other < number:
                    self._wait(other)
            between = [n for n in self._generations() if before < n < number]
            mine = self._touched(stage)
            fs_whole = any(fs.exists(self._fs(f"{self.path}/generation-{n}/_WHOLE")[0]) for n in between)
            if between and (whole or fs_whole or any(not mine.join(self._touched(f"{self.path}/generation-{n}"), "path", "left_semi").isEmpty() for n in between)):
                self._settle(number, False)
                raise Conflict(f"generations {between} came between")
            place = f"{self.path}/generation-{number}"
            fs.rename(p, self._fs(place)[0])
            if not self._settle(number, True):  # given up for us
                fs.delete(self._fs(place)[0], True)
                raise Conflict(f"number {number} was given up")
            self._create(f"{place}/_DONE")
        finally:
            fs.delete(p, True)
        if whole:  # what came before the last whole one is no longer read by anyone
            for n in range(1, min(base, default=1)):
                for left in (f"generation-{n}", f"claims/{n}", f"settled/{n}"):
                    fs.delete(self._fs(f"{self.path}/{left}")[0], True)
        elif len(base) >= MOST_GENERATIONS:
            self.compact()

    def _again(self, change: Callable[[], object]):
        """Makes a change, anew for each conflict."""
        for _ in range(RETRIES):
            try:
                return change()
            except Conflict as e:
                last = e
        raise last

    def compact(self) -> None:
        """Writes all live rows as one generation, unless another writer comes between."""
        at = self._generations()
        n, _ = self._totals(at)
        merged = {name: self._live(name, at) for name in ("documents", "chunks", "versions", "embeddings")}
        merged["blocks"] = blockmax.indexed(self._live("chunks", at), n, others=("document_path",))
        merged |= {"terms": self._frequencies(at).where("df <> 0"), "totals": self._summed(at)}
        try:
            self._commit(merged, at, whole=True)
        except Conflict:
            pass  # the next change tries again

    # statistics

    def _summed(self, generations: list[int]) -> DataFrame:
        """One row: n, length."""
        rows = self._scan("totals", generations)
        rows = self.spark.createDataFrame([], STORED["totals"]) if rows is None else rows
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))

    def _totals(self, generations: list[int]) -> tuple[int, float | None]:
        """The number of live chunks and their mean length in terms."""
        n, length = self._summed(generations).first()
        return n, length / n if n else None

    def _frequencies(self, generations: list[int], asked: DataFrame | None = None) -> DataFrame:
        """term, df over live chunks: of all terms, or of the asked ones."""
        rows = self._scan("terms", generations)
        if rows is None:
            return self.spark.createDataFrame([], STORED["terms"])
        if asked is not None:
            some, found = fetched(asked.select("term").distinct())
            rows = rows.where(among("term", [r["term"] for r in found])) if found is not None else rows.join(some, "term", "left_semi")
        return rows.groupBy("term").agg(F.sum("df").alias("df"))

    def _changes(self, added: DataFrame | None, gone: DataFrame, generations: list[int]) -> dict[str, DataFrame]:
        """The statistics of added chunks (content, dl) less those of the live chunks of the paths in `gone`."""
        gone, few = fetched(gone)
        old = self._live("chunks", generations)
        if few is not None:  # by name, so that bloom filters leave other row groups unread
            old = old.where(among("document_path", [r["path"] for r in few]))
        old = old.join(gone.select(F.col("path").alias("document_path")), "document_path", "left_semi").select("content", "dl", F.lit(-1).alias("sign"))
        both = old if added is None else old.unionByName(added.select("content", "dl", F.lit(1).alias("sign")))
        counted = cells.frequencies(both, "content", "sign")
        totals = both.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).cast("long").alias("length"))
        return {"terms": counted, "totals": totals}

    def _ranked(self, generations: list[int]) -> searching.Ranked:
        """Searches the blocks of these generations."""

        def search(queries: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
            index = self._scan("blocks", generations)
            if index is None:
                index = self.spark.createDataFrame([], STORED["blocks"] + ", generation bigint")
            n, mean = self._totals(generations)

            def alive(rows: DataFrame) -> DataFrame:
                rows = self._without_gone(rows, generations, "document_path")
                return rows if allowed is None else rows.join(allowed, "chunk_id", "left_semi")

            return blockmax.search(index, queries, n, mean, self._frequencies(generations, lexical.query_terms(queries)), k, ranges=("generation", "block"), alive=alive)

        return search

    # ingest

    def _extracted(self, inputs: Iterable[str]) -> tuple[DataFrame, list[str]]:
        inputs = list(inputs)
        urls = [i for i in inputs if i.lower().startswith(("http://", "https://"))]
        found, missing = files.scan(self.spark, [i for i in inputs if i not in urls])
        out = files.extract(found, self.extractors)
        if urls:
            out = out.unionByName(files.extract_pages(files.fetched(self.spark.createDataFrame([(u,) for u in urls], "url string"), self.fetch)))
        return out, missing

    @property
    def extractors(self) -> dict[str, files.Extractor]:
        """The extractors in use; `ocr` reads images, and with the setting also scanned PDFs."""
        out = dict(self.own_extractors or files.EXTRACTORS)
        if self.ocr:
            out["image"] = files.image_reader(self.ocr)
            if self.config.ocr:
                out["pdf"] = files.with_ocr(out["pdf"], self.ocr)
        return out

    def index(self, inputs: str | Iterable[str], metadata: dict | None = None) -> Indexed:
        extracted, missing = self._extracted([inputs] if isinstance(inputs, str) else inputs)
        return self.add(extracted, metadata, missing)

    def index_pages(self, pages: DataFrame, metadata: dict | None = None) -> Indexed:
        """Fetched pages (url, html)."""
        return self.add(files.extract_pages(pages), metadata)

    def add(self, extracted: DataFrame, metadata: dict | None = None, missing: Iterable[str] = ()) -> Indexed:
        """Adds extracted documents that are new or changed; chunks' metadata are the given ones, overlaid by the extractor's."""
        began = time.time()
        stage = f"{self.path}/stage-{uuid.uuid4().hex}"  # every text is extracted once
        try:
            extracted = self._staged(extracted, f"{stage}/extracted")
            return self._again(lambda: self._add(extracted, metadata, missing, f"{stage}/{uuid.uuid4().hex}", began))
        finally:
            p, fs = self._fs(stage)
            fs.delete(p, True)

    def _add(self, extracted: DataFrame, metadata: dict | None, missing: Iterable[str], stage: str, began: float) -> Indexed:
        failed = extracted.where("error IS NOT NULL").select("path", "error")
        n_failed = failed.count()
        errors = tuple((r["path"], r["error"]) for r in failed.limit(MOST_ERRORS).collect())
        generations = self._generations()
        versions_now = self._live("versions", generations)
        known = versions_now.join(self.table("documents", generations).select("path"), "path", "left_semi")
        new = self._staged(versions.changed(extracted.where("error IS NULL"), known), f"{stage}/new")
        done = lambda documents, chunks: Indexed(documents, chunks, n_failed, round(1000 * (time.time() - began)), errors, tuple(missing))
        count = new.count()
        if not count:
            return done(0, 0)
        given = F.create_map(*(F.lit(x) for k, v in metadata.items() for x in (k, searching.json_value(v)))) if metadata else F.create_map().cast(schemas.METADATA)
        own = F.coalesce("metadata", F.create_map().cast(schemas.METADATA))
        merged = F.map_concat(F.map_filter(given, lambda k, _: ~F.map_contains_key(own, k)), own)
        now = round(time.time() * 1000)
        texts = new.select("path", "format", tables.augmented(F.col("content")).alias("content"), merged.alias("metadata"))
        cut = chunking.chunk(texts, self.config.strategy, self.config.size, self.config.overlap)
        chunks = self._staged(cut.withColumn("dl", cells.lengths(F.col("content"))), f"{stage}/chunks")
        counts = chunks.groupBy(F.col("document_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        size = F.coalesce(F.try_element_at("metadata", F.lit("size")).cast("long"), F.length("content").cast("long"))
        documents = new.join(counts, "path", "left").select("path", "format", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), size.alias("size"), F.lit(now).cast("long").alias("indexed_at"), given.alias("metadata"))
        of_chunk = chunks.select("chunk_id", "document_path")
        total = chunks.count()
        gone = known.select("path").distinct().join(new.select("path"), "path", "left_semi")
        changes = {
            "gone": gone,
            "documents": documents,
            "chunks": chunks,
            "blocks": blockmax.indexed(chunks, total, others=("document_path",)),
            "versions": versions.next_versions(versions_now, new, F.lit(now)).withColumn("digest", F.sha2("content", 256)),
        }
        if self.embedder:
            changes["embeddings"] = vectors.embed(chunks, self.embedder, f"{self.path}/embedded").join(of_chunk, "chunk_id")
        self._commit(changes | self._changes(chunks, gone, generations), generations)
        return done(count, total)

    def _staged(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, path: str) -> bool:
        """Forgets a document; its versions stay. False if it isn't there."""

        def change() -> bool:
            at = self._generations()
            if self.table("documents", at).where(F.col("path") == path).isEmpty():
                return False
            gone = self.spark.createDataFrame([(path,)], STORED["gone"])
            self._commit({"gone": gone} | self._changes(None, gone, at), at)
            return True

        return self._again(change)

    def clear(self) -> None:
        self._again(lambda: self._commit({}, self._generations(), whole=True))

    # reads

    def stats(self) -> dict[str, int]:
        return {"documents": self.table("documents").count(), "chunks": self.table("chunks").count()}

    def documents(self) -> DataFrame:
        return self.table("documents")

    def document(self, path: str) -> DataFrame:
        return self.table("documents").where(F.col("path") == path)

    def diff(self, path: str) -> DataFrame:
        """One row of the path's last two versions' differences, or none if there aren't two."""
        return versions.diff(self.table("versions").where(F.col("path") == path))

    def configure(self, **changes) -> Config:
        """Changes the given fields only; what is indexed stays as it is."""
        self.config = self.config.replace(**changes)
        return self.config

    def _queries(self, queries: str | list[str] | DataFrame) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries
        rows = [(i, q) for i, q in enumerate([queries] if isinstance(queries, str) else queries)]
        if self.config.hyde and self.model:
            rows = [(i, answers.hypothetical(q, self.model)) for i, q in rows]
        if self.embedder and self.config.mode != "bm25":
            return self.spark.createDataFrame([(i, q, [float(x) for x in v]) for (i, q), v in zip(rows, self.embedder.embed([q for _, q in rows]), strict=True)], "query_id int, query string, vector array<double>")
        return self.spark.createDataFrame(rows, "query_id int, query string")

    def search(self, queries: str | list[str] | DataFrame, k: int = 10, wanted: dict | None = None) -> DataFrame:
        at = self._generations()
        return searching.search(self.table("chunks", at), self._queries(queries), k, wanted, self.config, embeddings=self.table("embeddings", at) if self.embedder else None, reranker=self.reranker, ranked=self._ranked(at))

    def ask(self, question: str, k: int = 5, wanted: dict | None = None) -> dict:
        """answer, sources, time. Without a model: the best match in words."""
        began = time.time()
        found = self.search(question, k, wanted).persist()
        try:
            rows = answers.contexts(found).collect()
            if not rows:
                return {"answer": answers.NOTHING_FOUND, "sources": [], "time": round(1000 * (time.time() - began))}
            if self.model:
                answer = self.model.generate(f"Excerpts:\n\n{rows[0]['context']}\n\nQuestion: {question}", answers.SYSTEM)
            else:
                answer = answers.fallbacks(found).first()["answer"]
        finally:
            found.unpersist()
        return {"answer": answer, "sources": [s.asDict() for s in rows[0]["sources"]], "time": round(1000 * (time.time() - began))}

    def research(self, question: str, k: int = 3) -> dict:
        """Answers by sub-questions that the model plans, each searched in the same job."""
        if not self.model:
            return self.ask(question, max(k, 5))
        began = time.time()
        parts = answers.plan_questions(question, self.model)
        found = self.search(parts, k).persist()
        try:
            return self._researched(question, parts, found, began)
        finally:
            found.unpersist()

    def _researched(self, question: str, parts: list[str], found: DataFrame, began: float) -> dict:
        held = {r["query_id"]: r["context"] for r in answers.contexts(found, answers.PLAN_CHARS).collect()}
        context = answers.SEPARATOR.join(f"{q}\n{held[i]}" for i, q in enumerate(parts) if i in held)
        sources = answers.union_sources(found.withColumnRenamed("query_id", "sub")).orderBy("sub", "rank").select("document_path", "score", F.substring("content", 1, answers.SOURCE_CHARS).alias("content"), "heading").collect()
        try:
            answer = self.model.generate(f"Excerpts:\n\n{context}\n\nQuestion: {question}", answers.SYSTEM)
        except Exception as e:  # the best match is an answer as well
            warnings.warn(f"the model failed: {e}", stacklevel=2)
            answer = (answers.fallbacks(found).first() or {"answer": answers.NOTHING_FOUND})["answer"]
        return {"answer": answer, "sources": [s.asDict() for s in sources], "questions": parts, "time": round(1000 * (time.time() - began))}

    def extract_schema(self, fields: list[dict], paths: list[str] | None = None, null_overwrites: bool = True) -> DataFrame:
        """path, fields of the documents' last versions."""
        if not self.model:
            raise ValueError("schema extraction needs a language model")
        last = self.table("versions").groupBy("path").agg(F.max_by("content", "version").alias("content"))
        last = last.join(self.table("documents").select("path"), "path", "left_semi")
        return answers.extract_fields(last.where(F.col("path").isin(paths)) if paths is not None else last, fields, self.model, null_overwrites=null_overwrites)

    # watching

    def watch(self, path: str, then: Callable[[Indexed], None] | None = None, once: bool = False):
        from ..streaming.watch import watch

        self.watches.append(watch(self, path, then, once))
        return self.watches[-1]

    def unwatch(self) -> None:
        for q in self.watches:
            q.stop()
        self.watches.clear()


__all__ = ["Indexed", "Library", "is_url"]
