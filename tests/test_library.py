import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.operators.export import write_csv, write_json
from lectern.operators.vectors import HashingEmbedder
from lectern.plans.library import Library
from lectern.sources import files, html, office
from lectern.sources import folder as folder_source

SAMPLE = "Termination of this agreement needs notice.\nThe indemnification clause stays.\nPayment terms are thirty days.\n"
MARKDOWN = "# Sample Document\n\nIntro.\n\n## Termination\n\nA termination notice.\n\n## Indemnification\n\nAn indemnification.\n\n## Payment Terms\n\nThirty days.\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/sample.txt").write_text(SAMPLE)
    (tmp_path / "in/sample.md").write_text(MARKDOWN)
    (tmp_path / "in/skipped.bin").write_text("x")
    return tmp_path


def test_lifecycle(spark, folder):
    library = Library(spark, f"file://{folder}/index")
    first = library.index(str(folder / "in"), {"team": "law", "year": 2024})
    assert (first.documents, first.failed) == (2, 0) and library.stats() == {"documents": 2, "chunks": first.chunks}
    again = library.index(str(folder / "in"))
    assert (again.documents, again.chunks) == (0, 0)
    got = library.search("termination", 5).collect()
    assert got and "termination" in got[0].content.lower() and got[0].score > 0
    assert library.search("xyznonexistent").count() == 0
    assert library.search("termination", 5, {"year": 2024}).count() == len(got) and library.search("termination", 5, {"year": "2024"}).count() == 0
    (folder / "in/sample.txt").write_text(SAMPLE.replace("thirty", "sixty"))
    other = Library(spark, f"file://{folder}/index")  # a new process sees the change too
    assert other.index(str(folder / "in")).documents == 1 and other.stats()["documents"] == 2
    path = [r.path for r in other.documents().collect() if r.path.endswith(".txt")][0]
    row = other.diff(path).first()
    assert (row.version_a, row.version_b) == (1, 2) and row.additions == ["Payment terms are sixty days."] and row.removals == ["Payment terms are thirty days."]
    before = other.stats()
    assert other.remove(path) and not other.remove(path)
    assert other.search("sixty").count() == 0 and other.stats()["documents"] == 1
    other.index(str(folder / "in/sample.txt"))
    assert other.stats() == before
    other.clear()
    assert other.stats() == {"documents": 0, "chunks": 0}


def test_missing_and_bad_files(spark, folder):
    (folder / "in/bad.docx").write_bytes(b"no zip")
    library = Library(spark, f"file://{folder}/index")
    done = library.index([str(folder / "in"), str(folder / "nothing")])
    assert (done.documents, done.failed, done.missing) == (2, 1, (str(folder / "nothing"),)) and "bad.docx" in done.errors[0][0]


def test_headings_modes_and_answers(spark, folder):
    library = Library(spark, f"file://{folder}/index", Config(strategy="by-heading"), HashingEmbedder(32))
    library.index(str(folder / "in/sample.md"))
    top = library.search("termination notice", 2).first()
    assert top.heading == "Termination"
    for mode in ("vector", "hybrid"):
        library.configure(mode=mode)
        assert library.search("termination notice", 3).count() == 3
    library.configure(mode="bm25", rerank=True)
    answer = library.ask("termination notice")
    assert answer["answer"].startswith("Found ") and answer["sources"][0]["heading"] == "Termination"
    assert library.ask("zzzz")["sources"] == []

    class Model:
        name = "fixed"

        def generate(self, prompt, system=None):
            return '["termination", "payment"]' if prompt.startswith("Split") else "An answer [1]."

    library.model = Model()
    assert library.ask("termination")["answer"] == "An answer [1]."
    found = library.research("what about termination and payment?")
    assert found["questions"] == ["termination", "payment"] and len({s["content"] for s in found["sources"]}) == len(found["sources"])


def test_watch(spark, folder):
    seen = []
    library = Library(spark, f"file://{folder}/index")
    library.watch(str(folder / "in"), seen.append, once=True).awaitTermination()
    assert sum(s.documents for s in seen) == 2 and library.stats()["documents"] == 2
    (folder / "in/sample.txt").write_text("changed words")
    (folder / "in/more.txt").write_text("more words")
    library.watch(str(folder / "in"), seen.append, once=True).awaitTermination()
    assert library.stats()["documents"] == 3 and library.search("changed").count() == 1
    library.unwatch()


def test_running_watch_reads_changed_files_only(spark, folder, monkeypatch):
    read, seen = [], []
    original = files.extract
    monkeypatch.setattr(files, "extract", lambda found, extractors=None: (read.append(sorted(r.path.rsplit("/", 1)[1] for r in found.select("path").collect())), original(found, extractors))[1])
    library = Library(spark, f"file://{folder}/index")
    library.watch(str(folder / "in"), seen.append)
    for n in (1, 2):
        for _ in range(60):
            if len(seen) == n:
                break
            time.sleep(0.5)
        if n == 1:
            (folder / "in/more.txt").write_text("more words")
    library.unwatch()
    assert read == [["sample.md", "sample.txt"], ["more.txt"]] and library.search("more").count() == 1


def test_a_watch_goes_on_where_it_was_cut_off(spark, folder, monkeypatch):
    """A batch that fails is made again from the same listings after a restart, even if files came meanwhile."""
    library, read = Library(spark, f"file://{folder}/index"), []
    plain = library.add
    monkeypatch.setattr(library, "add", lambda extracted, *a: (read.append({r.path.rsplit("/", 1)[1] for r in extracted.select("path").collect()}), plain(extracted, *a) if len(read) != 2 else 1 / 0)[1])
    library.watch(str(folder / "in"), once=True).awaitTermination()
    (folder / "in/more.txt").write_text("more words")
    with pytest.raises(Exception, match="ZeroDivision"):
        library.watch(str(folder / "in"), once=True).awaitTermination()
    (folder / "in/third.txt").write_text("third words")
    (folder / "in/_hidden.txt").write_text("no words")
    library.watch(str(folder / "in"), once=True).awaitTermination()
    library.watch(str(folder / "in"), once=True).awaitTermination()
    assert read == [{"sample.md", "sample.txt"}, {"more.txt"}, {"more.txt"}, {"third.txt"}] and library.stats()["documents"] == 4


def test_changed_entries():
    a, b, c = ("a", 1, 1), ("b", 1, 1), ("c", 1, 1)
    assert list(folder_source.changed(iter([a, b]), iter([a, ("b", 2, 1), c]))) == [("b", 2, 1), c]
    assert list(folder_source.changed(iter([]), iter([a]))) == [a] and list(folder_source.changed(iter([a]), iter([]))) == []


def test_a_change_writes_only_what_changes(spark, folder):
    library = Library(spark, f"file://{folder}/index")
    library.index(str(folder / "in"))
    first = {f: f.stat().st_mtime_ns for f in (folder / "index/generation-1").rglob("*.parquet")}
    (folder / "in/sample.txt").write_text("other words")
    library.index(str(folder / "in"))
    assert {f: f.stat().st_mtime_ns for f in (folder / "index/generation-1").rglob("*.parquet")} == first
    assert spark.read.parquet(f"file://{folder}/index/generation-2/documents").count() == 1
    assert library.search("thirty").where("document_format = 'txt'").count() == 0 and library.search("other words").count() == 1
    rows = lambda: {n: sorted(map(str, library.table(n).collect())) for n in ("documents", "chunks", "postings", "versions")}
    before = rows()
    library.compact()
    assert rows() == before and library._generations() == [3]
    library.remove([r.path for r in library.documents().collect() if r.format == "md"][0])
    assert library.stats()["documents"] == 1 and library.table("postings").where("term = 'sample'").count() == 0


def test_many_changes_are_compacted(spark, folder, monkeypatch):
    monkeypatch.setattr("lectern.plans.library.MOST_GENERATIONS", 2)
    library = Library(spark, f"file://{folder}/index")
    for k in range(4):
        (folder / "in/sample.txt").write_text(f"words number{k}")
        library.index(str(folder / "in/sample.txt"))
    assert len(library._generations()) <= 3 and library.search("number3").count() == 1 and library.search("number2").count() == 0
    assert library.table("versions").count() == 4


def test_plugins(spark, folder):
    (folder / "in/scan.pdf").write_bytes(b"xx")
    (folder / "in/photo.png").write_bytes(b"png")
    table = files.EXTRACTORS | {"pdf": lambda data: (" ", {"pages": len(data)})}
    ocr = lambda data: "words of a picture"
    library = Library(spark, f"file://{folder}/index", Config(ocr=True, rerank=True), fetch=lambda url: ("<title>T</title><p>fetched words", "text/html; charset=x"), extractors=table, ocr=ocr, reranker=lambda rows, k, *ties: rows.withColumn("score", F.lit(7.0)).withColumn("rank", F.lit(1)))
    done = library.index([str(folder / "in"), "https://e.org/p"])
    assert (done.documents, done.failed) == (5, 0)
    found = library.search("picture").collect()
    assert {r.document_path.rsplit("/", 1)[1] for r in found} == {"scan.pdf", "photo.png"} and {r.score for r in found} == {7.0}
    page = library.search("fetched").first()
    assert page.metadata["contentType"] == '"text/html; charset=x"' and page.document_path == "https://e.org/p"

    def fail(url):
        raise OSError("no route")

    library.fetch = fail
    assert library.index("https://e.org/q").errors[0] == ("https://e.org/q", "OSError: no route")


def test_export(spark, folder):
    library = Library(spark, f"file://{folder}/index")
    library.index(str(folder / "in/sample.txt"))
    found = library.search("termination")
    write_csv(found, f"file://{folder}/csv")
    write_json(found, f"file://{folder}/json")
    text = next((folder / "csv").glob("part-*.csv")).read_text()
    assert text.startswith('"score","document","heading","content"\n') and r"notice.\nThe" in text
    assert '"heading":null' in next((folder / "json").glob("part-*.json")).read_text()


def test_html():
    raw = "<html><head><title>Test HTML</title><style>x</style></head><body><header>h</header><nav>n</nav><h1>Title</h1>\n<p>a &amp; b</p><p>c</p><script>var x='</p>'</script><noscript>ns</noscript><a href='/x#y'>l</a><a href='mailto:a@b'>m</a><footer><a href='/gone'>f</a></footer></body></html>"
    assert html.read(raw) == {"content": "Title a & bcnslm", "title": "Test HTML", "links": []}
    page = html.read(raw, "https://e.org/a/b", True)
    assert page["content"] == "Title a & bclm" and page["links"] == ["https://e.org/x#y"]
    assert html.read("<p>a<br>b", "https://e.org", True) == {"content": "ab", "title": "https://e.org", "links": []}
    assert html.read("<p>a</p><p>b</p>", separator=" ")["content"] == "a b"
    assert html.read("<html><head><title>T</title><p>hello world</p>")["content"] == "hello world"
    assert html.read("<head><meta x><style>s</style> \n<title>T</title> loose <b>words</b></head> end")["content"] == "loose words end"
    assert html.read("<head><title>T</title></head><body>b")["content"] == "b"


def test_markdown_headings():
    got = files.headings("Title\n===\n\n# One #\n```\n# not\n```\n## Two\nx\n---\n")
    assert got == [{"level": 1, "text": "Title"}, {"level": 1, "text": "One"}, {"level": 2, "text": "Two"}, {"level": 2, "text": "x"}]


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office():
    w = 'xmlns:w="http://w"'
    text, meta = office.docx(zipped(**{"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>"}))
    assert text == "One\ttwo\n\nThree\n\n" and meta["warnings"] == []
    book = {
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="A" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
    }
    text, meta = office.xlsx(zipped(**book))
    assert text == "--- Sheet: A ---\nname\t\t3" and meta["sheets"] == ["A", "Empty"]
    slides = {f"ppt/slides/slide{n}.xml": f"<a><t>s</t><t>{n}</t></a>" for n in (1, 2, 10)}
    assert office.pptx(zipped(**slides))[0] == "s1\n\ns2\n\ns10" and office.pptx(zipped(**slides), False)[0] == "s1\n\ns10\n\ns2"


def test_scans():
    pdf = lambda data: (" ", {"pages": len(data)})
    read = files.with_ocr(pdf, lambda data: "words")
    assert read(b"12") == ("words", {"pages": 2, "ocr": True}) and read(b"1")[0] == " "


def test_html_references_end_with_a_semicolon():
    page = html.read("<title>a&amp;&amp</title><p>x&amp</p><p>&lt;b&gt; &copy &#65;&#66 &nosuch; &amp;lt; R&D &notit;</p><a href='/q?a=1&amp;b=2&copy=3'>l</a>", "https://e.org", True)
    assert page == {"content": "x&amp<b> &copy A&#66 &nosuch; &lt; R&D &notit;l", "title": "a&&amp", "links": ["https://e.org/q?a=1&b=2&copy=3"]}


def test_pages_are_parsed_a_few_at_a_time(spark):
    """A worker holds a few parsed pages, not those of a whole Arrow batch."""
    pages = spark.range(300).selectExpr("id", "id % 7 AS n", "concat('https://e.org/', id) AS url", "IF(id = 5, NULL, concat('<title>', id, '</title><p>b', id, '</p><a href=n>l</a>')) AS html")
    found = html.parse_pages(pages)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["id", "n", "url", "content", "title", "links"]
    assert {r.id: (r.n, r.content, r.title, r.links) for r in found.collect()} == {i: (i % 7, "", f"https://e.org/{i}", []) if i == 5 else (i % 7, f"b{i}l", str(i), ["https://e.org/n"]) for i in range(300)}
