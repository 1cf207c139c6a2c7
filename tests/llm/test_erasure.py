import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq

from lectern.llm import erasure, queries

TABLES = ("clients", "clicks", "sales", "sale_lines")
AMOUNT = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def local(path):
    return Path(urlparse(path).path)


def crc(value):
    return zlib.crc32(b"" if value is None else str(value).encode())


def plain(tables):
    """The contract over lists of dictionaries, in memory: (table, file_no) -> row of the report without path, and the files' rows."""
    owner = {}
    for r in tables["sales"]:
        if r["sale_id"] is not None and r["client_id"] is not None:
            owner[r["sale_id"]] = min(owner.get(r["sale_id"], r["client_id"]), r["client_id"])
    key = {t: (lambda r: crc(r["client_id"])) for t in TABLES} | {"sale_lines": lambda r: crc(owner.get(r["sale_id"]))}
    clicks, clients_of = Counter(r["client_id"] for r in tables["clicks"]), defaultdict(set)
    for r in tables["clients"]:
        if r["master_id"] is not None:
            clients_of[r["master_id"]].add(r["client_id"])
    total = {m: sum(clicks[c] for c in some if c is not None) for m, some in clients_of.items()}
    masters = {m for m in clients_of if crc(m) % 100 == 0} | set(sorted(total, key=lambda m: (-total[m], m))[:1])
    clients = {r["client_id"] for r in tables["clients"] if r["master_id"] in masters} - {None}
    sales = {r["sale_id"] for r in tables["sales"] if r["client_id"] in clients} - {None}
    victim = {"clients": lambda r: r["master_id"] in masters, "clicks": lambda r: r["client_id"] in clients, "sales": lambda r: r["client_id"] in clients, "sale_lines": lambda r: r["sale_id"] in sales}
    report, files = {}, {}
    for t in TABLES:
        rows = sorted(tables[t], key=lambda r: (key[t](r), [(v is not None, v if v is not None else 0) for v in r.values()]))
        size = 1 + len(rows) // 150
        for no in range(-(-len(rows) // size)):
            mine = rows[no * size : (no + 1) * size]
            left = [r for r in mine if not victim[t](r)]
            if left:
                cents = sum(math.floor(100 * r[AMOUNT[t]] + 0.5) for r in left if r[AMOUNT[t]] is not None)
                ids = ",".join("" if (v := next(iter(r.values()))) is None else str(v) for r in left)
                report[t, no] = (len(left), len(mine) - len(left), cents, len(left) < len(mine), hashlib.sha256(ids.encode()).hexdigest(), ",".join(left[0]))
                files[t, no] = left
    return report, files


def check(df, tables):
    rows = df.collect()
    got = {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r.columns) for r in rows}
    want, files = plain(tables)
    assert got == want and len(rows) == len(got)
    for r in rows:
        made = pq.ParquetFile(local(r.path))
        assert made.read().to_pylist() == files[r.table_name, r.file_no]
        first = files[r.table_name, r.file_no]
        values = [x["client_id"] for x in first if x.get("client_id") is not None] if r.table_name != "sale_lines" else [x["sale_id"] for x in first if x["sale_id"] is not None]
        at = made.schema_arrow.names.index("client_id" if r.table_name != "sale_lines" else "sale_id")
        groups = [made.metadata.row_group(g).column(at).statistics for g in range(made.metadata.num_row_groups)]
        if values:
            assert min(g.min for g in groups if g.has_min_max) == min(values) and max(g.max for g in groups if g.has_min_max) == max(values)
    for top in {str(local(r.path)).split("/final/")[0] for r in rows}:
        found = {str(p) for p in Path(top).rglob("*") if p.is_file() and not p.name.startswith(("_", "."))}
        assert found == {str(local(r.path)) for r in rows}
    return rows


def test_shop(spark):
    tables = {t: pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").to_pylist() for t in TABLES}
    rows = check(queries.op12_erasure(spark, "/root/testdata/sf0.001"), tables)
    assert any(r.rewritten for r in rows) and not all(r.rewritten for r in rows)


SCHEMAS = {"clients": "client_id long, master_id long, file_no long, balance double", "clicks": "click_id long, client_id long, value double", "sales": "sale_id long, client_id long, total double, __lt string", "sale_lines": "sale_id long, line_no int, amount double"}


def made(spark, rows):
    frames = {t: spark.createDataFrame(rows[t], SCHEMAS[t]) for t in TABLES}
    names = {t: frames[t].columns for t in TABLES}
    return frames, {t: [dict(zip(names[t], r, strict=True)) for r in rows[t]] for t in TABLES}


def test_odd_tables(spark, monkeypatch):
    """Nulls, repeated rows and ids, sales of two clients, lines without a sale, a hot client, clashing names; keys joined by shuffles."""
    monkeypatch.setattr(erasure, "MOST_BROADCAST", 0)
    divisible = next(m for m in range(1000) if crc(m) % 100 == 0)
    clients = [(i, i // 2, None, 1.005 * i) for i in range(40)] + [(None, divisible, 1, None), (None, None, 2, 2.0), (7, divisible, 3, -0.005), (7, divisible, 3, -0.005), (90, divisible, None, 0.5)]
    clicks = [(k, 5 if k % 3 else k % 45, 0.1 * k) for k in range(700)] + [(None, None, None)] * 5 + [(1, None, 1.0), (2, 5, None), (2, 5, None)]
    sales = [(s, s % 50, 1.0 * s, "x") for s in range(200)] + [(3, 90, 1.0, "y"), (4, None, 1.0, None), (None, 7, 2.0, "n"), (9, 9, 9.0, "x"), (9, 9, 9.0, "x")]
    lines = [(s % 210, k, 0.015 * k) for k, s in enumerate(range(900))] + [(9, 1, None)] * 400 + [(None, 1, 1.0)] * 3
    frames, rows = made(spark, {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines})
    out = check(erasure.digest(*frames.values()), rows)
    assert {"clients", "clicks", "sales", "sale_lines"} == {r.table_name for r in out}


def test_nothing_left_nothing_there(spark):
    frames, rows = made(spark, {"clients": [(1, 1, None, 1.0)], "clicks": [], "sales": [(1, 1, 1.0, None)], "sale_lines": [(1, 1, 2.0), (2, 1, 3.0)]})
    assert [(r.table_name, r.file_no) for r in check(erasure.digest(*frames.values()), rows)] == [("sale_lines", 0)]
    frames, rows = made(spark, {t: [] for t in TABLES})
    assert check(erasure.digest(*frames.values()), rows) == []


def test_other_files_are_untouched(spark):
    df = spark.range(1000).selectExpr("id AS client_id", "cast(id AS double) AS balance")
    filed = erasure.write_sorted(df, erasure.checksum("client_id"), df.columns, f"{erasure.scratch(spark)}/erasure-one", "clients")
    times = lambda: {r.path: local(r.path).stat().st_mtime_ns for r in filed.read().select("_file.path").distinct().collect()}
    before = times()
    gone = filed.read().where("client_id = 77").select("_file.path").first()[0]
    erasure.erase(filed, "client_id", spark.createDataFrame([(77,)], "k long"))
    after = times()
    assert len(before) == len(after) and {p for p in before if after.get(p) != before[p]} == {gone} and filed.read().count() == 999
