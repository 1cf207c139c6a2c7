"""Erasing clients and all that hangs on them from sorted Parquet tables, file by file.

A table is written as files of a fixed number of consecutive rows of its total order. Rows are range-sorted
into a staging table first; a row's rank is the rows of the parts before plus its place in its part's file,
so no task ever sees the whole table. Each file number is then one partition of one shuffle
(`repartitionById`), sorted in its task, staged with `partitionBy`, and the finished table is published by one
rename. Every file is written by one task, streaming, as its size is fixed by the caller.

An erasure first marks the numbers of the files that hold victims. The survivors of these files alone are
written in their old order, again one partition for each number, and replace them by dynamic partition
overwrite: readers see a file before or after its change, and other files aren't touched. Files without
survivors have no partition in that write, so they are deleted explicitly. All tables live below the shared
folder; a lost executor's tasks run again from files, and a failed run leaves only its own new folder.

Keys to erase are sent to all executors if they have at most `MOST_BROADCAST` bytes, else joined by a shuffle.
Ids that hold more than a `HOT`th of a table's rows, of which there are fewer than `HOT`, are joined on their own.

Null keys match no victim. Rows with a null or unknown parent sort under the empty string. Of parents that occur
several times with different clients the smallest client counts for the order, and any of them that is a victim
erases the children. Repeated rows keep their number. A table without rows has no files. Columns named like the
file number or other helpers don't clash: helpers take names that the table lacks. NaN and null amounts add 0 cents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_bytes, scratch, tagged

#: Most files of a table are this many and one.
FILES = 150
#: An id with more than this share of the rows of a table is joined apart.
HOT = 200
MOST_BROADCAST = 8_000_000
#: Columns whose cents are summed, by table.
AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _path(spark, path)
    files.delete(place, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    files, place = _path(spark, old)
    target = _path(spark, new)[1]
    files.mkdirs(target.getParent())
    if not files.rename(place, target):
        raise OSError(f"{old} can't be renamed to {new}")


def _free(want: str, names: list[str]) -> str:
    """`want`, longer by underscores until no column is called so."""
    while want in {n.lower() for n in names}:
        want += "_"
    return want


@dataclass
class Filed:
    """A table of numbered files: where it is, its columns, its rows when written, and the rows of a full file."""

    spark: SparkSession
    path: str
    schema: T.StructType
    rows: int
    size: int

    @property
    def number(self) -> str:
        """The name of the partition column."""
        return _free("file_no", self.schema.names)

    @property
    def helper(self) -> str:
        """The name of the column that `read` adds."""
        return _free("_file", self.schema.names)

    @property
    def files(self) -> int:
        return -(-self.rows // self.size)

    def read(self) -> DataFrame:
        """The rows, and the number (`no`) and path of their file and their place (`at`) in it."""
        whole = T.StructType([*self.schema.fields, T.StructField(self.number, T.LongType())])
        df = self.spark.read.schema(whole).parquet(self.path)
        of_file = F.struct(F.col(self.number).alias("no"), F.col("_metadata.row_index").alias("at"), F.col("_metadata.file_path").alias("path"))
        return df.select(*_columns(self.schema.names), of_file.alias(self.helper))


def _columns(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def _numbered(df: DataFrame, filed: Filed, number: Column, order: Column) -> DataFrame:
    """The rows of `df` and the numbers of their files, each number in a partition of its own and in `order`."""
    keyed = df.withColumn(filed.number, number.cast("int")).repartitionById(max(1, filed.files), filed.number)
    return keyed.sortWithinPartitions(filed.number, order).select(*_columns(filed.schema.names), filed.number)


def write_sorted(df: DataFrame, key: Column, names: list[str], base: str, name: str, files: int = FILES) -> Filed:
    """Writes the columns `names` of `df`, in the order of `key`, then of the columns, nulls first, as numbered files of
    1 + floor(rows / files) rows each below `base`/final/`name`."""
    spark = df.sparkSession
    lt = tagged(df)
    order = [F.col(f"{lt}_key"), *_columns(names)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(*_columns(names), key.alias(f"{lt}_key")).repartitionByRange(parts, *order)
    ranged = ranged.withColumn(f"{lt}_part", F.spark_partition_id()).sortWithinPartitions(*order)
    ranged_at, staging, final = (f"{base}/{stage}/{name}" for stage in ("ranged", "staging", "final"))
    ranged.write.option("maxRecordsPerFile", 0).parquet(ranged_at)
    held = spark.read.schema(ranged.schema).parquet(ranged_at)
    counts = held.groupBy(f"{lt}_part").agg(F.count(F.lit(1)).alias(f"{lt}_n"))
    rows = counts.agg(F.sum(f"{lt}_n")).first()[0] or 0
    filed = Filed(spark, final, df.select(*_columns(names)).schema, rows, 1 + rows // files)
    before = Window.orderBy(f"{lt}_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(f"{lt}_part", F.coalesce(F.sum(f"{lt}_n").over(before), F.lit(0)).alias(f"{lt}_first"))
    placed = held.withColumn(f"{lt}_at", F.col("_metadata.row_index")).join(F.broadcast(first), f"{lt}_part")  # `first` has `parts` rows at most
    ranked = placed.withColumn(f"{lt}_rank", F.col(f"{lt}_first") + F.col(f"{lt}_at"))
    staged = _numbered(ranked, filed, F.expr(f"{lt}_rank div {filed.size}"), F.col(f"{lt}_rank"))
    staged.write.option("maxRecordsPerFile", 0).partitionBy(filed.number).parquet(staging)
    _rename(spark, staging, final)
    _delete(spark, ranged_at)
    return filed


def erase(filed: Filed, column: str, victims: DataFrame) -> None:
    """Removes the rows whose `column` is among the distinct values of the only column of `victims`, a written table."""
    spark, helper = filed.spark, filed.helper
    keys = held_bytes(victims.toDF(f"{helper}_key"), F.lit(8), MOST_BROADCAST)
    match = F.col(f"`{column}`") == F.col(f"{helper}_key")
    rows, no = filed.read(), F.col(f"{helper}.no")
    # Pairs of key and file: a hot key is one row for each file that it is in.
    held = rows.select(f"`{column}`", no.alias(f"{helper}_no")).distinct().join(keys, match, "left_semi")
    hit = {r[0] for r in held.select(f"{helper}_no").distinct().collect()}  # numbers of files, so few
    if not hit:
        return
    survivors = rows.where(no.isin(sorted(hit))).join(keys, match, "left_anti")
    stay = {r[0] for r in survivors.select(no).distinct().collect()}
    if stay:
        again = _numbered(survivors, filed, no, F.col(f"{helper}.at"))
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(filed.number).parquet(filed.path)
    for emptied in hit - stay:
        _delete(spark, f"{filed.path}/{filed.number}={emptied}")


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def victim_masters(clients: DataFrame, clicks: DataFrame, every: int = 100) -> DataFrame:
    """master_id of the masters to erase: those whose checksum divides by `every`, and the one whose clients have most clicks."""
    owned = clients.where("master_id IS NOT NULL").select("master_id", "client_id").distinct()
    counts = clicks.where("client_id IS NOT NULL").groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    most = owned.join(counts, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy(F.desc("n"), "master_id").limit(1)
    return distinct_keys(clients, "master_id").where(F.crc32(F.col("master_id").cast("string")) % every == 0).union(most.select("master_id")).distinct()


def with_owner(children: DataFrame, parents: DataFrame, key: str, owner: str, called: str) -> DataFrame:
    """`children` with the smallest `owner` of their parent as `called`, null if there is none.

    Parents of many children are joined by a broadcast: fewer than `HOT` keys have more than a `HOT`th of the rows."""
    owners = parents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{called}_key")).agg(F.min(owner).alias(called))
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = children.count()
    hot = [r[0] for r in counts.where((F.col("n") * HOT > total) & F.col(key).isNotNull()).select(key).collect()]
    none = F.lit(None).cast(parents.schema[owner].dataType)
    join = lambda rows, some: rows.join(some, F.col(key) == F.col(f"{called}_key"), "left").drop(f"{called}_key")
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    out = join(children.where(F.col(key).isNotNull() & ~is_hot), owners.where(~F.col(f"{called}_key").isin(hot)) if hot else owners)
    out = out.union(children.where(F.col(key).isNull()).withColumn(called, none))
    return out.union(join(children.where(is_hot), F.broadcast(owners.where(F.col(f"{called}_key").isin(hot))))) if hot else out


def checksum(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def cascade(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame) -> dict[str, Filed]:
    """Writes the four tables below a new folder, then erases the victim masters' clients, their clicks and sales, and the
    sales' lines, the children first. Gives the tables as they are then."""
    spark = clients.sparkSession
    base = f"{scratch(spark)}/erasure-{uuid.uuid4().hex}"
    tables = {"clients": clients, "clicks": clicks, "sales": sales}
    filed = {name: write_sorted(df, checksum("client_id"), df.columns, base, name) for name, df in tables.items()}
    owner = tagged(sale_lines) + "_owner"
    filed["sale_lines"] = write_sorted(with_owner(sale_lines, sales, "sale_id", "client_id", owner), checksum(owner), sale_lines.columns, base, "sale_lines")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/victims/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/victims/{name}")

    masters = written(victim_masters(filed["clients"].read(), filed["clicks"].read()), "masters")
    theirs = filed["clients"].read().join(held_bytes(masters, F.lit(8), MOST_BROADCAST), "master_id", "left_semi")
    ids = written(distinct_keys(theirs, "client_id"), "clients")
    sold = filed["sales"].read().join(held_bytes(ids, F.lit(8), MOST_BROADCAST), "client_id", "left_semi")
    for name, column, victims in (("sale_lines", "sale_id", written(distinct_keys(sold, "sale_id"), "sales")), ("sales", "client_id", ids), ("clicks", "client_id", ids), ("clients", "master_id", masters)):
        erase(filed[name], column, victims)
    for stage in ("ranged", "staging", "victims"):
        _delete(spark, f"{base}/{stage}")
    return filed


def report(filed: Filed, name: str, amount: str) -> DataFrame:
    """One row per file, read in its order: see `digest`. A file streams through one task, of which only the hash is kept."""
    helper, first = filed.helper, filed.schema.names[0]
    cents = F.coalesce(F.when(~F.isnan(amount), F.floor(F.col(f"`{amount}`") * 100 + 0.5)), F.lit(0).cast("long"))
    rows = filed.read().select(F.col(f"{helper}.no").alias("no"), F.col(f"{helper}.at").alias("at"), F.col(f"{helper}.path").alias("path"), F.coalesce(F.col(f"`{first}`").cast("string"), F.lit("")).alias("id"), cents.alias("cents"))
    ordered = rows.repartitionById(max(1, filed.files), F.col("no").cast("int")).sortWithinPartitions("no", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # number, path, rows, cents, hash

        def made() -> pa.RecordBatch:
            no, path, n, total, seen = now
            return pa.RecordBatch.from_pydict({"file_no": [no], "n_rows": [n], "cents": [total], "ids_sha256": [seen.hexdigest()], "path": [path]})

        for batch in batches:
            numbers = batch.column("no").to_numpy()
            start = 0
            while start < len(batch):
                stop = int(numbers.searchsorted(numbers[start], "right"))
                part, no = batch.slice(start, stop - start), int(numbers[start])
                if not now or now[0] != no:
                    if now:
                        yield made()
                    now = [no, part.column("path")[0].as_py(), 0, 0, hashlib.sha256()]
                now[4].update((b"," if now[2] else b"") + ",".join(part.column("id").to_pylist()).encode())
                now[2] += len(part)
                now[3] += pc.sum(part.column("cents")).as_py()
                start = stop
        if now:
            yield made()

    found = ordered.mapInArrow(run, "file_no long, n_rows long, cents long, ids_sha256 string, path string")
    was = F.least(F.lit(filed.size), F.lit(filed.rows) - F.col("file_no") * filed.size)
    erased = (was - F.col("n_rows")).cast("long")
    return found.select(F.lit(name).alias("table_name"), "file_no", "n_rows", erased.alias("n_erased"), "cents", (erased > 0).alias("rewritten"), "ids_sha256", F.lit(",".join(filed.schema.names)).alias("columns"), "path")


def digest(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame) -> DataFrame:
    """Per file that is left: table_name, file_no, n_rows, n_erased, cents, rewritten, ids_sha256, columns, path."""
    made = cascade(clients, clicks, sales, sale_lines)
    reports = [report(filed, name, AMOUNTS[name]) for name, filed in made.items()]
    return reports[0].union(reports[1]).union(reports[2]).union(reports[3])
