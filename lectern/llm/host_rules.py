"""Quality rules of documents, and verdicts on their hosts.

Every whole text is measured once and held against simple rules. Rule failures are then summed
by host; as small hosts have unsure rates, each rate is shrunk to the rate of all hosts by a beta
prior whose two parameters come from the hosts themselves (method of moments). A host whose shrunken
rate of some rule is above `HOST_LIMIT` loses all its documents. The sums are partial before the
shuffle, so a host with a third of all rows costs no more than another one, and the host table
comes back to the documents by an ordinary join that Spark can broadcast or split.

Null or empty text: no words, so it fails the length rule. Null host: a host of its own. Null ids and
other nulls pass through. Repeated rows are measured each. Texts are measured whole and one at a time, in time
and memory in proportion to their length. A rate equal to the limit passes. Columns of `docs` may have any
names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, tagged

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: A host is rejected when its shrunken failure rate of a rule is above this.
HOST_LIMIT = 0.5

#: Rule -> SQL condition, over the measures, that holds when a document fails.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
}
BASE = ("short", "repeats")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:  # three ids no longer fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = np.flatnonzero(np.diff(windows[order]) == 0)
    hit = np.zeros(len(words), bool)
    for at in (order[same], order[same + 1]):
        for k in range(3):
            hit[at + k] = True
    return int(hit.sum())


def measures_of(text: bytes) -> tuple[int, ...]:
    words = text.split()  # bytes split at \\x20 and \\x09-\\x0D only
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    return (
        len(words),
        len(joined.decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def measure(docs: DataFrame, text: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if none are named) and the measures of `text`, named with `prefix`."""
    keep = docs.columns if keep is None else keep
    names = [prefix + m for m in MEASURES]
    source = prefix + "text_"
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(source).cast(pa.binary())]  # one text at a time
            columns = zip(*found, strict=True) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, *names])

    return docs.select(*keep, F.col(text).alias(source)).mapInArrow(run, schema)


def _rule(name: str, prefix: str) -> F.Column:
    condition = RULES[name]
    for m in MEASURES:
        condition = condition.replace(m, f"`{prefix}{m}`")
    return F.expr(condition)


def host_verdicts(measured: DataFrame, host: str, prefix: str = "", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: its shrunken rate of each rule (<prefix>rate_<rule>) and <prefix>host_rejected."""
    counts = measured.groupBy(host).agg(F.count(F.lit(1)).alias(prefix + "docs"), *(F.sum(_rule(r, prefix).cast("long")).alias(prefix + r) for r in RULES))
    counts = materialize(counts, "hosts")
    n = F.col(prefix + "docs").cast("double")
    sums = counts.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("hosts"), *(F.sum(prefix + r).alias(r) for r in RULES)).first()
    total, hosts = sums["n"] or 1.0, sums["hosts"]
    means = {r: (sums[r] or 0) / total for r in RULES}
    spreads = counts.agg(*(F.sum(n * F.pow(F.col(prefix + r) / n - F.lit(means[r]), F.lit(2.0))).alias(r) for r in RULES)).first()
    rates = {}
    for r in RULES:
        noise = means[r] * (1 - means[r])
        between = max((spreads[r] or 0.0) / total - noise * hosts / total, 1e-9)
        strength = min(max(noise / between - 1, 1.0), 1e6)
        rates[r] = (F.col(prefix + r) + F.lit(means[r] * strength)) / (n + F.lit(strength))
    out = counts.select(F.col(host), F.col(prefix + "docs"), *(c.alias(f"{prefix}rate_{r}") for r, c in rates.items()))
    return out.withColumn(prefix + "host_rejected", F.greatest(*(F.col(f"{prefix}rate_{r}") for r in RULES)) > limit)


def judge(measured: DataFrame, host: str = "source", prefix: str = "", limit: float = HOST_LIMIT) -> DataFrame:
    """`measured` with <prefix>base_failed, its host's verdict and rates, and <prefix>kept."""
    verdicts = host_verdicts(measured, host, prefix, limit).withColumnRenamed(host, prefix + "host_")
    joined = measured.join(verdicts, measured[host].eqNullSafe(verdicts[prefix + "host_"]), "left").drop(prefix + "host_")
    failed = F.lit(False)
    for r in BASE:
        failed = failed | _rule(r, prefix)
    return joined.withColumn(prefix + "base_failed", failed).withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & ~F.col(prefix + "host_rejected"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass their own rules and whose host passes, with the columns of `docs`.

    Every text is measured once: the measured documents are written, as the hosts' sums come first."""
    prefix = tagged(docs)
    return judge(materialize(measure(docs, text, prefix), "measured"), host, prefix).where(F.col(prefix + "kept")).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, base_failed and kept."""
    measured = materialize(measure(docs.select("doc_id", "source", "text"), keep=["doc_id", "source"]), "measures")
    return judge(measured).select("doc_id", *MEASURES[:5], "base_failed", "kept", "host_rejected")
