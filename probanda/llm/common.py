"""Helpers shared by the training-data operators: staged tables, size-checked broadcasts and vectorised word hashing.

Word hashing works on the UTF-8 bytes of whole Arrow batches with numpy: a word is a maximal run of bytes other than
space and 0x09-0x0D, A-Z fold to a-z, and its 64-bit value is a polynomial hash put through a finaliser. Two different
words (or shingles) get the same value with a probability of about 2**-64 per pair; the operators take equal values for
equal words.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; bounds the temporary arrays of a task to about 40 times as much.
SLICE_BYTES = 1 << 18


#: Bytes of one Arrow batch that a Python task gets at a time; the session's own setting stays where it is smaller.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder under /tmp in local mode, as in
    tests, and an error on a cluster, whose machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme: a bare path belongs to Hadoop's default file system, which on a cluster isn't each machine's disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{found.removeprefix('file:')}" if found.startswith("file:/") and not found.startswith("file://") else found  # Arrow wants both slashes


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, so that Python workers and their channels hold a few MB of long texts each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
    if not held or int(held[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; other DataFrames and None are left alone."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """Broadcast ``df`` where its counted rows (of a few fixed-width columns) are under ``most``; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= most else df


class Kept(dict):
    """A cache of bounded bytes in two generations: when the young one is full it becomes the old one, and what is asked for again
    moves back. So memory stays under twice ``most`` and words in use stay."""

    #: Bytes of an entry besides its characters and its value: two objects and their place in the table.
    ENTRY = 260

    def __init__(self, make, most: int, base: dict | None = None):
        """``base`` is there from the start and always stays."""
        super().__init__(base or {})
        self.make, self.most, self.size, self.base, self.old = make, most, 0, base or {}, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 256:
            self.size += self.ENTRY + 4 * len(word)
            if self.size > self.most:
                self.old, self.size = dict(self), 0
                self.clear()
                self.update(self.base)
            self[word] = found
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 at least of the base and of its inverse; only tables for slices of usual size are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    with np.errstate(over="ignore"):
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(max(n, SLICE_BYTES + 1), np.uint64(base))
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
    if n <= SLICE_BYTES + 1:
        _powers[:] = tables
    return tables[0], tables[1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = np.arange(256)
_FOLDED[ord("A") : ord("Z") + 1] += 32
_VALUES = mix((_FOLDED.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (int64, one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """(first, last) row ranges whose texts have at most ``most`` bytes together; a longer text goes alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row bounds: words of row i are ``hashes[bounds[i]:bounds[i + 1]]``."""
    base, end = int(offsets[0]), int(offsets[-1])
    rows = len(offsets) - 1
    if end == base:
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    buf, at = data[base:end], offsets - base
    word = ~_SPACE[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = at[1:-1]
    inner = inner[inner < len(buf)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _power_tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_VALUES[buf] * up[: len(buf)], out=total[1:])
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, at, "left")


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of ``width`` words; of all its words where there are fewer, and none for no words."""
    with np.errstate(over="ignore"):
        runs = hashes
        for k in range(1, width):
            m = max(len(hashes) - k, 0)
            runs = mix(runs[:m] * np.uint64(0xA0761D6478BD642F) + hashes[k:])
        out = []
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = last - first
            if n >= width:
                s = np.sort(runs[first : last - width + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif n:
                h = hashes[first : first + 1]
                for k in range(1, n):
                    h = mix(h * np.uint64(0xA0761D6478BD642F) + hashes[first + k : first + k + 1])
                out.append(mix(h + np.uint64(n)))
            else:
                out.append(hashes[:0])
    return out


def most_frequent(counts: DataFrame, most: int, n: str = "n"):
    """The rows of a table of counts that are highest, about ``most`` and never more, as pandas; a whole bin at the edge stays out.

    A histogram of at most a few hundred bins finds the edge, so that neither tasks nor the driver hold more rows than asked for.
    """
    bin_ = F.floor(F.log2(F.col(n).cast("double")) * 8)
    bins = sorted(((b, c) for b, c in counts.where(F.col(n) > 0).groupBy(bin_.alias("b")).count().collect()), reverse=True)
    total, edge = 0, None
    for b, c in bins:
        if total + c > most:
            break
        total, edge = total + c, b
    some = counts.where(F.col(n) > 0)
    if edge is None and bins:  # the top bin alone is too large: a part of it by hash
        edge, c = bins[0]
        some = some.where(F.pmod(F.xxhash64(*[F.col(x) for x in counts.columns if x != n]), F.lit(1_000_000)) < int(900_000 * most / c))
    return some.where(bin_ >= (edge if edge is not None else 0)).toPandas()
