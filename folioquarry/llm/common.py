"""Helpers that the training-data operators share: bounded Arrow batches, vectorised word tables, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one kernel call handles; a single longer text is handled alone.
BATCH_BYTES = 1_000_000
#: Bytes of rows that go to a Python worker at once; a single longer row goes alone.
ARROW_BYTES = 4 << 20


#: Rows of a few numbers that a side may have to be broadcast; as a hashed relation some 30 MB.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or that of setCheckpointDir.

    A temporary folder of this machine stands in only where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and (set_by_context := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = set_by_context.get()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def bounded(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join, to be broadcast if it is counted to hold at most so many rows."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


class Scratch:
    """Tables written to the shared folder and read back: they cut lineage and survive lost executors.

    checkpoint() would keep the estimated sizes of the plan it cuts, which multiply with each join of an
    iteration; a table that is read has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, new_folder(spark, "scratch"), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.paths += 1
        path = f"{self.folder}/{self.paths}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if t is not None and hasattr(t, "scratch_path"):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one with underscores before it, that no column has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, text: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have at most ``limit`` bytes together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on what crosses to Python at once, so that neither side of a worker holds long batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def over_texts(df: DataFrame, text_col: str, kernel: Callable, fields: T.StructType, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row beside what ``kernel(list of texts)`` returns for its text.

    kernel() gets whole texts (None for null), BATCH_BYTES of them at a time, and returns a list of
    column lists.  Kept columns that a result column's name clashes with (in any case) are left out.
    """
    small_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    types = [_arrow(f.dataType) for f in fields]
    out_names = [f.name for f in schema]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in slices(batch, texts):
                part = batch.slice(a, b - a)
                got = kernel(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *[pa.array(v, t) for v, t in zip(got, types, strict=True)]], out_names)

    return rows.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Words:
    """Words of a few texts as arrays over their UTF-8 bytes, joined by newlines.

    A word is a maximal run of bytes other than ASCII white space.  start/end: byte offsets in ``data``;
    doc: text number; first: byte offset where each text begins.
    """

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode() for t in texts]
        self.joined = b"\n".join(parts) + b"\n"
        self.data = np.frombuffer(self.joined, np.uint8)
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        space = SPACE[self.data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        self.start, self.end = edge[0::2], edge[1::2]  # the last byte is a newline, so edges come in pairs
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1

    def total(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each word have the mask set."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[self.end] - sums[self.start]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def char_starts(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes that begin a code point."""
    return (data & 0xC0) != 0x80


_MIX = np.random.default_rng(3).integers(1, 2**63, (256,), dtype=np.uint64)
_POWER = np.random.default_rng(4).integers(1, 2**63, (4096,), dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hashes of the words, the same in every batch and process."""
    starts = np.zeros(len(w.data), np.int64)
    starts[w.start] = w.start
    place = np.arange(len(w.data)) - np.maximum.accumulate(starts)
    with np.errstate(over="ignore"):
        factor = _POWER[np.minimum(place, len(_POWER) - 1)]
        far = np.flatnonzero(place >= len(_POWER) - 1)  # words of over 4,095 bytes
        factor[far] = mixed(place[far].astype(np.uint64)) | np.uint64(1)
        value = _MIX[w.data] * factor
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
        return mixed(sums[w.end] - sums[w.start] + (w.end - w.start).astype(np.uint64))
