"""What the operators of this folder share: reading, shared storage, bounded Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import new_folder

#: UTF-8 bytes of text that a Python worker holds as Python objects at a time; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives memory that Python freed back to the machine; a worker lives on after its task."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, remembers: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` has about `limit` bytes in each. Unless the task remembers chunks, its worker
    forgets those of the tasks before it."""
    if not remembers:
        for memo in MEMOS:
            memo.clear()
    try:
        yield from _slices(batches, column, limit)
    finally:
        trim()


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a column; null is empty."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def over_texts(docs: DataFrame, id_col: str, text_col: str, schema: str, rows: Callable[[list, list[bytes]], dict], limit: int = SLICE_BYTES, remembers: bool = False) -> DataFrame:
    """mapInArrow of `rows(ids, texts) -> columns` over bounded slices. Other columns of docs are not read, so their names cannot clash."""
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", limit, remembers):
            yield pa.RecordBatch.from_pydict(rows(part.column("id"), texts(part, "text")))

    return plain.mapInArrow(run, schema)


#: The memos of this worker.
MEMOS: list[Memo] = []


class Memo:
    """What a worker remembers by key, in two generations: a full young one becomes the old one, and what is used again moves back. So it holds twice `most` keys or `most_bytes` at the utmost, and common keys stay."""

    def __init__(self, most: int = 700_000, most_bytes: int = 64 << 20):
        self.most, self.most_bytes = most, most_bytes
        self.clear()
        MEMOS.append(self)

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def missing(self, keys: set) -> list:
        """Those of keys that are not known; the others are in `young` afterwards."""
        new = keys.difference(self.young)
        if len(self.young) + len(new) > self.most or self.held > self.most_bytes:
            self.old, self.young, self.held, new = self.young, {}, 0, keys
        miss = []
        for key in new:
            value = self.old.get(key)
            if value is None:
                miss.append(key)
            else:
                self.put(key, value)
        return miss

    def put(self, key, value) -> None:
        self.young[key] = value
        self.held += len(key) + len(value)
