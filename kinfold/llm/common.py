"""Helpers that the operators share: word splitting on UTF-8 bytes, shared-folder tables, Arrow plumbing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from ..sources.staging import materialise, shared_path  # noqa: F401

#: A-Z become a-z; digits, a-z and every byte from 0x80 stay; all else separates words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, with A-Z lower-cased; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks (0x20, 0x09-0x0D), with A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def rows_of(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``step`` rows, so that working memory follows the slice."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def giving_back(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The step of a mapInArrow, after which its worker, which Spark reuses, returns freed memory to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_splits(df: DataFrame) -> int:
    """Number of partitions of a frame's plan; no job runs for a plain scan."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def shuffle_width(df: DataFrame, per_split: float = 1.0) -> int:
    """A number of shuffle partitions that follows the input: splits of a scan are bounded by maxPartitionBytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(input_splits(df) * per_split), 1)


def crc_of_id(doc_id) -> F.Column:
    """crc32 of the decimal text of an id, as a non-negative long."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def integer_id(df: DataFrame, name: str = "doc_id") -> F.Column:
    """The id column as long; ids that are no integers raise, since a cast would make them null."""
    if not isinstance(df.schema[name].dataType, (IntegralType, NullType)):
        raise TypeError(f"{name} must be an integer, not {df.schema[name].dataType.simpleString()}")
    return F.col(name).cast("long")


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id", n: int | None = None) -> DataFrame:
    """All rows, or, if there are more than ``rows``, about so many chosen by the hash of the key."""
    n = df.count() if n is None else n
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def shielded(docs: DataFrame) -> DataFrame:
    """The documents with all columns but those that operators read under names that clash with no result's."""
    return docs.select(*(F.col(c) if c in ("doc_id", "text", "n_chars") else F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(docs.columns)))


def unshielded(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents, with their names, from a frame over shielded ones."""
    return out.select(*(F.col(c if c in ("doc_id", "text", "n_chars") else f"_own{i}").cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(docs.columns)))
