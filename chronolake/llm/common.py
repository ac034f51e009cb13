"""What the text operators share: reading tables, cutting lineage, Arrow slices, word codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import cut, gathered, shared_folder  # noqa: F401

#: The columns of ``documents``; pipeline stages return these.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space as a Java and RE2 class.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """``col`` with A-Z lowered. Other capitals may be lowered too, but nothing else becomes an ASCII character.

    ``lower`` is many times faster than ``translate``; of all characters only the Kelvin sign and the dotted capital I
    have ASCII letters as their small ones, and texts with these are translated.
    """
    return F.when(F.contains(col, F.lit("\u212a")) | F.contains(col, F.lit("\u0130")), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


#: Rows of a table of short rows that may be broadcast.
BROADCAST_ROWS = 100_000


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, salt: Column) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row for each ``key`` and is written already (see ``cut``).

    The table is broadcast if it has few rows. Else every row of it is repeated for some salts and the rows of a hot key
    are dealt over these by ``salt``, a hash of the row.
    """
    if keyed.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), key)
    salts = 32
    repeated = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(salts))).join(repeated, [key, "_salt"]).drop("_salt")


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each has about ``rows_each`` rows; the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


#: Bytes of rows that go to a Python worker at once, at about; Spark's own limit of 64 MB lets whole partitions go in one batch.
BATCH_BYTES = 4 << 20


def in_short_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends rows to Python workers in batches of about ``BATCH_BYTES``.

    A batch stands in the executor's and in the worker's memory, outside the heap and copied; a longer row is a batch of its own.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


#: What a Python worker keeps from one task to the next, by operator.
kept: dict[str, object] = {}


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, operator: str = "") -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` (a string) holds at most ``most_bytes``, or single longer rows: bounded memory.

    A worker that serves several operators in turn first lets go of what it keeps for another one.
    """
    for other in [x for x in kept if x != operator]:
        del kept[other]
    pa.default_memory_pool().release_unused()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column with nulls as empty texts, with 64-bit offsets, in buffers of its own.

    Some string kernels read a slice from the wrong place, so the rows are copied out of the batch first.
    """
    own = batch.column(column).take(pa.array(np.arange(batch.num_rows)))
    return pc.fill_null(own.cast(pa.large_string()), "")


def ragged(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A list array's items, and the number of its list for each."""
    lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lengths)), lengths)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, and the number of its text for each."""
    words, owner = ragged(pc.ascii_split_whitespace(texts))
    keep = pc.greater(pc.binary_length(words), 0)
    return words.filter(keep), owner[np.asarray(keep)]


def starts_of(owner: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of the runs of a sorted ``owner``."""
    return np.searchsorted(owner, np.arange(n + 1))


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)
