"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import contextlib
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words; every other character
#: belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column | str) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array (NULL: empty)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def text_bytes(text: str | None) -> bytes:
    """UTF-8 bytes; a lone surrogate becomes a replacement character."""
    return b"" if text is None else text.encode("utf-8", "replace")


def lower_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased.  `bytes.split()` cuts at
    exactly the six ASCII blanks that separate words here."""
    return text_bytes(text).lower().split()


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod folds; NULL ids are in fold 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fold_of(doc_id: int | None, folds: int = 5) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def internal(name: str) -> str:
    """A column name that no input column can clash with."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def small_side_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left",
                    max_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """Join a large table to a table of statistics, null-safe on `keys`.

    The small side is counted first: up to `max_rows` rows it is broadcast.
    Beyond that both sides are shuffled on the keys and a salt, so that a key
    that holds a third of the large side is spread over `salts` tasks.
    `big` keeps its columns; `small` adds its other columns.
    """
    marks = {k: internal(k) for k in keys}
    salt = internal("salt")
    if small.limit(max_rows + 1).count() <= max_rows:
        right = F.broadcast(small.withColumnsRenamed(marks))
        on = [F.col(k).eqNullSafe(F.col(m)) for k, m in marks.items()]
        return big.join(right, on, how).drop(*marks.values())
    left = big.withColumn(salt, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumnsRenamed(marks).withColumn(
        salt + "r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [F.col(k).eqNullSafe(F.col(m)) for k, m in marks.items()] + [
        F.col(salt) == F.col(salt + "r")]
    return left.join(right, on, how).drop(*marks.values(), salt, salt + "r")


#: Texts that go to a Python worker together: records, and bytes where Spark
#: bounds them.  The defaults (10,000 records of 2 KB) hold some 100 MB in
#: buffers of each task on either side.
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
              "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches for the session, unless its user has set them."""
    chosen = spark.sparkContext.getConf()
    for key, value in TEXT_BATCH.items():
        if not chosen.contains(key):
            spark.conf.set(key, value)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers
    are kept for later tasks and share the machine with the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no trim
        ctypes.CDLL(None).malloc_trim(0)


def arrow_fs(uri: str):
    """(file system, path) of a folder of the shared store, for tasks that
    write their own file format."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:"):].lstrip("/")
    elif "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)
