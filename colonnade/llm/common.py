"""What the operators share: reading text columns in Arrow batches, and named columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def column(name: str):
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The two columns an operator reads, as `id` and `text`; a null text counts as empty."""
    return docs.select(
        column(id_column).alias("id"), F.coalesce(column(text_column).cast("string"), F.lit("")).alias("text")
    )


def small_batches(docs: DataFrame) -> DataFrame:
    """`docs`, after the session was told to send a thousand rows at a time to Python where it has Spark's default of
    ten thousand: rows that hold texts would fill an executor's memory outside the heap, twice where they come back."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, "1000")
    return docs


def per_text(
    docs: DataFrame, prepare: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str, id_column: str
) -> DataFrame:
    """Columns computed from each text of an `id, text` frame, beside its id.  `prepare` runs once in
    each task and gives a function from a batch of texts to columns."""
    id_type = docs.schema["id"].dataType.simpleString()
    out = f"`{id_column}` {id_type}, {schema}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            for part in portions(batch):
                columns = compute(part.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict({id_column: part.column(0), **columns})

    return docs.mapInArrow(run, out)


def portions(batch: pa.RecordBatch, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of a few megabytes, so that long texts don't pile up as Python strings."""
    rows = batch.num_rows
    if not rows:
        return
    each = max(1, rows * most_bytes // max(batch.nbytes, 1))
    for start in range(0, rows, each):
        yield batch.slice(start, each)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same on every machine."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n neighbours in order; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return hashes[:0]
    with np.errstate(over="ignore"):
        out = hashes[:count].copy()
        for k in range(1, n):
            out = out * _FACTOR + hashes[k : k + count]
        out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Which of `length` places lie in a stretch of `width` from one of the starts."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, length), -1)
    return np.cumsum(edge[:-1]) > 0


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], salts: int = 8) -> DataFrame:
    """`many` joined with one row per key of `few`, a key's rows dealt over `salts` parts by the columns `by`.

    Copying the few rows also makes Spark shuffle them for this join, so that it can split parts still too large."""
    each = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return dealt.join(each, [*keys, "__salt"]).drop("__salt")
