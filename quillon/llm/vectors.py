"""Vector columns as matrices, the best k of each query, and searches that stream queries past parts of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matrices(batch: pa.RecordBatch, ids: str, vectors: str, zero: bool = False) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each dimension the ids (int64), the vectors (float64, one a row) and their rows in the batch.

    Vectors that are null, empty or hold null or non-finite components are left out, as are rows without an id
    and, unless ``zero``, vectors of zeros.
    """
    column, key = batch.column(vectors), batch.column(ids)
    keep = pc.and_(pc.is_valid(column), pc.is_valid(key))
    place = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
    column, key = column.filter(keep), key.filter(keep).cast(pa.int64()).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64())
    flat = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    out = {}
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[first[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1)
        if not zero:
            good &= (x != 0).any(1)
        out[d] = (key[rows[good]], x[good], place[rows[good]])
    return out


def best(query: np.ndarray, badness: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of each query with the lowest badness, ties to smaller ids, in that order."""
    order = np.lexsort((ids, badness, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    step = raw.dtype.itemsize * raw.shape[1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int64) * step), pa.py_buffer(raw)]).cast(pa.binary())


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def hashed(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, x, h1, h2): rows that have an id and a vector, with two hashes of it."""
    own = df.select(df[vec_id].cast("long").alias("id"), df[embedding].alias("x")).where("id is not null and x is not null")
    return own.select("id", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))


def one_each(queries: DataFrame) -> DataFrame:
    """Of the rows (id, x, h1, h2) that share an id the one of lowest hash."""
    return queries.groupBy("id").agg(F.min_by(F.struct("x", "h1", "h2"), F.struct("h1", "h2")).alias("r")).select("id", "r.x", "r.h1", "r.h2")


def once(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows (id, x, h1, h2), those that repeat both id and vector once, and (id, h1, h2, copies) of these; None if there are none."""
    many = rows.groupBy("id", "h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1")
    return (rows, None) if many.isEmpty() else (rows.dropDuplicates(["id", "h1", "h2"]), many)


def repeated(found: DataFrame, many: DataFrame | None, k: int) -> DataFrame:
    """found (id, h1, h2 and more) with ``copies``: how often a row counts, k at most, as no result has more."""
    if many is None:
        return found.withColumn("copies", F.lit(1).cast("long"))
    return found.join(many, ["id", "h1", "h2"], "left").withColumn("copies", F.least(F.coalesce("copies", F.lit(1)), F.lit(k)).cast("long"))


def representatives(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors those of the k + 1 smallest ids: no search for k rows beside the query's own needs more of them, however many there are.

    The window's limit applies within each task before the shuffle, so a frequent vector burdens no task.
    """
    place = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


def past(index: DataFrame, queries: DataFrame, parts: int, load: Callable, search: Callable, schema: str) -> DataFrame:
    """search(load(index rows of a part), query rows of the part) for each part: both sides have a column ``part`` (0 to parts - 1), and otherwise the same columns.

    A task holds the index rows of one part at a time; queries stream past in batches, so their number doesn't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready = None, [], None
        for batch in batches:
            key = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)] if len(key) else []
            for a, b in zip(cuts, cuts[1:]):
                if key[a] >> 1 != part:
                    part, held, ready = key[a] >> 1, [], None
                if not key[a] & 1:
                    held.append(batch.slice(a, b - a))
                elif held:
                    ready = load(held) if ready is None else ready
                    yield from search(ready, batch.slice(a, b - a))

    both = index.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)))
    return both.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(run, schema)
