"""Exact top-k search by inner product with vector-approximation files.

The components of a vector are integers floor(scale * x). The approximation file holds of each vector one byte a
component: the cell of a grid whose width (a power of two) is the vector's own. Queries stream past parts of the
file; a cell's edges give an upper and a lower bound of each score, and what cannot reach the k-th highest lower
bound drops out. Exact vectors are then read in the order of their upper bounds: the first k of each query, and
after them those whose bound still reaches the k-th exact score. Then the result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .scratch import Scratch

#: Bytes of cells in a part, rows below which a table isn't parted further, and queries and rows that are compared at a time.
PART_BYTES, PART_ROWS, QUERIES, ROWS = 32 << 20, 4096, 256, 4096
_EXACT = float(1 << 53)


def scaled(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each dimension ids, vectors of whole numbers (as doubles), and their rows in the batch."""
    for ids, x, place in V.matrices(batch, "id", "x", zero=True).values():
        with np.errstate(over="ignore"):
            y = np.floor(scale * x)
        good = np.isfinite(y).all(1)
        yield ids[good], y[good], place[good]


def cells(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of vectors, one byte a component, and the bits of a cell's width: the fewest for which all components fit."""
    most = np.maximum(y.max(1) + 1, -y.min(1)) / 128
    part, bits = np.frexp(most)
    bits = np.maximum(0, np.where(part > 0.5, bits, bits - 1)).astype(np.int32)
    return np.clip(np.floor(np.ldexp(y, -bits[:, None])), -128, 127).astype(np.int8), bits


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries with vectors that lie between low and low + width."""
    with np.errstate(over="ignore", invalid="ignore"):
        base = q @ low.T
        lower, upper = base + np.minimum(q, 0).sum(1)[:, None] * width, base + np.maximum(q, 0).sum(1)[:, None] * width
        most = np.abs(q).max(1)[:, None] * (np.abs(low).max(1) + width) * q.shape[1]
        slack = np.where(2 * most < _EXACT, 0, most * 2.0**-45)  # sums beyond what doubles hold exactly
        lower, upper = lower - slack, upper + slack
    # Scores end at the range of long, and tie there.
    return np.clip(np.nan_to_num(lower, nan=-np.inf), -(2.0**63), 2.0**63), np.clip(np.nan_to_num(upper, nan=np.inf), -(2.0**63), 2.0**63)


def _load(held: list[pa.RecordBatch]) -> dict[int, tuple]:
    whole = pa.Table.from_batches(held).combine_chunks()
    length = whole["d"].to_numpy()
    out = {}
    for d in np.unique(length).tolist():
        own = whole.filter(pa.array(length == d)).combine_chunks()
        out[d] = (*(own[c].to_numpy() for c in ("id", "h1", "h2", "bits")), V.matrix(own["data"].combine_chunks(), np.int8))
    return out


CANDIDATE = "query_id long, id long, h1 long, h2 long, lower double, upper double"


def _scan(k: int):
    def search(part: dict[int, tuple], asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of each query the rows of the part whose upper bound reaches the k-th highest lower bound so far."""
        length = asked.column("d").to_numpy()
        for d in np.unique(length).tolist():
            if d not in part:
                continue
            own = asked.filter(pa.array(length == d))
            ids, h1, h2, bits, grid = part[d]
            q_ids, q = own.column("id").to_numpy(), V.matrix(own.column("data"), float)
            for i in range(0, len(q), QUERIES):
                best = np.full((len(q[i : i + QUERIES]), k), -np.inf)
                for j in range(0, len(ids), ROWS):
                    wide = np.ldexp(1.0, bits[j : j + ROWS])
                    lower, upper = bounds(q[i : i + QUERIES], grid[j : j + ROWS] * wide[:, None], wide - 1)
                    same = q_ids[i : i + QUERIES, None] == ids[j : j + ROWS]
                    lower[same] = -np.inf
                    best = np.sort(np.partition(np.concatenate([best, lower], axis=1), -k, axis=1)[:, -k:], axis=1)
                    a, b = np.nonzero((upper >= best[:, :1]) & ~same)
                    row = b + j
                    columns = (q_ids[a + i], ids[row], h1[row], h2[row], lower[a, b], upper[a, b])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "h1", "h2", "lower", "upper"])

    return search


def _scores(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Exact inner products of rows (query_id, id, x, q); beyond the range of long its ends."""
    for batch in batches:
        for ids, y, place in scaled(batch, scale):
            own = batch.take(pa.array(place))
            q = V.matrix(own.column("q"), float) if len(place) else np.zeros((0, y.shape[1]))
            large = np.abs(q).max(initial=0) * np.abs(y).max(initial=0) * y.shape[1] * 2 >= _EXACT
            score = [min(max(sum(int(a) * int(b) for a, b in zip(*z)), -(2**63)), 2**63 - 1) for z in zip(q, y)] if large else np.einsum("ij,ij->i", q, y).astype(np.int64)
            yield pa.RecordBatch.from_arrays([own.column("query_id"), pa.array(ids), pa.array(score, pa.int64()), own.column("copies")], ["query_id", "vec_id", "score", "copies"])


def candidates(rows: DataFrame, asked: DataFrame, k: int, scale: float, scratch: Scratch) -> DataFrame:
    """(query_id, id, h1, h2, upper, place): the rows each query may have to read, in the order of their bounds."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, y, place in scaled(batch, scale):
                grid, bits = cells(y) if len(y) else (np.zeros((0, y.shape[1]), np.int8), np.zeros(0, np.int32))
                h1, h2 = (batch.column(c).take(pa.array(place)) for c in ("h1", "h2"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), h1, h2, pa.array(np.full(len(ids), y.shape[1], np.int32)), pa.array(bits), V.binary(grid)], ["id", "h1", "h2", "d", "bits", "data"])

    file = scratch.table(V.representatives(rows.mapInArrow(encode, "id long, h1 long, h2 long, d int, bits int, data binary"), k), "cells")
    size = file.agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes")).first()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-(size.bytes or 0) // PART_BYTES), min(spread, -(-size.n // PART_ROWS)))
    index = file.withColumn("part", F.pmod(F.xxhash64("id", "h1"), F.lit(parts)))
    sent = asked.select("id", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), "d", F.lit(0).alias("bits"), F.col("q").alias("data"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = scratch.table(V.past(index, sent, parts, _load, _scan(k), CANDIDATE).distinct(), "bounds")
    # The k-th highest lower bound over all parts.
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    least = found.select("query_id", "lower", top.alias("top")).where(F.col("top") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("lower").alias("least"))
    left = found.join(least, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("least")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "id", "h1"))
    out = scratch.table(left.select("query_id", "id", "h1", "h2", "upper", place.alias("place")), "candidates")
    scratch.drop("bounds", "cells")
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k rows with the highest integer inner product, ties to the smaller vec_id.

    A row with the query's own vec_id is no candidate. Vectors that are null, empty or hold null or non-finite
    components take no part, nor do those of another length than the query's. Scores beyond the range of long
    come to its ends, and tie there. Of queries that share a vec_id the one with the lowest hash counts; rows that
    share one count each, also those that repeat a vector. Empty tables give no rows. Other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "va-file")
    rows, queries = V.hashed(rows, vec_id, embedding), V.one_each(V.hashed(queries, vec_id, embedding))
    rows, many = V.once(rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, y, _ in scaled(batch, scale):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), y.shape[1], np.int32)), V.binary(y)], ["id", "d", "q"])

    asked = scratch.table(queries.mapInArrow(ask, "id long, d int, q binary"), "queries")
    order = candidates(rows, asked, k, scale, scratch)

    def read(pairs: DataFrame, name: str) -> DataFrame:
        """The exact scores of candidates."""
        near = rows.join(V.repeated(pairs.select("query_id", "id", "h1", "h2"), many, k), ["id", "h1", "h2"]).join(asked.select(F.col("id").alias("query_id"), "q"), "query_id")
        return scratch.table(near.select("query_id", "id", "x", "q", "copies").mapInArrow(lambda b: _scores(b, scale), "query_id long, vec_id long, score long, copies long"), name)

    # In the order of the bounds, twice as many each time; a query is done when no bound that is left reaches its k-th score.
    out, done, size = None, 0, k
    while True:
        due = order.where((F.col("place") > done) & (F.col("place") <= done + size))
        if out is not None:
            top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
            kth = out.withColumn("top", top).where(F.col("top") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
            held = order.where(F.col("place") > done).join(kth, "query_id", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("upper") >= F.col("kth")))
            if held.isEmpty():
                break
            due = held.where(F.col("place") <= done + size)
        more = read(due, f"read-{done}")
        out = more if out is None else out.unionAll(more)
        done, size = done + size, 2 * size
    each = out if many is None else out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    scratch.drop("candidates", "queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return each.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op10_va_file(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scores
)
SELECT * FROM ranked WHERE rank <= 10
"""
