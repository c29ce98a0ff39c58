"""Approximate nearest neighbours: inverted lists of coarse centroids with product-quantised residuals.

Coarse centroids and the codebooks of residuals are trained on a bounded sample; every row is then assigned to
its nearest centroid's list with its code. Lists lie together in groups of bounded size (a long list is cut into
several), and a query goes once to each group that holds one of the lists nearest to it, past the codes that are
there. Distances come from asymmetric tables (query to codebook entries); the rows that come out nearest over all
lists are fetched by id and reranked by their exact vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .scratch import Scratch

F4 = np.float32


@dataclass
class Settings:
    """``sample``: rows trained on at most, as many as ``rows_a_list`` for each list. ``lists``: coarse centroids at most (else the root of the number of rows).
    ``recall``: what the number of probes is set for, on the sample. ``refine``: rows reranked for each query. ``group``: rows of a group at most."""

    sample: int = 131072
    rows_a_list: int = 32
    lists: int = 4096
    subspaces: int = 32
    codes: int = 256
    recall: float = 0.97
    refine: int = 100
    group: int = 1 << 17
    rounds: int = 6
    seed: int = 5


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *[np.argmax(x[i : i + 2048] @ c.T - half, axis=1) for i in range(0, len(x), 2048)]])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty cluster takes the vector of a random row."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n > 0)
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
        if len(lost := np.flatnonzero(n == 0)):
            c[lost] = x[rng.integers(0, len(x), len(lost))]
    return c


class Index:
    """Centroids, codebooks and the number of probes for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, rows: int, s: Settings):
        rng = np.random.default_rng(s.seed)
        x = sample.astype(F4)
        self.dim = x.shape[1]
        lists = int(max(1, min(s.lists, rows**0.5, len(x))))
        self.centroids = k_means(x, lists, s.rounds, rng)
        home = _nearest(x, self.centroids)
        some = rng.permutation(len(x))[: 64 * s.codes]
        rest = x[some] - self.centroids[home[some]]
        self.parts = [p for p in np.array_split(np.arange(self.dim), min(s.subspaces, self.dim))]
        self.books = [k_means(np.ascontiguousarray(rest[:, p]), min(s.codes, len(rest)), s.rounds, rng) for p in self.parts]
        self.probes = self._probes(x, home, s, rng)

    def _probes(self, x: np.ndarray, home: np.ndarray, s: Settings, rng: np.random.Generator) -> int:
        """How many lists hold the share ``recall`` of the ten nearest sample rows of sample rows."""
        k = min(10, len(x) - 1)
        if not k:
            return len(self.centroids)
        found = []
        for asked in np.array_split(rng.permutation(len(x))[:256], 8):
            d = -2.0 * (x[asked] @ x.T) + (x * x).sum(1)
            d[np.arange(len(asked)), asked] = np.inf
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            place = np.argsort(np.argsort(self._off(x[asked]), axis=1), axis=1)
            found.append(np.take_along_axis(place, home[near], 1).ravel())
        found = np.sort(np.concatenate(found))
        return int(found[min(len(found) - 1, int(np.ceil(s.recall * len(found))) - 1)]) + 1

    def _off(self, q: np.ndarray) -> np.ndarray:
        """Half the squared distances of queries and centroids, but for the queries' own length."""
        return 0.5 * (self.centroids**2).sum(1) - q.astype(F4) @ self.centroids.T

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and what a row adds to any query's distance: half the residual's length and its product with the centroid."""
        x = x.astype(F4)
        home = _nearest(x, self.centroids)
        middle = self.centroids[home]
        code = np.stack([_nearest((x - middle)[:, p], b) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        own = np.zeros(len(x), F4)
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            r = book[code[:, m]]
            own += 0.5 * (r * r).sum(1) + (r * middle[:, p]).sum(1)
        return home, code, own

    def probe(self, q: np.ndarray, every: bool = False) -> np.ndarray:
        """The lists nearest to each query, or all."""
        off = self._off(q)
        return np.argpartition(off, self.probes - 1, axis=1)[:, : self.probes] if self.probes < len(self.centroids) and not every else np.tile(np.arange(len(self.centroids)), (len(q), 1))

    def search(self, q_ids: np.ndarray, q: np.ndarray, lists: np.ndarray, ids: np.ndarray, codes: np.ndarray, own: np.ndarray, refine: int, every: bool = False) -> tuple[np.ndarray, ...]:
        """Of each query the ``refine`` nearest rows (in order of their lists) in lists it probes: its place, theirs, and asymmetric distances."""
        off = self._off(q)
        probed = np.zeros((len(q), len(self.centroids)), bool)
        np.put_along_axis(probed, self.probe(q, every), True, 1)
        tables = [q[:, p].astype(F4) @ book.T for p, book in zip(self.parts, self.books)]
        begin = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(begin, np.append(begin[1:], len(lists))):
            asked = np.flatnonzero(probed[:, lists[a]])
            if len(asked):
                d = np.repeat(off[asked, lists[a], None], b - a, axis=1) + own[a:b]
                for m, table in enumerate(tables):
                    d -= table[asked[:, None], codes[a:b, m]]
                d[q_ids[asked, None] == ids[a:b]] = np.inf
                n = min(refine, b - a)
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                found.append((np.repeat(asked, n), (near + a).ravel(), np.take_along_axis(d, near, 1).ravel()))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, F4)
        at, row, d = (np.concatenate(z) for z in zip(*found))
        keep = V.best(at, d, ids[row], refine)
        keep = keep[np.isfinite(d[keep])]
        return at[keep], row[keep], d[keep]


def groups(sizes: dict[int, int], most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Lists laid out in groups of at most ``most`` rows: each list's first group, and over how many it is dealt; and the number of groups."""
    first, number = np.zeros(max(sizes, default=0) + 1, np.int64), np.ones(max(sizes, default=0) + 1, np.int64)
    group, room = 0, most
    for i, n in sorted(sizes.items()):
        if n > room and room < most:
            group, room = group + 1, most
        number[i] = max(1, -(-n // most))
        first[i] = group
        if number[i] > 1:
            group, room = group + int(number[i]), most
        else:
            room -= n
    return first, number, group + 1


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, settings: Settings | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest rows found (all candidates, if fewer), by Euclidean distance, ties to the smaller vec_id.

    A row with the query's own vec_id is no candidate. Vectors that are null, empty or zero or hold null or
    non-finite components take no part. Vectors are near to those of their own length alone; each length has an index of its own. Of queries that
    share a vec_id the one with the lowest hash counts; rows that share one count each, also those that repeat a vector. A table without usable vectors gives no rows. Other columns are not read.
    """
    s = settings or Settings()
    rows, queries = V.hashed(rows, vec_id, embedding).where("size(x) > 0"), V.one_each(V.hashed(queries, vec_id, embedding))
    lengths = rows.groupBy(F.size("x").alias("d")).count().collect()
    rows, many = V.once(rows)
    found = [_nearest_of_length(rows.where(F.size("x") == r.d), queries.where(F.size("x") == r.d), int(r["count"]), many, k, s) for r in sorted(lengths)]
    none = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionAll, found) if found else none


def _nearest_of_length(rows: DataFrame, queries: DataFrame, total: int, many: DataFrame | None, k: int, s: Settings) -> DataFrame:
    """nearest() among vectors of one length, each (id, x, h1, h2) once; ``many`` tells which count more than once."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "ivf-pq")
    wanted = int(min(s.sample, s.rows_a_list * max(64, min(s.lists, total**0.5)) + 64 * s.codes))
    # Rows whose hash is below a threshold, so that no task sorts or merges the samples of all others; the limit only guards the driver.
    share = min(1.0, wanted / max(1, total))
    sampled = rows.where(F.pmod(F.xxhash64("id", "h1"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "x").limit(int(1.2 * wanted) + 64)
    drawn = sampled.toArrow()
    if not sum(len(x) for b in drawn.to_batches() for _, x, _ in V.matrices(b, "id", "x").values()):
        # None of the sample can be used: the others are few in proportion, yet take part.
        drawn = rows.select("id", "x").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)).limit(wanted).toArrow()
    found = [(ids, x.astype(F4)) for b in drawn.to_batches() for ids, x, _ in V.matrices(b, "id", "x").values() if len(ids)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids, sample = (np.concatenate(z) for z in zip(*found))
    index = spark.sparkContext.broadcast(Index(sample[np.argsort(ids, kind="stable")], total, s))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, place in V.matrices(batch, "id", "x").values():
                if len(ids):
                    home, code, own = index.value.encode(x)
                    h1, h2 = (batch.column(c).take(pa.array(place)) for c in ("h1", "h2"))
                    yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(ids), h1, h2, pa.array(own), V.binary(code)], ["list", "id", "h1", "h2", "own", "data"])

    listed = rows.mapInArrow(assign, "list int, id long, h1 long, h2 long, own float, data binary")
    listed = scratch.table(V.representatives(listed, k), "index")
    sizes = {r.list: r["count"] for r in listed.groupBy("list").count().collect()}  # a row for each list, at most settings.lists
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = min(s.group, max(4096, -(-sum(sizes.values()) // spread)))
    first, number, n_groups = groups(sizes, most)
    layout = spark.sparkContext.broadcast((first, number, n_groups))
    at = lambda a: F.element_at(F.lit(a.tolist()), F.col("list") + 1)
    data = listed.withColumn("part", at(first) + F.pmod(F.xxhash64("id", "h1"), at(number)))

    def probe(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
        first, number, n_groups = layout.value
        for batch in batches:
            for ids, x, _ in V.matrices(batch, "id", "x").values():
                for i in range(0, len(ids), 256):
                    q = x[i : i + 256].astype(F4)
                    lists = index.value.probe(q, every)
                    which = np.repeat(np.arange(len(q)), lists.shape[1])
                    lists = lists.ravel()
                    known = lists < len(first)
                    which, lists = which[known], lists[known]
                    n = number[lists]
                    part = np.repeat(first[lists], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    sent = np.unique(np.repeat(which, n) * n_groups + part)  # once to each group, however many of its lists are probed
                    which, part = sent // n_groups, sent % n_groups
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(ids[i : i + 256][which]), V.binary(q[which])], ["part", "id", "data"])

    none = {"list": "int", "h1": "long", "h2": "long", "own": "float"}

    def load(held: list[pa.RecordBatch]) -> tuple:
        whole = pa.Table.from_batches(held).sort_by([("list", "ascending"), ("id", "ascending")]).combine_chunks()
        return (*(whole[c].to_numpy() for c in ("list", "id", "h1", "h2", "own")), V.matrix(whole["data"].combine_chunks(), np.uint8))

    def search(part: tuple, asked: pa.RecordBatch, every: bool) -> Iterator[pa.RecordBatch]:
        lists, ids, h1, h2, own, codes = part
        for i in range(0, asked.num_rows, 256):
            mine = asked.slice(i, 256)
            q_ids = mine.column("id").to_numpy()
            q, row, d = index.value.search(q_ids, V.matrix(mine.column("data"), F4), lists, ids, codes, own, s.refine, every)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[q], ids[row], h1[row], h2[row], d)], ["query_id", "id", "h1", "h2", "d"])

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))

    def candidates(asked: DataFrame, every: bool) -> DataFrame:
        """(query_id, id, h1, h2) of the refine nearest codes in the lists probed, or in every list."""
        sent = asked.mapInArrow(lambda b: probe(b, every), "part long, id long, data binary").select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        near = V.past(data, sent, n_groups, load, lambda part, b: search(part, b, every), "query_id long, id long, h1 long, h2 long, d float")
        near = near.withColumn("place", place).where(F.col("place") <= s.refine).drop("place", "d").distinct()
        return scratch.table(near, "near-of-all" if every else "near")

    near = candidates(queries, False)
    # Queries that met fewer than k rows in the lists they probe go past all lists.
    short = queries.join(near.groupBy("query_id").count().where(F.col("count") >= k).withColumnRenamed("query_id", "id"), "id", "left_anti")
    if not short.isEmpty():
        short = scratch.table(short, "short")
        near = near.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(candidates(short, True))
    scratch.drop("index")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, place in V.matrices(batch, "id", "x").values():
                own = batch.take(pa.array(place))
                if len(ids):
                    ((_, q, _),) = V.matrices(own, "id", "q").values()
                    score = np.sqrt(((q - x) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([own.column("query_id"), pa.array(ids), pa.array(score), own.column("copies")], ["query_id", "vec_id", "score", "copies"])

    exact = rows.join(V.repeated(near, many, k), ["id", "h1", "h2"]).join(queries.select(F.col("id").alias("query_id"), F.col("x").alias("q")), "query_id")
    scored = exact.select("query_id", "id", "x", "q", "copies").mapInArrow(rerank, "query_id long, vec_id long, score double, copies long")
    each = scored if many is None else scored.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return each.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op1_ivf_pq(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
