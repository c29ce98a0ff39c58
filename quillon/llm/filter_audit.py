"""Filter interaction audit: what each filter removes after any of the others, from a packed bitmap index.

Within a partition rows become bits: a bitset for each filter (the rows that fail it), for each label and for each
part. The rows that pass the filters of a subset are the AND-NOT of their bitsets; popcounts of those that the
next filter removes are counted for every subset and filter, of each part. Only these counts leave the partition;
their sums give every order of the filters, since what a filter removes depends on the set of those before it, not on
their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

FILTERS = ("A", "B", "C", "D", "E")
#: Classes of equal texts with more than this share of all rows are looked up by broadcast: there are fewer than SHARE of them.
SHARE = 1024
#: Parts whose bitsets are held at a time, and parts whose counts a task holds before it passes them on.
PARTS, HELD = 32, 4096
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#$%&*|")] = True
_AFTER = np.zeros(256, bool)
_AFTER[0x80:0xC0] = True


def text_failures(column: pa.Array) -> list[np.ndarray]:
    """Whether each text fails A (under 200 words), B (under half its words distinct), C (over 3 % A-Z) and D (holds one of #$%&*|)."""
    data, offsets = T.text_buffer(column)
    start, end, first = T.words(data, offsets, T.NOT_SPACE)
    words = np.diff(first)
    hashes, doc = T.word_hashes(data, start, end, T.EXACT), np.repeat(np.arange(len(words)), words)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(words))
    within = lambda which: np.diff(np.concatenate([[0], np.cumsum(which[data])])[offsets])
    points = np.diff(offsets) - within(_AFTER)
    return [words < 200, 100 * distinct < 50 * words, 100 * within(_UPPER) > 3 * points, within(_SIGNS) > 0]


def failures(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, A to E) of each row of docs; part is empty where null.

    E: another row with a smaller doc_id has the same text (by 128 bits of hashes and its length), a null text being
    empty. A row without a doc_id neither fails E nor makes others fail it.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[part], F.lit("")).alias("part"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), F.octet_length(body).alias("bytes"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            flags = [pa.array(x) for x in text_failures(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "h1", "h2", "bytes")] + flags, ["doc_id", "part", "h1", "h2", "bytes", *FILTERS[:4]])

    table = scratch.table(rows.mapInArrow(run, "doc_id long, part string, h1 long, h2 long, bytes int, A boolean, B boolean, C boolean, D boolean"), "rows")
    same = ["h1", "h2", "bytes"]
    classes = scratch.table(table.groupBy(*same).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "classes")
    # A class of more than 1 / SHARE of all rows leaves room for fewer than SHARE such classes, which is what is broadcast.
    most = max(table.count() // SHARE, 1)
    large = classes.where(F.col("n") > most).select(*same, F.col("first").alias("first_of_large"))
    small = classes.where(F.col("n") <= most).select(*[F.col(c).alias(f"s_{c}") for c in same], "first")
    found = table.join(F.broadcast(large), same, "left")
    # Rows that have their answer are dealt by their id in the second join, where they meet nothing.
    key = F.when(F.col("first_of_large").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id"))
    found = found.withColumn("key", key).join(small, (F.col("key") == F.col("s_h1")) & (F.col("h2") == F.col("s_h2")) & (F.col("bytes") == F.col("s_bytes")), "left")
    copy = F.coalesce(F.col("doc_id") > F.coalesce("first_of_large", "first"), F.lit(False))
    return found.select("doc_id", "part", *FILTERS[:4], copy.alias("E"))


def _block(part: np.ndarray, n_parts: int, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Counts[part, subset, filter] of COUNTS of one block of rows; those of a filter within its own subset stay 0."""
    pack = lambda x: np.ascontiguousarray(np.packbits(np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, -x.shape[-1] % 64)]), axis=-1)).view(np.uint64)
    of, of_part, of_good, of_toxic = pack(fails), pack(part == np.arange(n_parts)[:, None]), pack(good), pack(toxic)
    ones = lambda x: np.bitwise_count(x & of_part).sum(axis=-1, dtype=np.int64)
    k = len(fails)
    out = np.zeros((n_parts, 1 << k, k, len(COUNTS)), np.int64)
    gone = np.zeros((1 << k, of.shape[1]), np.uint64)
    for subset in range(1 << k):
        if subset:
            low = (subset & -subset).bit_length() - 1
            gone[subset] = gone[subset & (subset - 1)] | of[low]
        for f in range(k):
            if not subset >> f & 1:
                removed = of[f] & ~gone[subset]
                each = (~(gone[subset] | of[f]), removed, of[f] & gone[subset], removed & of_good, removed & of_toxic)
                out[:, subset, f] = np.stack([ones(x) for x in each], axis=-1)
    return out


def subset_counts(rows: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """(part, subset, filter, COUNTS) from rows of (part, a boolean for each filter, good, toxic).

    ``subset`` has the bits of the filters applied before, ``filter`` is the place of the next one. Nulls of booleans count as false, and a null part is empty.
    """
    k = len(filters)
    keys = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]

    def table(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        counts = np.stack(list(sums.values()))[:, [s for s, _ in keys], [f for _, f in keys]].reshape(-1, len(COUNTS))
        tiled = [np.tile(np.array([x[i] for x in keys], np.int32), len(sums)) for i in (0, 1)]
        names = pa.array(np.repeat(np.array(list(sums), object), len(keys)), pa.string())
        return pa.RecordBatch.from_arrays([names, *map(pa.array, tiled), *[pa.array(np.ascontiguousarray(c)) for c in counts.T]], ["part", "subset", "filter", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = pc.dictionary_encode(batch.column("part"))
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            bits = np.stack([pc.fill_null(batch.column(c), False).to_numpy(zero_copy_only=False) for c in (*filters, "good", "toxic")])
            order = np.argsort(codes, kind="stable")
            first = np.searchsorted(codes[order], np.arange(0, len(names) + PARTS, PARTS))
            for i, (a, b) in enumerate(zip(first, first[1:])):
                some, at = names[i * PARTS : (i + 1) * PARTS], order[a:b]
                for name, counts in zip(some, _block(codes[at] - i * PARTS, len(some), bits[:k, at], bits[k, at], bits[k + 1, at])):
                    sums[name] = sums[name] + counts if name in sums else counts
            if len(sums) > HELD:
                yield table(sums)
                sums = {}
        if sums:
            yield table(sums)

    counted = rows.select(F.coalesce("part", F.lit("")).alias("part"), *filters, "good", "toxic").mapInArrow(run, "part string, subset int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.groupBy("part", "subset", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(rows: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """A row for each part, filter_order and step, zeros included, from rows as subset_counts takes them.

    ``filters`` are named by single letters. Counts of the part at that step: kept, removed, redundant (fail the filter, removed
    before), unique_fails (fail only this filter), good_lost and toxic_lost (removed with that label), and shapley, what
    the filter removes summed over all orders. No rows, no parts, no result.
    """
    scratch, k = Scratch(rows.sparkSession, "filter-audit"), len(filters)
    sums = scratch.table(subset_counts(rows, filters), "subsets")
    # So many orders have this very subset before the filter.
    weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), F.bit_count("subset") + 1)
    alone = F.bit_count("subset") == k - 1
    by_filter = sums.groupBy("part", "filter").agg(F.max(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(weight * F.col("removed")).cast("long").alias("shapley"))
    steps = [("".join(filters[f] for f in p), i + 1, sum(1 << f for f in p[:i]), p[i]) for p in permutations(range(k)) for i in range(k)]
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, subset int, filter int")
    found = sums.join(by_filter, ["part", "filter"]).join(F.broadcast(orders), ["subset", "filter"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Rows that repeat a doc_id count each; a doc_id has a label if any of its rows in labels has it."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    failed = failures(docs.select("doc_id", "text", "lang"), Scratch(spark, "filter-failures"))
    return audit(failed.join(marks, "doc_id", "left"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM w LEFT JOIN marks USING (doc_id)
), cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(range(0, 5)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x + 1]), '') AS filter_order, CAST(step AS INT) AS step, CAST(1 << o[step] AS INT) AS f, coalesce(list_sum(list_transform(o[1:step - 1], lambda x: CAST(1 << x AS INT))), 0)::INT AS s
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN mask & (s | f) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & f <> 0 AND mask & s = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & f <> 0 AND mask & s <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & f <> 0 AND mask & s = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & f <> 0 AND mask & s = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
