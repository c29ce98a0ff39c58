"""Passages that documents share, by a sparse suffix array.

Of all suffixes of all texts (from a word on) only those at minimiser positions are retained: positions whose
next ANCHOR words have the lowest hash in some stretch of the words of one passage. Any two occurrences of a
passage of ``min_words`` words retain suffixes at the same places. First the suffixes go by the hash of their
beginning, and those whose beginning only one document has are dropped. The others are sorted by what follows,
word by word, dealt by range over all tasks. Each is compared with its neighbours of other documents: the common
words that follow and, from the suffix to the left, those before it. A match of ``min_words`` words in all gives
the starts of all stretches within it.

The neighbour with the longest match to the right need not have the longest to the left. Where the two come from
different documents, or a range ends within a beginning, the few stretches left open are compared by their hash.
Stretches that another document has too are united to the longest passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from . import vectors as V
from .scratch import Scratch

#: Words of a suffix's beginning that are compared first.
ANCHOR = 16
#: Bytes of text that are cut into words at a time, and suffixes that are compared at a time.
CHUNK, PIECE = 1 << 20, 1 << 14


def _words(batch: pa.RecordBatch) -> list[np.ndarray]:
    data, offsets = T.text_buffer(batch.column("text"))
    start, end, first = T.words(data, offsets, T.NOT_SPACE)
    hashes = T.word_hashes(data, start, end)
    return [hashes[a:b] for a, b in zip(first[:-1], first[1:])]


def minimisers(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ANCHOR words from each word on, and the place of the lowest of them (the first, of equals) in each stretch of min_words words."""
    anchors = T.shingle_hashes(words, ANCHOR)
    return anchors, np.lib.stride_tricks.sliding_window_view(anchors, min_words - ANCHOR + 1).argmin(1) + np.arange(len(words) - min_words + 1)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """In how many words rows of a and b agree from the beginning."""
    return np.minimum(np.where((same := a == b).all(1), a.shape[1], same.argmin(1)), most)


class Neighbours:
    """A run of retained suffixes in order: contexts to the right and to the left (nearest word first), compared with neighbours of other documents."""

    def __init__(self, rows: pa.Table, min_words: int):
        self.key, self.doc, self.at, self.low, self.high, self.n_left, self.n_right = (rows[c].to_numpy() for c in ("key", "doc_id", "at", "low", "high", "n_left", "n_right"))
        side = lambda c: V.matrix(rows[c].combine_chunks(), np.uint32)
        self.right, self.left, self.min_words = side("right"), side("left"), min_words

    def _of_others(self, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and their nearest row of another document before and after them in an order, within their key."""
        key, doc = self.key[order], self.doc[order]
        opens = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        begin = np.flatnonzero(opens)
        run = np.cumsum(opens) - 1
        before, after = begin[run] - 1, np.append(begin[1:], len(key))[run]
        out = []
        for near in (before, after):
            inside = (near >= 0) & (near < len(key))
            inside[inside] = key[near[inside]] == key[inside]
            out.append((order[inside], order[near[inside]]))
        return out

    def matches(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(row, words to the left, words to the right) of matches with neighbours in the order of what follows; and each row's longest match either way with any other document."""
        wide, n = self.left.shape[1], len(self.key)
        longest = [np.full(n, -1), np.full(n, -1)]
        found = []
        by_left = np.lexsort((self.doc, *self.left.T[::-1], self.key))
        for a, b in self._of_others(np.arange(n)):
            right = ANCHOR + _common(self.right[a], self.right[b], np.minimum(self.n_right[a], self.n_right[b]))
            left = _common(self.left[a], self.left[b], np.minimum(self.n_left[a], self.n_left[b]))
            np.maximum.at(longest[1], a, right)
            found.append((a, left, right))
        for a, b in self._of_others(by_left):
            np.maximum.at(longest[0], a, _common(self.left[a], self.left[b], np.minimum(self.n_left[a], self.n_left[b])))
        assert wide == self.right.shape[1]
        return [np.concatenate(z) for z in zip(*found)], *longest

    def results(self, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Kind 0: (doc_id, a, b), the first and last start of stretches that match. Kind 1: (key, doc_id, a), by their hash, stretches of which
        it isn't known, and those that they may equal.

        ``cut``: rows whose key may go on elsewhere.
        """
        w, wide = self.min_words, self.left.shape[1]
        (row, left, right), far_left, far_right = self.matches()
        hit = left + right >= w
        row, left, right = row[hit], left[hit], right[hit]
        yield _batch(0, self.key[row], self.doc[row], self.at[row] - left, self.at[row] + right - w)
        known = np.zeros((len(self.key), wide + 2), np.int32)  # offsets of a stretch's start before its suffix that are settled
        np.add.at(known, (row, np.maximum(0, w - right)), 1)
        np.add.at(known, (row, left + 1), -1)
        offset = np.arange(wide + 1)
        own = (offset >= self.low[:, None]) & (offset <= self.high[:, None])
        known = (np.cumsum(known, axis=1)[:, :-1] > 0) & own
        # Where the longest matches either way are with one neighbour, there is no other; else they bound what there may be.
        open_ = own & ~known & (cut[:, None] | ((offset >= w - far_right[:, None]) & (offset <= far_left[:, None])))
        group = np.cumsum(np.concatenate([[False], self.key[1:] != self.key[:-1]]))
        asked = np.bincount(group, cut | open_.any(1))[group] > 0
        yield self._by_hash(*np.nonzero(open_))
        # Open ones must find those that are settled; of equal ones two, of different documents, are enough.
        r, o = np.nonzero(known & asked[:, None])
        settled = self._by_hash(r, o)
        key, doc = settled["key"].to_numpy(), settled["doc_id"].to_numpy()
        order = np.lexsort((doc, key))
        opens = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(order)]
        ends = np.concatenate([opens[1:], [True]])[: len(order)]
        yield settled.take(pa.array(order[opens | ends]))

    def _by_hash(self, r: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
        """Stretches that start o words before the suffixes r."""
        wide = self.left.shape[1]
        place = T.splitmix(np.arange(1, 2 * wide + 3, dtype=T.U)) | T.U(1)
        rows, r_ = np.unique(r, return_inverse=True)
        left, right = (np.concatenate([np.zeros((len(rows), 1), T.U), np.cumsum(side[rows].astype(T.U) * place[i * wide : (i + 1) * wide], axis=1, dtype=T.U)], axis=1) for i, side in enumerate((self.left, self.right)))
        whole = T.splitmix(self.key[r].view(T.U) + left[r_, o] + right[r_, wide - o] + place[-1] * o.astype(T.U))
        return _batch(1, T.int64(whole), self.doc[r], self.at[r] - o, self.at[r] - o)


def _batch(kind: int, key, doc, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), *(pa.array(x, pa.int64()) for x in (key, doc, a, b))], ["kind", "key", "doc_id", "a", "b"])


def compared(suffixes: DataFrame, min_words: int) -> DataFrame:
    """(kind, key, doc_id, a, b) from the retained suffixes, dealt by range and sorted by what follows them; see Neighbours.results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, opening, went_on = 0, None, None

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, number, opening, went_on
            whole = pa.Table.from_batches(held).combine_chunks()
            key = whole["key"].to_numpy()
            opening = key[0] if opening is None else opening
            # The last key waits for the next batch, unless it alone fills a piece.
            end = len(key) if last or key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
            own = key[:end]
            cut = (own == opening) | (own == key[-1]) | (own == (own[0] if went_on is None else went_on))
            went_on = key[-1] if end == len(key) else None
            yield from Neighbours(whole.slice(0, end), min_words).results(cut)
            rest = whole.slice(end)
            held, number = rest.to_batches(), rest.num_rows

        for batch in batches:
            for i in range(0, batch.num_rows, PIECE):
                held.append(batch.slice(i, PIECE))
                number += held[-1].num_rows
                if number >= PIECE:
                    yield from settle(False)
        if number:
            yield from settle(True)

    # Copies of a frequent passage are alike up to the document, so that is part of the range.
    order = ["key", "right", "left", "doc_id", "at"]
    ranged = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "kind int, key long, doc_id long, a long, b long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Of rows (key, doc_id, at) those whose key rows of another document have too.

    Rows are dealt by range over (key, doc_id), sorted, and compared with their neighbours as they stream by. A
    frequent key may fill many partitions. What a partition cannot tell about its first and last key, a few
    rows a partition do.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, doc, at, kind):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(np.full(len(key), kind), pa.int32())], ["key", "doc_id", "at", "kind"])

        held = [np.zeros(0, np.int64)] * 3  # rows of the last key, all of one document so far
        last, several, opening = None, False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, at = (np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "doc_id", "at")))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(begin[1:], len(key))
            multi = doc[begin] != doc[end - 1]
            if last is not None and len(key) and key[0] == last and several:
                multi[0] = True
            if opening is None:
                opening = key[0]
            yield_rows = np.repeat(multi, end - begin)
            edge = begin[0] if key[0] == opening and not multi[0] else None
            if key[0] == opening:
                yield out(key[[0, end[0] - 1]], doc[[0, end[0] - 1]], at[[0, 0]], 2)
            yield out(key[yield_rows], doc[yield_rows], at[yield_rows], 0)
            tail = slice(begin[-1], end[-1])
            if edge is not None and len(begin) > 1:
                yield out(key[: end[0]], doc[: end[0]], at[: end[0]], 1)
            last, several = key[-1], bool(multi[-1])
            held = [np.zeros(0, np.int64)] * 3 if several else [x[tail] for x in (key, doc, at)]
            closing = (key[-1], doc[begin[-1]], doc[-1])
        if last is not None:
            yield out(np.array([closing[0]] * 2), np.array(closing[1:]), np.zeros(2, np.int64), 2)
            if len(held[0]):
                yield out(*held, 1)

    ranged = rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "at")
    found = ranged.mapInArrow(compare, "key long, doc_id long, at long, kind int")
    return found


def _resolved(found: DataFrame) -> DataFrame:
    """Rows of the first and last keys of the partitions, once it is known which documents have those keys."""
    known = found.where("kind = 2").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("key")
    edges = found.where("kind = 1").join(known, "key", "left_semi")
    return found.where("kind = 0").unionAll(edges).select("key", "doc_id", "at")


def shared_passages(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words): the longest stretches of at least min_words words of which each min_words words are in another document too.

    Words are runs of characters other than white space, A-Z lower-cased, counted from 0. Null and empty texts
    have none, nor have texts of fewer words. Rows that share a doc_id count as one document, and give their
    passages together. A table without rows gives none; other columns are not read.
    """
    if min_words < ANCHOR + 1:
        raise ValueError(f"min_words must be above {ANCHOR}")
    scratch = Scratch(docs.sparkSession, "passages")
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))

    wide = min_words - ANCHOR

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, limit=CHUNK):
            found = []
            for w in _words(batch):
                every, at = minimisers(w, min_words) if len(w) >= min_words else (np.zeros(0, T.U), np.zeros(0, np.int64))
                found.append(np.unique(every[at]))
            doc = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(T.int64(np.concatenate(found))), pa.array(doc, pa.int64()), pa.array(np.zeros(len(doc), np.int64))], ["key", "doc_id", "at"])

    def retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, limit=CHUNK):
            left, ids = batch.column("keys"), batch.column("doc_id").to_numpy()
            rows: list[tuple[np.ndarray, ...]] = []
            for i, w in enumerate(_words(batch)):
                if len(w) < min_words:
                    continue
                every, at = minimisers(w, min_words)
                kept = np.flatnonzero(np.isin(every[at], left[i].values.to_numpy(zero_copy_only=False).view(T.U)))
                m, begin, number = np.unique(at[kept], return_index=True, return_counts=True)  # the stretches of a minimiser are neighbours
                first = kept[begin]
                padded = np.concatenate([np.zeros(wide, np.uint32), (w >> T.U(32)).astype(np.uint32) | np.uint32(1), np.zeros(wide, np.uint32)])
                sides = padded[(m + wide - 1)[:, None] - np.arange(wide)], padded[(m + wide + ANCHOR)[:, None] + np.arange(wide)]
                rows.append((T.int64(every[m]), np.full(len(m), ids[i]), m, m - first - number + 1, m - first, np.minimum(m, wide), np.minimum(len(w) - m - ANCHOR, wide), *sides))
            if rows:
                *plain, back, after = (np.concatenate(z) for z in zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in plain), V.binary(back), V.binary(after)], ["key", "doc_id", "at", "low", "high", "n_left", "n_right", "left", "right"])

    whole = docs.where("doc_id is not null and text is not null")
    beginnings = scratch.table(whole.mapInArrow(anchors, "key long, doc_id long, at long"), "beginnings")
    several = scratch.table(shared_keys(beginnings), "several")
    scratch.drop("beginnings")
    left = _resolved(several).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    schema = "key long, doc_id long, at long, low long, high long, n_left long, n_right long, left binary, right binary"
    suffixes = scratch.table(whole.join(left, "doc_id").mapInArrow(retained, schema), "suffixes")
    found = scratch.table(compared(suffixes, min_words), "found")
    scratch.drop("several", "suffixes")
    rest = scratch.table(shared_keys(found.where("kind = 1").select("key", "doc_id", F.col("a").alias("at"))), "rest")
    hits = found.where("kind = 0").select("doc_id", "a", "b").unionAll(_resolved(rest).select("doc_id", "at", "at"))
    # Hits of a document in order; one further than min_words from all before it opens a passage.
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = hits.distinct().withColumn("opens", (reach.isNull() | (F.col("a") - reach > min_words)).cast("int"))
    spans = opens.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "span").agg(F.min("a").alias("start_word"), (F.max("b") - F.min("a") + min_words).alias("n_words")).drop("span")


def op7_shared_passages(spark, sf_dir: str) -> DataFrame:
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), starts AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM words WHERE len(w) >= 50),
stretches AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 50], ' ') AS s FROM starts),
shared AS (SELECT s FROM stretches GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, pos, pos - lag(pos, 1, -1000) OVER (PARTITION BY doc_id ORDER BY pos) > 50 AS opens FROM stretches SEMI JOIN shared USING (s)),
spans AS (SELECT doc_id, pos, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM hits)
SELECT doc_id, min(pos) AS start_word, max(pos) - min(pos) + 50 AS n_words FROM spans GROUP BY doc_id, g
"""
