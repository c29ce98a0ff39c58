"""SentencePiece encoding and decoding.

The pieces of a model file form an Aho-Corasick automaton over bytes. One pass over a text walks it; at each
position the output links give the pieces that end there, and each relaxes the best score of that position
from the best score at its start (Viterbi). The pass runs over many texts at once: a piece holds the space
mark only at its beginning, so a text falls into stretches that no piece crosses, one for each run of spaces with
what follows; equal stretches of a batch are encoded once, side by side in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textops as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What an unknown character costs below the lowest score of a piece.
UNKNOWN_PENALTY = 10.0
#: Cells of the score table of one group of stretches.
GROUP = 1 << 21


@dataclass
class Vocabulary:
    """Pieces with scores by id. ``kind``: n (normal), b (a byte), u (unknown), c (control)."""

    pieces: list[str]
    scores: list[float]
    kinds: str


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file; read on the driver only."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.vocab_size())
    kinds = "".join("u" if m.is_unknown(i) else "c" if m.is_control(i) else "b" if m.is_byte(i) else "n" for i in ids)
    return Vocabulary([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], kinds)


class Codec:
    """The automaton of a vocabulary, with encoding and decoding of batches."""

    def __init__(self, v: Vocabulary):
        normal = [i for i, k in enumerate(v.kinds) if k == "n"]
        self.bytes = [p.replace(MARK, " ").encode() if k == "n" else bytes([int(p[3:5], 16)]) if k == "b" else b"" for p, k in zip(v.pieces, v.kinds)]
        self.crossed = any(b" " in self.bytes[i].lstrip(b" ") for i in normal)
        self.byte_id = np.full(256, next(i for i, k in enumerate(v.kinds) if k == "u"), np.int64)
        for i, k in enumerate(v.kinds):
            if k == "b":
                self.byte_id[self.bytes[i][0]] = i
        self.score = np.array(v.scores, np.float64)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.unknown = float(min(v.scores[i] for i in normal)) - UNKNOWN_PENALTY
        self._automaton(normal)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.data = np.frombuffer(b"".join(self.bytes) or b"\0", np.uint8)

    def _automaton(self, normal: list[int]) -> None:
        """goto (complete), piece (that ends in a state, or -1) and link (the state itself if a piece ends there, else the next such suffix, 0 for none)."""
        children: list[dict[int, int]] = [{}]
        depth, piece = [0], [-1]
        for i in normal:
            at = 0
            for b in self.bytes[i]:
                to = children[at].get(b)
                if to is None:
                    to = children[at][b] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                at = to
            piece[at] = i
        n = len(children)
        parent, byte = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for s, kids in enumerate(children):
            for b, to in kids.items():
                parent[to], byte[to] = s, b
        level, self.piece = np.array(depth), np.array(piece, np.int64)
        goto, fail = np.zeros((n, 256), np.int32), np.zeros(n, np.int64)
        self.link, self.after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        goto[0, byte[level == 1]] = np.flatnonzero(level == 1)
        for d in range(1, int(level.max()) + 1):
            here = np.flatnonzero(level == d)
            if d > 1:
                fail[here] = goto[fail[parent[here]], byte[here]]
            goto[here] = goto[fail[here]]
            self.after[here] = self.link[fail[here]]
            self.link[here] = np.where(self.piece[here] >= 0, here, self.after[here])
            below = np.flatnonzero((level == d + 1))
            goto[parent[below], byte[below]] = below
        self.goto = goto

    def _group(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches of one group, all in one array, and the number of each."""
        n, most = len(start), int(length.max())
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0
        how = np.zeros((most + 1, n), np.int32)
        state, begin = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = n  # stretches are in order of falling length
        falling = -length
        for t in range(most):
            live = int(np.searchsorted(falling, -t, "left"))
            rows = np.arange(live)
            b = data[start[:live] + t]
            state[:live] = self.goto[state[:live], b]
            begin[:live] = np.where((b & 0xC0) != 0x80, t, begin[:live])
            last = length[:live] == t + 1
            ends = last.copy()
            more = np.flatnonzero(~last)
            ends[more] = (data[start[more] + t + 1] & 0xC0) != 0x80
            top, by, single = best[t + 1], how[t + 1], np.zeros(live, bool)
            at, node = rows, self.link[state[:live]]
            while True:
                found = node > 0
                at, node = at[found], node[found]
                if not len(at):
                    break
                p = self.piece[node]
                from_ = t + 1 - self.length[p]
                value = best[from_, at] + self.score[p]
                better = value > top[at]
                top[at[better]], by[at[better]] = value[better], p[better]
                single[at] |= from_ == begin[at]
                node = self.after[node]
            lone = np.flatnonzero(ends & ~single)
            if len(lone):
                value = best[begin[lone], lone] + self.unknown
                better = value > top[lone]
                lone, value = lone[better], value[better]
                top[lone], by[lone] = value, -(t + 1 - begin[lone])
        at, codes, owners, places = length.copy(), [], [], []
        left = np.arange(n)
        while len(left):
            code = how[at[left], left].astype(np.int64)
            codes.append(code)
            owners.append(left)
            places.append(at[left])
            at[left] -= np.where(code < 0, -code, self.length[code])
            left = left[at[left] > 0]
        code, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, owners, places))
        order = np.lexsort((place, owner))
        code, owner, place = code[order], owner[order], place[order]
        times = np.where(code < 0, -code, 1)
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        code, owner, place, times = (np.repeat(x, times) for x in (code, owner, place, times))
        ids = np.where(code < 0, self.byte_id[data[np.where(code < 0, start[owner] + place - times + nth, 0)]], code)
        return ids, np.bincount(owner, minlength=n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of each text's."""
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        raw, ends = T.text_buffer(texts)
        sizes = np.diff(ends)
        full = sizes > 0
        shift = np.cumsum(full)
        data = np.full(len(raw) + int(full.sum()), 0x20, np.uint8)
        data[np.arange(len(raw)) + np.repeat(shift, sizes)] = raw
        firsts = np.concatenate([[0], np.cumsum(sizes + full)])
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if self.crossed:
            begins[:] = False
        begins[firsts[:-1][full]] = True
        at = np.concatenate([np.flatnonzero(begins), [len(data)]])
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        which = stretches.indices.to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(stretches.dictionary.buffers()[1], np.int64)[: len(stretches.dictionary) + 1]
        own = np.frombuffer(stretches.dictionary.buffers()[2], np.uint8)
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        ids, number, done = [], np.zeros(len(order), np.int64), 0
        while done < len(order):
            to = done + max(1, GROUP // (int(length[order[done]]) + 1))
            part = order[done:to]
            got, n = self._group(own, offsets[part], length[part])
            ids.append(got)
            number[part] = n
            done = to
        flat = np.concatenate(ids)
        place = np.zeros(len(order), np.int64)
        place[order] = np.cumsum(number[order]) - number[order]
        counts = number[which]
        out = flat[np.arange(int(counts.sum())) + np.repeat(place[which] - (np.cumsum(counts) - counts), counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        cut = total[np.searchsorted(at[:-1], firsts)]
        return out, np.diff(cut)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of the ids; what is not UTF-8 becomes the replacement character. Control pieces are empty."""
        known = np.where((ids >= 0) & (ids < len(self.length)), ids, 0)
        size = self.length[known]
        data = self.data[np.arange(int(size.sum())) + np.repeat(self.offset[known] - (np.cumsum(size) - size), size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        lead = np.zeros(len(data), bool)
        full = np.flatnonzero(ends[1:] > ends[:-1])
        lead[ends[full]] = data[ends[full]] == 0x20
        kept = data[~lead]
        ends = np.concatenate([[0], np.cumsum(~lead)])[ends]
        out = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            whole = kept.tobytes()
            out = pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.large_string())
        return out


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's automaton of a broadcast vocabulary."""
    v = shared.value
    key = hash((tuple(v.pieces), v.kinds, tuple(v.scores)))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(v)
    return _codecs[key]


def encode(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """For each row of docs doc_id, n_tokens and token_ids: the segmentation of the whole text with the highest sum of piece scores.

    Spaces become space marks and a text gets one more in front, as the model's own library does; characters
    without a piece become their bytes. Ties go to the longer last piece. A null or empty text has no tokens.
    With ``check`` a column round_trip tells whether the ids decode to the text again (a literal space mark
    counts as a space). Any number of rows may share a doc_id; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in T.chunks(rows):
            ids, counts = codec.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns, names = [batch.column("doc_id"), pa.array(counts), lists], ["doc_id", "n_tokens", "token_ids"]
            if check:
                columns.append(pc.equal(codec.decode(ids, counts), pc.replace_substring(pc.fill_null(batch.column("text"), "").cast(pa.large_string()), MARK, " ")))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n_tokens long, token_ids array<int>" + ", round_trip boolean" * check)


def decode(rows: DataFrame, model: str = MODEL, doc_id: str = "doc_id", token_ids: str = "token_ids") -> DataFrame:
    """doc_id and text of each row's token ids; null or no ids give an empty text, ids outside the vocabulary nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in parts:
            lists = batch.column("token_ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(pc.list_flatten(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), codec.decode(ids, counts).cast(pa.string())], ["doc_id", "text"])

    return rows.select(rows[doc_id].cast("long").alias("doc_id"), rows[token_ids].cast("array<int>").alias("token_ids")).mapInArrow(batches, "doc_id long, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=True)
