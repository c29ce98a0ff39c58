"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the vector of its hash bucket beside the mean vector of its character 4-grams. Two gated
recurrent layers read a window of words, one in each direction; attention pools their states; a logistic unit
scores the window. Windows overlap and cover the whole text, and the highest window gives the document's score.
The driver trains on a bounded sample of labelled texts; executors score batches of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from . import textops as T

WORDS, GRAMS, DIM_W, DIM_C, HIDDEN, ATTEND = 1 << 17, 1 << 16, 12, 12, 12, 8
#: In how many training texts a bucket must be to have a vector: a share of them, within bounds.
COMMON_SHARE, COMMON = 1 / 300, (6, 10)
#: Words of a window, and from one window's start to the next.
SPAN, STRIDE = 48, 24
F4 = np.float32
#: Steps of training at least, how fast vectors learn beside the other weights, and how fast they shrink: the faster the fewer texts there are, as then most of what they hold is chance.
LEAST_STEPS, PACE, SHRINK, SHRINK_TEXTS = 240, 3.0, 32.0, 9600
#: From this score on a document counts as toxic.
THRESHOLD = 0.3


@dataclass
class Sample:
    """The bound of what is learned from: texts of either label, and bytes of all of them. Texts are whole; if they are long, they are fewer."""

    toxic: int = 1200
    clean: int = 2800
    bytes: int = 24 << 20
    epochs: int = 5
    seed: int = 11


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's bucket, the grams of all words, and each word's first gram."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket = (T.word_hashes(data, start, end) >> T.U(47)).astype(np.int64)
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    b = T._LOWER[data[place + np.repeat(start, length)]].astype(np.uint32)
    gram = b * np.uint32(0x9E3779B1)
    for j, m in ((1, 0x85EBCA77), (2, 0xC2B2AE3D), (3, 0x27D4EB2F)):
        before = np.zeros_like(b)
        before[j:] = b[:-j]
        before = np.where(place >= j, before, np.uint32(1 if j == 1 else 0))
        gram = gram + before * np.uint32(m)
    gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return bucket, (gram >> np.uint32(16)).astype(np.int64), first


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words; the last one is the first that reaches the end."""
    return np.arange(0, max(n - SPAN + STRIDE, 1), STRIDE)


@dataclass
class Network:
    p: dict[str, np.ndarray]
    common: tuple[np.ndarray, np.ndarray] | None = None
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    grads: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(rng: np.random.Generator) -> Network:
        d, h = DIM_W + DIM_C, HIDDEN
        g = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(F4)
        p = {"word": np.zeros((WORDS, DIM_W), F4), "gram": np.zeros((GRAMS, DIM_C), F4), "att": g(2 * h, ATTEND, k=0.3), "attv": g(ATTEND, k=0.3), "out": g(2 * h, k=0.3), "bias": np.array([-1.0], F4)}
        for way in "fb":
            p |= {f"wx{way}": g(d, 3 * h, k=d**-0.5), f"wh{way}": g(h, 3 * h, k=h**-0.5), f"bx{way}": np.zeros(3 * h, F4)}
        return Network(p)

    def inputs(self, bucket: np.ndarray, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.append(first, len(gram)))[:, None].astype(F4)
        word = self.p["word"][bucket] * self.common[0][bucket, None]
        grams = self.p["gram"][gram] * self.common[1][gram, None]
        return np.concatenate([word, np.add.reduceat(grams, first, axis=0) / sizes], axis=1)

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores of windows; ``at``: (windows, SPAN) rows of x, ``mask``: which of them count."""
        p, h = self.p, HIDDEN
        n, span = at.shape
        states, tapes = [], []
        for way in "fb":
            pre = x @ p[f"wx{way}"] + p[f"bx{way}"]
            s, tape = np.zeros((n, h), F4), []
            run = np.zeros((span, n, h), F4)
            for t in range(span) if way == "f" else range(span - 1, -1, -1):
                a = pre[at[:, t]]
                m = mask[:, t : t + 1]
                u = s @ p[f"wh{way}"]
                zr = 0.5 * np.tanh(0.5 * (a[:, : 2 * h] + u[:, : 2 * h])) + F4(0.5)
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
                if keep:
                    tape.append((t, s, z, r, c, u[:, 2 * h :], m))
                s = s + m * z * (c - s)
                run[t] = s
            states.append(run)
            tapes.append(tape)
        both = np.concatenate(states, axis=2)
        hidden = np.tanh(both @ p["att"])
        e = np.where(mask.T > 0, hidden @ p["attv"], F4(-1e9))
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        pooled = (a[:, :, None] * both).sum(0)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (tapes, both, hidden, a, pooled)) if keep else logit

    def backward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, tape, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all weights but the vectors, and of x."""
        p, h = self.p, HIDDEN
        tapes, both, hidden, a, pooled = tape
        g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], F4)}
        d_pooled = d_logit[:, None] * p["out"]
        d_both = a[:, :, None] * d_pooled
        d_a = (both * d_pooled).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_hidden = d_e[:, :, None] * p["attv"] * (1 - hidden**2)
        g["attv"] = (d_e[:, :, None] * hidden).sum((0, 1))
        g["att"] = both.reshape(-1, 2 * h).T @ d_hidden.reshape(-1, ATTEND)
        d_both = d_both + d_hidden @ p["att"].T
        d_x = np.zeros_like(x)
        for way, rows, half in (("f", tapes[0], slice(0, h)), ("b", tapes[1], slice(h, 2 * h))):
            d_s = np.zeros((at.shape[0], h), F4)
            d_wh, d_pre = np.zeros_like(p[f"wh{way}"]), np.zeros((len(x), 3 * h), F4)
            for t, s, z, r, c, uc, m in reversed(rows):
                d_s = d_s + d_both[t][:, half]
                step = m * d_s
                d_c = step * z * (1 - c**2)
                d_z = step * (c - s) * z * (1 - z)
                d_r = d_c * uc * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_a = np.concatenate([d_z, d_r, d_c], axis=1)
                d_wh += s.T @ d_u
                d_s = d_s - step * z + d_u @ p[f"wh{way}"].T
                np.add.at(d_pre, at[:, t], d_a * m)
            g[f"wh{way}"] = d_wh
            g[f"wx{way}"] = x.T @ d_pre
            g[f"bx{way}"] = d_pre.sum(0)
            d_x += d_pre @ p[f"wx{way}"].T
        return g, d_x

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit.astype(np.float64) + self.shift, -40, 40)))


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words, one after the other: each window's first row, the end of its text, and its text."""
    starts = [window_starts(int(n)) for n in counts]
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begin = np.concatenate([np.zeros(0, np.int64), *[s + b for s, b in zip(starts, base)]]).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), [len(s) for s in starts])
    return begin, (base + counts)[owner], owner


def _rows(begin: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of windows, and which of them count."""
    at = begin[:, None] + np.arange(SPAN)
    return np.minimum(at, np.maximum(limit - 1, 0)[:, None]), (at < limit[:, None]).astype(F4)


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words, one after the other: rows of each window, which count, and each window's text."""
    begin, limit, owner = _places(counts)
    return *_rows(begin, limit), owner


def train(texts: list[str], labels: list[int], sample: Sample) -> Network:
    """A network for texts and labels (0 or 1). A text counts as its highest window; gradients go to that window."""
    y = np.array(labels, F4)
    if not len(y) or y.min() == y.max():
        return Network({}, constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(sample.seed)
    net = Network.new(rng)
    parts, counts = [], []
    for batch in T.chunks([pa.record_batch({"text": pa.array(texts, pa.large_string())})], limit=256 << 10):
        data, offsets = T.text_buffer(batch.column("text"))
        start, end, of_text = T.words(data, offsets, T.ALNUM)
        parts.append([x.astype(t) for x, t in zip((*features(data, start, end)[:2], end - start), (np.int32, np.uint16, np.int32))])
        counts.append(np.diff(of_text))
    size, gram, bucket = (np.concatenate([x.pop() for x in parts]) for _ in range(3))
    first = (np.cumsum(size) - size).astype(np.int32)
    del parts, data, offsets, start, end, batch
    counts = np.concatenate(counts)
    net.common = _common(bucket, gram, first, counts)
    begin, limit, owner = _places(counts)
    filled = begin < limit
    begin, limit, owner = begin[filled], limit[filled], owner[filled]
    by_text = np.searchsorted(owner, np.arange(len(y) + 1))
    has = np.flatnonzero(np.diff(by_text) > 0)
    apart = has[(has % 5 == 4)] if min((y[has] > 0).sum(), (y[has] == 0).sum()) >= 20 else has  # sets the scale, without being learned from
    has = np.setdiff1d(has, apart) if len(apart) < len(has) else has
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    steps, scale, shrink = 0, {"word": 0.0, "gram": 0.0}, min(SHRINK, SHRINK_TEXTS / len(y))
    weight = np.where(y > 0, 0.5 * len(y) / max(1, (y > 0).sum()), 0.5 * len(y) / max(1, (y == 0).sum())).astype(F4)
    rate0, batches = 0.01, 0
    total = max(LEAST_STEPS, sample.epochs * (len(has) // 64 + 1))
    while batches < total:
        highest = _text_logits(net, bucket, gram, first, begin, limit)
        order = np.concatenate([rng.permutation(has) for _ in range(max(1, 960 // len(has)))])
        for b in range(0, len(order), 64):
            part = order[b : b + 64]
            pick = []
            for i in part:
                own = np.arange(by_text[i], by_text[i + 1])
                top = own[np.argmax(highest[own] + (rng.gumbel(size=len(own)) * (0.5 if y[i] else 0.2)).astype(F4))]
                pick.append(top)
            rows = np.array(pick)
            at, mask = _rows(begin[rows], limit[rows])
            words = np.unique(at)
            local = np.searchsorted(words, at)
            lengths = size[words]
            ends = np.cumsum(lengths)
            places = np.arange(int(ends[-1])) + np.repeat(first[words] - (ends - lengths), lengths)
            grams, firsts = gram[places], ends - lengths
            x = net.inputs(bucket[words], grams, firsts)
            dropped = rng.random(len(words)) < 0.3  # a word's own vector, so that its characters count as well
            x[dropped, :DIM_W] = 0
            logit, tape = net.forward(x, local, mask, keep=True)
            d = (1 / (1 + np.exp(-logit)) - y[part]) * weight[part] / len(part)
            g, d_x = net.backward(x, local, mask, tape, d.astype(F4))
            d_x[dropped, :DIM_W] = 0
            d_x[:, :DIM_W] *= net.common[0][bucket[words], None]
            steps += 1
            batches += 1
            rate = rate0 * min(1.0, steps / 20) * (1 - 0.9 * min(1.0, batches / total))
            for k, v in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                net.p[k] -= (rate * (m1[k] / (1 - 0.9**steps)) / (np.sqrt(m2[k] / (1 - 0.99**steps)) + 1e-8)).astype(F4)
            for k, ids, dv in (("word", bucket[words], d_x[:, :DIM_W]), ("gram", grams, np.repeat(d_x[:, DIM_W : DIM_W + DIM_C] / lengths[:, None].astype(F4), lengths, axis=0) * net.common[1][grams, None])):
                own, inverse = np.unique(ids, return_inverse=True)
                v = np.zeros((len(own), dv.shape[1]), F4)
                np.add.at(v, inverse, dv)
                # One scale for all vectors: words that are often in texts of one label move further than chance ones.
                scale[k] = 0.95 * scale[k] + 0.05 * float((v * v).mean())
                net.p[k][own] = net.p[k][own] * F4(1 - shrink * rate) - (PACE * rate * np.clip(v / (np.sqrt(scale[k] / (1 - 0.95**steps)) + 1e-12), -8, 8)).astype(F4)
            if batches >= total:
                break
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, owner, _text_logits(net, bucket, gram, first, begin, limit))
    _calibrate(net, top[apart], y[apart])
    return net


def _common(bucket: np.ndarray, gram: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets of words and of grams are in enough training texts to have a vector of their own."""
    words = np.concatenate([[0], np.cumsum(counts)])
    ends = np.append(first, len(gram))[words]
    tables = [np.zeros(n, np.int32) for n in (WORDS, GRAMS)]
    for i in range(len(counts)):
        for table, ids in zip(tables, (bucket[words[i] : words[i + 1]], gram[ends[i] : ends[i + 1]])):
            table[np.unique(ids)] += 1
    least = np.clip(round(COMMON_SHARE * len(counts)), *COMMON)
    return tuple((t >= least).astype(F4) for t in tables)


def _text_logits(net: Network, bucket: np.ndarray, gram: np.ndarray, first: np.ndarray, begin: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Scores of all windows, some thousand at a time; windows are in the order of their words."""
    out, ends = [np.zeros(0, F4)], np.append(first, len(gram))
    for i in range(0, len(begin), 2048):
        at, mask = _rows(begin[i : i + 2048], limit[i : i + 2048])
        lo, hi = int(at[0, 0]), int(at[:, -1].max()) + 1
        x = net.inputs(bucket[lo:hi], gram[ends[lo] : ends[hi]], first[lo:hi] - ends[lo])
        out.append(net.forward(x, at - lo, mask))
    return np.concatenate(out)


def _calibrate(net: Network, logit: np.ndarray, y: np.ndarray) -> None:
    """Scale and shift of the texts' highest logits: if a threshold parts all but a fiftieth of label 0 and a fifth of label 1 (labels err), it comes between them; else by logistic regression, mildly held to 1 and 0."""
    low, high = (np.quantile(logit[y == c], q) if (y == c).any() else np.nan for c, q in ((0, 0.98), (1, 0.2)))
    if low < high:
        net.scale = float(min(8 / (high - low), 2.0))
        net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - net.scale * (0.6 * low + 0.4 * high))
        return
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-6)
        g = np.array([((q - y) * logit).sum() + 0.5 * (a - 1), (q - y).sum() + 0.5 * b])
        hess = np.array([[(w * logit * logit).sum() + 0.5, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.5]])
        step = np.clip(np.linalg.solve(hess, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    net.scale, net.shift = float(max(a, 0.05)), float(b)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def lowest(marks: DataFrame, y: int, n: int) -> DataFrame:
    """The n rows of label y of lowest hash; each task keeps n at most, so none sorts all rows."""
    return marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: Sample) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from, at most as many as ``sample`` says: those of lowest hash, none of which is held out."""
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("y"))
    # Twice as many, as labels may name documents that are not there; at most 2 * (toxic + clean) rows are sent to all.
    marks = lowest(marks, 1, 2 * sample.toxic).union(lowest(marks, 0, 2 * sample.clean))
    found = docs.join(F.broadcast(marks), "doc_id").where(F.col("text").isNotNull()).select("doc_id", "y", "text", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "h"))
    rows = found.drop("text").withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("y") == 1, sample.toxic).otherwise(sample.clean)).collect()
    taken = within(rows, sample)
    if not taken:
        return [], []
    # Sizes first, texts then: the driver never gets more bytes of text than the sample's.
    kept = docs.sparkSession.createDataFrame([(r.doc_id, r.h) for r in taken], found.select("doc_id", "h").schema).distinct()
    texts = {(r.doc_id, r.h): r.text for r in found.join(F.broadcast(kept), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "text").collect()}
    return [texts[r.doc_id, r.h] for r in taken], [r.y for r in taken]


def within(rows: list[Row], sample: Sample) -> list[Row]:
    """The rows by rank until their texts (n bytes each) would exceed the label's part of the sample's bytes; a text that alone would is passed over."""
    total = {y: sample.bytes * k // (sample.toxic + sample.clean) for y, k in ((1, sample.toxic), (0, sample.clean))}
    left, taken = dict(total), []
    for r in sorted(rows, key=lambda r: (r.rank, r.y)):
        if r.n > total[r.y]:
            continue
        left[r.y] -= r.n
        if left[r.y] >= 0:
            taken.append(r)
    return taken


def toxicity(docs: DataFrame, labels: DataFrame, sample: Sample | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with toxic_score (0 to 1), n_windows and worst_window (its first word).

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. All windows of the
    whole text are scored. A text that is null or has no word scores 0. With labels of one kind only, every
    other text scores that label; without labels 0. Rows are scored one by one, whatever ids they share. Columns of docs with the names of the
    results are replaced.
    """
    docs = docs.drop("toxic_score", "n_windows", "worst_window")
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    net = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(own, labels, sample or Sample()), sample or Sample()))
    place = docs.columns.index(text)
    schema = docs.select("*", F.lit(0.0).alias("toxic_score"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("worst_window")).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for batch in T.chunks(batches, text=place, limit=512 << 10):
            data, offsets = T.text_buffer(batch.column(place))
            start, end, of_text = T.words(data, offsets, T.ALNUM)
            counts = np.diff(of_text)
            score, windows, worst = np.zeros(len(counts)), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            full = np.flatnonzero(counts > 0)
            if len(full):
                begin, limit, owner = _places(counts[full])
                logit = np.zeros(len(begin), F4) if model.constant is not None else _text_logits(model, *features(data, start, end), begin, limit)
                by_text = np.searchsorted(owner, np.arange(len(full)))
                windows[full] = np.diff(np.append(by_text, len(owner)))
                order = np.lexsort((begin, -logit, owner))[by_text]
                score[full] = model.score(logit[order]) if model.constant is None else model.constant
                worst[full] = begin[order] - of_text[full]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(windows), pa.array(worst)], [*batch.schema.names, "toxic_score", "n_windows", "worst_window"])

    return docs.mapInArrow(scored, schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows", "worst_window"
    )
