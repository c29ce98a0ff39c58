"""Language of whole texts: a convolutional network over bytes, in numpy.

Byte vectors pass through filters of several widths; the highest response of each filter within a window of
fixed length goes into a softmax. A text falls into windows over all of its bytes, and its language is the one
with the highest sum of their log-probabilities. The driver trains on a bounded sample of labelled texts;
executors score windows in batches. A filter is a sum of one weight vector for each of its bytes, so that
responses come from table look-ups: of pairs of bytes for the even part of a width, of bytes for the odd one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .toxicity import held_out

F4 = np.float32
#: Bytes of a window, filters of each width, the widths, and byte classes (letters are lower-cased, rare bytes share one).
SPAN, FILTERS, WIDTHS, DIM = 192, 12, (2, 3, 4), 8


@dataclass
class Sample:
    """The bound of what is learned from: windows of each language, windows in total (but one of each language at least), windows of one text, and steps of training (batches of 256 windows, with languages drawn evenly) for each language, and at most."""

    windows: int = 3000
    total: int = 200_000
    each: int = 12
    steps: int = 120
    most_steps: int = 6000
    seed: int = 3


class Network:
    def __init__(self, languages: list[str], seed: int):
        rng = np.random.default_rng(seed)
        g = lambda *s, k: (rng.standard_normal(s) * k).astype(F4)
        self.languages = languages
        self.p = {"byte": g(256, DIM, k=0.5), "out": g(FILTERS * len(WIDTHS), len(languages), k=0.2), "bias": np.zeros(len(languages), F4)}
        for w in WIDTHS:
            self.p |= {f"w{w}": g(w, DIM, FILTERS, k=(w * DIM) ** -0.5), f"b{w}": np.zeros(FILTERS, F4)}
        self.tables: dict[int, list[np.ndarray]] = {}

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows (bytes, zero where a text has ended) by look-up."""
        if not self.tables:
            for w in WIDTHS:
                one = [self.p["byte"] @ self.p[f"w{w}"][j] for j in range(w)]
                self.tables[w] = [(one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)] + ([one[-1]] if w % 2 else [])
        pair = windows[:, :-1].astype(np.intp) * 256 + windows[:, 1:]
        top = []
        for w in WIDTHS:
            n, r = SPAN - w + 1, None
            for j, table in enumerate(self.tables[w]):
                at = pair[:, 2 * j : 2 * j + n] if len(table) == 65536 else windows[:, 2 * j : 2 * j + n]
                r = table[at] if r is None else r + table[at]
            top.append(np.maximum(r.max(1) + self.p[f"b{w}"], 0))
        z = np.concatenate(top, axis=1) @ self.p["out"] + self.p["bias"]
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def step(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        p, n = self.p, len(windows)
        x = p["byte"][windows]
        tops, tapes = [], []
        for w in WIDTHS:
            cols = np.concatenate([x[:, j : SPAN - w + 1 + j] for j in range(w)], axis=2)
            r = cols @ p[f"w{w}"].reshape(w * DIM, FILTERS)
            at = r.argmax(1)
            best = np.take_along_axis(r, at[:, None], 1)[:, 0] + p[f"b{w}"]
            tops.append(np.maximum(best, 0))
            tapes.append((at, best > 0))
        pooled = np.concatenate(tops, axis=1)
        z = pooled @ p["out"] + p["bias"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"out": pooled.T @ q, "bias": q.sum(0), "byte": np.zeros_like(p["byte"])}
        d = q @ p["out"].T
        for i, (w, (at, live)) in enumerate(zip(WIDTHS, tapes)):
            dr = d[:, i * FILTERS : (i + 1) * FILTERS] * live
            g[f"b{w}"] = dr.sum(0)
            g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
            for j in range(w):
                b = np.take_along_axis(windows, at + j, 1)
                v = p["byte"][b]
                g[f"w{w}"][j] = np.einsum("nfd,nf->df", v, dr)
                np.add.at(g["byte"], b, dr[:, :, None] * p[f"w{w}"][j].T[None])
        return g


_FOLD = T._LOWER.copy()
_FOLD[1:32] = 32
_FOLD[48:58] = 48


def windows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover all bytes of all texts, zero after a text's end, and each window's text. An empty text has none."""
    data, offsets = T.text_buffer(column)
    sizes = np.diff(offsets)
    number = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    at = offsets[owner] + nth * SPAN
    places = at[:, None] + np.arange(SPAN)
    inside = places < offsets[owner + 1][:, None]
    if not len(data):
        return np.zeros((0, SPAN), np.uint8), owner
    return np.where(inside, _FOLD[data[np.minimum(places, len(data) - 1)]], 0).astype(np.uint8), owner


def train(windows: np.ndarray, y: list[str], sample: Sample) -> Network:
    """A network for windows and their languages, each language drawn as often as any other."""
    known = sorted(set(y))
    net = Network(known, sample.seed)
    if not known:
        return net
    rng = np.random.default_rng(sample.seed)
    place = {x: i for i, x in enumerate(known)}
    y = np.array([place[x] for x in y])
    share = np.bincount(y, minlength=len(known))
    chance = np.cumsum(1 / share[y])
    total = min(max(150, sample.steps * len(known)), sample.most_steps)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for t in range(1, total + 1):
        part = np.minimum(np.searchsorted(chance, rng.random(256) * chance[-1], "right"), len(y) - 1)
        for k, v in net.step(windows[part], y[part]).items():
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            net.p[k] -= (0.02 * (1 - 0.9 * t / total) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)).astype(F4)
    return net


def labelled_sample(docs: DataFrame, learn, lang: str, sample: Sample) -> tuple[np.ndarray, list[str]]:
    """Windows and languages to learn from: of every language some (fewer of each if there are many), from all over the whole texts of lowest hash.

    No task ranks a whole language: a hash threshold for each language, from its number of texts, leaves about as
    many texts as are needed, and those alone are ranked.
    """
    texts = docs.where(learn & F.col(lang).isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col(lang).alias("y"), F.xxhash64("doc_id", "text").alias("h"), "text")
    counts = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}  # a row for each language, as the network has a column for each
    if not counts:
        return np.zeros((0, SPAN), np.uint8), []
    wanted = max(1, min(sample.windows, sample.total // len(counts)))
    # With one window a text at least, ``wanted`` texts are enough; half as many again, as hashes fall by chance.
    share = docs.sparkSession.createDataFrame([(y, min(1.0, (1.5 * wanted + 30) / n)) for y, n in counts.items()], "y string, share double")
    low = F.pmod(F.col("h"), F.lit(1 << 40)) < F.col("share") * float(1 << 40)
    some = texts.join(F.broadcast(share), "y").where(low)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.chunks(iter([batch]), limit=1 << 20):
                win, owner = windows_of(part.column("text"))
                h = part.column("h").to_numpy().view(T.U)[owner]
                first = np.searchsorted(owner, owner)
                order = T.splitmix(h + (np.arange(len(owner)) - first).astype(T.U))
                rank = np.lexsort((order, owner))
                nth = np.zeros(len(owner), np.int64)
                nth[rank] = np.arange(len(owner)) - first
                kept = nth < sample.each
                flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(kept.sum()), [None, pa.py_buffer(np.arange(int(kept.sum()) + 1, dtype=np.int64) * SPAN), pa.py_buffer(np.ascontiguousarray(win[kept]))])
                yield pa.RecordBatch.from_arrays([part.column("y").take(pa.array(owner[kept])), pa.array(T.int64(order[kept])), flat.cast(pa.binary())], ["y", "h", "window"])

    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", "window"))
    rows = some.mapInArrow(cut, "y string, h long, window binary").withColumn("rank", rank).where(F.col("rank") <= wanted).toArrow().sort_by([("rank", "ascending"), ("y", "ascending")])
    if not rows.num_rows:
        return np.zeros((0, SPAN), np.uint8), []
    return np.frombuffer(b"".join(rows["window"].to_pylist()), np.uint8).reshape(-1, SPAN), rows["y"].to_pylist()


def languages(docs: DataFrame, sample: Sample | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """For each row doc_id, held_out, lang_pred, score (0 to 1) and n_windows.

    The network learns from text and ``lang`` of rows that aren't held out (crc32 of the id as text mod 4 is 2)
    and predicts from the text alone. A text that is null or has no letter is ``und`` with score 0; so is every
    text if nothing can be learned. The score is the predicted language's share of the windows' mean
    probabilities. Rows are predicted one by one, whatever ids they share.
    """
    sample = sample or Sample()
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    net = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(own, ~held_out(F.col("doc_id")), "lang", sample), sample))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for batch in T.chunks(batches, limit=256 << 10):
            n, names = batch.num_rows, model.languages
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            win, owner = windows_of(batch.column("text"))
            share, log, number = np.zeros((n, max(1, len(names)))), np.zeros((n, max(1, len(names)))), np.bincount(owner, minlength=n)
            for i in range(0, len(win) if names else 0, 256):
                p = model.probabilities(win[i : i + 256]).astype(np.float64)
                of = owner[i : i + 256]
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))  # windows of a text are neighbours
                log[of[first]] += np.add.reduceat(p, first, axis=0)
                share[of[first]] += np.add.reduceat(np.exp(p), first, axis=0)
            best = log.argmax(1)
            known = letters & (number > 0) & bool(names)
            score = np.where(known, share[np.arange(n), best] / np.maximum(number, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([names[b] if k else "und" for b, k in zip(best, known)]), pa.array(np.clip(score, 0, 1)), pa.array(number.astype(np.int64))], ["doc_id", "lang_pred", "score", "n_windows"])

    found = own.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, n_windows long")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_windows")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
