"""The networks of language and toxicity against plain loops over bytes and words, and whole small tables against those."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from quillon.llm import languages, textops, toxicity


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


# --- language: byte convolutions


def plain_windows(text):
    """Byte classes of a text: A-Z lower-cased, control characters as spaces, digits as one; cut in stretches of SPAN, the last filled with zeros."""
    folded = []
    for b in text.encode():
        if 65 <= b <= 90:
            b += 32
        elif 1 <= b < 32:
            b = 32
        elif 48 <= b <= 57:
            b = 48
        folded.append(b)
    n = languages.SPAN
    return [(folded[i : i + n] + [0] * n)[:n] for i in range(0, len(folded), n)]


def plain_probabilities(net, window):
    """Log-probabilities of one window, filter by filter and byte by byte."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    pooled = []
    for w in languages.WIDTHS:
        for f in range(languages.FILTERS):
            best = max(sum(sum(p["byte"][window[t + j]][d] * p[f"w{w}"][j][d][f] for d in range(languages.DIM)) for j in range(w)) for t in range(languages.SPAN - w + 1))
            pooled.append(max(best + p[f"b{w}"][f], 0.0))
    z = [sum(x * p["out"][i][c] for i, x in enumerate(pooled)) + p["bias"][c] for c in range(len(net.languages))]
    top = max(z)
    return [v - top - math.log(sum(math.exp(u - top) for u in z)) for v in z]


def test_windows_against_a_plain_loop():
    import pyarrow as pa

    texts = ["", "Abc 12\tX\x00", "é" * 300, None, "x" * languages.SPAN, "y" * (languages.SPAN + 1)]
    got, owner = languages.windows_of(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in plain_windows(t or "")]
    assert owner.tolist() == [i for i, _ in want] and got.tolist() == [w for _, w in want]


def test_convolutions_against_a_plain_loop():
    rng = np.random.default_rng(1)
    net = languages.Network(["a", "b", "c"], 4)
    net.p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.2 for k, v in net.p.items()}
    windows = rng.integers(0, 256, (2, languages.SPAN)).astype(np.uint8)
    windows[1, 50:] = 0
    assert np.allclose(net.probabilities(windows), [plain_probabilities(net, w.tolist()) for w in windows], atol=1e-4)


def test_a_table_of_languages_against_a_plain_loop(spark, monkeypatch):
    """The network that the operator trains, run over every text of a small table in loops."""
    rng = random.Random(7)
    make = {"xx": "bakelomi", "yy": "strunzop", "zz": "wyvaqiu"}
    text = lambda lang, n: " ".join("".join(rng.choice(make[lang]) for _ in range(rng.randint(3, 7))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choice(list(make)) for _ in range(40))]
    rows += [(50, None, "xx"), (51, "", "yy"), (52, "12 !", "zz"), (53, text("xx", 20) + text("yy", 35), None), (54, "é" + "q", None), (3, text("zz", 9), "xx")]
    nets, train = [], languages.train
    monkeypatch.setattr(languages, "train", lambda *a: (nets.append(train(*a)), nets[-1])[1])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.n_windows, r.lang_pred, r.score, r.held_out) for r in languages.languages(df, languages.Sample(windows=60, steps=30)).collect())
    (net,) = nets
    want = []
    for i, t, _ in rows:
        logs = [plain_probabilities(net, w) for w in plain_windows(t or "")]
        if not re.search(r"[^\W\d_]", t or ""):
            want.append((i, len(logs), "und", 0.0, _held(i)))
            continue
        total = [sum(x[c] for x in logs) for c in range(len(net.languages))]
        best = max(range(len(total)), key=total.__getitem__)
        want.append((i, len(logs), net.languages[best], sum(math.exp(x[best]) for x in logs) / len(logs), _held(i)))
    for a, b in zip(got, sorted(want)):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3], abs=1e-4)


def test_training_steps_are_bounded():
    """However many languages there are, training takes most_steps at most, and every language is drawn."""
    rng = np.random.default_rng(2)
    windows = rng.integers(97, 123, (120, languages.SPAN)).astype(np.uint8)
    taken = []
    step = languages.Network.step
    languages.Network.step = lambda self, w, y: (taken.append(y), step(self, w, y))[1]
    try:
        net = languages.train(windows, [f"l{i % 60:02}" for i in range(120)], languages.Sample(most_steps=5))
    finally:
        languages.Network.step = step
    assert len(taken) == 5 and len(net.languages) == 60 and len(set(np.concatenate(taken))) == 60


# --- toxicity: recurrent windows


def plain_words(text):
    return [w.encode() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_window(net, words):
    """The logit of one window of words, word by word in both directions, with the attention written out."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    xs = []
    for w in words:
        data = np.frombuffer(w, np.uint8)
        bucket, grams, _ = toxicity.features(data, np.array([0]), np.array([len(data)]))
        own = p["word"][bucket[0]] * net.common[0][bucket[0]]
        xs.append(np.concatenate([own, np.mean([p["gram"][g] * net.common[1][g] for g in grams], axis=0)]))
    states = {}
    for way, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
        s = np.zeros(h)
        for t in order:
            a, u = xs[t] @ p[f"wx{way}"] + p[f"bx{way}"], s @ p[f"wh{way}"]
            z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
            s = s + z * (np.tanh(a[2 * h :] + r * u[2 * h :]) - s)
            states[way, t] = s
    both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(xs))]
    e = np.array([np.tanh(b @ p["att"]) @ p["attv"] for b in both])
    a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return float(sum(x * b for x, b in zip(a, both)) @ p["out"] + p["bias"][0])


def test_a_table_of_toxicity_against_a_plain_loop(spark, monkeypatch):
    """Every window of every text of a small table, in loops, with the network that the operator trains."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(90):
        w = [word() for _ in range(rng.choice([1, 5, 47, 48, 49, 73, 130]))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "zorkface"
        rows.append((i, ", ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(100, None), (101, "..!"), (102, "Straße ZORKFACE-été 42"), (5, "again 5")]
    nets, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: (nets.append(train(*a)), nets[-1])[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {(r.doc_id, r.text): r for r in toxicity.toxicity(df, marks, toxicity.Sample(toxic=30, clean=60, epochs=1)).collect()}
    (net,) = nets
    for i, t in rows:
        words, r = plain_words(t or ""), got[i, t]
        starts = [s for s in range(0, max(len(words), 1), toxicity.STRIDE) if s == 0 or s + toxicity.SPAN - toxicity.STRIDE < len(words)] if words else []
        assert r.n_windows == len(starts), (i, len(words))
        if not words:
            assert r.toxic_score == 0
            continue
        logits = [plain_window(net, words[s : s + toxicity.SPAN]) for s in starts]
        assert r.toxic_score == pytest.approx(float(sigmoid(net.scale * max(logits) + net.shift)), abs=2e-4)
        near = [s for s, x in zip(starts, logits) if x > max(logits) - 1e-4]
        assert r.worst_window in near


def test_words_of_networks_are_those_of_the_plain_loop():
    text = "Aé-b_c 9\u2003x"
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = textops.words(data, np.array([0, len(data)]), textops.ALNUM)
    assert [data[a:b].tobytes() for a, b in zip(start, end)] == plain_words(text)
