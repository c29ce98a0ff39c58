"""Operators on texts against plain versions, and on tables with nulls, empty and very long texts, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillon.llm import languages, licenses, line_dedup, mixing, ngram_join, passages, pieces, toxicity
from quillon.llm.scratch import Scratch

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rate string, row int, n string, token int, n_windows string, kept_text int, score int"


def table(spark, rows):
    """rows: (doc_id, text[, source[, lang]]), among columns whose names operators use themselves."""
    full = [(i, t, *((rest + (None, None))[1::-1]), len(t or ""), 7, "x", 1, "n", 2, "w", 3, 4) for i, t, *rest_ in rows for rest in [tuple(rest_)]]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Random texts with copies, near copies, shared lines and passages, and the odd rows."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(70), "A Line that many documents share, of more than forty"
    rows = [(i, text(rng.randint(1, 130)), f"s{i % 5}") for i in range(60)]
    for i in range(60, 110):
        base = rows[rng.randint(0, 2) if i < 90 else rng.randint(0, 30)][1].split()
        for _ in range(rng.randint(0, max(1, len(base) // 30))):
            base[rng.randrange(len(base))] = word()
        rows.append((i, " ".join(base).upper() if i % 7 == 0 else " ".join(base), "s0"))
    for i in range(110, 125):
        rows.append((i, f"{text(rng.randint(0, 60))}\n  {line}\t\n{text(20)} {passage if i % 3 else ''} {text(5)}\n{line.upper()}", "s1" if i % 2 else None))
    rows += [(200, None, "s2"), (201, "", "s2"), (202, " \n\t ", "s3"), (203, "one", "s3"), (204, "One", None), (205, "one two", "s9")]
    rows += [(206, (passage + "\n") * 300, "s4"), (207, "wörd éx " * 90, "s4"), (208, "x" * 100_000, "s4"), (None, "no id here but some words", "s4")]
    return rows + rows[3:5]  # two rows twice


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))


def test_line_dedup(spark, corpus):
    docs = table(spark, corpus)
    got = {(r.doc_id, r.text): r for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    for i, t, *_ in corpus:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    for i, t, *_ in corpus:
        lines = (t or "").split("\n")
        drop = [i is not None and len(key(x)) >= 40 and len(holders[key(x)] - {None}) >= 5 and i != max(holders[key(x)] - {None}) for x in lines]
        row = got[i, t]
        assert (row.n_lines, row.n_dropped) == (len(lines), sum(drop)), i
        assert row.kept_text == "\n".join(x for x, d in zip(lines, drop) if not d)
    assert any(r.n_dropped for r in got.values())
    runs = line_dedup.keep_bitmaps(docs).where("doc_id = 112").head()
    assert runs.dropped == [1, 3] and [tuple(r) for r in runs.keep_runs] == [(0, 1), (2, 3), (4, None)]
    empty = docs.limit(0)
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0


@pytest.mark.parametrize("least", [256, 2])
def test_line_dedup_of_repeated_rows(spark, monkeypatch, least):
    """Rows with one doc_id: each text loses its own lines; with few rows a slice, frequent keys are cut into many."""
    monkeypatch.setattr(line_dedup, "LEAST", least)
    monkeypatch.setattr(line_dedup, "MOST", least)
    rng = random.Random(9)
    common = [f"common line number {i}, of more than forty characters" for i in range(6)]
    rows = []
    for i in range(150):
        own = [rng.choice(common) if rng.random() < 0.5 else f"line {rng.random()} of this text alone, and no other one" for _ in range(rng.randint(1, 6))]
        rows.append((rng.randint(0, 80) if i % 10 else None, "\n".join(own)))
    rows += rows[:40] + [(3, None), (3, ""), (3, "\n" + common[0])]
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[x].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or len(x) < 40 or len(holders[x] - {None}) < 5 or i == max(holders[x] - {None})]
        want.append((i, t, len(lines), len(lines) - len(left), "\n".join(left)))
    docs = table(spark, rows)
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[3] for x in want) > 50


def test_line_dedup_streams_in_one_range_shuffle(spark, corpus):
    keys = line_dedup.line_keys(table(spark, corpus), "doc_id", "text", 40)
    plan = line_dedup.stream(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan and "Python" not in plan


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, corpus, k, percent):
    sets = {}
    for i, t, *_ in corpus:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    component = {i: i for i in ids}

    def top(i):
        while component[i] != i:
            i = component[i]
        return i

    links = 0
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = sorted((top(a), top(b)))
                component[y] = x
    got = ngram_join.ngram_join(table(spark, corpus), k, percent).collect()
    assert len(got) == len(corpus) and links > 20
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), top(r.doc_id)), r
    assert ngram_join.ngram_join(table(spark, corpus[:0]), k, percent).count() == 0


def test_ngram_join_of_one_large_group(spark):
    """Near copies with edits from a small vocabulary: many links within reach of few shared tokens."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = rng.choice("abc")
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[j : j + 3]) for j in range(58)} for w in (words(t) for _, t in rows)]
    parent = list(range(150))
    for _ in range(150):
        for a in range(150):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    parent[a] = parent[b] = min(parent[a], parent[b])
        if all(parent[parent[a]] == parent[a] for a in range(150)):
            break
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(table(spark, rows), 3, 90).collect()}
    closed = [got[a] == got[b] for a in range(150) for b in range(a) if 100 * (c := len(sets[a] & sets[b])) >= 90 * (len(sets[a]) + len(sets[b]) - c)]
    assert all(closed) and len(set(got.values())) == len(set(parent))


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join_of_different_texts_under_one_id(spark, seed):
    """A document may have several texts: links of each count for it, and none is lost to another's tokens."""
    rng = random.Random(seed)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 40)}" for _ in range(n))
    rows = [(rng.randint(0, 40), text(rng.randint(30, 60))) for _ in range(50)]
    for _ in range(40):
        w = rng.choice(rows)[1].split()
        w[rng.randrange(len(w))] = "other"
        rows.append((rng.randint(0, 60), " ".join(w)))
    rows += [rng.choice(rows) for _ in range(10)] + [(rng.randint(0, 60), rng.choice([None, "", " ", "a", "a b"])) for _ in range(12)]
    if seed == 0:
        a, b = text(40), text(40)
        rows = [(7, a), (8, a.replace(a.split()[20], "other", 1)), (9, b), (7, text(40)), (7, None)]
    k, percent = ((3, 90), (5, 80))[seed % 2]
    if seed == 0:
        percent = 60
    sets = [{tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set() for w in (words(t) for _, t in rows)]
    group = {i: i for i, _ in rows}
    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                low, high = sorted((group[i], group[j]))
                group = {n: low if g == high else g for n, g in group.items()}
    got = ngram_join.ngram_join(table(spark, rows), k, percent).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, len(s), group[i]) for s, (i, _) in zip(sets, rows))
    assert seed or group[8] == 7


def test_flipped_bits_bound_the_difference():
    """Bits that differ are never more than tokens that only one set holds, so that no link is lost."""
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        every = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (every[rng.random(400) < rng.random()] for _ in range(2))
        differ = int(np.unpackbits((ngram_join.flipped_bits(a) ^ ngram_join.flipped_bits(b)).view(np.uint8)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_ngram_join_of_texts_of_the_same_blocks(spark):
    """Texts that share tokens under any order, most of them without being linked."""
    rng = random.Random(6)
    blocks = [[" ".join(f"{chr(97 + b)}{v}{i}" for i in range(9)) for v in range(3)] for b in range(8)]
    rows = [(i, " ".join(rng.choice(b) for b in blocks)) for i in range(240)]
    for i in range(240, 300):
        w = rows[i - 240][1].split()
        w[rng.randrange(len(w))] = "z"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (words(t) for _, t in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(table(spark, rows), 3, 90).collect()}
    assert [got[i] for i in range(len(rows))] == group and len(set(group)) < 250


@pytest.mark.parametrize("piece", [1 << 14, 5])
def test_shared_passages_with_different_surroundings(spark, monkeypatch, piece):
    """Passages whose longest matches to the left and to the right are with different documents, in groups cut at any place."""
    monkeypatch.setattr(passages, "PIECE", piece)
    rng = random.Random(21)
    lefts, rights = ([[f"{c}{v}{i}" for i in range(70)] for v in range(4)] for c in "lr")
    middle = [[f"m{v}{i}" for i in range(20)] for v in range(3)]
    docs = []
    for i in range(90):
        t = []
        for _ in range(rng.randint(1, 3)):
            a, b = rng.choice(lefts), rng.choice(rights)
            t += a[-rng.randint(0, 60) :] + rng.choice(middle) + b[: rng.randint(0, 60)] + [f"x{rng.random()}"]
        docs.append((i, " ".join(t)))
    where = defaultdict(set)
    for i, t in docs:
        w = t.split()
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(i)
    want = set()
    for i, t in docs:
        w, spans = t.split(), []
        for j in range(len(w) - 49):
            if len(where[tuple(w[j : j + 50])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + 50
                else:
                    spans.append([j, j + 50])
        want |= {(i, a, b - a) for a, b in spans}
    got = [tuple(r) for r in passages.shared_passages(table(spark, docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_shared_passages(spark, corpus):
    where = defaultdict(set)
    for i, t, *_ in corpus:
        w = words(t)
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(i)
    want = set()
    for i, t in {(i, t) for i, t, *_ in corpus if i is not None}:
        w, spans = words(t), []
        for j in range(len(w) - 49):
            if len(where[tuple(w[j : j + 50])] - {None}) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + 50
                else:
                    spans.append([j, j + 50])
        want |= {(i, a, b - a) for a, b in spans}
    got = [tuple(r) for r in passages.shared_passages(table(spark, corpus)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert passages.shared_passages(table(spark, corpus[:0])).count() == 0


def test_mixing(spark, corpus):
    docs = table(spark, corpus)
    rows = mixing.copies(docs).collect()
    assert len(rows) == len(corpus)
    sizes = defaultdict(int)
    for _, t, s in corpus:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(order)}
    total, free = sum(sizes.values()), set(order)
    while True:
        rest = total - sum(3 * sizes[s] for s in order if s not in free)
        above = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]}
        if not above:
            break
        free -= above
    target = {s: rest * weight[s] / sum(weight[x] for x in free) if s in free else Fraction(3 * sizes[s]) for s in order}
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(float(target[r.source])) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    small = {s: min([len(words(t)) for _, t, x in corpus if x == s and words(t)], default=0) for s in order}
    for s in order:
        if max(len(words(t)) for _, t, x in corpus if x == s) > target[s] / 2:
            continue  # a single document outweighs what rounding can do
        assert abs(taken[s] - target[s]) <= max(small[s], 0.02 * target[s]), (s, taken[s], float(target[s]))
    again = {(r.doc_id, r.text): r.copies for r in mixing.copies(docs.repartition(7)).collect()}
    assert all(again[r.doc_id, r.text] == r.copies for r in rows)
    assert mixing.copies(docs.limit(0)).count() == 0
    alone = mixing.copies(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [r.copies for r in alone] == [1, 1]


def plain_balance(sizes, targets, goal, cap, penalty):
    """Rates by source and class from Newton's method on all multipliers of the dual at once, in one dense system."""
    import numpy as np

    s, k = sizes.shape
    z, price = np.zeros(s + k), penalty * np.maximum(goal, 1.0)

    def at(z):
        tilt = z[:s, None] + z[None, s:]
        over = tilt >= np.log(cap)
        rate = np.where(over, cap, np.exp(np.minimum(tilt, np.log(cap))))
        paid = (sizes * np.where(over, cap * (tilt - np.log(cap)) + cap, rate)).sum() - targets @ z[:s] - goal @ z[s:] + price @ z[s:] ** 2 / 2
        bends = np.where(over, 0, sizes * rate)
        gradient = np.concatenate([(sizes * rate).sum(1) - targets, (sizes * rate).sum(0) - goal + price * z[s:]])
        return paid, gradient, np.block([[np.diag(bends.sum(1) + 1e-9), bends], [bends.T, np.diag(bends.sum(0) + price)]]), rate

    for _ in range(500):
        paid, gradient, hessian, rate = at(z)
        if np.abs(gradient).max() < 1e-9 * targets.sum():
            break
        step = -np.linalg.solve(hessian, gradient)
        step *= min(1, 1 / np.abs(step).max())
        while at(z + step)[0] > paid and np.abs(step).max() > 1e-12:
            step /= 2
        z = z + step
    return rate


@pytest.mark.parametrize("seed", range(2))
def test_mixing_newton(spark, seed):
    """The distributed steps against a dense solver, with sources that differ in what classes they hold, some of them near the cap."""
    import numpy as np

    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 1000, (9, 5)) * (rng.random((9, 5)) < 0.7)
    sizes[:, 2] += 5
    targets = sizes.sum(1) * rng.choice([0.2, 0.7, 1.3, 2.5, 2.9], 9)
    goal = targets.sum() * sizes.sum(0) / sizes.sum()
    rows = [(f"s{i}", int(n.sum()), [(c, float(x)) for c, x in enumerate(n) if x], float(t)) for i, (n, t) in enumerate(zip(sizes, targets))]
    rows += [("none", 0, [(-1, 0.0)], 0.0), ("full", 10, [(1, 10.0)], 30.0), ("not", 10, [(3, 10.0)], 0.0)]
    df = spark.createDataFrame(rows, "source string, source_size long, cells array<struct<cls: int, size: double>>, target double")
    got = {r.source: r for r in mixing.balance(df, 3, Scratch(spark, "t")).collect()}
    want = plain_balance(sizes.astype(float), targets, goal, 3.0, mixing.PENALTY)
    for i in range(9):
        assert np.allclose([x for x, n in zip(got[f"s{i}"].rates, sizes[i]) if n], [x for x, n in zip(want[i], sizes[i]) if n], rtol=1e-4, atol=1e-6)
        assert np.dot(got[f"s{i}"].rates, sizes[i]) == pytest.approx(targets[i], rel=1e-9)
    assert got["none"].rates == [1.0] * 5 and got["full"].rates == [3.0] * 5 and got["not"].rates == [0.0] * 5
    even = lambda rates: np.abs((rates * sizes).sum(0) / targets.sum() - sizes.sum(0) / sizes.sum()).sum()
    assert even(np.array([got[f"s{i}"].rates for i in range(9)])) < even((targets / sizes.sum(1))[:, None])


def test_mixing_closed_form(spark):
    """With documents of one size class a source's rate is target / size."""
    rows = [(f"s{i}", 10 * i, [(0, 10.0 * i)], float(i * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "source string, source_size long, cells array<struct<cls: int, size: double>>, target double")
    for r in mixing.balance(df, 1e9, Scratch(spark, "t")).collect():
        assert r.rates[0] == (1.0 if not r.source_size else pytest.approx(r.target / r.source_size, rel=1e-9))


def test_mixing_rounding(spark):
    """Copies against the rates, class by class; many sources at once."""
    rng = random.Random(12)
    docs = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40, 200])), f"s{rng.choice(range(25)):02}") for i in range(6000)]
    got = mixing.copies(table(spark, docs)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for source, own in by.items():
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target, rel=1e-9)
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 0.01 * own[0].target + 2
        for r in own:
            assert r.copies <= 3 and abs(r.copies - r.rate) < 2  # what a larger size class can't round passes to the next one
    sized = table(spark, docs).withColumn("words", mixing.n_words(F.col("text")))
    assert {r.doc_id: r.copies for r in mixing.copies(sized.drop("text"), sizes="words").collect()} == {r.doc_id: r.copies for r in got}
    with pytest.raises(ValueError):
        mixing.copies(sized, cap=2.5)


def test_pieces(spark, corpus):
    import sentencepiece

    v = pieces.load()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    score = {p.replace(pieces.MARK, " "): s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k == "n"}
    unknown = min(score.values()) - pieces.UNKNOWN_PENALTY

    def best(text):
        """Highest sum of scores by plain dynamic programming over characters."""
        t, top = " " + text, [0.0]
        for e in range(1, len(t) + 1):
            options = [top[b] + score[t[b:e]] for b in range(max(0, e - 48), e) if t[b:e] in score]
            top.append(max([*options, *([top[e - 1] + unknown] if t[e - 1] not in score else [])]))
        return top[-1]

    texts = ["", " ", "  a  b ", "the end", "日本語 テスト 😀", "tab\tand\nline", "naïve café " * 3, "hello" * 50, "▁mark ▁", "\x00\x7f"] + [t[:200] for _, t, *_ in corpus[:20]]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pieces.encode(table(spark, rows), check=True).collect()}
    for i, t in rows:
        ids = got[i].token_ids
        assert got[i].round_trip and len(ids) == got[i].n_tokens
        assert model.decode(ids) == t.replace(pieces.MARK, " ")
        if t:
            value, at = 0.0, 0
            while at < len(ids):  # a run of byte pieces is so many unknown characters
                run = at
                while run < len(ids) and v.kinds[ids[run]] == "b":
                    run += 1
                raw = bytes(int(v.pieces[j][3:5], 16) for j in ids[at:run])
                value += unknown * len(raw.decode()) if raw else v.scores[ids[at]]
                at = max(run, at + 1)
            assert value == best(t.replace(pieces.MARK, " ")), t
    every = pieces.encode(table(spark, corpus), check=True)
    assert every.where("round_trip").count() == len(corpus)
    back = {r.doc_id: r.text for r in pieces.decode(every).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in corpus)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [-5, 10**6, 3 + 0xFF])], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(odd).collect()} == {1: "", 2: "", 3: "�"}
    assert pieces.encode(table(spark, corpus[:0])).count() == 0


def test_codecs_of_models_alike(spark):
    """Two models of one size, last piece and scores are two models, in a reused worker too."""
    made = [pieces.Vocabulary(["<unk>", "\u2581", *letters, "z"], [0.0, -1.0, *[-float(2 + i) for i in range(len(letters))], -50.0], "un" + "n" * len(letters) + "n") for letters in ("abcd", "abce")]
    one, two = (type("Shared", (), {"value": v})() for v in made)
    a, b = pieces._codec(one), pieces._codec(two)
    assert a is not b and pieces._codec(two) is b and pieces._codec(type("Shared", (), {"value": made[1]})()) is b


def test_license_scan(spark, corpus):
    exact = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = [*corpus, (301, "Released under the MIT  License. And the MIT-License, gnu GENERAL public\nlicense; mitt license"), (302, "some words. Relesed under the MIT License."), (303, "Licensd under the Apache Licence, Version 2.0"),
            (304, "é" * 50 + " Licensed under CC BY-NC 4.0"), (305, "the license of mit is general"), (306, "mit license " * 5000)]
    got = {(r.doc_id, r.n_words): r for r in licenses.license_scan(table(spark, rows)).collect()}
    for i, t, *_ in rows:
        w = exact.findall((t or "").translate(ASCII))
        at = [(j, label) for p, label in licenses.PHRASES for q in [p.split()] for j in range(len(w) - len(q) + 1) if w[j : j + len(q)] == q]
        r = got[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None))
        assert r.base_labels == sorted({x for _, x in at}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    pick = {i: r for (i, _), r in got.items()}
    assert pick[301].labels == ["gpl", "mit"] and pick[301].n_base == 3
    assert pick[302].labels == ["mit"] and [(s.start, s.errors) for s in pick[302].spans] == [(12, 1)] and pick[302].score == 1
    assert pick[303].labels == ["apache"] and pick[303].n_base == 0 and 0.9 < pick[303].score < 1
    assert pick[304].labels == ["cc-by-nc"] and pick[304].spans[0].start == 51
    assert pick[305].labels == [] and pick[200].labels == [] and pick[306].n_base == 5000
    assert licenses.license_scan(table(spark, corpus[:0])).count() == 0


def test_license_spans_of_near_notices(spark):
    """Notices with more edits are found beside those with fewer, whichever comes first."""
    near, exact = "Licensd under the Apache License, Version 2.0. ", "Licensed under the Apache License, Version 2.0. "
    rows = [(1, near * 50 + exact), (2, exact + near * 50), (3, "All right reserved. All rights reserved.")]
    got = {r.doc_id: [(s.start, s.errors) for s in r.spans if s.label != "mit"] for r in licenses.license_scan(table(spark, rows)).collect()}
    assert got[1] == [(len(near) * i, 1) for i in range(50)] + [(len(near) * 50, 0)]
    assert got[2] == [(0, 0)] + [(len(exact) + len(near) * i, 1) for i in range(50)]
    assert got[3] == [(0, 1), (20, 0)]


def test_license_spans_of_wrapped_notices(spark):
    """Any run of characters other than words' may stand between the words of a notice; spans are places in the text itself."""
    texts = ["é¡ All rights\n           Reserved.", "creative commons\n        // attribution", "Redistribution and use in source\n -- \n -- and binary forms", "gnu" + " " * 5000 + "lesser genral public\n\n#\t\t*       license", "  mozilla  public  license,  version  (2 . 0)"]
    wants = [("all-rights-reserved", 0), ("cc-by", 0), ("bsd", 0), ("lgpl", 1), ("mpl", 0)]
    got = {r.doc_id: r.spans for r in licenses.license_scan(table(spark, list(enumerate(texts)))).collect()}
    for i, (text, want) in enumerate(zip(texts, wants)):
        assert [(s.label, s.errors) for s in got[i]] == [want]
        first, last = re.search(r"[a-zA-Z]", text).start(), max(m.end() for m in re.finditer(r"[a-zA-Z0-9]", text))
        assert (got[i][0].start, got[i][0].end) == (first, last)


def _nearest(words, text):
    """By a plain edit-distance scan: for each end in text the fewest edits of words, from any start."""
    column, ends = list(range(len(words) + 1)), []
    for c in text:
        row = [0]
        for i, w in enumerate(words):
            row.append(min(column[i] + (w != c), column[i + 1] + 1, row[i] + 1))
        column = row
        ends.append(column[-1])
    return ends


def test_notice_matcher_against_plain_distance():
    """Places have as many errors as said, and no place of so few errors is left beside or between them."""
    rng = random.Random(2)
    cases = [(f"a{''.join(rng.choice('ab ') for _ in range(rng.randint(1, 7)))}b", "".join(rng.choice("ab ") for _ in range(rng.randint(0, 40))), 1) for _ in range(300)]
    for _ in range(60):
        notice = rng.choice([n for n in licenses.NOTICES if len(n.words) < 52])
        parts = []
        for _ in range(rng.randint(1, 4)):
            near = list(notice.words)
            for _ in range(rng.randint(0, notice.errors + 1)):
                at = rng.randrange(len(near))
                near[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
            parts += ["".join(near), "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9)))]
        cases.append((notice.words, " ".join(" ".join(parts).split()), notice.errors))
    hits = 0
    for words, text, errors in cases:
        found = licenses.Matcher(words, errors).find(text)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        for start, end, d in found:
            assert _nearest(words, text[start:end])[-1] <= d <= errors
        edges = [0, *(x for start, end, _ in found for x in (start, end)), len(text)]
        for a, b in zip(edges[::2], edges[1::2]):
            assert all(d > errors for d in _nearest(words, text[a:b])), (words, text, found)
        hits += len(found)
    assert hits > 200


def test_license_spans_against_plain_scan(spark):
    """Through seeds and windows too: whatever the plain scan finds in texts of several near notices side by side overlaps a span of that notice."""
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            notice = rng.choice(licenses.NOTICES)
            near = list(notice.words)
            for _ in range(rng.randint(0, notice.errors)):
                at = rng.randrange(len(near))
                near[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
            parts += ["".join(near), *(rng.choice(["some", "word", "license"]) for _ in range(rng.randint(0, 3)))]
        texts.append(" ".join(" ".join(parts).split()))
    got = {r.doc_id: r.spans for r in licenses.license_scan(table(spark, list(enumerate(texts)))).collect()}
    found = 0
    for i, text in enumerate(texts):
        for notice in licenses.NOTICES:
            spans = [(s.start, s.end) for s in got[i] if s.label == notice.label]
            for j, d in enumerate(_nearest(notice.words, text)):
                if d <= notice.errors:
                    found += 1
                    assert any(a < j + 1 + notice.errors and j + 1 - len(notice.words) - notice.errors < b for a, b in spans), (text, notice.label, j)
    assert found > 100


def test_notice_seeds_hold_under_errors():
    """Whatever errors a notice has, one of its seeds is left (pigeonhole)."""
    for notice in licenses.NOTICES:
        assert len(notice.seeds()) == notice.errors + 1
        spans = sorted((before, before + len(seed)) for seed, before in notice.seeds())
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def _languages(n):
    rng = random.Random(8)
    kinds = {"xx": "bakelomi", "yy": "strüngßöch", "zz": "éàçouêqui"}
    rows = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 60))), None, lang))
    return rows


def test_languages(spark):
    rows = _languages(240) + [(900, None, None, "xx"), (901, "", None, "xx"), (902, "12 34 !!", None, "yy"), (903, "bake", None, None), (904, "bake lomi " * 20000, None, None)]
    got = {r.doc_id: r for r in languages.languages(table(spark, rows), languages.Sample(windows=300, steps=60)).collect()}
    known = [(r, got[r[0]]) for r in rows[:240]]
    assert all(g.held_out == _held(r[0]) for r, g in known)
    held = [r[3] == g.lang_pred for r, g in known if g.held_out]
    assert len(held) > 30 and sum(held) >= 0.9 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[904].lang_pred == "xx"
    assert languages.languages(table(spark, rows[:0])).count() == 0
    blind = [(i, t, s, "qq" if _held(i) else lang) for i, t, s, lang in rows]  # labels that are held out change nothing
    other = {r.doc_id: r for r in languages.languages(table(spark, blind), languages.Sample(windows=300, steps=60)).collect()}
    assert all(other[i].lang_pred == got[i].lang_pred for i in got)
    none = languages.languages(table(spark, [(1, "bake", None, None)])).collect()
    assert none[0].lang_pred == "und"


def test_languages_are_all_learned(spark):
    """Rare languages beyond any number of frequent ones get their own value; the sample is bounded in total."""
    rng = random.Random(3)
    langs = [f"l{k:02}" for k in range(70)]
    words = {x: chr(0x4E00 + 128 * k) for k, x in enumerate(langs)}
    rows = [(100 * k + i, " ".join(words[x] * rng.randint(2, 5) for _ in range(20)), None, x) for k, x in enumerate(langs) for i in range(12 if k < 64 else 9)]
    docs = table(spark, rows)
    own = docs.select("doc_id", "text", "lang")
    _, learned = languages.labelled_sample(own, ~languages.held_out(F.col("doc_id")), "lang", languages.Sample())
    assert set(learned) == set(langs)
    _, few = languages.labelled_sample(own, ~languages.held_out(F.col("doc_id")), "lang", languages.Sample(total=150))
    assert set(few) == set(langs) and len(few) == 140
    _, least = languages.labelled_sample(own, ~languages.held_out(F.col("doc_id")), "lang", languages.Sample(total=10))
    assert sorted(least) == langs
    got = {r.doc_id: r.lang_pred for r in languages.languages(docs, languages.Sample(steps=12)).collect()}
    rare = [got[i] == x for i, _, _, x in rows if x in langs[64:]]
    assert sum(rare) >= 0.9 * len(rare)


def test_languages_learn_from_whole_texts(spark):
    """Windows come from all over a long text, not from its beginning or middle; a frequent language is cut down before it is ranked."""
    long = "".join(chr(0x4E00 + i // 64) for i in range(64 * 900))
    rows = [(i, long, None, "long") for i in range(12)] + [(100 + i, "short text", None, "short") for i in range(3000)]
    own = table(spark, rows).select("doc_id", "text", "lang")
    win, y = languages.labelled_sample(own, F.lit(True), "lang", languages.Sample(windows=100))
    assert y.count("short") == y.count("long") == 100
    places = sorted((w.tobytes()[:3].decode("utf-8", "ignore") or "\u4e00") for w, x in zip(win, y) if x == "long")
    assert ord(places[5]) < 0x4E00 + 200 and ord(places[-5]) > 0x4E00 + 700


def test_toxicity_learns_from_whole_texts(spark):
    long = "plain words " * 20000 + "zorkface"
    rows = [(i, long if i % 2 else f"short {i}") for i in range(60)] + [(77, None), (78, "é" * 40), (78, "twice"), (78, "twice")]
    marks = spark.createDataFrame([*((i, i % 2) for i in range(60)), (77, 0), (78, 0), (79, 1)], "doc_id long, toxic int")
    learn = lambda **k: list(zip(*toxicity.labelled_sample(table(spark, rows).select("doc_id", "text"), marks, toxicity.Sample(**k))))
    texts = learn(bytes=1 << 30)
    assert sorted(texts) == sorted([(t, int(t == long)) for i, t in rows if not _held(i) and t is not None])
    some = learn(bytes=4 * 240_008 * 4000 // 1200 + 4)
    assert [t for t, y in some if y] == [long] * 4 and sum(1 for _, y in some if not y) == sum(1 for _, y in texts if not y)
    assert not any(y for _, y in learn(bytes=240_000))


def test_toxicity_windows_hold_every_short_passage():
    """Any passage of half a window lies whole in some window."""
    for n in range(24, 200):
        starts = toxicity.window_starts(n)
        assert starts[-1] + toxicity.SPAN >= n
        assert all(any(s <= a and a + 24 <= s + toxicity.SPAN for s in starts) for a in range(n - 23))


def test_toxicity_labels_are_not_sorted_in_one_task(spark, monkeypatch):
    """No window over the labels: the lowest hashes of either label come from each task's own."""
    sent = []
    monkeypatch.setattr(toxicity.F, "broadcast", lambda frame: sent.append(frame) or frame)
    docs = table(spark, [(i, f"text {i}") for i in range(40)]).select("doc_id", "text")
    marks = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    texts, y = toxicity.labelled_sample(docs, marks, toxicity.Sample(toxic=3, clean=4))
    plan = sent[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("TakeOrderedAndProject") == 2
    order = [r.doc_id for r in marks.orderBy(F.xxhash64("doc_id"), "doc_id").collect() if not _held(r.doc_id)]
    assert sorted(zip(texts, y)) == sorted((f"text {i}", k) for k, n in ((1, 3), (0, 4)) for i in [i for i in order if i % 2 == k][:n])


def test_toxicity(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(420):
        w = [word() for _ in range(rng.randint(3, 150))]
        toxic = rng.random() < 0.4
        for _ in range(max(1, len(w) // 30) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(("zorkface", "quagnit", "vexxu" + rng.choice("aeiou")))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 0))
    rows += [(900, None), (901, ""), (902, "... !!"), (903, " ".join(word() for _ in range(30000)) + " zorkface"), (904, "Zorkface"), (905, "bit")]
    marks = spark.createDataFrame([*labels, (0, None, 1), (77777, 1, 1)], "doc_id long, toxic int, y int")
    sample = toxicity.Sample(toxic=150, clean=200, epochs=3)
    docs = table(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks, sample).collect()}
    held = [((got[i].toxic_score >= toxicity.THRESHOLD) == bool(y)) for i, y, _ in labels if _held(i)]
    assert len(held) > 60 and sum(held) >= 0.9 * len(held)
    assert all(got[i].toxic_score == 0 and got[i].n_windows == 0 for i in (900, 901, 902))
    assert got[903].toxic_score >= 0.3 and got[903].n_windows > 800 and got[904].toxic_score >= 0.3 and got[905].toxic_score < 0.3
    assert got[903].worst_window >= 29900 and set(got[1].asDict()) == {*docs.columns, "toxic_score", "n_windows", "worst_window"}
    assert toxicity.toxicity(docs.limit(0), marks, sample).count() == 0
    assert toxicity.toxicity(docs, marks.limit(0), sample).where("toxic_score = 0").count() == len(rows)
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.doc_id: r.toxic_score for r in toxicity.toxicity(docs, flipped, sample).collect()}
    assert all(other[i] == got[i].toxic_score for i in got)


def test_gradients():
    """The networks' gradients against differences of the loss."""
    import numpy as np

    rng = np.random.default_rng(1)
    toxicity_net = toxicity.Network.new(rng)
    x = rng.standard_normal((30, toxicity.DIM_W + toxicity.DIM_C)).astype(np.float32)
    at, mask, _ = toxicity._windows(np.array([30]))
    loss = lambda: float(toxicity_net.forward(x, at, mask).sum())
    _, tape = toxicity_net.forward(x, at, mask, keep=True)
    g, dx = toxicity_net.backward(x, at, mask, tape, np.ones(1, np.float32))
    for values, grad in [(x, dx), *((toxicity_net.p[k], v) for k, v in g.items())]:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in values.shape)
            old = values[i]
            values[i] = old + 1e-2
            up = loss()
            values[i] = old - 1e-2
            assert (up - loss()) / 2e-2 == pytest.approx(grad[i], abs=3e-3, rel=0.05)
            values[i] = old
    net = languages.Network(["a", "b"], 1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    win, y = rng.integers(97, 122, (5, languages.SPAN)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    g = net.step(win, y)

    def cross():
        net.tables = {}
        return -float(net.probabilities(win)[np.arange(5), y].mean())

    for k in g:
        for _ in range(3):
            i = (int(rng.integers(97, 122)), int(rng.integers(0, languages.DIM))) if k == "byte" else tuple(rng.integers(0, n) for n in net.p[k].shape)
            old = net.p[k][i]
            net.p[k][i] = old + 1e-5
            up = cross()
            net.p[k][i] = old - 1e-5
            assert (up - cross()) / 2e-5 == pytest.approx(g[k][i], abs=1e-5, rel=1e-3)
            net.p[k][i] = old


