"""Vector searches against brute force, with odd vectors, ties and repeats."""

import math

import numpy as np

from quillon.llm import ivf_pq, va_file

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, list int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "s", 2) for i, v in vectors], SCHEMA)


def vectors(n=400, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    x = (centres[rng.integers(0, 8, n)] + 0.5 * rng.standard_normal((n, d))).astype(np.float32)
    x[: n // 3] = x[0]  # a third are the same
    rows = [(i, x[i].tolist()) for i in range(n)]
    rows += [(1000, None), (1100, []), (1200, [None] * d), (1300, [math.nan] * d), (1400, [math.inf] + [0.0] * (d - 1)), (1500, [0.0] * d), (1600, [1.0, 2.0]), (1700, x[7].tolist())]
    return rows, x


def test_va_file(spark):
    rows, x = vectors()
    usable = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows if v and None not in v and all(map(math.isfinite, v))}
    df = table(spark, rows)
    got = va_file.top_k(df, df.where("vec_id % 100 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in [i for i in usable if i % 100 == 0]:
        want = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:10]
        assert sorted(by.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)], q
    assert {1000, 1100, 1200, 1300, 1400}.isdisjoint(by)
    assert va_file.top_k(df.limit(0), df).count() == 0 and va_file.top_k(df, df.limit(0)).count() == 0


def test_va_file_in_parts_and_beyond_doubles(spark, monkeypatch):
    for name, value in (("PART_BYTES", 100), ("QUERIES", 3), ("ROWS", 7)):
        monkeypatch.setattr(va_file, name, value)
    rows, _ = vectors(60, 4, 2)
    big = [(2000 + i, [3e9 * (i + 1), -1e9, 7.0, i]) for i in range(5)]
    df = table(spark, rows[:60] + big)
    usable = {i: [math.floor(1024 * float(np.float32(z))) for z in v] for i, v in rows[:60] + big}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in va_file.top_k(df, df, k=3).collect()}
    for q, a in usable.items():
        want = sorted((-min(max(sum(p * r for p, r in zip(a, b)), -(2**63)), 2**63 - 1), i) for i, b in usable.items() if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in want]


def test_cells_hold_their_vectors():
    rng = np.random.default_rng(3)
    y = np.floor(np.concatenate([rng.standard_normal((40, 5)) * 10.0 ** rng.integers(0, 12, (40, 1)), [[127, -128, 0, 1, 2]], [[128, -129, 0, 1, 2]], [[0.0] * 5]]))
    grid, bits = va_file.cells(y)
    low = np.ldexp(grid.astype(float), bits[:, None])
    assert grid.dtype == np.int8 and ((low <= y) & (y <= low + np.ldexp(1.0, bits[:, None]) - 1)).all()
    assert bits[40:].tolist() == [0, 1, 0]
    lower, upper = va_file.bounds(y, low, np.ldexp(1.0, bits) - 1)
    exact = np.clip(y @ y.T, -(2.0**63), 2.0**63)
    assert ((lower <= exact) & (exact <= upper)).all()


def test_va_file_reads_few_exact_vectors(spark, tmp_path):
    """Candidates are few beside all pairs, in the order of their bounds; equal vectors are read k + 1 times at most."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32))
    x[:1000] = x[0]
    rows = va_file.V.hashed(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), "vec_id", "embedding")
    y = [(i, 32, np.floor(1024 * x[i].astype(np.float32).astype(float)).tobytes()) for i in range(0, 3000, 100)]
    asked = spark.createDataFrame([(i, d, bytearray(b)) for i, d, b in y], "id long, d int, q binary")
    order = va_file.candidates(rows, asked, 10, 1024, va_file.Scratch(spark, "test")).toPandas().sort_values(["query_id", "place"])
    assert order.groupby("query_id").size().between(10, 100).all() and order.query_id.nunique() == 30
    assert (order.groupby("query_id").upper.diff().dropna() <= 0).all()
    assert (order.id < 1000).groupby(order.query_id).sum().max() <= 11


def test_queries_that_share_an_id(spark):
    rows = [(i, [float(i), 1.0, -i]) for i in range(30)] + [(7, [1.0, 1.0, 1.0]), (7, [7.0, 1.0, -7.0])]
    df = table(spark, rows)
    for search in (lambda a, b: va_file.top_k(a, b, k=5), lambda a, b: ivf_pq.nearest(a, b, k=5)):
        one, two = (sorted(map(tuple, search(df, q).collect())) for q in (df.where("vec_id = 7"), df.where("vec_id = 7").repartition(3).orderBy("embedding")))
        assert one == two and len(one) == 5 and all(r[2] != 7 for r in one)
    asked = table(spark, rows[3:4])
    score = [r.score for r in va_file.top_k(df, asked, k=40).orderBy("rank").collect()]
    want = sorted((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(rows[3][1], v)) for i, v in rows if i != 3))
    assert [-s for s in score] == want


def test_groups_hold_all_lists():
    rng = np.random.default_rng(1)
    sizes = {int(i): int(n) for i, n in zip(rng.permutation(60)[:50], rng.integers(1, 400, 50))}
    first, number, total = ivf_pq.groups(sizes, 100)
    load = np.zeros(total)
    for i, n in sizes.items():
        load[first[i] : first[i] + number[i]] += n / number[i]
    assert load.max() <= 100 and (first + number).max() <= total and total <= sum(-(-n // 100) for n in sizes.values()) + 1


def test_ivf_pq(spark):
    rows, x = vectors()
    df = table(spark, rows)
    settings = ivf_pq.Settings(sample=300, lists=12, codes=64, group=50)
    got = ivf_pq.nearest(df, df.where("vec_id % 20 = 0"), settings=settings).collect()
    every = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and len(v) == 16 and None not in v and all(map(math.isfinite, v)) and any(v)}
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for q in [i for i in every if i % 20 == 0]:
        want = sorted((math.sqrt(((every[q] - v) ** 2).sum()), i) for i, v in every.items() if i != q)[:10]
        mine = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - math.sqrt(((every[q] - every[r.vec_id]) ** 2).sum())) < 1e-9 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len({i for _, i in want} & {r.vec_id for r in mine})
        total += 10
    assert hit >= 0.9 * total
    assert {1000, 1100, 1200, 1300, 1400, 1500, 1600}.isdisjoint(by)
    assert ivf_pq.nearest(df.limit(0), df).count() == 0
    few = table(spark, rows[130:134])
    assert ivf_pq.nearest(few, few).count() == 4 * 3


def plain_nearest(rows, asked, k=10):
    want = {}
    for q, a in asked:
        near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))), i) for i, b in rows if i != q and len(b) == len(a))
        want[q] = near[:k]
    return want


def found(rows):
    by = {}
    for r in sorted(rows, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return by


def test_ivf_pq_of_several_lengths(spark):
    """Each length has an index: no vector is left out for being of a rarer one."""
    rng = np.random.default_rng(6)
    single = lambda d: rng.standard_normal(d).astype(np.float32).astype(float).tolist()
    rows = [(i, single(8)) for i in range(300)] + [(i, single(4)) for i in range(1000, 1200)] + [(5000, single(3)), (5001, single(3)), (6000, single(5))]
    df = table(spark, rows)
    got = found(ivf_pq.nearest(df, df.where("vec_id % 100 = 0")).collect())
    want = plain_nearest(rows, [r for r in rows if r[0] % 100 == 0])
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items() if x}
    hit = sum(len({i for _, i in got[q]} & {i for _, i in x}) for q, x in want.items() if x)
    assert hit >= 0.9 * sum(map(len, want.values())) and len(got[1100]) == 10 and [i for _, i in got[5000]] == [5001]


def test_ivf_pq_finds_k_where_lists_are_short(spark):
    """Queries whose probed lists hold fewer than k rows go past all."""
    rng = np.random.default_rng(7)
    rows = [(i, (1000.0 * (i // 3) + rng.standard_normal(6)).astype(np.float32).astype(float).tolist()) for i in range(90)]
    df = table(spark, rows)
    settings = ivf_pq.Settings(lists=30, sample=90, recall=0.1)
    got = found(ivf_pq.nearest(df, df, settings=settings).collect())
    assert all(len(got[q]) == 10 for q in range(90))
    want = plain_nearest(rows, rows)
    assert all({i for _, i in got[q][:2]} == {i for _, i in want[q][:2]} for q in range(90))


def test_rows_that_repeat_id_and_vector(spark):
    """Each counts, though one is kept."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(5).astype(np.float32).astype(float).tolist()) for i in range(40)]
    rows += [rows[3]] * 25 + [rows[4]] * 2 + [rows[0]] * 3
    df = table(spark, rows)
    got = found(ivf_pq.nearest(df, df.where("vec_id % 10 = 0"), settings=ivf_pq.Settings(refine=40)).collect())
    want = plain_nearest(rows, [rows[i] for i in (0, 10, 20, 30)])
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    cell = lambda v: [math.floor(1024 * x) for x in v]
    scores = found(va_file.top_k(df, df.where("vec_id % 10 = 0")).collect())
    for q in (0, 10, 20, 30):
        best = sorted((-sum(a * b for a, b in zip(cell(rows[q][1]), cell(v))), i) for i, v in rows if i != q)[:10]
        assert scores[q] == [(-s, i) for s, i in best]
