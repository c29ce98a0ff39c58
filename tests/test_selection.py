"""Places in an order: numbering, selection of order statistics, samples, order of rows in files."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.operators import annotate, frames, numbering, selection
from quillon.operators.numbering import numbered, numbered_within
from quillon.sources import tables


def table(spark, n=900):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice([None, *range(40)]), rng.random()) for _ in range(n)] + [("one", 1, 0.5), ("same", 7, 0.25)] + [("same", 7, 0.25)] * 30
    return rows, spark.createDataFrame(rows, "g string, i int, `a.b` double").repartition(5)


@pytest.mark.parametrize("small, splitters, sampled", [(1 << 16, 256, 16), (3, 8, 2)])
def test_selection_takes_the_rows_at_their_places(spark, monkeypatch, small, splitters, sampled):
    """In one round, and in as many as ranges of so few rows take."""
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "SPLITTERS", splitters)
    monkeypatch.setattr(selection, "SAMPLED", sampled)
    rows, df = table(spark, 300)
    groups = defaultdict(list)
    for g, i, v in rows:
        groups[g].append((i is not None, i or 0, v))
    got = defaultdict(list)
    picked = selection.selected(df, ["g"], ["i", "`a.b`"], lambda n: F.array((n - 1).cast("long"), F.floor(n / 3).cast("long"), F.lit(0).cast("long"), F.lit(5000).cast("long")))
    assert picked.columns == df.columns
    for g, i, v in picked.collect():
        got[g].append((i is not None, i or 0, v))
    assert {g: sorted(x) for g, x in got.items()} == {g: [sorted(x)[p] for p in sorted({0, len(x) // 3, len(x) - 1})] for g, x in groups.items()}
    assert selection.selected(df.limit(0), ["g"], ["i"], lambda n: F.array(n)).count() == 0
    whole = sorted((i is not None, i or 0, v) for _, i, v in rows)
    assert [tuple(r) for r in selection.selected(df, [], ["i", "`a.b`"], lambda n: F.array(F.lit(17).cast("long"))).select("i", "`a.b`").collect()] == [whole[17][1:] if whole[17][0] else (None, whole[17][2])]


def test_selection_does_not_number_all_rows(spark):
    """Windows are over ranges that hold a wanted place, and the rows that reach them are few."""
    df = spark.range(50_000).select((F.col("id") % 3).cast("string").alias("g"), "id")
    picked = frames.sample_evenly(df, ["g"], ["id"], 4)
    assert sorted(r.id for r in picked.collect()) == sorted(3 * p + g for g, n in ((0, 16667), (1, 16667), (2, 16666)) for p in (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1))
    plan = picked._jdf.queryExecution().toString()
    assert "row_number" in plan and "partitionBy" not in plan.split("row_number")[0]
    assert "_r" in plan.split("row_number")[1].split("\n")[0]


def test_numbering_is_an_order_of_all_rows(spark):
    rows, df = table(spark)
    placed = numbered(df, ["g", "i"]).collect()
    assert sorted(r._i for r in placed) == list(range(len(rows)))
    key = lambda r: ((r.g is not None, r.g or ""), (r.i is not None, r.i or 0))
    ordered = [key(r) for r in sorted(placed, key=lambda r: r._i)]
    assert ordered == sorted(ordered)
    within = numbered_within(df, ["g"], ["i"]).collect()
    by = defaultdict(list)
    for r in within:
        by[r.g].append(r)
    assert all(sorted(r._i for r in x) == list(range(len(x))) and all(r._n == len(x) for r in x) for x in by.values())
    assert numbered(df.limit(0), ["i"]).count() == 0


def test_numbering_writes_its_input_once(spark, monkeypatch):
    written = []
    table_of = numbering.Scratch.table
    monkeypatch.setattr(numbering.Scratch, "table", lambda self, df, name: (written.append(name), table_of(self, df, name))[1])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000, numPartitions=4).repartition(3).mapInArrow(count, "id long")
    placed = numbered(df, ["id"])
    before = seen.value
    assert placed.where("_i = id").count() == 1000 and placed.groupBy().sum("_i").head()[0] == 499500
    assert written == ["rows"] and seen.value == before <= 2000


@pytest.mark.parametrize("every", [1, 2, 5, 50])
def test_ids_of_a_holdout_are_those_of_its_splits(spark, every):
    df = spark.createDataFrame([(f"n{i:03}",) for i in range(23)], "name string").repartition(3)
    ids = annotate.holdout_ids(df, ["name"], every)
    assert sorted(map(tuple, ids.select("split", "image_id", "name").collect())) == sorted(map(tuple, annotate.image_ids(annotate.holdout(df, ["name"], every), ["name"]).select("split", "image_id", "name").collect()))


def test_seeded_sample(spark):
    df = spark.range(500).select(F.concat(F.lit("/f/"), "id").alias("path"))
    a, b, c = ([r.path for r in frames.seeded_sample(d, "path", 20, s).collect()] for d, s in ((df, 7), (df.repartition(7), 7), (df, 8)))
    assert a == b != c and len(set(a)) == 20 and frames.seeded_sample(df, "path", 900).count() == 500


def test_rows_in_file_order(spark, tmp_path):
    """A file that is read in several splits, and a folder of files."""
    lines = [f"{i},{'x' * (i % 50)}" for i in range(3000)]
    (tmp_path / "log.csv").write_text("n,t\n" + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        log = tables.read_log(spark, f"{tmp_path}/log.csv")
        assert log.columns == ["n", "t", "row_idx"]
        rows = log.collect()
        assert spark.read.text(f"{tmp_path}/log.csv").rdd.getNumPartitions() > 3
        assert sorted((r.row_idx, r.n) for r in rows) == [(i, i) for i in range(3000)]
        (tmp_path / "many").mkdir()
        for name, part in (("b", lines[1000:1700]), ("a", lines[:1000]), ("c", lines[1700:])):
            (tmp_path / "many" / f"{name}.txt").write_text("\n".join(part) + "\n")
        many = tables.in_file_order(spark.read.text(f"{tmp_path}/many"))
        assert [r.value for r in many.orderBy("row_idx").collect()] == lines
        assert sorted(r.row_idx for r in many.collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_numbers_above_the_header_are_no_hits(spark, tmp_path):
    head = "ID SSSSSSSS.mmmuuun CH RISE SIG STRENGTH AMP ABS-ENERGY\n"
    body = "1 12.5 1 3 4 40 1.25\nx 13.0 2 3 4 41 2\nID 14.0 2 3 SSSS 42 3\n"
    (tmp_path / "hits.txt").write_text("7 99.0 1 3 4 40 2\n8 98.0 1 3 4 40 2\n" + head + body)
    got = tables.read_hits(spark, f"{tmp_path}/hits.txt")
    assert [(r.time_s, r.ch, r.abs_energy) for r in got.orderBy("time_s").collect()] == [(12.5, 1, 1.25), (13.0, 2, 2.0), (14.0, 2, 3.0)]


def test_state_folders(spark):
    paths = [("/top/img/25 V/a.png",), ("/top/img/25 V/sub/b.png",), ("/top/img/c.png",), ("/top/img/30/top/img/40/d.png",), ("hdfs://h:1/top/img/50/e.png",), ("file:///top/img/60/e.png",)]
    df = spark.createDataFrame(paths, "path string")
    for root in ("/top/img", "/top/img/", "hdfs://h:1/top/img"):
        assert [r[0] for r in df.select(tables.state_folder(root)).collect()] == ["25 V", "25 V", None, "30", "50", "60"]
