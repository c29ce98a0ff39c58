"""Line dedup: which lines of each document stay, as compressed bitmaps. DataFrame functions only.

Lines are hashed, dealt by range over their hashes and sorted within a range by hash, document (largest first) and
position. A window streams over that order: the first row of a key is the occurrence to keep, and each row is
compared with the one before it to count the key's documents. A sketch of bounded size finds keys frequent enough
to burden a task; these are cut into slices by document, each a stream of its own, and the heads of the slices (a
row for each) say which document comes first in all of them. What comes out are bitmaps, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
#: Keys that the sketch reports at most and that it tracks, the share of all rows above which a key is sliced, and the bounds on the rows of a slice.
HOT_KEYS, TRACKED, SHARE, LEAST, MOST = 1024, 16384, 1024, 256, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the short way for texts of ASCII alone."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    """The lines of a text; of null one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Hash of each key of at least ``min_chars`` code points: (h1, h2, doc_id, body, pos). ``body`` is the text's hash, which tells rows with one doc_id apart."""
    rows = docs.where(F.col(doc_id).isNotNull())
    lines = rows.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("body"), F.posexplode(text_lines(F.col(text))).alias("pos", "line"))
    stripped = lines.where(F.octet_length("line") >= min_chars).select("doc_id", "body", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
    keys = stripped.where(F.length("line") >= min_chars).select("doc_id", "body", "pos", ascii_lower(F.col("line")).alias("key"))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.reverse("key")).alias("h2"), "doc_id", "body", "pos")


def slices(keys: DataFrame) -> DataFrame:
    """(h1, slices) of frequent keys, at most HOT_KEYS rows: into how many slices a key is cut so that none exceeds its share of all rows."""
    top = keys.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {HOT_KEYS}, {TRACKED})").alias("top"))
    each = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col("n") / SHARE))
    found = top.select(F.explode("top").alias("t"), each.alias("each"))
    return found.select(F.col("t.item").alias("h1"), F.ceil(F.col("t.count") / F.col("each")).alias("slices")).where("slices > 1")


def stream(keys: DataFrame) -> DataFrame:
    """The rows of keys, each with ``first``, the document at the head of its stream, ``n_docs`` of the stream, ``is_head`` and the number of ``slices``."""
    cut = keys.join(F.broadcast(slices(keys)), "h1", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id"), "slices"))
    ranged = cut.repartitionByRange("h1", "h2", "slice")
    # The windows' order is the secondary sort within a range; they need no further shuffle.
    key = Window.partitionBy("h1", "h2", "slice")
    ordered = key.orderBy(F.desc("doc_id"), "body", "pos")
    before = ranged.select("*", F.first("doc_id").over(ordered).alias("first"), F.lag("doc_id").over(ordered).alias("before"))
    opens = F.col("before").isNull() | (F.col("before") != F.col("doc_id"))
    return before.select("h1", "h2", "slices", "doc_id", "body", "pos", "first", F.col("before").isNull().alias("is_head"), F.sum(opens.cast("long")).over(key).alias("n_docs"))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """A row for each text that loses lines: doc_id, body (the text's hash), n_dropped, dropped (positions), keep_runs.

    A key is a line without blanks at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code
    points that at least ``min_docs`` documents hold lose all their lines except in the largest doc_id
    that holds them. ``keep_runs`` is the keep bitmap, run-length coded: the runs of kept lines, each a struct of its
    start and its end (exclusive; null of the last run, which goes on to the text's end).

    Null and empty texts have one empty line and lose nothing, nor do rows without a doc_id, which count as no
    document. Rows that share a doc_id count as one document for the keys' counts, and keep or lose a key's lines
    together; each different text has a bitmap of its own, and rows with equal text share it. A table without
    rows gives none. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    # Written once, as the sketch, dealing by range and the streams all read it.
    keys = scratch.table(line_keys(docs, doc_id, text, min_chars), "keys")
    # What can lose its line, and all rows of sliced keys, of which that isn't known yet.
    found = scratch.table(stream(keys).where((F.col("slices") > 1) | ((F.col("n_docs") >= min_docs) & (F.col("doc_id") < F.col("first")))), "found")
    scratch.drop("keys")
    sliced = found.where("slices > 1")
    heads = sliced.where("is_head").groupBy("h1", "h2").agg(F.max("first").alias("top"), F.sum("n_docs").alias("n"))
    # At most HOT_KEYS keys (but for colliding hashes) are sliced.
    losing = sliced.join(F.broadcast(heads.where(F.col("n") >= min_docs)), ["h1", "h2"]).where(F.col("doc_id") < F.col("top"))
    losing = found.where("slices = 1").select("doc_id", "body", "pos").unionAll(losing.select("doc_id", "body", "pos"))
    dropped = losing.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    return dropped.select("doc_id", "body", F.size("dropped").alias("n_dropped"), "dropped", keep_runs(F.col("dropped")).alias("keep_runs"))


def keep_runs(dropped: Column) -> Column:
    """Sorted positions of dropped lines as the runs of kept lines: structs of ``start`` and ``end``, the latter exclusive, of the last run null."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1))
    runs = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1)).alias("start"),
        F.concat(starts, F.array(F.lit(None).cast("int"))).alias("end"),
    )
    return F.filter(runs, lambda r: r["end"].isNull() | (r["end"] > r["start"]))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs with n_lines, n_dropped and kept_text: the lines that stay, joined by \\n.

    Documents without a bitmap keep all lines; a null text is one empty line. Columns of docs with the
    names of the results are replaced.
    """
    names = ("n_lines", "n_dropped", "kept_text")
    marks = bitmaps.select(F.col("doc_id").alias("id"), F.col("body").alias("of"), "n_dropped", F.col("keep_runs").alias("runs"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("body"))
    joined = rows.join(marks.hint("shuffle_hash"), (F.col("doc_id") == F.col("id")) & (F.col("body") == F.col("of")), "left")
    body = F.col("row")[text]
    lines = text_lines(body)
    cut = F.transform("runs", lambda r: F.slice("lines", r["start"] + 1, F.coalesce(r["end"], F.size("lines")) - r["start"]))
    found = joined.select("row", F.size(lines).cast("long").alias("n_lines"), "n_dropped", F.when(F.col("runs").isNotNull(), lines).alias("lines"), "runs")
    return found.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in names],
        "n_lines",
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("runs").isNull(), F.coalesce(body, F.lit(""))).otherwise(F.array_join(F.flatten(cut), "\n")).alias("kept_text"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    applied = apply_bitmaps(docs, keep_bitmaps(docs))
    return applied.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), frequent AS (
  SELECT key, max(doc_id) AS first FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, f.key IS NOT NULL AND l.doc_id < f.first AS dropped FROM lines l LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
