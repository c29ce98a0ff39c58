"""Corpus pipeline: toxic documents go, repeated lines go, near duplicates go, sources are mixed, tokens remain.

Each stage calls one operator of quillon.llm and takes effect on the documents that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import line_dedup, mixing, ngram_join, pieces, toxicity
from quillon.llm.scratch import Scratch, released


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed by their place, and the new name of each: no name of a result can clash with them."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(found: DataFrame, names: dict[str, str], **new: Column) -> DataFrame:
    """The columns of documents under their own names, those in ``new`` replaced."""
    return found.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold.

    Null and empty texts and those without words stay. Rows are judged one by one: of rows that repeat a doc_id each
    stays or goes by its own text. All columns come back as they were, whatever their names. An empty table stays one.
    """
    rows, names = numbered(docs)
    scored = toxicity.toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id=names["doc_id"], text=names["text"])
    return restored(scored.where(F.col("toxic_score") < toxicity.THRESHOLD), names)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that the bitmaps drop; n_chars follows the text. A document may be left empty.

    Texts that lose nothing stay as they are, null included, as do rows without a doc_id. Rows that repeat a doc_id lose
    their own lines each. Other columns come back as they were, whatever their names. An empty table stays one.
    """
    rows, names = numbered(docs)
    own = {"doc_id": names["doc_id"], "text": names["text"]}
    cut = line_dedup.apply_bitmaps(rows, line_dedup.keep_bitmaps(rows, **own), **own)
    lost = F.col("n_dropped") > 0
    new = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col(names["text"]))}
    if "n_chars" in names:
        new["n_chars"] = F.when(lost, F.length("kept_text").cast("long")).otherwise(F.col(names["n_chars"]))
    return restored(cut, names, **new)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8 or more the one with the smallest doc_id.

    Rows that share a doc_id are one document: they have each other's links, and stay or go together. Null and empty
    texts are linked with nothing and stay, as do rows without a doc_id. All columns come back as they were, whatever
    their names. An empty table stays one.
    """
    rows, names = numbered(docs)
    joined = ngram_join.ngram_join(rows, k=5, percent=80, doc_id=names["doc_id"], text=names["text"])
    gone = joined.where("component_id < doc_id").select(F.col("doc_id").alias(names["doc_id"])).distinct()
    return restored(rows.join(gone, names["doc_id"], "left_anti"), names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times; those without words, null texts included, once.

    A null source is a source of its own. Rows that repeat a doc_id are taken each by its own size. All columns come
    back as they were, whatever their names. An empty table stays one.
    """
    rows, names = numbered(docs)
    taken = mixing.copies(rows, doc_id=names["doc_id"], text=names["text"], source=names["source"]).where("copies > 0")
    return restored(taken.select(*names.values(), F.explode(F.sequence(F.lit(1), F.col("copies")))), names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of each document's copies, a row for each row.

    Null and empty texts have no tokens. Other columns are not read. An empty table gives no rows.
    """
    return pieces.encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing", mixed),
    ("SentencePiece", tokens),
]
#: Networks, rounded rates and segmentations have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages documents are a written table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
