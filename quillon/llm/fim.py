"""Fill-in-middle transformation: documents cut in three at unit ranks and put together anew, in constant memory.

A unit is a run of characters other than white space with the white space before it; white space at the end is a
unit too. A lazy iterator matches units from left to right. The first pass over a text counts them, which gives the two
ranks at which it is cut; the second pass advances a fresh iterator to the smaller rank and on to the larger, and
keeps the places where it stands. Units themselves are never stored, so a text of any length costs the text and what
is made of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T

UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
#: Sentinels before prefix, suffix and middle; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
#: Bytes of text that a worker holds as Python strings at a time (or one text).
CHUNK = 1 << 20
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def count_units(text: str) -> int:
    n = 0
    for n, _ in enumerate(UNIT.finditer(text), 1):
        pass
    return n


def cut_places(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first ``first`` units end and where the first ``second`` (not fewer) do, in code points."""
    units, places, at, passed = UNIT.finditer(text), [], 0, 0
    for rank in (first, second):
        if rank > passed:
            at = next(islice(units, rank - passed - 1, None)).end()
            passed = rank
        places.append(at)
    return places[0], places[1]


def transformed(text: str, h: tuple[int, int, int, int] | None, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """RESULTS of one text, from the four numbers drawn for its document; without numbers it stays plain."""
    n = count_units(text)
    if h is None or not text or h[2] % 100 >= percent or re.search(SENTINEL, text):
        return n, "plain", None, None, text
    a, b = cut_places(text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 of a document, from the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with n (units), form, prefix_chars, middle_chars (code points; null if plain) and output.

    Of the texts ``percent`` in a hundred are transformed, ``spm_percent`` in a hundred of these with the suffix first (spm), the
    others with the prefix first (psm). Null texts count as empty; empty texts, texts that hold a sentinel and rows
    without a doc_id stay plain, with the text (null: empty) as output. Rows that repeat a doc_id share its numbers and
    are cut each by its own units. Columns of docs with the names of the results are replaced. No rows give none.
    """
    kept = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(kept)], docs[text].alias("text"), *[d.alias(f"h{i}") for i, d in enumerate(draws(docs[doc_id], seed))])
    passed = [f"c{i}" for i in range(len(kept))]
    schema = rows.select(*passed).schema
    for name, kind in zip(RESULTS, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, limit=CHUNK):
            numbers = zip(*(batch.column(f"h{i}").to_pylist() for i in range(4)))
            found = [transformed(t.as_py() or "", None if h[0] is None else h, percent, spm_percent) for t, h in zip(batch.column("text"), numbers)]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            new = [pa.array(column, kind) for column, kind in zip(zip(*found), types)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in passed] + new, [*passed, *RESULTS])

    made = rows.mapInArrow(run, schema)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *RESULTS)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. Its parts hold no sentinel, so that the three put in are the only ones."""
    part = lambda i: F.get(F.split(output, SENTINEL, -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS x FROM documents
), drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS UBIGINT) AS h1, CAST('0x' || x[9:16] AS UBIGINT) AS h2, CAST('0x' || x[17:24] AS UBIGINT) AS h3, CAST('0x' || x[25:32] AS UBIGINT) AS h4 FROM cut
), parts AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m, array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""
