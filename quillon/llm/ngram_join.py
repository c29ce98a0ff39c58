"""N-gram Jaccard join by prefix filtering under several global token orders.

A document is the set of its k-word shingles (64-bit hashes). If two sets reach Jaccard similarity t, then
under any global order of tokens the first n - ceil(t n) + 1 tokens of both (n: each one's size) share a
token.

The first order puts a fixed range of hashes, a few times wider than a prefix, before all other tokens and
the unique tokens of that range first. No two documents share a unique token, so a document with a prefix of
such tokens has no candidates. Among the documents left, the second order sorts all tokens by their exact
document frequency, rarest first; again unique tokens fill prefixes without giving candidates, and what a
prefix still takes of others is listed. Pairs that share a listed token must share one under a third and a
fourth order (by hash) as well; only then are the whole sets compared.

Copies are joined as one class, by their set, and classes are what is compared; doc_ids come in again at the end. Within the documents that share a token no list of all pairs
is made: each is compared with three leaders of that token, the links found so far are merged into
components, and only documents of different components are compared further. That finds the components of
all links, since a link within a component adds nothing to it. What two such documents must pass first is a
comparison of a few words of bits: a token flips one bit of its document's, so that bits in which two documents
differ are a lower bound of the tokens that only one of them has. Texts made of the same blocks, which share
tokens under any order, part there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .graph import components
from .scratch import Scratch

#: Bytes of text that are hashed at a time, and the bits of the filter of candidate documents (2 MB).
CHUNK, BLOOM_BITS = 1 << 20, 24
#: The range of hashes whose frequencies are counted, as a multiple of a prefix's share of a set.
RANGE = 1.75
#: Words of 64 bits in which each token flips one bit.
BIT_WORDS = 8
BITS = [f"bits{i}" for i in range(BIT_WORDS)]
_ORDERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    data, offsets = T.text_buffer(batch.column("text"))
    start, end, first = T.words(data, offsets, T.NOT_SPACE)
    hashes = T.word_hashes(data, start, end)
    return [T.shingle_set(hashes[first[i] : first[i + 1]], k) for i in range(batch.num_rows)]


def set_name(tokens: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of hash of a set."""
    return T.splitmix(tokens).sum(dtype=T.U), T.splitmix(tokens ^ T.U(0x5851F42D4C957F2D)).sum(dtype=T.U)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def low_tokens(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """For each row doc_id, n (size of its set), h1 and h2 (a hash of the set) and low: its tokens in the first order's range."""
    limit = np.uint64(min(1.0, RANGE * (1 - percent / 100)) * (2**64 - 2**12))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, limit=CHUNK):
            low, rows = [], []
            for own in _sets(batch, k):
                low.append(own[: int(np.searchsorted(own, limit))])
                rows.append((len(own), *set_name(own)))
            n, h1, h2 = (pa.array(T.int64(np.array(x, T.U))) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, h1, h2, T.list_column(np.concatenate(low), [len(x) for x in low])], ["doc_id", "n", "h1", "h2", "low"])

    return docs.mapInArrow(lowest, "doc_id long, n long, h1 long, h2 long, low array<long>")


def prefix_length(percent: int) -> Column:
    return (F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1).cast("int")


def set_classes(table: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each different set: cid (a number of its own), h1, h2, rep (its smallest doc_id), n and low.

    What follows knows sets by cid alone, so that rows which share a doc_id can't be taken for one another.
    """
    each = table.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("low").alias("low"))
    # Numbers are fixed by being written: each task that is committed has a range of its own.
    return scratch.table(each.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")


def first_order(classes: DataFrame, percent: int) -> DataFrame:
    """(cid, h1, h2, rep) of the classes whose prefix under the first order isn't of unique tokens alone."""
    held = classes.select("cid", F.explode("low").alias("token")).groupBy("token").agg(F.count("*").alias("df"), F.min("cid").alias("cid"))
    unique = held.where("df = 1").groupBy("cid").agg(F.count("*").alias("unique"))
    every = classes.select("cid", "h1", "h2", "rep", prefix_length(percent).alias("p"))
    return every.join(unique, "cid", "left").where(F.coalesce("unique", F.lit(0)) < F.col("p")).select("cid", "h1", "h2", "rep")


def second_order(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(cid, n, unique, take, ranks): of each class that lists tokens the number of its unique tokens, and the places in the order of the others in its prefix.

    A place is the document frequency, up to 32767, before 48 bits of the token, in one long.
    """
    every = sets.select("cid", F.explode("tokens").alias("token"))
    shared = scratch.table(every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    rank = F.shiftleft(F.least("df", F.lit(32767)).cast("long"), 48).bitwiseOR(F.shiftrightunsigned("token", 16)).alias("rank")
    found = every.join(shared.hint("shuffle_hash"), "token").select("cid", rank).groupBy("cid").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    each = sets.select("cid", "n", prefix_length(percent).alias("p")).join(found, "cid").withColumn("unique", F.col("n") - F.size("ranks"))
    each = each.withColumn("take", (F.col("p") - F.col("unique")).cast("int")).where("take > 0")
    return each.select("cid", "n", "unique", "take", F.slice("ranks", F.lit(1), F.col("take")).alias("ranks"))


def few_bits_differ(percent: int) -> Column:
    """Whether the bits of rows x and y differ in no more places than so similar sets have tokens that only one holds."""
    differ = sum(F.bit_count(F.col(f"bits{i}_x").bitwiseXOR(F.col(f"bits{i}_y"))) for i in range(BIT_WORDS))
    # A union of u and an intersection of t u at least differ by (1 - t) / (1 + t) of both sizes at most.
    return (100 + percent) * differ <= (100 - percent) * (F.col("n_x") + F.col("n_y"))


def flipped_bits(tokens: np.ndarray) -> np.ndarray:
    """BIT_WORDS words: a bit is set if an odd number of tokens fall on it."""
    odd = np.bincount((T.splitmix(tokens ^ _ORDERS[0]) % np.uint64(64 * BIT_WORDS)).astype(np.int64), minlength=64 * BIT_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2^BLOOM_BITS bits in which each rep has its own two: all that reaches the driver, however many there are."""
    word = F.explode(F.array(F.xxhash64(F.lit(1), "rep"), F.xxhash64(F.lit(2), "rep"))).alias("h")
    places = ids.select(word).select(F.col("h").bitwiseAND((1 << BLOOM_BITS) - 1).alias("h"))
    words = places.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.bits
    return out


def _candidates(docs: DataFrame, left: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Of the classes in ``left`` (cid, h1, h2, rep) the whole set, and its prefixes under the other orders, a row each. A Bloom filter of their reps spares the texts of most other rows."""
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(left))
    place = lambda seed: F.xxhash64(F.lit(seed), "doc_id").bitwiseAND((1 << BLOOM_BITS) - 1)

    def prefix(tokens: np.ndarray, order: np.uint64) -> np.ndarray:
        p = prefix_size(len(tokens), percent)
        return tokens[np.argpartition(T.splitmix(tokens ^ order), p - 1)[:p]] if len(tokens) > p else tokens

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = bits.value
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            batch = batch.filter(pa.array(((bloom[a >> 6] >> (a & 63)) & (bloom[b >> 6] >> (b & 63)) & 1) == 1))
            for part in T.chunks(iter([batch]), limit=CHUNK):
                own = _sets(part, k)
                lists = [own, *([prefix(x, order) for x in own] for order in _ORDERS)]
                words = np.stack([flipped_bits(x) for x in own], axis=1)
                names = [pa.array(T.int64(np.array(x, T.U))) for x in zip(*map(set_name, own))]
                columns = [part.column("doc_id"), *names, pa.array([len(x) for x in own], pa.int64()), *(T.list_column(np.concatenate(x), [len(y) for y in x]) for x in lists), *(pa.array(w) for w in words)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "n", "tokens", "p2", "p3", *BITS])

    found = docs.select("doc_id", "text", place(1).alias("a"), place(2).alias("b")).mapInArrow(sets, "doc_id long, h1 long, h2 long, n long, tokens array<long>, p2 array<long>, p3 array<long>, " + ", ".join(f"{b} long" for b in BITS))
    # Of a class the rows of its rep, one but for rows that repeat both a doc_id and its text.
    found = scratch.table(found.join(left, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "rep", "h1", "h2"), "sets")
    if found.groupBy("cid").count().where("count > 1").isEmpty():
        return found
    once = scratch.table(found.dropDuplicates(["cid"]), "sets-once")
    scratch.drop("sets")
    return once


def _links(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Of candidate pairs (u, v) those that share prefix tokens under the other orders and are as similar as asked."""
    of = lambda x, *columns: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    near = pairs.join(of("u", "p2", "p3"), "u").join(of("v", "p2", "p3"), "v")
    near = near.where((100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & F.arrays_overlap("p2_u", "p2_v") & F.arrays_overlap("p3_u", "p3_v"))
    near = scratch.table(near.select("u", "v"), f"{name}-near")
    shared = near.join(of("u", "tokens"), "u").join(of("v", "tokens"), "v").select("u", "v", F.size(F.array_intersect("tokens_u", "tokens_v")).alias("both"), (F.col("n_u") + F.col("n_v")).alias("sizes"))
    links = scratch.table(shared.where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("u", "v"), f"{name}-links")
    scratch.drop(f"{name}-near")
    return links


def class_links(docs: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v) of classes: links enough to connect all that are linked."""
    left = scratch.table(first_order(classes, percent), "left")
    sets = _candidates(docs, left, k, percent, scratch)
    orders = scratch.table(second_order(sets, percent, scratch), "orders")
    listed = scratch.table(orders.select("cid", "take", F.explode("ranks").alias("token")), "prefixes")
    leads = listed.groupBy("token").agg(F.count("*").alias("m"), F.min("cid").alias("a"), F.max("cid").alias("b"), F.max_by("cid", "take").alias("c")).where("m > 1")
    shared = scratch.table(listed.drop("take").join(leads, "token"), "shared")
    scratch.drop("prefixes", "frequencies", "left")
    stars = shared.select("cid", F.explode(F.array("a", "b", "c")).alias("lead")).where("cid != lead")
    stars = stars.select(F.least("cid", "lead").alias("u"), F.greatest("cid", "lead").alias("v")).distinct()
    first = _links(stars, sets, percent, scratch, "stars")
    merged = components(first, scratch, "first")

    rest = shared.where("m > 3 and cid not in (a, b, c)").select("token", "cid")
    known = merged.select(F.col("node").alias("cid"), F.col("component"))
    rest = rest.join(known, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    parts = rest.groupBy("token", "component").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("component", "c").alias("main")).where("parts > 1")
    begin = orders.select("cid", "n", "unique").join(sets.select("cid", *BITS), "cid")
    rest = scratch.table(rest.join(mixed.select("token", "main"), "token").join(begin, "cid"), "rest")
    scratch.drop("shared")
    if rest.isEmpty():
        return first
    side = lambda c: [F.col(n).alias(f"{n}_{c}") for n in ("cid", "component", "n", "unique", *BITS)]
    x = rest.where("component != main").select("token", *side("x"))
    y = rest.select("token", "main", *side("y"))
    cross = x.join(y, "token").where("component_x != component_y and (component_y = main or cid_x < cid_y)")
    few = lambda c: (100 + percent) * (F.col(f"n_{c}") - F.col(f"unique_{c}")) >= percent * (F.col("n_x") + F.col("n_y"))  # noqa: E731  tokens that no other document has aren't in the intersection
    cross = cross.where((100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & few("x") & few("y") & few_bits_differ(percent))
    cross = cross.select(F.least("cid_x", "cid_y").alias("u"), F.greatest("cid_x", "cid_y").alias("v")).distinct()
    second = _links(cross, sets, percent, scratch, "cross")
    scratch.drop("rest", "sets", "sets-once", "orders")
    return first.unionAll(second)


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs doc_id, n_shingles and component_id: the smallest doc_id that links lead to.

    Words are runs of characters other than white space, A-Z lower-cased. A text's set holds its distinct
    k-word shingles; with fewer words the whole sequence as one; a text that is null or has no word has an
    empty set and no links. Texts are linked if 100 * intersection >= percent * union.

    Rows that share a doc_id are one document: each stays a row with its own n_shingles, all have one component_id,
    and links lead on from any of them; one without words gets it too. Rows without a doc_id are linked as others are, but
    their missing doc_id is never a component_id, unless no other is reached. A table without rows gives none; other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = scratch.table(low_tokens(docs, k, percent), "tokens")
    classes = set_classes(table, scratch)
    rows = table.select("doc_id", "n", "h1", "h2")
    links = class_links(docs, classes, k, percent, scratch)

    # The texts of one document, if it has several, are connected through the document.
    named = rows.where("n > 0 and doc_id is not null").select("doc_id", F.struct("h1", "h2").alias("name"))
    several = named.groupBy("doc_id").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a != b").select("doc_id")
    held = named.join(several, "doc_id", "left_semi").distinct().select("doc_id", "name.h1", "name.h2").join(classes.select("cid", "h1", "h2"), ["h1", "h2"])
    through = scratch.table(held.select("doc_id", "cid"), "through")
    through = through.join(through.groupBy("doc_id").agg(F.min("cid").alias("u")), "doc_id").where("cid != u").select("u", F.col("cid").alias("v"))
    final = components(links.unionAll(through), scratch, "final")
    reps = classes.select("cid", "h1", "h2", "rep").join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    reps = scratch.table(reps.select("h1", "h2", "rep", "component"), "of-classes")
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = rows.where("n > 0").join(reps.join(least, "component").select("h1", "h2", "component_id"), ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"))
    # Documents with a text without words and another one with words.
    beside = found.join(bare.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return found.unionAll(bare.join(beside, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.v), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.s
"""
