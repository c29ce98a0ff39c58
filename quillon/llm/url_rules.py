"""URL filter by association rules. DataFrame functions and Spark's FP-growth only.

Given rules (host and path beginnings) judge the URLs they fit, the longest one deciding. These verdicts are the labels from
which the rest is learned: a URL is a set of tokens of its host, path and query, FP-growth finds the token combinations
that are frequent with a label, and those with enough support and confidence become rules. They are held as an
inverted index, each under its rarest token; a URL looks its tokens up there and takes the surest rule whose
tokens it holds in full. The index is one row, bounded as said at Mining, so that judging needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import ascii_lower
from .scratch import Scratch

#: The rules of the query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
VERDICTS = ("allow", "block")


@dataclass(frozen=True)
class Mining:
    """Bounds of learning. ``rows`` labelled URLs at most, those of the smallest hash (about); ``vocabulary`` tokens that tell the labels apart
    best, and of a URL its ``width`` best of them, so that there are no more than 2^width / support rules; support as a share of
    the labelled URLs and as their least number; least confidence; buckets of the index."""

    rows: int = 1_000_000
    vocabulary: int = 4096
    width: int = 8
    support: float = 0.01
    least: int = 5
    confidence: float = 0.8
    buckets: int = 1024


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty of null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule (verdict, host and path as one text) that fits, as a struct of length, rule and verdict; null if none does.

    A rule fits its host and all hosts below it whose path starts with its path. Of one rule with both verdicts block holds.
    """
    fits = []
    for verdict, rule in rules:
        domain, slash, below = rule.partition("/")
        fit = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + below)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: the top domain, words of the host before it, segments of the path with digits as #, keys of the query."""
    names = F.split(host, r"\.")
    top = F.concat(F.lit("top:"), F.element_at(names, -1))
    words = F.transform(F.split(F.regexp_replace(host, r"\.?[^.]*$", ""), "[^a-z0-9]+"), lambda w: F.concat(F.lit("host:"), w))
    segments = F.transform(F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", "#"), "/"), lambda s: F.concat(F.lit("path:"), s))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda k: F.concat(F.lit("key:"), F.regexp_extract(k, r"(?s)^([^=]*)", 1)))
    return F.array_distinct(F.filter(F.concat(F.array(top), words, segments, keys), lambda t: ~t.endswith(":")))


def index_of(entries: DataFrame, buckets: int) -> DataFrame:
    """One row with one array, index: at the place of a token's hash the entries (structs with a field ``token``) of all tokens with that hash."""
    each = entries.groupBy(F.pmod(F.xxhash64(F.col("entry.token")), F.lit(buckets)).cast("int").alias("bucket")).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    every = entries.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(each, "bucket", "left")
    held = every.agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("entries", F.array().cast(each.schema["entries"].dataType)).alias("entries")))).alias("s"))
    return held.select(F.transform("s", lambda b: b["entries"]).alias("index"))


def look_up(index: Column, token: Column, buckets: int) -> Column:
    return F.filter(F.get(index, F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")), lambda e: e["token"] == token)


def with_index(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows with the one row of the index beside each."""
    return rows.join(F.broadcast(index))


def mined_rules(labelled: DataFrame, mining: Mining, scratch: Scratch) -> DataFrame:
    """(antecedent, verdict, confidence, support, rows) from (tokens, verdict) of labelled URLs: whoever holds all tokens of the antecedent has that verdict."""
    stats = labelled.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]).first()
    total = sum(stats)
    if not total:
        return labelled.limit(0).select(F.col("tokens").alias("antecedent"), "verdict", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"), F.lit(0).cast("long").alias("rows"))
    each = labelled.select(F.explode("tokens").alias("token"), "verdict").groupBy("token").agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    # How far a token's share of the allowed is from its share of the blocked; in whole numbers, so that ties are ties.
    apart = F.abs(F.col("allow") * F.lit(stats.block).cast("decimal(19,0)") - F.col("block") * F.lit(stats.allow).cast("decimal(19,0)"))
    usual = each.where(F.col("n") >= F.lit(mining.support) * total).select("token", apart.alias("apart")).orderBy(F.desc("apart"), "token").limit(mining.vocabulary)
    vocabulary = index_of(usual.select(F.struct("token", "apart").alias("entry")), mining.buckets)
    known = F.flatten(F.transform("tokens", lambda t: look_up(F.col("index"), t, mining.buckets)))
    best = F.slice(F.array_sort(F.transform(known, lambda e: F.struct((-e["apart"]).alias("a"), e["token"].alias("t")))), 1, mining.width)
    items = with_index(labelled, vocabulary).select(F.concat(F.transform(best, lambda e: e["t"]), F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    items = scratch.table(items, "transactions")
    found = FPGrowth(itemsCol="items", minSupport=mining.support, minConfidence=mining.confidence).fit(items).associationRules
    verdict = F.get("consequent", F.lit(0))
    rules = found.where(verdict.startswith("=")).where(~F.exists("antecedent", lambda t: t.startswith("=")))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(verdict, 2, 9).alias("verdict"), "confidence", "support", F.round(F.col("support") * total).cast("long").alias("rows"))
    return scratch.table(rules.where(F.col("rows") >= mining.least), "rules")


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, mining: Mining = Mining(), default: str = "allow", url: str = "url") -> DataFrame:
    """The rows of pages with host, path, rule, verdict, learned (tokens of the mined rule that decided) and confidence.

    ``rule`` is the given rule that fits, else null; ``verdict`` is that rule's, else that of the mined rule of the highest confidence,
    then support, then number of tokens (block before allow, then the smallest tokens, if all are alike), else ``default``. A null URL
    and one without :// have an empty host and path. URLs may be of any length; repeated rows are judged alike and
    learned from as often as they occur. Columns of pages with the names of the results are replaced; no rows give none.
    """
    scratch = Scratch(pages.sparkSession, "url-rules")
    names = ("host", "path", "rule", "verdict", "learned", "confidence")
    kept = [c for c in pages.columns if c not in names]
    rows = pages.select(F.struct(*[pages[c] for c in kept] or [F.lit(0).alias("none")]).alias("row"), pages[url].alias("url"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    rows = rows.select("*", given_rule(F.col("host"), F.col("path"), rules).alias("given"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    labelled = rows.where("given is not null")
    number = labelled.count()
    if number > mining.rows:
        share = int((1 << 32) * (mining.rows / number))
        labelled = labelled.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 32)) < share)
    # Written, as learning goes over them several times.
    labelled = scratch.table(labelled.select("tokens", F.col("given.verdict").alias("verdict")), "labelled")
    learned = mined_rules(labelled, mining, scratch)
    scratch.drop("labelled", "transactions")
    # A rule lies under its rarest token: the one with the fewest rows among all rules of one token, the smallest of equals.
    single = learned.where(F.size("antecedent") == 1).groupBy(F.get("antecedent", F.lit(0)).alias("token")).agg(F.sum("rows").alias("n"))
    each = learned.select("*", F.explode("antecedent").alias("token")).join(single, "token", "left").groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct(F.coalesce("n", F.lit(1 << 62)).alias("n"), "token")).alias("rarest"))
    place = F.struct(F.col("rarest.token").alias("token"), "confidence", "support", F.size("antecedent").alias("size"), "verdict", "antecedent")
    index = index_of(each.select(place.alias("entry")), mining.buckets)
    hits = F.flatten(F.transform("tokens", lambda t: look_up(F.col("index"), t, mining.buckets)))
    full = F.filter(hits, lambda r: F.forall(r["antecedent"], lambda t: F.array_contains("tokens", t)))
    order = lambda r: F.struct((-r["confidence"]).alias("c"), (-r["support"]).alias("s"), (-r["size"]).alias("n"), (r["verdict"] != "block").alias("v"), r["antecedent"].alias("a"), r["verdict"].alias("verdict"))
    best = F.when(F.col("given").isNull(), F.array_min(F.transform(full, order)))
    found = with_index(rows, index).select("row", "host", "path", "given", best.alias("best"))
    return found.select(
        *[F.col("row")[c].alias(c) for c in kept], "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.a").alias("learned"), (-F.col("best.c")).alias("confidence"),
    )


def op13_url_rules(spark, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "confidence")


ORACLE = r"""
WITH r(verdict, rule, domain, below) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
p AS (
  SELECT row_number() OVER () AS i, page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), g AS (
  SELECT p.*, f.rule, f.verdict AS given FROM p LEFT JOIN (
    SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, below) GROUP BY i) f USING (i)
), t AS (
  SELECT *, list_distinct(list_filter(list_concat(['top:' || string_split(host, '.')[-1]], list_transform(regexp_split_to_array(regexp_replace(host, '\.?[^.]*$', ''), '[^a-z0-9]+'), lambda x: 'host:' || x),
    list_transform(string_split(regexp_replace(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '#', 'g'), '/'), lambda x: 'path:' || x),
    list_transform(string_split(coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: 'key:' || string_split(x, '=')[1])), lambda x: NOT ends_with(x, ':'))) AS tokens FROM g
), n AS (SELECT count(*) FILTER (given = 'allow') AS a, count(*) FILTER (given = 'block') AS b, count(given) AS total FROM g),
each AS (SELECT token, count(*) AS n, count(*) FILTER (given = 'allow') AS ta, count(*) FILTER (given = 'block') AS tb FROM (SELECT unnest(tokens) AS token, given FROM t WHERE given IS NOT NULL) GROUP BY 1),
usual AS (SELECT token, abs(ta * b - tb * a) AS apart FROM each, n WHERE each.n >= 0.01::DOUBLE * total ORDER BY apart DESC, token LIMIT 4096),
items AS (
  SELECT i, given, list(token ORDER BY apart DESC, token)[1:8] AS items FROM (SELECT i, given, unnest(tokens) AS token FROM t WHERE given IS NOT NULL) JOIN usual USING (token) GROUP BY i, given
), sets AS (
  SELECT list_sort(list_filter(items, lambda x, k: (mask >> (k - 1)) & 1 = 1)) AS s, given FROM (SELECT *, unnest(range(1, CAST(1 << len(items) AS BIGINT))) AS mask FROM items)
), counted AS (SELECT s, count(*) AS n, unnest(['allow', 'block']) AS verdict, unnest([count(*) FILTER (given = 'allow'), count(*) FILTER (given = 'block')]) AS u FROM sets GROUP BY s),
rules AS (SELECT s, verdict, u::DOUBLE / counted.n::DOUBLE AS confidence, u::DOUBLE / total::DOUBLE AS support FROM counted, n WHERE u >= ceil(0.01::DOUBLE * total) AND u >= 5 AND u::DOUBLE / counted.n::DOUBLE >= 0.8::DOUBLE),
best AS (
  SELECT i, x.verdict, x.confidence FROM (SELECT t.i, list(rules ORDER BY confidence DESC, support DESC, len(s) DESC, rules.verdict DESC, s)[1] AS x FROM t JOIN rules ON list_has_all(tokens, s) WHERE given IS NULL GROUP BY t.i)
)
SELECT page_id, host, path, rule, coalesce(given, best.verdict, 'allow') AS verdict, best.confidence FROM t LEFT JOIN best USING (i)
"""
