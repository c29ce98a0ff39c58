"""Mixing sources to target weights by entropy balancing.

Every word of a document carries the document's rate. The rates r minimise the relative entropy of the mix to
the corpus, sum of size * (r log r - r) with r at most the cap, under token constraints of two kinds: for each source, that its words
come to its target; and across sources, for each size class of documents (powers of two), that its share of the mix stays near its share of
the corpus (near: at the price of a quadratic penalty, as not all can be met together). The solution tilts exponentially,
r = min(cap, exp(lambda of the source + mu of the class)), and the convex dual has those multipliers as variables.

Newton's method solves it. For given mu the dual's best lambda of each source is found in its own row, as sources share no constraint with each other but through mu; gradient and Hessian
of what remains (the Schur complement, full, since classes meet in every source) are sums over sources of sums over documents, which
one Spark aggregate a step brings together. The driver sees vectors as long as there are classes, and solves for the step.
Rates then become whole copies: floor(r) of every document of a source and class and one more of a part of them, so chosen that each source's words come to its target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillon.operators.numbering import numbered

from .scratch import Scratch

#: Price of a class's share away from the corpus's, as a part of its words, and the steps of Newton's method at most.
PENALTY, STEPS = 0.1, 40
#: Hash buckets within a size class of a source, a bound on the rows that choose the extra copies.
BUCKETS = 4096


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float, scratch: Scratch) -> DataFrame:
    """(source, source_size, cells, target) from (source, cls, size), a row for each source; cells: its words by size class.

    Sources in code-point order, null last, take the weights in turn; together they share the sum of all
    sizes. A target stops at ``cap`` times its source's size, and the others share the excess by weight until
    none is above. The driver sees sums over sources, a row a round.
    """
    by_class = sizes.groupBy("source", "cls").agg(F.sum("size").alias("size"))
    by_source = scratch.table(by_class.groupBy("source").agg(F.sum("size").alias("source_size"), F.collect_list(F.struct("cls", F.col("size").cast("double").alias("size"))).alias("cells")), "by-source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = numbered(by_source, [F.col("source").isNull(), "source"], "i").withColumn("w", weight).withColumn("most", cap * F.col("source_size").cast("double"))
    ranked = scratch.table(ranked.select("source", "source_size", "cells", "w", "most"), "weights")
    level, stopped = 0.0, -1
    while True:
        stops = F.col("most") < F.lit(level) * F.col("w")
        sums = ranked.agg(F.sum("source_size").alias("total"), F.sum(F.when(stops, F.col("most"))).alias("held"), F.sum(F.when(~stops, F.col("w"))).alias("free"), F.count_if(stops).alias("stopped")).first()
        if sums.stopped == stopped or not sums.free:
            break
        level, stopped = (sums.total - (sums.held or 0.0)) / sums.free, sums.stopped
    share = F.least("most", F.lit(level) * F.col("w")) if sums.free else F.col("most")
    return ranked.select("source", "source_size", "cells", share.alias("target"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def tilt_of_source(mu: np.ndarray, cap: float, halvings: int = 60) -> Column:
    """lambda of a row (sizes by class, target) for given mu: where the source's words, min(cap, exp(lambda + mu)) of each class's, come to its target."""
    held = F.array(*[F.lit(float(x)) for x in mu])
    words = lambda lam: _total(F.zip_with("sizes", held, lambda n, m: n * F.least(F.lit(float(cap)), F.exp(lam + m))))
    low = F.log(F.col("target") / _total(F.col("sizes"))) - float(mu.max())
    high = F.lit(float(np.log(cap) - mu.min()))

    def halve(ends: Column, _: Column) -> Column:
        middle = (ends["low"] + ends["high"]) / 2
        below = words(middle) < F.col("target")
        return F.struct(F.when(below, middle).otherwise(ends["low"]).alias("low"), F.when(below, ends["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(low.alias("low"), high.alias("high")), halve)
    return (found["low"] + found["high"]) / 2


def dual(rows: DataFrame, mu: np.ndarray, cap: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian of the sources' part of the dual in mu, each source's lambda being the best for it; one aggregate over (sizes, target)."""
    k, top = len(mu), float(np.log(cap))
    held = F.array(*[F.lit(float(x)) for x in mu])
    each = rows.select("sizes", "target", tilt_of_source(mu, cap).alias("lam"))
    tilt = F.transform(held, lambda m: F.col("lam") + m)
    each = each.select("sizes", "target", "lam", tilt.alias("tilt"))
    each = each.select(
        "*", F.zip_with("sizes", "tilt", lambda n, t: n * F.least(F.lit(float(cap)), F.exp(t))).alias("mass"), F.zip_with("sizes", "tilt", lambda n, t: F.when(t < top, n * F.exp(t)).otherwise(0.0)).alias("bends"),
        F.zip_with("sizes", "tilt", lambda n, t: n * F.when(t < top, F.exp(t)).otherwise(cap * (t - top) + cap)).alias("paid"),
    )
    each = each.withColumn("bend", F.greatest(_total(F.col("bends")), F.lit(1e-300)))
    places = F.sequence(F.lit(0), F.lit(k - 1))
    hessian = F.flatten(F.transform(places, lambda i: F.transform(places, lambda j: F.when(i == j, F.get("bends", i)).otherwise(0.0) - F.get("bends", i) * (F.get("bends", j) / F.col("bend")))))
    value = _total(F.col("paid")) - F.col("target") * F.col("lam")
    vector = array_to_vector(F.concat(F.array(value), F.col("mass"), hessian))
    sums = each.agg(Summarizer.sum(vector).alias("sums")).first().sums.toArray()
    return float(sums[0]), sums[1 : k + 1], sums[k + 1 :].reshape(k, k)


def balanced_classes(rows: DataFrame, goal: np.ndarray, cap: float, penalty: float = PENALTY) -> np.ndarray:
    """mu at the minimum of the dual: Newton's method with steps halved until the value falls."""
    price = penalty * np.maximum(goal, 1.0)

    def at(mu: np.ndarray):
        value, gradient, hessian = dual(rows, mu, cap)
        return value - goal @ mu + price @ mu**2 / 2, gradient - goal + price * mu, hessian + np.diag(price)

    mu = np.zeros(len(goal))
    value, gradient, hessian = at(mu)
    for _ in range(STEPS):
        if np.abs(gradient).max() <= 1e-7 * max(goal.sum(), 1.0):
            break
        step = -np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        while True:
            found = at(mu + step)
            if found[0] <= value or np.abs(step).max() < 1e-9:
                break
            step /= 2
        mu, (value, gradient, hessian) = mu + step, found
    return mu


def balance(targets: DataFrame, cap: float, scratch: Scratch) -> DataFrame:
    """The rows of targets with ``rates``, one for each size class from 0 up.

    A source whose target is ``cap`` times its size has that rate throughout, one with a target of 0 the rate 0, and one without words 1.
    """
    bounds = targets.select(F.max(F.array_max(F.transform("cells", lambda c: c["cls"]))).alias("top")).first()
    k = max(int(bounds.top if bounds.top is not None else 0), 0) + 1
    size = lambda i: F.coalesce(F.get(F.filter("cells", lambda c: c["cls"] == i), F.lit(0))["size"], F.lit(0.0))
    sized = targets.withColumn("sizes", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), size))
    open_ = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    sized = scratch.table(sized.withColumn("free", open_), "balance")
    free = sized.where("free").select("sizes", "target")
    mu = np.zeros(k)
    if not free.isEmpty():
        sums = free.agg(Summarizer.sum(array_to_vector(F.concat(F.array("target"), "sizes"))).alias("sums")).first().sums.toArray()
        mu = balanced_classes(free, sums[0] * sums[1:] / sums[1:].sum(), cap)
    held = F.array(*[F.lit(float(x)) for x in mu])
    tilted = F.transform(held, lambda m: F.least(F.lit(float(cap)), F.exp(tilt_of_source(mu, cap) + m)))
    fixed = F.when(F.col("source_size") <= 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.lit(float(cap)))
    return sized.select("source", "source_size", "target", F.when(F.col("free"), tilted).otherwise(F.transform("sizes", lambda _: fixed)).alias("rates"))


def _cuts(cap: int):
    def cuts(hist: pd.DataFrame) -> pd.DataFrame:
        """For each size class of one source how many copies all documents have, and how many hash buckets one more; what a class leaves open passes to the next smaller one."""
        out, carry = [], 0.0
        for cls, rows in sorted(hist.groupby("cls"), key=lambda x: -x[0]):
            rate = float(rows.rate.iat[0])
            mass = np.zeros(BUCKETS + 1)
            mass[rows.bucket.to_numpy() + 1] = rows["size"].to_numpy()
            mass = np.cumsum(mass)
            want = rate * mass[-1] + carry
            held = min(max(want, 0.0), cap * mass[-1])
            whole = min(int(held / mass[-1]), cap)
            cut = int(np.argmin(np.abs(mass - (held - whole * mass[-1])))) if whole < cap else 0
            carry = want - whole * mass[-1] - mass[cut]
            out.append((cls, whole, cut))
        return pd.DataFrame({"source": [hist.source.iat[0]] * len(out), **{n: [x[i] for x in out] for i, n in enumerate(("cls", "whole", "cut"))}})

    return cuts


def copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", sizes: str | None = None) -> DataFrame:
    """The rows of docs with columns size, source_size, target, rate and copies.

    ``size`` is the number of runs of characters other than white space (null text: 0), counted twice over; a caller that has the sizes names
    their column instead, and no text is read. ``cap`` is a whole number. Rates are rounded to
    copies by size class (powers of two) of a source: all documents of a class have the same copies, and those
    whose hash falls below the class's cut one more. Classes follow from the largest down; what a class can't
    round passes to the next smaller one, so that a source's words come to its target within about half a
    bucket of its smallest class (unless single documents outweigh the target). Copies never exceed ``cap``,
    and reruns give the same.
    Columns of docs with these names are replaced. A source that is null is a source of its own. Documents of size 0 count one copy (their source's words
    do not change). Rows that repeat a doc_id share a hash. A table without rows gives none.
    """
    if cap != int(cap) or cap < 1:
        raise ValueError("cap is a whole number of copies")
    scratch = Scratch(docs.sparkSession, "mixing")
    words = F.coalesce(docs[sizes], F.lit(0)).cast("long") if sizes else n_words(docs[text])
    names = ("size", "source_size", "target", "rate", "copies")
    sized = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c not in names] or [docs[doc_id]]).alias("row"),
        docs[source].alias("source"), words.alias("size"), F.pmod(F.xxhash64(docs[doc_id]), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    sized = sized.withColumn("cls", F.when(F.col("size") > 0, F.floor(F.log2("size")).cast("int")).otherwise(-1))
    hist = scratch.table(sized.groupBy("source", "cls", "bucket").agg(F.sum("size").alias("size")), "sizes")
    rates = scratch.table(balance(source_targets(hist, weights, cap, scratch), cap, scratch), "rates").withColumnRenamed("source", "s")
    rate = F.when(F.col("cls") >= 0, F.get("rates", F.col("cls"))).otherwise(F.lit(1.0)).alias("rate")
    by_class = hist.join(rates, F.col("source").eqNullSafe(F.col("s"))).select("source", "cls", "bucket", "size", rate).where("cls >= 0")
    cuts = by_class.groupBy("source").applyInPandas(_cuts(int(cap)), hist.select("source").schema.add("cls", IntegerType()).add("whole", IntegerType()).add("cut", IntegerType()))
    every = hist.select("source", "cls").distinct().join(rates, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate)
    cuts = cuts.select(F.col("source").alias("c_source"), F.col("cls").alias("c_cls"), "whole", "cut")
    every = every.join(cuts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cls") == F.col("c_cls")), "left")
    every = scratch.table(every.select("s", F.col("cls").alias("s_cls"), "source_size", "target", "rate", "whole", "cut"), "cuts")
    scratch.drop("sizes", "by-source", "weights", "balance", "rates")
    found = sized.join(every, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("s_cls")), "left")
    extra = F.when(F.col("bucket") < F.col("cut"), F.lit(1)).otherwise(F.lit(0))
    number = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + extra)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in names], "size", "source_size", "target", "rate", number.cast("long").alias("copies"))


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Written: each text is cut into words once.
    sized = Scratch(spark, "sizes").table(docs.select("doc_id", "source", n_words(F.col("text")).alias("n_words")), "documents")
    mixed = copies(sized, sizes="n_words")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
