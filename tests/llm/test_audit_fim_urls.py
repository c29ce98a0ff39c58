"""Filter audit, fill-in-middle and URL rules against plain versions, on odd tables too."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from quillon.llm import filter_audit, fim, url_rules
from quillon.llm.scratch import Scratch

WS = "\x20\x09-\x0d"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(1, 4)))
    every = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(80)]
    every += [rng.choice(every[:5]) for _ in range(40)] + [t.upper() for t in every[5:15]] + [t + rng.choice("#$%&*|") for t in every[15:30]]
    every += [None, "", " ", " \t\n", "\n a", "a\u00a0b é\u2003ß ", "ÀÉ " * 210, "a<P>b", "c <S> d", "<M>", "< P>x", "x " * 100_000, "y" * 70_000, "a a a", "A" + "b" * 32, "A" + "b" * 33, "tail  \x0b\x0c\r"]
    return every


# --- fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(f"[{WS}]*[^{WS}]+|[{WS}]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if doc_id is None or not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, texts):
    rows = [(i, t, 5, "n", "x") for i, t in enumerate(texts)] + [(None, "no id", 5, "n", "x"), (3, "again under an id", 5, "n", "x"), (4, texts[4], 5, "n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, c0 string")
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "c0", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == Counter((i, t, plain_fim(i, t)) for i, t, *_ in rows)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_cuts_at_all_ranks():
    for text in ("", "a", " a", "a ", "a b  c \n"):
        n = fim.count_units(text)
        units = re.findall(f"[{WS}]*[^{WS}]+|[{WS}]+", text)
        assert n == len(units)
        for a in range(n + 1):
            for b in range(a, n + 1):
                assert fim.cut_places(text, a, b) == (len("".join(units[:a])), len("".join(units[:b])))


def test_fill_in_middle_shares_and_names(spark):
    docs = spark.range(400).select(F.col("id").alias("key"), F.lit("one two three four").alias("body"))
    all_spm = fim.fill_in_middle(docs, percent=100, spm_percent=100, doc_id="key", text="body")
    assert {r.form for r in all_spm.collect()} == {"spm"}
    assert fim.fill_in_middle(docs, percent=0, doc_id="key", text="body").where("form = 'plain' and output = body").count() == 400
    assert fim.fill_in_middle(docs.limit(0), doc_id="key", text="body").count() == 0


# --- filter audit


def plain_flags(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(f"[^{WS}]+", t)
        out.append((len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i))
    return out


def plain_audit(rows, good, toxic):
    flags = plain_flags(rows)
    found = {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, r[0]) for f, r in zip(flags, rows) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations(range(5)):
            left, before = own, set()
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                counts = (len(left), len(removed), sum(x[0][f] and any(x[0][g] for g in before) for x in own), sum(x[0][f] and sum(x[0]) == 1 for x in own), sum(x[1] in good for x in removed), sum(x[1] in toxic for x in removed))
                found[part, "".join("ABCDE"[g] for g in order), step] = counts
                shapley["ABCDE"[f]] += len(removed)
                before.add(f)
        for key, counts in found.items():
            if key[0] == part and len(counts) == 6:
                found[key] = (*counts, shapley[key[1][key[2] - 1]])
    return found


def audited(spark, tmp_path, rows, labels):
    spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, kept int, A boolean").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.op11_filter_audit(spark, str(tmp_path)).collect()}


def test_filter_audit(spark, tmp_path, texts):
    rng = random.Random(12)
    rows = [(i, t, rng.choice(["en", "en", "de", None, ""])) for i, t in enumerate(texts)] + [(None, texts[0], "en"), (None, "no id", "fr"), (7, texts[7], "en"), (7, texts[1], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, len(texts), 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = audited(spark, tmp_path, rows, labels)
    assert got == plain_audit(rows, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None})
    assert len(got) == 600 * 4


def test_filter_audit_many_parts_and_one_large_class(spark, tmp_path):
    """More parts than bitsets are held at a time, and a text that most rows share."""
    rows = [(i, "the same" if i % 4 else f"own {i} #", f"part{i % 75}") for i in range(3000)]
    got = audited(spark, tmp_path, rows, [(i, 1, 0) for i in range(0, 3000, 3)])
    flags = plain_flags(rows)
    for part in ("part0", "part37", "part74"):
        own = [f for f, r in zip(flags, rows) if r[2] == part]
        assert got[part, "EDCBA", 1][:2] == (sum(not f[4] for f in own), sum(f[4] for f in own))
        assert got[part, "ADBCE", 5][0] == sum(not any(f) for f in own)
    assert len(got) == 600 * 75


def test_filter_audit_of_nothing(spark, tmp_path):
    assert audited(spark, tmp_path, [], []) == {}


def test_failures_of_text(spark, texts):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    found = filter_audit.failures(spark.createDataFrame(rows, "doc_id long, text string, lang string"), Scratch(spark, "t")).collect()
    assert {r.doc_id: tuple(r[c] for c in "ABCDE") for r in found} == {i: f for (i, *_), f in zip(rows, plain_flags(rows))}


# --- URL rules


def plain_split(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules=url_rules.RULES):
    fits = []
    for verdict, rule in rules:
        domain, _, below = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + below):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme.org/", "http://", "http://ORG/", "http://org", "HTTPS://Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://xexample.org/es/", "http://notorg/", "a://b://com/fr/", "http://com?x=/fr/", "http://m.com/fr/?a=b#c", "http://com/de/#/fr/", "http://com/DE/", "http://a.com/fr", "http://é.com/fr/ü\n/x", "x://com/fr/" + "a/" * 30_000, "http://org/\nes/", "http://a.org#/"]


def test_given_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, verdict string")
    for r in url_rules.judged(pages).collect():
        host, path = plain_split(r.url)
        assert (r.host, r.path) == (host, path), r.url
        rule, verdict = plain_rule(host, path)
        assert r.rule == rule and r.verdict in ("allow", "block")
        assert rule is None or (r.verdict == verdict and r.learned is None)


def plain_tokens(url):
    host, path = plain_split(url)
    names = host.split(".")
    query = re.match(r"[^?#]*\?([^#]*)", url or "", re.S)
    tokens = ["top:" + names[-1]] + ["host:" + w for w in re.split("[^a-z0-9]+", ".".join(names[:-1]))]
    tokens += ["path:" + s for s in re.sub("[0-9]+", "#", "".join(c.lower() if "A" <= c <= "Z" else c for c in path)).split("/")]
    tokens += ["key:" + k.split("=")[0] for k in (query.group(1) if query else "").split("&")]
    return {t for t in tokens if not t.endswith(":")}


def plain_judge(urls, mining):
    """FP-growth's rules by counting every subset."""
    given = [plain_rule(*plain_split(u))[1] for u in urls]
    labelled = [(plain_tokens(u), g) for u, g in zip(urls, given) if g]
    total = Counter(g for _, g in labelled)
    each, by = Counter(), Counter()
    for tokens, g in labelled:
        for t in tokens:
            each[t] += 1
            by[t, g] += 1
    apart = {t: abs(by[t, "allow"] * total["block"] - by[t, "block"] * total["allow"]) for t in each if each[t] >= mining.support * len(labelled)}
    usual = set(sorted(apart, key=lambda t: (-apart[t], t))[: mining.vocabulary])
    n, u = Counter(), Counter()
    for tokens, g in labelled:
        best = sorted(tokens & usual, key=lambda t: (-apart[t], t))[: mining.width]
        for size in range(1, len(best) + 1):
            for s in combinations(sorted(best), size):
                n[s] += 1
                u[s, g] += 1
    rules = [(-c / n[s], -c / len(labelled), -len(s), g != "block", s, g) for (s, g), c in u.items() if c >= max(mining.least, mining.support * len(labelled)) and c / n[s] >= mining.confidence]
    out = []
    for url, g in zip(urls, given):
        fits = [r for r in rules if plain_tokens(url) >= set(r[4])]
        best = min(fits) if fits and not g else None
        out.append((g or (best[5] if best else "allow"), list(best[4]) if best else None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules(spark, seed):
    rng = random.Random(seed)
    urls = [f"http://{rng.choice(['', 'm.', 'www.'])}{rng.choice(['cheap-pills', 'news', 'a-b', 'x'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randint(1, 99)}{rng.choice(['', '.html', '?ref=x&page=2', '#top'])}" for _ in range(300)]
    urls += [urls[0]] * 150 + URLS
    mining = url_rules.Mining(width=4, vocabulary=12, support=0.02, confidence=0.75)
    got = {r.page_id: r for r in url_rules.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), mining=mining).collect()}
    want = plain_judge(urls, mining)
    assert [(got[i].verdict, got[i].learned) for i in range(len(urls))] == want
    assert {v for i, (v, learned) in enumerate(want) if learned} == {"allow", "block"}


def test_learning_rows_are_bounded(spark):
    urls = [f"http://h{i}.example.{'org' if i % 2 else 'com'}/{'fr' if i % 3 else 'de'}/{i}" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = url_rules.judged(pages, mining=url_rules.Mining(rows=100)).collect()
    assert len(judged) == 400
    assert all(r.rule == plain_rule(*plain_split(r.url))[0] for r in judged)


def test_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None), (2, None)], "page_id long, url string")
    assert [(r.verdict, r.rule, r.learned) for r in url_rules.judged(pages, default="block").collect()] == [("block", None, None)] * 3
    assert url_rules.judged(pages.limit(0)).count() == 0
