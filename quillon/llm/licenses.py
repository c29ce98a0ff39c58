"""License scans: short notices with a few errors, and exact phrases.

A notice that may have k errors is split into k + 1 parts, so that at least one part of any occurrence is
unchanged; the longest word of each part is its exact seed. Seeds are searched for in all bytes of a batch at
once, in a copy in which every run of other characters than those of words is one space. Around the hits the regex
library matches the notice with at most k errors, from left to right, reporting spans and errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Phrases whose words stand consecutively, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Notice:
    words: str
    label: str
    errors: int

    def seeds(self) -> list[tuple[bytes, int]]:
        """The longest word of each of errors + 1 parts, parted so that the shortest seed is as long as can be, with the characters before it."""
        w = self.words.split()
        longest = lambda a, b: max(range(a, b), key=lambda i: len(w[i]))
        best: dict[int, tuple[int, list[int]]] = {0: (99, [])}
        for _ in range(self.errors + 1):
            after: dict[int, tuple[int, list[int]]] = {}
            for a, (least, picked) in best.items():
                for b in range(a + 1, len(w) + 1):
                    i = longest(a, b)
                    if (value := min(least, len(w[i]))) > after.get(b, (-1, []))[0]:
                        after[b] = (value, [*picked, i])
            best = after
        return [(w[i].encode(), sum(len(x) + 1 for x in w[:i])) for i in best[len(w)][1]]

    def most(self) -> int:
        return len(self.words) + self.errors


NOTICES = (
    Notice("released under the mit license", "mit", 1),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4),
    Notice("licensed under the apache license version 2 0", "apache", 2),
    Notice("licensed under the gnu general public license", "gpl", 3),
    Notice("this program is free software you can redistribute it", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 3),
    Notice("mozilla public license version 2 0", "mpl", 2),
    Notice("licensed under cc by nc", "cc-by-nc", 1),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("all rights reserved", "all-rights-reserved", 1),
)

SPANS = "array<struct<label:string,start:int,end:int,errors:int>>"


class Matcher:
    """Places of words with one space between them, with at most so many errors."""

    def __init__(self, words: str, errors: int):
        self.least = max(1, len(words) - errors)
        # The first match rather than the best one, so that none is passed over for a better one after it; (?e) then fits it to fewer errors.
        self.pattern = regex.compile(f"(?e)(?:{regex.escape(words, literal_spaces=True)}){{e<={errors}}}")

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """Start, end and errors of places that don't overlap, in order; beside and between them there is no other."""
        found: list[tuple[int, int, int]] = []
        parts = [(0, len(text))]
        while parts:
            a, b = parts.pop()
            if b - a < self.least or not (m := self.pattern.search(text, a, b)) or m.end() == m.start():
                continue
            own = text[m.start() : m.end()]
            start, end = m.end() - len(own.lstrip(" ")), m.start() + len(own.rstrip(" "))
            if end - start < len(own) and (bare := self.pattern.fullmatch(text, start, end)):  # a space at an end may be an error or a match
                m = bare
            found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            # A match that was fitted may have left room before it.
            parts += [(a, m.start()), (m.end(), b)]
        return sorted(found)


class Scanner:
    def __init__(self, notices: tuple[Notice, ...], phrases: tuple[tuple[str, str], ...]):
        self.notices = [(n, Matcher(n.words, n.errors), n.most()) for n in notices]
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for seed, before in n.seeds():
                self.seeds.setdefault(seed, []).append((i, before))
        word, gap = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"
        self.phrases = [(re.compile(rb"(?<!" + word + rb")" + gap.join(p.encode().split()) + rb"(?!" + word + rb")"), label, p.split()[-1].encode()) for p, label in phrases]

    @staticmethod
    def places(data: bytes, seed: bytes) -> list[int]:
        out, at = [], data.find(seed)
        while at >= 0:
            out.append(at)
            at = data.find(seed, at + 1)
        return out

    @staticmethod
    def single_spaces(raw: np.ndarray, offsets: np.ndarray, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """A copy of data in which each run of bytes that aren't words' is one space, each of its bytes' place in data, and its texts' starts with the end as the last."""
        inside = T.ALNUM[raw]
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        kept[offsets[:-1][offsets[:-1] < len(raw)]] = True
        place = np.flatnonzero(kept)
        return np.where(inside[place], np.frombuffer(data, np.uint8)[place], 32).astype(np.uint8).tobytes(), place, np.searchsorted(place, offsets)

    def scan(self, column: pa.Array) -> list[tuple]:
        """For each text: words, phrase places, first and last one's word, phrase labels, all labels, score, spans."""
        raw, offsets = T.text_buffer(column)
        start, _, first = T.words(raw, offsets, T.ALNUM)
        data = raw.tobytes().lower()
        n = len(column)
        near, place, edges = self.single_spaces(raw, offsets, data)
        chars = np.cumsum((raw & 0xC0) != 0x80)
        base: dict[int, list[tuple[int, str]]] = {}
        hits = {last: np.array(self.places(data, last), np.int64) for last in {last for _, _, last in self.phrases}}
        for pattern, label, last in self.phrases:
            for i in np.unique(np.searchsorted(offsets, hits[last], "right") - 1).tolist():
                for m in pattern.finditer(data[offsets[i] : offsets[i + 1]]):
                    base.setdefault(i, []).append((int(np.searchsorted(start, offsets[i] + m.start())) - int(first[i]), label))
        windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for seed, uses in self.seeds.items():
            at = np.array(self.places(near, seed), np.int64)
            where = np.searchsorted(edges, at, "right") - 1
            for p, i in zip(at.tolist(), where.tolist()):
                for notice, before in uses:
                    n_, _, most = self.notices[notice]
                    a, b = max(int(edges[i]), p - before - 4 * n_.errors), min(int(edges[i + 1]), p + most + 4 * n_.errors)  # only an edit has more than a byte
                    windows.setdefault((i, notice), []).append((a, b))
        spans: dict[int, list[tuple[str, int, int, int, float]]] = {}
        for (i, notice), parts in windows.items():
            n_, matcher, _ = self.notices[notice]
            merged: list[list[int]] = []
            for a, b in sorted(parts):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                while a > edges[i] and near[a] & 0xC0 == 0x80:
                    a -= 1
                piece = near[a:b].decode("utf-8", "ignore")
                if not (found := matcher.find(piece)):
                    continue
                begins = np.flatnonzero((np.frombuffer(near, np.uint8, b - a, a) & 0xC0) != 0x80) + a
                number = chars[place[begins]] - int(chars[offsets[i]])
                for begin, end, errors in found:
                    spans.setdefault(i, []).append((n_.label, int(number[begin]), int(number[end - 1]) + 1, errors, 1 - errors / len(n_.words)))
        out, counts = [], np.diff(first)
        for i in range(n):
            b, s = base.get(i, ()), spans.get(i, ())
            words = [w for w, _ in b]
            out.append((int(counts[i]), len(b), min(words, default=None), max(words, default=None), sorted({x for _, x in b}), sorted({x for _, x in b} | {x[0] for x in s}), 1.0 if b else max((x[4] for x in s), default=0.0), [dict(label=x[0], start=x[1], end=x[2], errors=x[3]) for x in sorted(s, key=lambda x: x[1:3])]))
        return out


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    The whole text is lower-cased (A-Z) and cut into words of ASCII letters, digits and characters beyond
    ASCII. n_base counts the places of phrases, first_word and last_word are the smallest and largest of them
    (in words, from 0; null if none). spans lists the notices found, with their label, place in characters and
    number of errors; any run of other characters between the words of a notice counts as one space. score is 1 with a phrase, else
    that of the nearest notice, one less the share of its characters that are edits; 0 without either. Null and
    empty texts have no words and labels. Rows are scanned one by one, whatever ids they share.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("errors", pa.int32())]))]
        for batch in T.chunks(rows, limit=1 << 20):
            found = zip(*scanner.scan(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(found, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans {SPANS}"
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(batches, schema)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    spans = F.array_join(F.transform("spans", lambda s: F.format_string("%s:%d-%d:%d", s["label"], s["start"], s["end"], s["errors"])), " ")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *[x.alias(c) for c, x in joined.items()], "score", F.size("spans").cast("long").alias("n_notices"), spans.alias("spans"))
