import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import collocations
from tests.llm.fixtures import SCHEMA, frame, rows, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, most=3, least=10, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + k])) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    candidates = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= least}
    inside = Counter()
    for (lang, ws), f in candidates.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                inside[lang, ws[i : i + k]] = max(inside[lang, ws[i : i + k]], f)
    found = {}
    for (lang, ws), a in candidates.items():
        if 100 * inside[lang, ws] >= 50 * a:
            continue
        cuts = [(counts[lang, ws[:k]], counts[lang, ws[k:]]) for k in range(1, len(ws))]
        left, right = min(cuts, key=lambda c: 1_000_000 * a * a // (c[0] * c[1]))
        found.setdefault(lang, []).append((-(1_000_000 * a * a // (left * right)), -a, " ".join(ws).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, every in found.items() for i, (s, a, p, left, right) in enumerate(sorted(every)[:top], 1)}


def got(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    odd = [
        (200 + i, text, lang, "s0", None)
        for i, (text, lang) in enumerate([("A a\ta  a, a a; a A a", "x"), ("New York.New York\rnew york\x0bNEW YORK new\x1fyork", None), ("é É naïve über", "und"), ("$ & ## $ & ##", "x"), (". . ,\n", "x")] * 12)
    ]
    return rows() * 2 + odd


@pytest.mark.parametrize("cells, shard", [(1 << 26, 4 << 20), (8, 3000)])
def test_equals_brute_force(spark, data, monkeypatch, cells, shard):
    """Also with a sketch so small that every phrase passes it, and with many shards."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    docs = with_clashes(frame(spark, data)).withColumn("words", F.lit("w")).withColumn("phrase", F.lit("p")).repartition(5)
    want = brute(data)
    assert len(want) > 100 and got(collocations.collocations(docs, most_cells=cells)) == want


def test_four_words_low_counts_and_top(spark, data):
    assert got(collocations.collocations(frame(spark, data), most_words=4, min_count=2, top=7)) == brute(data, 4, 2, 7)


def test_empty_and_null(spark):
    assert got(collocations.collocations(spark.createDataFrame([], SCHEMA))) == set()
    assert got(collocations.collocations(frame(spark, [(1, None, None, None, None), (2, "", "en", None, None)]))) == set()


def test_phrases_that_share_a_hash_are_told_apart(monkeypatch):
    real = collocations.Phrases

    class Clash(real):
        def __init__(self, *a):
            super().__init__(*a)
            self.hash = [h & np.uint64(3) for h in self.hash]

    monkeypatch.setattr(collocations, "Phrases", Clash)
    words, phrases, found = collocations.count_shard([b"a b c d e a b", b"c d"], "x", 2, np.full(1 << 13, 255, np.uint8), 1 << 15)
    assert words == 9 and dict(zip(phrases, found.tolist())) == {b"a": 2, b"b": 2, b"c": 2, b"d": 2, b"e": 1, b"a b": 2, b"b c": 1, b"c d": 2, b"d e": 1, b"e a": 1}


def test_long_text_and_exact_score(spark):
    data = [(1, "one two three " * 200_000, "en", None, None)]
    assert got(collocations.collocations(frame(spark, data))) == brute(data)
    big = spark.sql("select 900000000000000L a, 900000000000001L l, 900000000000000L r")
    assert big.selectExpr("(cast(a as decimal(16)) * cast(a as decimal(16)) * 1000000) div (cast(l as decimal(19)) * cast(r as decimal(19)))").first()[0] == 10**6 * 9 * 10**14 // (9 * 10**14 + 1)
