import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import gam
from tests.llm.fixtures import SCHEMA, frame, rows, sentence, with_clashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def plain(text):
    """The features of one text, counted a byte and a word at a time."""
    b = (text or "").encode()
    if not b:
        return [0.0] * len(gam.FEATURES)
    ws = WORD.findall(b)
    low = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ws]
    n, per = len(b), max(len(ws), 1)
    letter = lambda c: chr(c).isalpha() and c < 128 or c >= 128
    letters, symbols = sum(map(letter, b)), b"#*$%&|<>"
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    twice, cover = Counter(windows), set()
    for i, win in enumerate(windows):
        if twice[win] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in b.split(b"\n") if x.strip()]
    other = sum(1 for c in b if 32 < c < 127 and not letter(c) and not 48 <= c <= 57 and c not in symbols and c not in b".,;:?!")
    return [
        math.log1p(len(ws)), sum(map(len, ws)) / per, math.log1p(max(map(len, ws), default=0)), sum(c in symbols for c in b) / n, sum(65 <= c <= 90 for c in b) / max(letters, 1), b.count(b"!") / per,
        sum(48 <= c <= 57 for c in b) / n, sum(c in b".,;:?" for c in b) / per, other / n, sum(c >= 128 for c in b) / n,
        -sum(k / n * math.log2(k / n) for k in Counter(b).values()), len(set(low)) / per, sum(x == y for x, y in zip(low, low[1:])) / per,
        len(cover) / per, sum(not any(map(letter, w)) for w in ws) / per, sum(w[-1] in symbols for w in ws) / per, sum(65 <= w[0] <= 90 for w in ws) / per,
        math.log1p(len(ws) / max(len(lines), 1)), (len(lines) - len(set(lines))) / max(len(lines), 1),
    ]


def test_features_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(gam, "ROWS", 5)
    data = rows(n=20) + [(300, "A! b* #c\n\nA! b* #c\na a A 12,3 é", None, None, None), (301, "x\n" * 3, None, None, None)]
    got = gam.text_features(with_clashes(frame(spark, data)).withColumn("features", F.lit("x")), keep=("doc_id",)).collect()
    want = {}
    for r in data:
        want.setdefault(r[0], plain(r[1]))
    assert len(got) == len(data)
    for r in got:
        assert r["features"] == pytest.approx(want[r["doc_id"]], abs=1e-9)


def test_score_is_a_sum_of_look_ups():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)  # only the pair tells
    m = gam.fit(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.95
    for row, s in zip(x[:50], m.score(x[:50])):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges)]
        z = m.base + sum(t[i] for t, i in zip(m.tables, bins)) + sum(t[bins[f], bins[g]] for (f, g), t in zip(m.pairs, m.pair_tables))
        assert s == pytest.approx(1 / (1 + math.exp(-z)))


def test_single_features_and_best_trees():
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, 5, 2000).astype(float), np.ones(2000)], 1)
    y = (rng.random(2000) < np.array([0.1, 0.9, 0.1, 0.9, 0.5])[x[:, 0].astype(int)]).astype(float)
    s = gam.fit(x, y).score(np.stack([np.arange(5.0), np.ones(5)], 1))
    assert s == pytest.approx([0.1, 0.9, 0.1, 0.9, 0.5], abs=0.08)
    g, h = rng.normal(size=12), rng.random(12) + 0.5
    gains = [g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1) for k in range(1, 12)]
    assert gam._best_cut(g, h, 1.0, 0.0) == (pytest.approx(max(gains)), int(np.argmax(gains)) + 1)
    g2, h2 = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.5
    best = max(
        sum(g2[a, b].sum() ** 2 / (h2[a, b].sum() + 1) for a in (slice(0, i), slice(i, 4)) for b in (slice(0, j), slice(j, 5))) for i in range(1, 4) for j in range(1, 5)
    )
    assert gam._pair_tree(g2, h2, 1.0)[0] == pytest.approx(best - g2.sum() ** 2 / (h2.sum() + 1))


def corpus(n=600):
    import random

    rng, out, marks = random.Random(3), [], []
    vocab = ["the", "and", "house", "river", "walks", "quickly", "over", "stone", "bridge", "morning"]
    for i in range(n):
        text, good = sentence(rng, rng.randint(20, 200), vocab) + ".", i % 4 > 0
        if not good:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), " ".join([text.split()[0]] * 80)][i // 4 % 3]
        out.append((i, text, "en", "s", None))
        marks.append((i, int(good), 0))
    return out, marks


def test_held_out_accuracy_and_awkward_rows(spark):
    data, marks = corpus()
    labels = marks + [(0, 1 - marks[0][1], 0), (None, 1, 0), (5, None, None), (10**6, 1, 0)]
    docs = with_clashes(frame(spark, data + rows())).withColumn("predicted", F.lit("x"))
    model = gam.train(docs.where("doc_id % 5 <> 0"), spark.createDataFrame(labels, LABELS))
    found = gam.score(docs, model).collect()
    assert len(found) == len(data + rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["kept"] == "x" for r in found)
    truth = dict((m[0], m[1]) for m in marks)
    texts = {r[0]: r[1] for r in data}
    out = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["doc_id"] is not None and r["doc_id"] % 5 == 0 and texts.get(r["doc_id"]) == r["text"]]
    assert len(out) > 100 and sum(p == t for p, t in out) / len(out) > 0.97


def test_few_labels_and_empty_tables(spark):
    docs, none = frame(spark, corpus(20)[0]), spark.createDataFrame([], LABELS)
    empty = gam.train(docs, none)
    assert {r["score"] for r in gam.score(docs, empty).collect()} == {0.5}
    one = gam.train(docs, spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS))
    assert {round(r["score"], 3) for r in gam.score(docs, one).collect()} == {round(20.5 / 21, 3)}
    assert gam.score(spark.createDataFrame([], SCHEMA), one).collect() == []


def test_the_sample_is_bounded(spark):
    data, marks = corpus(400)
    assert 60 < gam.labelled(frame(spark, data), spark.createDataFrame(marks, LABELS), 100).count() < 140
