import math

import numpy as np

from cairn.llm import language_id
from tests.llm.fixtures import folder, frame, rows, with_clashes


def test_held_out_accuracy_and_unknown(spark, tmp_path):
    data = rows(n=300)
    out = {(r.doc_id): r for r in language_id.op6_language_id(spark, folder(spark, tmp_path, data)).collect()}
    truth = {i: lang for i, t, lang, *_ in data if i is not None and (i < 100 or i >= 1000)}
    held = [i for i in truth if out[i].held_out]
    assert held and sum(out[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    for i in (100, 101, 102, 103):
        assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_code_lengths_equal_a_plain_ppm(spark):
    texts = {"a": ["abab abba ba", "aabb"], "b": ["cdcd dccd", "ddcc abc"]}
    data = [(0, t, lang, None, 0) for lang, ts in texts.items() for t in ts]
    model = language_id.train(frame(spark, data))

    def count(lang, order):
        held = {}
        for t in texts[lang]:
            b = [0, 0, 0, *t.encode()]
            for i in range(3, len(b)):
                held.setdefault(tuple(b[i - order : i]), {}).setdefault(b[i], 0)
                held[tuple(b[i - order : i])][b[i]] += 1
        return held

    def bits(lang, ctx, c):
        here = tables[lang][len(ctx)].get(tuple(ctx), {})
        n, t = sum(here.values()), len(here)
        if c in here:
            return -math.log2(here[c] / (n + t))
        return (-math.log2(t / (n + t)) if here else 0) + (bits(lang, ctx[1:], c) if len(ctx) else 8)

    tables = {lang: [count(lang, k) for k in range(4)] for lang in texts}
    probe = b"abcd xyab dcba"
    b = [0, 0, 0, *probe]
    got, _ = language_id.code_lengths(model, np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))
    for j, lang in enumerate(model.langs):
        want = sum(bits(lang, b[i - 3 : i], b[i]) for i in range(3, len(b)))
        assert abs(want - got[0, j]) < 1e-3


def test_no_labels_and_clashing_columns(spark):
    model = language_id.train(frame(spark, [(1, "abc", None, None, 0)]))
    out = language_id.classify(with_clashes(frame(spark)), model)
    assert {r.lang_pred for r in out.collect()} == {"und"} and out.count() == len(rows())
    assert language_id.classify(frame(spark, []), language_id.train(frame(spark))).count() == 0


def test_long_texts_and_masses_of_copies_are_learned(spark):
    data = [(0, "zul zula zulu " * 3000, "z", "s", 0)] + [(1, "kop kopa kopu", "k", "s", 0)] * 300 + [(i, f"mar mara maru {chr(97 + i % 26)}", "m", "s", 0) for i in range(2, 60)]
    model = language_id.train(frame(spark, data), texts_per_lang=40)
    assert model.langs == ["k", "m", "z"]
    out = {r.doc_id: r.lang_pred for r in language_id.classify(frame(spark, [(0, "zulu zul", None, None, 0), (1, "kopu kop", None, None, 0), (2, "maru", None, None, 0)]), model).collect()}
    assert out == {0: "z", 1: "k", 2: "m"}
