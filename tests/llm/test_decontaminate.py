import math
import random
from collections import Counter

import numpy as np

from cairn.llm import decontaminate
from tests.llm.fixtures import frame, rows, with_clashes

ITEMS = [
    (1, "Which of these rivers crosses seven borders before it reaches the sea? The Danube crosses ten of them."),
    (2, "A farmer counts forty sheep, sells eleven and buys three more lambs every spring. How many does she keep"),
    (3, None),
    (4, "too short"),
    (5, ""),
]


def items(spark, data=ITEMS):
    return spark.createDataFrame(data, "item_id long, text string")


def test_planted_passages_are_found_and_clean_texts_left(spark):
    filler = rows()[0][1]
    data = rows() + [
        (200, filler + "\n" + ITEMS[0][1] + "\n" + filler, "en", "s", 0),
        (201, ITEMS[1][1].upper().replace(" ", "!! "), "en", "s", 0),
        (202, "Which of these rivers crosses seven borders before it reaches the sea?", "en", "s", 0),  # no answer
        (203, ITEMS[0][1].replace("seven", "nine"), "en", "s", 0),
    ]
    for options in ({}, {"slice_bytes": 60, "block": 1}):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(with_clashes(frame(spark, data)), items(spark), **options).collect()}
        assert got == {(200, 1), (201, 2), (203, 1)}, options
    left = decontaminate.drop_leaking(frame(spark, data), items(spark))
    assert left.count() == len(data) - 3 and left.columns == frame(spark, data).columns


def brute(texts, words, threshold, overlap, step, min_words=3):
    """The leaks of one text, scoring every passage and item in full."""
    split = {i: tuple(map(list, decontaminate.question_and_answer(t))) for i, t in texts}
    whole = {i: q + a for i, (q, a) in split.items() if len(q + a) >= min_words}
    mean = sum(map(len, whole.values())) / len(whole)
    df = Counter(w for ws in whole.values() for w in set(ws))
    runs = lambda ws: [tuple(ws[k : k + min(3, len(ws))]) for k in range(len(ws) - min(3, len(ws)) + 1)] if ws else []
    out = {}
    for start in range(0, len(words) + 1, step):
        have, around = set(words[start : start + 2 * step]), words[max(0, start - step) : start + 3 * step]
        near = {tuple(around[k : k + n]) for n in (1, 2, 3) for k in range(len(around) - n + 1)}
        for i, ws in whole.items():
            weight = {t: math.log(1 + (len(whole) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t, n in Counter(ws).items()}
            score = sum(v for t, v in weight.items() if t in have) / sum(weight.values())
            q, a = (sum(r in near for r in runs(part)) / len(runs(part)) if part else 1.0 for part in split[i])
            if score >= threshold - 1e-9 and q >= overlap and a >= overlap:
                out[i] = max(out.get(i, (0, 0, 0)), (round(score, 9), q, a))
    return out


def test_leaks_equal_brute_force():
    """Block-max WAND and the verdict against scoring every passage and item in full."""
    rng = random.Random(4)
    texts = [(i, (" ".join(f"w{(i * k) % 23}" for k in range(1, 9 + i % 7)) + ". " + " ".join(f"w{(i + k) % 19}" for k in range(1 + i % 5))).encode()) for i in range(40)]
    words = []
    while len(words) < 600:
        i = rng.randrange(40)
        own = decontaminate.words_of(texts[i][1])
        words += [w if rng.random() < 0.9 else b"other" for w in own] if rng.random() < 0.6 else [f"w{rng.randrange(29)}".encode() for _ in range(9)]
    for block in (1, 4, 64):
        index = decontaminate.Index(texts, 0.5, block, 3)
        got = {i: (round(s, 9), q, a) for (_, i), (s, q, a) in index.leaks(words, np.array([len(words)]), 0.5).items()}
        assert got == brute(texts, words, 0.5, 0.5, index.length) and len(got) > 5


def test_clashing_columns_and_other_item_ids(spark):
    docs = with_clashes(frame(spark, [(1, ITEMS[0][1], "en", "s", 0)])).selectExpr("*", "'x' AS item_id")
    out = decontaminate.find_leaks(docs, spark.createDataFrame([("a", ITEMS[0][1])], "item_id string, text string"), keep=("doc_id", "item_id", "score", "word"))
    assert [(r.doc_id, r.word, r.item_id, r.score) for r in out.collect()] == [(1, "x", "a", 1.0)]
    assert out.columns == ["doc_id", "word", "item_id", "score", "question_overlap", "answer_overlap"]


def test_a_text_over_a_chunk_and_repeated_rows(spark):
    data = [(1, "filler words " * 150_000 + ITEMS[0][1], "en", "s", 0)] * 2
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, data), items(spark)).collect()] == [(1, 1)] * 2


def test_empty_sides(spark):
    assert decontaminate.find_leaks(frame(spark, []), items(spark)).count() == 0
    assert decontaminate.find_leaks(frame(spark), items(spark, [])).count() == 0
    assert decontaminate.drop_leaking(frame(spark), items(spark, [])).count() == len(rows())


def test_short_items_are_matched_word_by_word(spark):
    data = [(1, "It was: Too SHORT!", "en", "s", 0), (2, "too long, short", "en", "s", 0), (3, "it was too", "en", "s", 0), (4, "short of it", "en", "s", 0), (5, "Quo vadis, Domine? Too short.", "en", "s", 0)]
    both = items(spark, ITEMS + [(6, "quo vadis domine")])
    got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(frame(spark, data), both).collect()}
    assert got == {(1, 4, 1.0), (5, 4, 1.0), (5, 6, 1.0)}
    assert {r.doc_id for r in decontaminate.drop_leaking(frame(spark, data), both).collect()} == {2, 3, 4}


def test_slices_change_no_score(spark):
    data = [(i, f"the old town by river {i % 4} has bridge number w{i} and tower v{i % 7} of stone. It was built in {1800 + i}" + " and more" * (i % 5)) for i in range(40)]
    docs = frame(spark, [(i, "so they say " + t.replace("stone", "brick") + " as we know", "en", "s", 0) for i, t in data])
    out = []
    for options in ({}, {"slice_bytes": 400, "block": 3}):
        out.append({(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.find_leaks(docs, items(spark, data), **options).collect()})
    assert out[0] == out[1] and all((i, i) in out[0] for i, _ in data)
