import collections
import math
import zlib

import numpy as np

from cairn.llm import brown_lm
from tests.llm.fixtures import folder, rows


def test_base_equals_brute_force_and_classes_beat_it(spark, tmp_path):
    data = [r for r in rows(n=300) if r[0] is not None]
    out = brown_lm.op2_brown_lm(spark, folder(spark, tmp_path, data)).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    count = collections.Counter()
    for i, text, *_ in data:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(tokens(text))
    total, distinct = sum(count.values()), len(count)
    want = sorted(
        (i, zlib.crc32(str(i).encode()) % 5 == 1, len(tokens(t)), sum(count[k] > 0 for k in tokens(t)), total, round(sum(math.log10((count[k] + 0.5) / (total + 0.5 * (distinct + 1))) for k in tokens(t)), 4))
        for i, t, *_ in data
    )
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    held = [r for r in out if r.held_out and r.n_tokens < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tail_words_are_joined(spark):
    data = spark.createDataFrame([(1, "a b c d e"), (2, "a b zz"), (3, None)], "doc_id long, text string")
    model = brown_lm.train(data, frequent=1, endings=2, head=2, classes=3)
    got = {r.doc_id: r for r in brown_lm.score(data, model).collect()}
    assert [got[i].n_known for i in (1, 2, 3)] == [6, 4, 1]
    full = {r.doc_id: r for r in brown_lm.score(data, brown_lm.train(data, frequent=1, endings=2, head=100, classes=3)).collect()}
    assert all(abs(full[i].base_score - got[i].base_score) < 1e-9 for i in full)


def test_exchange_finds_alternating_classes():
    # units 1, 2 are always followed by 3, 4 and the other way round
    pairs = np.zeros((5, 5))
    for a in (1, 2):
        for b in (3, 4):
            pairs[a, b] = pairs[b, a] = 50
    of = brown_lm.exchange(pairs, classes=3)
    assert of[1] == of[2] != of[3] == of[4] and of[0] == 0


def test_empty_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    r = brown_lm.score(some, brown_lm.train(none)).collect()[0]
    assert (r.n_tokens, r.n_known) == (2, 0)
    assert brown_lm.score(none, brown_lm.train(some)).count() == 0


def test_every_word_is_classed_by_its_own_neighbours(spark):
    """Against plain loops: classes of all words that are no units, the tables, and the score, with words in and beyond the head."""
    data = [(i, t) for i, t, *_ in rows(n=120) if i is not None]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    held = [(1, "never seen words " + (data[0][1] or "")), (2, None), (3, "xx")]
    model = brown_lm.train(frame, frequent=20, endings=10, head=60, classes=8)
    v, texts = model.vocabulary, [(t or "").encode().lower().split() for _, t in data]
    unit = lambda w: int(v.units([w])[1][0])
    seed, k = lambda w: int(model.class_of[unit(w)]), len(model.log_transition)
    count, table, follows = collections.Counter(), np.zeros((k, k)), collections.defaultdict(lambda: np.zeros(k))
    for words in texts:
        before = 0
        for w in words:
            count[w] += 1
            table[before, seed(w)] += 1
            follows[w][before] += 1
            before = seed(w)
        table[before, 0] += 1
    transition, share = brown_lm._logs(table, table.sum(0))
    want = {}
    for w, left in follows.items():
        gain = left @ transition - left.sum() * share
        want[w] = seed(w) if unit(w) <= 20 else 1 + int(np.argmax(gain[1:]))
    got = {bytes(r.word): r.cls for r in model.counts.collect()} | {w: int(model.head_class[i]) for w, i in v.head.items()}
    assert got == want
    assert any(want[w] != want[x] for w in want for x in want if unit(w) > 20 and unit(w) == unit(x))  # one ending, two classes

    final, mass = np.zeros((k, k)), np.zeros(k)
    final[:, 0] = table[:, 0]
    for w, left in follows.items():
        final[:, want[w]] += left
        mass[want[w]] += count[w] + 0.5
    transition, share = brown_lm._logs(final, mass)
    for i, t in held:
        before, score = 0, 0.0
        for w in (t or "").encode().lower().split():
            cls = want.get(w, seed(w))
            score += transition[before, cls] - share[cls] + math.log10(count[w] + 0.5)
            before = seed(w)
        held[i - 1] = (i, t, float(score) + float(transition[before, 0]))  # the end is the only member of its class
    out = {r.doc_id: r.score for r in brown_lm.score(spark.createDataFrame([h[:2] for h in held], "doc_id long, text string"), model).collect()}
    assert {i: round(x, 6) for i, x in out.items()} == {i: round(x, 6) for i, _, x in held}
    assert np.allclose(model.log_transition, transition) and np.allclose(model.log_class_total, share)
