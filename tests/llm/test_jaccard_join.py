import random

import numpy as np

from cairn.llm import jaccard_join
from tests.llm.fixtures import folder, frame, rows, with_clashes


def brute(data):
    sets = {}
    for i, t, *_ in data:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {i: i for i in sets}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed=3):
    """Groups whose members differ a little, chains of them, and texts that share one long passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared, out, i = [word() for _ in range(60)], [], 1000
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 30, 120, 300]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            out.append((i, " ".join(w), "en", "s", 0))
            base = w if rng.random() < 0.3 else base
            i += 1
    for _ in range(40):
        out.append((i, " ".join(shared + [word() for _ in range(rng.randrange(5, 90))]), "en", "s", 0))
        i += 1
    return out


def test_components_equal_brute_force(spark, tmp_path):
    data = rows() + copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op5_ngram_jaccard_join(spark, folder(spark, tmp_path, data)).collect()}
    assert got.pop(None)[1] is None
    assert got == brute(data)


def test_small_bounds_change_nothing(spark):
    data = copies(5)
    out = jaccard_join.jaccard_join(with_clashes(frame(spark, data)), bucket_rows=500, list_rows=4, hot_sets=6, most_hot=200, broadcast_ids=0, block_rows=5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(data)


def test_empty_table(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0


def test_sure_pairs_join_components_once():
    """Of random pairs in batches: the sure ones kept are a spanning forest, and no other of two components so joined is kept after it."""
    rng = np.random.default_rng(4)
    names = rng.permutation(10**6)[:300]

    def roots(pairs):
        root = {int(n): int(n) for n in names}
        for a, b in pairs:
            x, y = root[a], root[b]
            if x != y:
                root = {n: x if r == y else r for n, r in root.items()}
        return root

    joined, kept, every, loose = jaccard_join._Joined(names), [], [], []
    for _ in range(6):
        a, b, sure = rng.choice(names, 70), rng.choice(names, 70), rng.random(70) < 0.5
        keep = joined.apart(a, b, sure)
        pairs = list(zip(a.tolist(), b.tolist()))
        every += [p for p, s in zip(pairs, sure) if s]
        kept += [p for p, s, k in zip(pairs, sure, keep) if s and k]
        now = roots(every)
        assert all((now[x] != now[y]) == k for (x, y), s, k in zip(pairs, sure, keep.tolist()) if not s)
        loose += [p for p, s in zip(pairs, sure) if not s]
    one, all_ = roots(kept), roots(every)
    same = lambda r: {(x, y) for x in r for y in r if r[x] == r[y]}
    assert same(one) == same(all_) and len(kept) == len(names) - len(set(one.values())) and loose
