import collections
import re

import numpy as np

from cairn.llm import quality
from tests.llm.fixtures import folder, frame, rows, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines, seen, dup = [x for x in t.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    wins = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_counts_equal_brute_force(spark, tmp_path):
    extra = [(200, "a b c a b c a b c\n\n# x\n# x\n|<>|", "en", "s", 0), (201, "é è ö  \x0b ü", "fr", "s", 0)]
    out = {(r.doc_id, r.n_words): r for r in quality.op1_quality_rules(spark, folder(spark, tmp_path, rows() + extra)).collect()}
    for i, text, *_ in rows() + extra:
        want = brute(text)
        r = out[i, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_plain_rows_stay(spark):
    data = [(i, t, "en", "s0", 0) for i, (_, t, lang, *_) in enumerate(rows(n=600)) if lang == "en" and t and len(t) < 5000 and len(t) > 300]
    junk = [(9000 + i, " ".join(w + "###" for w in (data[i][1]).split()), "en", "s0", 0) for i in range(5)]
    stats = quality.text_statistics(frame(spark, data + junk))
    out = {r.doc_id: r.kept for r in quality.quality_rules(stats, min_group=50).collect()}
    assert not any(out[9000 + i] for i in range(5))
    good = [k for i, k in out.items() if i < 9000]
    assert sum(good) >= 0.98 * len(good)


def test_empty_table_and_clashing_columns(spark):
    stats = quality.text_statistics(with_clashes(frame(spark, [])))
    assert quality.quality_rules(stats).count() == 0
    assert quality.text_statistics(with_clashes(frame(spark))).count() == len(rows())


def plain_mcd(x, share=0.75):
    """Distances of the rows of x given their length, by the same concentration steps in numpy."""
    floors = np.array(quality.FLOORS)

    def estimate(rows):
        mu, cov = rows.mean(0), np.cov(rows.T, bias=True)
        cov = cov + np.diag(np.maximum(floors**2 - np.diag(cov), 0) + 1e-9)
        return mu, np.linalg.pinv(cov, hermitian=True), cov[0, 0], np.linalg.slogdet(cov)[1]

    def distance(e, length=False):
        d = x - e[0]
        full = np.einsum("ni,ij,nj->n", d, e[1], d)
        return full - d[:, 0] ** 2 / e[2] if length else full

    def step(e, part):
        c = np.floor(np.log2(1 + np.maximum(distance(e), 0)) * 32)
        below = np.array([(c < v).sum() for v in c])
        return estimate(x[below < part * len(x)])

    q = np.percentile(np.round(x, 3), [25, 50, 75], axis=0)
    sd = np.maximum((q[2] - q[0]) / 1.349, floors)
    robust = (q[1], np.diag(1 / sd**2), sd[0] ** 2, np.inf)
    now = []
    for k, e in enumerate((robust, estimate(x), robust)):
        e = step(e, 0.5 if k == 2 else share)
        low = np.inf if k == 2 else e[3]
        while (then := step(e, share))[3] < low - 1e-3:
            e, low = then, then[3]
        now.append(e)
    best = min(now, key=lambda e: e[3])
    d = distance(best, True)
    mid = 2 ** ((np.median(np.floor(np.log2(1 + np.maximum(d, 0)) * 256)) + 0.5) / 256) - 1
    return np.sqrt(np.maximum(d / max(mid / quality.chi_square_quantile(0.5, 5), 1), 0))


def test_distances_equal_a_plain_mcd_and_ties_share_a_verdict(spark):
    data = [(i, t + "\n" + "extra words in it " * (i % 9) + "#" * (i % 5), "en", "s0", 0) for i, (_, t, lang, *_) in enumerate(rows(n=600)) if lang == "en" and t and 300 < len(t) < 5000]
    data += [(9000 + i, data[0][1] + " ###" * 90, "en", "s0", 0) for i in range(3)]  # repeated texts
    stats = quality.text_statistics(frame(spark, data)).repartition(3).selectExpr("*", "'x' AS kept", "'y' AS x0", "'z' AS scale")
    out = quality.quality_rules(stats, min_group=50)
    assert out.columns == ["doc_id", "lang", "source", *quality.STATS, "base_failed", "distance", "kept"]
    got = {r.doc_id: r for r in out.collect()}
    good = [i for i, r in got.items() if not r.base_failed]
    raw = np.array([[got[i][c] for c in quality.STATS] for i in good], float)
    words, chars = raw[:, 0] + 1, raw[:, 1] + 1
    x = np.stack([np.log(words), np.log(chars / words), np.sqrt(raw[:, 2] / chars), np.sqrt(raw[:, 3] / (raw[:, 5] + 1)), np.sqrt(raw[:, 4] / words), np.sqrt(raw[:, 6] / chars)], 1)
    assert len(good) > 100 and np.allclose([got[i].distance for i in good], plain_mcd(x), rtol=1e-5, atol=1e-5)
    assert len({(got[9000 + i].distance, got[9000 + i].kept) for i in range(3)}) == 1 and not got[9000].kept


def test_a_mass_of_equal_rows_and_null_groups(spark):
    same = rows()[0][1]
    out = quality.quality_rules(quality.text_statistics(frame(spark, [(i, same, None, None, 0) for i in range(150)])), min_group=50).collect()
    assert len(out) == 150 and all(r.kept and r.distance < 1 for r in out)
