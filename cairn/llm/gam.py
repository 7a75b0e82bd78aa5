"""Quality classifier: a generalised additive model with pairwise interactions.

A text's score is the logistic of a sum of lookup tables: one table per feature, over its bins, and one
per chosen pair of features, over both their bins.  The tables are learned by cyclic boosting: turn by
turn every feature gets a shallow tree over its own bins, fitted to the gradient and curvature of the
log loss that the sum so far leaves, and the tree's leaves, shrunk, are added to the feature's table.
Pairs are ranked by what a table over coarse bins would gain on the residuals, and the best are boosted
in the same way by trees of one cut on each.  Rows held back from boosting end it and choose its length.

The model is fitted on the driver from a bounded sample of labelled rows; features and scores of all
texts are computed by tasks, a score as one gather and addition per table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Words, chunks, crc_mod5, map_arrow, mix64, read, text_bytes
from cairn.llm.quality import _line_counts, _repeated_words

FEATURES = [
    "words", "word_bytes", "longest_word", "symbols", "upper", "exclamations", "digits", "stops", "other_signs", "letters_beyond_ascii",
    "byte_entropy", "distinct_words", "word_again", "repeated_words", "words_without_letter", "words_ending_in_symbols", "capitalised_words", "line_words", "repeated_lines",
]
#: Score from which a text counts as good.
THRESHOLD = 0.3
#: Texts of a chunk that are worked on at once; a row takes 2 KB of byte counts.
ROWS = 2048


# ---------------------------------------------------------------- features


def _kinds() -> np.ndarray:
    """Bytes by kind: symbols, upper case, exclamation marks, digits, stops, other signs, bytes beyond ASCII, letters."""
    b = np.arange(256)
    upper, digit = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    letter = upper | ((b >= 97) & (b <= 122)) | (b >= 128)
    symbol, stop = np.isin(b, list(b"#*$%&|<>")), np.isin(b, list(b".,;:?"))
    other = (b > 32) & (b < 127) & ~letter & ~digit & ~symbol & ~stop & (b != 33)
    return np.stack([symbol, upper, b == 33, digit, stop, other, b >= 128, letter], 1).astype(np.float64)


_KINDS = _kinds()
_SYMBOL, _LETTER, _CAPITAL = _KINDS[:, 0] > 0, _KINDS[:, 7] > 0, _KINDS[:, 1] > 0


def features(buf: np.ndarray, off: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Rows of FEATURES: shares of bytes and words, logarithms of lengths; all 0 for a text without bytes."""
    rows, n = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(rows), n)
    bytes_of = np.bincount(row * 256 + buf, minlength=rows * 256).reshape(rows, 256).astype(np.float64)
    kinds = bytes_of @ _KINDS
    w = Words(buf, off, lower=True)
    words = np.diff(w.first).astype(np.float64)
    length = w.end - w.start
    longest = np.zeros(rows)
    np.maximum.at(longest, w.row, length)
    # words that their row has had before: next to an equal one of it in order of hashes
    at = np.argsort(w.hash, kind="stable")
    had = (w.hash[at][1:] == w.hash[at][:-1]) & (w.row[at][1:] == w.row[at][:-1])
    old = np.bincount(w.row[at[1:]][had], minlength=rows)
    after = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    of_words = lambda which: np.bincount(w.row[which], minlength=rows)
    lines = np.array([_line_counts(t) for t in texts], np.float64).reshape(-1, 2)
    some, per = np.maximum(n, 1.0), np.maximum(words, 1.0)
    share = bytes_of / some[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0.0).sum(1)
    many = np.maximum(lines[:, 0], 1.0)
    return np.stack(
        [
            np.log1p(words), np.bincount(w.row, length, minlength=rows) / per, np.log1p(longest), kinds[:, 0] / some, kinds[:, 1] / np.maximum(kinds[:, 7], 1.0), kinds[:, 2] / per,
            kinds[:, 3] / some, kinds[:, 4] / per, kinds[:, 5] / some, kinds[:, 6] / some, entropy, (words - old) / per, of_words(np.flatnonzero(after) + 1) / per,
            _repeated_words(w, rows) / per, of_words(letters[w.end] == letters[w.start]) / per, of_words(_SYMBOL[buf[w.end - 1]]) / per, of_words(_CAPITAL[buf[w.start]]) / per,
            np.log1p(words / many), lines[:, 1] / many,
        ],
        1,
    ) * (n > 0)[:, None]


def _feature_chunks(batches: Iterator[pa.RecordBatch]):
    for c in chunks(batches, "__bytes"):
        texts, found = c.texts(), []
        for lo in range(0, len(texts), ROWS):
            hi = min(lo + ROWS, len(texts))
            a, b = c.off[lo], c.off[hi]
            found.append(features(c.buf[a:b], c.off[lo : hi + 1] - a, texts[lo:hi]))
        yield c, np.concatenate(found)


def text_features(docs: DataFrame, text: Column | str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` with an array `features` of each whole text; null counts as empty."""
    kept = list(keep)
    schema = T.StructType([docs.schema[c] for c in kept]).add("features", T.ArrayType(T.DoubleType()))

    def run(batches):
        for c, x in _feature_chunks(batches):
            yield pa.record_batch([c.column(k) for k in kept] + [pa.array(x.tolist(), pa.list_(pa.float64()))], names=[*kept, "features"])

    return map_arrow(docs.select(*kept, text_bytes(text).alias("__bytes")), run, schema)


# ---------------------------------------------------------------- the model


@dataclass
class Gam:
    """Logit = base + tables[f][bin of f] + pair_tables[p][bins of both]; edges[f] part the bins of feature f."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), np.int64)

    def logit(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            z += t[b[:, f], b[:, g]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(self.bins(x)), -30, 30)))


def _edges(x: np.ndarray, most: int) -> np.ndarray:
    """At most `most` - 1 edges between different values, by quantiles."""
    q = np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1], method="higher"))
    return q[q > x.min()]


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _leaf(g, h, ridge):
    return g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Of a row of bins with gradients and curvatures: the gain of the best cut and the first bin right of it."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = _gain(left_g, left_h, ridge) + _gain(all_g - left_g, all_h - left_h, ridge) - _gain(all_g, all_h, ridge)
    gain[(left_h < least) | (all_h - left_h < least)] = 0.0
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """The values, bin by bin, of a tree of at most `leaves` leaves grown by best cut."""
    parts = [(0, len(g), *_best_cut(g, h, ridge, least))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda j: parts[j][2])
        lo, hi, gain, cut = parts[i]
        if gain <= 0:
            break
        mid = lo + cut
        parts[i : i + 1] = [(lo, mid, *_best_cut(g[lo:mid], h[lo:mid], ridge, least)), (mid, hi, *_best_cut(g[mid:hi], h[mid:hi], ridge, least))]
    out = np.zeros(len(g))
    for lo, hi, _, _ in parts:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum(), ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Over two features' bins: the gain and the values of the best tree of one cut on each, that is four corners."""
    sums = [np.cumsum(np.cumsum(t, 0), 1) for t in (g, h)]
    corners = []
    for t in sums:
        a, left, up, whole = t[:-1, :-1], t[:-1, -1:], t[-1:, :-1], t[-1, -1]
        corners.append((a, left - a, up - a, whole - left - up + a))
    gain = sum(_gain(x, y, ridge) for x, y in zip(*corners))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    values = [_leaf(x[i, j], y[i, j], ridge) for x, y in zip(*corners)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j] - _gain(g.sum(), h.sum(), ridge)), out


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0.0, z) - y * z).mean()) if len(z) else 0.0


def fit(x: np.ndarray, y: np.ndarray, most_bins: int = 64, pair_bins: int = 16, pairs: int = 8, turns: int = 400, rate: float = 0.1, leaves: int = 4, ridge: float = 1.0, least: float = 1.0, patience: int = 25) -> Gam:
    """Fit on features x and labels y (0 or 1).  Every fifth row is held back to end the boosting.

    Without rows the base is 0; where the labels are all alike the tables stay 0 and the base says so.
    """
    good, n = float(y.sum()), len(y)
    base = float(np.log((good + 0.5) / (n - good + 0.5)))
    if not n or good in (0.0, float(n)):
        return Gam(base, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    back = np.arange(n) % 5 == 4
    model = Gam(base, [_edges(x[:, f], most_bins) for f in range(x.shape[1])], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    z = np.full(n, base)
    _boost(model, b, z, y, back, turns, rate, lambda g, h: _singles(model, b, back, g, h, leaves, ridge, least), patience)
    # coarse bins of each feature, as runs of its bins
    runs = [(np.arange(len(t)) * min(pair_bins, len(t)) // len(t)) for t in model.tables]
    coarse = np.stack([r[b[:, f]] for f, r in enumerate(runs)], 1)
    p = 1 / (1 + np.exp(-z))
    ranked = []
    for f in range(x.shape[1]):
        for g in range(f + 1, x.shape[1]):
            ranked.append((_pair_tree(*_sums2(coarse, runs, f, g, ~back, y - p, p * (1 - p)), ridge)[0], -f, -g))
    model.pairs = [(-f, -g) for gain, f, g in sorted(ranked, reverse=True)[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[f]), len(model.tables[g]))) for f, g in model.pairs]
    if model.pairs:
        _boost(model, b, z, y, back, turns, rate, lambda g, h: _doubles(model, coarse, runs, back, g, h, ridge), patience)
    return model


def _sums2(coarse, runs, f, g, rows, grad, curve):
    shape = (int(runs[f][-1]) + 1, int(runs[g][-1]) + 1)
    at = coarse[rows, f] * shape[1] + coarse[rows, g]
    return tuple(np.bincount(at, v[rows], minlength=shape[0] * shape[1]).reshape(shape) for v in (grad, curve))


def _singles(model, b, back, grad, curve, leaves, ridge, least):
    """Turn by turn (table, its step, the step per row) for each feature."""
    for f, table in enumerate(model.tables):
        g, h = (np.bincount(b[~back, f], v()[~back], minlength=len(table)) for v in (grad, curve))
        step = _tree(g, h, leaves, ridge, least)
        yield table, step, lambda step=step, f=f: step[b[:, f]]


def _doubles(model, coarse, runs, back, grad, curve, ridge):
    for (f, g), table in zip(model.pairs, model.pair_tables):
        _, small = _pair_tree(*_sums2(coarse, runs, f, g, ~back, grad(), curve()), ridge)
        yield table, small[np.ix_(runs[f], runs[g])], lambda small=small, f=f, g=g: small[coarse[:, f], coarse[:, g]]


def _boost(model, b, z, y, back, turns, rate, steps, patience) -> None:
    """Add shrunk steps to the tables, cyclically, and keep the tables of the turn with the least loss on rows held back."""
    p = lambda: 1 / (1 + np.exp(-z))
    tables = lambda: [*model.tables, *model.pair_tables]
    least, kept, kept_z, since = _loss(z[back], y[back]), [t.copy() for t in tables()], z.copy(), 0
    for _ in range(turns):
        for table, step, by_row in steps(lambda: y - p(), lambda: p() * (1 - p())):
            table += rate * step
            z += rate * by_row()
        now, since = _loss(z[back], y[back]), since + 1
        if now < least - 1e-6:
            least, kept, kept_z, since = now, [t.copy() for t in tables()], z.copy(), 0
        if since >= patience:
            break
    for table, best in zip(tables(), kept):
        table[...] = best
    z[...] = kept_z


# ---------------------------------------------------------------- training and scoring on tables


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(doc_id, text, quality) of at most about most_rows labelled documents, chosen by hash of doc_id.

    Rows of labels without doc_id or quality, and doc_ids labelled both ways, are left out; so are documents
    without doc_id.  Of equal doc_ids in docs one row is taken, that of the least text.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(most_rows / n * (1 << 30))))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # about most_rows rows of two numbers


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 40_000) -> Gam:
    """Fit on labelled documents: docs (doc_id, text), labels (doc_id, quality); about most_rows of them, by hash, where there are more."""
    found = text_features(labelled(docs, labels, most_rows), keep=("doc_id", "quality")).dropDuplicates(["doc_id"]).toArrow()
    order = np.argsort(mix64(found["doc_id"].to_numpy().astype(np.uint64)), kind="stable")
    x = np.array(found["features"].to_pylist(), np.float64).reshape(-1, len(FEATURES))[order]
    return fit(x, found["quality"].to_numpy().astype(np.float64)[order])


def score(docs: DataFrame, model: Gam, text: Column | str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if not given) with score (0 to 1, higher: better) and predicted (1 where score >= threshold, else 0).

    A null text counts as empty; a text without bytes has features 0 and is scored like any other.
    Columns of those names in docs are replaced; an empty table gives an empty one.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for c, x in _feature_chunks(batches):
            s = m.score(x)
            yield pa.record_batch([c.column(k) for k in kept] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in kept], text_bytes(text).alias("__bytes")), run, schema)


def op13_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs.where(crc_mod5() != 0), labels.where(crc_mod5() != 0))
    held_out = F.coalesce(crc_mod5() == 0, F.lit(False))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
