"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Each text gets a vector of transformed statistics.  Per language and source the MCD estimate of
centre and scatter is found by concentration steps: each keeps the `share` of rows nearest to the
current estimate, by Mahalanobis distance, and takes their mean and covariance.  Steps go on until no
determinant falls any more, from three starts: medians and quartile scales, all rows, and the half
nearest to the first; the estimate of least determinant is kept.  A step is one grouped aggregation
of all rows by classes of distance about two percent wide, so no group is ever gathered, and the rows
kept are those of whole classes, which do not depend on how the rows are dealt out.  A text is
rejected when its distance, given its length, exceeds the chi-square quantile; length itself is in the
estimate but is no ground for rejection.

Groups with fewer than `min_group` rows are pooled by language, then over all; a pool of under
`min_group` rows rejects nothing.  A row at the quantile is kept.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Words, chunks, map_arrow, read, release, stage, text_bytes, windows

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Least standard deviation of each entry of the vector; keeps scatter regular where a statistic is constant.
FLOORS = [0.05, 0.03, 0.05, 0.16, 0.11, 0.05]
DIM = len(FLOORS)

_CODE_POINT = np.ones(256, np.int64)
_CODE_POINT[0x80:0xC0] = 0
_CODE_POINT[[0x20, 9, 10, 11, 12, 13]] = 0
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def _row_sums(table: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(table[buf], out=total[1:])
    return np.diff(total[off])


def _repeated_words(w: Words, rows: int) -> np.ndarray:
    """Per row, its words in some 3-word window that the row has twice or more."""
    h, at = windows(w, 3)
    with np.errstate(over="ignore"):
        h = h ^ (w.row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(w.start), bool)
    for k in range(3):
        cover[at[twice] + k] = True
    return np.bincount(w.row[cover], minlength=rows)


def _line_counts(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _count(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "__bytes"):
            w = Words(c.buf, c.off, lower=False)
            lines = np.array([_line_counts(t) for t in c.texts()], np.int64).reshape(-1, 2)
            found = {
                "n_words": np.diff(w.first),
                "word_chars": _row_sums(_CODE_POINT, c.buf, c.off),
                "n_symbols": _row_sums(_SYMBOL, c.buf, c.off),
                "n_dup_lines": lines[:, 1],
                "n_repeat_words": _repeated_words(w, len(c.off) - 1),
                "n_lines": lines[:, 0],
                "n_upper": _row_sums(_UPPER, c.buf, c.off),
            }
            yield pa.record_batch([c.column(k) for k in kept] + [pa.array(found[k].astype(np.int64)) for k in STATS], names=kept + STATS)

    return run


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns `keep` with the counts STATS of each whole text; a null text counts as empty."""
    kept = [c for c in keep if c not in STATS]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(s, T.LongType()) for s in STATS])
    return docs.select(*kept, text_bytes(text).alias("__bytes")).transform(map_arrow, _count(kept), schema)


def _vector() -> list[Column]:
    words, chars = F.col("n_words") + 1.0, F.col("word_chars") + 1.0
    return [
        F.log(words),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1.0)),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_upper") / chars),
    ]


X = [f"x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_ESTIMATE = T.StructType().add("mu", T.ArrayType(T.DoubleType())).add("inv", T.ArrayType(T.DoubleType())).add("var0", T.DoubleType()).add("log_det", T.DoubleType())


@F.pandas_udf(_ESTIMATE)
def _estimate(n: pd.Series, s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
    """Mean, inverse covariance, variance of the first entry and log determinant, from sums and sums of products."""
    out = []
    for m, a, b in zip(n, s1, s2):
        mu = np.array(a) / m
        cov = np.zeros((DIM, DIM))
        cov[np.triu_indices(DIM)] = np.array(b) / m
        cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mu, mu)
        cov += np.diag(np.maximum(np.array(FLOORS) ** 2 - np.diag(cov), 0) + 1e-9)
        out.append((mu.tolist(), np.linalg.pinv(cov, hermitian=True).ravel().tolist(), float(cov[0, 0]), float(np.linalg.slogdet(cov)[1])))
    return pd.DataFrame(out, columns=["mu", "inv", "var0", "log_det"])


def _distance(given_length: bool) -> Column:
    diff = [F.col(x) - F.col("mu")[i] for i, x in enumerate(X)]
    d = sum((diff[i] * diff[j] * F.col("inv")[i * DIM + j] * (1.0 if i == j else 2.0) for i in range(DIM) for j in range(i, DIM)), F.lit(0.0))
    return d - diff[0] * diff[0] / F.col("var0") if given_length else d


def chi_square_quantile(p: float, df: int) -> float:
    """Wilson-Hilferty approximation."""
    return df * (1 - 2 / (9 * df) + NormalDist().inv_cdf(p) * (2 / (9 * df)) ** 0.5) ** 3


def _small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df marked for broadcast where its rows, a few hundred bytes each, have been counted and are few."""
    return F.broadcast(df) if df.count() <= most else df


def _class_of(d: Column, per_octave: int) -> Column:
    return F.floor(F.log2(1.0 + F.greatest(d, F.lit(0.0))) * per_octave)


def _sums(n: Column) -> list[Column]:
    return [F.sum(n).alias("n"), *[F.sum(F.col(x)).alias(x) for x in X], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}_{j}") for i, j in _PAIRS]]


def _estimates(sums: DataFrame, key: list[str]) -> DataFrame:
    e = _estimate("n", F.array(*X), F.array(*[f"p{i}_{j}" for i, j in _PAIRS]))
    return sums.select(*key, e.alias("e")).select(*key, "e.*")


def _step(vectors: DataFrame, now: DataFrame, key: list[str], share: Column) -> DataFrame:
    """The estimates of the share of rows nearest to each estimate in now, taken in whole classes of distance."""
    at = vectors.join(_small(now), key[:-1]).withColumn("class", _class_of(_distance(False), 32))
    classes = at.groupBy(*key, "class").agg(*_sums(F.lit(1)))
    own = Window.partitionBy(*key)
    before = F.sum("n").over(own.orderBy("class").rowsBetween(Window.unboundedPreceding, -1))
    near = classes.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("n").over(own)).where(F.col("before") < share * F.col("all"))
    added = [F.sum(c).alias(c) for c in ("n", *X, *[f"p{i}_{j}" for i, j in _PAIRS])]
    return _estimates(near.groupBy(*key).agg(*added), key)


def mcd_estimates(vectors: DataFrame, group: list[str], share: float = 0.75, most_steps: int = 30) -> DataFrame:
    """MCD estimate (mu, inv, var0, log_det) of each group, with the scale that makes its median distance that of a chi-square.

    A start goes on while its determinant falls by a thousandth; most_steps is far above what that takes.
    """
    key = [*group, "start"]
    # quartiles from counts of values in steps of a thousandth
    tall = vectors.select(*group, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(x, 3).alias("v")) for i, x in enumerate(X)])).alias("s")).select(*group, "s.*")
    quart = tall.groupBy(*group, "i", "v").agg(F.count("*").alias("n")).groupBy(*group, "i").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    wide = quart.groupBy(*group).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(x) for i, x in enumerate(X)])
    var = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(f)) for x, f in zip(X, FLOORS)]
    inv = F.array(*[1 / (var[i] * var[i]) if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)])
    robust = wide.select(*group, F.array(*[F.col(x)[1] for x in X]).alias("mu"), inv.alias("inv"), (var[0] * var[0]).alias("var0"))
    plain = _estimates(vectors.withColumn("start", F.lit(1)).groupBy(*key).agg(*_sums(F.lit(1))), key)
    starts = [robust.withColumn("start", F.lit(0)), plain, robust.withColumn("start", F.lit(2))]
    columns = ["mu", "inv", "var0", "log_det"]
    now = stage(reduce(DataFrame.unionByName, [x.withColumn("log_det", F.lit(float("inf"))).select(*key, *columns) for x in starts]), "mcd")
    written, done = [now], []
    for turn in range(most_steps):
        then = _step(vectors, now, key, F.when(F.col("start") == 2, 0.5).otherwise(share) if turn == 0 else F.lit(share))
        falls = F.col("t.log_det") < F.col("log_det") - 1e-3
        moved = now.join(then.select(*key, F.struct(*columns).alias("t")), key).select(*key, *[F.when(falls, F.col(f"t.{c}")).otherwise(F.col(c)).alias(c) for c in columns], falls.alias("falls"))
        if turn == 0:  # the half is a way to start, its determinant no measure of the share
            moved = moved.withColumn("log_det", F.when(F.col("start") == 2, float("inf")).otherwise(F.col("log_det")))
        moved = stage(moved, "mcd")
        written.append(moved)
        done.append(moved.where("not falls").select(*key, *columns))
        now = moved.where("falls").select(*key, *columns)
        if not now.take(1):
            break
    now = reduce(DataFrame.unionByName, [*done, now])
    best = now.groupBy(*group).agg(F.min(F.struct("log_det", "start", "mu", "inv", "var0")).alias("e")).select(*group, "e.mu", "e.inv", "e.var0", "e.log_det")
    best = stage(best, "mcd")
    release(*written)
    fine = 256
    middle = vectors.join(_small(best), group).groupBy(*group, _class_of(_distance(True), fine).alias("class")).agg(F.count("*").alias("n")).groupBy(*group).agg(F.percentile("class", F.lit(0.5), F.col("n")).alias("mid"))
    mid = F.pow(F.lit(2.0), (F.col("mid") + 0.5) / fine) - 1.0
    scaled = stage(best.join(middle.withColumn("scale", F.greatest(mid / chi_square_quantile(0.5, DIM - 1), F.lit(1.0))), group), "mcd")
    release(best)
    return scaled


_OWN = ("base_failed", "distance", "kept", "mu", "inv", "var0", "log_det", "mid", "scale", "g1", "g2", "n", "m", "start", "class", "before", "all", "__lang", "__source", "__group2")


def quality_rules(stats: DataFrame, min_words: int = 50, min_group: int = 100, alpha: float = 1e-6, share: float = 0.75) -> DataFrame:
    """stats (from text_statistics, with lang and source) with base_failed, distance and kept.

    Null languages and sources are groups of their own.  distance is null where a row failed the base
    rule or had no group large enough; such rows are kept unless the base rule fails them.  Columns of stats with the names
    of the result's or of internal ones (x0, mu, g1, n and the like) are not kept.
    """
    ids = [c for c in stats.columns if c not in {*_OWN, *X}]
    stats = stats.select(*[F.col(f"`{c}`") for c in ids])
    words = F.col("n_words")
    base = (words < min_words) | (100 * F.col("n_repeat_words") > 50 * words)
    key = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in ("lang", "source")]
    base_rows = stage(stats.withColumn("base_failed", base).withColumns(dict(zip(X, _vector()))).withColumns({"__lang": key[0], "__source": key[1]}), "quality")

    good = base_rows.where(~F.col("base_failed"))
    sizes = good.groupBy("__lang", "__source").agg(F.count("*").alias("n"))
    pooled = sizes.withColumn("__group2", F.when(F.col("n") >= min_group, F.col("__source")).otherwise(F.lit("")))
    by_lang = pooled.groupBy("__lang", "__group2").agg(F.sum("n").alias("m"))
    placed = pooled.join(by_lang, ["__lang", "__group2"]).select(
        "__lang", "__source", F.when(F.col("m") >= min_group, F.col("__lang")).otherwise(F.lit("")).alias("g1"), F.when(F.col("m") >= min_group, F.col("__group2")).otherwise(F.lit("")).alias("g2"), "n"
    )
    total = placed.groupBy("g1", "g2").agg(F.sum("n").alias("m")).where(F.col("m") >= min_group)
    placed = stage(placed.join(total, ["g1", "g2"]).select("__lang", "__source", "g1", "g2"), "groups")

    vectors = good.join(_small(placed), ["__lang", "__source"]).select("g1", "g2", *X)
    found = mcd_estimates(vectors, ["g1", "g2"], share)
    cut = chi_square_quantile(1 - alpha, DIM - 1)
    judged = base_rows.join(_small(placed.join(_small(found), ["g1", "g2"])), ["__lang", "__source"], "left")
    distance = F.when(~F.col("base_failed"), F.sqrt(F.greatest(_distance(True) / F.col("scale"), F.lit(0.0))))
    kept = ~F.col("base_failed") & F.coalesce(distance <= float(np.sqrt(cut)), F.lit(True))
    return judged.select(*stats.columns, "base_failed", distance.alias("distance"), kept.alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(text_statistics(read(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
