"""Scoring by a Brown class-based bigram model.

Word counts come from every training text.  Clustering has two steps:

* Units: each of the `frequent` words is one, every other word belongs to the unit of its last three bytes, where that ending
  is frequent, or else to one shared unit.  Bigram counts of units come from every training text; exchange clustering moves
  units between classes, one at a time, as long as the likelihood of the class bigrams grows.  This is the class that a word,
  seen or not, has as the word before.
* Words: every other training word, however rare, then moves on its own, in Spark: its counts by the class of the word before,
  from all of its occurrences, choose the class in which they are likeliest.  This is the class in which a word is predicted.
  Only words that no training text has are predicted in the class of their unit.

A text's log10 probability is the sum over its tokens (words, then one end) of

    log10 P(class | class of the word before) + log10 P(word | class)

with both parts smoothed by a constant added to each count.  The unit tables are bounded by
`frequent` and `endings`, so the bigram table has at most (frequent + endings + 2) ** 2 cells.
Counts and classes of the `head` most frequent words are sent to the tasks; those of all others are joined.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import chunks, crc_mod5, map_arrow, read, release, stage, text_bytes

ENDING = 3
ADDED = 0.5
ADDED_TRANSITION = 0.1
_FLUSH = 300_000


@dataclass
class Vocabulary:
    """Word to head index; per head index its log10 count and unit; ending to unit.  Unit 0 is the text's end, then come the frequent words."""

    head: dict[bytes, int]
    log_count: np.ndarray
    head_unit: np.ndarray
    ending_unit: dict[bytes, int]
    other: int
    frequent: int

    @property
    def n_units(self) -> int:
        return self.other + 1

    def units(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head index (-1: not in the head) and unit of each word."""
        at = np.fromiter(map(self.head.get, words, itertools.repeat(-1)), np.int64, len(words))
        unit = self.head_unit[at] if len(self.head_unit) else np.full(len(words), -1)
        rest = np.flatnonzero((at < 0) | (unit < 0))
        get = self.ending_unit.get
        unit[rest] = [get(words[i][-ENDING:], self.other) for i in rest.tolist()]
        return at, unit


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    held: Counter = Counter()
    for c in chunks(batches):
        for t in c.texts():
            held.update(_words(t))
        if len(held) > _FLUSH:
            yield out(held)
            held = Counter()
    yield out(held)


def _count_pairs(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        keys, counts, size = [], [], 0
        for c in chunks(batches):
            docs = [_words(t) for t in c.texts()]
            n = np.array([len(d) for d in docs])
            _, unit = v.units(list(itertools.chain.from_iterable(docs)))
            after = np.insert(unit, np.cumsum(n), 0)  # the end of each text
            before = np.concatenate([[0], after[:-1]])
            k, m = np.unique(before * v.n_units + after, return_counts=True)
            keys.append(k)
            counts.append(m)
            size += len(k)
            if size > 4 * _FLUSH:
                k, at = np.unique(np.concatenate(keys), return_inverse=True)
                keys, counts, size = [k], [np.bincount(at, np.concatenate(counts)).astype(np.int64)], len(k)
        if keys:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            m = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            yield pa.record_batch([pa.array(k), pa.array(m)], ["pair", "n"])

    return run


def _count_left(held):
    """(word, left, n): how often a word that is no unit of its own follows each class."""

    def out(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k[:-1] for k in found], pa.binary()), pa.array([k[-1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["word", "left", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, class_of = held.value
        found: Counter = Counter()
        for c in chunks(batches):
            docs = [_words(t) for t in c.texts()]
            n = np.array([len(d) for d in docs])
            flat = list(itertools.chain.from_iterable(docs))
            _, unit = v.units(flat)
            left = class_of[_before(unit, n)].astype(np.uint8).tobytes()
            found.update([flat[i] + left[i : i + 1] for i in np.flatnonzero(unit > v.frequent).tolist()])
            if len(found) > _FLUSH:
                yield out(found)
                found = Counter()
        yield out(found)

    return run


def _before(unit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unit before each word: texts have n words, and the end's unit is before the first."""
    before = np.concatenate([[0], unit[:-1]])[: len(unit)]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    return before


_CLASSED = "word binary, c long, lefts array<struct<left:int,n:long>>, cls int"


def _move(log_transition: np.ndarray, log_class_total: np.ndarray):
    """Put each word into the class in which its occurrences are likeliest; the end's class is for the end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(log_transition)
        for batch in batches:
            lefts = batch.column("lefts")
            row = np.repeat(np.arange(len(batch)), lefts.value_lengths().to_numpy())
            cell, n = lefts.flatten().flatten()
            counts = np.bincount(row * k + cell.to_numpy(), n.to_numpy(), len(batch) * k).reshape(-1, k)
            gain = counts @ log_transition - counts.sum(1, keepdims=True) * log_class_total
            gain[:, 0] = -np.inf
            yield pa.record_batch([batch.column("word"), batch.column("c"), lefts, pa.array(gain.argmax(1), pa.int32())], ["word", "c", "lefts", "cls"])

    return run


def _logs(table: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class | class before), and the log10 of what a class's words share."""
    log_class_total = np.log10(mass + ADDED)
    log_class_total[0] = 0.0  # the end is the only member of its class
    return np.log10((table + ADDED_TRANSITION) / (table.sum(1, keepdims=True) + ADDED_TRANSITION * len(table))), log_class_total


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = 64, sweeps: int = 6) -> np.ndarray:
    """Class of each unit, from the matrix of unit bigram counts; unit 0 (the end) keeps class 0 for itself."""
    n_units = len(pairs)
    classes = max(2, min(classes, n_units))
    left, right = pairs.sum(1), pairs.sum(0)
    order = [u for u in np.argsort(-(left + right), kind="stable").tolist() if u]
    of = np.zeros(n_units, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    one = np.eye(classes)
    table = one[of].T @ pairs @ one[of]
    k = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            own = pairs[u, u]
            row = np.bincount(of, pairs[u], classes)
            col = np.bincount(of, pairs[:, u], classes)
            a = of[u]
            row[a] -= own
            col[a] -= own
            table[a] -= row
            table[:, a] -= col
            table[a, a] -= own
            base = _f(table)
            by_row, by_col = _f(table + row) - base, _f(table + col[:, None]) - base
            gain = by_row.sum(1) - by_row[k, k] + by_col.sum(0) - by_col[k, k] + _f(table[k, k] + row + col + own) - base[k, k]
            n_l, n_r = table.sum(1), table.sum(0)
            # the unit's own pairs raise other marginals equally, whichever class it joins
            gain -= _f(n_l + row.sum() + own + col) - _f(n_l + col) + _f(n_r + col.sum() + own + row) - _f(n_r + row)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += row
            table[:, b] += col
            table[b, b] += own
            moved += b != a
            of[u] = b
        if not moved:
            break
    return of


@dataclass
class BrownModel:
    vocabulary: Vocabulary
    class_of: np.ndarray
    head_class: np.ndarray
    log_transition: np.ndarray
    log_class_total: np.ndarray
    counts: DataFrame
    tokens: int
    distinct: int
    ends: int


def train(docs: DataFrame, frequent: int = 1500, endings: int = 500, head: int = 100_000, classes: int = 64) -> BrownModel:
    """Fit on the texts of docs; a null text is an empty one.  There are at most 256 classes."""
    if classes > 256:
        raise ValueError("a class is one byte")
    spark = docs.sparkSession
    texts = docs.select(text_bytes().alias("text"))
    counts = stage(texts.transform(map_arrow, _count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = docs.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()

    top = counts.orderBy(F.desc("c"), "word").limit(head).toArrow()
    words, c = top["word"].to_pylist(), top["c"].to_numpy()
    names = words[:frequent]
    frequent_words = spark.createDataFrame([(bytearray(w), i + 1) for i, w in enumerate(names)], "word binary, unit int")
    ending = F.when(F.length("word") > ENDING, F.expr(f"substring(word, -{ENDING}, {ENDING})")).otherwise(F.col("word"))
    rest = counts.join(F.broadcast(frequent_words), "word", "left").withColumn("ending", ending)
    common = rest.where(F.col("unit").isNull()).groupBy("ending").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "ending").limit(endings).collect()
    ending_unit = {bytes(r["ending"]): len(names) + 1 + i for i, r in enumerate(common)}
    other = len(names) + 1 + len(ending_unit)
    head_unit = np.full(len(words), -1)
    head_unit[: len(names)] = 1 + np.arange(len(names))
    v = Vocabulary({w: i for i, w in enumerate(words)}, np.log10(c + ADDED), head_unit, ending_unit, other, len(names))

    held = spark.sparkContext.broadcast(v)
    found = texts.transform(map_arrow, _count_pairs(held), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(v.n_units**2)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    pairs = pairs.reshape(v.n_units, v.n_units)
    class_of = exchange(pairs, classes)
    n_classes = int(class_of.max()) + 1
    one = np.eye(n_classes)[class_of]
    table = one.T @ pairs @ one
    n_words = table.sum(0)

    left = texts.transform(map_arrow, _count_left(spark.sparkContext.broadcast((v, class_of))), "word binary, left int, n long")
    lefts = left.repartition("word").groupBy("word", "left").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("c"), F.collect_list(F.struct("left", "n")).alias("lefts"))
    classed = stage(lefts.transform(map_arrow, _move(*_logs(table, n_words)), _CLASSED), "classes")
    # frequent words and the end keep their units' classes, all others count in their own
    table = one.T @ pairs[:, : len(names) + 1] @ one[: len(names) + 1]
    for r in classed.select("cls", F.explode("lefts").alias("x")).groupBy("x.left", "cls").agg(F.sum("x.n").alias("n")).collect():
        table[r["left"], r["cls"]] += r["n"]
    mass = np.bincount(class_of[1 : len(names) + 1], c[: len(names)] + ADDED, n_classes)
    for r in classed.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        mass[r["cls"]] += r["n"] + ADDED * r["v"]
    log_transition, log_class_total = _logs(table, mass)
    # words by count again: those that are no units of their own come in the same order
    own = classed.select("c", "word", "cls").orderBy(F.desc("c"), "word").limit(len(words) - len(names)).toArrow()["cls"].to_numpy() if len(words) > len(names) else []
    head_class = np.concatenate([class_of[1 : len(names) + 1], own]).astype(np.int64)
    release(counts)
    return BrownModel(v, class_of, head_class, log_transition, log_class_total, classed.select("word", "c", "cls"), int(total["n"]) + ends, int(total["v"]) + (ends > 0), ends)


_ROWS = "rid long, word binary, before int, guess int, n long, log_counts double, known long, n_tokens long, by_class double"


def _score(held, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, class_of, head_class, log_step = held.value
        for c in chunks(batches):
            rid = c.column("rid").to_pylist()
            docs = [_words(t) for t in c.texts()]
            flat = list(itertools.chain.from_iterable(docs))
            n = np.array([len(d) for d in docs])
            at, unit = v.units(flat)
            doc = np.repeat(np.arange(len(docs)), n)
            before = class_of[_before(unit, n)]
            last = np.zeros(len(docs), np.int64)  # the class before the end
            last[n > 0] = class_of[unit[np.cumsum(n)[n > 0] - 1]]
            by_class = log_step[last, 0]
            seen = at >= 0
            logs = np.bincount(doc[seen], v.log_count[at[seen]], len(docs)) if seen.any() else np.zeros(len(docs))
            known = np.bincount(doc[seen], minlength=len(docs))
            if seen.any():
                by_class = by_class + np.bincount(doc[seen], log_step[before[seen], head_class[at[seen]]], len(docs))
            rare = Counter(zip(doc[~seen].tolist(), [flat[i] for i in np.flatnonzero(~seen).tolist()], before[~seen].tolist(), class_of[unit[~seen]].tolist()))
            # a text's own row has a key with a space, which no word has: it meets no count and no crowd
            keys = [b" %d" % r for r in rid] + [w for _, w, _, _ in rare]
            rids = rid + [rid[d] for d, _, _, _ in rare]
            pad = np.zeros(len(rare), np.int64)
            yield pa.record_batch(
                [
                    pa.array(rids, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([0] * len(rid) + [b for _, _, b, _ in rare], pa.int32()),
                    pa.array([0] * len(rid) + [g for _, _, _, g in rare], pa.int32()),
                    pa.array([0] * len(rid) + list(rare.values()), pa.int64()),
                    pa.array(np.concatenate([logs, pad])),
                    pa.array(np.concatenate([known, pad])),
                    pa.array(np.concatenate([n + 1, pad])),
                    pa.array(np.concatenate([by_class, pad])),
                    *[pa.concat_arrays([c.column(k), pa.nulls(len(rare), c.column(k).type)]) for k in keep],
                ],
                names=["rid", "word", "before", "guess", "n", "log_counts", "known", "n_tokens", "by_class", *keep],
            )

    return run


def score(docs: DataFrame, model: BrownModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with n_tokens, n_known, base_score and score of each whole text.

    An empty or null text has one token, its end.  base_score is the add-0.5 unigram model over the
    same counts.  With no training text every count is zero.
    """
    log_step = model.log_transition - model.log_class_total
    held = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.class_of, model.head_class, log_step))
    schema = _ROWS + "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *keep, text_bytes().alias("text")).transform(map_arrow, _score(held, list(keep)), schema)
    logs = F.col("log_counts") + F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + ADDED)
    known = F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)
    step = F.get(F.lit(log_step.ravel()), F.col("before") * len(log_step) + F.coalesce("cls", "guess"))
    by_class = F.col("by_class") + F.when(F.col("n") > 0, F.col("n") * step).otherwise(0.0)
    sums = (
        rows.join(model.counts, "word", "left")
        .groupBy("rid")
        .agg(F.sum(logs).alias("logs"), F.sum(known).alias("known"), F.sum("n_tokens").alias("n_tokens"), F.sum(by_class).alias("by_class"), *[F.max(k).alias(k) for k in keep])
    )
    base_total = float(np.log10(model.tokens + ADDED * (model.distinct + 1)))
    end = float(np.log10(model.ends + ADDED))
    return sums.select(
        *keep,
        F.col("n_tokens"),
        (F.col("known") + (1 if model.ends else 0)).alias("n_known"),
        (F.col("logs") + end - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("logs") + F.col("by_class")).alias("score"),
    )


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod5() == 1, F.lit(False)).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    out = score(docs, model, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
