"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Texts are lower-cased; words are runs of letters, digits and non-ASCII characters.  Passages are windows of twice the
longest item's length, one starting at every item length, so each item that a text holds lies whole
in some passage.  Scores are BM25 of the item for the passage's distinct words, divided by the item's
score for itself; all (passage, item) pairs at or above `threshold` are retrieved, by block-max WAND:

* Each item's most common words, up to half the threshold in weight, are its non-essential postings:
  alone they cannot lift it to the threshold.  A passage is looked at only through essential postings.
* Items lie in blocks of `block` by number.  A block is skipped for a passage unless the block's
  highest impacts of the passage's essential words, plus the block's highest non-essential rest,
  reach the threshold.
* The items of blocks left are scored in full.

A pair retrieved is a leak when at least `overlap` of the three-word runs of the item's question (all
but its last sentence) and of its answer (the last sentence; of a single one, the last third) occur
in the passage or within an item's length of it.

Items with fewer than `min_words` words are not scored: a text that holds their words in a row leaks them, with score
and overlaps 1.  Those of a word or two may be there by chance.
The index goes to every task, so its items are cut into slices of at most `slice_bytes` of text; each slice is one
more pass over the documents.  Number, mean and highest length of the items and the words' item counts are those of
the whole benchmark in every slice, so slices change no result.
"""

from __future__ import annotations

import bisect
import itertools
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cairn.llm.common import Chunk, chunks, map_arrow, read, release, stage, text_bytes

K1, B = 1.2, 0.75
#: Postings whose bounds are added up at a time, some 60 bytes each.
ENTRIES = 1 << 19
_TO_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _lower() -> Column:
    return text_bytes(F.lower(F.col("text").cast("string")))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def _runs(words: list, n: int = 3) -> list[tuple]:
    n = min(n, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    parts = [w for w in map(words_of, re.split(rb"[.!?\n]+", text)) if w]
    if len(parts) > 1:
        return list(itertools.chain.from_iterable(parts[:-1])), parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for every i, side by side."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class Index:
    """Postings of the items with impacts as shares of each item's own score, in blocks; and the short items by first word.

    whole: number, mean and highest length, and words' item counts of all items of min_words words or more; else of these.
    Words are numbered and all else is arrays, some 20 bytes a posting, as every task holds an index.
    """

    def __init__(self, items: list[tuple[object, bytes]], threshold: float, block: int, min_words: int, whole: tuple[int, float, int, dict[bytes, int]] | None = None):
        split = [(k, *question_and_answer(t)) for k, t in items]
        long = [x for x in split if len(x[1]) + len(x[2]) >= min_words]
        few = [x for x in split if 0 < len(x[1]) + len(x[2]) < min_words]
        self.ids = [k for k, _, _ in long + few]
        self.threshold, self.block, self.term = threshold, block, {}
        number = lambda words: [self.term.setdefault(w, len(self.term)) for w in words]
        words = [q + a for _, q, a in long]
        n_items, mean, self.length, df = whole or (len(long), sum(map(len, words)) / max(1, len(long)), max(map(len, words), default=1), Counter(itertools.chain.from_iterable(map(set, words))))
        self.words = np.array([t for w in words for t in number(w)], np.int32)
        self.begin = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self.answer = self.begin[:-1] + np.array([len(q) for _, q, _ in long], np.int64)
        self.short: dict[int, dict[int, dict[tuple, list[int]]]] = {}
        for i, (_, q, a) in enumerate(few, len(long)):
            w = number(q + a)
            self.short.setdefault(w[0], {}).setdefault(len(w), {}).setdefault(tuple(w), []).append(i)
        self.n_terms, self.n_blocks = len(self.term), -(-len(long) // block)
        self.rest = np.zeros(self.n_blocks)
        term, item, impacts, essential = array("i"), array("i"), array("d"), array("b")
        for i, w in enumerate(words):
            raw = {}
            for t, n in Counter(w).items():
                idf = np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5))
                raw[t] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean))
            own, rest = sum(raw.values()), 0.0
            for t in sorted(raw, key=lambda t: (-df[t], t)):
                impact = float(raw[t] / own)
                light = rest + impact < threshold / 2
                rest += impact if light else 0.0
                term.append(self.term[t])
                item.append(i)
                impacts.append(impact)
                essential.append(not light)
            self.rest[i // block] = max(self.rest[i // block], rest)
        term, item, impacts, essential = (np.array(x) for x in (term, item, impacts, essential))
        key = (item // block).astype(np.int64) * self.n_terms + term
        order = np.lexsort((item, key))
        self.key, self.item, self.impact = key[order], item[order].astype(np.int32), impacts[order]
        # the highest impact of each word in each block where it is essential, in order of word and block
        at = np.flatnonzero(essential)
        at = at[np.lexsort((item[at] // block, term[at]))]
        new = np.flatnonzero(np.diff(key[at], prepend=-1))
        self.first = np.searchsorted(term[at][new], np.arange(self.n_terms + 1))
        self.blocks = (item[at][new] // block).astype(np.int32)
        self.top = np.maximum.reduceat(impacts[at], new) if len(new) else np.zeros(0)

    def terms(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.term.get, words, itertools.repeat(-1)), np.int64, len(words))

    def passages(self, term: np.ndarray, n_words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, start, end, block) of the passages whose block bound reaches the threshold; rows lie side by side in term.

        Bounds are added up for a run of passages at a time, of about ENTRIES postings or one passage, whatever the text's length.
        """
        at = np.flatnonzero(term >= 0)
        count = self.first[term[at] + 1] - self.first[term[at]]
        at, count = at[count > 0], count[count > 0]
        step = self.length
        begin = np.concatenate([[0], np.cumsum(n_words)])
        row = np.searchsorted(begin, at, "right") - 1
        base = np.concatenate([[0], np.cumsum(n_words // step + 1)])
        inner = (at - begin[row]) // step
        passage, total, s, low = base[row] + inner, np.cumsum(count), 0, 0
        while s < len(at):
            e = max(s + 1, int(np.searchsorted(total, total[s] - count[s] + ENTRIES, "right")))
            high = passage[e - 1]
            e, beyond = np.searchsorted(passage, [high, high + 1], "right").tolist()
            # a word counts for the passage that starts at its step and for the one a step before, which reaches over it
            also = np.arange(s, beyond)
            also = also[(inner[also] > 0) & (passage[also] > low)]
            which = np.concatenate([np.arange(s, e), also])
            entry = _ranges(self.first[term[at[which]]], count[which])
            key = np.repeat(np.concatenate([passage[s:e], passage[also] - 1]), count[which]) * self.n_blocks + self.blocks[entry]
            found, inv = np.unique(key, return_inverse=True)
            block = found % self.n_blocks
            ok = np.bincount(inv, self.top[entry]) + self.rest[block] >= self.threshold - 1e-9
            for w, b in zip((found // self.n_blocks)[ok].tolist(), block[ok].tolist()):
                r = int(np.searchsorted(base, w, "right")) - 1
                start = int(begin[r]) + (w - int(base[r])) * step
                yield r, start, min(start + 2 * step, int(begin[r + 1])), b
            s, low = e, high + 1

    def scores(self, term: np.ndarray, block: int) -> np.ndarray:
        """Score of each item of a block for the passage of these words."""
        have = np.unique(term)
        key = block * self.n_terms + have[have >= 0]
        lo = np.searchsorted(self.key, key, "left")
        at = _ranges(lo, np.searchsorted(self.key, key, "right") - lo)
        return np.bincount(self.item[at] - block * self.block, self.impact[at], self.block)

    def leaks(self, words: list[bytes], n_words: np.ndarray, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item) to the highest (score, question overlap, answer overlap)."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        begin, term = np.concatenate([[0], np.cumsum(n_words)]).tolist(), self.terms(words)
        for row, start, end, b in self.passages(term, n_words):
            score, near = self.scores(term[start:end], b), None
            for j in np.flatnonzero(score >= self.threshold - 1e-9).tolist():
                i = b * self.block + j
                if near is None:
                    around = term[max(begin[row], start - self.length) : min(begin[row + 1], end + self.length)].tolist()
                    near = {n: set(_runs(around, n)) for n in (1, 2, 3)}
                cut = self.begin[i], self.answer[i], self.begin[i + 1]
                parts = [_runs(self.words[x:y].tolist()) for x, y in zip(cut, cut[1:])]
                q, a = (sum(r in near[len(r)] for r in part) / len(part) if part else 1.0 for part in parts)
                if q >= overlap and a >= overlap:
                    out[row, i] = max(out.get((row, i), (0.0, 0.0, 0.0)), (float(score[j]), q, a))
        if self.short:
            begins = np.zeros(self.n_terms + 1, bool)
            begins[list(self.short)] = True
            for at in np.flatnonzero(begins[term]).tolist():
                row = bisect.bisect_right(begin, at) - 1
                for n, known in self.short[int(term[at])].items():
                    if at + n <= begin[row + 1]:
                        for i in known.get(tuple(term[at : at + n].tolist()), ()):
                            out[row, i] = (1.0, 1.0, 1.0)
        return out


def _count_words(items: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Of the items (part, text) with at least min_words words: (n_words), and (part, word) for each distinct word of each."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            n = [len(words_of(t)) for t in c.texts()]
            yield pa.record_batch([pa.array([x for x in n if x >= min_words], pa.int64())], names=["n_words"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            rows = [(p, w) for p, t in zip(c.column("part").to_pylist(), c.texts()) if len(all_words := words_of(t)) >= min_words for w in set(all_words)]
            yield pa.record_batch([pa.array([p for p, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.binary())], names=["part", "word"])

    return items.transform(map_arrow, lengths, "n_words long"), items.transform(map_arrow, distinct, "part long, word binary")


def _indexes(benchmark: DataFrame, threshold: float, block: int, min_words: int, slice_bytes: int) -> Iterator[Index]:
    """Indexes over slices of the items (item_id, text), each of bounded size, with counts over all items."""
    b = benchmark.select("item_id", _lower().alias("text"))
    total = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-int(total) // slice_bytes) or 1
    b = b.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("long"))
    lengths, words = _count_words(b.select("part", "text"), min_words)
    n_items, n_words, length = lengths.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.max("n_words"), F.lit(1))).first()
    counts = stage(words.groupBy("word").agg(F.count("*").alias("df"), F.collect_set("part").alias("parts")), "benchmark-words")
    for k in range(n):
        part = b.where(F.col("part") == k).orderBy("item_id", "text").toArrow()
        own = counts.where(F.array_contains("parts", F.lit(k).cast("long"))).select("word", "df").toArrow()
        df = dict(zip(own["word"].to_pylist(), own["df"].to_pylist()))
        yield Index(list(zip(part["item_id"].to_pylist(), part["text"].to_pylist())), threshold, block, min_words, (n_items, n_words / max(1, n_items), length, df))
    release(counts)


def _words_of_chunk(c: Chunk) -> tuple[list[bytes], np.ndarray]:
    docs = [words_of(t) for t in c.texts()]
    return list(itertools.chain.from_iterable(docs)), np.array([len(d) for d in docs], np.int64)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5, overlap: float = 0.5, block: int = 16, min_words: int = 5, slice_bytes: int = 16 << 20) -> DataFrame:
    """The columns `keep` of docs with item_id, score, question_overlap and answer_overlap, one row per text and item leaked.

    Null and empty texts leak nothing, on either side; a repeated row of docs is reported each time.
    Columns of docs with the names of the result's own are not kept.
    """
    item = benchmark.schema["item_id"]
    added = [item] + [T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]
    kept = [c for c in keep if c not in [f.name for f in added]]
    schema = T.StructType([docs.schema[c] for c in kept] + added)
    source, out = docs.select(*kept, _lower().alias("__bytes")), None
    for index in _indexes(benchmark, threshold, block, min_words, slice_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for c in chunks(batches, "__bytes"):
                found = index.leaks(*_words_of_chunk(c), overlap)
                if found:
                    rows = pa.array([r for r, _ in found], pa.int64())
                    values = np.array(list(found.values()))
                    first = [c.column(k).take(rows) for k in kept]
                    yield pa.record_batch([*first, pa.array([index.ids[i] for _, i in found]).cast(to_arrow_type(item.dataType)), *[pa.array(values[:, j]) for j in range(3)]], names=[f.name for f in schema])

        part = source.transform(map_arrow, search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, block: int = 16, min_words: int = 5, slice_bytes: int = 16 << 20) -> DataFrame:
    """docs without the rows whose text leaks an item; all columns stay."""
    schema = docs.schema
    for index in _indexes(benchmark, threshold, block, min_words, slice_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for c in chunks(batches, "__bytes"):
                bad = {r for r, _ in held.value.leaks(*_words_of_chunk(c), overlap)}
                rows = pa.array([r for r in range(len(c.off) - 1) if r not in bad], pa.int64())
                yield pa.record_batch([c.column(f.name).take(rows) for f in schema], names=[f.name for f in schema])

        docs = docs.select("*", _lower().alias("__bytes")).transform(map_arrow, clean, schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
