"""Phrase collocations: phrases that are more frequent than their parts explain, per language.

1. Every task counts the hashes of all phrases of up to `most_words` words into a count-min sketch of two
   rows; the tasks' cells are added by block, and a bit a cell says whether its bound reaches `min_count`.
   A bound is never below the true count, so no frequent phrase is lost.
2. Every task cuts its texts into shards.  The phrases of a shard whose bound, and that of each of their
   parts, reaches `min_count` are compiled into one automaton a language, each between guards of one
   space; scanning the shard counts all occurrences, overlapping ones too.  So an automaton follows its
   shard and never the corpus.
3. Counts are summed over shards; only then do thresholds apply.  Scores are joins and aggregations.

The sketch has at most 2 * `most_cells` cells: a byte each in a task, a bit each where it is broadcast
(16 MB).  In a corpus far beyond that, more rare phrases pass it and are counted and dropped; no count changes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import CHUNK_BYTES, Words, map_arrow, mix64, read, release, stage, text_bytes

#: Language of texts without one.
NO_LANG = "und"
#: Characters that end a piece; \n, vertical tab, form feed and \r too.
STOPS = b".,;:!?"
#: Texts of a task are scanned in shards of about so many bytes, and a task reads about so many where inputs are small.
SHARD_BYTES, TASK_BYTES = 4 << 20, 32 << 20
BLOCK_CELLS = 1 << 16
#: Counts of at least a total / HOT are broadcast: phrases of k words occur at most n times, so there are at most most_words * HOT.
HOT = 1000
#: Parts that rank on their own before a language's phrases meet in one place.
SALTS = 64

_U = np.uint64
_STEPS = mix64(np.arange(101, 133, dtype=np.uint64)) | _U(1)
_FOLD = bytes(10 if b in STOPS or 10 <= b <= 13 else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


# ---------------------------------------------------------------- phrases of a block


class Phrases:
    """Phrases of up to `most` words in a folded block of bytes; hash[k - 1][i] is the one of k words from word i on.

    at[k - 1] lists the words i from which k words lie in one piece.
    """

    __slots__ = ("block", "start", "end", "hash", "at")

    def __init__(self, block: bytes, most: int, seed: int):
        buf = np.frombuffer(block, np.uint8)
        words = Words(buf, np.array([0, len(buf)]), lower=False)
        self.block, self.start, self.end = block, words.start, words.end
        piece = np.cumsum(buf == 10)[words.start]
        n, self.hash, self.at = len(words.start), [], []
        with np.errstate(over="ignore"):
            total = np.full(n, seed, np.uint64)
            for k in range(1, most + 1):
                m = max(n - k + 1, 0)
                total = total[:m] + words.hash[k - 1 :][:m] * _STEPS[k]
                self.hash.append(mix64(total + _U(k)))
                self.at.append(np.flatnonzero(piece[:m] == piece[k - 1 :][:m]))


def _seed(lang: str) -> int:
    """A number of the language's name that every worker gives alike."""
    h = 1469598103934665603
    for b in lang.encode():
        h = ((h ^ b) * 1099511628211) & ((1 << 64) - 1)
    return h


def _cells(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in either row; the second row lies behind the first."""
    mask = _U(width - 1)
    return (h & mask).astype(np.int64), ((h >> _U(32)) & mask).astype(np.int64) + width


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Per shard, folded blocks of about a megabyte by language; a longer text is a block of its own."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            blocks = held.setdefault(lang, [[], 0])
            text = text.as_py().translate(_FOLD)
            if not blocks[0] or blocks[1] + len(text) > CHUNK_BYTES:
                blocks[0].append([])
                blocks[1] = 0
            blocks[0][-1].append(text)
            blocks[1] += len(text) + 1
            size += len(text) + 1
            if size >= SHARD_BYTES:
                yield {g: [b"\n".join(b) for b in bs] for g, (bs, _) in held.items()}
                held, size = {}, 0
    if held:
        yield {g: [b"\n".join(b) for b in bs] for g, (bs, _) in held.items()}


# ---------------------------------------------------------------- the sketch


def _sketch_rows(most: int, width: int):
    schema = pa.schema([("block", pa.int32()), ("dense", pa.bool_()), ("data", pa.binary())])

    def run(batches):
        cells = np.zeros(2 * width, np.uint8)
        for shard in _shards(batches):
            for lang, blocks in shard.items():
                for block in blocks:
                    p = Phrases(block, most, _seed(lang))
                    h = np.concatenate([h[at] for h, at in zip(p.hash, p.at)])
                    at, count = np.unique(np.concatenate(_cells(h, width)), return_counts=True)
                    cells[at] = np.minimum(cells[at] + count, 255)
        for b in range(0, 2 * width, BLOCK_CELLS):
            part = cells[b : b + BLOCK_CELLS]
            used = np.flatnonzero(part)
            if len(used):
                dense = 3 * len(used) > len(part)
                data = part.tobytes() if dense else used.astype("<u2").tobytes() + part[used].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK_CELLS], pa.int32()), pa.array([dense]), pa.array([data], pa.binary())], schema=schema)

    return run


def _merge_rows(min_count: int, size: int):
    schema = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def run(batches):
        sums = {}
        for batch in batches:
            for block, dense, data in zip(*(c.to_pylist() for c in batch.columns)):
                cells = sums.setdefault(block, np.zeros(size, np.uint32))
                if dense:
                    cells += np.frombuffer(data, np.uint8)
                else:
                    n = len(data) // 3
                    cells[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, np.uint8, n, 2 * n)
                np.minimum(cells, min_count, out=cells)
        for block, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(cells >= min_count, bitorder="little").tobytes()], pa.binary())], schema=schema)

    return run


def sketch(texts: DataFrame, most_words: int, min_count: int, width: int) -> np.ndarray:
    """Bits of the cells whose count reaches min_count (at most 255); both rows, 2 * width bits."""
    if not 1 <= min_count <= 255:
        raise ValueError("the sketch counts to 255")
    size = min(BLOCK_CELLS, 2 * width)
    rows = map_arrow(texts, _sketch_rows(most_words, width), "block int, dense boolean, data binary")
    merged = map_arrow(rows.repartition(max(1, 2 * width // size // 128), "block"), _merge_rows(min_count, size), "block int, bits binary")
    bits = np.zeros(2 * width // 8, np.uint8)
    for block, data in merged.collect():  # 2 * width bits in all
        bits[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(data, np.uint8)
    return bits


# ---------------------------------------------------------------- automata over shards


def _frequent(p: Phrases, bits: np.ndarray, width: int) -> list[np.ndarray]:
    """Per number of words, the first words of phrases whose bound and whose parts' bounds reach the threshold."""
    out, below = [], None
    for h, at in zip(p.hash, p.at):
        if below is not None:
            at = at[below[at] & below[at + 1]]
        if len(at):
            a, b = _cells(h[at], width)
            at = at[((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1) == 1]
        below = np.zeros(len(h) + 1, bool)
        below[at] = True
        out.append(at)
    return out


def _guarded(block: bytes) -> str:
    """The block with one space around every word and a break between pieces, a character a byte."""
    return (b" " + re.sub(rb"  +", b" ", re.sub(rb" *\n[ \n]*", b" \n ", block)) + b" ").decode("latin-1")


def _phrase(block: bytes, start: int, end: int) -> bytes:
    return b" ".join(block[start:end].split())


def count_shard(blocks: list[bytes], lang: str, most: int, bits: np.ndarray, width: int) -> tuple[int, dict[bytes, int], np.ndarray]:
    """All words, and the candidates of the blocks with the number of words in each and how often each occurs."""
    words, hashes, places = 0, [], []
    for i, block in enumerate(blocks):
        p = Phrases(block, most, _seed(lang))
        words += len(p.start)
        for k, at in enumerate(_frequent(p, bits, width), 1):
            hashes.append(p.hash[k - 1][at])
            places.append(np.stack([np.full(len(at), i), p.start[at], p.end[at + k - 1], np.full(len(at), k)], 1))
    h, place = np.concatenate(hashes), np.concatenate(places)
    if not len(h):
        return words, {}, np.zeros(0, np.int64)
    _, first = np.unique(h, return_index=True)
    for chosen in (place[first], place):  # all places only if two phrases share a hash
        phrases = {}
        for i, s, e, k in chosen.tolist():
            phrases.setdefault(_phrase(blocks[i], s, e), k)
        found = _scan(blocks, phrases)
        if found.sum() == len(h):
            break
    return words, phrases, found


def _scan(blocks: list[bytes], phrases: dict[bytes, int]) -> np.ndarray:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase.decode('latin-1')} ", i)
    automaton.make_automaton()
    found = np.zeros(len(phrases), np.int64)
    for block in blocks:
        found += np.bincount(np.fromiter((i for _, i in automaton.iter(_guarded(block))), np.int32), minlength=len(phrases))
    return found


def _count_rows(most: int, width: int, shared):
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("bytes", pa.binary()), ("f", pa.int64())])

    def run(batches):
        bits = shared.value
        for shard in _shards(batches):
            for lang, blocks in shard.items():
                words, phrases, found = count_shard(blocks, lang, most, bits, width)
                f = pa.array(np.concatenate([[words], found]), pa.int64())
                k = pa.array([0, *phrases.values()], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), k, pa.array([b"", *phrases], pa.binary()), f], schema=schema)

    return run


def phrase_counts(docs: DataFrame, most_words: int = 3, min_count: int = 10, most_cells: int = 1 << 26) -> DataFrame:
    """(lang, words, phrase, f): every phrase of 1 to most_words words that occurs min_count times or more; words 0: all words of lang.

    A staged table.  docs needs lang and text; null lang is `und`, null text is empty.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    width = min(most_cells, 1 << max(16, (size // 2).bit_length()))
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), text_bytes().alias("text"))
    texts = texts.coalesce(max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES))
    shared = spark.sparkContext.broadcast(sketch(texts, most_words, min_count, width))
    parts = map_arrow(texts, _count_rows(most_words, width, shared), "lang string, words int, bytes binary, f long")
    sums = parts.groupBy("lang", "words", F.col("bytes").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    out = stage(sums.where(F.col("f") >= F.when(F.col("words") == 0, 1).otherwise(min_count)), "phrases")
    shared.unpersist()
    return out


# ---------------------------------------------------------------- scores


def _with_count(df: DataFrame, counts: DataFrame, part: str, name: str, hot: float) -> DataFrame:
    """df with the count of the phrase in column part; frequent ones, which many phrases hold, are broadcast."""
    known = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(name))
    on = (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_phrase"))
    often = df.join(F.broadcast(known.where(F.col(name) >= hot)), on, "left").drop("_lang", "_phrase")
    rest = often.where(F.col(name).isNull()).drop(name).join(known.where(F.col(name) < hot), on).drop("_lang", "_phrase")
    return often.where(F.col(name).isNotNull()).unionByName(rest)


def collocations(docs: DataFrame, most_words: int = 3, min_count: int = 10, inside_pct: int = 50, top: int = 2000, most_cells: int = 1 << 26) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at `.,;:!?` and line ends, pieces into words at spaces
    and tabs; phrases lie within a piece.  A candidate has 2 to most_words words and a >= min_count
    occurrences, overlapping ones counted; it is dropped where a longer candidate that holds its words has
    100 * f >= inside_pct * a.  Each cut gives floor(10**6 * a * a / (l * r)); the lowest counts, of equal
    ones the first.  Order: score and a descending, phrase by bytes; so ties have one order.

    Null text or one without words adds nothing; null lang is `und`; equal rows count each; without
    candidates, and without rows, the result is empty.  Other columns of docs are not looked at.
    Numbers are exact while a < 10**15 (decimals of 38 digits); beyond that the query fails and returns nothing wrong.
    """
    counts = phrase_counts(docs, most_words, min_count, most_cells)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    hot = max((counts.where("words = 0").agg(F.sum("f")).first()[0] or 0) / HOT, 1)
    known = counts.where("words > 0")
    candidates = known.where("words > 1").withColumnRenamed("f", "a")
    inner = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    longer = candidates.where("words > 2").select("lang", F.explode(F.expr(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where((F.col("longer") * 100 < F.col("a") * inside_pct) | F.col("longer").isNull()).drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = stage(cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring_index(phrase, ' ', cut - words)")), "cuts")
    halves = stage(_with_count(cuts, known, "left", "l", hot), "halves")
    both = _with_count(halves, known, "right", "r", hot)
    score = F.expr("(cast(a as decimal(16)) * cast(a as decimal(16)) * 1000000) div (cast(l as decimal(19)) * cast(r as decimal(19)))")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), F.col("cut"), F.col("l"), F.col("r"))).alias("best"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = stage(rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")), "collocations")
    release(counts, cuts, halves)
    return out


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for op11_collocations."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents
), listed AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed),
grams AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM starts, (VALUES (1), (2), (3)) t(k) WHERE i + k - 1 <= len(ws)
), counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k >= 2 AND f >= 10),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3
  ) GROUP BY ALL
), kept AS (SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(c.ws[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(c.ws[cut + 1 : c.k], ' ')
), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM least JOIN totals USING (lang) QUALIFY rank <= 2000
"""
