"""Token ids in a Re-Pair compressed file format with random access.

Texts are encoded in doc_id order, the end id after each, and cut into shards of about `shard_ids` ids
that hold whole documents.  In each shard the most frequent pairs of neighbouring symbols are replaced
by new ones, and again in the result, until no pair occurs `min_count` times or two bytes name no more
symbols; a turn replaces many pairs at once, so it costs a few passes over the shard.  Pairs never
span the end id, so a symbol never spans documents.

A file is Parquet with a row per shard: part and seq give its place, start the ids before it in its
part, doc_ids and doc_ends its documents and where each ends, rules the pairs (symbol `first_rule` + i
stands for pair i), lengths how many ids each rule expands to, sequence what is left, the last three
little-endian unsigned of `width` bytes (lengths: 4).  With running sums of expansion lengths, one
document's ids are decoded without the rest.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import chunks, map_arrow, read, stage, text_bytes

END = 1
_CACHED = 600_000
_TWO_BYTES = 1 << 16
#: Signs that form a token of their own behind letters.
_SIGNS = b"#$%&*!|;:?)"
_CODERS: dict[str, WordCoder] = {}
#: Bytes before a stop or comma that part it from what it follows: white space, ASCII letters and digits; and two-byte letters,
#: by lead and last byte: U+00C0 to U+017F without the two signs there and the dotted I, which the vocabulary reads as two.
_BEFORE_STOP = np.zeros(256, bool)
_BEFORE_STOP[[9, 10, 11, 12, 13, 32, *range(48, 58), *range(97, 123)]] = True
_LETTERS = np.zeros((256, 256), bool)
_LETTERS[0xC3:0xC6, 0x80:0xC0] = True
_LETTERS[[0xC3, 0xC3, 0xC4], [0x97, 0xB7, 0xB0]] = False


class WordCoder:
    """Encodes texts word by word, which the vocabulary's rules allow: white space always parts tokens.

    The vocabulary ignores case, so ASCII is lower-cased first.  Stops and commas are parted from the
    letter or digit before them, as its rules do; a text that has one behind anything else, with which
    it may form one token, keeps its words whole.  A text with a special token's string, whatever its
    case, or with combining marks, which compose with some letters of one case only, is encoded at
    once.  Words are remembered, those in use longest, so each worker encodes most words once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level form: bytes that do not print as Latin-1 stand for characters from 256 on
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_form = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printing)}
        self.signs: dict[bytes, bytes] = {}
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordCoder:
        if path not in _CODERS:
            _CODERS[path] = cls(path)
        return _CODERS[path]

    @staticmethod
    def _kinds(texts: list[bytes]) -> tuple[list[bool], list[bool]]:
        """Per text, whether its stops and commas all follow white space, plain letters or digits; and whether it has combining marks."""
        off = np.cumsum([0] + [len(t) + 1 for t in texts])
        buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        at = np.flatnonzero((buf == 46) | (buf == 44))
        before, lead = np.where(at > 0, buf[at - 1], 32), np.where(at > 1, buf[at - 2], 32)
        plain = _BEFORE_STOP[before] | _LETTERS[lead, before]
        rows = len(texts)
        odd = np.bincount(np.searchsorted(off, at[~plain], "right") - 1, minlength=rows)[:rows]
        marks = np.bincount(np.searchsorted(off, np.flatnonzero((buf == 0xCC) | (buf == 0xCD)), "right") - 1, minlength=rows)[:rows]
        return (odd == 0).tolist(), (marks > 0).tolist()

    def _form(self, word: bytes) -> str | None:
        """The word as the vocabulary spells it, if it is of letters that the normaliser leaves alone and the pre-tokeniser keeps together."""
        if word.isascii():
            return word.decode() if word.isalpha() else None
        s = word.decode("utf-8", "replace")
        return word.decode("latin-1").translate(self.byte_form) if s.isalpha() and max(s) < "\u0250" and s.lower() == s and is_normalized("NFC", s) else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words: those of letters by the vocabulary's merges alone, with signs behind them as two."""
        tokenize, rest = self.tokenizer.model.tokenize, []
        for w in words:
            letters = w.rstrip(_SIGNS)
            form = self._form(letters) if letters else None
            if form is None:
                rest.append(w)
                continue
            signs = w[len(letters) :]
            if signs not in self.signs:
                if len(self.signs) > _CACHED:
                    self.signs.clear()
                self.signs[signs] = self._whole([signs.decode()])[0]
            self.ids[w] = array("I", [t.id for t in tokenize(form)]).tobytes() + self.signs[signs]
        self.ids.update(zip(rest, self._whole([w.decode("utf-8", "replace") for w in rest])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text with the end id, as little-endian unsigned 32-bit integers."""
        lower = [t.lower() for t in texts]
        parted, marked = self._kinds(lower)
        at_once = [m or any(s in t for s in self.special) for t, m in zip(lower, marked)]
        docs = [[] if o else (t.replace(b".", b" .").replace(b",", b" ,") if p else t).split() for t, p, o in zip(lower, parted, at_once)]
        if len(self.ids) > _CACHED:
            self.ids, self.older = {}, self.ids
        words = list(itertools.chain.from_iterable(docs))
        parts = list(map(self.ids.get, words))
        missed = [i for i, x in enumerate(parts) if x is None]
        new = []
        for w in dict.fromkeys([words[i] for i in missed]):
            found = self.older.get(w)
            if found is None:
                new.append(w)
            else:
                self.ids[w] = found
        self._learn(new)
        for i in missed:
            parts[i] = self.ids[words[i]]
        cut = [0, *itertools.accumulate(map(len, docs))]
        end = END.to_bytes(4, "little")
        out = [b"".join(parts[x:y]) + end for x, y in zip(cut, cut[1:])]
        whole = [i for i, o in enumerate(at_once) if o]
        for i, x in zip(whole, self._whole([texts[i].decode("utf-8", "replace") for i in whole])):
            out[i] = x + end
        return out


_CELLS = 1 << 20


def _cell(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs of symbols to _CELLS."""
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(12)


def _frequent_pairs(seq: np.ndarray, most: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to most pairs that occur min_count times, about the most frequent, one a cell, most frequent first; places of pairs in their cells, and the cells.

    Pairs do not begin with the end id.  None are left when there are none to give.
    """
    left, right = seq[:-1], seq[1:]
    cell = _cell(left, right)
    counts = np.bincount(cell, minlength=_CELLS)
    few = max(min_count, int(np.partition(counts, -2 * most)[-2 * most])) if 2 * most < _CELLS else min_count
    for least, exact in ((few, False), (min_count, False), (min_count, True)):
        at = np.flatnonzero((counts >= least)[cell] & (left != END))
        own = cell[at]
        key = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
        pair = np.zeros(_CELLS, np.uint64)
        if exact:  # a cell's most frequent pair stands for it
            keys, n = np.unique(key, return_counts=True)
            keys = keys[np.argsort(n, kind="stable")]
            pair[_cell((keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32))] = keys
        else:  # any one of its pairs does
            pair[own] = key
        hit = np.flatnonzero(pair[own] == key)
        at, own = at[hit], own[hit]
        n = np.bincount(own, minlength=_CELLS)
        cells = np.flatnonzero(n >= min_count)
        if len(cells):
            break
    cells = cells[np.argsort(-n[cells], kind="stable")][:most]
    rule_of = np.full(_CELLS, -1, np.int32)
    rule_of[cells] = np.arange(len(cells))
    rule = rule_of[own]
    return pair[cells], at[rule >= 0], rule[rule >= 0]


def compress(ids: np.ndarray, first_rule: int, turns: int = 6, min_count: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, sequence): pairs of symbols, ids that each expands to, and ids with pairs replaced.

    Pairs are replaced until none occurs min_count times, or, where symbols take two bytes, until these are used up, as one
    more rule would double the width of all; in about `turns` turns then, which take an equal share of the symbols.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.ones(first_rule, np.int64)
    room = _TWO_BYTES if first_rule < _TWO_BYTES else 1 << 32
    most = max(1, (room - first_rule) // turns) if room == _TWO_BYTES else _TWO_BYTES // turns
    while len(seq) > 1 and len(lengths) < room:
        made, at, rule = _frequent_pairs(seq, min(most, room - len(lengths)), min_count)
        if not len(made):
            break
        # of overlapping places take those more frequent than both neighbours, then every other of the rest
        near = np.diff(at) == 1
        best = np.ones(len(at), bool)
        best[1:] &= ~near | (rule[1:] < rule[:-1])
        best[:-1] &= ~near | (rule[:-1] <= rule[1:])
        free = ~best
        free[1:] &= ~(near & best[:-1])
        free[:-1] &= ~(near & best[1:])
        rest = np.flatnonzero(free)
        if len(rest):
            begin = np.concatenate([[True], np.diff(at[rest]) != 1])
            since = np.arange(len(rest)) - np.maximum.accumulate(np.where(begin, np.arange(len(rest)), 0))
            best[rest[since % 2 == 0]] = True
        at, rule = at[best], rule[best]
        base = len(lengths)
        made = np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        rules.append(made)
        lengths = np.concatenate([lengths, lengths[made[:, 0]] + lengths[made[:, 1]]])
        seq[at] = (base + rule).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), lengths[first_rule:], seq


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that the symbols seq stand for."""
    own = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.empty(own[-1], np.uint32)
    begin = own.tolist()
    for i, (a, b) in enumerate(rules.tolist()):
        s = begin[i]
        for x in (a, b):
            if x < first_rule:
                flat[s] = x
                s += 1
            else:
                e = s + begin[x - first_rule + 1] - begin[x - first_rule]
                flat[s:e] = flat[begin[x - first_rule] : begin[x - first_rule + 1]]
                s = e
    is_rule = seq >= first_rule
    r = np.where(is_rule, seq.astype(np.int64) - first_rule, 0)
    n = np.where(is_rule, lengths[r] if len(lengths) else 1, 1)
    start = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(start[-1], np.uint32)
    out[start[:-1][~is_rule]] = seq[~is_rule]
    many = n[is_rule]
    shift = np.repeat(own[r[is_rule]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    place = np.repeat(start[:-1][is_rule] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    out[place] = flat[shift]
    return out


_FILE = "part int, seq int, start long, n_ids long, doc_ids array<long>, doc_ends array<long>, first_rule int, width int, rules binary, lengths binary, sequence binary"


def _shard(part: int, seq: int, start: int, doc_ids: list, held: list[bytes], options: dict) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(held), "<u4")
    first = options["first_rule"]
    rules, lengths, sequence = compress(ids, first, options["turns"], options["min_count"])
    width = 2 if first + len(rules) <= 1 << 16 else 4
    ends = np.cumsum([len(x) // 4 for x in held])
    as_bytes = lambda a, w: a.astype(f"<u{w}").tobytes()
    values = [part, seq, start, len(ids), doc_ids, ends.tolist(), first, width, as_bytes(rules, width), as_bytes(lengths, 4), as_bytes(sequence, width)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], [x.split()[0] for x in _FILE.split(", ")])


def _write(path: str, shard_ids: int, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = WordCoder.at(path), TaskContext.get().partitionId()
        seq = start = size = 0
        doc_ids, held = [], []
        for c in chunks(batches):
            for i, ids in zip(c.column("doc_id").to_pylist(), coder.encode(c.texts())):
                doc_ids.append(i)
                held.append(ids)
                size += len(ids) // 4
                if size >= shard_ids:
                    yield _shard(part, seq, start, doc_ids, held, options)
                    seq, start, size, doc_ids, held = seq + 1, start + size, 0, [], []
        if held:
            yield _shard(part, seq, start, doc_ids, held, options)

    return run


def encode_shards(docs: DataFrame, path: str, shard_ids: int = 3_000_000, turns: int = 6, min_count: int = 8, vocabulary: int = 49_408, part_bytes: int = 24 << 20) -> DataFrame:
    """The file rows of docs (doc_id, text) in ascending doc_id order, in parts of about part_bytes of text.

    Null texts are empty, null ids come first.  Rows that repeat a doc_id are in the order of a hash of their texts, and
    may be dealt to several parts; equal rows are in one, shard by shard.  Other columns are left out.
    """
    options = {"first_rule": vocabulary, "turns": turns, "min_count": min_count}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    tie = F.xxhash64("text")
    dealt = texts.withColumn("tie", tie).repartitionByRange(int(total) // part_bytes + 1, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return dealt.select("doc_id", "text").transform(map_arrow, _write(path, shard_ids, options), _FILE)


def _parts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = f"<u{row['width']}"
    return np.frombuffer(row["rules"], w).reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["sequence"], w)


def document_ids(row: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of a shard row, decoding only the symbols it covers."""
    rules, lengths, seq = _parts(row)
    first = row["first_rule"]
    table = np.concatenate([np.ones(first, np.int64), lengths])
    upto = np.cumsum(table[seq])
    begin, end = (row["doc_ends"][k - 1] if k else 0), row["doc_ends"][k]
    a, b = np.searchsorted(upto, [begin, end - 1], "right")
    return expand(seq[a : b + 1], rules, lengths, first)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            ids = expand(*[_parts(row)[k] for k in (2, 0, 1)], row["first_rule"]).astype("<u4")
            ends = np.array(row["doc_ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
            yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"] + row["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def decode_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in files, from its decoded ids."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition written
    before = list(itertools.accumulate((r["n"] for r in sizes), initial=0))
    base = files.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part int, base long")
    return files.join(F.broadcast(base), "part").transform(map_arrow, _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = stage(encode_shards(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "tokens")
    return decode_shards(files)
