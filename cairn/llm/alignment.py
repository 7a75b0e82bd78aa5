"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers' tokens are laid end to end.  Byte offsets where tokens of both end cut a text into
groups; an A token and a B token are linked where their byte ranges overlap.  All texts of a chunk are
worked on at once: running sums give the ends, their intersection the cuts, binary search the group of
each token, and repeating each token by its number of partners the links.

Texts are encoded once; their ids are staged, and links are made from them in two passes: one counts
for each pair of ids the documents that hold it linked, one scores every document by these counts.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import chunks, map_arrow, read, release, shared_dir, stage, text_bytes

#: Texts are encoded in chunks of about so many bytes; an encoding takes some hundred bytes a token.
ENCODE_BYTES = 1 << 19
# Fixed value: the pattern by which byte-level vocabularies of this kind part a text.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs that a task adds up before it hands them on.
TASK_PAIRS = 2_000_000
#: Groups that each pair's counts are spread over before they meet.
SALTS = 16

_LOADED: dict[tuple[str, str], Tokenizers] = {}


# ---------------------------------------------------------------- the two tokenizers


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: those not printing as Latin-1 are numbered from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A byte-level tokenizer file (A) and a SentencePiece model (B), with the bytes of every token of both.

    Where A's merges are in the order of their ids, and it parts text by the usual pattern alone, its ids
    are those of a rank vocabulary, and the faster library for these encodes; else the file's own.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        value, special = _byte_values(), a.get_added_tokens_decoder()
        entries = [a.id_to_token(i) or "" for i in range(max(a.get_vocab().values()) + 1)]
        self.a_bytes = [t.encode() if i in special else bytes(value[c] for c in t) for i, t in enumerate(entries)]
        self.b_bytes = [self._piece(i) for i in range(self.b.piece_size())]
        self.a_length, self.b_length = (np.array([len(t) for t in ts], np.int64) for ts in (self.a_bytes, self.b_bytes))
        ranks = self._ranks(json.loads(a.to_str()), special)
        if ranks:
            import tiktoken

            by_rank = tiktoken.Encoding("ranks", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})
            self.a_ids = lambda texts: [by_rank.encode_ordinary(t) for t in texts]
        else:
            self.a_ids = lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ranks(self, file: dict, special: dict) -> dict[bytes, int] | None:
        """Bytes and rank of all entries, if the file is no more than a byte-level vocabulary whose ids are its merges' ranks."""
        model, before = file["model"], file["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not file["normalizer"]
        odd = model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if odd or not plain:
            return None
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ordered = all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged)) and {model["vocab"].get(c) for c in _byte_values()} == set(range(256))
        return {t: i for i, t in enumerate(self.a_bytes) if i not in special} if ordered and len(merged) + 256 == len(model["vocab"].keys() - {t.content for t in special.values()}) else None

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @classmethod
    def at(cls, a_path: str, b_path: str) -> Tokenizers:
        if (a_path, b_path) not in _LOADED:
            _LOADED[a_path, b_path] = cls(a_path, b_path)
        return _LOADED[a_path, b_path]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by A, with a space before it, and by B; none where the text is empty or either's bytes are not the text's."""
        read, out = [t.decode("utf-8", "replace") for t in texts], []
        for text, a, b in zip(texts, self.a_ids([" " + t for t in read]), self.b.encode(read, num_threads=1)):
            whole = b" " + text
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            out.append((np.array(a if same else [], "<u4"), np.array(b if same else [], "<u4")))
        return out


# ---------------------------------------------------------------- alignment of a chunk


@dataclass
class Vocabulary:
    """Bytes that each id of A and of B stands for."""

    a: np.ndarray
    b: np.ndarray

    @property
    def pair_base(self) -> int:
        return len(self.b)


class Aligned:
    """Texts' ids laid end to end: group of each token, links (A token, B token), and where each text begins in all of these."""

    def __init__(self, vocabulary: Vocabulary, a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray):
        self.a, self.b, self.a_off, self.b_off = a, b, a_off, b_off
        a_end, b_end = np.cumsum(vocabulary.a[a]), np.cumsum(vocabulary.b[b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)  # every text's end is one
        self.a_group, self.b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        self.groups = len(cuts)
        full = a_off[1:] > a_off[:-1]
        self.group_off = np.zeros(len(a_off), np.int64)
        self.group_off[1:][full] = self.a_group[a_off[1:][full] - 1] + 1
        np.maximum.accumulate(self.group_off, out=self.group_off)
        # partners of an A token: from the B token that holds its first byte to the one that holds its last
        first = np.searchsorted(b_end, a_end - vocabulary.a[a], "right")
        partners = np.searchsorted(b_end, a_end, "left") - first + 1
        before = np.concatenate([[0], np.cumsum(partners)])
        self.link_a = np.repeat(np.arange(len(a)), partners)
        self.link_b = np.arange(before[-1]) - np.repeat(before[:-1] - first, partners)
        self.link_off = before[a_off]
        self.pair = a[self.link_a].astype(np.int64) * vocabulary.pair_base + b[self.link_b]

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids, ascending, and how many texts hold each linked."""
        text = np.repeat(np.arange(len(self.link_off) - 1), np.diff(self.link_off))
        pairs, place = np.unique(self.pair, return_inverse=True)
        held = np.unique(place * max(len(self.link_off) - 1, 1) + text) // max(len(self.link_off) - 1, 1)
        return pairs, np.bincount(held, minlength=len(pairs))

    def written(self, digits: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
        """Per text `a1,a2|b1;a3|b2,b3`: ids of each group, first A's, then B's."""
        a_ends = np.searchsorted(self.a_group, np.arange(self.groups), "right")
        b_ends = np.searchsorted(self.b_group, np.arange(self.groups), "right")
        a_at = np.arange(len(self.a)) + np.concatenate([[0], b_ends])[self.a_group]
        b_at = np.arange(len(self.b)) + a_ends[self.b_group]
        n = len(self.a) + len(self.b)
        ids, sign = np.empty(n, np.int64), np.full(n, 44, np.uint8)
        ids[a_at], ids[b_at] = self.a, self.b
        sign[a_at[a_ends - 1]], sign[b_at[b_ends - 1]] = 124, 59
        table, width = digits
        length = width[ids]
        end = np.cumsum(length + 1)
        out = np.empty(end[-1] if n else 0, np.uint8)
        out[end - 1] = sign
        for d in range(table.shape[1]):
            long = np.flatnonzero(length > d)
            out[end[long] - 2 - d] = table[ids[long], d]
        text_end = np.concatenate([[0], end])[self.a_off + self.b_off]
        whole = out.tobytes()
        for s, e in zip(text_end.tolist(), text_end[1:].tolist()):
            yield whole[s : e - 1] if e > s else b""


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids below size, last digit first, as characters, and how many there are."""
    ids, n = np.arange(max(size, 1)), len(str(max(size - 1, 1)))
    table = np.stack([ids // 10**d % 10 + 48 for d in range(n)], 1).astype(np.uint8)
    return table, np.maximum(1, (ids[:, None] >= 10 ** np.arange(n)).sum(1))


def _aligned(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary):
    """Chunks of staged rows with their alignment."""
    for c in chunks(batches, "a_ids"):
        b_ids = c.column("b_ids").to_pylist()
        b_off = np.cumsum([0] + [len(x) // 4 for x in b_ids])
        yield c, Aligned(vocabulary, c.buf.view("<u4"), c.off // 4, np.frombuffer(b"".join(b_ids), "<u4"), b_off)


# ---------------------------------------------------------------- passes over the documents


def _encode(a_path: str, b_path: str):
    def run(batches):
        tokenizers = Tokenizers.at(a_path, b_path)
        for c in chunks(batches, limit=ENCODE_BYTES):
            ids = tokenizers.encode(c.texts())
            yield pa.record_batch([c.column("doc_id"), *(pa.array([x[k].tobytes() for x in ids], pa.binary()) for k in (0, 1))], ["doc_id", "a_ids", "b_ids"])

    return run


def _pairs(held):
    def run(batches):
        vocabulary, turn = held.value, TaskContext.get().partitionId()
        codes, counts, size = [], [], 0

        def flush():
            nonlocal codes, counts, size, turn
            pair, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            codes, counts, size, turn = [], [], 0, turn + 1
            for lo in range(0, len(pair), 1 << 17):
                p = pair[lo : lo + (1 << 17)]
                yield pa.record_batch([pa.array(p), pa.array(np.full(len(p), turn % SALTS, np.int32)), pa.array(n[lo : lo + (1 << 17)])], ["pair", "salt", "docs"])

        for _, x in _aligned(batches, vocabulary):
            pair, docs = x.distinct_pairs()
            codes.append(pair)
            counts.append(docs)
            size += len(pair)
            if size >= TASK_PAIRS:
                yield from flush()
        if size:
            yield from flush()

    return run


def pair_counts(encoded: DataFrame, held) -> DataFrame:
    """(pair, docs): A id * size of B + B id, and how many documents hold the two linked."""
    parts = map_arrow(encoded.select("a_ids", "b_ids"), _pairs(held), "pair long, salt int, docs long")
    return parts.groupBy("pair", "salt").agg(F.sum("docs").alias("docs")).groupBy("pair").agg(F.sum("docs").alias("docs"))


_ADDED = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(held, slice_held, first: bool, kept: list[str]):
    """The kept columns of rows with what the links of one slice of pairs add; the first slice also gives the other columns."""

    def run(batches):
        vocabulary, (pairs, docs, best, a_from, a_to) = held.value, slice_held.value
        digits = _digits(max(len(vocabulary.a), len(vocabulary.b)))
        for c, x in _aligned(batches, vocabulary):
            n = np.zeros(len(x.pair), np.int64)
            top = np.zeros(len(x.pair), bool)
            own = np.flatnonzero((x.pair >= a_from * vocabulary.pair_base) & (x.pair < a_to * vocabulary.pair_base))
            used, back = np.unique(x.pair[own], return_inverse=True)
            found = docs[np.searchsorted(pairs, used)] if len(used) else np.zeros(0, np.int64)
            n[own] = found[back]
            top[own] = (found == best[used // vocabulary.pair_base - a_from])[back] if len(used) else False
            per_text = [np.diff(np.concatenate([[0], np.cumsum(v)])[x.link_off]) for v in (top.astype(np.int64), n)]
            if first:
                sha = [hashlib.sha256(w).hexdigest() if w else "" for w in x.written(digits)]
                own_columns = [np.diff(x.a_off), np.diff(x.b_off), np.diff(x.group_off), np.diff(x.link_off)]
                columns = [pa.array(v.astype(np.int64)) for v in [*own_columns, *per_text]] + [pa.array(sha, pa.string())]
            else:
                columns = [c.column(k) for k in ("n_a", "n_b", "n_groups", "n_links")]
                columns += [pa.array(v + c.column(k).to_numpy(zero_copy_only=False)) for k, v in zip(("n_best", "count_sum"), per_text)] + [c.column("groups_sha256")]
            yield pa.record_batch([c.column(k) for k in kept] + columns, [*kept, *(f.split()[0] for f in _ADDED.split(", "))])

    return run


def _slices(counts: DataFrame, base: int, size: int, most: int) -> list[tuple[int, int]]:
    """Ranges of A ids that hold at most `most` pairs each, or one id alone: at most size of B then."""
    sizes = np.zeros(size, np.int64)
    for r in counts.groupBy(F.expr(f"pair div {base}").alias("a")).count().collect():  # a row for each A id
        sizes[r["a"]] = r["count"]
    cuts, held = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            cuts.append(i)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], size]))


def align(docs: DataFrame, a_path: str, b_path: str, with_ids: bool = True, most_pairs: int = 4_000_000) -> DataFrame:
    """Per row of docs: doc_id, a_ids and b_ids (unless with_ids is off), n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizer file and reads a space and the text; B a SentencePiece model that adds the
    space itself.  a_ids and b_ids are little-endian unsigned 32-bit integers.  A row whose text is null or
    empty, or where either's token bytes are not those of space and text (a text with U+2581, one that is
    not UTF-8), has no tokens: zeros and an empty digest.  count_sum adds over the links how many rows hold
    the pair of ids linked; n_best counts links whose pair has its A id's highest number, ties included.
    Rows are documents: equal ones count each.  docs needs doc_id and text, other columns are not looked at.

    Counts of pairs are broadcast in slices of A ids with at most `most_pairs` pairs (16 bytes each); where
    they are more, each further slice is one more pass over the staged ids.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    tokenizers = Tokenizers.at(a_path, b_path)
    vocabulary = Vocabulary(tokenizers.a_length, tokenizers.b_length)
    held = spark.sparkContext.broadcast(vocabulary)
    texts = docs.select("doc_id", text_bytes().alias("text"))
    encoded = stage(map_arrow(texts, _encode(a_path, b_path), "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", a_ids binary, b_ids binary"), "token_ids")
    counts = stage(pair_counts(encoded, held), "pair_counts")
    base, rows = vocabulary.pair_base, encoded
    slices = _slices(counts, base, len(vocabulary.a), most_pairs)
    for i, (a_from, a_to) in enumerate(slices):
        table = counts.where((F.col("pair") >= a_from * base) & (F.col("pair") < a_to * base)).toArrow()  # at most most_pairs, or one id's
        pairs, n = table["pair"].to_numpy(), table["docs"].to_numpy()
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        best = np.zeros(a_to - a_from, np.int64)
        np.maximum.at(best, pairs // base - a_from, n)
        last = i == len(slices) - 1
        kept = encoded.columns if with_ids or not last else ["doc_id"]
        schema = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in kept) + ", " + _ADDED
        scored = map_arrow(rows, _score(held, spark.sparkContext.broadcast((pairs, n, best, a_from, a_to)), i == 0, kept), schema)
        if not last:
            scored = stage(scored, "aligned")
            release(rows)
        rows = scored
    release(counts)
    return rows


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
