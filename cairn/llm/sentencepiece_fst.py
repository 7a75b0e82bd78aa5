"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a BPE model file into tables of arcs (output, weight):

* `normal`, with an arc for each character that the normaliser changes (others map to themselves at
  weight 0): space to U+2581; its initial arc puts one before the text;
* `arcs`, a trie from characters to pieces, and `weight`, from the state to the piece put out next.  A
  state is the last piece put out.  The arc from piece p to piece q has weight 0 where byte-pair
  merging of their joint text gives p and q again, and infinite weight otherwise, so that in the
  tropical semiring the path of least weight spells exactly the pieces that merging would give;
* `fallback`, with an arc from a character without a piece to the pieces of its UTF-8 bytes, at weight 1.

The weight between p and q follows from the merges that built them: going up the right edge of p and
the left edge of q in the order of merge priorities, the pair is ruled out if some two symbols met on
the way could have merged before either was used.  Composition is lazy: the arcs of the composed
machine are made as the shortest path meets them and remembered.  The path is found over the positions
of one segment (a word with the U+2581 before it, which no piece extends beyond) by relaxing arcs with
(min, +); of paths of equal weight that meet in a position the one whose last piece began first stays,
and as weights are not negative an arc into a position is looked at only if it can lower its weight.
Segments are remembered.  Runs of several spaces have equal priorities in the models, where the
leftmost goes first; they are merged directly.

Ids equal those of the SentencePiece library for BPE models with identity normalisation.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Remembered, chunks, map_arrow, read, text_bytes

SPACE = "▁"
_SPACE = SPACE.encode()
_CACHED = 200_000
_BYTE = -1
_NEVER = float("inf")


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, b[i : i + n]
        i += n


@dataclass
class Model:
    """Pieces of a model and, for every piece that merging can build, the two it is made of last.

    arcs has the id of every piece that merging can build, and -1 for what only begins pieces.
    """

    pieces: list[bytes]
    id_of: dict[str, int]
    score: list[float]
    byte_id: list[int]
    made_of: dict[int, tuple[int, int]]
    parts_lines: bool
    arcs: dict[str, int]
    joined: frozenset[str]
    normal: dict[int, str] = field(default_factory=lambda: {ord(" "): SPACE})
    weight: dict[tuple[int, int], float] = field(default_factory=dict)
    fallback: dict[str, tuple[list[int], float]] = field(default_factory=dict)


def load(path: str) -> Model:
    """Compile a model file; it must be a BPE model with byte fallback and identity normalisation."""
    with open(path, "rb") as f:
        data = f.read()
    names, scores, kinds, norm, trainer = [], [], [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            names.append(p[1].decode())
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            kinds.append(p.get(3, 1))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            norm = dict(_fields(value))
    if trainer.get(3) != 2 or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1):
        raise ValueError("only BPE models with identity normalisation, kept spaces and a leading space are handled")
    if any(k == 1 and SPACE in n.lstrip(SPACE) for n, k in zip(names, kinds)):
        raise ValueError("only models whose pieces hold U+2581 at their start alone are handled")
    id_of = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == 1}
    byte_id = [0] * 256
    for i, (n, k) in enumerate(zip(names, kinds)):
        if k == 6:
            byte_id[int(n[3:5], 16)] = i
    pieces = [bytes([int(n[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else n.encode() for n, k in zip(names, kinds)]
    joined = frozenset(n[k : k + 2] for n in id_of for k in range(len(n) - 1))
    m = Model(pieces, id_of, scores, byte_id, {}, not any("\n" in n and len(n) > 1 for n in id_of), {}, joined)
    for name, i in id_of.items():
        if len(name) > 1:
            done, last = merge(m, name)
            if done == [name]:
                m.made_of[i] = (id_of[last[0]], id_of[last[1]])
    m.arcs.update((n[:k], _BYTE) for n in id_of for k in range(1, len(n) + 1))
    m.arcs.update((n, i) for n, i in id_of.items() if len(n) == 1 or i in m.made_of)
    return m


def merge(m: Model, text: str) -> tuple[list[str], tuple[str, str] | None]:
    """Symbols left after byte-pair merging, and the two merged last; used on short strings."""
    s, last = list(text), None
    while len(s) > 1:
        found = [(-m.score[m.id_of[a + b]], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in m.id_of]
        if not found:
            break
        i = min(found)[1]
        last = (s[i], s[i + 1])
        s[i : i + 2] = [s[i] + s[i + 1]]
    return s, last


def _edge(m: Model, piece: int, side: int) -> list[int]:
    """The piece and, downwards, its parts on one edge (0: left, 1: right), in order of making."""
    out = [piece]
    while out[-1] in m.made_of:
        out.append(m.made_of[out[-1]][side])
    return out[::-1]


def follow_weight(m: Model, p: int, q: int) -> float:
    """Weight of the arc that puts out piece q in the state of piece p."""
    left, right = _edge(m, p, 1), _edge(m, q, 0)
    i = j = 0
    name = m.pieces
    while True:
        both = m.id_of.get((name[left[i]] + name[right[j]]).decode())
        use_l = m.score[left[i + 1]] if i + 1 < len(left) else None
        use_r = m.score[right[j + 1]] if j + 1 < len(right) else None
        if both is not None:
            s = m.score[both]
            # of equal priorities the leftmost goes first: p's own merge before theirs, theirs before q's
            if (use_l is None or s > use_l) and (use_r is None or s >= use_r):
                return _NEVER
        if use_l is None and use_r is None:
            return 0.0
        if use_r is None or (use_l is not None and use_l >= use_r):
            i += 1
        else:
            j += 1


def fallback_arc(m: Model, char: str) -> tuple[list[int], float]:
    """Output and weight of the arc from a character to its bytes; infinite where it has a piece."""
    found = m.fallback.get(char)
    if found is None:
        found = m.fallback[char] = ([], _NEVER) if char in m.id_of else ([m.byte_id[x] for x in char.encode()], 1.0)
    return found


def shortest_path(m: Model, segment: str) -> list[int]:
    """Output of the path of least weight through the composition with a segment, as normalised."""
    n = len(segment)
    least = [_NEVER] * (n + 1)
    state = [_BYTE] * (n + 1)
    begin = [0] * (n + 1)
    least[0] = 0.0
    get, weight = m.arcs.get, m.weight
    for b in range(n):
        so_far, p = least[b], state[b]
        if so_far == _NEVER:
            continue
        for e in range(b + 1, n + 1):
            q = get(segment[b:e])
            if q is None:  # no piece reaches further
                break
            if q == _BYTE or least[e] <= so_far:
                continue
            total = so_far
            if p != _BYTE:  # bytes merge with nothing
                w = weight.get((p, q))
                if w is None:
                    w = weight[p, q] = follow_weight(m, p, q)
                total += w
            if total < least[e]:
                least[e], state[e], begin[e] = total, q, b
        if least[b + 1] > so_far:
            total = so_far + fallback_arc(m, segment[b])[1]
            if total < least[b + 1]:
                least[b + 1], state[b + 1], begin[b + 1] = total, _BYTE, b
    out: list[int] = []
    e = n
    while e:
        b = begin[e]
        if state[e] == _BYTE:
            out += fallback_arc(m, segment[b])[0][::-1]
        else:
            out.append(state[e])
        e = b
    return out[::-1]


def _spaces(m: Model, n: int) -> list[int]:
    return [m.id_of[s] for s in merge(m, SPACE * n)[0]] if n < 64 else [m.id_of[s] for s in _long_run(m, n)]


def _long_run(m: Model, n: int) -> list[str]:
    """A long run merges from the left into the longest run piece, again and again."""
    top = max(len(k) for k in m.id_of if k == SPACE * len(k))
    full, rest = divmod(n, top)
    return [SPACE * top] * full + (merge(m, SPACE * rest)[0] if rest else [])


class Encoder:
    """Encodes texts by segments, which are remembered, those in use longest."""

    def __init__(self, model: Model):
        self.m = model
        self.ids = Remembered(self._segment, _CACHED)
        self.paths = Remembered(lambda part: shortest_path(model, part), _CACHED // 2)

    def _path(self, segment: str) -> list[int]:
        """Ids of a segment, cut where no piece holds both characters at the cut."""
        joined, out, b = self.m.joined, [], 0
        for e in range(1, len(segment) + 1):
            if e < len(segment) and segment[e - 1 : e + 1] in joined:
                continue
            part = segment[b:e]
            out += self.paths[part]
            b = e
        return out

    def _segment(self, key: bytes) -> bytes:
        """Ids of a segment: a word, with a space before it unless it starts with a line's end; or spaces and a word."""
        text = key.decode("utf-8", "replace")
        if key[:1] == b"\n":
            ids = self._path(text)
        else:
            word = text.lstrip(" ")
            spaces, ids = len(text) - len(word), self._path(SPACE + (word.translate(self.m.normal) if " " in word else word))
            if spaces and word and ids[0] != self.m.id_of[SPACE]:
                ids = _spaces(self.m, spaces) + ids
            elif spaces:
                ids = _spaces(self.m, spaces + 1) + ids[1:]
        return array("I", ids).tobytes()

    def _keys(self, text: bytes) -> list[bytes]:
        if _SPACE in text:
            text = text.replace(_SPACE, b" ")
        if self.m.parts_lines:
            text = text.replace(b"\n", b" \n")
        words = text.split(b" ")
        if b"" not in words:
            return words
        out, spaces = [], 0
        for w in words:
            if w == b"":
                spaces += 1
            elif w[:1] == b"\n":
                if spaces:
                    out.append(b" " * (spaces - 1))
                out.append(w)
                spaces = 0
            else:
                out.append(b" " * spaces + w)
                spaces = 0
        if spaces:
            out.append(b" " * (spaces - 1))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        docs = [self._keys(t) if t else [] for t in texts]
        self.ids.age()
        self.paths.age()
        for arcs in (self.m.weight, self.m.fallback):
            if len(arcs) > 2 * _CACHED:
                arcs.clear()
        get = self.ids.__getitem__
        return [b"".join(map(get, d)) for d in docs]


def decode(model: Model, ids: np.ndarray) -> bytes:
    """The text of ids: pieces side by side, U+2581 as space, without the leading one."""
    out = b"".join(map(model.pieces.__getitem__, ids.tolist())).replace(_SPACE, b" ")
    return out[1:] if out[:1] == b" " else out


#: The worker's encoder, which outlives a task so that segments stay remembered.
_ENCODER: list[Encoder] = []


def encode_and_decode(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """docs (all columns, or `keep`) with n_pieces, pieces (ids), pieces_crc32, decoded and round_trip.

    decoded is the text made from the ids again; round_trip says whether it is the text as normalised
    (a literal U+2581 reads as a space).  A null or empty text has no pieces and decodes as empty.
    `with_ids` and `with_text` leave the two large columns out.  Columns of these names are replaced.
    """
    added = T.StructType().add("n_pieces", "long")
    if with_ids:
        added.add("pieces", T.ArrayType(T.IntegerType()))
    added.add("pieces_crc32", "long")
    if with_text:
        added.add("decoded", "string")
    added.add("round_trip", "boolean")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    schema = T.StructType([docs.schema[c] for c in kept] + added.fields)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _ENCODER or _ENCODER[0].m is not held.value:
            _ENCODER[:] = [Encoder(held.value)]
        encoder = _ENCODER[0]
        for c in chunks(batches, "__bytes"):
            texts = c.texts()
            ids = encoder.encode(texts)
            arrays = [np.frombuffer(x, "<u4") for x in ids]
            back = [decode(encoder.m, a) for a in arrays]
            cols = {"n_pieces": pa.array([len(a) for a in arrays], pa.int64())}
            if with_ids:
                ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
                cols["pieces"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            cols["pieces_crc32"] = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            if with_text:
                cols["decoded"] = pa.array([x.decode("utf-8", "replace") for x in back], pa.string())
            cols["round_trip"] = pa.array([x == t.replace(_SPACE, b" ") for x, t in zip(back, texts)])
            yield pa.record_batch([c.column(k) for k in kept] + list(cols.values()), names=kept + list(cols))

    return docs.select(*[F.col(f"`{c}`") for c in kept], text_bytes().alias("__bytes")).transform(map_arrow, run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = load(public_tokenizers.path("piece_bpe_32k.model"))
    return encode_and_decode(read(spark, sf_dir, "documents"), model, ("doc_id",), with_ids=False, with_text=False)
