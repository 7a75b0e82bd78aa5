"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of order 0 to 3 with the counts of the bytes that follow.
A byte seen after its context costs -log2(n / (N + T)) bits (n: its count, N: all counts there, T:
distinct bytes there); one not seen there costs the escape -log2(T / (N + T)) plus its cost after the
next shorter context, down to 8 bits for a byte never seen.  Counts are frozen when scoring, so the
code length of a text is a sum over its bytes, and the language with the shortest code is predicted.

Texts are lower-cased, and each run of ASCII other than a-z counts as one space.  Training reads a
sample of labelled rows, at most about `texts_per_lang` different texts per language, chosen by a hash
of the text and counted whole, however long; copies count once.  Contexts beyond order 1 are kept, most
frequent first, while each language's table takes at most `bytes_per_lang`, whatever their number;
those left out are scored by the next shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import chunks, crc_mod5, map_arrow, read, text_bytes

UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


@dataclass
class PpmModel:
    """costs[node * n_classes + class] has the bits per language; node_of maps the last three classes to a node."""

    langs: list[str]
    class_of: np.ndarray
    node_of: np.ndarray
    costs: np.ndarray
    n_classes: int


def _fold(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of a chunk with runs of spaces made one, and the new row offsets."""
    b = _FOLD[buf]
    space = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[off[:-1][off[:-1] < len(b)]] = True
    at = np.zeros(len(b) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return b[keep], at[off]


def _before(x: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The three preceding values of each position, 0 before a row's start."""
    out, edges = [], off[:-1][off[:-1] < len(x)]
    for _ in range(3):
        p = np.zeros_like(x)
        p[1:] = x[:-1]
        p[edges] = 0
        out.append(p)
        x = p
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for c in chunks(batches):
        b, off = _fold(c.buf, c.off)
        if not len(b):
            continue
        p1, p2, p3 = (p.astype(np.uint32) for p in _before(b, off))
        gram = (p3 << 24) | (p2 << 16) | (p1 << 8) | b
        langs = np.array(c.column("lang").to_pylist(), object)
        of = np.repeat(langs, np.diff(off))
        for lang in set(langs.tolist()):
            k, n = np.unique(gram[of == lang], return_counts=True)
            held.setdefault(lang, []).append((k, n))
    for lang, parts in held.items():
        k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
        yield pa.record_batch([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def train(labelled: DataFrame, texts_per_lang: int = 1500, bytes_per_lang: int = 6 << 20) -> PpmModel:
    """Fit on rows (text, lang); rows with a null or empty text or lang are left out."""
    d = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("h", F.xxhash64("text"))
    rate = d.groupBy("lang").agg((F.lit(float(texts_per_lang)) / F.approx_count_distinct("h", 0.02)).alias("rate"))
    # one row per language, as the model has one column for each: small by construction
    d = d.join(F.broadcast(rate), "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).dropDuplicates(["lang", "h"])
    grams = (
        d.select("lang", text_bytes(F.lower("text")).alias("text"))
        .transform(map_arrow, _count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    return _build(grams, bytes_per_lang)


def _build(grams: pa.Table, bytes_per_lang: int) -> PpmModel:
    lang = np.array(grams["lang"].to_pylist(), object)
    gram, n = grams["gram"].to_numpy().astype(np.int64), grams["n"].to_numpy().astype(np.float64)
    langs = sorted(set(lang.tolist()))
    # byte 0 stands before a text's start; bytes never seen in training share class 1
    seen = np.unique(gram & 255)
    class_of = np.ones(256, np.int64)
    class_of[seen[seen > 0]] = np.arange(2, 2 + (seen > 0).sum())
    size = int(class_of.max()) + 1
    parts = [class_of[(gram >> s) & 255] * (((gram >> s) & 255) > 0) for s in (24, 16, 8)]
    last = class_of[gram & 255]
    ctx2 = parts[1] * size + parts[2]
    ctx3 = parts[0] * size * size + ctx2

    room = max(0, bytes_per_lang // (4 * size) - 1 - size)
    total2, total3 = np.bincount(ctx2, n, size**2), np.bincount(ctx3, n, size**3)
    kept2 = np.argsort(-total2, kind="stable")[: min(room, int((total2 > 0).sum()))]
    kept3 = np.argsort(-total3, kind="stable")[: min(room - len(kept2), int((total3 > 0).sum()))]

    node1 = 1 + np.arange(size)
    node2 = np.tile(node1, size)
    node2[kept2] = 1 + size + np.arange(len(kept2))
    node3 = np.tile(node2, size)
    node3[kept3] = 1 + size + len(kept2) + np.arange(len(kept3))

    costs = np.zeros((1 + size + len(kept2) + len(kept3), size, len(langs)), np.float32)
    place3 = np.full(size**3, -1)
    place3[kept3] = np.arange(len(kept3))

    def cost(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        here, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = -np.log2(counts / (here + kinds))
            escape = np.where(here > 0, -np.log2(kinds / (here + kinds)), 0.0)
        return np.where(counts > 0, found, escape + shorter)

    for j, name in enumerate(langs):
        own = lang == name
        m, d = n[own], last[own]
        c0 = cost(np.bincount(d, m, size), np.full(size, 8.0))
        c1 = cost(np.bincount(parts[2][own] * size + d, m, size**2).reshape(size, size), c0)
        c2 = cost(np.bincount(ctx2[own] * size + d, m, size**3).reshape(size**2, size), np.tile(c1, (size, 1)))
        row = place3[ctx3[own]]
        deep = np.bincount(row[row >= 0] * size + d[row >= 0], m[row >= 0], len(kept3) * size).reshape(-1, size)
        c3 = cost(deep, c2[kept3 % size**2])
        costs[:, :, j] = np.concatenate([c0[None], c1, c2[kept2], c3])
    return PpmModel(langs, class_of, node3.astype(np.int32), costs.reshape(costs.shape[0] * size, len(langs)), size)


def code_lengths(model: PpmModel, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each row under each language, and the number of bytes scored."""
    b, off = _fold(buf, off)
    n = np.diff(off)
    bits = np.zeros((len(n), len(model.langs)))
    if len(b):
        c = model.class_of[b]
        p1, p2, p3 = _before(c, off)
        s = model.n_classes
        each = model.costs[model.node_of[(p3 * s + p2) * s + p1].astype(np.int64) * s + c]
        full = np.flatnonzero(n)
        bits[full] = np.add.reduceat(each, off[full], axis=0, dtype=np.float64)
    return bits, n


def classify(docs: DataFrame, model: PpmModel, text: Column | str = "text") -> DataFrame:
    """docs with lang_pred, score (the posterior of the prediction under equal priors) and bits_per_byte.

    A null text, one without a letter, or a model without languages gives `und`, 0.0 and null.  Of equal
    codes the first language by name wins.  Columns of those names in docs are replaced.
    """
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    kept = [c for c in docs.columns if c not in added.names]
    schema = T.StructType([docs.schema[c] for c in kept] + added.fields)
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = F.col(text) if isinstance(text, str) else text

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for c in chunks(batches, "__bytes"):
            known = c.column("__letters").to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
            pred, prob, rate = np.full(len(known), UNKNOWN, object), np.zeros(len(known)), np.full(len(known), np.nan)
            if m.langs:
                bits, n = code_lengths(m, c.buf, c.off)
                best = bits.argmin(1)
                low = bits[np.arange(len(best)), best]
                p = 1.0 / np.exp2(low[:, None] - bits).sum(1)
                pred[known] = np.array(m.langs, object)[best[known]]
                prob[known] = p[known]
                rate[known] = low[known] / np.maximum(n[known], 1)
            cols = [c.column(k) for k in kept] + [pa.array(pred.tolist(), pa.string()), pa.array(prob), pa.array(rate, mask=np.isnan(rate))]
            yield pa.record_batch(cols, names=kept + added.names)

    letters = F.coalesce(source.cast("string").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*[F.col(f"`{c}`") for c in kept], letters.alias("__letters"), text_bytes(F.lower(source)).alias("__bytes")).transform(map_arrow, score, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(F.coalesce(crc_mod5() != 0, F.lit(True))).select("text", "lang"))
    held_out = F.coalesce(crc_mod5() == 0, F.lit(False))
    return classify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
