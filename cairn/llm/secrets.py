"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a private key block, a dotted token, a run of at least `MIN_LENGTH` characters of the
base64 and hex alphabets with up to two = behind it, or a value of at least `MIN_NAMED` characters
given to a name such as `password`.  Its features: length, character mix and entropy; character
transitions, as the mean log probability under the letter pairs of the corpus's frequent words and as
the share of changes between letters and digits; dictionary coverage, the share of it made of frequent
words; path signs around it; and the neighbouring words: whether they are words, and how much of the
40 bytes before is made of frequent words.

The forest is trained by Spark on labelled findings, a bounded sample of at most about `sample_rows`
different ones per label.  Where the caller has no findings, `label_by_origin` labels some: by what a
value is said to be (a secret's name, or a digest's) or by an issuer's format.  The forest sees neither
the names nor the formats, so it has to tell by the value and its place; values of unknown origin are
not learned from.  An issuer's format settles a finding whatever its score.  `evaluate` measures
precision and recall on findings whose values were kept out of training.  Word counts cover every
document.

A null or empty text has no candidates; repeated rows are reported each time.  Columns of docs with
the names of the result's own are not kept.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import chunks, delete, map_arrow, read, release, shared_dir, stage, text_bytes

MIN_LENGTH, MIN_NAMED = 16, 8
# Names that secrets are given, names of values that are none, and formats that settle a finding.
_NAMES = rb"token|secret|passw(?:or)?d|pwd|passphrase|api_?key|apikey|access_?key|auth|bearer|credential|private_?key|signature"
_OTHERS = rb"commit|revision|checksum|digest|sha-?(?:1|256|512)|md5|crc|uuid|guid|etag|version|session|request|trace|build"
_KEY_BLOCK = rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]{0,20000}-----END [A-Z ]{0,20}PRIVATE KEY-----"
_DOTTED = rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
CANDIDATE = re.compile(rb"%s|%s|[A-Za-z0-9+/_-]{%d,}={0,2}" % (_KEY_BLOCK, _DOTTED, MIN_LENGTH))
GIVEN = re.compile(rb"(?i)(?:%s)[\w-]{0,20}[\"'`]?\s{0,3}(?:=>|=|:)\s{0,3}[\"'`]?([^\s\"'`<>,;]{%d,})" % (_NAMES, MIN_NAMED))
NAMED = re.compile(rb"(?i)(?:%s)[\w-]{0,20}\W{0,6}$" % _NAMES)
OTHER = re.compile(rb"(?i)(?:%s)[\w-]{0,20}\W{0,6}$" % _OTHERS)
ASSIGNED = re.compile(rb"(?:=|:|=>)\s{0,3}[\"'`]?$")
BEARER = re.compile(rb"(?i)bearer\s+$")
FORMATS = re.compile(rb"(?:%s|%s|(?i:AKIA|ASIA)[0-9A-Za-z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35})$" % (_KEY_BLOCK, _DOTTED))
UUID = re.compile(rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
FEATURES = [
    "length", "entropy", "digits", "upper", "lower", "distinct", "hex", "switches", "pair_log_prob", "coverage",
    "in_path", "quoted", "before_is_word", "after_is_word", "before_known",
]
_WORD = re.compile(rb"[a-z]{4,12}")
_SWITCH = re.compile(rb"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
_HEX = re.compile(rb"[0-9a-fA-F]+$")


@dataclass
class Dictionary:
    """Frequent words, and log probabilities of letter pairs (26: any other character)."""

    words: frozenset[bytes]
    pairs: np.ndarray


def _count_letter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        kept = {w: n for w, n in held.items() if 4 <= len(w) <= 12 and w.isalpha() and w.isascii()}
        return pa.record_batch([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

    for c in chunks(batches):
        held.update(c.buf.tobytes().lower().split() if len(c.off) == 2 else b" ".join(c.texts()).lower().split())
        if len(held) > 100_000:
            yield out()
            held.clear()
    yield out()


def learn_dictionary(docs: DataFrame, size: int = 20_000) -> Dictionary:
    """From the most frequent words of 4 to 12 letters of all texts."""
    texts = docs.select(text_bytes().alias("text"))
    counts = texts.transform(map_arrow, _count_letter_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    pairs = np.ones((27, 27))
    for r in top:
        w = np.frombuffer(bytes(r["word"]), np.uint8).astype(np.int64) - 97
        np.add.at(pairs, (w[:-1], w[1:]), r["n"])
    return Dictionary(frozenset(bytes(r["word"]) for r in top), np.log2(pairs / pairs.sum(1, keepdims=True)))


def _coverage(low: bytes, words: frozenset[bytes]) -> float:
    """Share of the characters in words taken longest first from the left."""
    n, i, found = len(low), 0, 0
    while i < n:
        for k in range(min(12, n - i), 3, -1):
            if low[i : i + k] in words:
                found += k
                i += k
                break
        else:
            i += 1
    return found / n


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Spans of candidates in order; a named value that lies in or over another goes to that one."""
    out = [m.span() for m in CANDIDATE.finditer(text)]
    for m in GIVEN.finditer(text):
        s, e = m.span(1)
        at = bisect.bisect_left(out, (s, s))
        if (at == len(out) or out[at][0] >= e) and (at == 0 or out[at - 1][1] <= s):
            out.insert(at, (s, e))
    return out


def features(text: bytes, start: int, end: int, d: Dictionary) -> list[float]:
    s = text[start:end]
    n = len(s)
    before, after = text[max(0, start - 40) : start], text[end : end + 24]
    counts = Counter(s)
    digits, upper = sum(counts[c] for c in range(48, 58)), sum(counts[c] for c in range(65, 91))
    lower = sum(counts[c] for c in range(97, 123))
    low = s.lower()
    code = np.frombuffer(low, np.uint8).astype(np.int64) - 97
    code = np.where((code < 0) | (code > 25), 26, code)
    b, a = before.split(), after.split()
    return [
        float(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        digits / n,
        upper / n,
        lower / n,
        len(counts) / min(n, 64),
        float(bool(_HEX.match(s))),
        len(_SWITCH.findall(s)) / n,
        float(d.pairs[code[:-1], code[1:]].mean()),
        _coverage(low, d.words) if digits < n else 0.0,
        float(before[-1:] in (b"/", b"\\", b".") or after[:1] in (b"/", b"\\") or s.count(b"/") > 1),
        float(before[-1:] in (b'"', b"'", b"`")),
        float(bool(b) and _WORD.match(b[-1].lower()) is not None),
        float(bool(a) and _WORD.match(a[0].lower()) is not None),
        sum(len(w) for w in b if w.lower() in d.words) / 40,
    ]


def label_by_origin(text: bytes, start: int, end: int) -> float | None:
    """1 for a finding that its issuer's format or the name it is given to tells, 0 for one that is told to be something else, else None.

    Digests, identifiers and the like are something else by their names; UUIDs, numbers, and runs of letters in prose by their shape.
    """
    s, before = text[start:end], text[max(0, start - 40) : start]
    if FORMATS.match(s):
        return 1.0
    if OTHER.search(before) or UUID.match(s) or s.isdigit():
        return 0.0
    named = NAMED.search(before) is not None and (ASSIGNED.search(before) is not None or BEARER.search(before) is not None)
    if any(48 <= c < 58 for c in s):
        return 1.0 if named and any(c > 64 for c in s) else None
    return None if named else 0.0


_FINDING = (
    T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("sha256", T.StringType()).add("issued", T.BooleanType()).add("features", T.ArrayType(T.FloatType())).add("label", T.DoubleType())
)


def find_candidates(docs: DataFrame, dictionary: Dictionary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per candidate: the columns `keep`, its byte span, SHA-256, whether an issuer's format fits, features and label by origin."""
    kept = [c for c in keep if c not in _FINDING.names]
    schema = T.StructType([docs.schema[c] for c in kept] + _FINDING.fields)
    held = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = held.value
        for c in chunks(batches, "__bytes"):
            rows, out = [], []
            for i, t in enumerate(c.texts()):
                for s, e in candidates(t):
                    rows.append(i)
                    out.append((s, e, hashlib.sha256(t[s:e]).hexdigest(), FORMATS.match(t[s:e]) is not None, features(t, s, e, d), label_by_origin(t, s, e)))
            if out:
                at = pa.array(rows, pa.int64())
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.float32()), pa.float64()]
                yield pa.record_batch([c.column(k).take(at) for k in kept] + [pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=[f.name for f in schema])

    return docs.select(*kept, text_bytes().alias("__bytes")).transform(map_arrow, run, schema)


#: A fifth of all values, whatever document they are in.
HELD_OUT = "pmod(crc32(sha256), 5) = 0"


@dataclass
class Forest:
    """Trees side by side: feature (-1 in a leaf), threshold, children and probability of a secret per node."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    chance: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean probability over the trees, for rows of features."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, go, at)
            total += self.chance[at]
        return total / max(1, len(self.roots))


def train_forest(findings: DataFrame, sample_rows: int = 10_000, trees: int = 20, depth: int = 8, seed: int = 1) -> Forest:
    """Fit on the labelled ones of findings (sha256, features, label): at most about sample_rows different values of each label.

    Values are chosen by a hash, so copies of one count once, and those of HELD_OUT are kept out for `evaluate`.
    With only one label, or none, every score is that label's, or 0.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark = findings.sparkSession
    told = findings.where(F.col("label").isNotNull() & ~F.expr(HELD_OUT)).groupBy("sha256", "label").agg(F.min("features").alias("features"))
    told = stage(told, "told")
    counts = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    if len(counts) < 2:
        release(told)
        only = next(iter(counts), 0.0)
        leaf = np.zeros(1, np.int64)
        return Forest(leaf, leaf - 1, np.zeros(1), leaf, leaf, np.array([only]))
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_rows / n))])
    sample = told.where(F.pmod(F.xxhash64("sha256"), F.lit(1 << 20)) < rate[F.col("label")] * (1 << 20))
    sample = stage(sample.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), "label").coalesce(8), "findings")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(sample)
    path = f"{shared_dir(spark)}/cairn-forest-{sample._cairn_path.rpartition('-')[2]}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    release(told, sample)
    delete(spark, path)
    base, size = {}, Counter(r["treeID"] for r in nodes)
    for t in sorted(size):
        base[t] = sum(size[x] for x in base)
    get = lambda f: np.array([f(r) for r in nodes])
    return Forest(
        np.array([base[t] for t in sorted(base)]),
        get(lambda r: r["split"]["featureIndex"] if r["leftChild"] >= 0 else -1),
        get(lambda r: r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else 0.0),
        get(lambda r: base[r["treeID"]] + max(0, r["leftChild"])),
        get(lambda r: base[r["treeID"]] + max(0, r["rightChild"])),
        get(lambda r: r["impurityStats"][1] / max(1e-12, sum(r["impurityStats"]))),
    )


def judge(findings: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """findings with score and is_secret; issued, features and label go."""
    own = ("issued", "features", "label", "score", "is_secret")
    kept = [c for c in findings.columns if c not in own]
    schema = T.StructType([findings.schema[c] for c in kept]).add("score", "double").add("is_secret", "boolean")
    held = findings.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = held.value.score(np.array(b.column("features").flatten()).reshape(-1, len(FEATURES)))
            issued = b.column("issued").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.record_batch([b.column(c) for c in kept] + [pa.array(s), pa.array(issued | (s >= threshold))], names=schema.names)

    return findings.select(*kept, "issued", "features").transform(map_arrow, run, schema)


def evaluate(findings: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """One row: of the labelled findings whose values the forest has not seen, how many are secrets, taken for secrets, and both."""
    told = findings.where(F.col("label").isNotNull() & F.expr(HELD_OUT)).withColumn("told", F.col("label"))
    judged = judge(told.withColumn("issued", F.lit(False)), forest, threshold)
    secret, taken = F.col("told") == 1.0, F.col("is_secret")
    return judged.agg(F.count("*").alias("n"), F.count_if(secret).alias("secrets"), F.count_if(taken).alias("taken"), F.count_if(secret & taken).alias("both"))


def redact(docs: DataFrame, dictionary: Dictionary, forest: Forest, threshold: float = 0.5, mark: str = "<SECRET>") -> DataFrame:
    """docs with every candidate that the forest or an issuer's format takes for a secret replaced by mark; all columns and rows stay."""
    schema = docs.schema
    held = docs.sparkSession.sparkContext.broadcast((dictionary, forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, f = held.value
        for c in chunks(batches, "__bytes"):
            texts = c.texts()
            spans = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)]
            new: dict[int, bytes] = {}
            if spans:
                x = np.array([features(texts[i], s, e, d) for i, s, e in spans], np.float32)
                issued = np.array([FORMATS.match(texts[i][s:e]) is not None for i, s, e in spans])
                hits = [spans[k] for k in np.flatnonzero(issued | (f.score(x) >= threshold))]
                for i, s, e in reversed(hits):
                    t = new.get(i, texts[i])
                    new[i] = t[:s] + mark.encode() + t[e:]
            cols = []
            for field in schema:
                col = c.column(field.name)
                if field.name == "text" and new:
                    col = pa.array([new[i].decode("utf-8", "replace") if i in new else v for i, v in enumerate(col.to_pylist())], col.type)
                cols.append(col)
            yield pa.record_batch(cols, names=schema.names)

    return docs.select("*", text_bytes().alias("__bytes")).transform(map_arrow, run, schema)


def learn(docs: DataFrame) -> tuple[Dictionary, Forest, DataFrame]:
    """Dictionary, forest and staged candidates of docs (doc_id, text), labelled by origin."""
    dictionary = learn_dictionary(docs)
    found = stage(find_candidates(docs, dictionary), "candidates")
    return dictionary, train_forest(found), found


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, forest, found = learn(read(spark, sf_dir, "documents"))
    return judge(found, forest).select("doc_id", "start", "end", "sha256", "score", "is_secret")
