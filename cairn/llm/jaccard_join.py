"""N-gram Jaccard self-join of documents with set-relation skipping.

A document's set holds its distinct five-word shingles.  Two sets link when their Jaccard similarity
reaches `percent` / 100.  The join is exact up to 64-bit hashes of words, shingles and sets:

1. Equal sets are one set from here on, so copies cost nothing.
2. Prefix index: shingles are put in one fixed order, and each set is listed under its first
   n - ceil(t n) + 1; linked sets share one of these.  First come shingles in the lower half of the
   hash range, then those of `hot_sets` sets or more, by number of sets, so that passages many texts
   share list few of them, then the upper half.  Sets are counted for the shingles that may come early:
   the lower half, and more where that holds less than a set's prefix.  Of more than `most_hot`
   frequent ones the most frequent are taken.  The order affects the cost only.
3. Index-level skipping: a list is sorted by the position of its shingle in each set.  The set at
   the lowest position leads the list and is compared with the others; position and size bounds
   skip those that cannot reach the threshold, and lists with equal members are kept once.  Parity
   cells, about two bits for each shingle, bound the symmetric difference of a pair from below and
   rule out most false candidates before whole sets are moved.
4. Answer-level skipping: sets linked to their leader are connected already.  Sets outside the
   leader's component are compared with another member of it per list, which connects most.  Of
   the pairs of a list still in different components, the overlaps with the shared leader X bound
   the overlap of Y and Z,

       |X∩Y| + |X∩Z| - |X|  <=  |Y∩Z|  <=  min(|X∩Z| + |Y\\X|, |X∩Y| + |Z\\X|),

   and only pairs that these bounds, then the parity cells, leave open are compared.  Outsiders of a
   list meet its members in blocks of `block_rows`, so no task holds a long list or more than the square
   of that in pairs (some 20 bytes each); in a block, both sides are sorted by size, and slices of it meet
   only the sizes that they can link with.  Components that sure pairs of the block join are not compared further.

Lists of very frequent shingles are dealt to tasks in parts of about `list_rows` sets; the leaders of
the parts are compared too, and step 4 sees the whole list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import chunks, map_arrow, mix64, read, release, shingle_sets, stage, text_bytes
from cairn.llm.graph import connected_components

_POSTING = np.dtype([("h", "<u8"), ("sid", "<i8"), ("n", "<i4"), ("pos", "<i4")])
_U = np.uint64
_HALF = _U(1 << 63)


def _set_id(hashes: np.ndarray) -> int:
    """64-bit identity of a set: of its size and two symmetric sums of mixed hashes."""
    m = mix64(hashes)
    with np.errstate(over="ignore"):
        both = np.array([m.sum(dtype=np.uint64) + _U(len(m)) * _U(0x9E3779B97F4A7C15), np.bitwise_xor.reduce(m)], np.uint64)
        return int(mix64(mix64(both[:1]) + both[1:]).view(np.int64)[0])


def _bits(hashes: np.ndarray) -> bytes:
    """Per cell the parity of how many hashes fall there; about two cells per hash, 256 to 2**17 in all."""
    cells = min(1 << 17, max(256, 1 << (2 * len(hashes)).bit_length()))
    at = ((hashes >> _U(7)) & _U(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: bytes, most: int = 128) -> bytes:
    """The same cells folded into at most so many bytes."""
    x = np.frombuffer(bits, np.uint64)
    while 8 * len(x) > most:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the size of the symmetric difference: cells of different parity."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_CODE_BITS, _CODE_PLANES = 43, 6


def _codes(hashes: np.ndarray) -> np.ndarray:
    """What a shingle is counted under: the upper bits of its hash."""
    return (hashes >> _U(63 - _CODE_BITS)).view(np.int64)


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            sets = shingle_sets(c, size)
            sid = [_set_id(s) if len(s) else 0 for s in sets]
            bits = [_bits(s) if len(s) else None for s in sets]
            few = [None if x is None else _fold(x) for x in bits]
            cols = [c.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary()), pa.array(few, pa.binary())]
            yield pa.record_batch(cols, ["doc_id", "n", "sid", "bits", "few_bits"])

    return run


def _distinct_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(id, hashes) of the non-empty sets of a task, equal ones once."""
    seen = set()
    for c in chunks(batches):
        for s in shingle_sets(c, size):
            sid = _set_id(s) if len(s) else 0
            if len(s) and sid not in seen:
                seen.add(sid)
                yield sid, s


def _prefix(n: int, percent: int) -> int:
    return n - _least_overlap(n, percent) + 1


def _count(size: int, percent: int, buckets: int, flush: int = 500_000):
    """Rows (bucket, codes): counted codes, sorted, as byte planes of their differences and of their numbers of sets."""

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (codes * buckets) >> _CODE_BITS
        edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
        steps = np.diff(codes, prepend=0)
        steps[edge] = codes[edge]
        planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8)[:, :_CODE_PLANES], n.astype("<u4").view(np.uint8).reshape(-1, 4)], 1)
        blobs = [planes[s:e].T.tobytes() for s, e in zip(edge, np.append(edge[1:], len(codes)))]
        return pa.record_batch([pa.array(bucket[edge]), pa.array(blobs, pa.binary())], ["bucket", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for _, s in _distinct_sets(batches, size):
            held.append(_codes(s[: max(int(np.searchsorted(s, _HALF)), _prefix(len(s), percent))]))
            rows += len(held[-1])
            if rows > flush:
                yield pack(held)
                held, rows = [], 0
        if rows:
            yield pack(held)

    return run


def _frequent_codes(least: int):
    def run(table: pa.Table) -> pa.Table:
        codes, counts = [], []
        for blob in table["codes"].to_pylist():
            planes = np.frombuffer(blob, np.uint8).reshape(_CODE_PLANES + 4, -1)
            wide = np.zeros((planes.shape[1], 8), np.uint8)
            wide[:, :_CODE_PLANES] = planes[:_CODE_PLANES].T
            codes.append(np.cumsum(wide.view(np.int64).ravel()))
            counts.append(np.ascontiguousarray(planes[_CODE_PLANES:].T).view("<u4").ravel())
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        keep = n >= least
        return pa.table([pa.array(code[keep]), pa.array(n[keep])], names=["code", "n"])

    return run


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _post(size: int, percent: int, buckets: int, frequent, flush: int = 200_000):
    """Rows (bucket, part, postings): the prefix postings of every set, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank, parts = frequent.value
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            p = np.concatenate(held)
            bucket = ((p["h"] >> _U(33)) % _U(buckets)).astype(np.int64)
            part = (mix64(p["sid"].view(np.uint64)) % _find(hot, parts, p["h"], 1).astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, bucket))
            p, bucket, part = p[order], bucket[order], part[order]
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(part) != 0)]))
            ends = np.append(edge[1:], len(p))
            return pa.record_batch([pa.array(bucket[edge]), pa.array(part[edge]), pa.array([p[s:e].tobytes() for s, e in zip(edge, ends)], pa.binary())], ["bucket", "part", "postings"])

        for sid, s in _distinct_sets(batches, size):
            n = len(s)
            late, k = _find(hot, rank, s, -1), _prefix(n, percent)
            late[(late < 0) & (s >= _HALF)] = len(hot)
            if late[:k].max() >= 0:
                s = s[np.argsort(late, kind="stable")]
            p = np.empty(k, _POSTING)
            p["h"], p["sid"], p["n"], p["pos"] = s[:k], sid, n, np.arange(k)
            held.append(p)
            rows += k
            if rows > flush:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return run


def _find(hot: np.ndarray, values: np.ndarray, hashes: np.ndarray, other: int) -> np.ndarray:
    """Values of the frequent codes of hashes, other where a hash's code is not frequent."""
    if not len(hot):
        return np.full(len(hashes), other, np.int64)
    code = _codes(np.ascontiguousarray(hashes))
    at = np.minimum(np.searchsorted(hot, code), len(hot) - 1)
    return np.where(hot[at] == code, values[at], other)


_MEMBER = "list_id long, sid long, n int, pos int, leader long, leader_n int, leader_pos int, parts long"


def _lists(frequent):
    """Lists of two or more sets in one bucket, each led by the set at the lowest position."""

    def run(table: pa.Table) -> pa.Table:
        hot, _, parts = frequent.value
        p = np.frombuffer(b"".join(table["postings"].to_pylist()), _POSTING)
        p = p[np.lexsort((p["sid"], p["pos"], p["h"]))]
        if len(p) > 1:  # a set comes from as many tasks as hold copies of it
            p = p[np.concatenate([[True], (p["h"][1:] != p["h"][:-1]) | (p["sid"][1:] != p["sid"][:-1])])]
        edge = np.flatnonzero(np.concatenate([[True], p["h"][1:] != p["h"][:-1]])) if len(p) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(p)))
        dealt = _find(hot, parts, p["h"][edge], 1)
        if len(edge):
            with np.errstate(over="ignore"):
                same = np.add.reduceat(mix64(p["sid"].view(np.uint64)), edge) + mix64(p["sid"][edge].view(np.uint64))
            _, first = np.unique(same, return_index=True)
            keep = np.zeros(len(edge), bool)
            keep[first] = True
            keep = (keep & (count > 1)) | (dealt > 1)
            edge, count, dealt = edge[keep], count[keep], dealt[keep]
        at = np.repeat(edge - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(edge) else np.zeros(0, np.int64)
        m, lead = p[at], p[np.repeat(edge, count)] if len(edge) else p[:0]
        cols = [m["h"].view(np.int64), m["sid"], m["n"], m["pos"], lead["sid"], lead["n"], lead["pos"], np.repeat(dealt, count)]
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in cols], names=["list_id", "sid", "n", "pos", "leader", "leader_n", "leader_pos", "parts"])

    return run


def _sets(size: int):
    """(sid, hashes) of rows whose text has the set they are wanted for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            out = [(i, s.tobytes()) for i, s in zip(c.column("sid").to_pylist(), shingle_sets(c, size)) if len(s) and _set_id(s) == i]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["sid", "hashes"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x, y in zip(b.column("x"), b.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            out.append((len(x), len(y), int((both[1:] == both[:-1]).sum())))
        n = np.array(out, np.int64).reshape(-1, 3)
        yield pa.record_batch([b.column("a"), b.column("b"), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(n[:, 2])], ["a", "b", "n_a", "n_b", "both"])


def _not_ruled_out(percent: int):
    """Pairs whose cells of different parity leave room for the overlap they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            room = total - 2 * -(-percent * total // (100 + percent))
            least = [_least_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column("x"), b.column("y"))]
            ok = pa.array(np.array(least, np.int64) <= room)
            yield pa.record_batch([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    return run


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of distinct set ids that the parity cells of both sets do not rule out."""
    with_a = pairs.join(classes.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x")), "a")
    both = with_a.join(classes.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y")), "b")
    return both.select("a", "b", "n_a", "n_b", "x", "y").transform(map_arrow, _not_ruled_out(percent), "a long, b long")


def _reaches(n_a: str, n_b: str, both: str, percent: int):
    """100 |A∩B| >= percent |A∪B| for the overlap (or a bound of it) in the SQL expression both."""
    return F.expr(f"(100 + {percent}) * ({both}) >= {percent} * ({n_a} + {n_b})")


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both) for distinct pairs of set ids."""
    with_a = pairs.join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a")
    return with_a.join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y").transform(map_arrow, _overlaps, "a long, b long, n_a long, n_b long, both long")


def _cell_tables(blobs: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Of cells folded by _fold: words of 64 cells that each has, and per number of words all that have as many, folded to it."""
    words = np.array([len(x) // 8 for x in blobs])
    tables = {16: np.frombuffer(b"".join(x.ljust(128, b"\0") for x in blobs), np.uint64).reshape(-1, 16)}
    for w in (8, 4):
        wide = tables[2 * w]
        tables[w] = np.where((words > w)[:, None], wide[:, :w] ^ wide[:, w:], wide[:, :w])
    return words, tables


class _Joined:
    """Components of a task's rows, of which some are joined by pairs that are sure to link."""

    def __init__(self, components: np.ndarray):
        self.of = np.unique(components)
        self.root = np.arange(len(self.of))

    def apart(self, a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Which pairs of components still say something: the sure ones that join two, and the others of two that nothing has joined."""
        a, b = np.searchsorted(self.of, a), np.searchsorted(self.of, b)
        keep = (self.root[a] != self.root[b]) & ~sure
        at = np.flatnonzero((self.root[a] != self.root[b]) & sure)
        while len(at):
            # of each higher root the first pair joins it to a lower one; those then joined already drop out
            low, high = np.minimum(self.root[a[at]], self.root[b[at]]), np.maximum(self.root[a[at]], self.root[b[at]])
            _, first = np.unique(high, return_index=True)
            keep[at[first]] = True
            to = np.arange(len(self.of))
            to[high[first]] = low[first]
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]
            at = at[self.root[a[at]] != self.root[b[at]]]
        return keep & (sure | (self.root[a] != self.root[b]))


def _open_blocks(percent: int, rows: int = 128, pairs: int = 50_000):
    """Pairs (a, b, sure) of outsiders and members of lists, in different components, that no bound rules out.

    Of pairs that are sure to link, a task gives only as many as join its components, and none of two components that these join.
    """
    enough = lambda total, both: (100 + percent) * both >= percent * total
    columns = ("list_id", "sid", "n", "pos", "leader", "leader_n", "both", "component", "outside")

    def table(t: pa.Table) -> dict:
        t = t.sort_by([("list_id", "ascending"), ("n", "ascending")])
        words, tables = _cell_tables(t["few_bits"].to_pylist())
        return {c: t[c].to_numpy() for c in columns} | {"words": words} | {f"cells{w}": x for w, x in tables.items()}

    def part(d: dict, begin: int, end: int) -> dict:
        return {c: v[begin:end] for c, v in d.items()}

    def meet(y: dict, z: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        total = y["n"][:, None] + z["n"]
        ok = (y["component"][:, None] != z["component"]) & (~z["outside"] | (y["sid"][:, None] < z["sid"]))
        before = np.minimum(y["pos"][:, None], z["pos"])
        ok &= enough(total, before + np.minimum((y["n"] - y["pos"])[:, None], z["n"] - z["pos"]))
        known = (y["leader"][:, None] == z["leader"]) & (y["both"] >= 0)[:, None] & (z["both"] >= 0)
        most = np.minimum(z["both"] + (y["n"] - y["both"])[:, None], y["both"][:, None] + z["n"] - z["both"])
        ok &= ~known | enough(total, most)
        sure = ok & known & enough(total, y["both"][:, None] + z["both"] - y["leader_n"][:, None])
        left, right = np.nonzero(ok)
        for s in range(0, len(left), pairs):
            i, j = left[s : s + pairs], right[s : s + pairs]
            width, least = np.minimum(y["words"][i], z["words"][j]), np.zeros(len(i), np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                least[at] = np.bitwise_count(y[f"cells{w}"][i[at]] ^ z[f"cells{w}"][j[at]]).sum(1)
            t = total[i, j]
            keep = sure[i, j] | (least <= t - 2 * -(-percent * t // (100 + percent)))
            i, j = i[keep], j[keep]
            yield y["sid"][i], z["sid"][j], sure[i, j], y["component"][i], z["component"][j]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        if left.num_rows and right.num_rows:
            y, z = table(left), table(right)
            joined = _Joined(np.concatenate([y["component"], z["component"]]))
            ids, begin = np.unique(y["list_id"], return_index=True)
            end = np.append(begin[1:], len(y["list_id"]))
            zb, ze = np.searchsorted(z["list_id"], ids, "left"), np.searchsorted(z["list_id"], ids, "right")
            for k in range(len(ids)):
                sizes = z["n"][zb[k] : ze[k]]
                for s in range(begin[k], end[k], rows):
                    own = part(y, s, min(s + rows, end[k]))
                    lo = np.searchsorted(sizes, -(-percent * own["n"][0] // 100), "left")
                    hi = np.searchsorted(sizes, 100 * own["n"][-1] // percent, "right")
                    for a, b, sure, of_a, of_b in meet(own, part(z, zb[k] + lo, zb[k] + hi)):
                        keep = joined.apart(of_a, of_b, sure)
                        a, b, sure = a[keep], b[keep], sure[keep]
                        found.append((np.minimum(a, b), np.maximum(a, b), sure))
        a, b, sure = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.lexsort((~sure, b, a))
        a, b, sure = a[order], b[order], sure[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        return pa.table([pa.array(a[new]), pa.array(b[new]), pa.array(sure[new])], names=["a", "b", "sure"])

    return run


#: Which of the parts that a list is dealt in has a set.
_DEAL = "pmod(xxhash64(sid), parts)"


def _with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows (list_id, sid, parts, ...) with the columns of lists (list_id, parts, ...): a long list in as many tasks as it has parts."""
    each = lists.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return rows.withColumn("deal", F.expr(_DEAL)).join(each, ["list_id", "deal"]).drop("deal")


def _mixed_lists(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the lists that have undecided pairs, marked as outside of the leader's component or not.

    A leader's own pairs are decided, so its row goes, unless the list was dealt in parts; then the
    rest of a list has to hold several components.
    """
    m = members.join(groups.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    rest = (F.col("parts") > 1) | (F.col("sid") != F.col("leader"))
    lists = m.groupBy("list_id").agg(
        F.max("parts").alias("parts"), F.min(F.when(rest, F.col("component"))).alias("c0"), F.max(F.when(rest, F.col("component"))).alias("c1"), F.min(F.struct("pos", "sid", "component")).alias("head"), F.count("*").alias("size")
    ).where("c0 <> c1")
    return _with_lists(m.where(rest), lists.select("list_id", "parts", "head", "size")).select(*m.columns, "size", (F.col("component") != F.col("head.component")).alias("outside"))


def _second_leaders(mixed: DataFrame) -> DataFrame:
    """Pairs of each outsider with a random member of its list's main component."""
    pick = mixed.where("not outside").groupBy("list_id").agg(F.max("parts").alias("parts"), F.min(F.struct(F.xxhash64("sid", "list_id").alias("r"), F.col("sid"))).alias("m"))
    pairs = _with_lists(mixed.where("outside"), pick).select(F.col("m.sid").alias("a"), F.col("sid").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open_pairs(mixed: DataFrame, classes: DataFrame, percent: int, block_rows: int) -> DataFrame:
    m = stage(mixed.join(classes.select("sid", "few_bits"), "sid").withColumn("both", F.coalesce("both", F.lit(-1))), "mixed")
    again = m.sparkSession.read.schema(m.schema).parquet(m._cairn_path)
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    # short lists share tasks, of about as many rows as a block has
    few = F.pmod(F.xxhash64("list_id"), F.lit(m.count() // block_rows + 1))
    keys = ["few", "y_block", "z_block"]
    y = m.where("outside").select("*", few.alias("few"), own.alias("y_block"), every.alias("z_block"))
    z = again.select("*", few.alias("few"), own.alias("z_block"), every.alias("y_block"))
    found = y.groupBy(*keys).cogroup(z.groupBy(*keys)).applyInArrow(_open_blocks(percent), "a long, b long, sure boolean")
    out = stage(found.groupBy("a", "b").agg(F.max("sure").alias("sure")), "open")
    release(m)
    return out


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, count_rows: int = 1_000_000, bucket_rows: int = 400_000, list_rows: int = 50_000, hot_sets: int = 8, most_hot: int = 2_000_000, broadcast_ids: int = 500_000, block_rows: int = 2_000) -> DataFrame:
    """doc_id, n_shingles, set_id, class_id and component_id of every row of docs (doc_id, text).

    class_id is the least doc_id with an equal set, component_id the least one reachable by links.
    Rows without words have no shingles, set_id 0 and themselves as class and component.  A null
    doc_id links with nothing and has null class and component.  Rows that repeat a doc_id with
    different texts count as different documents under one number.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    some = texts.where(F.col("doc_id").isNotNull())
    profiles = stage(texts.transform(map_arrow, _profile(size), "doc_id long, n long, sid long, bits binary, few_bits binary"), "profiles")
    sized = profiles.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = stage(sized.groupBy("sid").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.first("bits").alias("bits"), F.first("few_bits").alias("few_bits")), "classes")

    shingles = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count_buckets = min(1 << 20, int(shingles) // count_rows + 8)
    codes = some.transform(map_arrow, _count(size, percent, count_buckets), "bucket long, codes binary").groupBy("bucket").applyInArrow(_frequent_codes(hot_sets), "code long, n long")
    top = codes.orderBy(F.desc("n"), "code").limit(most_hot).toArrow()
    hot, df = top["code"].to_numpy(), top["n"].to_numpy()
    rank = np.empty(len(hot), np.int64)
    rank[np.lexsort((hot, df))] = np.arange(len(hot))
    order = np.argsort(hot)
    frequent = spark.sparkContext.broadcast((hot[order], rank[order], (-(-df // list_rows))[order]))

    postings = classes.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1), F.lit(0)).alias("p")).first()["p"]
    buckets = max(8, -(-int(postings) // bucket_rows))
    packed = some.transform(map_arrow, _post(size, percent, buckets, frequent), "bucket long, part long, postings binary")
    members = stage(packed.groupBy("bucket", "part").applyInArrow(_lists(frequent), _MEMBER), "lists")

    # position and size bounds: at most the shingles before, the shared one, and those after in the shorter rest
    bound = "least(pos, leader_pos) + 1 + least(n - pos, leader_n - leader_pos) - 1"
    led = members.where((F.col("sid") != F.col("leader")) & _reaches("n", "leader_n", bound, percent)).select(F.col("leader").alias("a"), F.col("sid").alias("b"))
    heads = members.where("parts > 1 and sid = leader")
    over = heads.groupBy("list_id").agg(F.min(F.struct("pos", "sid")).alias("m")).join(heads.select("list_id", "sid"), "list_id").where("m.sid <> sid")
    led = led.unionByName(over.select(F.col("m.sid").alias("a"), F.col("sid").alias("b"))).distinct()

    def measured(pairs: DataFrame) -> DataFrame:
        """Overlaps of the pairs that may reach the threshold.  Sets are made anew from one text of each class;
        texts are shuffled only if the sets are many."""
        pairs = stage(_possible(pairs, classes, percent), "pairs")
        ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(classes, "sid").select("sid", F.col("class_id").alias("doc_id")), "ids")
        near = some.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc_id")
        sets = stage(near.select("sid", "text").transform(map_arrow, _sets(size), "sid long, hashes binary"), "sets")
        out = stage(_measure(pairs, sets), "overlaps")
        release(pairs, ids, sets)
        return out

    def linked(overlaps: DataFrame) -> DataFrame:
        return overlaps.where(_reaches("n_a", "n_b", "both", percent)).select("a", "b")

    first = measured(led)
    groups = connected_components(linked(first))
    known = first.select(F.col("a").alias("leader"), F.col("b").alias("sid"), "both")
    rows = members.join(known, ["leader", "sid"], "left").withColumn("both", F.when(F.col("sid") == F.col("leader"), F.col("n").cast("long")).otherwise(F.col("both")))

    second = measured(_second_leaders(_mixed_lists(rows, groups)))
    links = linked(first).unionByName(linked(second))
    if linked(second).take(1):
        groups = connected_components(links)
    left = _open_pairs(_mixed_lists(rows, groups), classes, percent, block_rows)
    third = measured(left.where("not sure").select("a", "b"))
    last = linked(third).unionByName(left.where("sure").select("a", "b"))
    if last.take(1):
        groups = connected_components(links.unionByName(last))
    release(members, first, second, third, left)

    at = profiles.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    least = at.where(linkable).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = at.join(least, "component", "left").join(classes.select("sid", "class_id"), "sid", "left")
    own = lambda c: F.when(linkable, F.col(c)).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), own("class_id").alias("class_id"), own("component_id").alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
