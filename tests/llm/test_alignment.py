import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import alignment
from tests.llm.fixtures import SCHEMA, frame, rows, with_clashes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    """Characters of the byte-level form, as GPT-2 style vocabularies list them."""
    bs = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    cs, n = bs[:], 0
    for b in range(256):
        if b not in bs:
            bs.append(b)
            cs.append(256 + n)
            n += 1
    return dict(zip(map(chr, cs), bs))


def brute(data):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row, a token and a pair at a time."""
    a, b, value = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    a.encode_special_tokens = True
    found, held = [], Counter()
    for doc_id, text, *_ in data:
        links, groups = [], []
        if text:
            ta = [(i, bytes(value[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = []
            for i in b.encode(text):
                p = b.id_to_piece(i)
                tb.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(t for _, t in ta) == whole and b"".join(t for _, t in tb) == whole:
                owner, at = [], 0
                for j, (_, t) in enumerate(tb):
                    owner += [j] * len(t)
                for i, t in ta:
                    links += [(i, tb[j][0]) for j in dict.fromkeys(owner[at : at + len(t)])]
                    at += len(t)
                groups = cut(ta, tb)
        held.update(set(links))
        n_a, n_b = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups)
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((doc_id, n_a, n_b, len(groups), links, hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return Counter((d, x, y, g, len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), s) for d, x, y, g, ls, s in found)


def cut(ta, tb):
    """Groups (ids of A, ids of B) between the offsets where tokens of both end."""
    ends = [set(np.cumsum([len(t) for _, t in ts]).tolist()) for ts in (ta, tb)]
    sides = []
    for ts in (ta, tb):
        at, group, every = 0, [], []
        for i, t in ts:
            at += len(t)
            group.append(i)
            if at in ends[0] and at in ends[1]:
                every.append(group)
                group = []
        sides.append(every)
    return list(zip(*sides, strict=True))


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.fixture(scope="module")
def data():
    odd = ["▁not the text", "a <|endoftext|> b <s> </s> <unk> <0x41>", "\x00\x01 zero", "  two  spaces ", "emoji 😀👍🏽 ﬁ é́ 漢字", "a\r\n\tb", " ", "x", "�", "naïve space", "1234567890" * 30]
    return rows(n=24) + [(500 + i, t, None, None, None) for i, t in enumerate(odd)] + [(900, None, None, None, None)]


def test_equals_brute_force(spark, data):
    docs = with_clashes(frame(spark, data)).withColumn("a_ids", F.lit("x")).withColumn("pair", F.lit("y")).repartition(3)
    want = brute(data)
    assert got(alignment.align(docs, A, B)) == want
    assert any(r[1] and r[3] < min(r[1], r[2]) for r in want) and (500, 0, 0, 0, 0, 0, 0, "") in want


def test_slices_and_small_chunks_change_nothing(spark, data, monkeypatch):
    monkeypatch.setattr(alignment, "TASK_PAIRS", 50)
    monkeypatch.setattr(alignment, "ENCODE_BYTES", 500)
    assert got(alignment.align(frame(spark, data).repartition(3), A, B, with_ids=False, most_pairs=60)) == brute(data)


def test_ranks_and_the_files_own_library_agree():
    import random

    rng, own = random.Random(4), Tokenizer.from_file(A)
    own.encode_special_tokens = True
    some = ["a", "B", " ", "  ", "\n", "\t", ".", "'s", "'LL", "1", "é", "漢", "\u00a0", "\x1c", "<|endoftext|>", "😀", "!!", "ß", "word", "\x00", "²", "٣"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    assert alignment.Tokenizers.at(A, B).a_ids(texts) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_a_file_of_another_kind_is_read_by_its_own_library():
    other = public_tokenizers.path("word_bpe_49k.json")
    assert alignment.Tokenizers._ranks(None, __import__("json").loads(Tokenizer.from_file(other).to_str()), {}) is None


def test_ids_come_back(spark):
    r = alignment.align(frame(spark, [(1, "two words", "en", None, 9)]), A, B).first()
    assert np.frombuffer(r["a_ids"], "<u4").tolist() == Tokenizer.from_file(A).encode(" two words").ids and r["n_links"] == r["n_groups"] == 2


def test_empty_table_and_bytes_that_are_no_text(spark):
    assert got(alignment.align(spark.createDataFrame([], SCHEMA), A, B)) == Counter()
    broken = spark.sql("select 1L doc_id, cast(X'61FF62' as string) text")
    assert got(alignment.align(broken, A, B)) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 1})
