import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairn.llm import repair_tokens as rt
from tests.llm.fixtures import folder, frame, rows, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a...b, c.,d !.! it's I'LL 3.14", "ÉÈ…. x_.y ‰.", "é É", "<|endoftext|> x <|startoftext|>", " a\x1cb c", "日本語。テスト. İI ß", "!!!,,,", ". ,"]
ODD += ["<|ENDOFTEXT|> x", "a<|EndOfText|>b", "İ. İ, x.", "a\x1c. b\x1c, c", "J\u030c H\u0331. e\u0301,", "Σ. Ж, 5. \u0663. ª. ×. ÷,", "\ufffd. \u00a0. a\u0085b", "x² ½. Ⅷ."]


def ids_of(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_words_encode_as_whole_texts():
    coder = rt.WordCoder(PATH)
    texts = ODD + [r[1] or "" for r in rows()]
    for t, got in zip(texts, coder.encode([t.encode() for t in texts])):
        assert got == ids_of(t).tobytes(), t


def test_fuzzed_texts_encode_as_whole():
    rng = random.Random(8)
    signs = list("aAbéÉÈßİıÇñÑ.,..,, \n\t'’sSTtMm0159-_&#*|<>?!\x1c\x85\u00a0\u0301\u030c\u0331ǰJjhΣσςЖжж中。あ½²Ⅷª×÷\u0663\u2028") + ["<|endoftext|>", "<|EndOfText|>", "the ", "Word", "'ll", "N'T", ", ", ". "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 24))) for _ in range(50_000)]
    whole = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    coder = rt.WordCoder(PATH)
    for k in range(0, len(texts), 1000):
        for t, got, want in zip(texts[k : k + 1000], coder.encode([t.encode() for t in texts[k : k + 1000]]), whole[k:]):
            assert got == np.array(want.ids + [1], "<u4").tobytes(), repr(t)


def test_files_hold_every_document(spark, tmp_path):
    data = rows() + [(400 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in rt.op7_repair_tokens(spark, folder(spark, tmp_path, data)).collect())
    want, at = [], 0
    for i, t, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = ids_of(t)
        want.append((-1 if i is None else i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)


@pytest.mark.parametrize("kind", ["random", "runs", "text", "tiny", "empty"])
def test_round_trip(kind):
    rng = np.random.default_rng(1)
    ids = {
        "random": rng.integers(2, 50, 20_000),
        "runs": np.repeat(rng.integers(2, 5, 500), rng.integers(1, 40, 500)),
        "text": np.tile(rng.integers(2, 1000, 700), 30),
        "tiny": np.array([5]),
        "empty": np.zeros(0, np.int64),
    }[kind].astype(np.uint32)
    rules, lengths, seq = rt.compress(ids, 1000)
    assert np.array_equal(rt.expand(seq, rules, lengths, 1000), ids)
    if kind in ("runs", "text"):
        assert len(seq) + 2 * len(rules) < len(ids) / 2


def test_random_access(spark):
    files = rt.encode_shards(frame(spark), PATH, shard_ids=500).collect()
    for row in map(lambda r: r.asDict(), files):
        for k, i in enumerate(row["doc_ids"]):
            if i is not None and i < 60:
                assert np.array_equal(rt.document_ids(row, k), ids_of(rows()[i][1]))


def test_repeated_rows_and_clashing_columns_fall_in_parts(spark):
    data = [(5, f"text number {i % 7} of five", "en", "s", 0) for i in range(50)] + [(5, "long words " * 120_000, "en", "s", 0)]
    files = rt.encode_shards(with_clashes(frame(spark, data)), PATH, part_bytes=200)
    got = rt.decode_shards(files).collect()
    assert len(got) == 51 and {r.doc_id for r in got} == {5}
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(ids_of(t).tobytes()) for _, t, *_ in data)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_grammar_leaves_no_frequent_pair():
    ids = np.random.default_rng(2).integers(2, 40, 30_000).astype(np.uint32)
    _, _, seq = rt.compress(ids, 1000, min_count=30)
    assert np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)[1].max() < 2 * 30  # overlaps of equal symbols count twice
    assert len(rt.compress(ids, 65_500)[0]) == 36


def test_empty_table(spark, tmp_path):
    assert rt.op7_repair_tokens(spark, folder(spark, tmp_path, [])).count() == 0
