import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cairn.llm import sentencepiece_fst as sp
from tests.llm.fixtures import frame, rows, with_clashes

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "   a", "a  b", "a   \n  b  ", "\n\n x", "def f(x):\n    return x+1\n\n\n        y = 2  ", "日本語 😀😀", "\tabc\t\td", "a▁b ▁ c", "▁▁x", "z".join([" " * 25] * 3), "x" * 200, " \n", "\n ", "<s> </s> <0x41>"]


@pytest.fixture(scope="module")
def model():
    return sp.load(PATH)


def test_ids_equal_the_library(model):
    rng = random.Random(1)
    texts = ODD + [r[1] or "" for r in rows()] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    \nABC0123.,éü日▁") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t, got in zip(texts, sp.Encoder(model).encode([t.encode() for t in texts])):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == library.encode(t), t
        assert sp.decode(model, ids).decode() == t.replace("▁", " ")


def test_weights_equal_merging(model):
    """The arc between two pieces is open just where merging their joint text gives them back."""
    rng = random.Random(4)
    ids = [i for i in model.made_of if "▁▁" not in model.pieces[i].decode()]
    for _ in range(3000):
        p, q = rng.choice(ids), rng.choice(ids)
        both = (model.pieces[p] + model.pieces[q]).decode()
        assert (sp.follow_weight(model, p, q) == 0.0) == (sp.merge(model, both)[0] == [model.pieces[p].decode(), model.pieces[q].decode()]), both


def test_query_columns(spark, model):
    out = sp.encode_and_decode(with_clashes(frame(spark)), model)
    got = out.collect()
    assert len(got) == len(rows()) and all(r.round_trip for r in got)
    assert all(r.decoded == (r.text or "") and len(r.pieces) == r.n_pieces for r in got)
    assert sp.encode_and_decode(frame(spark, []), model).count() == 0


def test_path_is_the_least_of_all(model):
    """Against every way to spell a segment in pieces, and against byte-pair merging."""
    m = model
    inf = float("inf")

    def paths(s, last=sp._BYTE):
        if not s:
            yield 0.0, ()
        for e in range(1, len(s) + 1):
            q = m.arcs.get(s[:e])
            if q is None:
                break
            if q != sp._BYTE:
                w = 0.0 if last == sp._BYTE else sp.follow_weight(m, last, q)
                yield from ((w + v, (q, *rest)) for v, rest in paths(s[e:], q))

    for word in ("the", "walking", "unhappily", "Straße", "aaaa", "x1y2", "theeee"):
        s = sp.SPACE + word
        ends = sorted(paths(s))
        assert ends[0][0] == 0.0 and all(w == inf for w, _ in ends[1:])
        assert list(ends[0][1]) == sp.shortest_path(m, s) == [m.id_of[x] for x in sp.merge(m, s)[0]]
    assert sp.fallback_arc(m, "a")[1] == inf and sp.fallback_arc(m, "\U0001f9ff")[1] == 1.0
