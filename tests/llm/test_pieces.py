"""The encoder and decoder against the sentencepiece library."""

import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

from trialspan.llm import pieces as M  # noqa: E402


@pytest.fixture(scope="module")
def both():
    with open(M.model_path(), "rb") as f:
        model = f.read()
    return M.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def check(both, texts):
    p, sp = both
    ids, counts, joined = p.encode(texts)
    ends = np.cumsum(counts)
    back = p.decode(ids, counts)
    for t, e, c, j, d in zip(texts, ends, counts, joined, back, strict=True):
        want = sp.encode(t or "")
        assert ids[e - c:e].tolist() == want, repr(t)[:200]
        assert j == ",".join(map(str, want))
        assert d == sp.decode(want), repr(t)[:200]


EDGES = [None, "", " ", "  ", " " * 50 + "x", "a", "\x00a", "\ta\r\nb", "▁x", "a▁▁ b", "日本語\U0001f642", "a" * 5000,
         "ab" * 4000, " " * 3000, "é́", "�", "x" * 3000 + " the end", "\n" * 10, " 　", "thththth the thehe"]


def test_edges(both):
    check(both, EDGES)


def test_random_texts(both):
    rng = random.Random(5)
    pools = ["abcdehinorst ", "the in on er re a▁ ", "éèàüßñ aeiou\n", "\U0001f600中文あ \tabc", "!#$%&*() A1"]
    check(both, ["".join(rng.choice(pools[i % 5]) for _ in range(rng.randrange(1, 300))) for i in range(600)])


def test_rounds_equal_heap_on_long_words(both):
    p, sp = both
    rng = random.Random(3)
    for pool in ("ab", "the", "aeiounrst"):
        w = "".join(rng.choice(pool) for _ in range(6000))
        check(both, [w])
        sym = p.char[np.frombuffer(("▁" + w[:1500]).encode("utf-32-le"), dtype=np.uint32)]
        a, _ = p.merge_rounds(sym.copy(), np.zeros(len(sym), dtype=np.int64))
        assert a.tolist() == p.merge_long(sym.tolist())[1] == sp.encode(w[:1500])


def test_decoding_any_ids(both):
    p, sp = both
    rng = random.Random(9)
    for _ in range(300):
        ids = [rng.randrange(3, 400) if rng.random() < .7 else rng.randrange(0, p.n) for _ in range(rng.randrange(1, 30))]
        assert p.decode(np.array(ids), np.array([len(ids)])) == [sp.decode(ids)], ids


def test_frame(spark, both):
    rows = [(i, t, i) for i, t in enumerate(EDGES)] + [(3, "  ", 9), (None, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = M.encode(df, M.model_path()).collect()
    assert len(got) == len(rows)
    want = {i: both[1].encode(t or "") for i, t in enumerate(EDGES)}
    assert all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in got if r.doc_id is not None)
    back = {r.doc_id: r.text for r in M.decode(M.encode(df, M.model_path()), M.model_path()).collect()}
    assert all(back[i] == both[1].decode(want[i]) for i in want)
    assert M.encode(df.limit(0), M.model_path()).count() == 0
