"""Token counts against the tokenizers library."""

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from trialspan.llm import token_counts as M  # noqa: E402


@pytest.fixture(scope="module")
def both():
    return M.Counter(M.vocabulary(M.vocabulary_path())), tokenizers.Tokenizer.from_file(M.vocabulary_path())


def check(both, texts):
    c, lib = both
    got = c.count(texts)
    for t, n in zip(texts, got.tolist(), strict=True):
        assert n == len(lib.encode(t or "", add_special_tokens=False).ids), repr(t)[:200]


EDGES = [None, "", " ", "  ", "\n", "\t's", " 's", "  's", "'s's", "''s", "'lla", "'re", "'r", "'", "I'm he'd we've they'll",
         "it'S", "a  b", "a \n b", "a\n\n", "x   ", "12ab34", "½²x", "a  b", "a　b", "é́ ü 日本語 \U0001f642\U0001f642",
         "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", " <|endoftext|>'s", "a" * 5000, "ab" * 4000,
         " " * 3000, "\x00\x1c\x85", "-" * 2000 + "=" * 300, "՘a", "\U000323b0 \U0001c89b"]


def test_edges(both):
    check(both, EDGES)


def test_random_texts(both):
    rng = random.Random(5)
    pools = ["abcdehinorst '", "the in on er re's ", "éèàüßñ aeiou\n\t", "\U0001f600中文あ \tabc　", "!#$%&*() A1'sdmtrevl", "<|endoftx>"]
    check(both, ["".join(rng.choice(pools[i % 6]) for _ in range(rng.randrange(1, 300))) for i in range(900)])


def test_any_code_points(both):
    rng = random.Random(6)
    point = lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x33500)]))
    check(both, ["".join(point() if rng.random() < .6 else rng.choice(" 'as1\n") for _ in range(60)) for _ in range(2000)])


def test_linked_rounds_equal_flat_ones(both):
    c, lib = both
    rng = random.Random(3)
    for pool in ("a", "ab", "the", "aeiounrst", "abcdefghijklmnopqrstuvwxyz"):
        w = "".join(rng.choice(pool) for _ in range(6000))
        check(both, [w])
        sym = np.frombuffer(w[:1500].encode(), dtype=np.uint8).astype(np.int64)
        assert c.linked(sym) == c.rounds(sym.copy(), np.zeros(len(sym), dtype=np.int64), 1)[0]


def test_parts_of_long_texts(both, monkeypatch):
    monkeypatch.setattr(M, "SLICE", 50)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the", " ", "  ", "\n", "'s", "ab", "12", "é"]) for _ in range(400)) for _ in range(40)]
    texts += ["x" * 700, " " * 700, "x" * 300 + " " + "y" * 300, "a<|endoftext|>" * 90]
    check(both, texts)
    assert all("".join(both[0].parts(t)) == t for t in texts)


def test_memory_of_words_is_bounded(both, monkeypatch):
    monkeypatch.setattr(M, "WORDS", 10)
    c = M.Counter(both[0].v)
    for k in range(5):
        check((c, both[1]), [f"w{k}x{i} and more" for i in range(30)])
    check((c, both[1]), ["x" * 100])
    assert "x" * 100 not in c.seen


def test_frame(spark, both):
    rows = [(i, t, i, "x") for i, t in enumerate(EDGES)] + [(3, "  ", 9, None), (None, "x y", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, `a.b` string")
    got = M.count_tokens(df, M.vocabulary_path(), limit=100).collect()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), n := len(both[1].encode(r[1] or "").ids), n > 100) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert M.count_tokens(df.limit(0), M.vocabulary_path()).count() == 0
    assert {r["a.b"] for r in M.count_tokens(df, M.vocabulary_path(), keep=("a.b",)).collect()} == {"x", "y", None}


def test_other_rules_are_refused(tmp_path):
    import public_tokenizers
    with pytest.raises(ValueError):
        M.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
