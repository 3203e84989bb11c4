"""Documents with every awkward case, and a plain union-find."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, value string, row long, kept boolean, node long, "
          "`a.b` string")


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, empty and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \t\n", "one", "One  ", "two words", "two\nwords", "three small words", "Three small\twords", "a b c d", "a b c d e",
             "é ü 日本", "\x00", "x" * 30_000, say(8000)]
    texts += [f"{say(30)}.\n{say(25)}!\n{say(40)}" for _ in range(40)]
    base = say(120)
    for k in range(70):  # near copies, some of them beyond the threshold
        w = base.split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    passage = say(60)
    texts += [f"{say(50)} {passage} {say(40)}" for _ in range(30)]  # a passage that many share
    texts += [texts[20], texts[20] + " ", texts[20].replace(" ", "  "), texts[60], texts[61]]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 5}" if i % 7 else None, len(t or ""), .5, "v", i, False, -1, "x") for i, t in corpus]
    rows += [rows[20], rows[20], (None, "no id here at all", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
