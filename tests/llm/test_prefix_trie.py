"""The trie of rebuilt conversations against plain Python."""

import hashlib
import random
import zlib

import pytest

from trialspan.llm import prefix_trie as M

SCHEMA = "conv_id long, turn long, role string, text string, key string, p long, `a.b` string"


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    digest = lambda t: hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()[:32]
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = [t[1:] for t in own.get(c - c % 100, [])[:h] + turns[h:]]
    members = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members.setdefault(tuple(made[c][:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        subs = [below(x) for x in children.get(node, [])]
        own_text = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        return (sum(s[0] for s in subs) or 1, own_text + sum(s[1] for s in subs))

    out = []
    for node, who in members.items():
        leaves, saved = below(node)
        ends = hashlib.sha256(",".join(str(c) for c in who if len(made[c]) == len(node)).encode()).hexdigest()
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(children.get(node, [])), leaves, saved, ends))
    return sorted(out, key=repr)


def run(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in M.trie(*M.rebuilt(df)).select(cols).collect()), key=repr)


def talk(rng, c, n, said):
    return [(c, i if rng.random() < .95 else None, rng.choice(["user", "assistant"]) if rng.random() < .2 else "user", rng.choice(said), "k", 1, "z")
            for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    said = ["a", "b", None, "", "é日", "long " * 2000]
    out = []
    for c in [*range(0, 60), *range(100, 130), *range(250, 260), 400, 7_000_000_123]:
        out += talk(rng, c, rng.choice([1, 2, 3, 5, 6, 9]), said[:rng.choice([1, 2, 6])])
    out += [r for c in (300, 301, 302) for r in [(c, i, None, "same", "k", 1, "z") for i in range(150)]]  # several levels of blocks
    out += [(303, i, None, "same" if i < 140 else "other", "k", 1, "z") for i in range(150)]
    out += [out[3], out[3], (None, 1, "user", "nobody's", "k", 1, "z"), (5, None, None, None, None, None, None), (-7, 0, "user", "a", "k", 1, "z")]
    return [r for r in out if r[0] is None or r[0] >= 0]


def test_against_plain(spark, rows):
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_small_blocks_and_stretches(spark, rows, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 2)
    monkeypatch.setattr(M, "FAN", 3)
    monkeypatch.setattr(M, "IDS", 3)
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(M, "IDS", 4)
    rows = [(c, i, "user", f"turn {i}", None, None, None) for c in range(1000, 1090) for i in range(6)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(None, 1, "u", "t", None, None, None)], SCHEMA)) == []


def test_turnless_conversations(spark):
    # of conversations with fewer turns than their base gives, nothing is left where the base is absent
    rows = [(c, 0, "user", "x", None, None, None) for c in range(501, 520)]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows) and (501, 0) in {r[:2] for r in got}
