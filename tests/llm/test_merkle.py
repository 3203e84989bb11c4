"""The manifest and its proofs against plain Python."""

import hashlib
import random
import zlib

import pytest

from trialspan.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at long, `a.b` string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Levels of one tree, the last one with a single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + M.FAN])) for i in range(0, len(levels[-1]), M.FAN)])
    return levels


def lowered(text):
    return None if text is None else text.translate(str.maketrans(*M.AZ))


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    order = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(r[:5]), leaf((*r[:4], lowered(r[4])))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (order(x[0]), x[1]))
    trees = [tree([x[1] for x in groups[s]]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (doc, own, other) in enumerate(groups[s]):
            test = other if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 else own
            proof = ""
            for levels, p in ((trees[k], i), (top, k)):
                for nodes in levels[:-1]:
                    a = p // M.FAN * M.FAN
                    run = nodes[a:a + M.FAN]
                    proof += "".join(h for j, h in enumerate(run) if j != p - a)
                    test = sha("".join(run[:p - a]) + test + "".join(run[p - a + 1:]))
                    p //= M.FAN
            out.append((doc, own, trees[k][-1][0], top[-1][0], sha(proof), test, test == top[-1][0]))
    return sorted(out, key=repr)


def run(df):
    chosen = M.F.crc32(M.F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    cols = [M.F.col(c) for c in M.FIELDS]
    test = M.F.when(chosen, M.leaf_digest([*cols[:4], M.F.translate("text", *M.AZ)])).otherwise(M.leaf_digest(cols))
    m = M.manifest(df, tested=test)
    got = M.verify(m, "tested").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return m, sorted((tuple(r) for r in got.collect()), key=repr)


def rows_of(n, sources):
    rng = random.Random(n)
    text = lambda: rng.choice([None, "", "plain", "Upper É", "x" * 40_000, "Some " * 50])
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), text(), -1, "z") for i in range(n)]


@pytest.mark.parametrize("case", ["mixed", "sources", "one", "pair"])
def test_against_plain(spark, case, monkeypatch):
    if case == "mixed":  # a hot source of three levels, nulls, repeated rows and ids, ties
        rows = rows_of(330, ["hot"] * 9 + ["a", "é", "B", None, ""])
        rows += [rows[5], rows[5], (5, *rows[5][1:4], "Other text", 0, "q"), (None, "hot", None, None, None, 1, None), (None, "hot", None, None, "T", 1, None)]
    elif case == "sources":  # a top tree of two levels, runs of one node
        rows = [(i, f"s{i % 17:02d}", "en", i, "Text", 0, None) for i in range(40)]
        monkeypatch.setattr(M, "SHARE", 4)  # heavy and light runs on the way
    elif case == "one":
        rows = [(7, None, None, None, "ABC", 0, None)]
    else:
        rows = [(7, "s", None, None, "ABC", 0, None), (8, "t", None, None, None, 0, None)]
    m, got = run(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == plain(rows)
    assert m.root == got[0][3]


def test_empty_table(spark):
    m, got = run(spark.createDataFrame([], SCHEMA))
    assert got == [] and m.root is None


def test_a_changed_field_shows(spark):
    rows = [(i, "s", "en", 1, f"Text {i}", 0, None) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    other = M.leaf_digest([M.F.when(M.F.col("doc_id") == 3, M.F.lit("x")).otherwise(M.F.col(c)) if c == "lang" else M.F.col(c) for c in M.FIELDS])
    bad = [r.doc_id for r in M.verify(M.manifest(df, tested=other), "tested").where("not verified").collect()]
    assert bad == [3]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) != "-1"
