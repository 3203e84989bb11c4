"""Exact, near and line deduplication against plain Python."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspan.llm import exact_dedup as E
from trialspan.llm import line_dedup as L
from trialspan.llm import near_dedup as N
from trialspan.llm.common import join_counted, no_space, stored
from trialspan.llm.components import components

from .conftest import Groups

WS = re.compile(r"[\x20\x09-\x0D]")


def exact_wanted(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WS.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {(i, k): (min(g)[3], len(g)) for k, g in groups.items() for *_, i in g}


def as_rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("keys", [(E.sha256,), (lambda t: F.substring(F.sha2(t, 256), 1, 1), E.whole_text)])
def test_exact(spark, docs, keys):
    """Also with a digest of four bits: full bytes are compared and the texts become the key."""
    rows = as_rows(docs)
    want = exact_wanted(rows)
    sha = {(i, WS.sub("", t or "")): hashlib.sha256(WS.sub("", t or "").encode()).hexdigest() for i, t in rows}
    got = E.exact_dedup(docs, keys=keys).collect()
    assert len(got) == len(rows)
    by = {(i, s): want[i, k] for (i, k), s in sha.items()}
    assert all((r.keep_id, r.group_size) == by[r.doc_id, r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len({k for _, k in want})  # also among rows that repeat an id
    assert E.drop_copies(docs).select(no_space(F.coalesce("text", F.lit("")))).distinct().count() == E.drop_copies(docs).count()
    assert E.drop_copies(docs).columns == docs.columns


def test_exact_stream_in_small_batches(docs):
    one = {tuple(r) for r in E.exact_dedup(docs).collect()}
    assert {tuple(r) for r in E.exact_dedup(docs, max_bytes=1).collect()} == one


def test_exact_empty(docs):
    assert E.exact_dedup(docs.limit(0)).count() == 0 == E.drop_copies(docs.limit(0)).count()


def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def near_wanted(rows, k):
    sets, groups = shingle_sets(rows, k), Groups()
    for (a, s), (b, t) in combinations([x for x in sets.items() if x[1] and x[0] is not None], 2):
        n = len(s & t)
        if 100 * n >= 80 * (len(s) + len(t) - n):
            groups.join(a, b)
    return {i: (len(s), groups.find(i) if i is not None else None) for i, s in sets.items()}


@pytest.mark.parametrize("words,block", [(4, 512), (5, 3)])
def test_near(docs, words, block, monkeypatch):
    """Also with tiny blocks, so that contested lists are compared in many of them."""
    monkeypatch.setattr(N, "BLOCK", block)
    want = near_wanted(as_rows(docs), words)
    got = N.near_duplicates(docs, words=words).collect()
    assert len(got) == docs.count()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = N.drop_near(docs, words=words)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept}


def test_near_empty(docs):
    assert N.near_duplicates(docs.limit(0)).count() == 0
    none = docs.where("coalesce(trim(text), '') = ''")
    assert all(r.kept and r.component_id == r.doc_id for r in N.near_duplicates(none).collect())


def test_near_repeated_and_null_ids(spark):
    w = [f"w{i}" for i in range(60)]
    a, b = " ".join(w[:30]), " ".join(w[30:])
    a2, b2 = a + " x", b + " y"
    schema = "doc_id long, text string, `a.b` long"
    rows = [(1, a, 0), (1, b, 0), (2, a2, 0), (3, b2, 0), (0, "other words here and more of them", 0), (1, a, 0)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df, words=4).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    left = N.drop_near(df, words=4)
    assert left.columns == df.columns and sorted(tuple(r)[:2] for r in left.collect()) == sorted([(1, a), (1, b), rows[4][:2]])
    # an id of which one text goes and the other stays
    df = spark.createDataFrame([(0, a, 0), (5, a2, 0), (5, b, 0)], schema)
    assert sorted(tuple(r)[:2] for r in N.drop_near(df, words=4).collect()) == [(0, a), (5, b)]
    # without ids: one row of each group; with an id beside them none
    df = spark.createDataFrame([(None, a, 0), (None, a, 0), (None, a2, 0), (None, b, 0), (3, b2, 0), (None, None, 0), (None, "", 0)], schema)
    got = N.near_duplicates(df, words=4).collect()
    assert sum(r.kept for r in got) == 4 and all(r.component_id == 3 for r in got if r.kept and r.n_shingles and r.doc_id is not None)
    left = [tuple(r)[:2] for r in N.drop_near(df, words=4).collect()]
    assert len(left) == 4 and (3, b2) in left and sum(t in (a, a2) for _, t in left) == 1 and (None, b) not in left


def test_near_links_only_through_others(spark):
    """A chain whose ends are unlike, and a crowd around a centre that is not linked among itself."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[5 * i:5 * i + 100])) for i in range(12)]
    rows += [(100 + i, " ".join(w[:150] + [f"own{i}x{j}" for j in range(30)])) for i in range(60)] + [(99, " ".join(w[:150]))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == {i: c for i, (_, c) in near_wanted(rows, 4).items()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def lines_wanted(rows):
    """First occurrence of each group of linked lines, by all pairs of distinct lines."""
    every = {}
    for k, (i, t) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n") if t else []):
            if L.normalised(line):
                every.setdefault(L.normalised(line), []).append((i is None, i or 0, k, n))
    lines, groups = list(every), Groups()
    for a, b in combinations(range(len(lines)), 2):
        if L.edit_similar(lines[a], lines[b], 80):  # equals plain distances, see test_edit_similarity
            groups.join(a, b)
    first, gone = {}, {}
    for a, line in enumerate(lines):
        first[groups.find(a)] = min([first.get(groups.find(a), (2,)), *every[line]])
    for a, line in enumerate(lines):
        for at in every[line]:
            if at != first[groups.find(a)]:
                gone.setdefault(at[2], []).append(at[3])
    return {k: sorted(gone.get(k, [])) for k in range(len(rows))}


@pytest.mark.parametrize("block", [512, 2])
def test_lines(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", block)
    base = "the quick brown fox jumps over the lazy dog and runs through the deep green forest while birds sing songs".split()
    rows = [(i, t) for i, t in corpus if len(t or "") < 5000][:90]
    for k in range(30):
        w = [*base, *base, *base]
        w[k % 40] = f"word{k % 7}"
        rows.append((1000 + k, f"first {k}\n\n{' '.join(w)}\nThe  same line\nthe same LINE\nlast {k}"))
    want = lines_wanted(rows)
    got = L.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {i: k for k, (i, _) in enumerate(rows)}
    assert {ids[r.doc_id]: r.dropped for r in got} == want
    assert sum(map(len, want.values())) > 60
    assert all(r.n_lines == len(t.split("\n") if (t := rows[ids[r.doc_id]][1]) else []) for r in got)


def test_lines_edges(spark, docs):
    got = L.near_lines(docs).collect()
    assert len(got) == docs.count()
    assert L.near_lines(docs.limit(0)).count() == 0
    text = spark.createDataFrame([("a\nb\n\nc", [1])], "t string, d array<int>").select(L.without(F.col("t"), F.col("d"))).first()[0]
    assert text == "a\n\nc"


def test_lines_by_edit_similarity_alone(spark):
    """Copies with one word replaced, in lines of 3 to 60 words, and all short lines, against all pairs."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 9)))
    lines = []
    for n in (3, 5, 6, 8, 12, 20, 27, 40, 60):
        for _ in range(8):
            w = [word() for _ in range(n)]
            lines.append(" ".join(w))
            w[rng.integers(n)] = word()
            lines.append(" ".join(w))
    lines += ["".join(rng.choice(list("ab c"), rng.integers(1, 12))) for _ in range(60)]
    rows = [(i, x) for i, x in enumerate(lines)]
    got = {r.doc_id: r.dropped for r in L.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, groups = {}, Groups()
    for i, x in enumerate(lines):
        if L.normalised(x):
            groups.join(i, first.setdefault(L.normalised(x), i))
    for (x, a), (y, b) in combinations(first.items(), 2):
        if L.edit_similar(x, y, 80):
            groups.join(a, b)
    want = {i: [0] if L.normalised(x) and groups.find(i) != i else [] for i, x in rows}
    assert got == want and sum(map(len, want.values())) > 70


def test_edit_similarity():
    rng = np.random.default_rng(6)
    rows = [("a" * 10, "a" * 8 + "bb"), ("a" * 10, "a" * 7 + "bbb"), ("", ""), ("", "abc"), ("a", "b"), ("ab" * 900, "ab" * 700 + "c" * 400)]
    rows += [tuple("".join(rng.choice(list("abc"), n)) for n in rng.integers(0, 90, 2)) for _ in range(300)]
    for _ in range(200):  # changed copies
        w = rng.choice(list("abcdefgh "), 200)
        x = "".join(w)
        for i in rng.integers(0, 200, 5):
            w[i] = rng.choice(["", "z", "zz"])
        rows.append((x, "".join(w)))
    for a, b in rows:
        assert L.edit_distance(a, b) == distance(a, b)
        assert L.edit_similar(a, b, 80) == (distance(a, b) <= max(len(a), len(b)) * 20 // 100)


def test_line_buckets_are_few():
    """A line that is not short has the lowest hashes of its grams as buckets, 12 or 16 in place of 50."""
    rng = np.random.default_rng(8)
    lines = ["".join(rng.choice(list("abcdefg hij"), n)) for n in (300, 500, 61, 76, 199, 201, 999)] + ["x" * 3000, "ab" * 40 + "c" * 30]
    _, at, _ = L.line_buckets(lines, 80)
    assert np.bincount(at).tolist() == [16, 16, 62, 12, 28, 16, 16, 1, 12]
    for k, most in ((14, 12), (18, 16)):
        line, value, place = L.lowest(lines, k, most)
        for i, x in enumerate(lines):
            every = L.windows(np.frombuffer(x.encode("utf-32-le"), np.uint32), k).tolist()
            want = {v: every.index(v) if every.count(v) == 1 else -1 for v in sorted(set(every))[:most]}
            assert dict(zip(value[line == i].tolist(), place[line == i].tolist(), strict=True)) == want
            assert L.windows(np.frombuffer(x[7:7 + k].encode("utf-32-le"), np.uint32), k).tolist() == every[7:8]


def test_line_texts_are_not_stored(spark, monkeypatch):
    """Tables between steps have digests; texts only of lines that are compared."""
    kept = {}
    monkeypatch.setattr(L, "stored", lambda df, name: kept.setdefault(name, []).append(t := stored(df, name)) or t)
    rng = np.random.default_rng(9)
    say = lambda n: "".join(rng.choice(list("abcdefghiklmnoprstu "), n))
    near = say(300)
    rows = [(i, f"{say(200)}\nthe same line\n{say(150)}") for i in range(20)] + [(20, near), (21, near[:100] + "q" + near[101:])]
    got = {r.doc_id: r.dropped for r in L.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [1] if 0 < i < 20 else [0] if i == 21 else [] for i in range(22)}
    assert {n for n, ts in kept.items() for t in ts if "text" in t.columns} == {"line-texts"}
    assert {r.text for t in kept["line-texts"] for r in t.collect()} == {" ".join(x.split()) for x in (near, rows[21][1])}


def test_pairs_of_contested_buckets_are_compared_in_parts(spark, monkeypatch):
    """Unlike lines around one phrase: no table holds their pairs, no part more than its share; shuffles go after each step."""
    kept, parts, freed = [], [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    on = lambda: spark.conf.get(freed, "false")
    monkeypatch.setattr(L, "AT_ONCE", 20_000)
    monkeypatch.setattr(L, "stored", lambda df, name: kept.append((name, (t := stored(df, name)).count(), on())) or t)
    real = L.similar_pairs
    monkeypatch.setattr(L, "similar_pairs", lambda pairs, percent: parts.append(pairs.agg(F.count(F.lit(1)), F.count_distinct("a", "b")).first()) or real(pairs, percent))
    rng = np.random.default_rng(12)
    say = lambda n: "".join(rng.choice(list("abcdefghiklmnoprstu"), n))
    phrase = say(80)
    rows = [(i, say(60) + phrase + say(60)) for i in range(60)]
    rows += [(100 + i, t[:5] + "zz" + t[5:]) for i, t in rows[50:]]
    was = on()
    got = {r.doc_id: r.dropped for r in L.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [0] if i >= 100 else [] for i, _ in rows}
    assert sum(n for n, _ in parts) > 1000 and max(n for n, _ in parts) < 400 and all(n == d for n, d in parts)
    assert all(n < 1000 for name, n, _ in kept if name not in ("buckets", "line-open")) and {x for *_, x in kept} == {"true"}
    assert on() == was


def test_far_apart_never_excludes_a_link():
    rng = np.random.default_rng(10)
    pairs = []
    for _ in range(400):
        w = rng.choice(list("abcdefgh é日"), rng.integers(1, 400))
        x = list(w)
        for i in rng.integers(0, len(x), int(len(x) * rng.random() / 3)):
            x[i] = rng.choice(["", "z", "zz"])
        pairs.append(("".join(w), "".join(x)))
    far = L.far_apart(pairs, 80)
    assert 0 < far.sum() and not any(f and L.edit_distance(a, b) <= max(len(a), len(b)) // 5 for f, (a, b) in zip(far, pairs, strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 400)] + [(500, 499), (499, 501), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 400)}, 499: 499, 500: 499, 501: 499}


def test_join_counted(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 5000), (2, 3), (3, 1), (None, 4)) for i in range(n)], "k long, i long")
    right = stored(left.where("k <> 3").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top")), "test")
    got = join_counted(left, right, "k", "n", left.count()).groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("top").alias("t")).collect()
    assert {r.k: (r.c, r.t) for r in got} == {1: (5000, 4999), 2: (3, 2), 3: (1, None), None: (4, None)}


def test_near_long_chain_of_half_alike_texts(spark):
    """Lists that share members only one after the other: their pairs are compared list by list."""
    w = [f"w{i}" for i in range(9000)]
    rows = [(i, " ".join(w[40 * i:40 * i + 90])) for i in range(220)]
    rows += [(1000 + i, " ".join(w[40 * i:40 * i + 88] + ["x", f"y{i}"])) for i in range(0, 220, 9)]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == {i: c for i, (_, c) in near_wanted(rows, 4).items()}


def test_near_only_links_leave_contested_lists(spark, monkeypatch):
    """Lists of two texts in a chain, alike but not enough but for two: the others are turned down inside the join."""
    met, verified = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, *a: met.append(pairs.count()) or verified(pairs, *a))
    sets = {i: list(range(30 * i, 30 * i + 120)) for i in range(30)} | {30: list(range(860, 980))}
    rows = [(v, n, 120, n, 2) for v in range(30) for n in (v, v + 1)]
    rows = spark.createDataFrame(rows, "value long, node long, n long, comp long, m long")
    got = N.contested_links(rows, spark.createDataFrame(list(sets.items()), "node long, shingles array<long>"), 80)
    assert [tuple(r) for r in got.collect()] == [(29, 30)] and met == [1]


def test_near_texts_of_their_own(spark):
    """Texts with too many shingles that no other has drop out before lists are joined; the others know how many they have."""
    sets = {i: list(range(100)) + list(range(1000 * i, 1000 * i + n)) for i, n in enumerate((5, 20, 25, 26, 60), 1)}
    rows = [(7, i, len(s), i, 5) for i, s in sets.items()] + [(8, 4, 126, 4, 2), (8, 5, 160, 5, 2)]
    rows = spark.createDataFrame(rows, "value long, node long, n long, comp long, m long")
    got = N.linkable(rows, spark.createDataFrame(list(sets.items()), "node long, shingles array<long>"), 80)
    assert sorted((r.value, r.node, r.lone, r.m) for r in got.collect()) == [(7, 1, 5, 3), (7, 2, 20, 3), (7, 3, 25, 3)]
