"""Centroids, hard negatives and the Jaccard join against brute force, and their edge cases."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithograph.llm import centroids, hard_negatives, jaccard_join

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def vectors(seed: int, n: int, size: int = 64, copies: int = 0):
    rng = np.random.default_rng(seed)
    made = (rng.standard_normal((n, size)) / 8 + rng.standard_normal((5, size))[rng.integers(5, size=n)] / 6).astype(np.float32)
    made[n - copies :] = made[0]
    return [[float(x) for x in v] for v in made]


# --- centroids -----------------------------------------------------------------------------------

EMBEDDED = "vec_id long, embedding array<float>, label int, q string, cluster string, n string"


def slow_clusters(rows, k, rounds):
    own = [(i, whole(v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(own, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), [x & 255 for x in r[1]]))
    at = [v for _, v in first[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min(range(len(at)), key=lambda j: (far(v, at[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in own:
            groups.setdefault(near(v), []).append(v)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(at)]
    given_ = [(i, near(v), far(v, at[near(v)])) for i, v in own]
    inertia = Counter()
    for _, j, d in given_:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in given_)


def test_centroids(spark):
    """A vector that a third of all rows have, nulls, other sizes, repeated ids, and components at and beyond the bound."""
    made = vectors(1, 330, copies=110)
    rows = [(i, v) for i, v in enumerate(made)]
    bad = [(900, None), (901, []), (902, made[0][:63]), (903, [*made[0], 0.5]), (904, [None, *made[0][1:]]), (905, [NAN, *made[0][1:]]), (906, [-INF, *made[0][1:]])]
    rows += bad + [(None, made[3]), (5, made[6]), (5, made[5])]
    df = spark.createDataFrame([(i, v, 1, "clash", "clash", "clash") for i, v in rows], EMBEDDED).repartition(3)
    got = centroids.centroid_clusters(df, 7, 3)
    assert Counter(tuple(r) for r in got.collect()) == slow_clusters(rows, 7, 3)
    assert centroids.centroid_clusters(df, 1000, 1).count() == 333  # fewer vectors than centroids
    none = centroids.centroid_clusters(df.limit(0))
    assert none.count() == 0 and none.columns == got.columns
    assert centroids.centroid_clusters(df.filter("vec_id BETWEEN 900 AND 906")).count() == 0


def test_nearest_centroid_is_exact_for_large_numbers():
    rng = np.random.default_rng(3)
    v, c = rng.integers(-(1 << 27), 1 << 27, (40, 64)), rng.integers(-(1 << 27), 1 << 27, (9, 64))
    at, apart = centroids.nearest(v, c)
    want = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)), j) for j, b in enumerate(c)) for a in v]
    assert list(zip(apart.tolist(), at.tolist(), strict=True)) == want


# --- hard negatives ------------------------------------------------------------------------------


def slow_negatives(rows):
    own = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, whole(v), (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    least = lambda i: -(1 << 63) if i is None else i
    out = Counter()
    for x, (i, v, label) in enumerate(own):
        if i is None or i % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), least(j), k, j, other) for k, (j, w, other) in enumerate(own) if k != x)
        for s, _, _, p, _ in [r for r in scored if r[4] == label][:5]:
            fit = [r for r in scored if r[4] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            for rank, (t, _, _, j, _) in enumerate(fit, 1):
                out[(i, p, rank, j, -s, -t)] += 1
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_hard_negatives(spark, seed):
    """One label holds a third of the rows; ties by copies, null and repeated ids, bad vectors, negative scores, other lengths."""
    rng = np.random.default_rng(seed)
    made = vectors(seed, 400, copies=30)
    rows = [(i, v, 3 if i % 3 == 0 else int(rng.integers(10))) for i, v in enumerate(made)]
    rows += [(None, made[7], 3), (50, made[9], 2), (50, made[50], rows[50][2]), (450, None, 1), (500, made[1], None), (550, [NAN, *made[0][1:]], 1), (600, [None], 1), (650, [], 1), (700, made[2][:9], 4), (750, [-x for x in made[0]], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS row", "'y' AS anchor", "'z' AS slice").repartition(4)
    got = hard_negatives.hard_negatives(df)
    assert Counter(tuple(r) for r in got.collect()) == slow_negatives(rows) and got.count() > 50
    none = hard_negatives.hard_negatives(df.limit(0))
    assert none.count() == 0 and none.columns == got.columns
    assert hard_negatives.hard_negatives(df.filter("label = 3 AND vec_id % 7 <> 0")).count() == 0


def test_rounds_cover_all_slices_once():
    for n in (1, 3, 8, 9, 211, 20000):
        covered = [k for low, high in hard_negatives._rounds(n) for k in range(low, high)]
        assert covered == list(range(n))


def test_partial_products_discard_pairs():
    """Of vectors with few strong directions the leading components leave few pairs to multiply, and none that counts is lost."""
    rng = np.random.default_rng(9)
    own = np.rint(rng.standard_normal((800, 64)) * np.where(np.arange(64) < 8, 200, 6)).astype(np.int32)
    rotation = np.linalg.eigh(own.T.astype(float) @ own)[1][:, ::-1]
    v, a = hard_negatives.Rotated(own, rotation), hard_negatives.Rotated(own[:20], rotation)
    partial, apart = hard_negatives._bounded(a, v, slice(0, 20))
    exact = own[:20].astype(np.int64) @ own.T
    assert (np.abs(exact - partial) <= apart).all()
    least = np.sort(exact, axis=1)[:, -5]
    i, j = np.nonzero(partial + apart >= least[:, None])
    assert len(i) < 0.05 * exact.size
    i, j, score = hard_negatives._survivors(a, v, i, j, partial[i, j], least[i])
    assert (score == exact[i, j]).all() and all((exact[k] >= least[k]).sum() == ((i == k) & (score >= least[k])).sum() for k in range(20))


# --- the Jaccard join ----------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), unique=True, min_size=1).map(sorted), min_size=1, max_size=30), st.integers(1, 12), st.tuples(st.integers(0, 12), st.integers(0, 12)))
def test_t_occurrence(lists, least, skip):
    postings, bounds = [], []
    for own in lists:
        bounds.append((len(postings), len(postings) + len(own)))
        postings += own
    counts = Counter(x for own in lists for x in own)
    assert sorted(jaccard_join.t_occurrence(postings, bounds, least)) == sorted((k, n) for k, n in counts.items() if n >= least)
    others = sorted((k, n) for k, n in counts.items() if n >= least and not skip[0] <= k < skip[1])
    assert sorted(jaccard_join.t_occurrence(postings, bounds, least, skip)) == others


def slow_components(rows):
    sets = []
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            shared = len(sets[x] & sets[y])
            if shared and 100 * shared >= 80 * (len(sets[x]) + len(sets[y]) - shared):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        key = -(1 << 63) if i is None else i
        least[find(x)] = min(least.get(find(x), key), key)
    named = lambda k: None if k == -(1 << 63) else k
    return Counter((i, len(sets[x]), named(least[find(x)])) for x, (i, _) in enumerate(rows))


def copies(seed: int, n: int, words: int, edits: int):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(3000, size=words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(words, size=rng.integers(edits + 1)):
            own[at] = f"e{rng.integers(10**9)}"
        out.append(" ".join(own))
    return out


def test_jaccard_components(spark):
    """Near copies of a third of the rows, chains, a passage that unlike documents share, and the usual edge cases."""
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"p{x}" for x in rng.integers(10**6, size=n))
    passage = prose(60)
    texts = copies(11, 150, 120, 9) + copies(12, 40, 30, 1) + [f"{passage} {prose(int(n))}" for n in rng.integers(1, 30, size=80)] + [prose(50) for _ in range(60)]
    chain = [f"c{x}" for x in range(200)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 100, 6)] + [" ".join(chain[k : k + 100]).upper() for k in (0, 12)]
    texts += ["one", "ONE", "one  two", "É one two three four", "é one two three four", "", " \n", None, None, prose(6000)]
    rows = list(enumerate(texts, 10)) + [(None, texts[0]), (None, None), (11, texts[300]), (11, texts[12])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS row", "'y' AS key", "'z' AS vertex", "1 AS n").repartition(5)
    got = jaccard_join.jaccard_components(df)
    assert Counter(tuple(r) for r in got.collect()) == slow_components(rows)
    none = jaccard_join.jaccard_components(df.limit(0))
    assert none.count() == 0 and none.columns == got.columns
    assert Counter(tuple(r) for r in jaccard_join.jaccard_components(df.filter("text = '' OR text IS NULL")).collect()) == Counter((i, 0, i) for i, t in rows if t in ("", None))


def test_blocks_in_buckets_of_unlike_sets(spark, monkeypatch):
    """With small groups, sets outside the largest component of a bucket still find each other, in pairs and in blocks."""
    monkeypatch.setattr(jaccard_join, "SEARCH", 5)
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in range(14)]
    texts = [" ".join(words[k] for k in rng.integers(14, size=rng.integers(5, 9))) for _ in range(60)]
    texts += [" ".join([*words, *rng.permutation(words)[: rng.integers(1, 5)]]) for _ in range(90)]
    rows = list(enumerate(texts))
    for paired in (0, 1000):
        monkeypatch.setattr(jaccard_join, "PAIRED", paired)
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter(tuple(r) for r in got.collect()) == slow_components(rows)


def test_no_link_is_lost_with_buckets_that_others_cover(spark, monkeypatch):
    """Sets of several shared passages, of equal and of different ones before each bucket, searched in pairs and in blocks."""
    monkeypatch.setattr(jaccard_join, "SEARCH", 6)
    rng = np.random.default_rng(21)
    prose = lambda n: [f"p{x}" for x in rng.integers(10**6, size=n)]
    passages = [prose(25) for _ in range(4)]
    texts = []
    for _ in range(160):
        own = [x for k in rng.permutation(4)[: rng.integers(1, 4)] for x in passages[k][rng.integers(4) :]]
        texts.append(" ".join(own + prose(rng.integers(9))))
    rows = list(enumerate(texts))
    want = slow_components(rows)
    assert 20 < len({c for _, _, c in want}) < 140
    for paired in (0, 1000):
        monkeypatch.setattr(jaccard_join, "PAIRED", paired)
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter(tuple(r) for r in got.collect()) == want


def test_a_bucket_that_another_covers_is_left_out(spark):
    """Where all sets of a bucket have the same prev, the pair was met before; where one has another, it stays."""
    met = spark.createDataFrame([(s, v, 9, p, 3) for v in (1, 2, 3) for p, s in enumerate((70, 71, 72)) if (v, s) != (3, 71)], "shingle long, vertex long, n long, place int, size long")
    got = {(r["shingle"], r["vertex"]): (r["prev"], r["weight"]) for r in jaccard_join._before(met).collect()}
    assert got == {(70, 1): (None, 9), (71, 1): (70, 9), (72, 1): (71, 9), (70, 2): (None, 9), (71, 2): (70, 9), (72, 2): (71, 9), (70, 3): (None, 6), (72, 3): (70, 6)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(1, 700), st.integers(0, 700), st.integers(0, 10**6))
def test_sketches_of_sets_that_link_are_never_too_far_apart(n, m, shared, seed):
    shared = min(n, m, shared)
    rng = np.random.default_rng(seed)
    own = np.unique(rng.integers(1 << 63, size=n + m - shared).astype(np.uint64) * np.uint64(2) + np.uint64(seed % 2))
    rng.shuffle(own)
    a, b = own[:n], own[n - shared : n - shared + m]
    both = [np.frombuffer(jaccard_join.parity_sketch(x), "<u8")[None] for x in (a, b)]
    apart, alone = int(jaccard_join._apart(*both)[0]), len(np.setxor1d(a, b))
    assert apart <= alone and apart == int(jaccard_join._apart(*both[::-1])[0])
    if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
        assert alone <= jaccard_join.most_apart(np.array([len(a) + len(b)]))[0]


def test_sets_that_only_share_a_passage_are_not_searched(spark, monkeypatch):
    """Sets of one bucket that are unlike by their sketches are sent to no group, in small buckets and in blocks; near copies among them still link."""
    rng = np.random.default_rng(33)
    prose = lambda n: " ".join(f"p{x}" for x in rng.integers(10**6, size=n))
    passage = prose(60)
    texts = [f"{passage} {prose(90)}" for _ in range(70)]
    texts += [texts[k] + " tail" for k in range(0, 70, 7)]
    rows = list(enumerate(texts))
    searched = []
    plain = jaccard_join._searched

    def counted(docs, nodes, pairs):
        searched.append(pairs.count())
        return plain(docs, nodes, pairs)

    monkeypatch.setattr(jaccard_join, "_searched", counted)
    for paired, size in ((1000, 2000), (0, 2000), (0, 9)):
        monkeypatch.setattr(jaccard_join, "PAIRED", paired)
        monkeypatch.setattr(jaccard_join, "BLOCK", size)
        searched.clear()
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter(tuple(r) for r in got.collect()) == slow_components(rows)
        assert 10 <= sum(searched) <= 40


@pytest.mark.parametrize("module", [centroids, hard_negatives, jaccard_join])
def test_whole_tables_match_sql(spark, module):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, query in module.QUERIES.items():
        got, want = query(spark, SF), con.sql(module.ORACLES[name])
        assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall()) and got.count() > 100
