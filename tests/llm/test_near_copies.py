import random

import numpy as np
import pytest
from brute import bag, jaccard, smallest_reachable

from inkspan.llm import bagminhash, multi_index
from inkspan.llm.graph import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(40)}}


def test_signature_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(0)
    miss = []
    for _ in range(40):
        h, a = rng.integers(1, 1 << 43, 150).astype(np.uint64), rng.integers(0, 12, 150)
        b = np.where(rng.random(150) < 0.7, a, rng.integers(0, 12, 150))
        sig = [bagminhash.signature(np.zeros((w > 0).sum(), int), h[w > 0], w[w > 0], 1) for w in (a, b)]
        miss.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(miss)) < 0.025


def _corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([6, 30, 80, 200]))]
        texts.append(base)
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy)
    return [" ".join(t) for t in texts] + ["One two, three", "one TWO three!", "x", "x", "y", "", "", None, "...", "..."]


def test_groups_equal_brute_force(spark):
    texts = _corpus()
    rows = [(i, t, None, "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.group_id, r.kept) for r in bagminhash.groups(spark.createDataFrame(rows, DOCS)).collect()}
    bags = [bag(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8]
    want = smallest_reachable(range(len(texts)), pairs)
    assert got == {i: (g, i == g) for i, g in want.items()}


def test_a_bucket_of_mixed_near_copies_loses_no_link(spark):
    """A family whose members differ from each other by more than from their origin."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        t = list(base)
        for _ in range(3 if k % 2 else 2):
            t[r.randrange(len(t))] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(t))
    bags = [bag(t) for t in texts]
    want = smallest_reachable(range(60), [(i, j) for i in range(60) for j in range(i) if jaccard(bags[i], bags[j]) >= 0.8])
    got = {x.doc_id: x.group_id for x in bagminhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == want


def test_keep_one_with_repeats_nulls_and_extra_columns(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, "a"), (2, long, "b"), (3, "other words stand here now", "c"), (3, "other words stand here now", "c"), (None, long, "d"), (4, None, "e"), (5, "", "f")]
    out = bagminhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, k1 string")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.k1) for r in out) == [(-1, "d"), (1, "a"), (3, "c"), (4, "e"), (5, "f")]
    assert bagminhash.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, 2, 3), (2, "A b c d e f", 4, 5, 6), (3, "x", 7, 8, 9), (3, "x", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _id int, kept int, _row int")
    out = bagminhash.keep_one(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def _kept(spark, rows):
    out = bagminhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, k1 string")).collect()
    return sorted((r.doc_id, r.text, r.k1) for r in out)


def test_different_texts_under_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    near = lambda t: t + " more"
    assert _kept(spark, [(3, b, ""), (5, a, ""), (5, b, "")]) == [(3, b, ""), (5, a, "")]
    assert _kept(spark, [(5, a, ""), (5, b, ""), (5, b, "")]) == [(5, a, ""), (5, b, "")]
    rows = [(5, a, ""), (5, b, ""), (7, near(a), ""), (9, near(b), ""), (9, c, "")]
    assert _kept(spark, rows) == [(5, a, ""), (5, b, ""), (9, c, "")]
    found = bagminhash.groups(spark.createDataFrame(rows, "doc_id bigint, text string, k1 string"))
    assert sorted((r.doc_id, r.group_id, r.kept) for r in found.collect()) == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 9, True)]
    rows = [(1, "One two", "z"), (1, "one TWO!", "y"), (2, "!", "x"), (2, "...", "w"), (2, "...", "v"), (2, None, "u"), (2, None, "u")]
    assert sorted(r[2] for r in _kept(spark, [(i, t or "", k) for i, t, k in rows])) == ["u", "v", "x", "z"]


def test_families_under_shared_ids_equal_brute_force(spark):
    """Each id stands at two unlike texts, so ids join nothing; mixed buckets are met block by block."""
    r = random.Random(8)
    rows = []
    for f in range(2):
        base = [f"f{f}w{i}" for i in range(120)]
        for k in range(40):
            t = list(base)
            for _ in range(3 if k % 2 else 2):
                t[r.randrange(len(t))] = f"z{r.randrange(10**6)}"
            rows.append((k, " ".join(t), ""))
    bags = [bag(t) for _, t, _ in rows]
    root = smallest_reachable(range(80), [(i, j) for i in range(80) for j in range(i) if jaccard(bags[i], bags[j]) >= 0.8])
    want = sorted((rows[i][0], rows[i][1], "") for i in range(80) if root[i] == i)
    assert _kept(spark, rows) == want


def _cosines(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    return s


@pytest.mark.parametrize("noise", [0.05, 0.35])
def test_embedding_links_against_brute_force(spark, noise):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 32))
    near = base + 0.25 * rng.standard_normal(base.shape)
    hot = rng.standard_normal((1, 32)) + noise * rng.standard_normal((300, 32))
    x = np.concatenate([base, near, hot])
    ids = [int(i) for i in rng.permutation(len(x))]
    got = {r.vec_id: r for r in multi_index.links(spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in zip(ids, x)], "vec_id bigint, embedding array<double>, label int")).collect()}
    s = _cosines(x)
    want = dict(zip(ids, s.sum(1)))
    assert all(got[i].n_links <= want[i] for i in ids)
    assert sum(r.n_links for r in got.values()) >= 0.95 * s.sum()
    root = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(s)))])
    assert np.mean([got[i].component_id == root[i] for i in ids]) >= 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def _recall(spark, x):
    """Share of the links of each half of the ids that is found, and of false ones."""
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {r.vec_id: r.n_links for r in multi_index.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(unit[i : i + 500] @ unit.T >= 0.9).sum(1) - 1 for i in range(0, len(x), 500)])
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all()
    return [found[part].sum() / want[part].sum() for part in (slice(0, len(x) // 3), slice(len(x) // 3, None))]


def test_recall_where_ids_follow_sources(spark):
    """Tight vectors under the lowest ids, pairs barely linked under the others."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.standard_normal((4000, 64)))
    r = rng.standard_normal(a.shape)
    r = unit(r - (r * a).sum(1, keepdims=True) * a)
    pairs = np.stack([a, 0.905 * a + np.sqrt(1 - 0.905**2) * r], 1).reshape(-1, 64)
    tight = unit(rng.standard_normal((200, 64)))[np.arange(4000) % 200] + 0.02 * rng.standard_normal((4000, 64))
    assert min(_recall(spark, np.concatenate([tight, pairs]))) >= 0.95


def test_embedding_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, nan]), (6, [1.0, inf]), (7, [1.0, None]), (8, []), (9, [1.0]), (10, [3.0]), (11, [0.0, 1.0]), (2, [2.0, 0.0]), (2, [0.0, 3.0]), (None, [1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (None, None), (None, [-1.0, 0.0])]
    got = sorted(map(tuple, multi_index.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (2, 1, 2, True), (11, 1, 2, False), (None, 3, 1, False), (None, 0, None, True), (None, 0, None, True), (9, 1, 9, True), (10, 1, 9, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 12)]]
    assert got == sorted(want, key=str)
    assert multi_index.links(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
