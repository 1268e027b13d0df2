"""Runs against trying every period at every place."""

import hashlib
import random

import numpy as np

from inkspan.llm import periodic_runs as pr
from inkspan.llm import queries

SCHEMA = "doc_id bigint, text string, start int, length string, runs int"


def plain(w, least=6, periods=4):
    out = []
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i + p - s
            if i > s and n >= max(least, periods * p) and not any(w[s : s + n - q] == w[s + q : s + n] for q in range(1, p)):
                out.append((s, n, p))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def report(doc_id, text, prepare=None):
    w = (text or "").encode().split()
    if prepare:
        w = prepare(w, doc_id)
    runs = plain(w)
    kept = [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(kept)))


def texts():
    rnd = random.Random(8)
    out = [None, "", " \t\r\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "é" * 3, "        " * 5, "A a A a A a A a", ("to and fro " * 4).strip()]
    for _ in range(300):
        w = [rnd.choice("abcd") for _ in range(rnd.randrange(80))]
        for _ in range(rnd.randrange(3)):
            at, p = rnd.randrange(len(w) + 1), rnd.randrange(1, 7)
            w[at:at] = ([rnd.choice("abcde") for _ in range(p)] * 9)[: rnd.randrange(30)]
        out.append(rnd.choice([" ", "\n", "  \x0b"]).join(w))
    out.append(" ".join(f"w{i % 700}" for i in range(6000)) + " x y" * 2000)
    return out


def test_every_run_of_two_periods():
    rnd = random.Random(9)
    for _ in range(600):
        w = [rnd.randrange(1, rnd.choice([2, 3, 4])  + 1) for _ in range(rnd.randrange(40))]
        got = [tuple(r) for r in pr.runs_of(w, 2, 2).tolist()]
        assert sorted(got, key=lambda r: (r[0], r[2])) == plain(w, 2, 2)


def test_range_minima():
    rng = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 500):
        v = rng.integers(0, 90, n)
        a, b = np.sort(rng.integers(0, n, (2, 2000)), axis=0)
        assert (pr.RangeMin(v).query(a, b) == [v[i : j + 1].min() for i, j in zip(a, b, strict=True)]).all()


def test_report_equals_brute_force(spark):
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts())] + [(None, "a a a a a a", 1, "x", 2), (3, "b b b b b b b", 1, "x", 2)]
    got = sorted(map(tuple, pr.report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted((report(i, t) for i, t, *_ in rows), key=str)
    got = sorted(map(tuple, pr.report(spark.createDataFrame(rows, SCHEMA), queries.with_periods).collect()), key=str)
    assert got == sorted((report(i, t, queries.with_periods) for i, t, *_ in rows), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13(spark, sf).collect()), key=str)
    ids = {i for i, t in docs if len((t or "").split()) < 1500}
    assert [g for g in got if g[0] in ids] == sorted((report(i, t, queries.with_periods) for i, t in docs if i in ids), key=str)
    assert len(got) == len(docs) and sum(g[1] > 0 for g in got) > len(docs) / 20


def test_collapse_and_find_keep_rows(spark):
    rows = [(1, "x a b a b a b a b y", 1, "s", 2), (1, None, None, None, None), (2, "a  b\n", 3, "t", 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = pr.collapse(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x a b y", 1, "s", 2), *rows[1:]], key=str)
    found = {(r.doc_id, r.n_words): [tuple(x) for x in r.runs] for r in pr.find(df).collect()}
    assert found == {(1, 10): [(1, 8, 2)], (1, 0): [], (2, 2): []}
    for f in (pr.collapse, pr.find, pr.report):
        assert f(df.limit(0)).count() == 0
