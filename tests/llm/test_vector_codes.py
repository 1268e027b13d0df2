"""Vector codes against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from inkspan.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<double>, label int, code int, error string, x int"


def plain(rows, rounds=6):
    """Per kept row (vec_id, code, error, label_error), and the digest, by full scans."""
    good = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in good), default=0) // 8)
    vectors = []
    for r in good:
        v = [math.floor(Fraction(x) * 4096) for x in r[1]]
        v += [0] * (8 * width - len(v))
        vectors.append([tuple(v[p * width : (p + 1) * width]) for p in range(8)])
    books = [[v[p] for v in vectors[:16]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(8):
            mine = [nearest(p, v[p]) for v in vectors]
            for e in range(len(books[p])):
                own = [v[p] for v, m in zip(vectors, mine, strict=True) if m == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    codes = [[nearest(p, v[p]) for p in range(8)] for v in vectors]
    errors = [sum(dist(v[p], books[p][c[p]]) for p in range(8)) for v, c in zip(vectors, codes, strict=True)]
    label = {}
    for r, e in zip(good, errors, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    top = 2**63 - 1
    return sorted((str(r[0]), bytes(c).hex(), min(e, top), min(label[r[2]], top), digest) for r, c, e in zip(good, codes, errors, strict=True))


def check(spark, rows):
    made = [(*r, 1, "x", 2) for r in rows]
    got = vc.encode(spark.createDataFrame(made, SCHEMA).repartition(3))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == plain(rows)


def test_rounds_ties_and_repeated_rows(spark):
    rnd = random.Random(3)
    grid = [[rnd.randrange(-2, 3) / 4096 for _ in range(16)] for _ in range(80)]  # many equal distances
    rows = [(i // 2, v, i % 3 or None) for i, v in enumerate(grid)] + [(5, grid[10], 1)] * 3
    check(spark, rows)


def test_unlike_lengths_nulls_and_few_rows(spark):
    rnd = random.Random(4)
    rows = [(None, [rnd.gauss(0, 1) for _ in range(n)], None) for n in (0, 3, 8, 9, 17)]
    rows += [(1, None, 1), (2, [1.0, None], 1), (3, [math.nan], 2), (4, [math.inf, 1.0], 2)]
    check(spark, rows)
    check(spark, [(7, [], 1)])
    assert vc.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vc.encode(spark.createDataFrame([(1, None, 1, 1, "", 1)], SCHEMA)).count() == 0


def test_large_numbers_are_exact(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([1e5, 3e8, 7e12, 1.5, -2e11]) * rnd.random() for _ in range(8)], i % 2) for i in range(40)]
    check(spark, rows)


def test_only_moved_entries_are_compared():
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 9, (500, 4)).astype(float)
    old = rng.integers(-9, 9, (16, 4)).astype(float)
    d = vc.distances(x, old)
    code, near = d.argmin(1), d.min(1).astype(np.int64)
    new, moved = old.copy(), np.zeros(16, bool)
    moved[[2, 9, 15]] = True
    new[moved] += rng.integers(-2, 3, (3, 4))
    vc.reassign(x, code, near, new, moved)
    d = vc.distances(x, new)
    assert (code == d.argmin(1)).all() and (near == d.min(1)).all()


def test_decode_is_the_nearest_entries(spark):
    rows = [(i, [float(i % 5), 0.5, -1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0, 1, "", 1) for i in range(10)]
    books, codes = vc.fit(spark.createDataFrame(rows, SCHEMA))
    for r in vc.decode(codes, books).collect():
        assert r.approx == pytest.approx([float(r.vec_id % 5), 0.5, -1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) and r.error == 0
