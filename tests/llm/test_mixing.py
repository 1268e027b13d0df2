"""Mixing sources to target weights against plain arithmetic."""

from fractions import Fraction

import pytest

from inkspan.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, draw int, rate string"


def shares(sizes):
    """Targets by sharing again and again, in exact fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, stopped = {}, set()
    total = Fraction(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(target[s] for s in stopped)
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return target
        for s in above:
            target[s] = Fraction(3 * sizes[s])
        stopped |= above


def documents():
    rows, doc_id = [], 0
    for k, (source, n) in enumerate([("b", 3), ("a", 700), (None, 5), ("Ä", 400), ("", 2), ("c", 1), ("zzz", 900), ("empty", 4)]):
        for i in range(n):
            text = None if source == "empty" else ("w\t" * (1 + (i * 7 + k) % 40) + "\x0b\x0c end\r\n")
            rows.append((doc_id, text, source, "x", 1, "y"))
            doc_id += 1
    return rows


@pytest.fixture(scope="module")
def planned(spark):
    return {r.doc_id: r for r in mixing.plan(spark.createDataFrame(documents(), SCHEMA)).collect()}


def test_sizes_and_targets(planned):
    size = {d: len([w for w in (t or "").encode().split()]) for d, t, *_ in documents()}
    total = {}
    for d, _, s, *_ in documents():
        total[s] = total.get(s, 0) + size[d]
    want = shares(total)
    assert {d: r["size"] for d, r in planned.items()} == size
    for d, _, s, *_ in documents():
        r = planned[d]
        assert r.source_size == total[s] and r.target == pytest.approx(float(want[s]), rel=1e-12)
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        rate = want[s] / total[s] if total[s] else 0
        assert int(rate) <= r.copies <= int(rate) + 1
    for s in ("a", "Ä", "zzz"):
        taken = sum(planned[d].taken for d, _, x, *_ in documents() if x == s)
        assert taken == pytest.approx(float(want[s]), rel=0.1)


def test_reruns_agree_and_the_corpus_is_what_was_planned(spark, planned):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(5)
    assert {r.doc_id: r for r in mixing.plan(docs).collect()} == planned
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert count == {d: r.copies for d, r in planned.items() if r.copies}


def test_nulls_ties_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b", "s", None, None, None)] * 3 + [(7, None, None, None, None, None), (7, "", "s", None, None, None), (7, "a b c", "s", None, None, None)]
    out = mixing.plan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["size"] for r in out) == [0, 0, 2, 2, 2, 3]
    assert len({(r.copies, r.taken) for r in out if r["size"] == 2}) == 1
    assert {(r.source_size, r.target) for r in out} == {(9, 9.0), (0, 0.0)}
    assert all(r.taken == r["size"] for r in out)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.plan(spark.createDataFrame([(1, None, "s", None, None, None)], SCHEMA)).collect()} == {0}


def test_many_sources_are_joined_by_shuffle(spark, planned, monkeypatch):
    from inkspan.llm import totals

    monkeypatch.setattr(totals.attach, "__defaults__", (0,))
    assert {r.doc_id: r for r in mixing.plan(spark.createDataFrame(documents(), SCHEMA)).collect()} == planned
