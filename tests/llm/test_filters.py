import re

import pytest

from inkspan.llm import langid, preference, quality, toxicity, url_filter

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "the words"), (3, "12 345 !!"), (4, "x"), (5, "word " * 50000), (6, "\u00bf\u20ac\U0001f600")]
    return spark.createDataFrame([(i, t, None, "s", None, 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")


def _held_accuracy(found, truth, column):
    rows = [(r["predicted"], r[column]) for r in found.join(truth, "doc_id").where("held_out").collect()]
    return rows


def test_toxicity(spark, docs, labels, odd):
    model = toxicity.fit(docs, labels)
    rows = _held_accuracy(toxicity.score(docs, model), labels, "toxic")
    assert len(rows) > 60 and sum(p == y for p, y in rows) / len(rows) > 0.88
    found = toxicity.score(odd, model).collect()
    assert len(found) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert {r.score for r in found if r.doc_id in (1, 2)} == {0.0}
    none = toxicity.fit(docs.limit(0), labels)
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_offending_sentence(spark):
    rows = [(i, f"Calm words here. {'You vile thing' if i % 2 else 'You nice thing'}. More words é", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    for r in toxicity.score(df.select("doc_id", "text"), model).where("held_out").collect():
        assert r.predicted == r.doc_id % 2
        if r.predicted:
            assert rows[r.doc_id][1][r.worst_start : r.worst_end] == "You vile thing" and r.n_offending == 1


def test_every_offending_sentence_has_its_span(spark):
    rows = [(i, f"Calm words here. {'You vile thing' if i % 2 else 'You nice thing'}. More words", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    texts = {1: "😀 é. So vile! Calm words. A vile one", 2: "Calm words", 3: None}
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), model).collect()}
    assert [texts[1][x.start : x.end] for x in got[1].offending] == ["So vile", "A vile one"]
    assert max(x.score for x in got[1].offending) == got[1].worst_score and all(r.n_offending == len(r.offending) for r in got.values())
    assert got[2].offending == got[3].offending == []


def test_quality(spark, docs, labels, odd):
    model = quality.fit(docs, labels)
    rows = _held_accuracy(quality.score(docs, model), labels, "quality")
    assert len(rows) > 50 and sum(p == y for p, y in rows) / len(rows) > 0.93
    found = quality.score(odd, model).collect()
    assert len(found) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert {r.score for r in quality.score(odd, quality.fit(docs.limit(0), labels)).collect()} == {0.5}
    assert quality.score(odd.limit(0), model).count() == 0


def test_quality_learns_from_every_labelled_document(spark):
    """Texts of over 20 000 characters and all but some 8 000 documents were not learned from."""
    rows = [(i, ("plain words of a text. " if i % 2 else "BUY!! $$$ 99% <<<>>> ") * 1000, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = quality.score(df, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got) and quality.fit(df.repartition(7), df)[3] == model[3]


def test_threshold_is_the_exact_quantile(spark):
    import numpy as np

    s = np.concatenate([np.random.default_rng(3).normal(size=20000), np.full(5000, 0.25), [1e6, -1e6]])
    df = spark.createDataFrame([(float(v),) for v in s], "s double")
    for rank in (0, 1, 7000, 15000, 25001):
        assert quality._at_rank(df, rank, s.min(), s.max()) == np.sort(s)[rank]


def test_language(spark, docs, odd):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    found = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(odd, model).collect()}
    assert found == {(1, True), (2, True), (None, False), (3, True), (4, False), (5, False), (6, True)}
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    assert langid.keep_known(odd, model).where("doc_id in (1, 2, 3, 6)").count() == 0
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_more_languages_than_a_word_has_bits(spark):
    alphabet = [chr(0x4E00 + 97 * k) for k in range(80)]
    rows = [(i, " ".join(alphabet[i % 80] * n for n in (3, 4, 5)), f"l{i % 80:02}") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(df, langid.fit(df)).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_a_rare_language_is_learned_beside_a_large_one(spark):
    rare, common = "zorblik vuntra mekosh pilluda", "the quiet harbour lights again"
    rows = spark.range(40_000).selectExpr("id as doc_id", f"case when id % 2000 = 0 then '{rare}' else '{common}' end as text", "case when id % 2000 = 0 then 'rare' else 'common' end as lang")
    alone = rows.where("lang = 'rare' or doc_id < 200")
    for docs in (alone, rows):
        model = langid.fit(docs)
        assert model.langs == ["common", "rare"]
        assert {r.lang_pred for r in langid.identify(rows.where("lang = 'rare'"), model).collect()} == {"rare"}
    long = rows.selectExpr("doc_id", "case when lang = 'rare' and doc_id % 4000 = 0 then repeat(text, 1000) else text end as text", "lang")
    assert langid.fit(long, 10).langs == ["common", "rare"]


def _parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")


def test_url_rules_and_model(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.ORG/en/12?x#y", "http://example.org/es/", "http://notexample.org/es/1", "http://org/a", "http://x.com/fr/1", "http://com/de/", "http://x.com/fr", "ftp://É.org?q://z/", "a://b://c/d", "http://casino-pills.net/win", "http://library.net/catalogue", "x://" + "a" * 5000 + "/" + "b" * 5000]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.fit(url_filter.labelled(spark))).collect()}
    for i, u in enumerate(urls):
        host, path = _parts(u)
        fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[1] if fits else None), u
        assert got[i].verdict == (max(fits)[2] if fits else "block" if got[i].score >= 0.5 else "allow")
    assert got[13].verdict == "block" and got[14].verdict == "allow"
    assert url_filter.judge(df.limit(0), ([0.0] * url_filter.BUCKETS, 0.0)).count() == 0


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "b😀d"), (1, 1, "assistant", "b😀d"),
        (2, 0, "user", "alone"), (4, 0, "user", "same"), (5, 0, "user", "same"), (7, 0, None, None), (None, 0, "user", "lost"),
        (8, 0, "user", "<|im_end|>"), (9, 0, "user", "other"), (9, None, "system", "first"),
    ]
    got = {r.pair_id: r for r in preference.format_pairs(spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, pair_id int")).collect()}
    p = got[0]
    assert (p.n_prefix, p.prompt, p.chosen, p.rejected) == (1, "<|im_start|>user\nhi<|im_end|>\n", "<|im_start|>assistant\ngood<|im_end|>\n", "<|im_start|>assistant\nb😀d<|im_end|>\n")
    a, b = map(int, p.rejected_mask.split(":"))
    assert p.rejected[a:b] == "b😀d<|im_end|>" and p.chosen_mask == "22:36"
    assert (got[1].prompt, got[1].rejected, got[1].n_rejected, got[1].chosen_mask) == ("", None, None, "")
    assert (got[2].n_prefix, got[2].chosen, got[2].rejected, got[2].n_chosen) == (1, "", "", 0)
    assert got[3].chosen is None and got[3].rejected == "<|im_start|>\n<|im_end|>\n"
    assert got[4].chosen == "<|im_start|>user\n<||im_end||><|im_end|>\n" and got[4].rejected.startswith("<|im_start|>system")
    assert set(got) == {0, 1, 2, 3, 4}
    assert preference.format_pairs(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    big = [(2**60 + k, 1, "user", f"t{k // 2}") for k in range(2, 6)] + [(-1, 1, "user", "x"), (-2, 1, "user", "x")]
    got = {r.pair_id: (r.n_prefix, r.n_chosen, r.n_rejected) for r in preference.format_pairs(spark.createDataFrame(big, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {2**59 + 1: (1, 0, 0), 2**59 + 2: (1, 0, 0), -1: (1, 0, 0)}
