import hashlib
import random

import pytest
from brute import base_spans, words

from inkspan.llm import bpe, pii, positional
from inkspan.llm.queries import tokenizer_path

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_decontamination_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: r.choice(["the", "of", "Red", "é", "fox9", "dog", "sun", "sea", "a", "b"]) + r.choice(["", "", "x", "y", "z"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 2, 5, 9, 10, 14])))) for i in range(30)] + [(3, "Red fox9 dog"), (None, "sun sea"), (77, None)]
    docs = []
    for i in range(80):
        t = [word() for _ in range(r.choice([0, 3, 40, 200]))]
        if i % 3 == 0:
            t[len(t) // 2 : len(t) // 2] = (items[r.randrange(30)][1] or "").split()
        docs.append((i, ", ".join(t).upper() if i % 2 else " ".join(t), "x"))
    docs += [(80, None, "x"), (81, "", "x"), (5, "sun sea", "x"), (None, "sun sea", "x")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string, n_words string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in positional.search(positional.build_index(d), b).collect())
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    want = []
    for i, text, _ in docs:
        w, hit, met = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in windows:
                    hit |= set(range(p, p + m))
                    met |= windows[tuple(w[p : p + m])]
        met = sorted(str(x) for x in met if x is not None)
        want.append((str(i), len(w), len(hit), len(met), sha(",".join(met)), bool(hit)))
    assert got == sorted(want)
    narrow = sorted((str(r.doc_id), r.n_hit) for r in positional.search(positional.build_index(d, b), b).collect())
    assert narrow == sorted((x[0], x[2]) for x in want)
    assert sorted(str(r.doc_id) for r in positional.drop_contaminated(d, b).collect()) == sorted(x[0] for x in want if not x[5])
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert positional.drop_contaminated(d, none).count() == len(docs)
    assert positional.search(positional.build_index(d.limit(0), b), b).count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item), (2, item.replace("gamma", "gamma some")), (3, "kappa " + item[:-6]), (4, item.replace("eta theta", "theta"))]
    b = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in positional.search(positional.build_index(d, b), b).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 0), 4: (0, 0)}
    item = "alpha beta gamma delta"
    docs = [(1, "beta gamma alpha delta alpha beta beta gamma"), (2, "delta"), (3, "beta gamma alpha delta"), (4, "gamma alpha delta")]
    b = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    assert {r.doc_id: r.n_near for r in positional.search(positional.build_index(d), b).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_proximity_and_spans_against_brute_force(spark, monkeypatch):
    r = random.Random(12)
    word = lambda: r.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 5, 6, 11, 12])))) for i in range(25)]
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 2, 7, 30])))) for i in range(60)]
    for i in range(0, 60, 4):  # shuffled a little
        w = items[i % 25][1].split()
        docs.append((100 + i, " ".join(x for _, x in sorted((k + r.uniform(-1.6, 1.6), x) for k, x in enumerate(w)))))
    want = {}
    for i, text in docs:
        w, exact, near, hit = text.split(), set(), set(), set()
        for item, t in items:
            x = t.split()
            m = min(10, len(x))
            for k in [x[j : j + m] for j in range(len(x) - m + 1)] if m else []:
                for p in range(-12, len(w) + 2):
                    if p >= 0 and w[p : p + m] == k:
                        exact.add(item)
                        hit |= set(range(p, p + m))
                    if all(any(0 <= q < len(w) and w[q] == v for q in range(p + j - 2, p + j + 3)) for j, v in enumerate(k)):
                        near.add(item)
        edges = [j for j in range(len(w) + 1) if (j in hit) != (j - 1 in hit)]
        want[i] = (len(exact), len(near - exact), list(zip(edges[::2], edges[1::2], strict=True)))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda index: {x.doc_id: (x.n_items, x.n_near, [tuple(s) for s in x.hit_spans]) for x in positional.search(index, b).collect()}
    assert found(positional.build_index(d, b)) == want and any(x[1] for x in want.values())
    monkeypatch.setattr(positional.blocks, "__defaults__", (60,))
    monkeypatch.setattr(positional, "PASS_BLOCKS", 2)
    assert found(positional.build_index(d, b)) == want
    assert {x.doc_id for x in positional.drop_contaminated(d, b).collect()} == {i for i, x in want.items() if not x[0]}


def test_blocks_of_items_agree_with_one_block(spark):
    b = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(50)], "item_id bigint, text string")
    assert len(list(positional.blocks(b, 30))) > 5
    text = " ".join(f"w{i}" for i in range(20, 40))
    import pyarrow as pa

    s = positional.Shard.of(pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]}))
    one, many = (s.search(list(positional.blocks(b, n))) for n in (1 << 20, 30))
    assert one == many and one["n_items"].to_pylist() == [18]


PARTS = ["a@b.c", "x", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+", " ", "-", "(12)", "3", "@", "a.b", "_", "😀", "é", "DE89370400440532013000", "card ", "378282246310005", "iban: ", "123-45-6789", "ssn ", "+1 (555) 010-9999", "\n"]


def test_long_dense_texts_take_time_in_proportion(spark):
    import time

    took = []
    for n in (4000, 4000, 32000):
        df = spark.createDataFrame([(1, "x@y.zz ab " * n)], "doc_id bigint, text string")
        t = time.time()
        assert pii.report(df).first().n_email == n
        assert pii.redact(df).first().text == "<EMAIL> ab " * n
        took.append(time.time() - t)
    assert took[2] < 24 * took[1]


def test_personal_data_against_brute_force(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["", None, "7" * 20000, "a" * 20000 + "@", "1.1" * 3000, "x@y.z " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'k' as _text", "7L as n_chars")
    found = {x.doc_id: x for x in pii.report(df).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        x = found[i]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == s[0] for s in want) for k in ("email", "ip", "card", "phone")], t
        assert x.base_sha256 == sha(",".join("%s:%d:%d" % s for s in want))
    assert sum("iban" in x.spans for x in found.values()) > 20 and sum("ssn" in x.spans for x in found.values()) > 5
    for x in pii.redact(df).collect():
        t, out, at = texts[x.doc_id], "", 0
        if t is None:
            assert x.text is None
            continue
        merged = []
        for s, e, k in sorted((int(y.split(":")[1]), int(y.split(":")[2]), y.split(":")[0]) for y in found[x.doc_id].spans.split(",") if y):
            if merged and merged[-1][1] > s:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e, k])
        for s, e, k in merged:
            out, at = out + t[at:s] + f"<{k.upper()}>", e
        out += t[at:]
        assert x.text == out and x._text == "k" and x.n_chars == (len(out) if merged else 7)
    assert pii.report(df.limit(0)).count() == 0


def test_context_decides_weak_kinds(spark):
    rows = [(1, "my ssn is 123-45-6789"), (2, "part 123-45-6789"), (3, "amex card 378282246310005"), (4, "id 378282246310005"), (5, "DE89370400440532013000"), (6, "DE88370400440532013000")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "ssn:10:21", 2: "", 3: "short_card:10:25", 4: "", 5: "iban:0:22", 6: ""}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


BITS = ["a", "b", "the", " ", "  ", "\n", "'s", "'ll", "'", "1", "23", "é", "😀", "漢", " ", "\u0085", "\t", "!", "!!", "<|endoftext|>", "<|", "²", "\u0301", "_"]


def test_tree_concatenation_equals_the_library(library):
    codec = bpe.Codec(bpe.load_vocabulary(tokenizer_path()), 6)
    r = random.Random(5)
    for _ in range(1500):
        s = "".join(r.choice(BITS) * r.choice([1, 1, 1, 3, 9]) for _ in range(r.randint(0, 30)))
        want = library.encode(s, add_special_tokens=False).ids
        n = r.randint(1, 12)
        assert codec.encode(s) == want
        assert codec.join_all([codec.encode(s[i : i + n]) for i in range(0, len(s), n)]) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_over_rows(spark, library):
    r = random.Random(9)
    texts = ["hello world", "", None, "z" * 3000, "word " * 400 + "q" * 700, "".join(r.choice(BITS) for _ in range(2000)), "hello world"]
    df = spark.createDataFrame([(i % 6, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids = bpe.encode(df, tokenizer_path(), text_leaf=100, piece_leaf=16)
    assert sorted((x.doc_id, x.ids) for x in ids.collect()) == sorted((i % 6, w) for i, w in enumerate(want))
    assert sorted((x.doc_id, x.text) for x in bpe.decode(ids, tokenizer_path()).collect()) == sorted((i % 6, t or "") for i, t in enumerate(texts))
    got = sorted((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.round_trip(df, tokenizer_path(), 64).collect())
    assert got == sorted((i % 6, len(w), sha(",".join(map(str, w))), sha(t or "")) for i, (t, w) in enumerate(zip(texts, want)))
    assert bpe.encode(df.limit(0), tokenizer_path()).count() == 0
