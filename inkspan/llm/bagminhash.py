"""Near copies of texts by weighted MinHash (BagMinHash) on five-word shingles.

A text is a bag of shingles; a shingle's weight is how often it stands there. Every shingle runs
Poisson processes over its weight: one on each dyadic interval of weight levels, with a rate equal
to the interval's width, its points thinned to the levels that the weight reaches. Each point falls
into one of ``SLOTS`` slots; a slot keeps the earliest point. Two bags agree in a slot with a
probability equal to their weighted Jaccard similarity. Points are drawn in time order and only up
to the time by which all slots are filled, so a bag costs about one draw a shingle.

Slots are banded into buckets. Equal bags are one class from the start. Inside a bucket every class
is compared with one centre first; what is still unconnected afterwards is compared with the whole
bucket, block by block, which makes no pair rows and loses no link. Every candidate is verified on
the bags themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.graph import components
from inkspan.llm.words import U, column, mix, slices, text_buffer, words
from inkspan.session import cut_lineage, small_side

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5  # a pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^5)^25 = 0.99995
SLOTS = 128
MIN_AGREE = 98  # of 128 one-bit slots; 115 are expected at similarity 0.8, and this is five standard deviations lower
BLOCK_WORDS, BLOCK_ROWS = 200_000, 1024  # of one side of a block, about; a longer text is a block of its own
FILTER_BITS = 24  # of the id filter: at most 2^18 rows of 64 bits are broadcast, whatever the input

SIGNATURE = "doc_id bigint, said bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>, b0 bigint, b1 bigint"
_GOLD = U(0x9E3779B97F4A7C15)


def bags(column_, k=WORDS):
    """(text, shingle, weight): distinct shingles of each text with their counts, by text."""
    doc, h = words(column_).shingles(k)
    key = np.sort((doc.astype(U) << U(44)) | (h >> U(20)))  # 44 bits tell shingles of one text apart
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U(44)).astype(np.int64), key & U((1 << 44) - 1), weight


def _points(doc, seed, base, width, weight, until, slots):
    """Points up to each text's time: (text, slot, time, identity), thinned to levels below the weight."""
    out, t, r = [], np.zeros(len(doc)), 0
    while len(doc):
        many = int(np.clip(8192 // len(doc), 1, 64))
        x = mix(seed[:, None] + _GOLD * np.arange(r + 1, r + many + 1, dtype=U)[None, :])
        times = t[:, None] + np.cumsum(-np.log(((x >> U(11)).astype(float) + 0.5) / (1 << 53)) / width, axis=1)
        live = times <= until[doc][:, None]
        row, col = np.nonzero(live)
        y = mix(x[row, col] ^ U(0xD1B54A32D192ED03))
        if width > 1:
            level = base + ((y >> U(12)) % U(width)).astype(np.int64)
            ok = level < weight[row]
            row, col, y = row[ok], col[ok], y[ok]
        z = mix(y)
        out.append((doc[row], (z % U(slots)).astype(np.int64), times[row, col], (z >> U(32)).astype(np.uint32)))
        go = live[:, -1]
        doc, seed, weight, t = doc[go], seed[go], weight[go], times[go, -1]
        r += many
    return out


def signature(doc, shingle, weight, n, slots=SLOTS):
    """(n, slots) identities of the earliest points; texts without shingles stay 0."""
    total = np.bincount(doc, weight, n)
    until = slots * (np.log(slots) + 2) / np.maximum(total, 1)
    best = np.zeros((n, slots), np.uint32)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        d, s, w = doc[use], shingle[use], weight[use]
        found, base, width, level = [], 0, 1, 0
        while len(d):
            found += _points(d, mix(s ^ mix(np.full(1, level, U))), base, width, w, until, slots)
            base, width, level = (1, 1, 1) if level == 0 else (base * 2, width * 2, level + 1)
            reach = w > base
            d, s, w = d[reach], s[reach], w[reach]
        pd, slot, time, who = (np.concatenate(x) for x in zip(*found, strict=True))
        key = pd * slots + slot
        earliest = np.full(n * slots, np.inf)
        np.minimum.at(earliest, key, time)
        done = todo & np.isfinite(earliest).reshape(n, slots).all(1)
        pick = done[pd] & (time == earliest[key])
        best.reshape(-1)[key[pick]] = who[pick]
        todo &= ~done
        until = np.where(todo, until * 2, until)
    return best


def _per_text(values, doc, n):
    sums = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    at = np.searchsorted(doc, np.arange(n + 1))
    return sums[at[1:]] - sums[at[:-1]]


def _signed(batches):
    for batch in batches:
        for part in slices(batch):
            n = part.num_rows
            doc, h, w = bags(column(part, "text"))
            ids = signature(doc, h, w, n)
            bands = np.zeros((n, BANDS), U)
            for r in range(ROWS):
                bands = mix(bands + ids[:, r : BANDS * ROWS : ROWS].astype(U) + U(r))
            bits = np.packbits((ids & 1).astype(np.uint8), axis=1).view(np.int64)
            keys = [_per_text(mix(h + w.astype(U) * c), doc, n).view(np.int64) for c in (_GOLD, U(0xC2B2AE3D27D4EB4F))]
            total = np.bincount(doc, w, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), column(part, "said"), pa.array(keys[0]), pa.array(keys[1]), pa.array(total), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(2)]],
                [f.split()[0] for f in SIGNATURE.split(", ")],
            )


def _said(text="text"):
    """A hash that tells the texts of rows with the same doc_id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), _said().alias("said"), F.col("text").cast("string")).mapInArrow(_signed, SIGNATURE)


def _similar(batches):
    for batch in batches:
        size = [np.diff(text_buffer(column(batch, c))[1]) for c in ("ta", "tb")]
        total = np.cumsum(size[0] + size[1])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (2 << 20), "right")))
            part = batch.slice(at, to - at)
            at = to
            j = bag_similarity(column(part, "ta"), column(part, "tb"))
            ok = pa.array(j >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([column(part, "a"), column(part, "b"), pa.array(j)], ["a", "b", "similarity"]).filter(ok)


def bag_similarity(left, right, k=WORDS):
    """Weighted Jaccard similarity of the shingle bags of two columns of texts, row by row; 0 where both are empty."""
    n = len(left)
    sides = [words(c).shingles(k) for c in (left, right)]
    _, code = np.unique(np.concatenate([h for _, h in sides]), return_inverse=True)
    cut = len(sides[0][1])
    counted = [np.unique(d.astype(np.int64) << 32 | c, return_counts=True) for (d, _), c in zip(sides, (code[:cut], code[cut:]), strict=True)]
    _, ia, ib = np.intersect1d(counted[0][0], counted[1][0], assume_unique=True, return_indices=True)
    both = np.bincount(counted[0][0][ia] >> 32, np.minimum(counted[0][1][ia], counted[1][1][ib]), n)
    total = sum(np.bincount(d, minlength=n) for d, _ in sides) - both
    return both / np.maximum(total, 1)


def _block(table):
    """Links between the two sides of a block, each as an edge to the smallest of what it is linked with there."""
    table = table.combine_chunks()
    n = len(table)
    doc, h = words(table.column("text")).shingles(WORDS)
    order = np.lexsort((h, doc))
    doc, h = doc[order].astype(np.int64), h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))  # the k-th time that a text says it
    _, col = np.unique(mix(h + times.astype(U) * _GOLD), return_inverse=True)
    total = np.bincount(doc, minlength=n)
    often = np.bincount(col) > 1
    number = np.cumsum(often) - 1
    doc, col = doc[often[col]], number[col[often[col]]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    left = table.column("is_rest").to_numpy(zero_copy_only=False).astype(bool)
    both = np.zeros((left.sum(), (~left).sum()))
    for first in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(col, (first, first + 4096))
        m = np.zeros((n, 4096), np.float32)
        m[doc[a:b], col[a:b] - first] = 1
        both += m[left] @ m[~left].T
    rep, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
    near = both >= THRESHOLD * np.maximum(total[left][:, None] + total[~left][None, :] - both, 1) - 1e-9
    i, j = np.nonzero(near & (own[left][:, None] != own[~left][None, :]))
    a, b = rep[left][i], rep[~left][j]
    low = {}
    for x, y in zip(a, b, strict=True):  # a forest: one edge for each merge
        x, y = _root(low, x), _root(low, y)
        if x != y:
            low[max(x, y)] = min(x, y)
    return pa.table({"a": pa.array(list(low), pa.int64()), "b": pa.array(list(low.values()), pa.int64())})


def _root(low, x):
    while x in low:
        x = low[x]
    return x


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, said, text) of the documents whose id may be among ``ids``: a one-hash bit filter of fixed size is broadcast."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << FILTER_BITS}) % 64 as int))")
    bits = ids.select(F.col("id").alias("doc_id")).select((h / 64).cast("int").alias("_w"), bit.alias("_bit")).groupBy("_w").agg(F.bit_or("_bit").alias("_bits"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _said().alias("said"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.withColumns({"_w": (h / 64).cast("int"), "_bit": bit}).join(F.broadcast(bits), "_w").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select("doc_id", "said", "text")


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose bags overlap by at least the threshold; a text is found by its doc_id and ``said``."""
    texts = _only(docs, pairs.select(F.explode(F.array("a_doc", "b_doc")).alias("id")))
    of = lambda side: texts.select(F.col("doc_id").alias(f"{side}_doc"), F.col("said").alias(f"{side}_said"), F.col("text").alias(f"t{side}"))
    left = pairs.drop("agree").join(of("a"), ["a_doc", "a_said"]).select("a", "b", "ta", "b_doc", "b_said")
    return left.join(of("b"), ["b_doc", "b_said"]).select("a", "b", "ta", "tb").mapInArrow(_similar, "a bigint, b bigint, similarity double").select("a", "b").distinct()


def _agree(p, q):
    return SLOTS - sum(F.bit_count(F.col(f"{p}{k}").bitwiseXOR(F.col(f"{q}{k}"))) for k in range(2))


def _with_bits(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("rep").alias(side), F.col("doc_id").alias(f"{side}_doc"), F.col("said").alias(f"{side}_said"), *[F.col(f"b{k}").alias(f"_{side}{k}") for k in range(2)]), side)
    return pairs.withColumn("agree", _agree("_a", "_b")).where(F.col("agree") >= MIN_AGREE).select("a", "b", "a_doc", "a_said", "b_doc", "b_said", "agree")


def _grouped(docs: DataFrame) -> DataFrame:
    """The columns of ``groups``, and said, k1, k2 and n of each row.

    What is linked are classes of equal bags, not doc_ids: different texts under one id are apart.
    ``rep`` numbers the classes in the order of (doc_id, said) of their smallest row.
    """
    sig = cut_lineage(signatures(docs))
    worded = sig.where("n > 0 and doc_id is not null")
    classes = worded.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "said", "bands", "b0", "b1", "n")).alias("m"))
    ordered = classes.select("k1", "k2", "m.*").orderBy("doc_id", "said", "k1", "k2")
    reps = cut_lineage(ordered.withColumn("rep", F.monotonically_increasing_id()))  # partitions are ranges, so numbers are in order
    bits = reps.select("rep", "doc_id", "said", "b0", "b1")
    buckets = reps.select("rep", F.posexplode("bands").alias("p", "h")).select("rep", F.xxhash64("p", "h").alias("bucket"))
    centres = cut_lineage(buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("many")).where("many > 1"))
    members = cut_lineage(buckets.join(centres, "bucket"))
    first = _with_bits(members.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), bits)
    links = cut_lineage(verify(docs, first))
    comp = cut_lineage(components(links))

    # buckets of three and more whose members are not all connected: what is not with the centre meets all
    label = lambda rows, node, name: rows.join(comp.select(F.col("node").alias(node), F.col("component").alias("_c")), node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")
    open_ = label(label(members.where("many > 2"), "rep", "own"), "centre", "main").join(reps.select("rep", "n", "doc_id", "said"), "rep")
    is_rest = F.col("own") != F.col("main")
    cuts = lambda c: F.greatest(F.ceil(F.sum(F.when(c, F.col("n"))) / BLOCK_WORDS), F.ceil(F.count(F.when(c, 1)) / BLOCK_ROWS), F.lit(1)).cast("int")
    sizes = open_.groupBy("bucket").agg(cuts(is_rest).alias("pi"), cuts(F.lit(True)).alias("pj"), F.max(is_rest).alias("mixed")).where("mixed").hint("rebalance")
    open_ = cut_lineage(open_.join(sizes, "bucket").select("bucket", "rep", "doc_id", "said", "own", "pi", "pj", is_rest.alias("is_rest")))
    if not open_.isEmpty():
        own = lambda p: F.pmod(F.xxhash64("rep"), F.col(p)).cast("int")
        every = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
        rest = open_.where("is_rest").select("bucket", own("pi").alias("i"), every("pj").alias("j"), "is_rest", "rep", "doc_id", "said", "own")
        all_ = open_.select("bucket", every("pi").alias("i"), own("pj").alias("j"), F.lit(False).alias("is_rest"), "rep", "doc_id", "said", "own")
        texts = _only(docs, open_.select(F.col("doc_id").alias("id")))
        met = rest.unionByName(all_).join(texts, ["doc_id", "said"]).drop("doc_id", "said").groupBy("bucket", "i", "j").applyInArrow(_block, "a bigint, b bigint")
        comp = cut_lineage(components(links.unionByName(met)))
    first_ids = small_side(comp.where("node = component").select("component").join(reps.select(F.col("rep").alias("component"), F.col("doc_id").alias("_first")), "component"))
    placed = reps.select("k1", "k2", "rep", F.col("doc_id").alias("_own")).join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(first_ids, "component", "left")
    placed = placed.select("k1", "k2", F.coalesce("_first", "_own").alias("_g"), F.coalesce(F.col("rep") == F.col("component"), F.lit(True)).alias("_stays"))
    keys = [F.when(F.col("n") > 0, F.col(k)).alias(k) for k in ("k1", "k2")]
    out = sig.select("doc_id", "said", *keys, "n").join(placed, ["k1", "k2"], "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("_g", "doc_id"))
    return out.select("doc_id", group.alias("group_id"), F.coalesce(F.col("_stays") & (group == F.col("doc_id")), F.lit(True)).alias("kept"), "said", "k1", "k2", "n")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, kept): the smallest doc_id reachable over links of similarity 0.8 or more.

    One row per row of ``docs``, judged by its own text; of each group exactly the text with doc_id =
    group_id is kept (repeated rows of it share the answer). Groups of unlike texts whose smallest id
    is the same share the number, and each keeps its own. A text of one to four words is one shingle.
    Texts without words (null, empty, only signs) link with nothing. Rows without doc_id are kept with
    a null group and link with nothing.
    """
    return _grouped(docs).select("doc_id", "group_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which one in each group stays.

    Of rows with the same id one for each text that is kept stays: among equal bags, or equal texts
    without words, the first row in the order of its JSON form.
    """
    found = cut_lineage(_grouped(docs).where("doc_id is not null").withColumnRenamed("doc_id", "_id"))
    ids = found.groupBy("_id").agg(F.count("*").alias("many"), F.max("kept").alias("any"))
    same = F.col("_docs.doc_id") == F.col("_found._id")
    out = docs.alias("_docs").join(ids.where("not any").select("_id").alias("_found"), same, "left_anti")
    twice = cut_lineage(ids.where("any and many > 1").select("_id"))
    if twice.isEmpty():
        return out
    again = out.alias("_docs").join(twice.alias("_found"), same, "left_semi")
    again = again.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), _said().alias("said"))
    kept = found.where("kept").join(twice, "_id").select("_id", "said", "k1", "k2", F.when(F.col("n") == 0, F.col("said")).alias("_bare")).distinct()
    again = again.join(kept, ["_id", "said"]).groupBy("_id", "k1", "k2", "_bare").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return out.alias("_docs").join(twice.alias("_found"), same, "left_anti").unionByName(again)
