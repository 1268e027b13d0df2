"""Batch reading of letter grids: features, template scores, readings, ranking, evaluation.

grids(id, cell, v) in long form; templates(ch, cell, v). Scoring is an equi-join on the cell, with
the templates broadcast after a size check and sums combined map-side per (id, ch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.chars import lookalike_class
from inkspan.functions.numbers import half_up
from inkspan.operators.masks import complement, distance
from inkspan.session import small_side

# Prior of rare symbols, and the symbols about as common as letters.
RARE_PRIOR, COMMON_SYMBOLS = 0.15, "!?#*"
LONE_STROKES = list("lIi1!|jJ/\\.,'-")


def grid_features(ink: DataFrame, n: int = 24, box: int | None = None) -> DataFrame:
    """(photo_id, cell, v): exact area coverage of the ink box scaled into an n-cell grid.

    ink(photo_id, x, y). The longer side fills ``box`` cells (all n by default), centred, aspect kept.
    Each pixel meets only the cells it overlaps.
    """
    fit = float(box or n)
    b = ink.groupBy("photo_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    s = F.lit(fit) / F.greatest(w, h)
    b = b.select("photo_id", "x0", "y0", s.alias("s"), ((F.lit(float(n)) - w * s) / 2).alias("ox"), ((F.lit(float(n)) - h * s) / 2).alias("oy"))
    p = ink.join(b, "photo_id")
    for ax in ("x", "y"):
        p = p.withColumn(f"{ax}a", F.col(f"o{ax}") + (F.col(ax) - F.col(f"{ax}0")) * F.col("s")).withColumn(f"{ax}b", F.col(f"o{ax}") + (F.col(ax) - F.col(f"{ax}0") + 1) * F.col("s"))
    span = lambda ax: F.explode_outer(F.sequence(F.greatest(F.lit(0), F.floor(F.col(f"{ax}a") + 1e-9)).cast("int"), F.least(F.lit(n - 1), F.ceil(F.col(f"{ax}b") - 1e-9) - 1).cast("int")))
    c = p.withColumn("cx", span("x")).withColumn("cy", span("y"))
    part = lambda ax: F.least(F.col(f"{ax}b"), F.col(f"c{ax}") + 1.0) - F.greatest(F.col(f"{ax}a"), F.col(f"c{ax}").cast("double"))
    return c.groupBy("photo_id", (F.col("cy") * n + F.col("cx")).alias("cell")).agg(F.sum(part("x") * part("y")).alias("v"))


def template_scores(probes: DataFrame, templates: DataFrame, probe_info: DataFrame, template_info: DataFrame) -> DataFrame:
    """(id, ch, score) best of each character: soft IoU x hole factor x aspect factor.

    *_info(id | tpl, [ch], aspect, holes); templates(tpl, cell, v), dense over cells.
    """
    t = small_side(templates.select("tpl", "cell", F.col("v").alias("tv")))
    iou = probes.join(t, "cell").groupBy("id", "tpl").agg(
        F.sum(F.least("v", "tv")).alias("i"), F.sum(F.greatest("v", "tv")).alias("u")
    )
    info = template_info.select("tpl", "ch", F.col("aspect").alias("ta"), F.col("holes").alias("th"))
    j = iou.join(probe_info, "id").join(info, "tpl")
    dh = F.abs(F.col("holes") - F.col("th"))
    hole = F.when(dh == 0, 1.06).when(dh == 1, 0.9).otherwise(0.72)
    asp = F.greatest(F.lit(0.55), F.lit(1.0) - F.abs(F.log(F.col("aspect") / F.col("ta"))) * 0.35)
    score = F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(F.lit(0.0)) * hole * asp
    return j.groupBy("id", "ch").agg(F.max(score).alias("score"))


def match_confidence(scores: DataFrame) -> DataFrame:
    """(id, ch, confidence): best character; 0.75 top + 2.2 (top - second), clamped to 0..1."""
    top2 = scores.groupBy("id").agg(F.max(F.struct("score", "ch")).alias("a"))
    second = scores.join(top2, "id").where(F.col("ch") != F.col("a.ch")).groupBy("id").agg(F.max("score").alias("s2"))
    j = top2.join(second, "id", "left")
    margin = F.coalesce(F.col("a.score") - F.col("s2"), F.lit(0.0))
    return j.select("id", F.col("a.ch").alias("ch"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("a.score") * 0.75 + margin * 2.2)).alias("confidence"))


def expected_scores(scores: DataFrame, expected: str) -> DataFrame:
    """Only the expected character, in either case."""
    return scores.where(F.lower("ch") == expected.lower())


def _to_ink(cells: DataFrame, key, n, level):
    return cells.where(F.col("v") > level).select(F.col(key).alias("photo_id"), F.lit(n).alias("w"), F.lit(n).alias("h"), (F.col("cell") % n).alias("x"), F.floor(F.col("cell") / n).cast("int").alias("y"))


def _distance(cells, key, n, level):
    """Distance of every cell to the nearest inked cell."""
    ink = _to_ink(cells, key, n, level)
    off = distance(complement(ink), border_ink=True)
    cell = (F.col("y") * n + F.col("x")).alias("cell")
    return ink.select(F.col("photo_id").alias(key), cell, F.lit(0.0).alias("d")).unionByName(off.select(F.col("photo_id").alias(key), cell, "d"))


def chamfer_scores(probes: DataFrame, templates: DataFrame, n: int) -> DataFrame:
    """(id, tpl, score): weight-agnostic match, harmonic mean of precision and recall of ink.

    A probe without ink matches nothing: it has one row, of score 0, without a template.
    """
    sigma2 = 2 * 1.6 * 1.6
    near = lambda d: F.exp(-(F.col(d) * F.col(d)) / sigma2)
    t_d = small_side(_distance(templates, "tpl", n, 0.3))
    t_ink = small_side(templates.where(F.col("v") > 0.3).select("tpl", "cell"))
    prec = probes.where(F.col("v") > 0.2).select("id", "cell").join(t_d, "cell").groupBy("id", "tpl").agg(F.avg(near("d")).alias("p"))
    rec = _distance(probes, "id", n, 0.2).join(t_ink, "cell").groupBy("id", "tpl").agg(F.avg(near("d")).alias("r"))
    j = prec.join(rec, ["id", "tpl"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    tpl = j.schema["tpl"].dataType
    blank = probes.select("id").distinct().join(prec.select("id").distinct(), "id", "left_anti").select("id", F.lit(None).cast(tpl).alias("tpl"), F.lit(0.0).alias("p"), F.lit(0.0).alias("r"))
    j = j.select("id", "tpl", "p", "r").unionByName(blank)
    return j.select("id", "tpl", F.when(F.col("p") + F.col("r") > 0, F.col("p") * F.col("r") * 2 / (F.col("p") + F.col("r"))).otherwise(0.0).alias("score"))


def score(probes: DataFrame, weights: DataFrame, biases: DataFrame) -> DataFrame:
    """Dense layer and softmax: probes(id, cell, v), weights(ch, cell, wt), biases(ch, bias) -> (id, ch, p)."""
    w = small_side(weights.select("ch", "cell", "wt"))
    logit = probes.join(w, "cell").groupBy("id", "ch").agg(F.sum(F.col("v") * F.col("wt")).alias("z")).join(biases, "ch").withColumn("z", F.col("z") + F.col("bias"))
    one = Window.partitionBy("id")
    e = logit.withColumn("e", F.exp(F.col("z") - F.max("z").over(one)))
    return e.select("id", "ch", (F.col("e") / F.sum("e").over(one)).alias("p"))


def reweight(readings: DataFrame) -> DataFrame:
    """Prior applied and renormalised: (cand_id, ch, p); 'junk' counts as common."""
    common = (F.col("ch") == "junk") | F.col("ch").rlike("^[0-9A-Za-z]$") | F.col("ch").isin(*COMMON_SYMBOLS)
    q = readings.withColumn("p", F.col("p") * F.when(common, 1.0).otherwise(RARE_PRIOR))
    s = F.sum("p").over(Window.partitionBy("cand_id"))
    return q.withColumn("p", F.when(s > 0, F.col("p") / s).otherwise(F.col("p")))


def letterness(readings: DataFrame) -> DataFrame:
    return readings.groupBy("cand_id").agg((F.lit(1.0) - F.sum(F.when(F.col("ch") == "junk", F.col("p")).otherwise(0.0))).alias("letterness"))


def clarity(readings: DataFrame) -> DataFrame:
    """letterness x sqrt(min(1, most pooled probability over look-alikes))."""
    pools = readings.where(F.col("ch") != "junk").groupBy("cand_id", lookalike_class(F.col("ch")).alias("pool")).agg(F.sum("p").alias("p"))
    best = pools.groupBy("cand_id").agg(F.max("p").alias("best"))
    return letterness(readings).join(best, "cand_id", "left").select(
        "cand_id", "letterness", (F.col("letterness") * F.sqrt(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0))))).alias("clarity"))


def top_guesses(readings: DataFrame) -> DataFrame:
    """(cand_id, rank, ch, p, auto): guesses of at least 0.04 by rank; auto-fill where sure."""
    w = Window.partitionBy("cand_id").orderBy(F.col("p").desc(), "ch")
    r = readings.where(F.col("ch") != "junk").withColumn("rank", F.row_number().over(w)).where(F.col("p") >= 0.04)
    return r.join(letterness(readings), "cand_id").where(F.col("letterness") >= 0.3).select(
        "cand_id", "rank", "ch", "p", ((F.col("rank") == 1) & (F.col("letterness") >= 0.5) & (F.col("p") >= 0.35)).alias("auto"))


def rank_candidates(cands: DataFrame) -> DataFrame:
    """Adds score: clarity x size x centrality x cut-off x lone-stroke penalty.

    cands(photo_id, cand_id, pw, ph, x0, y0, x1, y1 photo pixels, ink, clarity, top).
    """
    tall = F.greatest(F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1)
    most = cands.groupBy("photo_id").agg(F.greatest(F.lit(1), F.max("ink")).alias("max_ink"), F.greatest(F.lit(1), F.max(tall)).alias("max_tall"))
    size = F.pow(F.col("ink") / F.col("max_ink"), F.lit(0.3)) * F.pow(F.least(F.lit(1.0), tall / F.col("max_tall")), F.lit(0.5))
    dx, dy = (F.col("x0") + F.col("x1")) / 2 - F.col("pw") / 2, (F.col("y0") + F.col("y1")) / 2 - F.col("ph") / 2
    d2 = (dx * dx + dy * dy) / (F.col("pw") * F.col("pw") + F.col("ph") * F.col("ph"))
    cut = (F.col("x0") <= 1) | (F.col("y0") <= 1) | (F.col("x1") >= F.col("pw") - 2) | (F.col("y1") >= F.col("ph") - 2)
    lone = F.when(F.col("top").isin(*LONE_STROKES), 0.45).otherwise(1.0)
    s = F.col("clarity") * size * F.exp(-d2 / (2 * 0.22 * 0.22)) * F.when(cut, 0.75).otherwise(1.0) * lone
    return cands.join(most, "photo_id").withColumn("score", s).drop("max_ink", "max_tall")


def choose_split(whole: DataFrame, letters: DataFrame) -> DataFrame:
    """Letters found inside a shape against the shape itself: (photo_id, shape, cand_id, kind, score).

    whole(photo_id, shape, cand_id, letterness, clarity, score);
    letters(photo_id, shape, cand_id, letterness, clarity, score, inside, explained).
    """
    w = whole.select("photo_id", "shape", F.col("letterness").alias("wl"), F.col("clarity").alias("wc"))
    better = F.when(F.col("wl").isNull() | (F.col("wl") < 0.6), F.col("letterness") >= 0.5).otherwise(F.col("clarity") > F.col("wc") + 0.1)
    judged = letters.join(w, ["photo_id", "shape"], "left").withColumn("take", F.col("explained") & (F.col("inside") < 0.6) & better)
    split = judged.groupBy("photo_id", "shape").agg(F.max("take").alias("split"))
    keep = judged.join(split.where("split"), ["photo_id", "shape"], "left_semi").select("photo_id", "shape", "cand_id", F.lit("letter").alias("kind"), "score")
    rest = whole.join(split, ["photo_id", "shape"], "left").select(
        "photo_id", "shape", "cand_id", F.lit("whole").alias("kind"), (F.col("score") * F.when(F.coalesce("split", F.lit(False)), 0.5).otherwise(1.0)).alias("score"))
    out = keep.unionByName(rest)
    top = out.groupBy("photo_id").agg(F.max("score").alias("top"))
    return out.join(top, "photo_id").where((F.col("kind") == "whole") | (F.col("score") >= F.col("top") * 0.12)).drop("top")


def stroke_score(elong: Column, size: Column, fill: Column, touch: Column, density: Column) -> Column:
    ramp = lambda v, a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - a) / (b - a)))
    return (
        ramp(elong, 2.5, 8.0) * ramp(size, 0.05, 0.22) * F.when(size > 1.05, 0.5).otherwise(1.0)
        * F.when(fill > 0.5, F.greatest(F.lit(0.0), (F.lit(0.85) - fill) / 0.35)).otherwise(1.0)
        * F.element_at(F.array(*[F.lit(v) for v in (1.0, 0.85, 0.5, 0.15, 0.0)]), touch + 1) * ramp(density, 0.5, 0.8)
    )


def rank_inks(scored: DataFrame) -> DataFrame:
    """scored(photo_id, ink, s): s1 + .35 s2 + .15 s3; at least max(.2, .3 best), by rank."""
    w = Window.partitionBy("photo_id", "ink").orderBy(F.col("s").desc())
    k = scored.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 3)
    tot = k.groupBy("photo_id", "ink").agg(F.round(F.sum(F.col("s") * F.element_at(F.array(F.lit(1.0), F.lit(0.35), F.lit(0.15)), F.col("k"))), 9).alias("total"))
    r = Window.partitionBy("photo_id").orderBy(F.col("total").desc(), "ink")
    best = F.max("total").over(Window.partitionBy("photo_id"))
    return tot.withColumn("rank", F.row_number().over(r)).withColumn("best", best).where(
        F.col("total") >= F.greatest(F.lit(0.2), F.col("best") * 0.3)).drop("best")


def lean(stems: DataFrame) -> DataFrame:
    """(cand_id, lean): length-weighted mean of the densest +-5 degree cluster, 0 unless trusted.

    stems(cand_id, i, ang, len, tall).
    """
    w = Window.partitionBy("cand_id").orderBy("ang").rangeBetween(-5, 5)
    c = stems.withColumn("cw", F.sum("len").over(w)).withColumn("ca", F.sum(F.col("ang") * F.col("len")).over(w) / F.col("cw"))
    best = c.groupBy("cand_id").agg(
        F.max_by(F.struct("cw", "ca"), F.struct(F.round("cw", 6), -F.col("i"))).alias("b"), F.sum("len").alias("total"), F.max("tall").alias("tall"))
    v = half_up(F.col("b.ca"), 1)
    ok = (F.col("b.cw") >= F.col("total") * 0.6) & (F.col("b.cw") >= F.col("tall") * 0.4) & (F.abs(v) >= 2)
    return best.select("cand_id", F.when(ok, v).otherwise(0.0).alias("lean"))


def pick_disjoint(groupings: DataFrame) -> DataFrame:
    """Best first, each of members no better one took: (shape, rank, gid).

    groupings(shape, gid, score, letterness, members array). The letters of one shape are at most a
    few dozen, folded inside their own row.
    """
    g = groupings.where(F.col("letterness") >= 0.5).groupBy("shape").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "gid", "members"))).alias("gs"))
    kinds = dict(groupings.dtypes)
    start = F.struct(F.array().cast(f"array<{kinds['gid']}>").alias("ids"), F.array().cast(kinds["members"]).alias("used"))

    def step(acc, e):
        free = ~F.arrays_overlap(acc["used"], e["members"])
        return F.when(free, F.struct(F.concat(acc["ids"], F.array(e["gid"])).alias("ids"), F.concat(acc["used"], e["members"]).alias("used"))).otherwise(acc)

    return g.select("shape", F.posexplode(F.aggregate("gs", start, step)["ids"]).alias("rank", "gid")).withColumn("rank", F.col("rank") + 1)


def accuracy(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Top-1 and top-3 share, in thousandths: scored(id, ch, p), truth(id, label)."""
    w = Window.partitionBy("id").orderBy(F.col("p").desc(), "ch")
    r = scored.withColumn("rank", F.row_number().over(w)).join(truth, "id").where(F.col("ch") == F.col("label"))
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("rank") == 1).cast("int")).alias("top1"), F.sum((F.col("rank") <= 3).cast("int")).alias("top3"))


def class_balance(labels: DataFrame, label="label") -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def quantize_int8(vectors: DataFrame) -> DataFrame:
    """Adds scale and q: q = round-half-even(v / scale) clipped to +-127, scale = max|v| / 127 or 1."""
    m = F.array_max(F.transform("vector", lambda v: F.abs(v.cast("double")))) / 127.0
    return vectors.withColumn("scale", F.when(m == 0, F.lit(1.0)).otherwise(m)).withColumn(
        "q", F.transform("vector", lambda v: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(v.cast("double") / F.col("scale")))).cast("tinyint")))


def dequantize(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", F.transform("q", lambda v: v.cast("double") * F.col("scale")))


def bench_summary(scores: DataFrame) -> DataFrame:
    """Mean scores by lane, NULLs skipped, 3 decimals; best candidate and first one's score."""
    return scores.groupBy("lane").agg(
        half_up(F.avg("iou"), 3).alias("mean_iou"), F.count("iou").alias("scored"),
        F.max_by("idx", F.struct("iou", -F.col("idx"))).alias("best_idx"), F.min_by("iou", "idx").alias("first_iou"))


def stratified_sample(df: DataFrame, by: str, quotas: dict, id_col: str, whole=(), blocked=None, seed=0) -> DataFrame:
    """Seeded quota per category, by the order of a hash; categories in ``whole`` are kept entire, blocked names left out.

    A category is counted in 4096 bins of the hash first; what lies in bins before the one that
    fills its quota is taken as it is, and only that bin is ranked, so no category meets in one task.
    """
    src = df.where(~F.col(blocked[0]).rlike(blocked[1])) if blocked else df
    all_of = src.where(F.col(by).isin(*whole)) if whole else src.limit(0)
    picked = src.where(F.col(by).isin(*[k for k in quotas if k not in whole]))
    quota = F.coalesce(*[F.when(F.col(by) == k, F.lit(v)) for k, v in quotas.items()], F.lit(0))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    rows = picked.select(F.col(by).alias("_by"), h.alias("_h"), F.col(id_col).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), quota.alias("_q")).withColumn("_bin", F.substring("_h", 1, 3))
    upto = Window.partitionBy("_by").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a category
    bins = rows.groupBy("_by", "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    j = rows.join(F.broadcast(bins), ["_by", "_bin"]).where(F.col("_before") < F.col("_q"))  # a category of ``quotas`` has 4096 rows
    sure = j.where(F.col("_before") + F.col("_n") <= F.col("_q"))
    rank = F.row_number().over(Window.partitionBy("_by", "_bin").orderBy("_h", "_id"))
    last = j.where(F.col("_before") + F.col("_n") > F.col("_q")).withColumn("_k", rank).where(F.col("_before") + F.col("_k") <= F.col("_q"))
    return all_of.unionByName(sure.select("_row.*")).unionByName(last.select("_row.*"))


def train_classifier(features: DataFrame, iterations=50):
    """Softmax classifier on features(features vector, label); returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(maxIter=iterations, family="multinomial").fit(features)
