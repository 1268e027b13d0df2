"""URL verdicts: rules for hosts and paths first, else logistic regression on hashed character n-grams.

N-grams, rules and scores are DataFrame functions. The model is fitted from a small labelled table;
its weights are as many as there are buckets, whatever the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.arrays import let, letters
from inkspan.llm.sample import thin

BUCKETS = 4096
SIZES = (3, 4, 5)
STEPS, RATE, RIDGE = 60, 4.0, 1e-3
MOST_EXAMPLES = 2000  # rows of the labelled table that are learned from, about
BLOCK_AT = 0.5

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: The labelled table: addresses to allow and to block.
ALLOW = """https://www.university.edu/library/catalogue https://news.daily-times.org/world/2024/05/article https://en.encyclopedia.org/wiki/Physics
https://docs.project.io/manual/install http://city-council.gov/services/waste https://museum.net/exhibitions/current https://blog.engineer.dev/posts/compilers
https://school.org/timetable https://weather.service.net/forecast/week http://www.bookshop.com/authors/classic https://research.institute.edu/papers/2023/12.pdf
https://open-data.org/datasets/rivers https://forum.gardeners.net/topic/roses http://recipes.kitchen.com/soup https://travel.guide.org/mountains/hiking
https://hospital.org/patients/visits https://law.review.edu/volume/7 https://maps.region.gov/trails https://music.archive.org/recordings/choir https://thean.example.com/en/120
http://erther.example.net/fr/88 https://m.tionth.example.com/es/401.html https://blog.ndered.example.net/de/7""".split()
BLOCK = """http://best-casino-win.com/bonus/spin https://casino-jackpot.net/slots http://cheap-pills-online.biz/viagra https://pills-discount.com/order
https://free-bets-now.com/odds http://freebets.club/signup https://hot-xxx-cams.com/live http://adult-porn-videos.net/free https://quick-loans-cash.biz/apply
http://win-money-fast.top/prize https://replica-watches-cheap.com/rolex http://free-iphone-prize.win/claim https://poker-bonus-casino.com/play http://betting-tips-win.net/today
https://cheap-meds-pharmacy.com/buy http://xxx-dating-hot.com/join https://crypto-profit-fast.top/invest http://payday-loans.biz/instant https://lottery-win.top/ticket
http://pills.cheap-pharma.net/sale https://casino.free-spins.com/win http://free-bets.vip/bonus""".split()


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``, the host in lower case (A-Z), then the path up to ``?`` or ``#``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, the first by name if several are as long; null where none fits.

    The rules are part of the expression: hundreds, not millions.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):  # later ones win
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, each with its ends marked."""
    def cut(mark, n):
        one = lambda chars: lambda i: F.pmod(F.xxhash64(F.lit(mark), *[F.get(chars, i + k) for k in range(n)]), F.lit(BUCKETS)).cast("int")
        at = lambda chars: F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return lambda chars: F.transform(at(chars), one(chars))

    out = []
    for mark, part in (("h", host), ("p", path)):
        chars = F.concat(F.array(F.lit("^")), letters(part), F.array(F.lit("$")))
        out.append(let(chars, lambda c, mark=mark: F.concat(*[cut(mark, n)(c) for n in SIZES])))
    return F.concat(*out)


def margin(buckets: Column, weights, bias) -> Column:
    w = F.split(F.lit(",".join(repr(float(x)) for x in weights)), ",").cast("array<double>")  # folded to one constant
    return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(w, b)) / F.sqrt(F.greatest(F.size(buckets), F.lit(1))) + float(bias)


def labelled(spark) -> DataFrame:
    rows = ", ".join(f"('{u}', {y})" for y, urls in ((0, ALLOW), (1, BLOCK)) for u in urls)
    return spark.sql(f"select * from values {rows} as t(url, y)")


def fit(examples: DataFrame, steps=STEPS, most=MOST_EXAMPLES):
    """(weights, bias) from a small table (url, y), y = 1 to block; rows with null values are skipped.

    The n-grams come from Spark; the gradient steps over at most about ``most`` rows of bucket
    numbers are plain arithmetic on the driver. Beyond that a hashed sample is learned from.
    """
    host, path = parts(F.col("url"))
    rows = thin(examples.where("url is not null and y in (0, 1)"), most, "url").select(F.col("y").cast("double").alias("y"), grams(host, path).alias("g")).collect()
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(steps if rows else 0):
        grad, bias_grad = [RIDGE * w for w in weights], 0.0
        for y, g in rows:
            x = 1 / math.sqrt(max(1, len(g)))
            miss = (1 / (1 + math.exp(-x * sum(weights[b] for b in g) - bias)) - y) / len(rows)
            bias_grad += miss
            for b in g:
                grad[b] += miss * x
        weights = [w - RATE * d for w, d in zip(weights, grad, strict=True)]
        bias -= RATE * bias_grad / 4
    return weights, bias


def judge(pages: DataFrame, model, rules=RULES) -> DataFrame:
    """One row per page: host, path, the longest rule that fits, the verdict, and the model's score.

    A null url or one without ``://`` has an empty host and path, and gets the model's verdict on
    empty strings. Repeated pages are judged per row.
    """
    host, path = parts(F.col("url").cast("string"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    df = df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_v"), (1 / (1 + F.exp(-margin(grams(F.col("host"), F.col("path")), *model)))).alias("score"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"), "score")
