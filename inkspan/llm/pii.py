"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust a score.

Everything is DataFrame functions. A pattern's matches come from ``regexp_extract_all`` and their
places from the lengths of what ``split`` leaves between them. Patterns are written with possessive
repeats and anchored at the start of a run, which finds the same matches in linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.arrays import let, letters, most_before, sums_before

_MAIL = "A-Za-z0-9._%+-"
KEEP = 0.6  # score from which a span of the method is kept; base spans always stay
BEFORE, AFTER = 40, 20  # code points around a match in which its words may stand
CHUNK = 64  # code points of the pieces that contexts are cut from; not less than BEFORE


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a character without which the pattern can't match; '' if none
    base: bool
    prior: float  # of the pattern alone
    checked: float  # added by a checksum
    context: float  # added by a word nearby
    words: str


KINDS = [
    Kind("email", rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, 0, 0.1, "mail|email|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "", True, 0.6, 0, 0.3, "ip|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", True, 0.2, 0.5, 0.3, "card|visa|mastercard|credit|payment|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.6, 0, 0.3, "phone|tel|call|mobile|fax|whatsapp"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", "", False, 0.2, 0.5, 0.3, "iban|account|bank|transfer"),
    Kind("short_card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", "", False, 0.1, 0.3, 0.3, "card|visa|credit|payment|amex|diners"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "", False, 0.3, 0, 0.4, "ssn|social security|tax id"),
]


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the Luhn checksum 0."""
    def step(total, c, i, n):
        v = F.ascii(c) - 48
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return total + F.when((n - i) % 2 == 0, v).otherwise(twice)

    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: step(s, F.substring(digits, i, F.lit(1)), i, n)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number's letters and digits, its first four moved to the end, leave 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest, c):
        a = F.ascii(c)
        return F.when(a < 58, (rest * 10 + a - 48) % 97).otherwise((rest * 100 + a - 55) % 97)

    return F.aggregate(letters(turned), F.lit(0), step) == 1


def _valid(kind: Kind, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    between = lambda lo, hi: F.length(digits).between(lo, hi)
    if kind.name == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind.name == "card":
        return F.when(between(16, 19), let(digits, luhn)).otherwise(False)
    if kind.name == "short_card":
        return F.when(between(13, 15), let(digits, luhn)).otherwise(False)
    if kind.name == "phone":
        return between(8, 15)
    if kind.name == "iban":
        code = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), let(code, mod97)).otherwise(False)
    return F.lit(True)


def _found(text: Column, kind: Kind) -> tuple[Column, Column]:
    none = F.array().cast("array<string>")
    there = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(there, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(none), F.when(there, F.split(text, kind.pattern, -1)).otherwise(none)


def _stretch(chunks: Column, at: Column, n: Column) -> Column:
    """``n`` (up to a chunk's length) code points from place ``at`` on, at the cost of two chunks."""
    k = (at / CHUNK).cast("int")
    both = F.concat(F.get(chunks, k), F.coalesce(F.get(chunks, k + 1), F.lit("")))
    return F.when(n > 0, F.coalesce(F.substring(both, at % CHUNK + 1, n), F.lit(""))).otherwise("")


def _spans(chunks: Column, kind: Kind, found: Column, between: Column) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed matches."""
    pairs = F.zip_with(found, between, lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    gaps = F.transform(pairs, lambda p: F.length(p["b"]) + F.coalesce(F.length(p["m"]), F.lit(0)))
    begin = F.zip_with(sums_before(gaps), pairs, lambda s, p: F.struct(p["m"].alias("m"), (s + F.length(p["b"])).alias("at")))
    ok = F.filter(begin, lambda x: x["m"].isNotNull() & _valid(kind, x["m"]))

    def scored(x):
        lo = F.greatest(x["at"] - BEFORE, F.lit(0))
        end = x["at"] + F.length(x["m"])
        near = F.lower(F.concat(_stretch(chunks, lo, x["at"] - lo), x["m"], _stretch(chunks, end, F.lit(AFTER))))
        score = F.lit(kind.prior + kind.checked) + F.when(near.rlike(rf"\b(?:{kind.words})\b"), kind.context).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["at"].alias("start"), end.alias("end"), score.alias("score"))

    spans = F.transform(ok, scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= KEEP)


def find(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """``keep``, the text as ``_text`` and an array of spans per kind (``_email`` ...). A null text counts as empty."""
    df = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    for k in KINDS:
        found, between = _found(F.col("_text"), k)
        df = df.withColumns({f"_f_{k.name}": found, f"_b_{k.name}": between})
    some = sum((F.size(f"_f_{k.name}") for k in KINDS), F.lit(0)) > 0
    chunks = F.when(some, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_chunks", chunks)
    return df.select(*keep, "_text", *[_spans(F.col("_chunks"), k, F.col(f"_f_{k.name}"), F.col(f"_b_{k.name}")).alias(f"_{k.name}") for k in KINDS])


def _written(kinds) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.concat(*[F.col(f"_{k.name}") for k in kinds]), one), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans as text and as an array with scores.

    Null and empty texts have none; repeated ids are reported per row.
    """
    df = find(docs)
    return df.select(
        "doc_id", *[F.size(f"_{k.name}").cast("bigint").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(_written([k for k in KINDS if k.base]), 256).alias("base_sha256"), _written(KINDS).alias("spans"),
        F.concat(*[F.col(f"_{k.name}") for k in KINDS]).alias("scored_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by its kind in angle brackets.

    Other columns stay; ``n_chars``, where present, follows the text; a null text stays null.
    """
    quoted = [F.col(f"`{c}`") for c in docs.columns]
    df = find(docs.select(F.struct(*quoted).alias("_row"), F.col("text")), ("_row",))
    spans = F.array_sort(F.transform(F.concat(*[F.col(f"_{k.name}") for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merged(all_):
        """Spans as they begin where none before reaches over, each to where the ones it meets end."""
        ends = F.transform(all_, lambda s: s["end"])
        reach = F.zip_with(all_, most_before(ends), lambda s, r: F.struct(s["start"].alias("start"), r.alias("before"), s["kind"].alias("kind")))
        heads = F.filter(reach, lambda s: s["before"] <= s["start"])
        return let(heads, lambda h: F.transform(h, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(h, i + 1)["before"], F.array_max(ends)).alias("end"), s["kind"].alias("kind"))))

    df = df.withColumn("_all", let(spans, merged))
    wide = F.encode("_text", "UTF-32")  # four bytes a code point: cutting a piece costs its length only

    def pieces(w):
        cut = lambda a, b: F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring(w, a * 4 + 1, (b - a) * 4)), "UTF-32")
        end_before = lambda i: F.when(i > 0, F.get(F.col("_all"), i - 1)["end"]).otherwise(0)
        parts = F.transform("_all", lambda s, i: F.concat(cut(end_before(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), cut(F.element_at("_all", -1)["end"], F.length("_text")))

    text = F.when(F.size("_all") == 0, F.col("_text")).otherwise(let(wide, pieces))
    df = df.withColumn("_new", text)
    was = F.col("_row")
    new = {"text": F.when(was["text"].isNotNull(), F.col("_new"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_all") > 0, F.length("_new")).otherwise(was["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return df.select(*[new.get(c, was[c]).alias(c) for c in docs.columns])
