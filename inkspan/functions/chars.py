"""Character keys, vertical classes, labels and look-alike pools, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Font space, and the vertical box (top, bottom, overshoot) of each mark.
UPM, CAP, XH, ASC, DESC, SPACE_ADVANCE = 1000, 700, 490, 730, -210, 340
MARK_BOXES = {
    ".": (130, 0, False),
    ",": (140, -70, False),
    ":": (490, 0, False),
    ";": (490, -70, False),
    "'": (700, 510, False),
    '"': (700, 510, False),
    "`": (700, 510, False),
    "-": (370, 260, False),
    "_": (25, -65, False),
    "(": (740, -150, False),
    ")": (740, -150, False),
    "[": (740, -150, False),
    "]": (740, -150, False),
    "{": (740, -150, False),
    "}": (740, -150, False),
    "/": (740, -110, False),
    "\\": (740, -110, False),
    "|": (740, -150, False),
    "*": (700, 390, False),
    "+": (555, 145, False),
    "=": (495, 205, False),
    "<": (555, 145, False),
    ">": (555, 145, False),
    "^": (730, 460, False),
    "~": (425, 250, False),
    "!": (700, 0, True),
    "?": (700, 0, True),
    "$": (760, -60, False),
    "@": (700, -40, False),
}
# Names of marks in file names.
MARK_NAMES = {
    ".": "period", ",": "comma", ":": "colon", ";": "semicolon", "!": "exclaim",
    "?": "question", "'": "apostrophe", '"': "quote", "-": "hyphen",
    "_": "underscore", "#": "hash", "@": "at", "&": "ampersand", "$": "dollar",
    "%": "percent", "(": "paren-open", ")": "paren-close", "[": "bracket-open",
    "]": "bracket-close", "*": "asterisk", "+": "plus", "=": "equals",
    "/": "slash", "\\": "backslash", "<": "less", ">": "greater",
    "`": "backtick", "{": "brace-open", "}": "brace-close", "|": "pipe",
    "~": "tilde", "^": "caret",
}
# The display sections of the character grid.
SECTIONS = {
    "Caps": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "Lowercase": "abcdefghijklmnopqrstuvwxyz",
    "Numerals": "0123456789",
    "Marks": ".,:;!?'\"-_#@&$%()[]*+=/\\<>",
}
# Lower-case letters drawn alike in both cases.
SAME_IN_BOTH_CASES = "cosuvwxzky"


def _lit_map(d, to=F.lit) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), to(v))])


def char_key(value: Column) -> Column:
    """Library key of what was typed: one character, or 2-4 letters/digits (a ligature)."""
    v = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    return F.when(v.rlike("^[A-Za-z0-9]{2,4}$"), v).otherwise(F.right(v, F.lit(1)))


def _box(c: Column) -> Column:
    """Vertical box of one character."""

    def box(name, top, bottom, os):
        return F.struct(
            F.lit(name).alias("cls_name"), F.lit(top).alias("top"),
            F.lit(bottom).alias("bottom"), F.lit(os).alias("os"),
        )

    marks = _lit_map(MARK_BOXES, lambda v: box("mark", *v))
    return (
        F.when(c.rlike("^[A-Z0-9]$"), box("cap", CAP, 0, True))
        .when(c.rlike("^[bdfhkl]$"), box("asc", ASC, 0, True))
        .when(c == "t", box("asc", 650, 0, True))
        .when(c.rlike("^[gpqy]$"), box("desc", XH, DESC, True))
        .when(c == "j", box("desc", 660, DESC, False))
        .when(c == "i", box("xh", 660, 0, False))
        .when(c.rlike("^[a-z]$"), box("xh", XH, 0, True))
        .otherwise(F.coalesce(F.try_element_at(marks, c), box("cap", CAP, 0, True)))
    )


def char_class(key: Column) -> Column:
    """struct(cls_name, top, bottom, os); a ligature spans the boxes of its members."""
    members = F.transform(F.split(key, ""), _box)
    liga = F.struct(
        F.lit("liga").alias("cls_name"),
        F.array_max(F.transform(members, lambda m: m["top"])).alias("top"),
        F.array_min(F.transform(members, lambda m: m["bottom"])).alias("bottom"),
        F.exists(members, lambda m: m["os"]).alias("os"),
    )
    return F.when(F.length(key) > 1, liga).otherwise(_box(key))


def char_label(key: Column) -> Column:
    # the names are one constant array, looked up by place: little generated code, however often it is inlined
    at = F.when(F.length(key) == 1, F.position(key, F.lit("".join(MARK_NAMES))))
    mark = F.get(F.split(F.lit(" ".join(MARK_NAMES.values())), " "), at - 1)
    tail = F.when(key.rlike("^[A-Za-z0-9]{2,4}$"), "-liga").when(key.rlike("^[A-Z]$"), "-caps").when(key.rlike("^[a-z]$"), "-lower").when(key.rlike("^[0-9]$"), "")
    return F.coalesce(F.concat(key, tail), mark, F.concat(F.lit("u"), F.lower(F.hex(F.ascii(key)))))


def svg_file_name(key: Column, vid: Column) -> Column:
    # inside a lambda the label is evaluated once from its key, not written out wherever the name is used
    label = F.element_at(F.transform(F.array(key), char_label), 1)
    return F.concat(label, F.lit("__"), vid, F.lit(".svg"))


def svg_id_from_name(name: Column) -> Column:
    """Variant id inside a mirrored file name; NULL where the name does not parse."""
    got = F.regexp_extract(name, r"(?i)__([a-z0-9]+)\.svg$", 1)
    return F.when(got != "", got)


def photo_stem(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\.[a-z0-9]{2,5}$", "")


def lookalike_class(ch: Column) -> Column:
    """Pool of characters a reader cannot tell apart."""
    return F.upper(F.translate(ch, "0l|1", "OIII"))


def case_variants(ch: Column) -> Column:
    """Array of the character in both cases where both are drawn alike, else itself."""
    lower = F.lower(ch)
    return F.when(
        lower.isin(*SAME_IN_BOTH_CASES), F.array_distinct(F.array(ch, lower, F.upper(ch)))
    ).otherwise(F.array(ch))
