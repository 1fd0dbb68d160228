"""Column expressions on names and recognised text lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that recognition confuses, both ways, lower case.
CONFUSED = {
    "v": "yu", "y": "vu", "u": "vy", "m": "nh", "n": "mh", "h": "nm", "c": "go", "g": "co", "s": "5", "5": "s", "z": "2", "2": "z",
    "b": "86", "8": "b6", "6": "8b", "o": "0q", "0": "oq", "q": "o0", "i": "1l", "1": "il", "l": "i1", "d": "0", "t": "7", "7": "t",
    "e": "f", "f": "e",
}
# Pairs that a cleaned-up name may differ by, upper case.
GUARD_PAIRS = ("0O", "0D", "0Q", "1I", "1L", "17", "2Z", "5S", "6G", "8B", "9G", "9Q")
# What marks a recognised line as a rating or device label rather than a name.
NOISE = (
    r"VCB", r"REACTOR", r"CT[x×]\d+", r"\d+\s*/\s*\d+\s*A\b", r"\d+(?:\.\d+)?\s*V\s*/\s*\d+(?:\.\d+)?\s*V\b", r"\d+(?:\.\d+)?\s*VA\b",
    r"\d+(?:\.\d+)?\s*kA\b", r"ZCT", r"MCCB", r"\d+(?:\.\d+)?\s*AF\b", r"\d+(?:\.\d+)?\s*%", r"\d+(?:\.\d+)?\s*kW\b",
    r"\d+(?:\.\d+)?\s*MW\b", r"\d+(?:\.\d+)?\s*MVA\b", r"\d+(?:\.\d+)?\s*kV\b", r"\d+(?:\.\d+)?\s*kVA\b", r"\d+(?:\.\d+)?\s*Hz\b",
    r"QPTR", r"CAPACITOR", r"\d+(?:\.\d+)?\s*kVAR\b", r"\bFROM\b", r"\bTO\b", r"VOLTAGE", r"DETECTOR", r"LED", r"SA[x×]\d+", r"ALARM",
    r"\bSEE\b", r"\bD\.C\b", r"\d+(?:\.\d+)?\s*[-]\s*kW\b", r"\d+[x×]CT\b", r"\d+(?:\.\d+)?\s*S\.R\b", r"S\.R\b", r"\d+\.\d+\s*k\b",
    r"\d+\s*/\s*\d+(?!\s*[AaVv])", r"\d+C[x×]\d+(?:-\d+)?", r"(?<![A-Za-z0-9_-])\d+\s*A\b", r"VT[x×]\d+", r"%Z\s*=",
)
# Fixed value: words that point to a panel elsewhere.
CROSS_REFERENCE = r"(?i)\b(?:from|to|ref|see|via|cable)\b"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form. Spark has no such function; it runs in Python for all rows of a column it is applied to."""
    return _nfkc(text)


def norm(text: Column, compatible: bool = False) -> Column:
    """Trimmed, lower case, each run of white space one space; compatible: the text is in compatibility form (or ASCII) already."""
    plain = text if compatible else nfkc(text)
    return F.regexp_replace(F.regexp_replace(F.lower(plain), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def alphanum(normed: Column) -> Column:
    return F.regexp_replace(normed, "[^a-z0-9]", "")


def strip_zeros(text: Column) -> Column:
    """Without leading zeros of numbers that follow a letter."""
    return F.regexp_replace(text, r"(?<=[a-z])0+(\d)", "$1")


def folded(bare: Column) -> Column:
    """With o, l and i as the digits they are taken for."""
    return F.translate(bare, "oli", "011")


def alike(a: Column, b: Column) -> Column:
    """a, b: alphanumeric forms without leading zeros. Of three characters at least and equal but for o/0, l/1, i/1."""
    return (F.least(F.length(a), F.length(b)) >= 3) & (folded(a) == folded(b))


def _differences(a: Column, b: Column) -> Column:
    """Pairs of unlike characters at the same place, as two-character strings."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, F.concat(x, y)))
    return F.filter(pairs, lambda p: p.isNotNull())


def _one_confused(a: Column, b: Column, pairs: list[str]) -> Column:
    """Of strings of equal length. An edit distance of one is then one unlike character; only where it is one are the characters looked at."""
    return (F.levenshtein(a, b, 1) == 1) & F.coalesce(F.get(_differences(a, b), F.lit(0)).isin(pairs), F.lit(False))


def _both_ways(table: dict[str, str]) -> list[str]:
    return sorted({p for a, bs in table.items() for b in bs for p in (a + b, b + a)})


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def confused(a: Column, b: Column, least: int = 4, need_digits: bool = True) -> Column:
    """Alphanumeric forms of equal length and equal digits that differ by one confusable character."""
    ok = (F.length(a) >= least) & (F.length(a) == F.length(b)) & (a != b) & (digits(a) == digits(b))
    if need_digits:
        ok = ok & (digits(a) != "")
    return ok & _one_confused(a, b, _both_ways(CONFUSED))


def one_apart(a: Column, b: Column, least: int = 3) -> Column:
    """Of equal length, with one unlike character at most."""
    return (F.length(a) >= least) & (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 1) >= 0)


def guard_close(a: Column, b: Column) -> Column:
    """Upper-case forms that differ by one pair of GUARD_PAIRS."""
    return (F.length(a) == F.length(b)) & _one_confused(a, b, [p for x in GUARD_PAIRS for p in (x, x[::-1])])


def guard_norm(name: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(name, r"(?U)[\s\-]", "")), r"(?<!\d)0+(\d)", "$1")


def guard_light(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, r"(?U)[\s\-_]", ""))


def quoted(text: Column) -> Column:
    """As a pattern that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.regexp_replace(text, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E"))


def stands_alone(needle: Column, hay: Column) -> Column:
    """Whether the needle stands in the hay (both normed) with no letter, digit or dash at either end; never if empty."""
    return (F.length(needle) > 0) & F.regexp_like(hay, F.concat(F.lit(r"(?<![a-z0-9\-])"), quoted(needle), F.lit(r"(?![a-z0-9\-])")))


# Fixed value: prefix, number and suffix of a name in a series.
SERIAL = r"^(.*?)(\d+)([a-z]*)$"


def serial(normed: Column) -> Column:
    """struct(prefix, number, suffix) of a name that ends in a number and letters; else null."""
    number = F.regexp_extract(normed, SERIAL, 2)
    got = F.struct(
        F.regexp_extract(normed, SERIAL, 1).alias("prefix"), number.try_cast("long").alias("number"), F.regexp_extract(normed, SERIAL, 3).alias("suffix")
    )
    return F.when(F.length(number) > 0, got)


def is_noise(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit("(?i)" + "|".join(NOISE))), F.lit(False))


def is_cross_reference(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(CROSS_REFERENCE)), F.lit(False))


def safe_name(name: Column, default: str = "panel") -> Column:
    """For file names: runs of other characters than letters, digits, _ - . become _; 80 characters at most."""
    short = F.substring(F.regexp_replace(name, r"(?U)[^\w\-.]+", "_"), 1, 80)
    return F.when(F.coalesce(F.length(short), F.lit(0)) > 0, short).otherwise(F.lit(default))


def json_text(reply: Column) -> Column:
    """The JSON in a model's reply, as text: the reply without code fences if it parses, else its first { to its last }; else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parses = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(parses(bare), bare).when(parses(F.nullif(inner, F.lit(""))), inner)


def first_list(json: Column, keys: tuple[str, ...]) -> Column:
    """Strings of the reply itself if it is a list, else of the first of ``keys`` that holds one; null without any."""
    of = lambda path: F.from_json(F.get_json_object(json, path), "array<string>")
    return F.coalesce(F.when(F.trim(json).startswith("["), F.from_json(json, "array<string>")), *[of(f"$.{k}") for k in keys])


def hex_to_bgr(color: Column) -> Column:
    """array(b, g, r) of #rrggbb; null for anything else."""
    digits_ = F.regexp_extract(color, "^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(digits_, i, 2), 16, 10).cast("int")
    return F.when(F.length(digits_) == 6, F.array(part(5), part(3), part(1)))


def elapsed(seconds: Column) -> Column:
    """12.3s, or 2m 5s from a minute on."""
    whole = F.floor(seconds).cast("long")
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
