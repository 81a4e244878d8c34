"""Text normalisers, hashes and dates as column expressions. Letters are meant as Unicode has them, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Month names in order.
MONTHS = "january february march april may june july august september october november december".split()
#: Relations whose object is a date; fixed values.
DATE_RELATIONS = ["date of birth", "date of death", "publication date", "inception"]


def words(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits, in order; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spaced(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm_name(name: Column) -> Column:
    """Lower case, without one trailing parenthesis, all but letters, digits and underscores as blanks."""
    return spaced(F.regexp_replace(F.regexp_replace(F.lower(name), r"\s*\([^)]*\)\s*$", ""), r"[^\p{L}\p{N}_\s]", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words between blanks, punctuation read as blanks; empty for a text without words."""
    return F.filter(F.split(spaced(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")), " "), lambda t: t != "")


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and the articles a, an, the, blanks collapsed. Two passes take articles that share a blank."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    for _ in range(2):
        bare = F.regexp_replace(bare, r"(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)", "$1 $3")
    return spaced(bare)


def parse_answer(raw: Column) -> Column:
    """The first line that is not blank, without an answer label, quotes, stars and a full stop at the end; empty if there is none."""
    line = F.trim(F.regexp_extract(raw, r"^\s*([^\n\r]*)", 1))
    line = F.trim(F.regexp_replace(line, r"(?i)^(final\s+)?answer\s*:\s*", ""))
    line = F.regexp_replace(F.regexp_replace(line, r'^"+|"+$', ""), r"^\*+|\*+$", "")
    return F.trim(F.regexp_replace(line, r"\.+$", ""))


def spacing_key(text: Column) -> Column:
    """The text without blanks around punctuation: spellings that differ only there are equal."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s*([^\p{L}\p{N}_\s])\s*", "$1"))


def strip_disambiguator(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, r"\s*\([^)]*\)$", "")))


def has_disambiguator(title: Column) -> Column:
    return F.trim(title).rlike(r"\([^)]*\)$")


def cased_answer(value: Column, text: Column) -> Column:
    """value as text has it, whatever its case; null if it isn't there."""
    at = F.locate_expr(value, text) if hasattr(F, "locate_expr") else F.instr(F.lower(text), F.lower(value))
    return F.when(at > 0, F.substring(text, at, F.length(value)))


def short_hash(prefix: str, key: Column, digits: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(key), 1, digits))


def hash_percent(key: Column) -> Column:
    """SHA-1 of key, read as one number, modulo 100."""
    digit = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    return F.aggregate(F.split(F.sha1(key), ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * 16 + digit(c)) % 100))


def hash_order(seed: str, key: Column) -> Column:
    """A place in a seeded order: the first eight hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("bigint")


def parse_date(text: Column) -> Column:
    """struct(year, month, day), parts that a free text lacks null; null without a year of three or four digits. A day counts only with a month."""
    t = F.translate(F.lower(text), ",", " ")
    year = F.regexp_extract(t, r"(?:^|[^0-9a-z_])([0-9]{3,4})(?:[^0-9a-z_]|$)", 1)
    month = F.coalesce(*(F.when(t.rlike(rf"(^|[^0-9a-z_]){m}([^0-9a-z_]|$)"), i) for i, m in enumerate(MONTHS, 1)))
    day = F.regexp_extract(t, r"(?:^|[^0-9a-z_])([0-9]{1,2})(?:[^0-9a-z_]|$)", 1)
    parts = F.struct(year.cast("int").alias("year"), month.alias("month"), F.when(month.isNotNull() & (day != ""), day.cast("int")).alias("day"))
    return F.when(year != "", parts)


def dates_match(a: Column, b: Column) -> Column:
    """Both are dates of one year, and month and day agree where both have them."""
    same = lambda p: a[p].isNull() | b[p].isNull() | (a[p] == b[p])
    return F.coalesce((a["year"] == b["year"]) & same("month") & same("day"), F.lit(False))


def snippet(text: Column, n: int) -> Column:
    w = F.split(spaced(text), " ")
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, " ...").otherwise(""))


def token_count(text: Column) -> Column:
    """The offline counter of budgets: runs of letters and digits, and single other signs."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))
