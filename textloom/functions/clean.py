"""Text cleaning as Column functions; all but NFKC stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns, keywords and replacements that define the cleaning results.
URL = r"https?://\S+|www\.\S+"
TAG = r"<[^>]+>"
NON_WORD = r"[^a-z0-9'\s]"
MARKDOWN_LINK = r"\[([^\]]+)\]\((https?://[^)]+)\)"
HASHTAG = r"#\w+"
SLASH_MENTION = r"(?i)(?:^|\s)[/\\]?(?:u|r)[/\\][a-z0-9_-]+"
MENTION = r"[@#]\w+"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
#: White space of any script, as a class; cheaper than the Unicode flag.
SPACE = r"\s\x{1C}-\x{1F}\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"
LINE_KEYWORDS = ["proof", "ask me anything", "ask us anything", "learn more", "look up the options", "all wrapped up", "here's who will be answering"]
LINE_STARTS = ["**about ", "about ", "**edit", "edit:", "update:"]
SENTENCE_PHRASES = ["ask me anything", "ask us anything", "proof", "learn more", "look up the options", "all wrapped up", "here s who will be answering", "we are the team behind", "questions today between"]
MOJIBAKE = [
    ("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¦", "..."), ("Â", ""),
    ("Ã¢â‚¬â„¢", "'"), ("Ã¢â‚¬Ëœ", "'"), ("Ã¢â‚¬Å“", '"'), ("Ã¢â‚¬Â\x9d", '"'), ("Ã¢â‚¬â€œ", "-"), ("Ã¢â‚¬â€\x9d", "-"), ("Ã¢â‚¬Â¦", "..."), ("Ã‚", ""),
]


def safe_text(c: Column) -> Column:
    """Null becomes the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Removes leading and trailing white space of any script."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def let(value: Column, body) -> Column:
    """Binds value once in body, so that a lambda doesn't evaluate it for each use."""
    return F.transform(F.array(value), body)[0]


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def _literal(s: str) -> str:
    return "".join(f"\\{x}" if x in "*.:'()[]" and x != "'" else x for x in s)


def _spaced(p: str) -> str:
    return p.replace(r"\S", f"[^{SPACE}]").replace(r"|\s)", f"|[{SPACE}])")


#: All characters but letters, digits and the apostrophe, or letters and the apostrophe, as
#: plain ranges: a negated class of three parts matches ten times slower in the JVM.
NOT_WORD = r"[\x00-&(-/:-`{-\x{10FFFF}]+"
NOT_LETTER = r"[\x00-&(-`{-\x{10FFFF}]+"


def _only(c: Column, others: str) -> Column:
    """Runs of other characters, white space among them, become one space; trimmed."""
    return F.trim(F.regexp_replace(c, others, " "))


def basic_clean(c: Column) -> Column:
    """Lower case; URLs, tags and non-word characters become spaces; spaces squeezed."""
    t = F.lower(safe_text(c))
    for p in (URL, TAG):
        t = F.regexp_replace(t, _spaced(p), " ")
    return _only(t, NOT_WORD)


def serving_clean(c: Column) -> Column:
    """As basic_clean, but tags are not removed as a whole."""
    return _only(F.regexp_replace(F.lower(safe_text(c)), _spaced(URL), " "), NOT_WORD)


def _where(c: Column, marks: list[str], body) -> Column:
    """body(c) for texts that hold one of the marks; others pass without its work."""
    return let(c, lambda t: F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks]), body(t)).otherwise(t))


def repair_mojibake(c: Column) -> Column:
    """Literal replacements, in order."""

    def repaired(t: Column) -> Column:
        for bad, good in MOJIBAKE:
            t = F.replace(t, F.lit(bad), F.lit(good))
        return t

    return _where(c, ["â€", "Â", "Ã"], repaired)  # every bad text has one of these


def strip_boilerplate_lines(c: Column) -> Column:
    """Drops blank lines and lines with a boilerplate keyword or start."""

    starts = "|".join(map(_literal, LINE_STARTS))
    bad = "|".join(map(_literal, LINE_KEYWORDS)) + rf"|^[{SPACE}]*(?:{starts})"

    def stays(line: Column) -> Column:
        return line.rlike(f"[^{SPACE}]") & ~F.lower(line).rlike(bad)

    return F.array_join(F.filter(F.split(safe_text(c), LINE_BREAK, -1), stays), "\n")


def drop_boilerplate_sentences(c: Column) -> Column:
    """Drops sentences with a boilerplate phrase; a result of under 12 words gives the text back."""
    text = safe_text(c)

    phrase = "|".join(map(_literal, SENTENCE_PHRASES))

    def stays(s: Column) -> Column:
        return let(F.lower(s), lambda low: (low != "") & ~(F.startswith(low, F.lit("about ")) & F.contains(F.substring(low, 1, 120), F.lit(":"))) & ~low.rlike(phrase))

    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+", -1), strip)
    out = squeeze(F.array_join(F.filter(parts, stays), " "))
    return let(out, lambda o: F.when(F.size(F.filter(F.split(o, " ", -1), lambda w: w != "")) < 12, text).otherwise(o))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; ASCII texts pass through untouched."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def full_clean(c: Column, normalise: bool = True) -> Column:
    """The whole cleaning chain, in its fixed order; normalise=False leaves NFKC out."""
    t = strip_boilerplate_lines(c)
    t = repair_mojibake(nfkc(t) if normalise else t)
    t = _where(t, ["](http"], lambda x: F.regexp_replace(x, MARKDOWN_LINK, "$1"))
    t = F.lower(F.regexp_replace(t, rf"[*{EMOJI[1:]}", " "))  # runs of asterisks, then of emoji
    for p in (URL, TAG):
        t = F.regexp_replace(t, _spaced(p), " ")
    t = _where(t, ["#"], lambda x: F.regexp_replace(x, "(?U)" + HASHTAG, " "))
    t = _where(t, ["u/", "r/", "u\\", "r\\"], lambda x: F.regexp_replace(x, _spaced(SLASH_MENTION), " "))
    t = _where(t, ["@", "#"], lambda x: F.regexp_replace(x, "(?U)" + MENTION, " "))
    return _only(t, NOT_LETTER)  # digits go with the other characters
