"""Text expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The punctuation whose double-decoded forms are repaired.
PUNCTUATION = "…‘’“”–—"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, at least 1; null for null."""
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / 4).cast("int"))


def _broken_forms() -> list[tuple[str, str]]:
    pairs: dict[str, str] = {}
    for ch in PUNCTUATION:
        for code in ("latin-1", "cp1252"):
            try:
                pairs[ch.encode().decode(code)] = ch
            except UnicodeDecodeError:
                continue
    return list(pairs.items())


def repair_mojibake(c: Column) -> Column:
    """UTF-8 punctuation that was decoded as a single-byte code, put right."""
    for bad, good in _broken_forms():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def quote_words(c: Column) -> Column:
    """Tokens of letters, digits and apostrophes, lower-cased, without immediate repeats, joined by spaces."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9']+)"), F.lit(1))
    once = F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), w))
    return F.array_join(F.array_compact(once), " ")


def like(c: Column, pattern: str) -> Column:
    """Case-insensitive search; null counts as no match."""
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def only_words_left(c: Column, patterns: Sequence[str], filler: Sequence[str]) -> Column:
    """Whether one of the patterns occurs and only filler words remain without them."""
    rest, hit = c, F.lit(False)
    for p in patterns:
        hit = hit | like(rest, p)
        rest = F.regexp_replace(rest, "(?i)" + p, " ")
    words = F.regexp_extract_all(rest, F.lit("([a-z0-9']+)"), F.lit(1))
    return hit & (F.size(F.array_except(words, F.array(*[F.lit(w) for w in filler]))) == 0)
