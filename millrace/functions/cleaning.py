"""Text cleaning rules and the minimum-length filter.

The rewrites follow Unicode-aware regular expression semantics: a blank is any
of 29 code points and a digit or letter is any Unicode one. Java's own ``\\s``,
``\\d``, ``\\w`` and ``.`` are narrower, so the classes are spelled out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.binding import computed_once

# The code points that count as blank.
BLANKS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# What the web rules remove, in order of application.
WEB_REMOVALS = (
    r"https?://[a-zA-Z0-9./?=&_-]+",
    r"s3://commoncrawl/crawl-data/[^\n]*\n?",
    r"CC-MAIN-\p{Nd}{4}-\p{Nd}{2}",
    r"<urn:uuid:[a-f0-9-]+>",
)

# The math rules. The first sees raw text; the others run after
# blanks are collapsed, when U+0020 is the only blank left.
MATH_URL = rf"https?://[^{BLANKS}]+"
MATH_HOST = r"www\.[^ ]+\.[\p{L}\p{N}_]+"
MATH_PUNCTUATION = r" ([.,;:!?])"
MATH_FILE = r"[a-zA-Z0-9_\-\.]+\.(?:pdf|cgi)"
MATH_EMPTY_BRACKETS = r"\( *\)"
MATH_SHORT_BRACKETS = r"\( *[^\n] *\)"

# Same result as replacing every run of blanks by one U+0020. A lone U+0020
# before printable ASCII (nearly every blank there is) is already right and is
# skipped, and printable ASCII leaves the match after one range test.
_BLANK_RUN = rf"(?! [!-~])[^!-~](?<=[{BLANKS}])[{BLANKS}]*+"

# A file name can only start where a run of its characters starts.
_FILE_AT_RUN_START = r"(?<![a-zA-Z0-9_\-\.])" + MATH_FILE


def _remove(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, _BLANK_RUN, " ")


def web_clean(text: Column) -> Column:
    """Drop URLs, crawl paths, crawl ids and UUIDs; collapse blanks; strip."""
    out = F.coalesce(text, F.lit(""))
    for pattern in WEB_REMOVALS:
        out = _remove(out, pattern)
    return F.trim(_collapse_blanks(out))


def math_clean(text: Column) -> Column:
    """Drop URLs, host names, file names and (nearly) empty brackets, close up
    punctuation, collapse blanks, strip. The order of the rules matters."""
    out = _remove(F.coalesce(text, F.lit("")), MATH_URL)
    out = _remove(_collapse_blanks(out), MATH_HOST)
    out = F.regexp_replace(out, MATH_PUNCTUATION, "$1")
    out = _remove(out, _FILE_AT_RUN_START)
    out = _remove(_remove(out, MATH_EMPTY_BRACKETS), MATH_SHORT_BRACKETS)
    return F.trim(F.regexp_replace(out, r" {2,}", " "))


def word_count(cleaned: Column) -> Column:
    """Words of a cleaned text, whose only separator is one U+0020."""
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, " ")))


CLEANERS: dict[str, Callable[[Column], Column]] = {"web": web_clean, "math": math_clean}


def clean_and_keep(
    df: DataFrame,
    cleaner: Callable[[Column], Column],
    min_words_exclusive: int = 10,
    text: str = "text",
) -> DataFrame:
    """Replace ``text`` by its cleaned form and keep texts of more than
    ``min_words_exclusive`` words.

    The rewrite chain runs once although the filter reads its result. The
    length test in front is implied by the word count (n+1 words need 2n+1
    characters and no rule lengthens a text) and spares the rewrites on rows
    that cannot pass.
    """
    others = [c for c in df.columns if c != text]
    cleaned = df.filter(F.length(text) > 2 * min_words_exclusive).select(
        *others, computed_once(cleaner(F.col(text))).alias(text)
    )
    long_enough = word_count(F.col(text)) > max(min_words_exclusive, 0)
    return cleaned.filter(long_enough).select(*df.columns)
