"""Text expressions: tokenisers, shingles, markup cleaning, formatting. All are built-in Catalyst functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The one shingle of a text without tokens.
EMPTY = "<empty>"


def _strings(*items: str) -> Column:
    return F.array(*(F.lit(x) for x in items)) if items else F.array().cast("array<string>")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z only: lower() would also turn the Kelvin sign into k."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def index_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and _, lower-cased; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), "")


def unicode_tokens(text: Column) -> Column:
    """Runs of Unicode letters and numbers, lower-cased; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(tokens: Column, k: int = 2) -> Column:
    """Distinct runs of k tokens joined by a space; fewer tokens are one shingle, none are EMPTY."""
    if k < 1:
        raise ValueError("a shingle has one token at least")
    n = F.size(tokens)
    # sequence() counts down if its end is below its start, so the end is held at 0
    starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))
    return F.when(n == 0, _strings(EMPTY)).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


#: Markup patterns and what stands in their place, in the order in which they apply.
MARKUP = (
    (r"<!--[\s\S]*?-->", ""),
    (r"<ref[^>]*>[\s\S]*?</ref>", ""),
    (r"<ref[^/]*/>", ""),
    (r"<gallery>[\s\S]*?</gallery>", ""),
    (r"<[^>]+>", ""),
    *((r"\{\{[\s\S]*?\}\}", ""),) * 5,
    (r"\{[^\{]*\}", ""),
    (r"\[\[Category:([^\]]+)\]\]", "$1"),
    (r"\[\[[^|\]]+\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^|\]]+\|)?([^\]]+)\]\]", "$2"),
    (r"\[https?://[^\s\]]+\s([^\]]+)\]", "$1"),
    (r"={2,}\s*([^=]+)\s*={2,}", "$1"),
    (r"'{2,}([^']+)'{2,}", "$1"),
    (r"^[*#;:]+\s*", ""),
    (r"[\t\n\f\r ]+", " "),
)


def clean_markup(text: Column) -> Column:
    """Wiki and HTML markup taken out, white space made single, ends trimmed; null stays null."""
    for pattern, put in MARKUP:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def is_article(ns: Column, text: Column) -> Column:
    """Main name space, some text, and no redirect (in all capitals or none)."""
    redirect = F.startswith(text, F.lit("#REDIRECT")) | F.startswith(text, F.lit("#redirect"))
    return F.coalesce((ns == 0) & (text != "") & ~redirect, F.lit(False))


def format_bytes(n: Column, digits_gb: int = 1) -> Column:
    """B, KB, MB or GB by powers of 1024."""
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    half_even = lambda x, d: F.bround(x, d)  # noqa: E731  quotients by powers of two are exact, so ties are ties
    return (
        F.when(n >= gb, F.format_string(f"%.{digits_gb}f GB", half_even(n / gb, digits_gb)))
        .when(n >= mb, F.format_string("%.1f MB", half_even(n / mb, 1)))
        .when(n >= kb, F.format_string("%.1f KB", half_even(n / kb, 1)))
        .otherwise(F.format_string("%d B", n.cast("long")))
    )


def format_count(n: Column) -> Column:
    """Thousands set apart by spaces, for numbers of 0 or more."""
    return F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", " ")


def wrap(text: Column, width: int = 80) -> Column:
    """Array of lines of at most `width` bytes where words allow, paragraphs at newlines; empty ones give empty lines."""
    width = width if width > 0 else 80
    words = lambda p: F.array_remove(F.split(p, r"\s+"), "")

    def add(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.octet_length(last) + 1 + F.octet_length(word) <= width
        joined = F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word)))
        return F.when(F.size(lines) == 0, F.array(word)).when(fits, joined).otherwise(F.concat(lines, F.array(word)))

    def lines(p: Column) -> Column:
        found = F.aggregate(words(p), F.array().cast("array<string>"), add)
        return F.when(F.size(words(p)) == 0, _strings("")).otherwise(found)

    return F.flatten(F.transform(F.split(text, "\n"), lines))


def last_comma(line: Column) -> tuple[Column, Column]:
    """What stands before and after the last comma of a line without its line end; both null without a comma."""
    bare = F.regexp_replace(line, "[\r\n]+$", "")
    has = F.instr(bare, ",") > 0
    return F.when(has, F.regexp_extract(bare, r"(?s)^(.*),([^,]*)$", 1)), F.when(has, F.regexp_extract(bare, r"(?s)^(.*),([^,]*)$", 2))
