"""Column functions for text fields and JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) makes \s match all Unicode white space; \x1c-\x1f are separators which
# the clients' strip() removes too.
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
# Characters printed as escapes, and how much longer the escape is.
_UNSEEN = r"\p{Cf}\p{Zs}\p{Zl}\p{Zp}\p{Co}\p{Cn}"
HIDDEN = (
    (r"[\x7f-\xa0\xad]", 3),
    (rf"[{_UNSEEN}&&[\x{{100}}-\x{{ffff}}]]", 5),
    (rf"[{_UNSEEN}&&[\x{{10000}}-\x{{10ffff}}]]", 9),
)
# JSON escapes of characters beyond U+FFFF, and of those that have no sign.
PAIR = r"(?i)\\ud[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2}"
UNSEEN_PAIR = r"(?i)\\ud(?:8[c-f]|9[0-9a-f]|a[0-9a-f]|b[0-9a-f])[0-9a-f]\\ud[c-f][0-9a-f]{2}"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any Unicode kind."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def blank(text: Column) -> Column:
    """True where a text has nothing but white space."""
    return ~text.rlike(NOT_SPACE)


def too_long(text: Column, limit: int) -> Column:
    """True where the text has more than ``limit`` characters; NULL counts as short."""
    return F.coalesce(F.length(text) > limit, F.lit(False))


def outside(value: Column, domain: tuple[str, ...]) -> Column:
    """True where a present value is not in a closed domain (case-sensitive)."""
    return F.coalesce(~value.isin(*domain), F.lit(False))


def too_large_printed(json_text: Column, limit: int) -> Column:
    """True where compact JSON, in a dictionary's printed form, is too long.

    That form has a space after each ``,`` and ``:``, prints an escaped double quote as
    one character, a control character as four, and characters that can't be shown
    (``HIDDEN``) as their escapes. No character is printed as more than ten, so texts of a
    tenth of the limit need no look at their characters.
    """
    # Literal replacements first, so that the one pattern left is a plain
    # character class: alternatives in a loop overflow the stack on long texts.
    unescaped = F.replace(json_text, F.lit("\\\\"), F.lit(""))
    unquoted = F.replace(unescaped, F.lit('\\"'), F.lit(""))
    escaped_quotes = (F.length(unescaped) - F.length(unquoted)) / 2
    bare = F.regexp_replace(unquoted, '"[^"]*"', "")
    separators = F.length(bare) - F.length(F.translate(bare, ",:", ""))
    # \\u0001 is printed as \\x01, and a pair of surrogates as its character or as ten.
    pairs = F.regexp_count(unescaped, F.lit(PAIR))
    unseen_pairs = F.regexp_count(unescaped, F.lit(UNSEEN_PAIR))
    units = F.length(unescaped) - F.length(F.replace(unescaped, F.lit("\\u"), F.lit("u")))
    shorter = 2 * (units - 2 * pairs) + 11 * (pairs - unseen_pairs) + 2 * unseen_pairs
    escapes = sum((F.regexp_count(json_text, F.lit(c)) * more for c, more in HIDDEN), F.lit(0))
    printed = F.length(json_text) + separators - escaped_quotes.cast("int") - shorter + escapes
    return F.when(F.length(json_text) * 10 <= limit, F.lit(False)).otherwise(F.coalesce(printed > limit, F.lit(False)))


def string_map(json_text: Column) -> Column:
    """A JSON object as map<string,string>; NULL where the text is no object."""
    return F.from_json(json_text, "map<string,string>")


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def collated(text: Column, collation: str | None) -> Column:
    """Compare and group under a named collation; None keeps binary order."""
    return F.collate(text, collation) if collation else text


def record_id(*coordinates: str) -> Column:
    """An id which stays the same on replay: hash of where the record came from."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in coordinates]), 256)
