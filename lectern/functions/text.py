"""Text primitives with the white space of Unicode, for Spark columns and as DuckDB expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as characters: both regular-expression engines take them literally in a class.
WS = "".join(chr(c) for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: The same as a class's inside for Spark: single characters of Latin-1, which its engine looks up at once, and a category.
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\p{Z}"
#: Line ends: CR LF is one.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
LETTER = r"[\p{L}\p{N}_]"
#: Boundaries of words over Unicode letters, spelled out because engines differ on \b; they take a character.
BEFORE, AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def ascii_upper(c: Column) -> Column:
    """A-Z for a-z alone: engines differ on letters whose upper case is longer."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def first_word(c: Column) -> Column:
    """Empty where there is none."""
    return F.regexp_extract(c, f"^[{SPACE}]*([^{SPACE}]+)", 1)


def at_most(c: Column, n: int) -> Column:
    """Whether c has n words at most; it reads no further than the one after them."""
    return c.rlike(f"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]*+){{0,{n}}}+$")


def count_of(c: Column, klass: str) -> Column:
    """How many characters of c are in the class."""
    return F.length(F.regexp_replace(c, f"[^{klass}]+", ""))


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether c holds any of the patterns: one alternation, so one call in generated code. Where all are for the start
    (none has alternatives outside a group), the alternation is tried there alone, not at each character."""
    split = [("(?i:", p[4:]) if p.startswith("(?i)") else ("(?:", p) for p in patterns]
    if all(p.startswith("^") for _, p in split):
        return c.rlike("^(?:" + "|".join(f"{head}{p[1:]})" for head, p in split) + ")")
    return c.rlike("|".join(f"{head}{p})" for head, p in split))


# The same for DuckDB, as strings.


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def d_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(f'[{WS}]+')}), lambda w: w <> '')"


def d_n_words(x: str) -> str:
    return f"cast(len({d_words(x)}) as bigint)"


def d_count_of(x: str, klass: str) -> str:
    return f"length(regexp_replace({x}, {q(f'[^{klass}]')}, '', 'g'))"


def d_any_of(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, {q(p)})" for p in patterns) + ")"
