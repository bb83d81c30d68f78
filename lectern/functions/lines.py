"""Line classifiers: noise, code, OCR noise, labels, inline markup, tables. Profiles: "notebook" and "backend"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import AFTER, BEFORE, LETTER, any_of, at_most, count_of, d_any_of, d_count_of, d_n_words, d_strip, d_words, q, strip

# Patterns, character sets and limits that results depend on.
NOISE = {
    "notebook": (
        r"(?i)^\s*page\s+\d+\s*(of\s+\d+)?\s*$",
        r"^\s*\d+\s*$",
        r"(?i)^(?:©|\(c\)|copyright" + AFTER + ")",
        r"(?i)^\s*(references|bibliography)\s*$",
        r"^https?://\S+",
        r"^\s*\[\d+\]",
        r"^!\[.*?\]\(.*?\)$",
        r"(?i)^quiz\s*:",
        r"^\{\d+\}$",
        r"(?i)^(input|output|legend|infrastructure)(\s+replaced.*|\s+kept.*|\s+storage.*)?$",
    ),
    "backend": (
        r"(?i)^\s*page\s+\d+\s*(of\s+\d+)?\s*$",
        r"^\s*\d+\s*$",
        r"^©.*",
        r"(?i)^\s*(references|bibliography)\s*$",
        r"^https?://\S+",
        r"^\s*\[\d+\]",
        r"(?i)^quiz\s*:",
    ),
}
CODE_CHARS = {"notebook": r"{}();=\[\]", "backend": r"{}();=<>\[\]"}
CODE_SHARE = {"notebook": 0.08, "backend": 0.10}
CAMEL = BEFORE + r"[a-z]+[A-Z][a-zA-Z]+" + AFTER
SNAKE = BEFORE + r"[a-z]+_[a-z]+" + AFTER
OPERATOR = r"\s(==|!=|<=|>=|&&|\|\||:=|->|=>)\s"
CODE_END = r"[;{}]$"
COMMENT = r"^\s*(//|#\s|--|/\*|\*\s)"
CALL = BEFORE + LETTER + r"{2,}\("
CONSTRUCTOR = r"(?i)^(default\s+)?constructor\s+" + LETTER + r"+\s*\("
NUMBERED_CONSTRUCTOR = r"(?i)^\d+\.\s+(default\s+)?constructor\s+" + LETTER + r"+\s*\("
DUNDER = r"^__" + LETTER + r"+__\s*\("
DOTTED = BEFORE + r"[a-z]" + LETTER + r"*\.[a-z]" + LETTER + "*" + AFTER
DINGBATS = "•■-◿✀-➿"
BULLET = rf"^\s*[-*+]\s*(?:[{DINGBATS}]\s*)?|^\s*[{DINGBATS}]\s+"
DINGBAT_LED = rf"^[{DINGBATS}]\s*"
#: Inline markup with every delimiter spelled out, so that no engine needs back references.
INLINE = r"(?s)\*\*(.*?)\*\*|__(.*?)__|\*(.*?)\*|_(.*?)_|`([^`]+)`|~~(.*?)~~|\[([^\]]+)\]\([^)]+\)"
INLINE_ROUNDS = 4
#: What inline markup begins with.
MARK = r"[*_`~\[]"


def noise(t: Column, profile: str = "notebook") -> Column:
    """t: stripped. Blank isn't noise. Patterns hold at the start only, so a URL further on is none."""
    return (t != "") & any_of(t, NOISE[profile])


def code(t: Column, profile: str = "notebook") -> Column:
    """t: stripped. Tests that a line fails cheaply come first."""
    n = count_of(t, CODE_CHARS[profile])
    dense = (F.length(t) > 5) & (n / F.greatest(F.length(t), F.lit(1)) > CODE_SHARE[profile])
    snake, call = t.contains("_") & t.rlike(SNAKE), t.contains("(") & t.rlike(CALL)
    shared = any_of(t, ("^```", COMMENT, CONSTRUCTOR, DUNDER)) | dense | t.rlike(CODE_END) | snake | t.rlike(OPERATOR)
    if profile == "backend":
        return (t != "") & (shared | any_of(t, (NUMBERED_CONSTRUCTOR,)) | t.rlike(CAMEL) | (call & (n >= 2)))
    camel = at_most(t, 5) & t.rlike(CAMEL) & (count_of(t, ",") < 2)
    return (t != "") & (shared | camel | (at_most(t, 8) & call & (n >= 3)) | (at_most(t, 3) & t.rlike(DOTTED)))


def ocr_noise(t: Column) -> Column:
    n = F.greatest(F.length(t), F.lit(1))
    single = at_most(t, 1) & ~at_most(t, 0) & ~t.rlike(r"^\p{L}+$")
    return (F.length(t) < 4) | single | (count_of(t, r"\x{80}-\x{10FFFF}") / n > 0.1) | ((F.length(t) > 5) & (count_of(t, r"\p{L}") / n < 0.4))


def unbulleted(s: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(s, BULLET, ""), "^•+", ""))


def prose_label(s: Column) -> Column:
    """A bullet with words and without code characters, as found in fences that mix labels and code."""
    inner = unbulleted(s)
    return (s.rlike(BULLET) | s.startswith("•")) & (inner != "") & (count_of(inner, CODE_CHARS["notebook"]) == 0)


def strip_inline(c: Column) -> Column:
    """Inline markup replaced by what it shows, INLINE_ROUNDS levels deep. A delimiter pair around nothing vanishes.
    The alternatives are tried only where one can begin, and not at all on text without a mark."""
    shown = c
    for _ in range(INLINE_ROUNDS):
        shown = F.regexp_replace(shown, f"(?s)(?={MARK})(?:{INLINE.removeprefix('(?s)')})", "$1$2$3$4$5$6$7")
    return strip(F.when(c.rlike(MARK), shown).otherwise(c))


def cells(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, r"\|", -1), strip), lambda x: x != "")


def separator_row(row: Column) -> Column:
    return F.forall(row, lambda x: x.rlike("^[-:]+$"))


def header_row(row: Column) -> Column:
    return (F.size(row) > 0) & F.forall(row, lambda x: at_most(x, 3) & ~x.rlike(r"[\p{Nd}()]"))


# The same for DuckDB.


def d_noise(t: str, profile: str = "notebook") -> str:
    return f"({t} <> '' and {d_any_of(t, NOISE[profile])})"


def d_code(t: str, profile: str = "notebook") -> str:
    n, few = d_count_of(t, CODE_CHARS[profile]), d_n_words(t)
    shared = f"starts_with({t}, '```') or (length({t}) > 5 and {n} / greatest(length({t}), 1) > {CODE_SHARE[profile]}) or " + d_any_of(t, (SNAKE, OPERATOR, CODE_END, COMMENT, CONSTRUCTOR, DUNDER))
    if profile == "backend":
        return f"({t} <> '' and ({shared} or {d_any_of(t, (CAMEL, NUMBERED_CONSTRUCTOR))} or (regexp_matches({t}, {q(CALL)}) and {n} >= 2)))"
    return f"({t} <> '' and ({shared} or (regexp_matches({t}, {q(CAMEL)}) and {few} <= 5 and {d_count_of(t, ',')} < 2) or (regexp_matches({t}, {q(CALL)}) and {n} >= 3 and {few} <= 8) or (regexp_matches({t}, {q(DOTTED)}) and {few} <= 3)))"


def d_ocr_noise(t: str) -> str:
    n = f"greatest(length({t}), 1)"
    return f"(length({t}) < 4 or ({d_n_words(t)} = 1 and not regexp_matches({t}, '^\\p{{L}}+$')) or {d_count_of(t, r'\x{80}-\x{10FFFF}')} / {n} > 0.1 or (length({t}) > 5 and {d_count_of(t, r'\p{L}')} / {n} < 0.4))"


def d_unbulleted(s: str) -> str:
    return d_strip(f"regexp_replace(regexp_replace({s}, {q(BULLET)}, ''), '^•+', '')")


def d_prose_label(s: str) -> str:
    inner = d_unbulleted(s)
    return f"((regexp_matches({s}, {q(BULLET)}) or starts_with({s}, '•')) and {inner} <> '' and {d_count_of(inner, CODE_CHARS['notebook'])} = 0)"


def d_strip_inline(x: str) -> str:
    for _ in range(INLINE_ROUNDS):
        x = f"regexp_replace({x}, {q(INLINE)}, '\\1\\2\\3\\4\\5\\6\\7', 'g')"
    return d_strip(x)


def d_cells(s: str) -> str:
    return f"list_filter(list_transform(string_split({s}, '|'), lambda x: {d_strip('x')}), lambda x: x <> '')"


def d_separator_row(row: str) -> str:
    return f"(len(list_filter({row}, lambda x: not regexp_matches(x, '^[-:]+$'))) = 0)"


def d_header_row(row: str) -> str:
    return f"(len({row}) > 0 and len(list_filter({row}, lambda x: len({d_words('x')}) > 3 or regexp_matches(x, '[\\p{{Nd}}()]'))) = 0)"
