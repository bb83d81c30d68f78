"""Phrase rules: validity, labels, cleaning, parentheses, synonyms; and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, WS, at_most, d_any_of, d_n_words, d_strip, d_words, first_word, n_words, q, strip

# Word lists and patterns.
GENERIC = (
    "the", "this", "that", "these", "those", "some", "any", "each", "other", "another", "same", "such", "both", "all",
    "one", "two", "three", "four", "first", "second", "third", "use", "used", "using", "make", "made", "get", "given",
    "certain", "following", "above", "below", "per", "based", "etc", "e.g", "i.e", "note", "example", "part", "case",
    "way", "ways", "form", "time", "times", "place", "thing", "things", "item", "items", "value", "values", "number",
    "numbers", "order", "fact", "result", "results", "amount", "level", "type", "types", "kind", "kinds", "used to",
)
LABEL_STARTERS = ("to", "any", "how", "what", "when", "where", "why", "see", "let", "note", "given", "recall", "consider")
POINTERS = ("this", "that", "these", "those", "its", "their")
TOC_HEADINGS = (
    "summary", "contents", "outline", "overview", "agenda", "topics", "table of contents", "learning objectives", "objectives",
    "what we will cover", "plan", "schedule", "recap", "review", "today", "this week", "this lecture",
)
SECTION_WORDS = r"(?i)^(summary|overview|introduction|conclusion)[" + WS + "]+"
EDGES = r" .,;:\-/\\"
STARTS = "^(" + "|".join(LABEL_STARTERS) + ") "
NUMBERS = r"^[\d\s.,\-]+$"
PARENS = r"\s*\(.*?\)"
#: Stop words of the offline candidate splitter, chosen for this engine.
STOP_WORDS = tuple("a an and are as at be by for from has have in is it its of on or that the this to was were will with which".split())


def slide_label(p: Column) -> Column:
    """p: stripped lower case."""
    return p.rlike(STARTS) & ~at_most(p, 3)


def structural_label(p: Column) -> Column:
    return slide_label(p) | (first_word(p).endswith("ing") & ~at_most(p, 2))


def valid(p: Column) -> Column:
    """p: stripped lower case. Not short, generic, a label, a pointer's phrase or numbers."""
    return (F.length(p) >= 3) & ~p.isin(*GENERIC) & ~slide_label(p) & ~first_word(p).isin(*POINTERS) & ~p.rlike(NUMBERS)


def clean(p: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(p, r"\{\d+\}", ""), r"(^|[^\p{L}\p{N}_])\d+/\d+(?=$|[^\p{L}\p{N}_])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, SECTION_WORDS, ""), f"^[{EDGES}]+|[{EDGES}]+$", "")
    return F.when(p.contains("```"), F.lit("")).otherwise(strip(out))


def without_parens(p: Column) -> Column:
    return strip(F.regexp_replace(p, PARENS, ""))


def without_calls(p: Column) -> Column:
    return strip(F.replace(p, F.lit("()"), F.lit("")))


def anchors(p: Column) -> Column:
    """The phrase and its forms without parentheses, of two characters at least."""
    more = F.filter(F.array(without_parens(p), without_calls(p)), lambda x: F.length(x) >= 2)
    return F.array_distinct(F.concat(F.array(p), more))


#: The type of forms().
FORMS = "struct<p:string,short:string,initials:string,n:bigint,first:string>"


def forms(p: Column) -> Column:
    """What alike() compares, made once a phrase: it, its letters where they may be an acronym, its initials, its number
    of words and the first."""
    letters = F.regexp_replace(p, "[^a-z]+", "")
    initials = F.regexp_replace(F.regexp_replace(p, f"[^a-z{SPACE}]+", ""), f"(?<=[a-z])[a-z]+|[{SPACE}]+", "")
    short = F.when(F.length(letters).between(2, 6), letters).otherwise(F.lit("-"))
    return F.struct(p.alias("p"), short.alias("short"), initials.alias("initials"), n_words(p).alias("n"), first_word(p).alias("first"))


def alike(a: Column, b: Column) -> Column:
    """a, b: forms() of stripped lower case. Equal, acronym and expansion, or a phrase of up to five words inside the
    other, up to a word's end."""
    inside = F.when(F.length(a["p"]) <= F.length(b["p"]), _inside(a, b)).otherwise(_inside(b, a))
    return (a["p"] == b["p"]) | (a["short"] == b["initials"]) | (b["short"] == a["initials"]) | inside


def _inside(shorter: Column, longer: Column) -> Column:
    at = F.instr(longer["p"], shorter["p"])
    after = F.substr(longer["p"], at + F.length(shorter["p"]), F.lit(1))
    return F.startswith(longer["p"], shorter["first"]) & shorter["n"].between(1, 5) & (at > 0) & after.isin("", " ")


def synonyms(a: Column, b: Column) -> Column:
    """alike() of two phrases."""
    return alike(forms(a), forms(b))


# The same for DuckDB.


def _list(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(q, names)) + ")"


def d_slide_label(p: str) -> str:
    return f"({d_any_of(p, (STARTS,))} and {d_n_words(p)} >= 4)"


def d_structural_label(p: str) -> str:
    return f"({d_slide_label(p)} or (coalesce(({d_words(p)})[1], '') like '%ing' and {d_n_words(p)} >= 3))"


def d_valid(p: str) -> str:
    return f"(length({p}) >= 3 and {p} not in {_list(GENERIC)} and not {d_slide_label(p)} and coalesce(({d_words(p)})[1], '') not in {_list(POINTERS)} and not regexp_matches({p}, {q(NUMBERS)}))"


def d_clean(p: str) -> str:
    out = f"regexp_replace(regexp_replace({p}, '\\{{\\d+\\}}', '', 'g'), '\\b\\d+/\\d+\\b', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, {q(SECTION_WORDS)}, ''), {q(f'^[{EDGES}]+|[{EDGES}]+$')}, '', 'g')"
    return f"case when contains({p}, '```') then '' else {d_strip(out)} end"


def d_without_parens(p: str) -> str:
    return d_strip(f"regexp_replace({p}, {q(PARENS)}, '', 'g')")


def d_without_calls(p: str) -> str:
    return d_strip(f"replace({p}, '()', '')")


def d_synonyms(a: str, b: str) -> str:
    short, long = f"(case when length({a}) <= length({b}) then {a} else {b} end)", f"(case when length({a}) <= length({b}) then {b} else {a} end)"

    def acronym(s: str, t: str) -> str:
        letters = f"regexp_replace({s}, '[^a-z]', '', 'g')"
        stripped = f"regexp_replace({t}, {q(f'[^a-z{WS}]')}, '', 'g')"
        initials = f"coalesce(array_to_string(list_transform({d_words(stripped)}, lambda w: w[1]), ''), '')"
        return f"(length({letters}) between 2 and 6 and {letters} = {initials})"

    at = f"instr({long}, {short})"
    inside = f"(len({d_words(short)}) between 1 and 5 and {at} > 0 and substr({long}, {at} + length({short}), 1) in ('', ' ') and starts_with({long}, coalesce(({d_words(short)})[1], '')))"
    return f"({a} = {b} or {acronym(a, b)} or {acronym(b, a)} or {inside})"
