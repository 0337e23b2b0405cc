import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T


def value(spark, s, f):
    return spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (T.collapse_whitespace, " a \t\n b c ", "a b c"),
        (lambda c: T.truncate_words(c, 2), " a  b c", "a b"),
        (T.postprocess_answer, 'Answer: The answer is  "Paris" (insufficient context)', "Paris"),
        (T.postprocess_answer, None, ""),
        (T.short_span, "Red gold is an alloy. It contains copper.", "Red gold is an alloy"),
        (T.clean_candidate, "the copper and tin of. more", "copper and tin"),
        (T.clean_candidate, "the of", ""),
        (T.strip_any_suffix, "#SUM(a.title b.body)", "#SUM(a b)"),
        (T.strip_any_suffix, "a.title", "a.title"),
        (T.strip_field_suffix, "apple.title u.s.a x.body", "apple u.s.a x"),
        (T.plain_query, "#WSUM( 0.5 apple.title 0.5 #NEAR/3(pie crust) )", "apple pie crust"),
        (T.plain_query, "plain words 3", "plain words 3"),
        (T.escape_response, 'a "b"  \\c', 'a \\"b\\" \\\\c'),
        (T.safe_double, "x1", None),
        (T.safe_double, "1.5", 1.5),
        (T.needs_fallback, " Exception:: no", True),
        (T.needs_fallback, None, True),
        (T.needs_fallback, "Paris", False),
        (T.stem_s, "queries", "query"),
        (T.stem_s, "boxes", "boxe"),
        (T.stem_s, "cats", "cat"),
        (T.stem_s, "glass", "glass"),
        (T.valid_expansion_term, "café", False),
        (T.valid_expansion_term, "a.b", False),
        (T.valid_expansion_term, "cafe", True),
    ],
)
def test_functions(spark, f, given, expected):
    assert value(spark, given, f) == expected


def test_fallback_answers(spark):
    rows = [("What is it powered by?", "The boat is powered by the steam engine of Watt. More.", "", "steam engine of Watt"), ("Other?", "One two. Three.", None, "One two"), ("Other?", "One two.", "kept", "kept"), ("Other?", "", "", "")]
    df = spark.createDataFrame(rows, "q string, c string, a string, e string")
    for r in df.select("e", T.fallback_answer(F.col("a"), F.col("q"), F.col("c")).alias("x")).collect():
        assert r.x == r.e


def test_analyzer_agrees_with_itself(spark):
    a = T.Analyzer(stemmer="s")
    s = "The Cats' queries of a glass, and DOGS 42"
    assert value(spark, s, a.terms) == a.analyse(s) == ["cat", "query", "glass", "dog", "42"]
    with pytest.raises(ValueError):
        T.Analyzer(stemmer="k")


def test_parameters():
    assert T.coerce_numbers({"a": "1", "b": ["0.5", "x"]}) == {"a": 1, "b": [0.5, "x"]}
    for bad in (True, None):
        with pytest.raises(ValueError):
            T.coerce_numbers({"a": bad})
    assert T.lower_keys({"A": [{"B": 1}]}) == {"a": [{"b": 1}]}
