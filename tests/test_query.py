import pytest

from gleanery.plans.query import Positions, QuerySyntaxError, Scored, Term, bow, flat_terms, get_query, leaves, parse, simplify


def test_default_operator_and_implied_score():
    q = get_query("apple pie")
    assert q == Scored("SUM", (Scored("SCORE", (Term("apple"),)), Scored("SCORE", (Term("pie"),))))
    assert str(get_query("#NEAR/2(apple pie)")) == "#SCORE(#NEAR/2(apple.body pie.body ) )"


@pytest.mark.parametrize(
    "text",
    ["#SUM(a.nofield)", "#SUM(0.5 apple)", "#FOO(apple)", "#NEAR/x(a b)", "#AND(apple", "apple", "#SUM(apple) pie", "#NEAR/2(apple #AND(pie tart))",
     "#SCORE(apple pie)", "#NEAR/2(apple.title pie.body)", "#WSUM(apple 0.5)", "#WSUM(0.5 apple 0.5)", "#SUM((apple))", "#SCORE(#SUM(apple))"],
)
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_operators_are_case_insensitive_and_fields_lowered():
    assert parse("#near/3(apple.TITLE pie.title)") == Positions("NEAR", (Term("apple", "title"), Term("pie", "title")), 3)
    assert parse("#Window/3/9(apple pie)").distance == 3


def test_stopwords_vanish_with_their_weight_and_empty_queries_are_none():
    assert get_query("the of and") is None
    assert get_query("#AND(with)") is None
    q = get_query("#WSUM(0.5 the 0.3 apple 0.2 pie)")
    assert q.weights == (0.3, 0.2)
    assert get_query("#WSUM(0.7 #SYN(the of) 0.3 apple 0.4 pie)").weights == (0.3, 0.4)


def test_single_arguments_collapse_but_score_stays():
    assert simplify(parse("#AND(#AND(apple))")) == Scored("SCORE", (Term("apple"),))
    assert simplify(parse("#SUM(#SYN(apple))")) == Scored("SCORE", (Term("apple"),))


def test_duplicates_become_weights_only_for_equal_nodes():
    q = get_query("apple apple pie")
    assert q.op == "WSUM" and q.weights == (2.0, 1.0)
    assert get_query("apple apple") == Scored("SCORE", (Term("apple"),))
    assert get_query("#near/1(apple pie) #near/5(apple pie)").op == "SUM"


def test_one_token_may_give_several_terms_with_the_same_weight():
    q = get_query("#WSUM(0.5 near-death 0.5 pie)")
    assert q.weights == (0.5, 0.5, 0.5) and [t.term for t in leaves(q)] == ["near", "death", "pie"]


def test_flat_terms():
    assert flat_terms(get_query("apple apple pie.title")) == [("body", "apple", 2 / 3), ("title", "pie", 1 / 3)]
    assert flat_terms(get_query("#NEAR/1(apple pie)")) is None
    assert flat_terms(get_query("#WSUM(0.5 #SUM(apple pie) 1.5 #WSUM(3 tart 1 pie))")) == [("body", "apple", 0.25), ("body", "pie", 0.25), ("body", "tart", 0.5625), ("body", "pie", 0.1875)]
    assert flat_terms(get_query("the")) == []


def test_bow():
    assert bow("a b") == "a b"
    assert bow("#wsum(0.5 a 0.5 b)") == "a b"
    assert bow("#SUM( a b )") == "a b"
    for bad in ("#and(a b)", "#SUM(#SUM(a))", "(a)"):
        with pytest.raises(QuerySyntaxError):
            bow(bad)
