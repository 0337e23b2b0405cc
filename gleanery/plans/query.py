"""The structured query language: tree, parser and simplification rules. Nothing here needs Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from gleanery.functions.text import FIELDS, Analyzer


class QuerySyntaxError(ValueError):
    def __init__(self, what: str):
        super().__init__(f"Query syntax error: {what}")


@dataclass(frozen=True)
class Term:
    term: str
    field: str = "body"

    def __str__(self) -> str:
        return f"{self.term}.{self.field}"


@dataclass(frozen=True)
class Positions:
    """SYN, NEAR or WINDOW over terms and other positional nodes of one field."""

    op: str
    args: tuple
    distance: int = 0

    @property
    def field(self) -> str:
        return self.args[0].field

    def __str__(self) -> str:
        name = f"#{self.op}" + (f"/{self.distance}" if self.op != "SYN" else "")
        return f"{name}({''.join(f'{a} ' for a in self.args)})"


@dataclass(frozen=True)
class Scored:
    """AND, OR, SUM, WSUM (with a weight for each argument) or SCORE (of one positional node)."""

    op: str
    args: tuple
    weights: tuple[float, ...] = ()

    def __str__(self) -> str:
        parts = [f"{w:g} {a} " for w, a in zip(self.weights, self.args)] if self.op == "WSUM" else [f"{a} " for a in self.args]
        return f"#{self.op}({''.join(parts)})"


Positional = (Term, Positions)
SCORED_OPS, DISTANCE_OPS = ("AND", "OR", "SUM", "WSUM", "SCORE"), ("NEAR", "WINDOW")
LEXEME = re.compile(r"[()]|[^\s()]+")


def create_terms(token: str, analyzer: Analyzer) -> list[Term]:
    """`text[.field]`; the field is checked before analysis, which may give none or several terms."""
    text, dot, name = token.partition(".")
    name = name.lower() if dot else "body"
    if name not in FIELDS:
        raise QuerySyntaxError(f"unknown field in {token}")
    return [Term(t, name) for t in analyzer.analyse(text)]


def _operator(name: str) -> tuple[str, int]:
    op, slash, rest = name[1:].upper().partition("/")
    if slash:
        try:
            distance = int(rest.split("/")[0])
        except ValueError:
            raise QuerySyntaxError(f"invalid distance in {name}") from None
        if op in DISTANCE_OPS:
            return op, distance
    elif op in SCORED_OPS or op == "SYN":
        return op, 0
    raise QuerySyntaxError(f"unknown operator {name}")


def _build(op: str, distance: int, args: list, weights: list[float]):
    if op in DISTANCE_OPS or op == "SYN":
        if any(isinstance(a, Scored) for a in args):
            raise QuerySyntaxError(f"#{op} takes terms and positional operators only")
        if len({a.field for a in args if a is not None}) > 1:
            raise QuerySyntaxError(f"arguments of #{op} must be in one field")
        return Positions(op, tuple(args), distance)
    if op == "SCORE":
        if len(args) > 1 or any(isinstance(a, Scored) for a in args):
            raise QuerySyntaxError("#SCORE takes one positional argument")
        return Scored(op, tuple(args))
    return Scored(op, tuple(a if isinstance(a, Scored) else Scored("SCORE", (a,)) for a in args), tuple(weights))


class _Empty:
    """A positional operator without arguments left; its field no longer matters."""


def parse(text: str, analyzer: Analyzer | None = None):
    """The exact tree of a query that is one operator with its arguments."""
    analyzer = analyzer or Analyzer()
    text = text.strip()
    if "(" not in text or text.count("(") != text.count(")") or not text.startswith("#"):
        raise QuerySyntaxError(f"unbalanced or missing parentheses: {text}")
    lexemes, at = LEXEME.findall(text), 0

    def operator(depth: int):
        nonlocal at
        op, distance = _operator(lexemes[at])
        at += 1
        if at >= len(lexemes) or lexemes[at] != "(":
            raise QuerySyntaxError(f"missing ( after #{op}")
        at += 1
        args, weights = [], []
        while True:
            if at >= len(lexemes):
                raise QuerySyntaxError("unbalanced or missing parentheses")
            if lexemes[at] == ")":
                at += 1
                break
            weight = 1.0
            if op == "WSUM":
                try:
                    weight = float(lexemes[at])
                except ValueError:
                    raise QuerySyntaxError(f"#WSUM needs a weight before {lexemes[at]}") from None
                at += 1
                if at >= len(lexemes) or lexemes[at] == ")":
                    raise QuerySyntaxError("#WSUM has a weight without an argument")
            if lexemes[at] == "(":
                raise QuerySyntaxError("parenthesis without an operator")
            if lexemes[at].startswith("#"):
                found = [operator(depth + 1)]
            else:
                found = create_terms(lexemes[at], analyzer)
                at += 1
            found = [a for a in found if not isinstance(a, _Empty)]
            args += found
            weights += [weight] * len(found)
        if not args:
            return _Empty()
        return _build(op, distance, args, weights if op == "WSUM" else [])

    tree = operator(0)
    if at != len(lexemes):
        raise QuerySyntaxError(f"text after the last parenthesis: {text}")
    return None if isinstance(tree, _Empty) else tree


def simplify(node):
    """Single arguments replace their operator (not SCORE); a SUM with equal arguments becomes a WSUM."""
    if node is None or isinstance(node, Term):
        return node
    node = replace(node, args=tuple(simplify(a) for a in node.args))
    if isinstance(node, Scored) and node.op == "SUM":
        counts: dict = {}
        for a in node.args:
            counts[a] = counts.get(a, 0) + 1
        if len(counts) < len(node.args):
            node = Scored("WSUM", tuple(counts), tuple(float(c) for c in counts.values()))
    if len(node.args) == 1 and not (isinstance(node, Scored) and node.op == "SCORE"):
        return node.args[0]
    return node


def get_query(text: str, default_op: str = "#SUM", analyzer: Analyzer | None = None):
    """Parse and simplify a query as a ranker sees it: within its default operator. None if no term is left."""
    return simplify(parse(f"{default_op}({text})", analyzer))


def leaves(node) -> list[Term]:
    """All terms in order, whatever the structure."""
    if node is None:
        return []
    return [node] if isinstance(node, Term) else [t for a in node.args for t in leaves(a)]


def flat_terms(node) -> list[tuple[str, str, float]] | None:
    """(field, term, factor) of each term's part of the score, if the query is made of sums of terms, nested or not; else None."""
    if node is None:
        return []
    if node.op == "SCORE":
        return [(node.args[0].field, node.args[0].term, 1.0)] if isinstance(node.args[0], Term) else None
    if node.op not in ("SUM", "WSUM"):
        return None
    weights = node.weights or (1.0,) * len(node.args)
    total = sum(weights) if node.op == "WSUM" else 1.0
    parts = [flat_terms(a) for a in node.args]
    if any(p is None for p in parts):
        return None
    return [(f, t, x * w / total if total > 0 else 0.0) for p, w in zip(parts, weights) for f, t, x in p]


def bow(text: str) -> str:
    """The words of a plain query or of one flat #SUM or #WSUM; anything else is a syntax error."""
    counts = [text.count(c) for c in "#()"]
    if not any(counts):
        return text
    m = re.match(r"(?is)^\s*#(w?sum)\s*\((.*)\)\s*$", text)
    if counts != [1, 1, 1] or not m:
        raise QuerySyntaxError(f"not a bag of words: {text}")
    args = m.group(2).split()
    return " ".join(args[1::2] if m.group(1).lower() == "wsum" else args)
