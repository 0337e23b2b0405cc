"""From query trees to DataFrame plans, for one query or for a batch of flat ones."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import Analyzer
from gleanery.operators.blocks import best_of_set
from gleanery.operators.positional import merged, proximity, synonym, together
from gleanery.operators.scale import materialise
from gleanery.operators.topn import top_by_score
from gleanery.plans.models import BM25, RankedBoolean, UnrankedBoolean
from gleanery.plans.query import Positions, QuerySyntaxError, Scored, Term, bow, flat_terms, get_query, leaves, parse
from gleanery.sources.index import Index

#: Most nodes of a batch's trees that are broadcast; beyond it they meet the postings by shuffle.
BROADCAST_TERMS = 500_000
#: Most nodes of a batch whose terms are listed as a filter of the postings' scan.
LISTED_TERMS = 200


def bm25(tf: Column, length: Column, df: Column, num_docs: Column, avg_len: Column, k1: float, b: float) -> Column:
    """ln((N + 1) / (df + 0.5)) * tf / (tf + k1 * ((1 - b) + b * length / avg_len)); without an average length K is k1."""
    k = F.when(avg_len > 0, k1 * ((1 - b) + b * length / avg_len)).otherwise(F.lit(float(k1)))
    return F.log((num_docs + 1) / (df + 0.5)) * tf / (tf + k)


def positions(node, index: Index) -> DataFrame:
    """(eid, len, positions) of a positional node."""
    if isinstance(node, Term):
        return index.postings.filter((F.col("field") == node.field) & (F.col("term") == node.term)).select("eid", "len", "positions")
    parts = [positions(a, index) for a in node.args]
    return synonym(parts) if node.op == "SYN" else together(node.op, parts, node.distance)


def check(node, model, scored: bool = True) -> None:
    """Which operators a model can score; under an unranked AND or OR the arguments are only matched."""
    if isinstance(node, Scored):
        if scored and node.op in ("SUM", "WSUM") and not isinstance(model, BM25):
            raise QuerySyntaxError(f"#{node.op} has no score in {type(model).__name__}")
        if scored and node.op in ("AND", "OR") and isinstance(model, BM25):
            raise QuerySyntaxError(f"#{node.op} has no score in BM25")
        below = scored and not (isinstance(model, UnrankedBoolean) and node.op in ("AND", "OR"))
        for a in node.args:
            check(a, model, below)


def _leaf(node, index: Index, model) -> DataFrame:
    inner = node.args[0]
    if isinstance(model, UnrankedBoolean):
        found = index.postings.filter((F.col("field") == inner.field) & (F.col("term") == inner.term)) if isinstance(inner, Term) else positions(inner, index)
        return found.select("eid", F.lit(1.0).alias("score"))
    if isinstance(inner, Term):  # a bag of words does not read positions
        found = index.postings.filter((F.col("field") == inner.field) & (F.col("term") == inner.term)).select("eid", "len", "tf")
    else:
        found = positions(inner, index).select("eid", "len", F.size("positions").alias("tf"))
    if isinstance(model, RankedBoolean):
        return found.select("eid", F.col("tf").cast("double").alias("score"))
    if isinstance(inner, Term):
        df = index.term_stats.filter((F.col("field") == inner.field) & (F.col("term") == inner.term)).select("df")
    else:
        df = found.agg(F.count(F.lit(1)).alias("df"))
    stats = index.field_stats.filter(F.col("field") == inner.field).select("num_docs", (F.col("sum_len") / F.col("doc_count")).alias("avg_len"))
    one = F.lit(1).alias("one")
    known = df.select(one, "df").join(stats.select(one, "num_docs", "avg_len"), "one")  # one row
    found = found.select(one, "eid", "len", "tf").join(F.broadcast(known), "one")
    return found.select("eid", bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("num_docs"), F.col("avg_len"), model.k1, model.b).alias("score"))


def scores(node, index: Index, model) -> DataFrame:
    """(eid, score) of every matching document."""
    if node.op == "SCORE":
        return _leaf(node, index, model)
    weights = node.weights or (1.0,) * len(node.args)
    parts = [scores(a, index, model).select("eid", F.lit(i).alias("arg"), (F.col("score") * w).alias("score") if node.op == "WSUM" else F.col("score")) for i, (a, w) in enumerate(zip(node.args, weights))]
    grouped = reduce(DataFrame.unionByName, parts).groupBy("eid")
    if node.op == "AND":
        return grouped.agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(parts)).drop("n")
    if node.op == "OR":
        return grouped.agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    total = sum(weights) if node.op == "WSUM" else 1.0
    return grouped.agg((F.sum("score") / total if total > 0 else F.lit(0.0)).alias("score"))


def rank_query(text: str, index: Index, model, n: int = 1000, qid: str = "q") -> DataFrame:
    """(qid, rank, eid, score) of one structured query; a query of stopwords alone matches nothing.

    Scores are rounded to 9 places before ranking, so that equal documents tie in any order of summation.
    """
    tree = get_query(text, model.default_op, index.analyzer)
    if tree is None:
        return index.docs.sparkSession.createDataFrame([], "qid string, rank int, eid string, score double")
    if isinstance(tree, (Term, Positions)):
        tree = Scored("SCORE", (tree,))
    check(tree, model)
    flat = flat_terms(tree) if isinstance(model, BM25) else None
    if flat:  # one scan for all terms
        return rank_batch(index.docs.sparkSession.createDataFrame([(qid, *x) for x in flat], "qid string, field string, term string, weight double"), index, model, n, [(f, t) for f, t, _ in flat])
    found = scores(tree, index, model).select(F.lit(qid).alias("qid"), "eid", F.round("score", 9).alias("score"))
    return top_by_score(found, "qid", "eid", "score", n).select("qid", "rank", "eid", "score")


def _parsed(text: str, qid: str, default_op: str, analyzer: Analyzer):
    """The simplified tree of a query; what is wrong with it is said with its qid."""
    try:
        return get_query(text, default_op, analyzer)
    except QuerySyntaxError as e:
        raise QuerySyntaxError(f"{e} in query {qid}") from None


def query_terms(queries: DataFrame, index: Index, default_op: str = "#SUM") -> DataFrame:
    """(qid, field, term, weight) of the flat queries of (qid, qstring): plain words, #SUM and #WSUM of terms; others give no row, malformed ones raise."""

    @F.pandas_udf("array<struct<field:string,term:string,weight:double>>")
    def flat(qids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("field", "term", "weight"), x)) for x in flat_terms(_parsed(t, q, default_op, analyzer)) or []] for q, t in zip(qids, texts)], dtype=object)

    analyzer = index.analyzer
    return queries.filter(F.col("qstring").isNotNull()).select("qid", F.explode(flat("qid", "qstring")).alias("t")).select("qid", "t.*")


def bag_words(query: Column) -> Column:
    """The words of plain queries and of single flat sums; other structures raise."""

    @F.pandas_udf("string")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(bow, na_action="ignore")

    return words(query)


def query_leaves(queries: DataFrame, index: Index, default_op: str = "#SUM") -> DataFrame:
    """(qid, field, term): a row for every term of every query of (qid, qstring) as often as the query has it, whatever the structure."""

    @F.pandas_udf("array<struct<field:string,term:string>>")
    def found(qids: pd.Series, texts: pd.Series) -> pd.Series:
        def one(q, t):
            try:
                return [{"field": x.field, "term": x.term} for x in leaves(parse(f"{default_op}({t})", analyzer))]
            except QuerySyntaxError as e:
                raise QuerySyntaxError(f"{e} in query {q}") from None

        return pd.Series([one(q, t) for q, t in zip(qids, texts)], dtype=object)

    analyzer = index.analyzer
    return queries.filter(F.col("qstring").isNotNull()).select("qid", F.explode(found("qid", "qstring")).alias("t")).select("qid", "t.*")


def rank_batch(terms: DataFrame, index: Index, model: BM25, n: int = 1000, listed: list[tuple[str, str]] | None = None) -> DataFrame:
    """(qid, rank, eid, score) of all flat queries in one plan.

    Query terms are matched with their statistics, then scored in blocks of documents (`best_of_set`). The (field, term) pairs may be `listed` where they are known and few;
    then they are filters of the scan, each posting is scored once a query, and a query's scores add up before its best n are taken.
    """
    if listed:
        wanted = F.col("field").isin(*{f for f, _ in listed}) & F.col("term").isin(*{t for _, t in listed})
        index = replace(index, postings=index.postings.filter(wanted), term_stats=index.term_stats.filter(wanted))
    stats = index.field_stats.select("field", "num_docs", (F.col("sum_len") / F.col("doc_count")).alias("avg_len"))
    known = terms.join(index.term_stats, ["field", "term"]).join(F.broadcast(stats), "field")
    if not listed:
        asks = known.select("qid", F.lit("SUM").alias("op"), F.lit(1).alias("args"), F.lit(0).alias("distance"), F.lit(0).alias("arg"), "field", "term", F.col("weight").cast("double").alias("weight"), F.lit("BM25").alias("model"), "df", "num_docs", "avg_len")
        return best_of_set(asks, index, model.k1, model.b, n)
    met = index.postings.select("field", "term", "eid", "tf", "len").join(F.broadcast(known), ["field", "term"])
    score = F.col("weight") * bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("num_docs"), F.col("avg_len"), model.k1, model.b)
    found = met.groupBy("qid", "eid").agg(F.round(F.sum(score), 9).alias("score"))
    return top_by_score(found, "qid", "eid", "score", n).select("qid", "rank", "eid", "score")


#: A node of a query's tree as a row: its place, the place and height of the node above, its number among that one's arguments, and what it is.
NODE = "id:int,up:int,up_height:int,arg:int,height:int,op:string,distance:int,args:int,weight:double,field:string,term:string,model:string"
POSITIONAL = ("TERM", "SYN", "NEAR", "WINDOW")


def tree_rows(tree, model: str) -> list[dict]:
    """The nodes of a tree. Heights count from the terms within positional operators and again from #SCORE within scored ones; the root's `up` is -1."""
    rows: list[dict] = []

    def visit(node, up: int, arg: int, weight: float) -> tuple[int, int]:
        at = len(rows)
        row = {"id": at, "up": up, "up_height": -1, "arg": arg, "distance": 0, "args": 0, "weight": weight, "field": "", "term": "", "model": model}
        rows.append(row)
        if isinstance(node, Term):
            row |= {"height": 0, "op": "TERM", "field": node.field, "term": node.term}
            return at, 0
        weights = (1.0,) * len(node.args)
        if isinstance(node, Scored) and node.op == "WSUM":
            total = sum(node.weights)
            weights = tuple(w / total if total > 0 else 0.0 for w in node.weights)
        below = [visit(a, at, i, w) for i, (a, w) in enumerate(zip(node.args, weights))]
        height = 0 if node.op == "SCORE" else 1 + max(h for _, h in below)
        row |= {"height": height, "op": node.op, "args": len(node.args), "distance": getattr(node, "distance", 0), "field": node.field if isinstance(node, Positions) else ""}
        for child, _ in below:
            rows[child]["up_height"] = height
        return at, height

    visit(tree, -1, 0, 1.0)
    return rows


def _one_operator(nodes: DataFrame, index: Index, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of best_of_set for the queries that are one operator over terms, nodes of all other queries)."""
    root, near = F.col("up") == -1, F.col("op").isin("NEAR", "WINDOW")
    per = nodes.groupBy("qid").agg(
        F.count(F.when(F.col("op").isin("SYN", "NEAR", "WINDOW"), 1)).alias("placed"), F.max(F.when(root, F.col("op"))).alias("root"), F.max(F.when(root, F.col("height"))).alias("root_height"),
        F.max(F.when(root, F.col("args"))).alias("root_args"), F.max(F.when(near, F.struct("op", "distance", "args", "height"))).alias("near"), F.max("model").alias("by"),
    )
    plain = (F.col("placed") == 0) & (F.col("root_height") <= 1)
    proximity = (F.col("placed") == 1) & (F.col("root") == "SCORE") & (F.col("near.height") == 1) & (F.col("by") == "BM25")
    per = materialise(per.withColumn("kind", F.when(plain, "plain").when(proximity, "near").otherwise("rest")))
    ups = nodes.select("qid", F.col("id").alias("up"), F.col("weight").alias("up_weight"), F.col("arg").alias("up_arg"))
    met = nodes.filter("op = 'TERM'").select("qid", "up", "arg", "field", "term", "model").join(ups, ["qid", "up"]).join(per.filter("kind <> 'rest'"), "qid").join(index.term_stats, ["field", "term"]).join(stats, "field")
    is_near = F.col("kind") == "near"
    op = F.when(is_near, F.col("near.op")).when(F.col("root").isin("SCORE", "WSUM"), "SUM").otherwise(F.col("root"))
    asks = met.select(
        "qid", op.alias("op"), F.when(is_near, F.col("near.args")).otherwise(F.col("root_args")).alias("args"), F.when(is_near, F.col("near.distance")).otherwise(0).alias("distance"),
        F.when(is_near, F.col("arg")).otherwise(F.col("up_arg")).alias("arg"), "field", "term", F.when(is_near, 1.0).otherwise(F.col("up_weight")).alias("weight"), "model", "df", "num_docs", "avg_len",
    )
    return asks, nodes.join(per.filter("kind = 'rest'"), "qid", "left_semi")


def rank_set(queries: DataFrame, index: Index, model, n: int = 1000, boolean: bool = False) -> DataFrame:
    """(qid, rank, eid, score) of every query of (qid, qstring), whatever its structure, in one plan.

    The trees of all queries become rows. Those of one operator over terms are scored in blocks of documents (`best_of_set`). Terms of all others meet the postings in two joins, one for
    those that are scored as they are and one, with positions, for those within positional operators; then each height of the trees is one aggregation by query, node and
    document. So the number of scans depends neither on the number of queries nor on their size, and the number of aggregations only on the deepest tree. A malformed query raises, and so does an operator without a score in the model;
    with `boolean`, queries that are an #AND or #OR are ranked by ranked Boolean where the model is BM25. Queries without a text or of stopwords alone rank nothing.
    """
    name, default_op = type(model).__name__, model.default_op

    @F.pandas_udf(f"array<struct<{NODE}>>")
    def trees(qids: pd.Series, texts: pd.Series) -> pd.Series:
        def one(q, t):
            tree = _parsed(t, q, default_op, analyzer)
            if tree is None:
                return []
            own = RankedBoolean() if boolean and name == "BM25" and isinstance(tree, Scored) and tree.op in ("AND", "OR") else model
            try:
                check(tree, own)
            except QuerySyntaxError as e:
                raise QuerySyntaxError(f"{e} in query {q}") from None
            return tree_rows(tree if isinstance(tree, Scored) else Scored("SCORE", (tree,)), type(own).__name__)

        return pd.Series([one(q, t) for q, t in zip(qids, texts)], dtype=object)

    analyzer = index.analyzer
    nodes = materialise(queries.filter(F.col("qstring").isNotNull()).select("qid", F.explode(trees("qid", "qstring")).alias("t")).select("qid", "t.*"))
    stats = F.broadcast(index.field_stats.select("field", "num_docs", (F.col("sum_len") / F.col("doc_count")).alias("avg_len")))
    k1, b = (model.k1, model.b) if isinstance(model, BM25) else (0.0, 0.0)
    flat, nodes = _one_operator(nodes, index, stats)
    ranked = best_of_set(flat, index, k1, b, n)
    shape = nodes.agg(F.max(F.when(F.col("op").isin(*POSITIONAL), F.col("height"))).alias("inner"), F.max(F.when(~F.col("op").isin(*POSITIONAL), F.col("height"))).alias("outer"), F.count(F.lit(1)).alias("n")).first()
    if not shape["n"]:
        return ranked
    few = (lambda d: F.broadcast(d)) if shape["n"] <= BROADCAST_TERMS else (lambda d: d)
    ups = nodes.select("qid", F.col("id").alias("up"), F.col("op").alias("up_op"))
    terms = nodes.filter("op = 'TERM'").join(ups, ["qid", "up"]).select("qid", "up", "up_height", "arg", "field", "term", "up_op", "model")
    postings = index.postings
    if shape["n"] <= LISTED_TERMS:  # so few that they are filters of the scan
        listed = [r["term"] for r in terms.select("term").distinct().collect()]
        postings = postings.filter(F.col("term").isin(listed)) if listed else postings.limit(0)
    score_of = nodes.filter(F.col("op") == "SCORE").select("qid", F.col("id").alias("node"), F.col("up").alias("to"), F.col("up_height").alias("to_height"), "weight", "model")
    bare = terms.filter("up_op = 'SCORE'").select("qid", F.col("up").alias("node"), "field", "term").join(index.term_stats, ["field", "term"]).select("qid", "node", "field", "term", "df")

    def met_by(asked: DataFrame) -> DataFrame:
        """Postings laid out by document meet the terms: what is grouped by query, node and document afterwards stays where it is."""
        return postings.select("field", "term", "eid", "tf", "len").repartition("eid").join(few(asked), ["field", "term"]).select("qid", "node", "eid", "field", "tf", "len", "df")

    # queries with positional operators are apart, as their matches were written and read again
    placed = few(nodes.filter(F.col("op").isin("SYN", "NEAR", "WINDOW")).select("qid").distinct())
    found = [met_by(bare.join(placed, "qid", "left_semi"))]
    inner = terms.filter("up_op <> 'SCORE'")
    lists = [postings.select("field", "term", "eid", "len", "positions").repartition("eid").join(few(inner.select("qid", "up", "up_height", "arg", "field", "term")), ["field", "term"]).select("qid", "up", "up_height", "arg", "eid", "field", "len", "positions")]
    for height in range(1, (shape["inner"] or 0) + 1):
        ops = nodes.filter(F.col("op").isin("SYN", "NEAR", "WINDOW") & (F.col("height") == height))
        ops = ops.join(ups, ["qid", "up"]).select("qid", F.col("id").alias("node"), F.col("up").alias("to"), F.col("up_height").alias("to_height"), F.col("arg").alias("to_arg"), "op", "distance", "args", "up_op")
        mine = reduce(DataFrame.unionByName, lists).filter(F.col("up_height") == height).withColumnRenamed("up", "node").drop("up_height")
        mine = mine.groupBy("qid", "node", "eid", "field", "len").agg(F.sort_array(F.collect_list(F.struct("arg", "positions"))).alias("x")).join(few(ops), ["qid", "node"])
        mine = mine.filter((F.col("op") == "SYN") | (F.size("x") == F.col("args")))  # existence first
        near = proximity(F.col("op"), F.col("distance"), F.col("x.positions"))
        # matched once, then read for the scores, the document counts and the heights above
        met = materialise(mine.withColumn("near", near).withColumn("positions", F.when(F.col("op") == "SYN", merged(F.col("x.positions"))).otherwise(F.col("near"))).filter(F.size("positions") > 0).select("qid", "node", "to", "to_height", "to_arg", "up_op", "eid", "field", "len", "positions"))
        lists.append(met.filter("up_op <> 'SCORE'").select("qid", F.col("to").alias("up"), F.col("to_height").alias("up_height"), F.col("to_arg").alias("arg"), "eid", "field", "len", "positions"))
        scored = met.filter("up_op = 'SCORE'").select("qid", F.col("to").alias("node"), "eid", "field", F.size("positions").alias("tf"), "len")
        found.append(scored.join(scored.groupBy("qid", "node").agg(F.count(F.lit(1)).alias("df")), ["qid", "node"]))
    by_model = F.when(F.col("model") == "BM25", bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("num_docs"), F.col("avg_len"), k1, b)).when(F.col("model") == "RankedBoolean", F.col("tf").cast("double")).otherwise(1.0)

    def evaluated(found: DataFrame) -> DataFrame:
        """(qid, eid, score) of the trees' roots, from the matches of their #SCORE nodes."""
        leaf = found.join(few(score_of), ["qid", "node"]).join(stats, "field").select("qid", "to", "to_height", "eid", "weight", by_model.alias("score"))
        pending = [leaf]
        for height in range(1, (shape["outer"] or 0) + 1):
            ops = nodes.filter(~F.col("op").isin(*POSITIONAL) & (F.col("op") != "SCORE") & (F.col("height") == height)).select("qid", F.col("id").alias("node"), F.col("up").alias("above"), F.col("up_height").alias("above_height"), F.col("weight").alias("own_weight"), "op", "args")
            mine = reduce(DataFrame.unionByName, pending).filter(F.col("to_height") == height).withColumnRenamed("to", "node")
            mine = mine.groupBy("qid", "node", "eid").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.sum(F.col("weight") * F.col("score")).alias("total"), F.count(F.lit(1)).alias("met")).join(few(ops), ["qid", "node"])
            score = F.when(F.col("op") == "AND", F.col("least")).when(F.col("op") == "OR", F.greatest("most", F.lit(0.0))).otherwise(F.col("total"))
            pending.append(mine.filter((F.col("op") != "AND") | (F.col("met") == F.col("args"))).select("qid", F.col("above").alias("to"), F.col("above_height").alias("to_height"), "eid", F.col("own_weight").alias("weight"), score.alias("score")))
        return reduce(DataFrame.unionByName, pending).filter(F.col("to") == -1).select("qid", "eid", "score")

    best = evaluated(met_by(bare.join(placed, "qid", "left_anti"))).unionByName(evaluated(reduce(DataFrame.unionByName, found)))
    score = F.lit(1.0) if isinstance(model, UnrankedBoolean) else F.round("score", 9)
    return top_by_score(best.select("qid", "eid", score.alias("score")), "qid", "eid", "score", n).select("qid", "rank", "eid", "score").unionByName(ranked)
