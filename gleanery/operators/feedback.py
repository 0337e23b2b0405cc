"""Pseudo-relevance feedback: expansion terms from the first documents of a ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import valid_expansion_term
from gleanery.sources.index import Index


#: Most terms of a field whose counts are broadcast.
MOST_TERMS = 500_000


@dataclass(frozen=True)
class Feedback:
    algorithm: str = "rm3"
    num_docs: int = 10
    num_terms: int = 10
    field_in: str = "body"
    field_out: str = "body"
    orig_weight: float = 0.0

    def __post_init__(self):
        if self.algorithm not in ("rm3", "okapi"):
            raise ValueError(f"unknown feedback algorithm {self.algorithm}")

    @classmethod
    def of(cls, p: dict) -> Feedback:
        if str(p.get("type", "prf")).lower() != "prf":
            raise ValueError(f"unknown rewriter {p.get('type')}")
        get = lambda k, d: p.get(f"prf:{k}", d)
        return cls(str(get("algorithm", "rm3")).lower(), int(get("numDocs", 10)), int(get("numTerms", 10)), get("expansionFieldIn", "body"), get("expansionFieldOut", "body"), float(get("rm3:origWeight", 0.0)))


def expansion_terms(rankings: DataFrame, index: Index, p: Feedback) -> DataFrame:
    """(qid, place, term, weight) of the best terms of each query's first documents.

    okapi: documents with the term times max(0, ln((N - df + 0.5) / (df + 0.5))). rm3: sum of tf / poslen * score, times
    ln(C / ctf), C being the field's total length. Terms with a period, a comma or letters beyond ASCII and weights of 0 drop out.
    """
    top = rankings.filter(F.col("rank") <= p.num_docs).select("qid", "eid", "score")
    postings = index.of_documents(top).filter((F.col("field") == p.field_in) & valid_expansion_term(F.col("term"))).select("term", "eid", "tf")
    # a document's terms, which hold no space, travel to its queries in one row, and nothing moves again before a query's best terms are taken
    packed = postings.groupBy("eid").agg(F.collect_list(F.struct("term", "tf")).alias("x")).select("eid", F.array_join("x.term", " ").alias("terms"), F.col("x.tf").alias("tfs"))
    met = packed.join(top, "eid")
    if p.algorithm == "rm3":
        lengths = index.lengths.filter((F.col("field") == p.field_in) & (F.col("poslen") > 0)).select("eid", "poslen")
        met = met.join(lengths, "eid").select("qid", "terms", "tfs", "poslen", "score")
    found = met.repartition("qid").select("*", F.posexplode(F.split("terms", " ")).alias("at", "term")).withColumn("tf", F.get("tfs", F.col("at")))
    if p.algorithm == "rm3":
        raw = found.groupBy("qid", "term").agg(F.sum(F.col("tf") / F.col("poslen") * F.col("score")).alias("raw"))
    else:
        raw = found.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("raw"))
    terms = index.term_stats.filter(F.col("field") == p.field_in).select("term", "df", "ctf")
    terms = F.broadcast(terms) if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else terms
    whole = F.broadcast(index.field_stats.filter(F.col("field") == p.field_in).select(F.lit(1).alias("one"), "num_docs", "sum_len"))  # one row
    raw = raw.join(terms, "term").withColumn("one", F.lit(1)).join(whole, "one")
    if p.algorithm == "rm3":
        factor = F.when((F.col("ctf") > 0) & (F.col("sum_len") > 0), F.log(F.col("sum_len") / F.col("ctf"))).otherwise(0.0)
    else:
        factor = F.greatest(F.lit(0.0), F.log((F.col("num_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = raw.select("qid", "term", F.round(F.col("raw") * factor, 9).alias("weight")).filter(F.col("weight") > 0)
    w = Window.partitionBy("qid").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= p.num_terms).select("qid", "place", "term", "weight")


def learned_queries(terms: DataFrame, p: Feedback) -> DataFrame:
    """(qid, learned): the terms of each query as a query of their own, in ascending weight."""
    suffix = "" if p.field_out == "body" else f".{p.field_out}"
    piece = F.concat(F.format_string("%.12f ", F.col("x.weight")) if p.algorithm == "rm3" else F.lit(""), F.col("x.term"), F.lit(suffix))
    pieces = terms.select("qid", F.struct("weight", F.col("place").alias("place"), "term").alias("x")).withColumn("piece", piece)
    learned = pieces.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("x.place"), F.col("piece")))), lambda s: s["piece"]).alias("pieces"))
    op = "#WSUM" if p.algorithm == "rm3" else "#SUM"
    return learned.select("qid", F.concat(F.lit(f"{op}( "), F.array_join("pieces", " "), F.lit(" )")).alias("learned"))


def expanded_queries(terms: DataFrame, queries: DataFrame, p: Feedback, default_op: str = "#SUM") -> DataFrame:
    """(qid, qstring, original_qstring): learned queries, with a weight on the original if there is one; queries without terms stay as they are."""
    out = queries.select("qid", "qstring").join(learned_queries(terms, p), "qid", "left")
    mixed = F.concat(F.lit(f"#WSUM( {p.orig_weight:g} {default_op}("), "qstring", F.lit(f") {1 - p.orig_weight:g} "), "learned", F.lit(" )"))
    new = mixed if p.orig_weight > 0 else F.col("learned")
    return out.select("qid", F.coalesce(new, "qstring").alias("qstring"), F.col("qstring").alias("original_qstring"))
