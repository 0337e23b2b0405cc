"""The registered queries of the core and their SQL.

The collection is the table docs (the latest crawl of each page) with its five fields. Scores are rounded to six places and ranked after
rounding to nine, in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import answers, dense, feedback, inspection, ltr, passages
from gleanery.operators.scale import latest, new_path
from gleanery.operators.topn import top_by_score
from gleanery.plans.compile import bag_words, positions, query_leaves, rank_batch, rank_query, rank_set
from gleanery.plans.models import BM25, RankedBoolean, UnrankedBoolean
from gleanery.plans.query import get_query
from gleanery.sources import files, sinks
from gleanery.sources.index import Index, build_index, open_index

COLUMNS = {"body": "body_string", "title": "title_string", "url": "raw_url", "keywords": "keywords", "inlink": "inlink"}
#: Added before scores of nine places are rounded to six, so that a last 500 goes up in both engines.
TIE = 1e-10
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        REGISTRY[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "docs"), "eid", "crawled_at", ["body_string", "title_string", "raw_url", "keywords", "inlink", "spam_score", "page_rank"])


def index(spark: SparkSession, sf: str, *fields: str) -> Index:
    wanted = {f: c for f, c in COLUMNS.items() if not fields or f in fields}
    return build_index(docs(spark, sf), wanted, attributes=["raw_url", "title_string", "body_string", "spam_score", "page_rank"])


def stored(spark: SparkSession, sf: str, *fields: str, positions: bool = True) -> Index:
    """An index for plans that read its postings more than once; its documents are written too, without their texts."""
    wanted = {f: c for f, c in COLUMNS.items() if not fields or f in fields}
    return build_index(docs(spark, sf), wanted, attributes=["raw_url", "spam_score", "page_rank"], positions=positions).stored()


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder for a file that is written and read again; release() deletes it."""
    return new_path(spark, "file")


def query_set(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, qstring): of a repeated qid the later row holds."""
    rows = table(spark, sf, "queries").select("qid", "qstring", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    return rows.filter(F.col("qid").isNotNull()).groupBy("qid").agg(F.max_by("qstring", "at").alias("qstring"))


def run_ranking(spark: SparkSession, sf: str, n: int = 20, run: str = "bm25") -> DataFrame:
    """The best n pages of a run."""
    rows = table(spark, sf, "rankings").filter((F.col("runid") == run) & F.col("qid").isNotNull() & F.col("eid").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    rows = rows.groupBy("qid", "eid").agg(F.max("score").alias("score"))
    return top_by_score(rows, "qid", "eid", "score", n).select("qid", "rank", "eid", "score")


# SQL that builds the same index

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKEN = "'[\\p{L}\\p{N}]+'"
_RECS = "recs AS (SELECT * FROM docs WHERE eid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY eid ORDER BY crawled_at DESC, body_string, title_string, spam_score) = 1)"


def index_sql(*fields: str) -> str:
    parts = " UNION ALL ".join(f"SELECT eid, '{f}' AS field, regexp_extract_all(lower({c}), {_TOKEN}) AS w FROM recs WHERE {c} IS NOT NULL" for f, c in COLUMNS.items() if not fields or f in fields)
    return f"""WITH RECURSIVE {_RECS},
tok AS ({parts}),
pos AS (SELECT eid, field, len(w) AS len, unnest(w) AS term, unnest(range(len(w))) AS pos FROM tok),
post AS (SELECT field, term, eid, len, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM pos WHERE term NOT IN ({_STOP}) GROUP BY field, term, eid, len),
lengths AS (SELECT t.eid, t.field, len(t.w) AS len, coalesce(max(p.pos) + 1, 0) AS poslen FROM tok t LEFT JOIN (SELECT * FROM pos WHERE term NOT IN ({_STOP})) p ON p.eid = t.eid AND p.field = t.field GROUP BY t.eid, t.field, len(t.w)),
ts AS (SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM post GROUP BY field, term),
nd AS (SELECT count(*) AS num_docs FROM recs),
fs AS (SELECT l.field, l.doc_count, s.sum_len, num_docs, s.sum_len / l.doc_count AS avg_len FROM (SELECT field, count(*) AS doc_count FROM lengths WHERE poslen > 0 GROUP BY field) l JOIN (SELECT field, sum(ctf)::BIGINT AS sum_len FROM ts GROUP BY field) s USING (field), nd)"""


def _bm25_sql(tf: str = "tf", length: str = "len", df: str = "df") -> str:
    return f"ln((num_docs + 1) / ({df} + 0.5)) * {tf} / ({tf} + 1.2 * (0.25 + 0.75 * {length} / avg_len))"


def _top_sql(scores: str, n: int, qid: str = "'q'") -> str:
    """scores: SELECT of qid, eid, score."""
    return f"""SELECT qid, rank::INT AS rank, eid, round(score + {TIE}, 6) AS score FROM (
  SELECT qid, eid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, eid) AS rank FROM (SELECT qid, eid, round(score, 9) AS score FROM ({scores}))) WHERE rank <= {n}"""


def _shown(ranking: DataFrame) -> DataFrame:
    return ranking.select("qid", "rank", "eid", F.round(F.col("score") + TIE, 6).alias("score"))


# index and inspection


@query(index_sql() + " SELECT field, term, df, ctf FROM ts")
def index_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).term_stats


@query(index_sql() + " SELECT field, num_docs, doc_count, sum_len, round(avg_len, 6) AS avg_len FROM fs")
def index_field_stats(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.list_stats(stored(spark, sf)).withColumn("avg_len", F.round("avg_len", 6))


@query(index_sql() + " SELECT eid, field, len, poslen FROM lengths")
def index_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).lengths


@query(index_sql("body") + " SELECT term, eid, tf, len, array_to_string(positions, ' ') AS positions FROM post")
def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    p = index(spark, sf, "body").postings
    return p.select("term", "eid", "tf", "len", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query(index_sql("title") + " SELECT term, df, ctf FROM ts")
def list_terms(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.list_terms(index(spark, sf, "title"), "title")


@query(index_sql("body") + " SELECT eid, tf, array_to_string(positions, ' ') AS positions, df, ctf FROM post JOIN ts USING (field, term) WHERE term = 'compass'")
def list_postings(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.list_postings(stored(spark, sf, "body"), "compass", "body").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query(index_sql("body") + " SELECT eid, tf, array_to_string(positions, ' ') AS positions, df, ctf FROM post JOIN ts USING (field, term) WHERE term = 'compass' ORDER BY eid LIMIT 5")
def list_postings_sample(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.list_postings(stored(spark, sf, "body"), "compass", "body", 5).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


def _first_eid(spark: SparkSession, sf: str) -> str:
    return table(spark, sf, "docs").agg(F.min("eid")).first()[0] or ""


@query(index_sql() + " SELECT field, term, tf, array_to_string(positions, ' ') AS positions FROM post WHERE eid = (SELECT min(eid) FROM docs)")
def list_termvector(spark: SparkSession, sf: str) -> DataFrame:
    found = inspection.list_termvector(index(spark, sf), _first_eid(spark, sf))
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query(f"WITH {_RECS} SELECT row_number() OVER (ORDER BY eid) - 1 AS iid, eid FROM recs")
def list_docids(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.list_docids(index(spark, sf, "title"))


@query(index_sql() + " SELECT DISTINCT field FROM lengths")
def list_fields(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.list_fields(index(spark, sf))


@query(f"WITH {_RECS} SELECT eid, page_rank FROM recs WHERE eid = (SELECT min(eid) FROM docs)")
def list_attribute(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.list_attribute(index(spark, sf, "title"), _first_eid(spark, sf), "page_rank")


@query(f"WITH {_RECS} SELECT eid, raw_url, title_string, body_string FROM recs WHERE eid = (SELECT min(eid) FROM docs)")
def list_doc(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.list_doc(index(spark, sf, "title"), _first_eid(spark, sf)).select("eid", "raw_url", "title_string", "body_string")


@query(f"WITH {_RECS}, one AS (SELECT * FROM recs WHERE eid = (SELECT min(eid) FROM docs)) SELECT * FROM (SELECT 'raw_url' AS name, raw_url AS value FROM one UNION ALL SELECT 'title_string', title_string FROM one) WHERE value IS NOT NULL")
def list_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.list_metadata(index(spark, sf, "title"), _first_eid(spark, sf), ["raw_url", "title_string"])


# text functions


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), {_TOKEN})) AS tokens, len(list_filter(regexp_extract_all(lower(text), {_TOKEN}), lambda x: x NOT IN ({_STOP}))) AS terms FROM documents WHERE text IS NOT NULL")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    a, d = T.Analyzer(), table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.size(a.tokens(F.col("text"))).alias("tokens"), F.size(a.terms(F.col("text"))).alias("terms"))


@query("SELECT eid, trim(regexp_replace(title_string, '[ \\t\\n\\r\\x{0b}\\f\\x{85}\\p{Z}]+', ' ', 'g'), ' ') AS title FROM docs")
def whitespace_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "docs").select("eid", T.collapse_whitespace(F.col("title_string")).alias("title"))


@query("SELECT eid, array_to_string(list_filter(string_split_regex(title_string, '\\s+'), lambda x: x <> '')[1:5], ' ') AS title FROM docs WHERE title_string IS NOT NULL")
def truncate_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "docs").filter("title_string IS NOT NULL").select("eid", T.truncate_words(F.col("title_string"), 5).alias("title"))


@query(index_sql("title", "url") + " SELECT field, term FROM ts WHERE NOT regexp_matches(term, '[^\\x00-\\x7F]') AND NOT contains(term, '.') AND NOT contains(term, ',')")
def valid_expansion_term(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf, "title", "url").term_stats.filter(T.valid_expansion_term(F.col("term"))).select("field", "term")


@query("SELECT qid, eid, rel, try_cast(rel AS DOUBLE) AS value FROM qrels")
def safe_double(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "qrels").select("qid", "eid", "rel", T.safe_double(F.col("rel")).alias("value"))


@query(
    """SELECT qid, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(qstring, '\\s+', ' ', 'g')), '^(answer|short answer)\\s*:\\s*', '', 'i'),
  '\\s*\\([^)]*insufficient[^)]*\\)\\s*$', '', 'i'), '^(the answer is|it is)\\s+', '', 'i').trim(chr(32) || chr(9) || chr(13) || chr(10) || chr(34) || chr(39)) AS answer FROM (SELECT qid, coalesce(qstring, '') AS qstring FROM queries)"""
)
def answer_postprocess(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "queries").select("qid", T.postprocess_answer(F.col("qstring")).alias("answer"))


@query(
    """SELECT doc_id, trim(array_to_string(list_filter(string_split(regexp_extract(t, '^(.*?[.!?])(?:\\s|$)', 1) , ' '), lambda x: x <> '')[1:8], ' '), ' ,;:.') AS span
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(t, '[.!?](\\s|$)')"""
)
def short_span(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter(F.col("text").isNotNull() & T.collapse_whitespace(F.col("text")).rlike(r"[.!?](\s|$)"))
    return d.select("doc_id", T.short_span(F.col("text")).alias("span"))


# Boolean models


def one(spark: SparkSession, sf: str, q: str, model, n: int = 1000) -> DataFrame:
    return _shown(rank_query(q, stored(spark, sf, "body", "title"), model, n))


def _terms_sql(*terms: str, field: str = "body") -> str:
    return f"SELECT eid, term, tf FROM post WHERE field = '{field}' AND term IN ({', '.join(repr(t) for t in terms)})"


@query(index_sql("body") + _top_sql(f" SELECT 'q' AS qid, eid, 1.0::DOUBLE AS score FROM ({_terms_sql('compass', 'meadow')}) GROUP BY eid HAVING count(*) = 2", 1000))
def bool_unranked_and(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#AND(compass meadow)", UnrankedBoolean())


@query(index_sql("body") + _top_sql(f" SELECT 'q' AS qid, eid, 1.0::DOUBLE AS score FROM ({_terms_sql('lighthouse', 'falcon')}) GROUP BY eid", 1000))
def bool_unranked_or(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#OR(lighthouse falcon)", UnrankedBoolean())


@query(index_sql("body") + _top_sql(f" SELECT 'q' AS qid, eid, min(tf)::DOUBLE AS score FROM ({_terms_sql('compass', 'meadow')}) GROUP BY eid HAVING count(*) = 2", 1000))
def bool_ranked_and(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#AND(compass meadow)", RankedBoolean())


@query(index_sql("body") + _top_sql(f" SELECT 'q' AS qid, eid, max(tf)::DOUBLE AS score FROM ({_terms_sql('compass', 'meadow')}) GROUP BY eid", 1000))
def bool_ranked_or(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#OR(compass meadow)", RankedBoolean())


@query(
    index_sql("body", "title")
    + f""", o AS (SELECT eid, max(tf) AS s FROM ({_terms_sql('compass', 'meadow')}) GROUP BY eid),
t AS (SELECT eid, tf AS s FROM post WHERE field = 'title' AND term = 'ranking') """
    + _top_sql("SELECT 'q' AS qid, eid, least(o.s, t.s)::DOUBLE AS score FROM o JOIN t USING (eid)", 1000)
)
def bool_nested(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#AND(#OR(compass meadow) ranking.title)", RankedBoolean())


# positional operators


#: The pointer walk over any number of position lists as a recursive query: lists_(qid, eid, len, kind, n, x) to found(qid, eid, len, tf).
_WALK = """walk AS (
  SELECT qid, eid, len, kind, n, x, list_transform(x, lambda l: 1) AS pt, 0 AS m FROM lists_
  UNION ALL SELECT qid, eid, len, kind, n, x, CASE WHEN move = 0 THEN list_transform(pt, lambda a: a + 1) ELSE list_transform(range(1, len(pt) + 1), lambda j: pt[j] + (j = move)::INT) END, m + (move = 0)::INT FROM (
    SELECT *, CASE WHEN kind = 'WINDOW' THEN CASE WHEN list_max(here) - list_min(here) < n THEN 0 ELSE list_position(here, list_min(here)) END
      WHEN wrong = 0 THEN 0 WHEN here[wrong + 1] <= here[wrong] THEN wrong + 1 ELSE wrong END AS move FROM (
      SELECT *, coalesce(list_min(list_filter(range(1, len(here)), lambda j: NOT (here[j + 1] - here[j] BETWEEN 1 AND n))), 0) AS wrong FROM (
        SELECT *, list_transform(range(1, len(pt) + 1), lambda j: x[j][pt[j]]) AS here FROM walk WHERE len(list_filter(range(1, len(pt) + 1), lambda j: pt[j] > len(x[j]))) = 0)))),
found AS (SELECT qid, eid, max(len) AS len, max(m) AS tf FROM walk GROUP BY qid, eid HAVING max(m) > 0)"""


def _lists_sql(kind: str, n: int, *terms: str, field: str = "body") -> str:
    """lists_ of one operator over terms of a field."""
    joins = " ".join(f"JOIN post p{i} ON p{i}.eid = p0.eid AND p{i}.field = '{field}' AND p{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"lists_ AS (SELECT 'q' AS qid, p0.eid, p0.len, '{kind}' AS kind, {n} AS n, [{', '.join(f'p{i}.positions' for i in range(len(terms)))}] AS x FROM post p0 {joins} WHERE p0.field = '{field}' AND p0.term = '{terms[0]}')"


@query(index_sql("body") + " SELECT eid, string_agg(DISTINCT pos::VARCHAR, ' ' ORDER BY pos::VARCHAR) AS positions, count(DISTINCT pos) AS tf FROM pos WHERE term IN ('compass', 'meadow') GROUP BY eid")
def syn_postings(spark: SparkSession, sf: str) -> DataFrame:
    found = positions(get_query("#SYN(compass meadow)").args[0], index(spark, sf, "body"))
    return found.select("eid", F.array_join(F.array_sort(F.col("positions").cast("array<string>")), " ").alias("positions"), F.size("positions").alias("tf"))


def _match(spark: SparkSession, sf: str, q: str) -> DataFrame:
    return positions(get_query(q).args[0], stored(spark, sf, "body"))


@query(index_sql("body") + " SELECT DISTINCT a.eid FROM pos a JOIN pos b ON a.eid = b.eid AND a.term = 'compass' AND b.term = 'meadow' AND b.pos > a.pos AND b.pos - a.pos <= 8")
def near_match(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, "#NEAR/8(compass meadow)").select("eid")


@query(index_sql("body") + " SELECT DISTINCT a.eid FROM pos a JOIN pos b ON a.eid = b.eid AND a.term = 'compass' AND b.term = 'meadow' AND abs(b.pos - a.pos) < 8")
def window_match(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, "#WINDOW/8(compass meadow)").select("eid")


@query(index_sql("body") + f", {_lists_sql('NEAR', 8, 'compass', 'meadow')}, {_WALK} SELECT eid, tf FROM found")
def near_tf(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, "#NEAR/8(compass meadow)").select("eid", F.size("positions").alias("tf"))


@query(index_sql("body") + f", {_lists_sql('WINDOW', 8, 'compass', 'meadow')}, {_WALK} SELECT eid, tf FROM found")
def window_tf(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, "#WINDOW/8(compass meadow)").select("eid", F.size("positions").alias("tf"))


@query(
    index_sql("body")
    + " SELECT DISTINCT a.eid FROM pos a JOIN pos b ON a.eid = b.eid AND b.pos > a.pos AND b.pos - a.pos <= 12 JOIN pos c ON c.eid = b.eid AND c.pos > b.pos AND c.pos - b.pos <= 12 WHERE a.term = 'compass' AND b.term = 'meadow' AND c.term = 'ranking'"
)
def near_three(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, "#NEAR/12(compass meadow ranking)").select("eid")


@query(
    index_sql("body")
    + " SELECT DISTINCT a.eid FROM pos a JOIN pos b ON a.eid = b.eid AND abs(b.pos - a.pos) < 12 JOIN pos c ON c.eid = b.eid AND greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) < 12 WHERE a.term = 'compass' AND b.term = 'meadow' AND c.term = 'ranking'"
)
def window_three(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, "#WINDOW/12(compass meadow ranking)").select("eid")


@query(
    index_sql("body") + f", {_lists_sql('NEAR', 8, 'compass', 'meadow')}, {_WALK}, c AS (SELECT count(*) AS df FROM found) "
    + _top_sql(f"SELECT 'q' AS qid, found.eid, {_bm25_sql('found.tf', 'found.len', 'c.df')} AS score FROM found, c, fs", 100)
)
def near_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#NEAR/8(compass meadow)", BM25(), 100)


@query(index_sql("body") + f", {_lists_sql('NEAR', 12, 'compass', 'meadow', 'ranking')}, {_WALK} SELECT eid, tf FROM found")
def near_three_tf(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, "#NEAR/12(compass meadow ranking)").select("eid", F.size("positions").alias("tf"))


@query(index_sql("body") + f", {_lists_sql('WINDOW', 12, 'compass', 'meadow', 'ranking')}, {_WALK} SELECT eid, tf FROM found")
def window_three_tf(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, "#WINDOW/12(compass meadow ranking)").select("eid", F.size("positions").alias("tf"))


@query(index_sql("body") + " SELECT DISTINCT a.eid FROM pos a JOIN pos b ON a.eid = b.eid AND a.term IN ('compass', 'ranking') AND b.term = 'meadow' AND b.pos > a.pos AND b.pos - a.pos <= 5")
def near_syn_nested(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, "#NEAR/5(#SYN(compass ranking) meadow)").select("eid")


@query(
    index_sql("body")
    + ", s AS (SELECT eid, len, count(DISTINCT pos) AS tf FROM pos WHERE term IN ('compass', 'meadow') GROUP BY eid, len), c AS (SELECT count(*) AS df FROM s) "
    + _top_sql(f"SELECT 'q' AS qid, eid, {_bm25_sql('s.tf', 's.len', 'c.df')} AS score FROM s, c, fs", 100)
)
def syn_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#SYN(compass meadow)", BM25(), 100)


# BM25


def _sum_sql(weights: dict[str, float], total: float, n: int, field: str = "body") -> str:
    cases = " ".join(f"WHEN '{t}' THEN {w!r}" for t, w in weights.items())
    inner = f"SELECT 'q' AS qid, eid, sum(CASE term {cases} END * {_bm25_sql()}) / {total!r} AS score FROM post JOIN ts USING (field, term) JOIN fs USING (field) WHERE field = '{field}' AND term IN ({', '.join(repr(t) for t in weights)}) GROUP BY eid"
    return index_sql(field) + " " + _top_sql(inner, n)


@query(_sum_sql({"compass": 1.0, "meadow": 1.0, "ranking": 1.0}, 1.0, 10))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(rank_query("compass meadow ranking", stored(spark, sf, "body"), BM25(), 10))


@query(_sum_sql({"compass": 1.0, "meadow": 1.0}, 1.0, 1000))
def bm25_sum(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#SUM(compass meadow)", BM25())


@query(_sum_sql({"compass": 0.7, "meadow": 0.3}, 1.0, 1000))
def bm25_wsum(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#WSUM(0.7 compass 0.3 meadow)", BM25())


@query(_sum_sql({"compass": 2.0, "meadow": 1.0}, 3.0, 1000))
def bm25_dup_terms_wsum(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#SUM(compass compass meadow)", BM25())


@query(_sum_sql({"compass": 1.0, "meadow": 1.0}, 1.0, 100, "title"))
def bm25_title_field(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf, "#SUM(compass.title meadow.title)", BM25(), 100)


_QUERIES = "qs AS (SELECT qid, qstring FROM (SELECT *, row_number() OVER () AS seq FROM queries) WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY seq DESC) = 1)"
#: tk: every analysed term of every query with its operator, distance, place and weight; qw: those of sums of terms with their factors.
_ASKED = f"""{_QUERIES},
form AS (SELECT qid, s, upper(regexp_extract(s, '^#([A-Za-z]+)', 1)) AS op, try_cast(regexp_extract(s, '^#[A-Za-z]+/(\\d+)', 1) AS INT) AS n FROM (SELECT qid, trim(qstring, ' \t\r\n') AS s FROM qs WHERE qstring IS NOT NULL)),
args AS (SELECT qid, CASE op WHEN '' THEN 'SUM' ELSE op END AS op, n, list_filter(string_split_regex(CASE op WHEN '' THEN s ELSE regexp_extract(s, '\\((.*)\\)', 1) END, '\\s+'), lambda x: x <> '') AS w FROM form),
word AS (SELECT qid, op, n, i, CASE op WHEN 'WSUM' THEN w[2 * i + 1]::DOUBLE ELSE 1.0 END AS weight, CASE op WHEN 'WSUM' THEN w[2 * i + 2] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(CASE op WHEN 'WSUM' THEN len(w) // 2 ELSE len(w) END)) AS i FROM args)),
token AS (SELECT qid, op, n, i, weight, CASE WHEN contains(word, '.') THEN lower(split_part(word, '.', 2)) ELSE 'body' END AS field, regexp_extract_all(lower(split_part(word, '.', 1)), {_TOKEN}) AS ts FROM word),
tk AS (SELECT * FROM (SELECT qid, op, n, i, weight, field, unnest(ts) AS term, unnest(range(len(ts))) AS j FROM token) WHERE term NOT IN ({_STOP})),
size AS (SELECT qid, count(*) AS k FROM tk GROUP BY qid),
flat AS (SELECT tk.*, k FROM tk JOIN size USING (qid) WHERE k = 1 OR op IN ('SUM', 'WSUM')),
times AS (SELECT qid, op, k, field, term, count(*) AS times, sum(weight) AS weight FROM flat GROUP BY ALL),
qw AS (SELECT qid, field, term, CASE WHEN op = 'WSUM' AND k > 1 THEN weight / sum(weight) OVER q WHEN max(times) OVER q > 1 AND count(*) OVER q > 1 THEN times / k WHEN max(times) OVER q > 1 THEN 1.0 ELSE times END AS factor FROM times WINDOW q AS (PARTITION BY qid))"""


def asked_words(spark: SparkSession, sf: str, ix: Index) -> DataFrame:
    """(qid, term): the terms of every query, whatever its structure, as often as it has them."""
    return query_leaves(query_set(spark, sf), ix).select("qid", "term")


def bare_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every query with a text, as plain words."""
    return query_set(spark, sf).filter(F.col("qstring").isNotNull()).select("qid", T.plain_query(F.col("qstring")).alias("qstring"))


_BATCH = (
    index_sql() + f""", {_ASKED},
both_ AS (SELECT qid, n, k, op, field, term, row_number() OVER (PARTITION BY qid ORDER BY i, j) AS a FROM tk JOIN size USING (qid) WHERE k > 1 AND op IN ('NEAR', 'WINDOW', 'AND')),
lists_ AS (SELECT qid, eid, any_value(len) AS len, op AS kind, n, list(positions ORDER BY a) AS x FROM both_ JOIN post USING (field, term) WHERE op <> 'AND' GROUP BY qid, eid, op, n, k HAVING count(*) = k),
{_WALK}, near_df AS (SELECT qid, count(*) AS df FROM found GROUP BY qid), near_field AS (SELECT DISTINCT qid, field FROM both_ WHERE op <> 'AND'),
scored AS (
  SELECT qid, eid, sum(factor * {_bm25_sql()}) AS score FROM qw JOIN post USING (field, term) JOIN ts USING (field, term) JOIN fs USING (field) GROUP BY qid, eid
  UNION ALL SELECT qid, eid, min(tf)::DOUBLE FROM both_ JOIN post USING (field, term) WHERE op = 'AND' GROUP BY qid, eid, k HAVING count(*) = k
  UNION ALL SELECT qid, eid, {_bm25_sql('found.tf', 'found.len', 'near_df.df')} FROM found JOIN near_df USING (qid) JOIN near_field USING (qid) JOIN fs USING (field)) """
)


@query(_BATCH + _top_sql("SELECT qid, eid, score FROM scored", 100))
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The best 100 pages of every query of the query set, whatever its structure, in one plan."""
    return _shown(rank_set(query_set(spark, sf), stored(spark, sf), BM25(), 100, boolean=True))


@query(
    index_sql("body")
    + f""", lists_ AS (
  SELECT 's1' AS qid, a.eid, a.len, 'NEAR' AS kind, 5 AS n, [a.positions, b.positions] AS x FROM post a JOIN post b USING (eid) WHERE a.term = 'compass' AND b.term = 'meadow'
  UNION ALL SELECT 's2', a.eid, a.len, 'WINDOW', 6, [a.positions, b.positions, c.positions] FROM post a JOIN post b USING (eid) JOIN post c USING (eid) WHERE a.term = 'compass' AND b.term = 'meadow' AND c.term = 'ranking'),
{_WALK}, d AS (SELECT qid, count(*) AS df FROM found GROUP BY qid),
syn AS (SELECT eid, len, count(DISTINCT pos) AS tf FROM pos WHERE term IN ('lighthouse', 'falcon') GROUP BY eid, len), c AS (SELECT count(*) AS df FROM syn),
part AS (
  SELECT qid, eid, CASE qid WHEN 's1' THEN 0.6 ELSE 1.0 END * {_bm25_sql('found.tf', 'found.len', 'd.df')} AS score FROM found JOIN d USING (qid), fs
  UNION ALL SELECT 's1', eid, 0.4 * sum({_bm25_sql()}) FROM post JOIN ts USING (field, term) JOIN fs USING (field) WHERE term IN ('ranking', 'catalogue') GROUP BY eid
  UNION ALL SELECT 's2', eid, {_bm25_sql('syn.tf', 'syn.len', 'c.df')} FROM syn, c, fs) """
    + _top_sql("SELECT qid, eid, sum(score) AS score FROM part GROUP BY qid, eid", 50)
)
def bm25_structured_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Three queries with nested and positional operators in one plan."""
    texts = {"s1": "#WSUM(0.6 #NEAR/5(compass meadow) 0.4 #SUM(ranking catalogue))", "s2": "#SUM(#WINDOW/6(compass meadow ranking) #SYN(lighthouse falcon))", "s3": "the of and"}
    return _shown(rank_set(spark.createDataFrame([*texts.items()], "qid string, qstring string"), stored(spark, sf, "body"), BM25(), 50))


@query(index_sql("title") + f", {_ASKED} SELECT qid, field, term, count(*) AS times FROM tk GROUP BY qid, field, term")
def query_terms_of_set(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of every query with their fields."""
    return query_leaves(query_set(spark, sf), index(spark, sf, "title")).groupBy("qid", "field", "term").agg(F.count(F.lit(1)).alias("times"))


# feedback

_RUN20 = "run AS (SELECT qid, eid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, eid) AS rank FROM (SELECT qid, eid, max(score) AS score FROM rankings WHERE runid = 'bm25' AND qid IS NOT NULL AND eid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY qid, eid) QUALIFY rank <= 20)"
_OKAPI = ", raw AS (SELECT qid, term, count(*) * greatest(0.0, ln((num_docs - df + 0.5) / (df + 0.5))) AS weight FROM run JOIN post USING (eid) JOIN ts USING (field, term) JOIN fs USING (field) WHERE rank <= 10 AND NOT regexp_matches(term, '[^\\x00-\\x7F]') GROUP BY qid, term, num_docs, df)"
_RM3 = ", raw AS (SELECT qid, term, sum(tf / poslen * score) * ln(sum_len / ctf) AS weight FROM run JOIN post USING (eid) JOIN ts USING (field, term) JOIN fs USING (field) JOIN lengths l ON l.eid = run.eid AND l.field = post.field WHERE rank <= 10 AND NOT regexp_matches(term, '[^\\x00-\\x7F]') GROUP BY qid, term, sum_len, ctf)"
_BEST_TERMS = " SELECT qid, place::INT AS place, term, round(weight, 6) AS weight FROM (SELECT qid, term, weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) AS place FROM (SELECT qid, term, round(weight, 9) AS weight FROM raw) WHERE weight > 0) WHERE place <= 10"


def _expansion(spark: SparkSession, sf: str, algorithm: str) -> DataFrame:
    found = feedback.expansion_terms(run_ranking(spark, sf), stored(spark, sf, "body"), feedback.Feedback(algorithm))
    return found.withColumn("weight", F.round("weight", 6))


@query(index_sql("body") + f", {_RUN20}" + _OKAPI + _BEST_TERMS)
def prf_okapi_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _expansion(spark, sf, "okapi")


@query(index_sql("body") + f", {_RUN20}" + _RM3 + _BEST_TERMS)
def prf_rm3_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _expansion(spark, sf, "rm3")


@query(
    index_sql("body") + f", {_RUN20}" + _RM3
    + ", best AS (SELECT qid, term, weight FROM (SELECT qid, term, round(weight, 9) AS weight FROM raw) WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) <= 10), share AS (SELECT qid, term, weight / sum(weight) OVER (PARTITION BY qid) AS weight FROM best) "
    + _top_sql(f"SELECT qid, eid, sum(weight * {_bm25_sql()}) AS score FROM share JOIN post USING (term) JOIN ts USING (field, term) JOIN fs USING (field) GROUP BY qid, eid", 10)
)
def prf_expanded_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best pages by the learned queries."""
    ix = stored(spark, sf, "body", positions=False)
    terms = feedback.expansion_terms(run_ranking(spark, sf), ix, feedback.Feedback("rm3"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("qid"))
    learned = terms.select("qid", F.lit("body").alias("field"), "term", share.alias("weight"))
    return _shown(rank_batch(learned, ix, BM25(), 10))


_LEARNED = """, best AS (SELECT qid, term, weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) AS place FROM (SELECT qid, term, round(weight, 9) AS weight FROM raw) WHERE weight > 0 QUALIFY place <= 10),
learned AS (SELECT qid, '#WSUM( ' || string_agg(printf('%.12f', weight) || ' ' || term, ' ' ORDER BY place DESC) || ' )' AS learned FROM best GROUP BY qid)"""


@query(index_sql("body") + f", {_QUERIES}, {_RUN20}" + _RM3 + _LEARNED + " SELECT qid, coalesce('#WSUM( 0.5 #SUM(' || qstring || ') 0.5 ' || learned || ' )', qstring) AS qstring, qstring AS original_qstring FROM qs LEFT JOIN learned USING (qid)")
def prf_expanded_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The query strings after feedback with half of the weight on the original."""
    how = feedback.Feedback("rm3", orig_weight=0.5)
    terms = feedback.expansion_terms(run_ranking(spark, sf), stored(spark, sf, "body"), how)
    return feedback.expanded_queries(terms, query_set(spark, sf), how)


@query(index_sql("body") + f", {_RUN20}" + _RM3 + _LEARNED + " SELECT qid || ': ' || learned AS value FROM learned")
def prf_query_file(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the file of learned queries."""
    how = feedback.Feedback("rm3")
    learned = feedback.learned_queries(feedback.expansion_terms(run_ranking(spark, sf), stored(spark, sf, "body"), how), how)
    path = scratch(spark)
    sinks.write_expanded(learned.withColumnRenamed("learned", "qstring"), path)
    return files.read_lines(spark, path)


# learning to rank

_PAIRS = f"""{_ASKED}, qt AS (SELECT qid, term, count(*) AS times FROM tk GROUP BY qid, term), labels AS (SELECT qid, eid, max(greatest(0, try_cast(rel AS INT)))::INT AS label FROM qrels WHERE try_cast(rel AS INT) IS NOT NULL AND eid IN (SELECT eid FROM recs) AND qid IN (SELECT qid FROM qs WHERE qstring IS NOT NULL) GROUP BY qid, eid)"""


def _features(spark: SparkSession, sf: str, ix: Index | None = None) -> DataFrame:
    ix = ix or stored(spark, sf, "body", "title", "url", "inlink", positions=False)
    return ltr.extract(ltr.training_pairs(bare_queries(spark, sf), table(spark, sf, "qrels"), ix), asked_words(spark, sf, ix), ix)


_FIELDS = [("body", 5), ("title", 8), ("url", 11), ("inlink", 14)]
_FEATURES = (
    index_sql("body", "title", "url", "inlink") + f", {_PAIRS}, tot AS (SELECT qid, sum(times) AS tokens, count(*) AS stems FROM qt GROUP BY qid), "
    """cell AS (
  SELECT p.qid, p.eid, l.field, l.len, l.poslen, q.term, coalesce(q.times, 0) AS times, coalesce(tokens, 0) AS tokens, coalesce(stems, 0) AS stems, coalesce(post.tf, 0) AS tf, df, coalesce(ctf, 0) AS ctf, sum_len, num_docs, avg_len
  FROM labels p JOIN lengths l ON l.eid = p.eid AND l.poslen > 0 JOIN fs ON fs.field = l.field LEFT JOIN qt q ON q.qid = p.qid LEFT JOIN tot ON tot.qid = p.qid
  LEFT JOIN ts ON ts.field = l.field AND ts.term = q.term LEFT JOIN post ON post.field = l.field AND post.term = q.term AND post.eid = p.eid),
agg AS (
  SELECT qid, eid, field, sum(CASE WHEN tf > 0 THEN times * """ + _bm25_sql() + """ ELSE 0 END) AS bm25, sum((tf > 0)::INT)::DOUBLE AS overlap,
    min((tf + 2500.0 * ctf / sum_len) / (len + 2500.0)) AS least, sum(CASE WHEN tf + ctf > 0 THEN times * ln((tf + 2500.0 * ctf / sum_len) / (len + 2500.0)) END) / nullif(max(tokens), 0) AS logs,
    sum(tf * times) / max(poslen) AS density, max(CASE WHEN tf > 0 THEN ln((num_docs + 1) / (df + 0.5)) ELSE 0 END) AS max_idf, CASE WHEN max(stems) > 0 THEN sum((tf > 0)::INT) / max(stems) ELSE 0.0 END AS coverage,
    sum(CASE WHEN tf > 0 THEN tf * times * ln((num_docs + 1) / (df + 0.5)) ELSE 0 END) AS tfidf
  FROM cell GROUP BY qid, eid, field),
wide AS (SELECT qid, eid, """
    + ", ".join(f"max(CASE WHEN field = '{f}' THEN round(bm25, 6) END) AS f{i}, max(CASE WHEN field = '{f}' THEN round(CASE WHEN overlap > 0 AND least > 0 THEN exp(logs) ELSE 0 END, 6) END) AS f{i + 1}, max(CASE WHEN field = '{f}' THEN overlap END) AS f{i + 2}" for f, i in _FIELDS)
    + """, max(CASE WHEN field = 'body' THEN round(density, 6) END) AS f17, max(CASE WHEN field = 'body' THEN round(max_idf, 6) END) AS f18, max(CASE WHEN field = 'title' THEN round(coverage, 6) END) AS f19, max(CASE WHEN field = 'body' THEN round(tfidf, 6) END) AS f20
  FROM agg GROUP BY qid, eid)"""
)
_DOC_FEATURES = "spam_score AS f1, CASE WHEN length(raw_url) > 0 THEN length(raw_url) - length(replace(raw_url, '/', '')) END::DOUBLE AS f2, CASE WHEN contains(lower(coalesce(raw_url, '')), 'wikipedia.org') THEN 1.0 ELSE 0.0 END::DOUBLE AS f3, page_rank AS f4"
_ALL = ", ".join(f"f{i}" for i in range(5, 21))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("qid", "eid", "label", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(1, 21)])


@query(_FEATURES + f" SELECT l.qid, l.eid, l.label, {_DOC_FEATURES}, {_ALL} FROM labels l JOIN recs USING (eid) LEFT JOIN wide ON wide.qid = l.qid AND wide.eid = l.eid")
def ltr_features(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 features of every judged page of any query."""
    return _rounded(_features(spark, sf))


@query(
    _FEATURES + f", f AS (SELECT l.qid, l.eid, l.label, {_DOC_FEATURES}, {_ALL} FROM labels l JOIN recs USING (eid) LEFT JOIN wide ON wide.qid = l.qid AND wide.eid = l.eid) SELECT qid, eid, label, "
    + ", ".join(f"CASE WHEN f{i} IS NULL THEN NULL WHEN max(f{i}) OVER q > min(f{i}) OVER q THEN round((f{i} - min(f{i}) OVER q) / (max(f{i}) OVER q - min(f{i}) OVER q), 4) ELSE 0.0 END AS f{i}" for i in range(1, 21))
    + " FROM f WINDOW q AS (PARTITION BY qid)"
)
def ltr_minmax(spark: SparkSession, sf: str) -> DataFrame:
    """The features scaled within their query."""
    scaled = ltr.min_max(_rounded(_features(spark, sf)), ltr.Features().ids)
    return scaled.select("qid", "eid", "label", *[F.round(f"f{i}", 4).alias(f"f{i}") for i in range(1, 21)])


@query(f"WITH {_RECS}, {_PAIRS} SELECT qid, eid, label FROM labels")
def ltr_train_join(spark: SparkSession, sf: str) -> DataFrame:
    return ltr.training_pairs(bare_queries(spark, sf), table(spark, sf, "qrels"), index(spark, sf, "title"))


#: A linear ranker with fixed weights, so that the SQL knows it; ltr_trained trains one.
FIXED_RANKER = ltr.LinearRanker((5, 6, 8, 10, 17, 18), (0.5, 0.25, 0.75, 0.125, 1.5, 0.0625))
_HEAD_FEATURES = _FEATURES.replace(_PAIRS, f"{_PAIRS.replace('labels AS', 'judged AS')}, {_RUN20}, labels AS (SELECT qid, eid FROM run WHERE rank <= 10)")


def _head_features(spark: SparkSession, sf: str, run: DataFrame, ix: Index | None = None) -> DataFrame:
    ix = ix or stored(spark, sf, "body", "title", "url", "inlink", positions=False)
    return ltr.extract(run.filter(F.col("rank") <= 10).select("qid", "eid"), asked_words(spark, sf, ix), ix)


@query(
    _HEAD_FEATURES + f""", new AS (SELECT run.qid, run.eid, rank, score, round({' + '.join(f'coalesce(round(f{i}, 6), 0.0) * {w!r}' for i, w in zip(FIXED_RANKER.ids, FIXED_RANKER.weights))}, 9) AS new, rank <= 10 AS head FROM run LEFT JOIN wide USING (qid, eid)),
low AS (SELECT qid, min(CASE WHEN head THEN new END) AS low, max(CASE WHEN NOT head THEN score END) AS high FROM new GROUP BY qid)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY head DESC, CASE WHEN head THEN new END DESC, rank)::INT AS rank, eid, round(CASE WHEN head THEN new ELSE score - greatest(0.0, coalesce(high + 0.1 - low, 0.0)) END + {TIE}, 6) AS score FROM new JOIN low USING (qid)"""
)
def ltr_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """A run with its first ten pages in the order of a ranker with fixed weights."""
    run = run_ranking(spark, sf)
    feats = _head_features(spark, sf, run)
    feats = feats.select("qid", "eid", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in FIXED_RANKER.ids])
    return _shown(ltr.rerank(run, feats, FIXED_RANKER, 10))


@query()
def ltr_trained(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a model trained on the judgements."""
    how, run, ix = ltr.Features(), run_ranking(spark, sf), stored(spark, sf, "body", "title", "url", "inlink", positions=False)
    model = ltr.fit_pairwise(ltr.min_max(_features(spark, sf, ix), how.ids), how.ids)
    return _shown(ltr.rerank(run, ltr.min_max(_head_features(spark, sf, run, ix), how.ids), model, 10))


@query(
    _FEATURES + f""", f AS (SELECT l.qid, l.eid, l.label, {_DOC_FEATURES}, {_ALL} FROM labels l JOIN recs USING (eid) LEFT JOIN wide ON wide.qid = l.qid AND wide.eid = l.eid)
SELECT label || ' qid:' || qid || ' ' || {" || ' ' || ".join(f"'{i}:' || printf('%.9f', coalesce(round(f{i}, 6), 0.0))" for i in range(1, 21))} || ' # ' || eid AS value FROM f"""
)
def ltr_feature_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the file of feature vectors."""
    path = scratch(spark)
    sinks.write_features(ltr.feature_lines(_rounded(_features(spark, sf)), ltr.Features().ids), path)
    return files.read_lines(spark, path)


# passages

_WORDS = "list_filter(string_split_regex(coalesce({c}, ''), '[\\s\\x{{0b}}\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')"
_PSG = f"""w AS (SELECT eid, {_WORDS.format(c='body_string')} AS w, array_to_string({_WORDS.format(c='title_string')}[1:6], ' ') AS t FROM recs),
n AS (SELECT *, CASE WHEN len(w) > 0 THEN least(1 + ceil(greatest(len(w) - 60, 0) / 30), ceil(len(w) / 30))::INT ELSE 0 END AS k FROM w),
psg AS (
  SELECT eid, i AS psg_no, trim(concat_ws(' ', t, array_to_string(w[i * 30 + 1 : i * 30 + 60], ' ')), ' ') AS text FROM (SELECT *, unnest(range(k)) AS i FROM n)
  UNION ALL SELECT eid, 0, t FROM n WHERE k = 0 AND t <> '')"""


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.passages(docs(spark, sf), "eid", "body_string", "title_string", 60, 30, None, 6)


@query(f"WITH {_RECS}, {_PSG} SELECT eid, psg_no::INT AS psg_no, text FROM psg")
def passage_windows(spark: SparkSession, sf: str) -> DataFrame:
    """All windows of each body."""
    return _passages(spark, sf)


_SCORED = f"""{_PSG}, {_ASKED}, {_RUN20}, pq AS (SELECT qs.qid, coalesce(list_distinct(list(term) FILTER (WHERE term IS NOT NULL)), []) AS q FROM qs LEFT JOIN tk ON tk.qid = qs.qid WHERE qstring IS NOT NULL GROUP BY qs.qid),
head AS (SELECT qid, eid, rank FROM run SEMI JOIN pq USING (qid) WHERE rank <= 10),
scored AS (SELECT qid, eid, rank, psg_no, text, CASE WHEN len(q) > 0 THEN len(list_intersect(q, regexp_extract_all(lower(text), {_TOKEN}))) / len(q) ELSE 0.0 END AS score FROM head JOIN psg USING (eid) JOIN pq USING (qid))"""


def _head(spark: SparkSession, sf: str, aggregation: str) -> tuple[DataFrame, DataFrame]:
    """The runs of all queries and their heads, scored over whole bodies."""
    asked, a = bare_queries(spark, sf), T.Analyzer()
    run = run_ranking(spark, sf).join(asked.select("qid"), "qid", "left_semi")
    return run, passages.score_head(run, asked, _passages(spark, sf), lambda q, t: passages.overlap_score(q, t, a), 10, aggregation)


def _scores_only(head: DataFrame) -> DataFrame:
    return head.filter(F.col("score") > float("-inf")).select("qid", "eid", F.round("score", 6).alias("score"))


@query(f"WITH {_RECS}, {_SCORED} SELECT qid, eid, round(arg_min(score, psg_no), 6) AS score FROM scored GROUP BY qid, eid")
def rerank_firstp(spark: SparkSession, sf: str) -> DataFrame:
    return _scores_only(_head(spark, sf, "firstp")[1])


@query(f"WITH {_RECS}, {_SCORED} SELECT qid, eid, round(avg(score), 6) AS score FROM scored GROUP BY qid, eid")
def rerank_avgp(spark: SparkSession, sf: str) -> DataFrame:
    return _scores_only(_head(spark, sf, "avgp")[1])


@query(f"WITH {_RECS}, {_SCORED} SELECT qid, eid, round(max(score), 6) AS score FROM scored GROUP BY qid, eid")
def rerank_maxp(spark: SparkSession, sf: str) -> DataFrame:
    return _scores_only(_head(spark, sf, "maxp")[1])


@query(f"WITH {_RECS}, {_SCORED} SELECT qid, eid, eid || '.0 ' || text AS value FROM scored QUALIFY row_number() OVER (PARTITION BY qid, eid ORDER BY score DESC, psg_no) = 1")
def top_passage(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.passage_lines(_head(spark, sf, "maxp")[1])


@query(
    f"""WITH {_RECS}, {_SCORED}, best AS (SELECT qid, eid, max(score) AS score FROM scored GROUP BY qid, eid),
mine AS (SELECT run.*, coalesce(best.score, '-infinity'::DOUBLE) AS new FROM run SEMI JOIN pq USING (qid) LEFT JOIN best USING (qid, eid)),
low AS (SELECT qid, min(CASE WHEN rank <= 10 AND new > '-infinity'::DOUBLE THEN new END) AS low, max(CASE WHEN rank = 11 THEN score END) AS high FROM mine GROUP BY qid)
SELECT qid, CASE WHEN rank <= 10 THEN row_number() OVER (PARTITION BY qid, rank <= 10 ORDER BY new DESC, eid) ELSE rank END::INT AS rank, eid,
  round(CASE WHEN rank <= 10 THEN new ELSE score - greatest(0.0, coalesce(high + 0.1 - low, 0.0)) END + {TIE}, 6) AS score FROM mine JOIN low USING (qid)"""
)
def rerank_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A run with its first ten pages re-ranked by their best passage."""
    run, head = _head(spark, sf, "maxp")
    return _shown(passages.merge_head(run, head, 10))


# dense retrieval and answers


@query(
    """WITH good AS (SELECT vec_id::VARCHAR AS qid, list_transform(query_vector, lambda x: x::DOUBLE) AS v FROM query_vectors WHERE vec_id % 100 = 0 AND len(query_vector) = 64 AND len(list_filter(query_vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
pages AS (SELECT eid, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)
SELECT qid, rank::INT AS rank, eid, round(score + 1e-10, 6) AS score FROM (SELECT qid, eid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, eid) AS rank FROM (SELECT qid, eid, round(list_dot_product(v, e), 9) AS score FROM good, pages)) WHERE rank <= 10"""
)
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best pages for every query vector whose id is divisible by 100."""
    asked = table(spark, sf, "query_vectors").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "query_vector")
    return _shown(dense.dense_topk(asked, files.read_vectors(spark, f"{sf}/vectors.parquet"), 10, 64))


def _best(spark: SparkSession, sf: str) -> DataFrame:
    asked, a = bare_queries(spark, sf), T.Analyzer()
    pairs = run_ranking(spark, sf).filter(F.col("rank") <= 3).select("qid", "eid", "rank").join(_passages(spark, sf), "eid").join(asked, "qid")
    return answers.best_passages(pairs.withColumn("score", passages.overlap_score(F.col("qstring"), F.col("text"), a)))


_BEST = f"WITH {_RECS}, {_SCORED}, best AS (SELECT qid, eid, rank, text FROM scored WHERE rank <= 3 QUALIFY row_number() OVER (PARTITION BY qid, eid ORDER BY score DESC, psg_no) = 1)"


@query(_BEST + " SELECT qid, eid, rank::INT AS rank, text FROM best")
def rag_best_passage(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf)


@query(_BEST + " SELECT qid, string_agg(trim(text, ' '), ' ' ORDER BY rank) AS context FROM best GROUP BY qid")
def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    return answers.contexts(_best(spark, sf))


#: bare: every query as plain words; told: with its context.
_TOLD = _BEST + """, bare AS (SELECT qs.qid, CASE WHEN regexp_matches(qstring, '[#()]') THEN coalesce(string_agg(CASE WHEN regexp_matches(word, '(?i).\\.(body|title|url|keywords|inlink)$') THEN regexp_replace(word, '\\.[^.]*$', '') ELSE word END, ' ' ORDER BY i), '')
  ELSE array_to_string(list_filter(string_split_regex(qstring, '\\s+'), lambda x: x <> ''), ' ') END AS q FROM qs LEFT JOIN word ON word.qid = qs.qid WHERE qstring IS NOT NULL GROUP BY qs.qid, qstring),
told AS (SELECT bare.qid, q, coalesce(string_agg(trim(text, ' '), ' ' ORDER BY rank) FILTER (WHERE trim(text, ' ') <> ''), '') AS context FROM bare LEFT JOIN best ON best.qid = bare.qid GROUP BY bare.qid, q)"""


@query(
    _TOLD + """ SELECT qid, '[{"role":"authorize","email":"","code":""}, ' || to_json({'role': 'system', 'content': '""" + answers.PROMPTS[2][0].replace("'", "''")
    + """'}) || ', ' || to_json({'role': 'user', 'content': 'Question: ' || trim(q, ' ') || chr(10) || 'Context: ' || trim(context, ' ') || chr(10) || '""" + answers.PROMPTS[2][2] + """' || chr(10) || 'Answer: '}) || ']' AS prompt FROM told"""
)
def rag_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return answers.answers(bare_queries(spark, sf), answers.contexts(_best(spark, sf)), 2).select("qid", "prompt")


@query(
    _TOLD + """ SELECT qid, trim(array_to_string(list_filter(string_split(CASE WHEN regexp_matches(c, '[.!?]\\s') THEN regexp_extract(c, '^(.*?[.!?])\\s', 1) ELSE c END, ' '), lambda x: x <> '')[1:8], ' '), ' ,;:.') AS answer
FROM (SELECT qid, trim(regexp_replace(context, '\\s+', ' ', 'g')) AS c FROM told)"""
)
def rag_fallback_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Answers without a model: taken from the passages. None of the queries asks what a pattern answers."""
    return answers.answers(bare_queries(spark, sf), answers.contexts(_best(spark, sf))).select("qid", "answer")


# text functions of the query and answer stages


@query(_TOLD + " SELECT qid, q FROM bare")
def plain_query_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every query as plain words."""
    return bare_queries(spark, sf).withColumnRenamed("qstring", "q")


@query(f"WITH {_QUERIES} SELECT qid, CASE WHEN starts_with(qstring, '#') THEN regexp_replace(qstring, '(\\w+)\\.\\w+', '\\1', 'g') ELSE qstring END AS q FROM qs WHERE qstring IS NOT NULL")
def field_suffix_strip(spark: SparkSession, sf: str) -> DataFrame:
    return query_set(spark, sf).filter("qstring IS NOT NULL").select("qid", T.strip_any_suffix(F.col("qstring")).alias("q"))


@query(
    f"WITH {_ASKED} SELECT form.qid, array_to_string(list_transform(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> ''), "
    "lambda x: CASE WHEN regexp_matches(x, '(?i).\\.(body|title|url|keywords|inlink)$') THEN regexp_replace(x, '\\.[^.]*$', '') ELSE x END), ' ') AS q FROM form"
)
def known_suffix_strip(spark: SparkSession, sf: str) -> DataFrame:
    return query_set(spark, sf).filter("qstring IS NOT NULL").select("qid", T.strip_field_suffix(F.col("qstring")).alias("q"))


@query(
    f"WITH {_QUERIES}, s AS (SELECT qid, trim(qstring, ' \t\r\n') AS s FROM qs WHERE qstring IS NOT NULL AND regexp_matches(qstring, '(?i)^\\s*(#w?sum\\s*\\([^#()]*\\)|[^#()]*)\\s*$')), "
    "w AS (SELECT qid, s, list_filter(string_split_regex(regexp_extract(s, '\\((.*)\\)', 1), '\\s+'), lambda x: x <> '') AS w FROM s) "
    "SELECT qid, CASE WHEN NOT starts_with(s, '#') THEN s WHEN starts_with(lower(s), '#wsum') THEN array_to_string(list_transform(range(2, len(w) + 1, 2), lambda i: w[i]), ' ') ELSE array_to_string(w, ' ') END AS q FROM w"
)
def bag_of_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words of plain queries and of single sums; other structures are no bag of words."""
    rows = query_set(spark, sf).filter(F.col("qstring").rlike(r"(?i)^\s*(#w?sum\s*\([^#()]*\)|[^#()]*)\s*$"))
    return rows.select("qid", bag_words(F.btrim("qstring", F.lit(" \t\r\n"))).alias("q"))


@query("SELECT eid, replace(replace(trim(regexp_replace(body_string, '[ \\t\\n\\r\\x{0b}\\f\\x{85}\\p{Z}]+', ' ', 'g'), ' '), chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) AS body FROM docs")
def response_escaping(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "docs").select("eid", T.escape_response(F.col("body_string")).alias("body"))


@query("SELECT doc_id, trim(coalesce(text, ''), ' \t\r\n') = '' OR regexp_matches(lower(trim(coalesce(text, ''), ' \t\r\n')), '^(authorization failed|exception::)') AS needed FROM documents")
def fallback_needed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.needs_fallback(F.col("text")).alias("needed"))


_STOPPED = "|".join(T.CANDIDATE_STOPS)


@query(
    "WITH c AS (SELECT eid, trim(regexp_replace(regexp_extract(title_string, '^[^.;,()\\[\\]\\n]*'), '[ \\t\\n\\r\\x{0b}\\f\\x{85}\\p{Z}]+', ' ', 'g'), ' ') AS c FROM docs WHERE title_string IS NOT NULL) "
    f"SELECT eid, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(c, '(?i)^(?:(?:{_STOPPED})(?:\\s+|$))+', ''), '(?i)(?:(?:^|\\s+)(?:{_STOPPED}))+$', ''), ' '), lambda x: x <> '')[1:6], ' ') AS candidate FROM c"
)
def clean_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Titles as answer candidates."""
    return table(spark, sf, "docs").filter("title_string IS NOT NULL").select("eid", T.clean_candidate(F.col("title_string")).alias("candidate"))


# files


@query(f"WITH {_QUERIES}, {_RUN20} SELECT qs.qid, coalesce(rank, 1)::INT AS rank, coalesce(eid, 'Nonexistent_Docid') AS eid, round(coalesce(score, 0.0) + {TIE}, 6) AS score FROM qs LEFT JOIN (SELECT * FROM run WHERE rank <= 5) r ON r.qid = qs.qid")
def trec_run(spark: SparkSession, sf: str) -> DataFrame:
    """Run rows of five pages a query, with a row for queries without any."""
    return _shown(sinks.run_rows(query_set(spark, sf), run_ranking(spark, sf), 5))


@query(f"WITH {_QUERIES} SELECT qid, coalesce(qstring, '') AS answer FROM qs")
def qa_answers(spark: SparkSession, sf: str) -> DataFrame:
    asked = query_set(spark, sf)
    return sinks.qa_answers(asked, asked.filter("qstring IS NOT NULL").select("qid", F.col("qstring").alias("answer")))


RUNS = ("bm25", "dense", "ltr", "rankedboolean")


@query(
    "WITH m AS (SELECT runid, qid, count(*)::VARCHAR AS value FROM rankings WHERE qid IS NOT NULL GROUP BY runid, qid) SELECT 'rows' AS metric, qid, "
    + ", ".join(f"max(CASE WHEN runid = '{r}' THEN value END) AS {r}" for r in RUNS)
    + " FROM m GROUP BY qid"
)
def te2csv_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluator-like values of all runs side by side."""
    rows = table(spark, sf, "rankings").filter("qid IS NOT NULL").groupBy(F.col("runid").alias("file"), "qid").agg(F.count(F.lit(1)).cast("string").alias("value"))
    return sinks.evaluation_table(rows.withColumn("metric", F.lit("rows")), list(RUNS))


@query("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank, eid)::INT AS rank, eid FROM (SELECT DISTINCT qid, rank, eid FROM rankings WHERE runid = 'dense' AND rank IS NOT NULL AND eid IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, eid) <= 50")
def run_file_rank(spark: SparkSession, sf: str) -> DataFrame:
    """A run in the order of its own ranks, the first 50 of a query."""
    rows = table(spark, sf, "rankings").filter((F.col("runid") == "dense") & F.col("rank").isNotNull() & F.col("eid").isNotNull()).select("qid", "rank", "eid").distinct()
    return files.ranked_from_run(rows, 50).select("qid", "rank", "eid")


#: Finite scores of all runs, in the order of a file: of each query one stretch.
_RUN_LINES = "run AS (SELECT qid, eid, score, runid, row_number() OVER (PARTITION BY qid ORDER BY runid, rank, eid, score)::INT AS rank FROM rankings WHERE qid IS NOT NULL AND eid IS NOT NULL AND rank IS NOT NULL AND score IS NOT NULL AND isfinite(score))"


def _written(lines: DataFrame, *order: str) -> str:
    """The path of a text file of the lines (column value) in order."""
    path = scratch(lines.sparkSession)
    lines.orderBy(*order).select("value").coalesce(1).write.text(path)
    return path


@query(f"WITH {_RUN_LINES} SELECT qid, rank, eid, score, runid FROM run")
def run_file(spark: SparkSession, sf: str) -> DataFrame:
    """A run file written and read again."""
    rows = table(spark, sf, "rankings").filter("qid IS NOT NULL AND eid IS NOT NULL AND rank IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return files.read_run(spark, _written(rows.withColumn("value", F.concat_ws(" ", "qid", F.lit("Q0"), "eid", "rank", "score", "runid")), "qid", "runid", "rank", "eid", "score"))


@query(f"WITH {_QUERIES} SELECT qid, trim(coalesce(qstring, ''), ' ') AS qstring FROM qs")
def query_file(spark: SparkSession, sf: str) -> DataFrame:
    """A query file written and read again; of a repeated qid the later line holds."""
    rows = table(spark, sf, "queries").filter("qid IS NOT NULL").withColumns({"at": F.col("_metadata.row_index"), "value": F.concat("qid", F.lit(": "), F.coalesce("qstring", F.lit("")))})
    return files.read_queries(spark, _written(rows, "at"))


@query("SELECT qid, coalesce(nullif(ignored, ''), '0') AS ignored, eid, trim(rel) AS rel FROM qrels WHERE qid IS NOT NULL AND eid IS NOT NULL AND trim(coalesce(rel, '')) <> ''")
def qrels_file(spark: SparkSession, sf: str) -> DataFrame:
    """A judgement file written and read again; lines without a label are skipped."""
    rows = table(spark, sf, "qrels").filter("qid IS NOT NULL AND eid IS NOT NULL").withColumn("value", F.concat_ws(" ", "qid", F.coalesce(F.nullif("ignored", F.lit("")), F.lit("0")), "eid", "rel"))
    return files.read_qrels(spark, _written(rows, "qid", "eid"))


@query(f"WITH {_RUN_LINES} SELECT score FROM run")
def prediction_file(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as a learner's predictions: the last word of each line."""
    rows = table(spark, sf, "rankings").filter("qid IS NOT NULL AND eid IS NOT NULL AND rank IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return files.read_predictions(spark, _written(rows.withColumn("value", F.concat_ws("\t", "qid", "rank", "score")), "qid", "rank")).select("score")


@query("SELECT runid || '.teOut' AS file, 'rows' AS metric, qid, count(*)::VARCHAR AS value FROM rankings WHERE qid IS NOT NULL AND runid IS NOT NULL GROUP BY runid, qid")
def evaluation_files(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluator outputs of all runs, a file each, read together."""
    counts = table(spark, sf, "rankings").filter("qid IS NOT NULL AND runid IS NOT NULL").groupBy("runid", "qid").agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark)
    counts.select(F.concat("runid", F.lit(".teOut")).alias("name"), F.concat_ws(" ", F.lit("rows"), "qid", "n").alias("value")).write.partitionBy("name").text(path)
    read = files.read_evaluation(spark, [f"{path}/name={r}.teOut" for r in RUNS])
    return read.withColumn("file", F.regexp_extract("path", r"name=([^/]+)/", 1)).select("file", "metric", "qid", "value")


@query(f"WITH {_QUERIES}, {_RUN20} SELECT qs.qid || ' Q0 ' || coalesce(eid, 'Nonexistent_Docid') || ' ' || coalesce(rank, 1) || ' ' || printf('%.12f', coalesce(score, 0.0)) || ' reference' AS value FROM qs LEFT JOIN (SELECT * FROM run WHERE rank <= 5) r ON r.qid = qs.qid")
def trec_run_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a written run."""
    path = scratch(spark)
    sinks.write_run(query_set(spark, sf), run_ranking(spark, sf), 5, path)
    return files.read_lines(spark, path)


@query(f"WITH {_QUERIES} SELECT qid, row_number() OVER (ORDER BY try_cast(qid AS BIGINT) NULLS LAST, try_cast(qid AS DOUBLE) NULLS LAST, qid) AS place FROM qs")
def qid_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the qids in written files."""
    return query_set(spark, sf).select("qid", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*sinks.qid_order())).alias("place"))


@query(index_sql() + " SELECT field, num_docs, doc_count, sum_len, round(avg_len, 6) AS avg_len FROM fs")
def opened_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of an index that was written and opened."""
    return inspection.list_stats(_opened(spark, sf)).withColumn("avg_len", F.round("avg_len", 6))


@query(_sum_sql({"compass": 1.0, "meadow": 1.0}, 1.0, 1000))
def opened_index_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking over an index that was written and opened."""
    return _shown(rank_query("#SUM(compass meadow)", _opened(spark, sf, "body"), BM25()))


@query(index_sql("body") + f", {_RUN20}" + _RM3 + _BEST_TERMS)
def opened_index_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Expansion terms from an opened index: the buckets of the runs' documents are read."""
    return feedback.expansion_terms(run_ranking(spark, sf), _opened(spark, sf, "body"), feedback.Feedback("rm3")).withColumn("weight", F.round("weight", 6))


@query(index_sql() + " SELECT field, term, tf, array_to_string(positions, ' ') AS positions FROM post WHERE eid = (SELECT min(eid) FROM docs)")
def opened_index_termvector(spark: SparkSession, sf: str) -> DataFrame:
    """A term vector from one bucket of an opened index."""
    found = inspection.list_termvector(_opened(spark, sf), _first_eid(spark, sf))
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


def _opened(spark: SparkSession, sf: str, *fields: str) -> Index:
    path = scratch(spark)
    index(spark, sf, *fields).write(path)
    return open_index(spark, path)


@query(f"WITH {_RECS} SELECT iid, eid FROM (SELECT row_number() OVER (ORDER BY eid) - 1 AS iid, eid FROM recs) WHERE iid IN (0, 7)")
def docid_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """An internal id of an external one and back."""
    ix = _opened(spark, sf, "title")
    return inspection.to_iid(ix, _first_eid(spark, sf)).unionByName(inspection.to_eid(ix, 7))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
