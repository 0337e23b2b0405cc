"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.boilerplate import page_lines
from gleanery.llm.distinctive import term_weights
from gleanery.llm.frequency import frequencies, marks
from gleanery.llm.language import label_languages
from gleanery.llm.leakage import leaked_items
from gleanery.llm.mixing import Mix, mix_sources
from gleanery.llm.neighbours import nearest_units, nearest_vectors
from gleanery.llm.outranking import INDIFFERENCE, PREFERENCE, net_flow
from gleanery.llm.splitting import split_oversized
from gleanery.llm.topn import top_n_per_group
from gleanery.operators.dense import dense_topk
from gleanery.operators.scale import heavy_keys, heavy_limit, latest, materialise, split_by

RUNS = ["bm25", "rankedboolean", "dense", "ltr"]
CRITERIA = [*RUNS, "page_rank"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 1: most similar vectors


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_vectors(table(spark, sf, "query_vectors"), "vec_id", "query_vector")


def p1_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest of every vector."""
    near = neighbours(spark, sf)
    return near.select(F.col("id").alias("vec_id"), "place", F.col("other_id").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of vectors with cosine of at least 0.92."""
    near = neighbours(spark, sf).filter(F.col("cosine") >= 0.92)
    return near.select(F.least("id", "other_id").alias("vec_id_a"), F.greatest("id", "other_id").alias("vec_id_b")).distinct()


P1_FOUND = """
WITH good AS (
  SELECT vec_id, list_transform(query_vector, lambda x: x::DOUBLE) AS v FROM query_vectors
  WHERE len(query_vector) = 64 AND len(list_filter(query_vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(query_vector, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM good a JOIN good b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.v, b.v) >= 0.92"""


def p1_recall(spark: SparkSession, sf: str) -> DataFrame:
    """For every vector whose id is divisible by 100: how many of its true ten nearest, found by comparing it with all vectors, the operator has."""
    good = nearest_units(table(spark, sf, "query_vectors"), "vec_id", "query_vector").select(F.col("id"), "v")
    asked = good.filter(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("v").alias("query_vector"))
    true = dense_topk(asked, good.select(F.col("id").alias("eid"), F.col("v").alias("embedding")), 11, 64).filter(F.col("qid") != F.col("eid"))
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "eid"))).filter(F.col("n") <= 10)
    last = true.groupBy(F.col("qid").cast("long").alias("id")).agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("neighbours"))
    near = neighbours(spark, sf).filter(F.col("id") % 100 == 0)
    found = last.join(near, "id", "left").groupBy(F.col("id").alias("vec_id"), "neighbours").agg(F.count_if(F.col("cosine") >= F.col("last") - 1e-6).alias("found"))
    return found.select("vec_id", "neighbours", "found")


P1_RECALL = """
WITH good AS (
  SELECT vec_id FROM query_vectors WHERE len(query_vector) = 64 AND len(list_filter(query_vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(query_vector, lambda x: x <> 0)) > 0)
SELECT vec_id, least(10, (SELECT count(*) FROM good) - 1) AS neighbours, least(10, (SELECT count(*) FROM good) - 1) AS found FROM good WHERE vec_id % 100 = 0"""

# 2: one ranking from several scores


def flows(spark: SparkSession, sf: str, ranked: bool = True) -> DataFrame:
    """Net flow of each qid's candidates over the four runs' scores and page_rank."""
    rows = table(spark, sf, "rankings").select("qid", "eid", "runid", F.col("score").cast("double").alias("score")).filter(F.col("eid").isNotNull())
    good = F.when(F.col("score").isNotNull() & ~F.isnan("score"), F.col("score"))
    wide = materialise(rows.groupBy("qid", "eid").agg(*[F.max(F.when(F.col("runid") == r, good)).alias(r) for r in RUNS]))
    pages = latest(table(spark, sf, "docs"), "eid", "crawled_at", ["page_rank"])
    # a page that is a candidate of very many queries is met where its rows lie
    heavy = heavy_keys(wide, ["eid"], heavy_limit(wide.count(), spark))
    if heavy is None:
        met = wide.join(pages, "eid", "left")
    else:
        hot, cold = split_by(wide, heavy, ["eid"])
        met = hot.drop("rows_in_group").join(F.broadcast(pages.join(F.broadcast(heavy.select("eid")), "eid")), "eid", "left").unionByName(cold.join(pages, "eid", "left"))
    return net_flow(materialise(met), "qid", "eid", CRITERIA, ranked=ranked)


def p2_net_flow(spark: SparkSession, sf: str) -> DataFrame:
    """The combined ranking of every qid."""
    return flows(spark, sf).select("qid", "rank", "eid", F.round("net", 6).alias("net"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates among the best three by each of the five scores.

    Others are preferred to such a candidate with a strength of at most two in all by any score (half a point more leaves room for
    the rounding of long sums), and few candidates come so far; their places decide.
    """
    best = flows(spark, sf, ranked=False)
    for i in range(1, len(CRITERIA) + 1):
        best = best.filter((F.col(f"minus_{i}") <= 2.5) & (F.col(f"place_{i}") <= 3))
    return best.select("qid", "eid")


_P2_LONG = """
WITH good AS (SELECT qid, eid, runid, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM rankings WHERE eid IS NOT NULL),
cand AS (SELECT DISTINCT qid, eid FROM good),
pages AS (SELECT eid, page_rank FROM (SELECT eid, page_rank, row_number() OVER (PARTITION BY eid ORDER BY crawled_at DESC, page_rank) AS n FROM docs WHERE eid IS NOT NULL) WHERE n = 1 AND page_rank IS NOT NULL AND NOT isnan(page_rank)),
long AS (
  SELECT qid, eid, runid AS c, max(score) AS value FROM good WHERE score IS NOT NULL AND runid IN ('bm25', 'rankedboolean', 'dense', 'ltr') GROUP BY ALL
  UNION ALL SELECT qid, eid, 'page_rank', page_rank FROM cand JOIN pages USING (eid))"""
P2_FOUND = (
    _P2_LONG
    + """, placed AS (SELECT qid, eid, row_number() OVER (PARTITION BY qid, c ORDER BY value DESC, eid) AS place FROM long)
SELECT qid, eid FROM placed WHERE place <= 3 GROUP BY qid, eid HAVING count(*) = 5"""
)
P2_NET_FLOW = (
    _P2_LONG
    + f""", pct AS (
  SELECT qid, c, eid, n, (below + upto) / (2.0 * n) AS x FROM (
    SELECT qid, c, eid, count(*) OVER k AS n, rank() OVER (PARTITION BY qid, c ORDER BY value) - 1 AS below,
      count(*) OVER (PARTITION BY qid, c ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM long WINDOW k AS (PARTITION BY qid, c))),
sums AS (
  SELECT *, count(*) OVER a AS c1, coalesce(sum(x) OVER a, 0) AS s1, count(*) OVER b AS c2, coalesce(sum(x) OVER b, 0) AS s2,
    count(*) OVER c_ AS c3, coalesce(sum(x) OVER c_, 0) AS s3, count(*) OVER d AS c4, coalesce(sum(x) OVER d, 0) AS s4
  FROM pct WINDOW
    a AS (PARTITION BY qid, c ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND {PREFERENCE}::DOUBLE PRECEDING),
    b AS (PARTITION BY qid, c ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND {INDIFFERENCE}::DOUBLE PRECEDING),
    c_ AS (PARTITION BY qid, c ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND {INDIFFERENCE}::DOUBLE FOLLOWING),
    d AS (PARTITION BY qid, c ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND {PREFERENCE}::DOUBLE FOLLOWING)),
flow AS (
  SELECT qid, eid, CASE WHEN n > 1 THEN (c1 + ((c2 - c1) * (x - {INDIFFERENCE}) - (s2 - s1)) / ({PREFERENCE} - {INDIFFERENCE})
    - (n - c4) - ((s4 - s3) - (c4 - c3) * (x + {INDIFFERENCE})) / ({PREFERENCE} - {INDIFFERENCE})) / (n - 1) ELSE 0 END AS f FROM sums),
net AS (
  SELECT cand.qid AS qid, cand.eid AS eid, round(coalesce(sum(f), 0) / 5, 9) + 0.0 AS net
  FROM cand LEFT JOIN flow ON cand.qid IS NOT DISTINCT FROM flow.qid AND cand.eid = flow.eid GROUP BY cand.qid, cand.eid)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY net DESC, eid) AS rank, eid, round(net, 6) AS net FROM net"""
)

# 3: top N within groups


def top_pages(spark: SparkSession, sf: str) -> DataFrame:
    return top_n_per_group(table(spark, sf, "rankings"), ["runid", "qid"], "eid", "score", 5)


def p3_top_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The five best pages of each run and qid with their places."""
    return top_pages(spark, sf)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The five best pages of each run and qid."""
    return top_pages(spark, sf).select("runid", "qid", "eid")


_P3 = """
SELECT runid, qid, eid, score, row_number() OVER (PARTITION BY runid, qid ORDER BY score DESC, eid) AS place
FROM (SELECT runid, qid, eid, max(score) AS score FROM rankings WHERE eid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
QUALIFY place <= 5"""


# 4: main content of pages


def judged_lines(spark: SparkSession, sf: str) -> DataFrame:
    pages = latest(table(spark, sf, "docs"), "eid", "crawled_at", ["raw_url", "title_string", "body_string"])
    return page_lines(pages, "eid", "raw_url", "title_string", "body_string")


def p4_content(spark: SparkSession, sf: str) -> DataFrame:
    """Number of lines and of content lines of each page."""
    lines = judged_lines(spark, sf)
    return lines.groupBy("eid").agg(F.count(F.lit(1)).alias("lines"), F.count_if("content").alias("content_lines"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are not content."""
    return judged_lines(spark, sf).filter(~F.col("content")).select("eid", "line_no")


# 5: frequency of every term and value

COMMON_SHARE = {"body": 0.2, "keywords": 0.05}


def body_terms(spark: SparkSession, sf: str, max_n: int = 1) -> DataFrame:
    records = latest(table(spark, sf, "docs"), "eid", "crawled_at", ["body_string"])
    return frequencies(records, "body_string", "terms", max_n, common_share=COMMON_SHARE["body"])


def keyword_values(spark: SparkSession, sf: str) -> DataFrame:
    records = latest(table(spark, sf, "docs"), "eid", "crawled_at", ["keywords"])
    return frequencies(records, "keywords", "values", common_share=COMMON_SHARE["keywords"])


def _fields(body: DataFrame, keywords: DataFrame) -> DataFrame:
    return body.withColumn("field_name", F.lit("body")).unionByName(keywords.withColumn("field_name", F.lit("keywords")))


def p5_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences, records and marks of every term of the bodies and value of the keywords."""
    return _fields(body_terms(spark, sf), keyword_values(spark, sf)).select("field_name", "term", "occurrences", "records", "rare", "common")


def p5_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and records of every run of up to three terms of the bodies that comes at least twice."""
    return body_terms(spark, sf, 3).filter(F.col("occurrences") > 1).select("term", "n", "occurrences", "records")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms and values that are too rare or too common."""
    return _fields(marks(body_terms(spark, sf)), marks(keyword_values(spark, sf))).select("field_name", "term", "mark")


_DOCS = "SELECT * FROM docs WHERE eid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY eid ORDER BY crawled_at DESC, body_string, title_string, keywords) = 1"
_P5 = f"""
WITH records AS ({_DOCS}),
found AS (
  SELECT 'body' AS field_name, eid, lower(unnest(regexp_extract_all(body_string, '[\\p{{L}}\\p{{N}}]+'))) AS term FROM records
  UNION ALL SELECT * FROM (
    SELECT 'keywords', eid, lower(trim(unnest(string_split_regex(keywords, '[,;|]')), ' \t\r\n')) AS term FROM records WHERE keywords IS NOT NULL) WHERE term <> ''),
sizes AS (SELECT field_name, count(DISTINCT eid) AS n FROM found GROUP BY ALL),
counts AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT eid) AS records FROM found GROUP BY ALL),
marked AS (
  SELECT field_name, term, occurrences, records, records <= 1 AS rare,
    records * 100 > n * CASE field_name WHEN 'body' THEN 20 ELSE 5 END AS common FROM counts JOIN sizes USING (field_name))"""
P5_FREQUENCIES = _P5 + " SELECT * FROM marked"
P5_FOUND = _P5 + " SELECT field_name, term, 'rare' AS mark FROM marked WHERE rare UNION ALL SELECT field_name, term, 'common' FROM marked WHERE common"
P5_PHRASES = f"""
WITH records AS (SELECT eid, list_transform(regexp_extract_all(body_string, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS w FROM ({_DOCS}) WHERE body_string IS NOT NULL),
starts AS (SELECT eid, w, unnest(range(1, len(w) + 1)) AS i FROM records),
grams AS (SELECT eid, n, array_to_string(w[i : i + n - 1], ' ') AS term FROM starts, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w))
SELECT term, n::INT AS n, count(*) AS occurrences, count(DISTINCT eid) AS records FROM grams GROUP BY term, n HAVING count(*) > 1"""

# 6: splitting oversized fields

LIMITS = {"body_string": (2000, 100), "title_string": (120, 20)}


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "docs")
    # texts within the limit do not travel
    slim = docs.select("eid", "crawled_at", *[F.when(F.length(c) > limit, F.col(c)).alias(c) for c, (limit, _) in LIMITS.items()])
    return split_oversized(latest(slim, "eid", "crawled_at", list(LIMITS)), "eid", LIMITS)


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of over-long bodies and titles."""
    return pieces(spark, sf).select(F.col("id").alias("eid"), "field_name", "piece", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "cut_kind", "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Over-long fields and whether a cut within a stretch is forced."""
    cut = F.when(F.col("forced"), "forced").otherwise("clean")
    return pieces(spark, sf).select(F.col("id").alias("eid"), "field_name", cut.alias("cut")).distinct()


P6_FOUND = f"""
WITH long AS (
  SELECT eid, 'body_string' AS field_name, 2000 AS most, body_string AS t FROM ({_DOCS}) WHERE length(body_string) > 2000
  UNION ALL SELECT eid, 'title_string', 120, title_string FROM ({_DOCS}) WHERE length(title_string) > 120),
stretches AS (
  SELECT eid, field_name, most, unnest(string_split(replace(regexp_replace(regexp_replace(t, '([.!?;|])([ \t\r\n])', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1) || chr(1), chr(1)), chr(1))) AS s FROM long)
SELECT eid, field_name, CASE WHEN max(length(s)) > max(most) THEN 'forced' ELSE 'clean' END AS cut FROM stretches GROUP BY eid, field_name"""

# 7: distinctive terms


def weights(spark: SparkSession, sf: str) -> DataFrame:
    return term_weights(latest(table(spark, sf, "docs"), "eid", "crawled_at", ["title_string", "body_string"]), "eid", ["title_string", "body_string"])


def p7_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The weight of every term of every record."""
    return weights(spark, sf).select(F.col("id").alias("eid"), "term", "tf", F.round("weight", 6).alias("weight"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that come at least four times in a record and in at most three records.

    Such a term comes no more often in all than tf and two longest records, so its weight has a lower bound that grows with the collection. Only what
    weighs so much is looked at; its counts, of which the weight was made, decide.
    """
    longest = F.col("longest").cast("double")
    least = F.log(4 * F.col("whole") / ((4 + 2 * longest) * F.pow(longest, F.lit(0.75))))
    return weights(spark, sf).filter((F.col("weight") >= least - 1e-9) & (F.col("tf") >= 4) & (F.col("df") <= 3)).select(F.col("id").alias("eid"), "term")


_P7 = f"""
WITH found AS (SELECT eid, lower(unnest(regexp_extract_all(concat_ws(chr(10), title_string, body_string), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM ({_DOCS})),
tf AS (SELECT eid, term, count(*) AS tf FROM found GROUP BY ALL),
lengths AS (SELECT eid, count(*) AS n FROM found GROUP BY eid),
stats AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term)"""
P7_WEIGHTS = (
    _P7
    + """ SELECT eid, term, tf, round(greatest(0.0, ln(tf * (SELECT sum(pow(n, 0.75)) FROM lengths) / (total * pow(n, 0.75)))), 6) AS weight
FROM tf JOIN lengths USING (eid) JOIN stats USING (term)"""
)
P7_FOUND = _P7 + " SELECT eid, term FROM tf JOIN stats USING (term) WHERE tf >= 4 AND df <= 3"

# 8: test passages in training text


def leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items with the number of documents that hold them and the largest part held."""
    return leaks(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("share"), 6).alias("largest_share"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the items they hold."""
    return leaks(spark, sf).select("doc_id", "item_id").distinct()


# 9: mixing sources


def mix(spark: SparkSession, sf: str) -> Mix:
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), "doc_id", "text")


def p9_drawn(spark: SparkSession, sf: str) -> DataFrame:
    """The documents drawn, with their copies and virtual finish times."""
    return mix(spark, sf).drawn.select(F.col("id").alias("doc_id"), "source", "copy", F.col("size").alias("words"), F.round("finish", 3).alias("finish"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return mix(spark, sf).report.select("source", "target_share", "available", "drawn", F.round("actual_share", 6).alias("actual_share"), "repeats", "outcome")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each source."""
    return mix(spark, sf).report.select("source", "outcome").distinct()


P9_FOUND = """
WITH sizes AS (
  SELECT lower(trim(source, ' \t\r\n')) AS k, sum(len(regexp_extract_all(text, '[^ \t\r\n]+'))) AS w FROM documents GROUP BY 1),
goal AS (SELECT t.source, target_share, max_repeats, coalesce(w, 0) AS w FROM mix_targets t LEFT JOIN sizes ON k = lower(trim(t.source, ' \t\r\n')))
SELECT source, CASE WHEN w >= target_share * total THEN 'cut' WHEN w * max_repeats >= target_share * total THEN 'repeated' ELSE 'short' END AS outcome
FROM goal, (SELECT sum(w) AS total FROM goal)"""


# 10: languages

LANGUAGES = ["de", "en", "es", "fr", "it", "nl", "pt"]
LEAST_WORDS = 8


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return label_languages(table(spark, sf, "documents"), "doc_id", "text", "lang", LANGUAGES, least_words=LEAST_WORDS)


def p10_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage with its language and confidence."""
    return passages(spark, sf)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of documents that are mixed or whose label is missing or wrong."""
    held = passages(spark, sf).filter((F.col("words") >= LEAST_WORDS) & (F.col("mixed") | (F.col("label_state") != "right")))
    return held.select("doc_id", "lang").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and "_" in k and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_recall": P1_RECALL,
        "p2_found": P2_FOUND,
        "p2_net_flow": P2_NET_FLOW,
        "p3_found": f"SELECT runid, qid, eid FROM ({_P3})",
        "p3_top_pages": _P3,
        "p5_found": P5_FOUND,
        "p5_frequencies": P5_FREQUENCIES,
        "p5_phrases": P5_PHRASES,
        "p6_found": P6_FOUND,
        "p7_found": P7_FOUND,
        "p7_weights": P7_WEIGHTS,
        "p9_found": P9_FOUND,
    }
