"""How distinctive a term is of a record: positive pointwise mutual information with smoothed context counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import HEAVY_ROWS, hot_cold_join, materialise

#: Letters and digits in the JVM's and DuckDB's regular expressions.
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-cased maximal runs of letters or digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def term_weights(records: DataFrame, id_col: str, text_cols: list[str], smoothing: float = 0.75, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Weight of each term of each record: (id, term, tf, df, total, weight, whole, longest).

    weight = max(0, ln(tf * S / (total * length ** smoothing))) with tf the term's count in the record, total its count in all,
    length the record's number of terms and S (`whole`) the sum of length ** smoothing over all records, the longest of which has `longest` terms: the mutual information of
    term and record, with the records' counts smoothed by a fractional exponent. df: records with the term. A record's
    texts are joined; null ones count as empty. Records without terms or id give no rows; each row is a record of its own id.

    The counts are made where the record lies; only one row a term and record travels. Terms in more than `heavy_rows` records are
    met by broadcasting their (few) totals.
    """
    text = F.concat_ws("\n", *[F.col(c) for c in text_cols])
    words = records.select(F.col(id_col).alias("id"), terms(text).alias("w")).filter(F.col("id").isNotNull() & (F.size("w") > 0))
    counted = words.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))
    counted = materialise(counted)
    stats = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    # the length stands in each row of a record, so dividing by its number of terms adds up to one share a record
    share = F.col("tf") / F.col("length") * F.pow(F.col("length").cast("double"), F.lit(smoothing))
    whole = F.broadcast(counted.agg(F.sum(share).alias("s"), F.max("length").alias("longest")).withColumn("any", F.lit(True)))  # one row
    joined = hot_cold_join(counted, stats, "term", "df", heavy_rows).withColumn("any", F.lit(True)).join(whole, "any")
    pmi = F.log(F.col("tf") * F.col("s") / (F.col("total") * F.pow(F.col("length").cast("double"), F.lit(smoothing))))
    return joined.select("id", "term", "tf", "df", "total", F.greatest(F.lit(0.0), pmi).alias("weight"), F.col("s").alias("whole"), "longest")
