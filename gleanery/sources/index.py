"""The positional index over the fields of a collection: built from DataFrames, kept as Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import Analyzer
from gleanery.operators.scale import materialise, numbered

TABLES = ("docs", "postings", "lengths", "term_stats", "field_stats")


@dataclass(frozen=True)
class Index:
    """docs (eid, stored attributes), postings (field, term, eid, tf, len, positions), lengths (eid, field, len, poslen),
    term_stats (field, term, df, ctf) and field_stats (field, doc_count, sum_len, num_docs).

    len counts all tokens, stopwords too; sum_len the indexed ones; poslen is the last indexed position plus one. Postings carry their
    document's length, so scoring needs no second join.
    """

    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    analyzer: Analyzer = Analyzer()
    #: Of a written index: the postings once more, by document, with the bucket of each eid; and the numbering (iid, eid).
    vectors: DataFrame | None = None
    docids: DataFrame | None = None
    buckets: int = 0

    def of_documents(self, eids: DataFrame, most: int = 1_000_000) -> DataFrame:
        """The postings of the documents of (eid): of a written index only their buckets are read, and up to `most` ids are broadcast."""
        eids = eids.select("eid").distinct()
        if self.vectors is not None:
            eids = eids.withColumn("bucket", bucket_of("eid", self.buckets))
        few = eids.limit(most + 1).count() <= most
        source = self.postings if self.vectors is None else self.vectors
        return source.join(F.broadcast(eids) if few else eids, eids.columns, "left_semi").drop("bucket")

    def write(self, path: str, buckets: int = 64) -> None:
        """Postings are laid out by field and sorted by term, so that a term's scan touches few row groups; and once more in `buckets` of documents, for their vectors.

        The documents' numbering by eid is written as well, sorted, so that a lookup either way touches few row groups.
        """
        for name in TABLES:
            df = getattr(self, name)
            if name == "postings":
                df.repartitionByRange("field", "term").sortWithinPartitions("field", "term", "eid").write.partitionBy("field").mode("overwrite").parquet(f"{path}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

        spark, rows = self.docs.sparkSession, self.postings.select(bucket_of("eid", buckets).alias("bucket"), "eid", "field", "term", "tf", "len", "positions")
        rows.repartition("bucket").sortWithinPartitions("bucket", "eid", "field", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/vectors")
        ids = numbered(self.docs.select(F.lit(1).alias("one"), "eid"), ["one"], [F.asc("eid")], "iid").select((F.col("iid") - 1).alias("iid"), "eid")
        ids.sortWithinPartitions("iid").write.mode("overwrite").parquet(f"{path}/docids")
        spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")

    def stored(self) -> Index:
        """The same index with its documents, postings and lengths written once beside the checkpoints, terms sorted within files.

        What several branches of a plan read is then analysed once, and a term's filter skips row groups.
        """
        postings = materialise(self.postings.sortWithinPartitions("field", "term"))
        return derive_stats(materialise(self.docs), postings, materialise(self.lengths), self.analyzer)

    def persist(self) -> Index:
        for name in TABLES:
            getattr(self, name).persist()
        return self

    def close(self) -> None:
        for name in TABLES:
            getattr(self, name).unpersist()


def open_index(spark: SparkSession, path: str, analyzer: Analyzer | None = None) -> Index:
    """Read a written index; a missing table raises."""
    tables = [spark.read.parquet(f"{path}/{name}") for name in (*TABLES, "vectors", "docids")]
    return Index(*tables[:5], analyzer or Analyzer(), *tables[5:], spark.read.parquet(f"{path}/layout").first()["buckets"])


def bucket_of(eid: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(eid), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, fields: dict[str, str], id_col: str = "eid", attributes: list[str] | None = None, analyzer: Analyzer | None = None, positions: bool = True) -> Index:
    """Index the text columns `fields` (field -> column) of docs, one row a document; documents without id are left out.

    Null texts give no length and no posting; empty ones a length of 0. Without `positions`, for plans that never match them, these are null.
    """
    analyzer = analyzer or Analyzer()
    src = docs.filter(F.col(id_col).isNotNull())
    stored = src.select(F.col(id_col).alias("eid"), *[F.col(a) for a in attributes or []])
    texts = [F.struct(F.lit(f).alias("field"), analyzer.tokens(F.col(c)).alias("tokens")) for f, c in fields.items()]
    long = src.select(F.col(id_col).alias("eid"), F.explode(F.array(*texts)).alias("x")).select("eid", "x.field", "x.tokens").filter(F.col("tokens").isNotNull())
    # one row a token, so that stopwords and stems are compiled code, not lambdas over arrays
    each = long.select("eid", "field", F.size("tokens").alias("len"), F.posexplode_outer("tokens").alias("pos", "token"))
    kept = F.col("token").isNotNull() & analyzer.kept(F.col("token"))
    lengths = each.groupBy("eid", "field", "len").agg(F.coalesce(F.max(F.when(kept, F.col("pos") + 1)), F.lit(0)).alias("poslen"))
    each = each.filter(kept).select("field", analyzer.stem(F.col("token")).alias("term"), "eid", "len", "pos")
    grouped = each.groupBy("field", "term", "eid", "len")
    if positions:
        postings = grouped.agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("field", "term", "eid", F.size("positions").alias("tf"), "len", "positions")
    else:
        postings = grouped.agg(F.count(F.lit(1)).cast("int").alias("tf")).select("field", "term", "eid", "tf", "len", F.lit(None).cast("array<int>").alias("positions"))
    return derive_stats(stored, postings, lengths, analyzer)


def derive_stats(docs: DataFrame, postings: DataFrame, lengths: DataFrame, analyzer: Analyzer) -> Index:
    term_stats = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    # one row a field (five at most), and one with the number of documents
    num = docs.agg(F.count(F.lit(1)).alias("num_docs")).withColumn("one", F.lit(1))
    counts = lengths.filter(F.col("poslen") > 0).groupBy("field").agg(F.count(F.lit(1)).alias("doc_count"))
    sums = term_stats.groupBy("field").agg(F.sum("ctf").alias("sum_len"))
    field_stats = counts.join(sums, "field").withColumn("one", F.lit(1)).join(F.broadcast(num), "one").drop("one")
    return Index(docs, postings, lengths, term_stats, field_stats, analyzer)
