"""Looking into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import numbered
from gleanery.sources.index import Index, bucket_of


def list_attribute(index: Index, eid: str, name: str) -> DataFrame:
    return index.docs.filter(F.col("eid") == eid).select("eid", F.col(name))


def list_doc(index: Index, eid: str) -> DataFrame:
    """The stored document."""
    return index.docs.filter(F.col("eid") == eid)


def list_docids(index: Index) -> DataFrame:
    """(iid, eid): internal ids are a dense numbering in eid order; a written index has it, of another it comes from a range sort."""
    if index.docids is not None:
        return index.docids
    one = index.docs.select(F.lit(1).alias("one"), "eid")
    return numbered(one, ["one"], [F.asc("eid")], "iid").select((F.col("iid") - 1).alias("iid"), "eid")


def list_fields(index: Index) -> DataFrame:
    return index.lengths.select("field").distinct()


def list_postings(index: Index, term: str, field: str, first: int | None = None) -> DataFrame:
    """(eid, tf, positions, df, ctf) of a term, all or the first documents in eid order."""
    stats = index.term_stats.filter((F.col("field") == field) & (F.col("term") == term)).select(F.lit(1).alias("one"), "df", "ctf")
    found = index.postings.filter((F.col("field") == field) & (F.col("term") == term)).select(F.lit(1).alias("one"), "eid", "tf", "positions")
    found = found.join(F.broadcast(stats), "one").drop("one")  # one row
    return found.orderBy("eid").limit(first) if first else found


def list_stats(index: Index) -> DataFrame:
    """(field, num_docs, doc_count, sum_len, avg_len)."""
    return index.field_stats.select("field", "num_docs", "doc_count", "sum_len", (F.col("sum_len") / F.col("doc_count")).alias("avg_len"))


def list_terms(index: Index, field: str) -> DataFrame:
    return index.term_stats.filter(F.col("field") == field).select("term", "df", "ctf")


def list_termvector(index: Index, eid: str, field: str | None = None) -> DataFrame:
    """Terms of a document; of a written index one bucket is read."""
    found = index.postings if index.vectors is None else index.vectors.filter(F.col("bucket") == bucket_of(F.lit(eid), index.buckets))
    found = found.filter(F.col("eid") == eid)
    found = found.filter(F.col("field") == field) if field else found
    return found.select("field", "term", "tf", "positions")


def list_metadata(index: Index, eid: str, names: list[str]) -> DataFrame:
    """(name, value) of the stored attributes of a document that have a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])).alias("x")
    return index.docs.filter(F.col("eid") == eid).select(pairs).select("x.name", "x.value").filter(F.col("value").isNotNull())


def check_docid(index: Index, iid: int) -> None:
    """Raises for a number that is no document's."""
    many = index.docs.count()
    if not 0 <= iid < many:
        raise ValueError(f"no document {iid}, there are {many}, from 0")


def to_iid(index: Index, eid: str) -> DataFrame:
    return list_docids(index).filter(F.col("eid") == eid)


def to_eid(index: Index, iid: int) -> DataFrame:
    return list_docids(index).filter(F.col("iid") == iid)
