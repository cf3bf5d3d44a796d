"""Exact deduplication over a persistent digest index (operator 5).

The index is a table of one row per digest (32 bytes), bucketed by it, with sorted files. A delivery is reduced to its
distinct digests, anti-joined with the index by sort-merge (the index side needs no shuffle; Spark sorts a bucket again once
appends have given it several files) and what is new is appended.

Defined cases: a null text counts as empty; a null doc_id never stays while a row with an id does; of a text that only rows
without an id have, all stay, for nothing tells them apart; repeated rows count as members of their group; a row that the
index names already, delivered again, stays again, so a job may be run anew; an empty table gives no rows; other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, rows_without, table, text_or_empty, written

#: Digests that a bucket of a new index is meant to hold.
BUCKET_ROWS = 2_000_000


def digest(text: str = "text") -> Column:
    """SHA-256 of the UTF-8 bytes of the text as it is."""
    return F.unhex(F.sha2(text_or_empty(text).cast("string").cast("binary"), 256))


class DigestIndex:
    """Digests seen so far: ``digest, keep_id``; ``keep_id`` is of the delivery that brought the digest.

    A new index has a bucket for each ``BUCKET_ROWS`` of ``expected_rows``, 16 at least; an old one keeps its own number."""

    SCHEMA = "digest binary, keep_id long"

    def __init__(self, spark: SparkSession, name: str, expected_rows: int = 0):
        self.spark, self.name = spark, name
        if spark.catalog.tableExists(name):
            described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(described["data_type"])
        else:
            self.buckets = max(16, -(-expected_rows // BUCKET_ROWS))
            self._write(spark.createDataFrame([], self.SCHEMA), "errorifexists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.mode(mode).bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_digests(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` whose digest the index lacks."""
        return groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> DataFrame:
        """Anti-join, append, and return what was new."""
        fresh = materialize(self.new_digests(groups).select("digest", "keep_id"), "fresh-digests")
        self._write(fresh, "append")
        return fresh

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest; partial sums before the shuffle keep a hot digest to one row per task."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def by_age(rows: DataFrame, deliveries: int) -> list[DataFrame]:
    """The rows in so many ranges of doc_id, the largest first; rows without an id come last."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if deliveries < 2 or low is None:
        return [rows]
    number = F.coalesce(F.expr(f"least((CAST({high} AS DECIMAL(20)) - doc_id) * {deliveries} div {high - low + 1}, {deliveries - 1})").cast("int"), F.lit(deliveries - 1))
    return [rows.where(number == k) for k in range(deliveries)]


def exact_dedup(docs: DataFrame, index: DigestIndex, hot_share: int = 64, deliveries: int = 1) -> DataFrame:
    """Every row of ``docs`` with its group, after adding it to ``index`` in one or more deliveries, the largest ids first.

    ``group_size`` counts the rows of ``docs``. A text that the index had before keeps the row named there.
    A group that holds over 1/``hot_share`` of the rows is hot. There are fewer than ``hot_share`` such groups, so they
    are broadcast, and their members never meet in one task; the other members join the index on the digest.
    """
    rows = materialize(digests(docs), "digests")
    for delivery in by_age(rows, deliveries):
        index.append(groups_of(delivery))
    sizes = groups_of(rows).select("digest", "group_size")
    groups = materialize(sizes.hint("merge").join(index.read().select("digest", "keep_id").hint("merge"), "digest"), "groups")
    total = rows.count()
    hot = [bytes(r[0]) for r in groups.where(F.col("group_size") * hot_share > total).select("digest").limit(hot_share).collect()]
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    out = rows.where(~is_hot).join(groups.where(~is_hot), "digest")
    if hot:
        out = out.unionByName(rows.where(is_hot).join(F.broadcast(groups.where(is_hot)), "digest"))
    return out.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _new_index(docs: DataFrame) -> DigestIndex:
    return DigestIndex(docs.sparkSession, f"quillspark_digests_{uuid.uuid4().hex[:12]}", docs.select("doc_id").count())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in two deliveries against one index: the older half meets the digests of the newer one."""
    docs = table(spark, sf_dir, "documents")
    before, index = set(written()), _new_index(docs)
    out = materialize(exact_dedup(docs, index, deliveries=2), "exact")
    index.drop()
    discard(spark, *(p for p in written() if p not in before and p != out._scratch))
    return out


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, in all their columns; repeats of one (doc_id, text) are one document and stay together.
    Without an ``index`` the documents are held against each other alone."""
    own = index is None
    index = index or _new_index(docs)
    gone = materialize(exact_dedup(docs, index).where("NOT kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest")), "copies")
    if own:
        index.drop()
    return rows_without(docs, {"_id": F.col("doc_id").cast("long"), "_digest": digest()}, gone)
