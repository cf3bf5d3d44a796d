"""Rendezvous sharding (operator 9).

Every record key is hashed with every shard; the shard of the best weighted score gets the record. The law is ``key``:
doc_id, the shard count and the weights decide, nothing else, so a further shard takes records only into itself and the
others keep theirs. Score of shard s of weight w: -ln(u)/w, u in (0, 1) from md5(key:s); the least score wins.

Defined cases: a null text has size 16 and checksum 0; a null doc_id is a key of its own; repeated rows share a shard and
get slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

#: doc_ids of one block are numbered by one task for each shard.
BLOCK = 65536


def hash52(key: Column, shard: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("long")


def best_shard(key: Column, weights: list[float]) -> Column:
    """The winning shard of ``weights`` (ties: the smaller shard). Equal weights need no logarithm: the largest hash wins."""
    if len(set(weights)) == 1:
        scored = [F.struct((-hash52(key, s)).alias("x"), F.lit(s).alias("s")) for s in range(len(weights))]
    else:
        scored = [
            F.struct((-F.log((hash52(key, s) + 0.5) / F.lit(float(1 << 52))) / F.lit(float(w))).alias("x"), F.lit(s).alias("s"))
            for s, w in enumerate(weights)
        ]
    return F.array_min(F.array(*scored))["s"]


def rendezvous(docs: DataFrame, weights: list[float], new_weight: float = 1.0, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots run by doc_id. They come from two small steps: counts of each (shard, block of doc_ids) summed up before it, and
    a rank inside it, so no task sees more than one block of one shard; a block that repeated or null ids crowd is cut in
    parts, whose slots follow one another.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    all_shards = best_shard(F.col("key"), weights)
    rows = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"),
            (F.octet_length(text_or_empty()) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        )
        .withColumn("shard", all_shards)
        .withColumn("block", F.floor(F.coalesce(F.col("doc_id"), F.lit(-1)) / block))
    )
    newcomer = len(weights)
    if len({*weights, new_weight}) == 1:
        wins = hash52(F.col("key"), newcomer) > F.element_at(F.array(*[hash52(F.col("key"), s) for s in range(newcomer)]), F.col("shard") + 1)
        rows = rows.withColumn("grown_shard", F.when(wins, newcomer).otherwise(F.col("shard")))
    else:
        rows = rows.withColumn("grown_shard", best_shard(F.col("key"), [*weights, new_weight]))
    rows = materialize(rows.drop("key").withColumn("draw", F.rand(9)), "shards")
    # A block has over ``block`` rows only where ids repeat or lack: it is cut by the draw, which is written down.
    crowded = rows.groupBy("shard", "block").agg(F.count("*").alias("n")).where(F.col("n") > block)
    parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1))
    rows = rows.join(crowded, ["shard", "block"], "left").withColumn("part", F.floor(F.col("draw") * parts)).drop("n", "draw")
    counts = rows.groupBy("shard", "block", "part").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard", "block", "part",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("block", "part")) - F.col("n")).alias("base"),
    )
    local = F.row_number().over(Window.partitionBy("shard", "block", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("local", local)
        .join(before, ["shard", "block", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
                (F.col("base") + F.col("local")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous(table(spark, sf_dir, "documents"), [1.0] * 40)


#: CRC-32 a byte at a time: the table is made from its polynomial, the fold runs over the bytes of the text.
ORACLE_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
h AS (SELECT doc_id, s.range AS s, CAST('0x' || substr(md5(key || ':' || s.range), 1, 13) AS BIGINT) AS x FROM d, range(41) s),
o AS (SELECT doc_id, arg_max(s, x) FILTER (s < 40) AS shard, arg_max(s, x) AS grown FROM h GROUP BY doc_id),
z AS (SELECT d.doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, xor(list_reduce(
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT)),
        lambda a, b: xor(a >> 8, crc.t[CAST(xor(a, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32
      FROM d, crc)
SELECT z.doc_id, z.size, z.text_crc32, 'key' AS law, CAST(o.shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY o.shard ORDER BY z.doc_id) - 1 AS BIGINT) AS slot, CAST(o.grown AS INTEGER) AS grown_shard
FROM z JOIN o ON z.doc_id = o.doc_id
"""
