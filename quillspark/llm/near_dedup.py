"""MinHash near-deduplication with ProbMinHash (operator 1).

Signatures: a text's distinct five-word shingles all weigh the same, for links are decided by the sets alone: weights by count
would part texts that repeat lines. Each shingle is a Poisson process of rate 1 whose points fall on random registers; a
register keeps the shingle of its earliest point, so two texts agree in a register with the Jaccard similarity of their sets
(``probminhash`` itself takes any weights). Points come in order of time, and a shingle is given up once its next point is
later than the latest register of its text: most shingles of a long text make one point only.

Bands of registers make buckets. In every bucket each text is compared with the bucket's hub, the member that shares the
most buckets with others, so a group of n near copies costs n comparisons and not n^2. Texts of a bucket that are still in
different components after that are screened in blocks: signatures of all registers, a byte each, are compared as matrices,
and only pairs whose estimate comes within 4.5 standard deviations of the threshold become rows, each in the first band
that both share. Every comparison is exact: the Jaccard similarity of the two sets of shingles, 0.8 or more. Classes are the
components of those links.

Chance of a miss: a pair at exactly 0.8 shares none of 24 bands of 4 with probability 3e-6, less above; the screen misses
as many.

Defined cases: texts are equal or not byte by byte, a null text is empty; equal texts are one class, whatever they hold; a
text of fewer than five words is one shingle of its words; one without words is linked to equal texts only; words are runs
of ASCII letters and digits and of any other characters beyond ASCII, A-Z lower-cased; a null doc_id is never a class id
unless its class has no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slots, distinct_counts, materialize, mix64, rows_without, shingle_hashes, slices, table, text_or_empty, tidy
from .components import connected_components

BANDS, ROWS = 24, 4
#: Of these, bands take BANDS * ROWS; all of them estimate.
REGISTERS = 512
#: Standard deviations below the threshold at which the screen gives a pair up.
SLACK = 4.5
#: Texts of a bucket that are screened against each other in one piece.
BLOCK = 2048
THRESHOLD = 0.8
SHINGLE = 5


def probminhash(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Signatures (rows x registers) of weighted sets given as (row, key, weight); all rows take their next points together."""
    soonest = np.full(rows * registers, np.inf)
    winner = np.zeros(rows * registers, np.uint64)
    latest = np.full(rows, np.inf)
    at, n = np.zeros(len(key)), 0
    while len(key):
        n += 1
        draw = mix64(key + np.uint64((n * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        live = at < latest[row]
        row, key, weight, at, draw = row[live], key[live], weight[live], at[live], draw[live]
        if not len(key):
            break
        slot = row * registers + (mix64(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(soonest, slot, at)
        won = soonest[slot] == at
        winner[slot[won]] = key[won]
        touched = row[np.concatenate(([True], row[1:] != row[:-1]))]
        latest[touched] = soonest.reshape(rows, registers)[touched].max(1)
    return winner.reshape(rows, registers)


def sketches(texts: pa.Array, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, registers: int = REGISTERS):
    """Band keys (null for a text without words), and a byte of each register followed by a second one of those in bands.
    Keys are made of these bytes alone (16 bits a register, 64 a band of four), so sketches tell which bands two texts share."""
    row, key, _ = distinct_counts(*shingle_hashes(texts, shingle))
    signature = probminhash(row, key, np.ones(len(key)), len(texts), max(registers, bands * rows))
    sketch = np.concatenate(((signature >> np.uint64(56)).astype(np.uint8), (signature[:, : bands * rows] >> np.uint64(48)).astype(np.uint8)), 1)
    out = np.zeros((len(texts), bands), np.uint64)
    for j in range(rows):
        for first in (0, signature.shape[1]):
            out = mix64((out + sketch[:, first + j : first + bands * rows : rows]).ravel()).reshape(out.shape)
    out = mix64((out + np.arange(1, bands + 1, dtype=np.uint64)).ravel()).reshape(out.shape).view(np.int64)
    some = np.bincount(row, minlength=len(texts)) > 0
    return [out[i].tolist() if some[i] else None for i in range(len(texts))], [s.tobytes() for s in sketch]


def _signatures(bands: int, rows: int, shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                nodes = [hashlib.md5((t.as_py() or "").encode()).digest() for t in texts]
                keys, sketch = sketches(texts, bands, rows, shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], schema=schema)

    return tidy(run)


def close_pairs(group: np.ndarray, root: np.ndarray, sketch: np.ndarray, least: float, lag: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows of one group and different roots whose sketches agree in ``least`` of their bytes; rows come
    sorted by group. Small groups are compared all at once, a row with the next, the one after, and so on."""
    n, width = len(group), sketch.shape[1]
    bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    size = np.diff(bounds)
    big = np.repeat(size > lag, size)
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            good = (sketch[a] == sketch[b]).sum(1) >= least * width
            left.append(a[good])
            right.append(b[good])

    for d in range(1, min(lag, int(size[size <= lag].max(initial=1)))):
        i = np.arange(n - d)
        i = i[(group[i] == group[i + d]) & ~big[i] & (root[i] != root[i + d])]
        keep(i, i + d)
    for lo, hi in zip(bounds[:-1][size > lag], bounds[1:][size > lag]):
        for s in range(lo, hi, 32):
            e = min(s + 32, hi)
            agree = np.empty((e - s, hi - s), np.int32)
            for k in range(e - s):
                agree[k] = np.count_nonzero(sketch[s:hi] == sketch[s + k], axis=1)
            i, j = np.nonzero(agree >= least * width)
            i, j = i + s, j + s
            good = (i < j) & (root[i] != root[j])
            left.append(i[good])
            right.append(j[good])
    return np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)


def first_shared(a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The first band that two sketches share, pair by pair: both bytes of all its registers."""
    same = (a[:, : bands * rows] == b[:, : bands * rows]) & (a[:, -bands * rows :] == b[:, -bands * rows :])
    return same.reshape(len(a), bands, rows).all(2).argmax(1)


def _screen(least: float, bands: int, rows_: int):
    """Rows sorted by (band, block, other) in; close pairs of nodes out. A group that a batch ends in waits for the next."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        names = ("band", "block", "other")
        new = np.zeros(rows.num_rows, bool)
        for c in names:
            x = rows.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        node = rows.column("node").combine_chunks()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        root = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        # In a group of two blocks, pairs within a block are left to that block's own group.
        i, j = close_pairs(np.cumsum(new), root, sketch[:, : -bands * rows_], least)
        mine, block, other = (rows.column(c).to_numpy() for c in ("mine", "block", "other"))
        across = (block[i] == other[i]) | (mine[i] != mine[j])
        i, j = i[across], j[across]
        number = rows.column("number").to_numpy()
        first = np.concatenate([first_shared(sketch[i[s : s + 65536]], sketch[j[s : s + 65536]], bands, rows_) for s in range(0, len(i), 65536)] or [i])
        i, j = i[first == number[i]], j[first == number[i]]
        x, y = node.take(pa.array(i)).to_pylist(), node.take(pa.array(j)).to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in zip(x, y)], pa.binary()), pa.array([max(p) for p in zip(x, y)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            same = np.ones(rows.num_rows, bool)
            for c in ("band", "block", "other"):
                x = rows.column(c).to_numpy()
                same &= x == x[-1]
            last = int(rows.num_rows - same[::-1].argmin()) if not same.all() else 0
            if last:
                yield pairs(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield pairs(held)

    return tidy(run)


def jaccard(a: pa.Array, b: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Exact Jaccard similarity of the sets of shingles, pair by pair; 0 where either has none."""
    n = len(a)
    ra, ka, _ = distinct_counts(*shingle_hashes(a, shingle))
    rb, kb, _ = distinct_counts(*shingle_hashes(b, shingle))
    row, key = np.concatenate((ra, rb)), np.concatenate((ka, kb))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    common = np.zeros(n)
    if len(row) > 1:
        same = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
        common = np.bincount(row[1:][same], minlength=n).astype(float)
    total = np.bincount(row, minlength=n) - common
    return np.divide(common, total, out=np.zeros(n), where=total > 0)


def _similar(threshold: float, shingle: int):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", 1 << 20):
                for one in slices(part, "tb", 1 << 20):
                    linked = pa.array(jaccard(one.column("ta"), one.column("tb"), shingle) >= threshold)
                    yield pa.RecordBatch.from_arrays([one.column("a").filter(linked), one.column("b").filter(linked)], schema=schema)

    return tidy(run)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Those of the distinct pairs ``a, b`` of nodes whose texts (``node, text``) are similar enough."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    found = both.select("a", "b", "ta", "tb").mapInArrow(_similar(threshold, shingle), "a binary, b binary")
    return materialize(found, "links")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row a document: doc_id, node (MD5 of its text), text_id and class_id (least doc_id of equal texts, of the class)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(read.mapInArrow(_signatures(bands, rows, shingle), "doc_id long, node binary, bands array<long>, sketch binary"), "signatures")
    by_text = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("copies")), "texts")
    # One row of each text has its bands: that of the least doc_id, and of repeated rows any.
    one = signed.join(by_text.select("node", F.col("text_id").alias("least")), "node").where(F.col("doc_id").eqNullSafe(F.col("least")))
    spread = one.dropDuplicates(["node"]).select("node", F.posexplode("bands").alias("number", "band"))
    sizes = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(spread.join(sizes, "band"), "buckets")
    share = buckets.groupBy("node").agg(F.sum("n").alias("share"))
    hubs = buckets.join(share, "node").groupBy("band").agg(F.max(F.struct("share", "node"))["node"].alias("hub"))
    tried = materialize(
        buckets.join(hubs, "band").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(),
        "hub-pairs")
    wanted = buckets.select("node").distinct()
    sources = materialize(by_text.join(wanted, "node", "left_semi").select(F.col("node").alias("want"), "text_id"), "sources")
    texts = read.select("doc_id", text_or_empty().alias("text")).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
    # Texts of documents without a bucket stay where they are.
    texts = Slots(sources.select(F.xxhash64("want", "text_id"))).mark(texts, F.xxhash64("node", "doc_id")).where("_may")
    texts = texts.join(sources, (texts["node"] == sources["want"]) & texts["doc_id"].eqNullSafe(sources["text_id"])).select("node", "text")
    texts = materialize(texts, "candidate-texts")
    links = verified(tried, _distinct_texts(texts), threshold, shingle)
    parts = materialize(connected_components(links), "components")
    # Buckets whose members are still apart: the close pairs across components that were not compared yet.
    labelled = buckets.select("band", "number", "node").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    apart = materialize(labelled.join(apart.select("band", "size"), "band"), "apart")
    sketch = one.dropDuplicates(["node"]).select("node", "sketch")
    blocks = F.ceil(F.col("size") / BLOCK)
    mine = F.pmod(F.xxhash64("node", "band"), blocks)
    pieces = apart.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pieces = pieces.select("band", "number", "node", "root", "mine", F.least("mine", "with").alias("block"), F.greatest("mine", "with").alias("other"))
    screened = (
        pieces.join(sketch, "node").repartition("band", "block", "other").sortWithinPartitions("band", "block", "other")
        .select("band", "number", "node", "root", "mine", "block", "other", "sketch")
        .mapInArrow(_screen(threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5, bands, rows), "a binary, b binary")
    )
    rest = screened.distinct().join(tried, ["a", "b"], "left_anti")
    more = verified(rest, _distinct_texts(texts), threshold, shingle)
    # The first round's components stand for its links.
    both = parts.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    roots = connected_components(both)
    named = materialize(by_text.join(roots, "node", "left").select("node", "text_id", F.coalesce("root", "node").alias("root")), "named")
    classes = named.groupBy("root").agg(F.min("text_id").alias("class_id"))
    named = named.join(classes, "root").select("node", "text_id", "class_id")
    return signed.select("doc_id", "node").join(named, "node")


def _distinct_texts(texts: DataFrame) -> DataFrame:
    """Repeated rows of one document would double its pairs."""
    return texts.groupBy("node").agg(F.max("text").alias("text"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class stays, that of the least doc_id, in all its columns; repeats of one (doc_id, text) are
    one document and stay together."""
    gone = near_duplicates(docs).where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    node = F.unhex(F.md5(text_or_empty().cast("string").cast("binary")))
    return rows_without(docs, {"_id": F.col("doc_id").cast("long"), "_node": node}, gone)
