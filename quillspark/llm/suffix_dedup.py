"""Removal of repeated 100-byte strings by column-wise suffix sorting (operator 2).

A byte goes if a string of ``LENGTH`` bytes over it starts earlier somewhere (smaller doc_id, or the same document and an
earlier start). The suffix order is built column by column, one symbol of each member a round, as the Burrows-Wheeler
transform of a whole collection, with the common prefixes of neighbours, up to ``LENGTH`` bytes (``collection_order``). Built over all bytes that costs a pass over everything for each column of the longest text, so the
collections are cut first:

1. Each string of LENGTH bytes has an anchor: its least GRAM-byte string by hash, the leftmost of equals. Successive
   strings with the same anchor form one segment (at most 2 * LENGTH bytes). Equal strings have the same anchor at the same
   place, so only segments of the same anchor can share one; all segments of an anchor make one collection.
2. Segments equal as wholes are one member: all but the earliest go whole. Each task does that to its own text before the
   shuffle, so a passage that a third of all documents share leaves one row a task slice.
3. An anchor with one distinct segment is done. For the others the bytes are fetched, and each is trimmed to the longest
   flanks of its anchor that another one has too; those that come out under LENGTH are done. The rest are the documents of
   the collections, whose order and common prefixes are built column-wise, in files read and written in sequence.
4. Removed spans join their documents, and one pass gives the kept bytes' digest. Documents without any (or, in step 3,
   without a segment to fetch) stay where they are: a map of bits tells them.

Defined cases: a null text is empty; a text under LENGTH bytes keeps all; repeated rows (same doc_id and text) count one after
another, so all but one go whole, if they have LENGTH bytes; different texts of the same doc_id come in order of a hash; a
null doc_id comes after all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Slots, SpanHasher, flat_bytes, materialize, mix64, slices, table, text_or_empty, tidy

LENGTH = 100
GRAM = 32
#: Bytes of text hashed together, and bytes of segments in one collection.
CHUNK = 2 << 20
COLLECTION = 2 << 20
_POSITION = np.uint64((1 << 23) - 1)
LAST = (1 << 63) - 1


def window_minimum(x: np.ndarray, size: int) -> np.ndarray:
    done = 1
    while done * 2 <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (size - done)], x[size - done :]) if done < size else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Row, start in the row, bytes, place of the anchor, anchor's hash, whole segment's hash; for all rows of a buffer."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hasher = SpanHasher(data)
    at = np.arange(len(data) - gram + 1)
    grams = hasher(at, at + gram)
    least = window_minimum((grams & ~_POSITION) | at.astype(np.uint64), length - gram + 1)
    allowed = np.zeros(len(data) + 1, np.int64)
    last = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    np.add.at(allowed, offsets[:-1], 1)
    np.add.at(allowed, last, -1)
    start = np.flatnonzero(np.cumsum(allowed[:-1]) > 0)
    start = start[start <= len(data) - length]
    if not len(start):
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    anchor = (least[start] & _POSITION).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    s0, s1, a = start[first], start[np.append(first[1:], len(start)) - 1] + length, anchor[first]
    row = np.searchsorted(offsets, s0, side="right") - 1
    whole = mix64(hasher(s0, s1) + (a - s0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, s0 - offsets[row], s1 - s0, a - s0, grams[a], whole


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The buffer, or parts of its single long row that overlap by length - 1 bytes: (bytes, offsets, start in the row)."""
    if len(data) <= int(_POSITION):
        yield data, offsets, 0
        return
    assert len(offsets) == 2
    step = int(_POSITION) // 2
    for a in range(0, len(data) - length + 1, step):
        part = data[a : a + step + length - 1]
        yield part, np.array([0, len(part)]), a


#: A row is as narrow as can be, for there are many: anchor, seg (hash of the whole segment), doc, and ``at``: start in the
#: text, bytes, place of the anchor, 0. A span that the task knows to go is such a row too: a hash that no other row has, its
#: bytes, doc, and ``at``: start, 1. ``tie`` orders different texts of one doc_id.
_SEGMENT = [("anchor", pa.int64()), ("seg", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())]
_START, _BYTES, _PLACE = "shiftright(at, 20)", "CAST(shiftright(at, 10) & 1023 AS INT)", "CAST(shiftright(at, 1) & 511 AS INT)"


def _merged(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that meet or overlap in a row as one: row, start, bytes. Of two spans of a row, the later ends later."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + n)[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], end[last] - start[first] if len(row) else n


def _cut(length: int, gram: int, many: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                data, offsets = flat_bytes(part.column("text"))
                doc = part.column("doc").to_numpy(zero_copy_only=False)
                tie = part.column("tie").to_numpy(zero_copy_only=False)
                for bytes_, offs, shift in _chunks(data, offsets, length):
                    row, start, n, place, anchor, whole = segments(bytes_, offs, length, gram)
                    start = start + shift
                    order = np.lexsort((start, tie[row], doc[row], whole, anchor))
                    row, start, n, place, anchor, whole = (x[order] for x in (row, start, n, place, anchor, whole))
                    same = np.zeros(len(row), bool)
                    same[1:] = (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])
                    again = same.copy()  # a repeated row's same place
                    again[1:] &= (doc[row[1:]] == doc[row[:-1]]) & (tie[row[1:]] == tie[row[:-1]]) & (start[1:] == start[:-1])
                    own, gone = ~same, same & ~again
                    who, lo, n_gone = _merged(row[gone], start[gone], n[gone])
                    spread = mix64(doc[who].view(np.uint64) ^ mix64(lo.astype(np.uint64)))  # meets no other row
                    columns = [
                        np.concatenate((anchor[own], spread)).view(np.int64), np.concatenate((whole[own].view(np.int64), n_gone)),
                        np.concatenate((doc[row[own]], doc[who])), np.concatenate(((start[own] << 20) | (n[own] << 10) | (place[own] << 1), (lo << 20) | 1)),
                    ] + [np.concatenate((tie[row[own]], tie[who]))] * many
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c for c, _ in _SEGMENT] + ["tie"] * many)

    return tidy(run)


def _by_symbol(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The places of a transform by (symbol, place), every place's rank there, and the number of end marks, which come first."""
    order = np.argsort(symbol, kind="stable")
    rank = np.empty(len(symbol), np.int64)
    rank[order] = np.arange(len(symbol))
    return order, rank, int(np.count_nonzero(symbol == 0))


def _least_between(prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(prefix[low + 1 .. high]) of every pair of places low < high."""
    if not len(low):
        return prefix[:0]
    order = np.argsort(low)  # so that what lies between two ranges is read once
    bounds = np.stack((low[order] + 1, high[order] + 1), 1).ravel()
    out = np.empty(len(low), prefix.dtype)
    out[order] = np.minimum.reduceat(np.append(prefix, prefix[-1:]), bounds)[::2]
    return out


def collection_order(members: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``length`` bytes of all members, in order: member, start, and whether a common prefix of
    ``length`` bytes joins each to the one before.

    Round j puts the suffix of j symbols of every member that has them into the collection's Burrows-Wheeler transform (each
    suffix's preceding symbol, in order of the suffixes) and into the table of common prefixes (of each suffix with the one
    before, up to ``length``). Where it goes follows from the transform alone: behind the suffixes that start with a smaller
    symbol, and behind as many of its own symbol's as occur before its parent's place. Its common prefix with a neighbour that
    starts with the same symbol is one longer than that of the two parents, the least in the table between them; besides the
    new suffixes only those right behind one change. Both are files that a round reads in sequence while it writes the
    next ones. Walking the finished transform back from the members' ends names its suffixes.
    """
    count = len(members)
    sizes = np.array([len(m) for m in members])
    data = np.frombuffer(b"".join(members), np.uint8)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    used = np.unique(data)
    code = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
    code[used] = np.arange(1, len(used) + 1)  # 0: nothing precedes
    symbols = code[data]
    common = np.uint8 if length < 256 else np.int32
    with tempfile.TemporaryDirectory() as folder:
        names = [[os.path.join(folder, f"{what}{k}") for what in ("transform", "prefixes")] for k in (0, 1)]
        live = place = np.arange(count)
        new, prefix = symbols[ends - 1], np.zeros(count, common)
        for r in range(1, int(sizes.max()) + 1):
            for x, name in zip((new, prefix), names[(r - 1) & 1]):
                x.tofile(name)
            old, before = (np.fromfile(name, kind) for name, kind in zip(names[(r - 1) & 1], (code.dtype, common)))
            by_symbol, rank, done = _by_symbol(old)
            keep = sizes[live] >= r
            live, place = live[keep], place[keep]
            goes = count + rank[place] - done
            order = np.argsort(goes)
            live, parent, place = live[order], place[order], goes[order]
            fresh = np.zeros(len(old) + len(live) + 1, bool)
            fresh[place] = True
            new = np.empty(len(fresh) - 1, code.dtype)
            new[~fresh[:-1]] = old
            left = sizes[live] - r - 1
            new[place] = np.where(left >= 0, symbols[np.maximum(begin[live] + left, 0)], 0)
            prefix = np.zeros(len(new), common)
            prefix[~fresh[:-1]] = before
            at = rank[parent]
            above = by_symbol[np.maximum(at - 1, 0)]
            same = (at > 0) & (old[above] == old[parent])
            prefix[place[same]] = np.minimum(_least_between(before, above[same], parent[same]), length - 1) + 1
            below = by_symbol[np.minimum(at + 1, len(old) - 1)]
            same = (at + 1 < len(old)) & (old[below] == old[parent]) & ~fresh[place + 1]
            prefix[place[same] + 1] = np.minimum(_least_between(before, parent[same], below[same]), length - 1) + 1
    _, rank, done = _by_symbol(new)
    member, size = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32)
    live = place = np.arange(count)  # the empty suffixes come first, by member
    member[:count] = live
    for r in range(1, int(sizes.max()) + 1):
        keep = sizes[live] >= r
        live, place = live[keep], count + rank[place[keep]] - done
        member[place], size[place] = live, r
    long_ = np.flatnonzero(size >= length)
    return member[long_], sizes[member[long_]] - size[long_], prefix[long_] >= length


def _extent(group: np.ndarray, flank: list[bytes], width: int) -> np.ndarray:
    """Of every member, a bound of the longest prefix of its flank that another member of its group shares."""
    wide = -(-width // 8) * 8
    table_ = np.frombuffer(b"".join(f.ljust(wide, b"\0") for f in flank), np.uint8).reshape(len(flank), wide)
    words = table_.view(">u8")
    order = np.lexsort((*(words[:, k] for k in reversed(range(words.shape[1]))), group))
    sorted_, own = table_[order], group[order]
    differ = sorted_[1:] != sorted_[:-1]
    common = np.where(differ.any(1), differ.argmax(1), wide)
    common[own[1:] != own[:-1]] = -1
    best = np.full(len(flank), -1)
    best[1:] = common
    best[:-1] = np.maximum(best[:-1], common)
    out = np.empty(len(flank), np.int64)
    out[order] = best  # the longest of all is that of a neighbour in order
    return np.minimum(out, [len(f) for f in flank])


def trimmed(group: np.ndarray, members: list[bytes], place: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members that can share ``length`` bytes with another of their group, and the part of each (start, end) that can:
    the anchor with the longest flanks on either side that any other member has too."""
    width = length - gram
    after = _extent(group, [m[p + gram : p + gram + width] for m, p in zip(members, place)], width)
    before = _extent(group, [m[max(0, p - width) : p][::-1] for m, p in zip(members, place)], width)
    index = np.flatnonzero((after >= 0) & (before + gram + after >= length))
    return index, place[index] - before[index], place[index] + gram + after[index]


_SPAN = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("bytes", pa.int32())])
_SPAN_DDL = "doc long, tie long, start int, bytes int"


def repeated_spans(group, doc, tie, start, place, members, length: int = LENGTH, gram: int = GRAM):
    """Spans (index of the member, start in it, bytes) that go, of members which belong to anchors ``group``."""
    index, low, high = trimmed(np.asarray(group), members, np.asarray(place), length, gram)
    if not len(index):
        return []
    member, at, joined = collection_order([members[i][a:b] for i, a, b in zip(index, low, high)], length)
    at = at + low[member]
    member = index[member]
    # Runs of suffixes joined by common prefixes are the occurrences of one string; its earliest one stays.
    run = np.cumsum(~joined)
    order = np.lexsort((start[member] + at, tie[member], doc[member], run))
    member, at, run = member[order], at[order], run[order]
    later = np.zeros(len(run), bool)
    later[1:] = run[1:] == run[:-1]
    member, at = member[later], at[later]
    order = np.lexsort((at, member))
    member, at = member[order], at[order]
    if not len(member):
        return []
    new = np.ones(len(member), bool)
    new[1:] = (member[1:] != member[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(member)) - 1
    return list(zip(member[first], at[first], at[last] - at[first] + length))


def _collections(length: int, gram: int):
    """Rows sorted by anchor in; removed spans out. Whole anchors are gathered up to COLLECTION bytes for one collection."""

    def spans(rows: list) -> pa.RecordBatch:
        group = [r[0] for r in rows]
        doc, tie, start, place = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4))
        found = repeated_spans(group, doc, tie, start, place, [r[5] for r in rows], length, gram)
        return pa.RecordBatch.from_arrays(
            [pa.array([c[k] for c in [(int(doc[i]), int(tie[i]), int(start[i] + a), int(n)) for i, a, n in found]], t) for k, t in enumerate(_SPAN.types)],
            schema=_SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in ("anchor", "doc", "tie", "start", "place", "data"))):
                if size >= COLLECTION and r[0] != rows[-1][0]:
                    yield spans(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
        if rows:
            yield spans(rows)

    return tidy(run)


@tidy
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("place", pa.int32()), ("data", pa.binary())])
    for batch in batches:
        for part in slices(batch, "text"):
            out: list = []
            for doc, tie, text, wanted in zip(*(part.column(n).to_pylist() for n in ("doc", "tie", "text", "wanted"))):
                raw = text.encode()
                out += [(w["anchor"], doc, tie, w["start"], w["place"], raw[w["start"] : w["start"] + w["bytes"]]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)


_RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(length: int, with_text: bool = False):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    if with_text:
        schema = schema.append(pa.field("kept", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc, text, copies, starts, sizes in zip(*(part.column(n).to_pylist() for n in ("doc_id", "text", "copies", "starts", "sizes"))):
                    raw = text.encode()
                    gone = np.zeros(len(raw) + 1, np.int32)
                    if starts:
                        at = np.array(starts)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + np.array(sizes), -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) and gone[0]))
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    out.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
                    if copies > 1:  # later copies of the row itself
                        whole = len(raw) >= length
                        kept = b"" if whole else raw
                        out += [(doc, len(raw), len(raw) if whole else 0, int(whole), hashlib.sha256(kept).hexdigest(), kept)] * (copies - 1)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)

    return tidy(run)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row a row of ``docs``; ``with_text`` adds the kept bytes."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    # Only where ids repeat or lack is a text's hash needed to tell rows apart; else the column is one constant.
    many = read.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count() > 0
    tie = F.xxhash64("text") if many else F.lit(0).cast("long")
    read = read.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("tie", tie)
    cut = read.select("doc", "tie", "text").mapInArrow(_cut(length, gram, many), "anchor long, seg long, doc long, at long" + ", tie long" * many)
    by_anchor = Window.partitionBy("anchor")
    # ``at`` begins with the start, so it orders the places of a text.
    place = ["doc", "tie", F.expr(_START)] if many else ["doc", F.expr(_START)]
    marked = cut.select(
        "*", F.lag("seg").over(by_anchor.orderBy("seg", *place)).alias("prior"),
        (F.min("seg").over(by_anchor) != F.max("seg").over(by_anchor)).alias("several"),
    )
    opens = F.coalesce(F.col("prior") != F.col("seg"), F.lit(True))
    known, goes = F.expr("(at & 1) = 1"), ~opens
    if many:
        # A row that is the same place again (a repeated row's segment) is no other place: it is left to ``copies``.
        own = F.struct("doc", "tie", F.expr(_START))
        marked = marked.withColumn("earliest", F.first(own).over(Window.partitionBy("anchor", "seg").orderBy(*place)))
        goes = goes & (F.col("earliest") != own)
    marked = marked.withColumn("gone", known | goes).where(F.col("gone") | (opens & F.col("several")))
    marked = marked.select("gone", F.when(~F.col("gone"), F.col("anchor")).alias("anchor"), F.when(known, F.col("seg")).alias("span"), "doc", *["tie"] * many, "at")
    marked = materialize(marked, "segments")
    marked = marked.select("gone", "anchor", "doc", F.col("tie") if many else F.lit(0).cast("long").alias("tie"),
                           F.expr(f"CAST({_START} AS INT)").alias("start"), F.coalesce(F.col("span").cast("int"), F.expr(_BYTES)).alias("bytes"), F.expr(_PLACE).alias("place"))
    wanted = marked.where("NOT gone").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "start", "bytes", "place")).alias("wanted"))
    one = read.select("doc", "tie", "text")
    if many:
        one = one.dropDuplicates(["doc", "tie"])
    key = F.xxhash64("doc", "tie")
    one = Slots(marked.where("NOT gone").select(key).distinct()).mark(one, key).where("_may")
    fetched = one.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "wanted").mapInArrow(
        _fetch, "anchor long, doc long, tie long, start int, place int, data binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = fetched.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_collections(length, gram), _SPAN_DDL)
    spans = marked.where("gone").select("doc", "tie", "start", "bytes").unionByName(materialize(found, "spans"))
    by_doc = spans.groupBy("doc", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("bytes").alias("sizes"))
    texts = read.withColumn("copies", F.lit(1).cast("long"))
    if many:
        texts = texts.groupBy("doc", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = Slots(spans.select(key).distinct()).mark(texts, key)
    whole = texts.where("NOT _may").select("doc_id", "text", "copies", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("sizes"))
    cut_ = texts.where("_may").join(by_doc, ["doc", "tie"], "left").select("doc_id", "text", "copies", "starts", "sizes")
    joined = whole.unionByName(cut_)
    return joined.mapInArrow(_kept(length, with_text), _RESULT_DDL + (", kept binary" if with_text else ""))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
