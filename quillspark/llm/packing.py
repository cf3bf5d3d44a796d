"""Harmonic packing of token sequences (operator 4).

A document's ids (and its end id) are cut into pieces: whole sequences of ``capacity``, then the remainder's binary digits
down to ``SHORTEST``, then what is left. A piece of n ids belongs to the reciprocal class k = capacity // n, and every bin
of class k takes exactly k pieces, whatever they are: bins are filled by counting, never by searching, and workers share
nothing. Cut at powers of two, classes 1, 2, 4 ... are full to the last id; only the last, shorter pieces pad.

Each task numbers its own pieces within a class and says how many it had; sums of those counts (one row a task and class)
give the piece's number in its class over all tasks, hence bin and place. So a class has one bin that is not full, however
many tasks there are; that bin is cut into bins of powers of two, the lengths that need no padding.

Defined cases: a null or empty text is one piece, the end id; a null doc_id is kept as null; repeated rows are packed as
often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, materialize, slices, table, tidy

CAPACITY = 2048
END_ID = 1
#: Remainders are not cut below this many ids.
SHORTEST = 64
#: Words kept with their ids by a Python worker, twice: of two generations.
CACHE_WORDS = 350_000
#: Bytes of text whose words are looked up together, words that the tokenizer gets as one text, and words it gets at once.
SLICE, JOINED, TURN = 2 << 20, 256, 1 << 13
#: Documents that a worker gets at once.
BATCH_ROWS = 2000
#: White space or case rules that a cut at ASCII white space would not follow: such texts go to the tokenizer whole.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\u00a0\u03a3\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]|<\\|")
#: The rules of a tokenizer whose words may be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "</w>"
#: Letters and the marks behind them are cut apart by that split too.
_MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")
_MARKS = re.compile(r"[!-/:-@\[-`{-~]+")


def splits_at_spaces(rules: dict) -> bool:
    """Whether a tokenizer's file has the rules that ``WordIds`` relies on to encode word by word."""
    pre = rules.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    return (
        (rules.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and first.get("type") == "Split" and first.get("pattern") == {"Regex": _SPLIT}
        and first.get("behavior") == "Removed" and first.get("invert") is True and rules["model"].get("end_of_word_suffix") == _END
        and all(t["content"].startswith("<|") for t in rules.get("added_tokens", []))
    )


class WordIds:
    """Ids of whole texts. Where the tokenizer's rules keep ids inside words, a slice's distinct words are looked up and its
    texts are gathered from them; the words' ids are remembered as bytes. Any other tokenizer gets the texts whole."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self._tokenizer.to_str())
        self.by_word = splits_at_spaces(rules)
        vocabulary = self._tokenizer.get_vocab()
        self._last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._last[[i for t, i in vocabulary.items() if t.endswith(_END)]] = True
        self._most = cache_words
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_turns(self, texts: list[str], n: int) -> Iterator[bytes]:
        """The tokenizer keeps much more of a text than its ids, so it gets ``n`` texts at once."""
        for i in range(0, len(texts), n):
            yield from self._whole(texts[i : i + n])

    def _learn(self, fresh: list[str]) -> None:
        """Runs of letters or of marks have one end each, so many go as one text; other words go one by one."""
        runs = [w for w in fresh if w.isalpha() or _MARKS.fullmatch(w)]
        rest = [w for w in fresh if not (w.isalpha() or _MARKS.fullmatch(w))]
        groups = [runs[i : i + JOINED] for i in range(0, len(runs), JOINED)]
        for group, ids in zip(groups, self._in_turns([" ".join(g) for g in groups], TURN // JOINED)):
            end = 4 * (np.flatnonzero(self._last[np.frombuffer(ids, "<u4")]) + 1)
            if len(end) == len(group):
                self._young.update((w, ids[a:b]) for w, a, b in zip(group, [0, *end.tolist()], end.tolist()))
            else:
                rest += group
        self._young.update(zip(rest, self._in_turns(rest, TURN)))

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        young, old = self._young, self._old
        out = [young.get(w) for w in words]
        parts, fresh = {}, {}
        for i in [i for i, ids in enumerate(out) if ids is None]:
            cut_ = _MARKED.fullmatch(words[i])
            parts[i] = cut_.groups() if cut_ and cut_[1].isalpha() else (words[i],)
            for part in parts[i]:
                if part not in young:
                    if part in old:
                        young[part] = old[part]
                    else:
                        fresh[part] = None
        self._learn(list(fresh))
        for i, found in parts.items():
            out[i] = b"".join(young[part] for part in found)
        if len(young) > self._most:
            self._old, self._young = young, {}
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        if not self.by_word:
            return self._whole(texts)
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]
        low = pa.array([unicodedata.normalize("NFC", t).lower() for t in texts], pa.large_string())
        words = pc.ascii_split_whitespace(low)
        known = words.values.dictionary_encode()
        ids = self._of_words(known.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        index = known.indices.to_numpy()
        n = size[index]
        end = np.cumsum(n)
        source = np.repeat((np.cumsum(size) - size)[index] - (end - n), n)
        source += np.arange(len(source))
        flat = pool[source].tobytes()
        bounds = 4 * np.concatenate(([0], end))[words.offsets.to_numpy()]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i, whole in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = whole
        return out


_TOKENIZERS: dict[tuple[str, int], WordIds] = {}


def tokenizer_of(path: str, cache_words: int = CACHE_WORDS) -> WordIds:
    """One for a Python worker: later tasks find the words of earlier ones."""
    if (path, cache_words) not in _TOKENIZERS:
        _TOKENIZERS[path, cache_words] = WordIds(path, cache_words)
    return _TOKENIZERS[path, cache_words]


def cut(n: int, capacity: int = CAPACITY, shortest: int = SHORTEST) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity >> 1
    while part >= shortest:
        if rest >= part:
            out.append(part)
            rest -= part
        part >>= 1
    return out + [rest] * (rest > 0)


PIECE = pa.schema([
    ("task", pa.int32()), ("rank", pa.int64()), ("class", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()),
    ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
])
_PIECE_DDL = "task int, rank long, class int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, capacity: int, end_id: int, cache_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, ranks = tokenizer_of(path, cache_words), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for n in cut(total, capacity):
                        k = capacity // n
                        k += capacity * (n * k < capacity)
                        ranks[k] = rank = ranks.get(k, -1) + 1
                        rows.append((task, rank, k, doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total))
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECE.types)], schema=PIECE)

    return tidy(run)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its class.

    ``class``: pieces in a bin where capacity / class is the length, else that number and ``capacity``.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batches_of(docs.sparkSession, BATCH_ROWS):
        pieces = materialize(read.mapInArrow(_pieces(tokenizer_path, capacity, end_id, cache_words), _PIECE_DDL), "pieces")
    counts = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = counts.select(
        "class", "task",
        (F.sum("n").over(Window.partitionBy("class").orderBy("task")) - F.col("n")).alias("base"),
    )
    sizes = pieces.groupBy("class").agg(F.count("*").alias("total"))  # one row a class: at most ``capacity`` of them
    placed = pieces.join(before, ["class", "task"]).join(F.broadcast(sizes), "class")
    full, k = F.col("class") <= capacity, F.when(F.col("class") <= capacity, F.col("class")).otherwise(F.col("class") - capacity)
    placed = placed.withColumn("k", k).withColumn("at", (F.col("base") + F.col("rank")).cast("long"))
    placed = placed.withColumn("bin", F.expr("at div k")).withColumn("place", F.expr("at % k"))
    # The last bin of a class of powers of two holds fewer than k pieces: they are dealt, from the first, to bins of 2^j
    # pieces, one for each binary digit of their number. ``first`` is the place in the old bin where a piece's new bin begins.
    left = F.col("total") % F.col("k")
    powers = [1 << j for j in reversed(range(capacity.bit_length()))]
    first = F.lit(0)
    for p in powers:  # digits above p, as long as the place lies beyond them
        above = left - left % (p * 2)
        first = F.when((F.expr(f"{p}") <= left % (p * 2)) & (F.col("place") >= above), above).otherwise(first)
    placed = placed.withColumn("first", F.when(full & (F.col("bin") == F.expr("total div k")), first).otherwise(F.lit(0)).cast("long"))
    sequence = F.col("class").cast("long") * F.lit(1 << 49) + F.col("bin") * F.lit(capacity) + F.col("first")
    placed = placed.withColumn("sequence_id", sequence)
    ragged = Window.partitionBy("sequence_id").orderBy("place")
    even = placed.where(full).withColumn("offset", (F.col("place") - F.col("first")) * F.col("length"))
    odd = placed.where(~full).withColumn("offset", F.sum("length").over(ragged) - F.col("length"))
    return even.unionByName(odd).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"), "class")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
