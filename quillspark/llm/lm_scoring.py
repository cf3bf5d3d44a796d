"""Subword-lattice likelihood of documents (operator 6).

The vocabulary is an existing one of subword pieces with scores; a text is words, each written as a mark for its start and
its bytes, and one end. A word's probability is the sum over all its segmentations into pieces of the products of their
probabilities: a forward recursion in log space over the word's lattice. A document's is the product of its words' and the
end's; no piece crosses a word, so this is the marginal over all segmentations of the text. The pieces' probabilities start
from the vocabulary's scores and are fitted to the training documents by expected counts (a forward-backward pass over the
distinct words, weighted by their counts); the end's is its share of the tokens. Single bytes are always pieces, so every
text has a probability.

Counts cover every training document: words are counted inside blocks of documents, summed by word (partial sums first, so
a word of every block is one row a task), scored once each, and a block's own words get their sums and scores by a join,
whose crowded words adaptive execution splits. No vocabulary of the corpus is broadcast or collected: only the pieces (their
number is fixed by the vocabulary file) and three totals pass through the driver.

Defined cases: a null or blank text is the end alone; a null doc_id is the text "null" for the split; repeated rows count as
often as they occur; without any training document all counts are 0 and the pieces keep the vocabulary's scores; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, materialize, table, tidy

#: Bytes of text that a block of documents is meant to have; a task holds a block together with its words' counts.
BLOCK_BYTES = 16 << 20
SPACE = "▁".encode()
#: Weight of the vocabulary's own scores, in tokens, when pieces are fitted.
PRIOR_TOKENS = 1000.0
END = b""
#: Words whose lattices are walked together; (block, word) counts that a task holds before it hands them on.
BATCH_WORDS = 20_000
HELD_WORDS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as bytes."""
    return (text or "").encode().lower().split()


def vocabulary_scores(path: str) -> dict[bytes, float]:
    """Log weights of a sentencepiece file's pieces that can occur: its scores are negative ranks, 1 / (1 - score) the weight.
    The 256 bytes and the mark are always among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i):
            continue
        piece = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).encode()
        if SPACE in piece[1:] or piece != piece.lower():
            continue
        weight[piece] = weight.get(piece, 0.0) + 1.0 / (1.0 - model.get_score(i))
    least = min(weight.values())
    for piece in [SPACE, *(bytes([b]) for b in range(256))]:
        weight.setdefault(piece, least)
    total = sum(weight.values())
    return {p: math.log(w / total) for p, w in sorted(weight.items())}


class Lattices:
    """Lattices of many words at once: edges from a trie of the pieces, sums step by step over all words."""

    def __init__(self, logp: dict[bytes, float]):
        self.pieces = list(logp)
        self.logp = np.array(list(logp.values()))
        nodes: dict[bytes, int] = {}
        for k, p in enumerate(self.pieces):
            for n in range(1, len(p)):
                nodes.setdefault(p[:n], -1)
            nodes[p] = k
        self.longest = max(map(len, nodes))
        text = np.frombuffer(b"".join(nodes), np.uint8)
        end = np.cumsum([len(n) for n in nodes])
        start = np.concatenate(([0], end[:-1]))
        left = (SpanHasher(text)(start, end), np.array(list(nodes.values()), np.int64))
        self.levels = []  # hashed tables without chains: what collides in one goes to the next
        bits = 19
        while len(left[0]):
            slot = (left[0] >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            hashes, pieces = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int64)
            hashes[slot[first]], pieces[slot[first]] = left[0][first], left[1][first]
            self.levels.append((bits, hashes, pieces))
            rest = np.ones(len(slot), bool)
            rest[first] = False
            left = (left[0][rest], left[1][rest])
            bits = 14

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece number, -1 for a mere prefix of one, -2 for neither."""
        found = np.full(len(h), -2, np.int64)
        for bits, hashes, pieces in self.levels:
            slot = (h >> np.uint64(64 - bits)).astype(np.int64)
            hit = hashes[slot] == h
            found[hit] = pieces[slot[hit]]
        return found

    def edges(self, words: list[bytes]):
        """(from, to, piece) over places of the buffer of all words, and each word's first place; a word of n bytes with its
        mark has n + 1 places."""
        marked = [SPACE + w + b"\n" for w in words]  # a word has no \n: no piece crosses words
        size = np.array([len(m) for m in marked])
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(marked), np.uint8)
        hasher = SpanHasher(data)
        at = np.arange(len(data))
        at = np.delete(at, first + size - 1)
        room = np.repeat(first + size - 1, size - 1)
        begin, to, piece = [], [], []
        for n in range(1, self.longest + 1):
            fits = at + n <= room
            at, room = at[fits], room[fits]
            if not len(at):
                break
            found = self._find(hasher(at, at + n))
            whole = found >= 0
            begin.append(at[whole])
            to.append(at[whole] + n)
            piece.append(found[whole])
            at, room = at[found > -2], room[found > -2]
        return np.concatenate(begin), np.concatenate(to), np.concatenate(piece), first, size - 1

    def _sums(self, source, target, weight, depth, values):
        """values[target] = log sum exp(values[source] + weight), in order of depth of the targets."""
        order = np.lexsort((target, depth))
        source, target, weight, depth = source[order], target[order], weight[order], depth[order]
        bounds = np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1], [True])))
        for a, b in zip(bounds[:-1], bounds[1:]):
            goal = target[a:b]
            x = values[source[a:b]] + weight[a:b]
            group = np.flatnonzero(np.concatenate(([True], goal[1:] != goal[:-1])))
            top = np.maximum.reduceat(x, group)
            x = np.exp(x - np.repeat(top, np.diff(np.append(group, b - a))))
            values[goal[group]] = top + np.log(np.add.reduceat(x, group))
        return values

    def forward(self, words: list[bytes]):
        begin, to, piece, first, size = self.edges(words)
        word = np.searchsorted(first, begin, side="right") - 1
        alpha = np.zeros(int(first[-1] + size[-1] + 1))
        self._sums(begin, to, self.logp[piece], to - first[word], alpha)
        return alpha, (begin, to, piece, first, size, word)

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability over all its segmentations."""
        alpha, (_, _, _, first, size, _) = self.forward(words)
        return alpha[first + size]

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected occurrences of every piece in ``counts`` of the words."""
        alpha, (begin, to, piece, first, size, word) = self.forward(words)
        beta = np.zeros(len(alpha))
        self._sums(to, begin, self.logp[piece], first[word] - begin, beta)
        share = np.exp(alpha[begin] + self.logp[piece] + beta[to] - alpha[first + size][word])
        return np.bincount(piece, share * counts[word], len(self.pieces))


@tidy
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, occurrences in training documents): sums of what a task has read, handed on when there are many."""
    schema = pa.schema([("block", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
    held: dict[int, Counter] = {}

    def hand_on():
        for block, seen in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), block)), pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], schema=schema)
        held.clear()

    for batch in batches:
        for block, held_out, text in zip(batch.column("block").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")):
            seen = held.setdefault(block, Counter())
            found = words_of(text.as_py())
            found.append(END)
            if held_out:
                for w in found:
                    if w not in seen:
                        seen[w] = 0
            else:
                seen.update(found)
        if sum(map(len, held.values())) > HELD_WORDS:
            yield from hand_on()
    yield from hand_on()


def _expect(lattices: Lattices):
    schema = pa.schema([("piece", pa.int32()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattices.pieces))
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            for i in range(0, len(words), BATCH_WORDS):
                total += lattices.expected(words[i : i + BATCH_WORDS], counts[i : i + BATCH_WORDS])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=schema)

    return tidy(run)


def _word_scores(lattices: Lattices, end: float):
    """Adds the marginals of distinct words."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("lp", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            lp = [lattices.marginals(words[i : i + BATCH_WORDS]) for i in range(0, len(words), BATCH_WORDS)]
            lp = np.concatenate(lp) if lp else np.zeros(0)
            lp[[i for i, w in enumerate(words) if w == END]] = end
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lp)], schema=schema)

    return tidy(run)


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(total: int, distinct: int):
    whole = math.log10(total + 0.5 * (distinct + 1))

    def run(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        base = np.log10(counts["c"].to_numpy() + 0.5) - whole
        lp = counts["lp"].to_numpy() * math.log10(math.e)
        known = counts["c"].to_numpy() > 0
        place = {w: i for i, w in enumerate(counts["word"])}
        out = []
        for doc, held_out, text in zip(docs["doc_id"], docs["held_out"], docs["text"]):
            found = words_of(text)
            found.append(END)
            at = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
            out.append((None if pd.isna(doc) else int(doc), held_out, len(at), int(known[at].sum()), total, base[at].sum(), lp[at].sum()))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        return made.astype({"doc_id": "Int64"})

    return run


def _blocks(read: DataFrame, block_bytes: int) -> DataFrame:
    """Adds ``block``: runs of neighbouring ids of about so many bytes if the ids are spread evenly. Where they are not, or
    repeat, blocks are cut further by the text's hash; a text that is as long as a block is one by itself."""
    size = F.octet_length("text").cast("long") + 1
    alone = size >= block_bytes
    usual = F.when(~alone, size)
    low, high, total = read.agg(F.min("doc_id"), F.max("doc_id"), F.coalesce(F.sum(usual), F.lit(0))).first()
    width = max(1, block_bytes * ((high or 0) - (low or 0) + 1) // max(total, 1))
    block = F.coalesce(F.expr(f"(CAST(doc_id AS DECIMAL(20)) - {low or 0}) div {width}").cast("long"), F.lit(-1).cast("long"))
    most = read.groupBy(block.alias("b")).agg(F.sum(usual).alias("n")).agg(F.max("n")).first()[0] or 0
    cuts = max(1, math.ceil(most / (2 * block_bytes)))
    cut = block * cuts + F.pmod(F.xxhash64("text"), F.lit(cuts)) if cuts > 1 else block
    own = F.lit(-1) - cuts - F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))  # below all others
    return read.withColumn("block", F.when(alone, own).otherwise(cut))


def lm_scores(docs: DataFrame, vocabulary: str, block_bytes: int = BLOCK_BYTES, prior_tokens: float = PRIOR_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(key.cast("binary")) % 5 == 1).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    read = _blocks(read, block_bytes)
    counted = materialize(read.select("block", "held_out", "text").mapInArrow(_count_words, "block long, word binary, n long"), "word-counts")
    sums = materialize(counted.groupBy("word").agg(F.sum("n").alias("c")), "words")
    known = sums.where("c > 0")
    total, distinct, ends = known.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    logp = vocabulary_scores(vocabulary)
    fitted = known.where(F.length("word") > 0).select("word", "c").mapInArrow(_expect(Lattices(logp)), "piece int, n double")
    counts = np.zeros(len(logp))
    for r in fitted.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # no more rows than pieces
        counts[r["piece"]] = r["n"]
    mass = counts.sum() + prior_tokens
    end = math.log((ends + 0.5) / (mass + ends + 1.0))
    rest = math.log1p(-math.exp(end))
    logp = {p: math.log((n + prior_tokens * math.exp(lp)) / mass) + rest for (p, lp), n in zip(logp.items(), counts)}
    scored = sums.mapInArrow(_word_scores(Lattices(logp), end), "word binary, c long, lp double")
    scored = counted.select("block", "word").join(scored.hint("merge"), "word")
    return (
        read.groupBy("block").cogroup(scored.groupBy("block"))
        .applyInPandas(_score(int(total), int(distinct)), _OUT)
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), default_vocabulary())
