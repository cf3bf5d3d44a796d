"""Language identification by Bayesian evidence fusion (operator 10).

log P(language | item) = text + declared language + host prior, up to a constant:

* text: a naive-Bayes model over hashed byte trigrams of lower-cased letters, fitted on a bounded sample of labelled texts
  (``train_rows`` in all, but ``LEAST_ROWS`` of each language that has as many). Every labelled language is known. Trigrams overlap, so n of them weigh as much as 4 sqrt(n) independent ones.
* declared: the markup's lang attribute; right with probability ``TRUST``, else any other language.
* host: shares of languages on a host, smoothed towards its domain's, that towards its address suffix's (with the
  languages that country suffixes stand for), that towards all items'. Shares are sums of the posteriors by text and
  declaration, grouped; an item's own part is taken out of its host's before it is used.

``und`` (no known language) has a uniform text model. An item is rejected if ``und`` is best, if it has no letter, or if the best
language has less than ``threshold``.

Defined cases: a null or letterless text gives language null, rejected; an unknown declared language is no evidence; a null
url or source is a host of its own with nothing known; without labelled texts no language is known and all are rejected;
repeated rows count as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, flat_bytes, materialize, rows_without, slices, table, tidy

BITS = 15
TRAIN_ROWS = 20_000
#: Of a language that the sample would give fewer rows, about so many are taken.
LEAST_ROWS = 625
TRUST = 0.9
THRESHOLD = 0.5
SMOOTHING = 20.0
UND = "und"
#: Country suffixes and the language they speak for.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}
#: Letters (ASCII, and every byte beyond) stand for themselves, all else for a space.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every trigram around a letter, and the rows' numbers of them; texts are framed by spaces."""
    data, offsets = flat_bytes(texts)
    n = len(offsets) - 1
    framed = np.full(len(data) + 2 * n, 32, np.uint8)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    framed[np.arange(len(data)) + 2 * row_of + 1] = _LETTER[_LOWER[data]]
    if len(framed) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    start = offsets[:-1] + 2 * np.arange(n)
    wide = framed.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    row = np.repeat(np.arange(n), np.diff(offsets) + 2)[: len(code)]
    last = np.append(start[1:], len(framed)) - 2  # a trigram must not reach into the next text
    keep = (framed[1:-1] != 32) & (np.arange(len(code)) < last[row])
    bucket = ((code[keep] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    row = row[keep]
    return row, bucket, np.bincount(row, minlength=n)


def _count(languages: list[str]):
    place = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket, _ = trigrams(part.column("text"))
                lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                if len(row):
                    found, n = np.unique((lang[row] << BITS) + bucket, return_counts=True)
                    cells, at = np.unique(np.concatenate((cells, found)), return_inverse=True)
                    counts = np.bincount(at, np.concatenate((counts, n))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], names=["cell", "n"])

    return tidy(run)


class Model:
    """Languages, their log priors, and log P(bucket | language): of each language the value of buckets without a count, and
    those of the others; the last language is ``und``."""

    def __init__(self, languages: list[str], prior: list[float], rest: list[float], seen: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, self.prior, self.rest, self.seen = languages, prior, rest, seen

    def column(self, d: int) -> np.ndarray:
        """All buckets of language ``d``."""
        out = np.full(1 << BITS, self.rest[d], np.float32)
        bucket, value = self.seen[d]
        out[bucket] = value
        return out


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """``labelled``: text, lang and a key to sample by."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(sizes)
    total = sum(sizes.values())
    none = (np.zeros(0, np.int16), np.zeros(0, np.float32))
    if not languages:
        return Model([UND], [0.0], [-BITS * math.log(2)], [none])
    share = min(1.0, train_rows / total)
    rare = {x: min(1.0, LEAST_ROWS / n) for x, n in sizes.items() if share * n < min(n, LEAST_ROWS)}
    cut = F.lit(int(share * (1 << 20)))
    if rare:
        own = F.map_from_arrays(F.lit(list(rare)), F.lit([int(x * (1 << 20)) for x in rare.values()]))
        cut = F.coalesce(F.element_at(own, F.col("lang")), cut)
    sample = labelled.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 20)) < cut)
    cells = sample.select("text", "lang").mapInArrow(_count(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy()  # cells with a count only
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    bounds = np.searchsorted(cell, np.arange(len(languages) + 1) << BITS)
    rest, seen = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        mass = n[lo:hi].sum() + 0.5 * (1 << BITS)
        rest.append(math.log(0.5 / mass))
        seen.append(((cell[lo:hi] & ((1 << BITS) - 1)).astype(np.int16), np.log((n[lo:hi] + 0.5) / mass).astype(np.float32)))
    prior = [math.log(0.999 * sizes[x] / total) for x in languages] + [math.log(0.001)]
    return Model([*languages, UND], prior, [*rest, -BITS * math.log(2)], [*seen, none])


_EVIDENCE = "kind string, id long, host string, domain string, suffix string, declared string, n long, ll array<double>"


def _likelihood(model: Model):
    dims = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, bucket, n = trigrams(part.column("text"))
                total = np.zeros((part.num_rows, dims))
                some = np.flatnonzero(n)
                if len(row):
                    at = np.searchsorted(row, some)
                    for d in range(dims):
                        total[some, d] = np.add.reduceat(model.column(d)[bucket].astype(np.float64), at)
                total *= (np.minimum(n, 4 * np.sqrt(n)) / np.maximum(n, 1))[:, None]
                names = ["kind", "id", "host", "domain", "suffix", "declared"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(np.arange(0, total.size + 1, dims, dtype=np.int32), total.ravel())],
                    names=[*names, "n", "ll"])

    return tidy(run)


def visible_text(html: Column) -> Column:
    """Markup without comments, scripts, styles and tags."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ")


def of_pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    return pages.select(
        F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(F.array_join(F.slice(F.reverse(labels), 1, 2), "."), F.lit("")).alias("domain"),
        F.coalesce(F.element_at(labels, -1), F.lit("")).alias("suffix"),
        F.lower(F.substring(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", 1), 1, 3)).alias("declared"),
        visible_text(F.col("html")).alias("text"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """A document's source is its host; it has no address and no markup."""
    return docs.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.concat(F.lit("source:"), F.col("source").cast("string")), F.lit("source:")).alias("host"),
        F.lit("source").alias("domain"), F.lit("").alias("suffix"), F.lit(None).cast("string").alias("declared"), F.col("text").cast("string").alias("text"),
    )


def _softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def identify(items: DataFrame, model: Model, trust: float = TRUST, threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """kind, id, host, n (trigrams), language, confidence, accepted of every item (columns of ``of_pages``)."""
    dims = len(model.languages)
    names_of = F.lit(model.languages)
    right, wrong = math.log(trust), math.log((1 - trust) / max(1, dims - 1))
    known = (F.col("declared") != UND) & F.array_contains(names_of, F.col("declared"))
    declared = F.transform(names_of, lambda x: F.when(known, F.when(F.col("declared") == x, right).otherwise(wrong)).otherwise(0.0))
    seen = materialize(items.mapInArrow(_likelihood(model), _EVIDENCE), "evidence")
    seen = seen.withColumn("own", F.zip_with("ll", declared, lambda a, b: a + b))
    prior = F.lit(model.prior)
    seen = seen.withColumn("p", F.when(F.col("n") > 0, _softmax(F.zip_with("own", prior, lambda a, b: a + b))))
    names = [f"s{d}" for d in range(dims)]
    sums = [F.coalesce(F.sum(F.element_at("p", d + 1)), F.lit(0.0)).alias(x) for d, x in enumerate(names)]
    hosts = materialize(seen.groupBy("host", "domain", "suffix").agg(*sums), "hosts")

    def smoothed(inner: Column, outer: Column) -> Column:
        total = F.aggregate(inner, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(inner, outer, lambda a, b: (a + smoothing * b) / (total + smoothing))

    def rolled(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in names])

    array = F.array(*names)
    everywhere = [x or 0.0 for x in hosts.agg(*[F.sum(x) for x in names]).first()]  # one number a language
    whole = F.lit([(x + smoothing / dims) / (sum(everywhere) + smoothing) for x in everywhere])
    country = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    speaks = F.transform(names_of, lambda x: F.when(country[F.col("suffix")] == x, smoothing).otherwise(0.0))
    suffixes = rolled(hosts, "suffix").select("suffix", smoothed(F.zip_with(array, speaks, lambda a, b: a + F.coalesce(b, F.lit(0.0))), whole).alias("p1"))
    domains = rolled(hosts, "domain", "suffix").join(suffixes, "suffix").select("domain", "suffix", smoothed(array, F.col("p1")).alias("p2"))
    places = hosts.join(domains, ["domain", "suffix"]).select("host", "domain", "suffix", array.alias("on_host"), "p2")
    fused = seen.join(places, ["host", "domain", "suffix"])
    others = F.zip_with("on_host", F.coalesce("p", F.array(*[F.lit(0.0)] * dims)), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    final = _softmax(F.zip_with("own", smoothed(others, F.col("p2")), lambda a, b: a + F.log(b)))
    fused = fused.withColumn("q", F.when(F.col("n") > 0, final))
    best = F.array_max(F.transform("q", lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))
    out = fused.withColumn("language", F.when(F.col("q").isNotNull(), F.element_at(names_of, 1 - best["i"]))).withColumn("confidence", best["x"])
    accepted = F.coalesce((F.col("language") != UND) & (F.col("confidence") >= threshold), F.lit(False))
    return out.select("kind", "id", "host", "n", "declared", "language", "confidence", accepted.alias("accepted"))


def labelled_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("key"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; doc_id or page_id is null where a row is of the other kind."""
    docs = table(spark, sf_dir, "documents")
    items = of_documents(docs).unionByName(of_pages(table(spark, sf_dir, "pages")))
    out = identify(items, train(labelled_documents(docs)))
    return out.select(
        F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        "host", "declared", "language", "confidence", "accepted",
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are accepted, in all their columns. Rows are told apart by doc_id and their text's hash."""
    marked = of_documents(docs).withColumn("id", F.xxhash64("id", F.coalesce("text", F.lit("")), "host"))
    rejected = identify(marked, train(labelled_documents(docs))).where("NOT accepted").select(F.col("id").alias("_k"))
    source = F.coalesce(F.concat(F.lit("source:"), F.col("source").cast("string")), F.lit("source:"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")), source)
    return rows_without(docs, {"_k": key}, rejected)
