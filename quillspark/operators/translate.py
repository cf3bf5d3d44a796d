"""Model calls as a pluggable stage, and the policies around them (offline stubs only; nothing here reaches a network).

A provider maps a batch of prompts to answers. ``generate`` runs it over Arrow batches, one provider a Python worker; equal
prompts can be asked once and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import placeholders as p
from ..functions.exact import align
from ..functions.text import answer_or_raw, extract_answer

Provider = Callable[[list[str]], list[str]]
PROVIDERS: dict[str, Callable[[], Provider]] = {
    "echo": lambda: lambda prompts: prompts,
    "tagged": lambda: lambda prompts: [f"<TRANSLATION>{t.replace('e', 'E')}</TRANSLATION>" for t in prompts],
    "stub": lambda: lambda prompts: [t.replace("e", "E") for t in prompts],
}


def register(name: str, factory: Callable[[], Provider]) -> None:
    PROVIDERS[name] = factory


def generate(rows: DataFrame, prompt: str, provider: str, answer: str = "answer", distinct: bool = False) -> DataFrame:
    """``rows`` with the provider's answer to each prompt."""
    factory = PROVIDERS[provider]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = factory()
        for batch in batches:
            made = pa.array(ask([t or "" for t in batch.column(prompt).to_pylist()]), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, answer])

    if distinct:
        asked = generate(rows.select(prompt).distinct(), prompt, provider, answer)
        return rows.join(asked, prompt, "left")
    schema = T.StructType([*rows.schema.fields, T.StructField(answer, T.StringType())])
    return rows.mapInArrow(run, schema)


def three_phase(rows: DataFrame, provider: str = "stub") -> DataFrame:
    """The answer if its placeholders are valid; else one asked without placeholders, which are put back by place; else
    the original. ``rows``: doc_id, text, expected, first (the first answer)."""
    bare = generate(rows.withColumn("bare", p.remove_all(F.col("text"))), "bare", provider, "second")
    schema = T.StructType([*bare.schema.fields, T.StructField("aligned", T.StringType())])

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [align(o or "", s or "") for o, s in zip(batch.column("text").to_pylist(), batch.column("second").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "aligned"])

    tried = bare.mapInArrow(put_back, schema)
    ok = lambda c: p.validate(F.col(c), F.col("expected")).isNull() & F.col(c).isNotNull()
    return tried.select(
        "doc_id", F.when(ok("first"), F.col("first")).when(ok("aligned"), F.col("aligned")).otherwise(F.col("text")).alias("result"),
        F.when(ok("first"), 1).when(ok("aligned"), 2).otherwise(3).alias("phase"))


def two_pass(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Translate, then refine the draft; a refinement that fails keeps the draft, a failed draft the text."""
    draft = generate(rows, text, "tagged", "raw").withColumn("draft", F.coalesce(extract_answer(F.col("raw")), F.col(text)))
    refined = generate(draft, "draft", "tagged", "raw2")
    return refined.select(*keys, F.coalesce(extract_answer(F.col("raw2")), F.col("draft")).alias("result"))


def per_cue(cues: DataFrame) -> DataFrame:
    """Each cue asked by itself; blank ones pass."""
    asked = generate(cues, "text", "stub", "answer")
    return asked.withColumn("result", F.when(F.col("text").rlike(r"\S"), answer_or_raw(F.col("answer"), F.lit("\u0000"))).otherwise(F.col("text")))


def refine_cues(cues: DataFrame) -> DataFrame:
    """A cue with its translated neighbours; a refinement that fails (null) keeps the draft."""
    order = Window.partitionBy("file_id").orderBy("idx")
    return cues.select(
        "file_id", "idx", F.coalesce(F.lag("draft").over(order), F.lit("")).alias("before"), F.coalesce(F.lead("draft").over(order), F.lit("")).alias("after"),
        F.coalesce("refined", "draft").alias("result"))


def failed_or(translated: Column, original: Column) -> Column:
    """What a rebuilt text shows for a chunk."""
    return F.coalesce(translated, original)
