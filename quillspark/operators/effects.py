"""Outward effects as pluggable stages with offline stubs: speech, progress events, bounded batches, resumable streams."""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.chunking import speech_chunks
from ..functions.exact import speech_text

RATE = 24_000
#: Bytes of audio in a row, in rows that are sent together, and kept in memory of a file that is not finished.
PART, SENT, SPOOL = 256 << 10, 2 << 20, 32 << 20


def silence(text: str) -> bytes:
    """K17's stub: 16-bit samples, a hundred for each character."""
    return b"\0\0" * (100 * len(text))


SPEAKERS: dict[str, Callable[[str], bytes]] = {"silence": silence}


def wav_head(size: int, rate: int = RATE) -> bytes:
    """What stands before ``size`` bytes of samples; a size that 32 bits do not hold is given as their largest, as in streams."""
    size = min(size, 0xFFFFFFFF - 36)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", size)


def audio_parts(chunks: list[str], say: Callable[[str], bytes], gap: bytes, most: int = PART) -> Iterator[bytes]:
    """The file of ``chunks`` with ``gap`` between them, in parts of ``most`` bytes and a last one. Its head says how long it is,
    so samples are kept until the last chunk is spoken, on disk from ``SPOOL`` bytes on."""
    with tempfile.SpooledTemporaryFile(SPOOL) as samples:
        for i, chunk in enumerate(chunks):
            if i:
                samples.write(gap)
            samples.write(say(chunk))
        head = wav_head(samples.tell())
        samples.seek(0)
        part = head + samples.read(most - len(head))
        while part:
            yield part
            part = samples.read(most)


def _files(batches: Iterator[pa.RecordBatch], speaker: str, most: int, pause: float) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """file, doc_id and the parts of every document's file, made one after the other."""
    say, gap = SPEAKERS[speaker], b"\0\0" * int(pause * RATE)
    for batch in batches:
        for file, doc, text in zip(*(batch.column(c) for c in ("file", "doc_id", "text"))):
            chunks = speech_chunks(speech_text(text.as_py() or ""), most)
            yield file.as_py(), doc.as_py(), audio_parts(chunks, say, gap)


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("file"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def speak(docs: DataFrame, speaker: str = "silence", most: int = 5000, pause: float = 0.5) -> DataFrame:
    """File, doc_id, part, audio: a document's chunks spoken one after the other, with a pause between them.

    ``file`` tells documents apart (a doc_id may be null or there twice). A file has parts of ``PART`` bytes, from 0, and a last
    one: joined in order they are it. So neither a long text nor many texts in a batch are held as audio at once.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "doc_id", "part", "audio"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file, doc, parts in _files(batches, speaker, most, pause):
            for part, audio in enumerate(parts):
                rows.append((file, doc, part, audio))
                size += len(audio)
                if size >= SENT:
                    yield sent(rows)
                    rows, size = [], 0
        if rows:
            yield sent(rows)

    return _numbered(docs).mapInArrow(run, "file long, doc_id long, part int, audio binary")


def audio_sizes(docs: DataFrame, speaker: str = "silence", most: int = 5000, pause: float = 0.5) -> DataFrame:
    """doc_id, bytes: samples in every document's file. The files are made whole, as ``speak`` makes them, and measured part
    by part where they are made: a hundred times a text's size need not go to the JVM to be measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _files(batches, speaker, most, pause)
        head = len(wav_head(0))
        while rows := [(doc, sum(map(len, parts)) - head) for _, doc, parts in islice(made, 1000)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "bytes"])

    return _numbered(docs).mapInArrow(run, "doc_id long, bytes long")


def in_batches(rows: DataFrame, order: str, size: int = 5) -> DataFrame:
    """The number of the batch of ``size`` that a row belongs to, by its dense 0-based ``order``. How many batches run at
    once is the number of tasks."""
    return rows.withColumn("batch", F.floor(F.col(order) / size))


def progress_events(updates: DataFrame, jobs: DataFrame) -> DataFrame:
    """What is pushed of ``updates``: those of known jobs, with the job's own ``stats`` where they bring none."""
    known = jobs.select("translation_id", F.col("stats").alias("job_stats"))
    made = updates.join(known, "translation_id").withColumn("stats", F.coalesce("stats", "job_stats"))
    return made.select(*updates.columns)


def last_translations(updates: DataFrame, jobs: DataFrame, order: str) -> DataFrame:
    """The newest model answer of every known job that had one, for a view that is opened again."""
    answers = updates.where("log_type = 'llm_response' AND response <> ''").groupBy("translation_id").agg(F.max_by("response", order).alias("last_translation"))
    return answers.join(jobs.select("translation_id"), "translation_id")


def push_progress(stream: DataFrame, emit: Callable[[dict], None], checkpoint: str, every: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """After each micro-batch, its number of rows goes to ``emit``. The checkpoint folder is what a restart goes on
    from: a batch that was done is not done again."""

    def done(batch: DataFrame, number: int) -> None:
        rows = every(batch) if every else batch
        emit({"batch": number, "rows": rows.count()})

    return stream.writeStream.foreachBatch(done).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
