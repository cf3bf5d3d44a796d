"""Subtitles: parsing, blocks, encoding for a model and decoding of its answer, rebuilding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES, CHARS = 5, 500


def parse(files: DataFrame, content: str = "content") -> DataFrame:
    """One row a valid cue; blocks without number, timecode or text are dropped."""
    text = F.regexp_replace(F.col(content), r"\r\n?", "\n")
    blocks = files.select("file_id", F.posexplode(F.split(text, r"\n\n")).alias("block", "raw"))
    lines = F.split(F.regexp_replace("raw", r"^\s+|\s+$", ""), "\n")
    times = F.element_at("lines", 2)
    cues = blocks.withColumn("lines", lines).where((F.size("lines") >= 3) & F.element_at("lines", 1).rlike(r"^\d+$"))
    cues = cues.where(times.rlike(r"^\d{2}:\d{2}:\d{2},\d{3}\s*-->\s*\d{2}:\d{2}:\d{2},\d{3}"))
    return cues.select(
        "file_id", "block", F.element_at("lines", 1).alias("number"), F.regexp_extract(times, r"^(\S+?)\s*-->", 1).alias("start_time"),
        F.regexp_extract(times, r"-->\s*(\d{2}:\d{2}:\d{2},\d{3})", 1).alias("end_time"), F.array_join(F.slice("lines", 3, 100_000), "\n").alias("text"))


def to_ms(time: Column) -> Column:
    """E1."""
    part = lambda i: F.regexp_extract(time, r"(\d+):(\d+):(\d+),(\d+)", i).cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def from_ms(ms: Column) -> Column:
    n = ms.cast("long")
    div = lambda a, b: F.floor(a / b)
    return F.format_string("%02d:%02d:%02d,%03d", div(n, 3_600_000), div(n, 60_000) % 60, div(n, 1000) % 60, n % 1000)


def plain_text(cues: DataFrame) -> DataFrame:
    """Non-empty cues' texts of a file joined by spaces."""
    rows = cues.where(F.col("text").rlike(r"\S"))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("plain"))


def block_numbers(texts: Column, lines: int = LINES, chars: int = CHARS) -> Column:
    """A block number for each cue of a file (-1 for a blank cue without an open block). Up to ``lines`` cues and
    ``chars`` characters; a blank cue joins an open block at no characters, but as a line."""
    def add(acc, text):
        blank = ~F.regexp_like(text, F.lit(r"\S"))
        n = F.when(blank, 0).otherwise(F.length(text))
        full = (acc["lines"] >= lines) | (acc["chars"] + n > chars)
        opens = ~blank & ((acc["lines"] == 0) | full)
        stays_out = blank & ((acc["lines"] == 0) | (acc["lines"] >= lines))
        number = F.when(opens, acc["block"] + 1).otherwise(acc["block"])
        return F.struct(
            number.cast("int").alias("block"), F.when(opens, 1).when(stays_out, F.when(acc["lines"] >= lines, 0).otherwise(acc["lines"])).otherwise(acc["lines"] + 1).cast("int").alias("lines"),
            F.when(opens, n).when(stays_out, F.when(acc["lines"] >= lines, 0).otherwise(acc["chars"])).otherwise(acc["chars"] + n).cast("int").alias("chars"),
            F.concat(acc["ids"], F.array(F.when(stays_out, -1).otherwise(number).cast("int"))).alias("ids"))
    start = F.struct(F.lit(-1).alias("block"), F.lit(0).alias("lines"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("ids"))
    return F.aggregate(texts, start, add, lambda acc: acc["ids"])


def blocks(cues: DataFrame) -> DataFrame:
    """Cues with their block and the place in it. A file's cues are folded together; a file is one subtitle track."""
    files = cues.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("cues"))
    numbered = files.withColumn("ids", block_numbers(F.transform("cues", lambda c: c["text"])))
    rows = numbered.select("file_id", F.explode(F.arrays_zip("cues", "ids")).alias("z")).select("file_id", F.col("z.cues.idx").alias("idx"), F.col("z.cues.text").alias("text"), F.col("z.ids").alias("block"))
    place = F.row_number().over(Window.partitionBy("file_id", "block").orderBy("idx")) - 1
    return rows.where("block >= 0").withColumn("local", place)


def encode(blocked: DataFrame) -> DataFrame:
    """One text a block, ``[local]text`` a cue, with the last text before and the first after."""
    parts = F.array_sort(F.collect_list(F.struct("local", "text", "idx")))
    made = blocked.groupBy("file_id", "block").agg(parts.alias("p"))
    line = lambda x: F.concat(F.lit("["), x["local"].cast("string"), F.lit("]"), x["text"])
    order = Window.partitionBy("file_id").orderBy("block")
    return made.select(
        "file_id", "block", F.array_join(F.transform("p", line), "\n").alias("content"), F.transform("p", lambda x: x["idx"]).alias("global_indices"),
        F.coalesce(F.lag(F.element_at("p", -1)["text"]).over(order), F.lit("")).alias("before"), F.coalesce(F.lead(F.element_at("p", 1)["text"]).over(order), F.lit("")).alias("after"))


def decode(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Rows of (file_id, idx, text) from a block's answer: every ``[n]`` begins a body that may span lines,
    a later body of a number replaces an earlier one, empty bodies and unknown numbers are dropped."""
    text = F.regexp_replace(F.col(answer), r"(\S)[ \t]+(\[\d+\])", "$1\n$2")
    body = r"(?ms)^\s*\[(\d+)\](.*?)(?=^\s*\[\d+\]|\z)"
    numbers, bodies = F.regexp_extract_all(text, F.lit(body), 1), F.regexp_extract_all(text, F.lit(body), 2)
    rows = answers.select("file_id", "block", "global_indices", F.posexplode(F.arrays_zip(numbers.alias("n"), bodies.alias("b"))).alias("pos", "z"))
    rows = rows.select("file_id", "block", "pos", F.try_element_at("global_indices", F.col("z.n").cast("int") + 1).alias("idx"), F.regexp_replace("z.b", r"^\s+|\s+$", "").alias("text"))
    rows = rows.where("idx IS NOT NULL AND text <> ''")
    return rows.groupBy("file_id", "idx").agg(F.max(F.struct("block", "pos", "text"))["text"].alias("text"))


def apply_translations(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """A cue without a translation keeps its text."""
    t = translations.select("file_id", "idx", F.col("text").alias("_t"))
    joined = cues.join(t, ["file_id", "idx"], "left").withColumn("original_text", F.col("text"))
    return joined.withColumn("text", F.coalesce("_t", "text")).drop("_t")


def rebuild(cues: DataFrame, bilingual: bool = False) -> DataFrame:
    """K2, K3: one SRT a file, from ``number, start_ms, end_ms, text`` (and ``original_text`` above it)."""
    body = F.concat_ws("\n", "original_text", "text") if bilingual else F.col("text")
    cue = F.concat("number", F.lit("\n"), from_ms(F.col("start_ms")), F.lit(" --> "), from_ms(F.col("end_ms")), F.lit("\n"), body, F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("idx", cue.alias("c"))))
    return cues.groupBy("file_id").agg(F.array_join(F.transform(parts, lambda x: x["c"]), "\n").alias("srt"))


def carried_context(blocked: DataFrame, last: int = 5) -> DataFrame:
    """The last cues of the block before, numbered anew."""
    parts = F.array_sort(F.collect_list(F.struct("local", "text")))
    made = blocked.groupBy("file_id", "block").agg(F.transform(parts, lambda x: x["text"]).alias("t"))
    before = F.lag("t").over(Window.partitionBy("file_id").orderBy("block"))
    tail = F.slice(before, F.greatest(F.size(before) - last + 1, F.lit(1)), last)
    line = F.transform(tail, lambda t, i: F.concat(F.lit("["), i.cast("string"), F.lit("]"), t))
    return made.select("file_id", "block", F.coalesce(F.array_join(line, "\n"), F.lit("")).alias("context"))


def merge_continuations(cues: list[str], most: int = 100) -> list[list[int]]:
    """Groups of cues: one goes on if it ends no sentence, the next begins without a capital (but I), and both fit."""
    groups: list[list[int]] = []
    text = ""
    for i, cue in enumerate(cues):
        first = cue[:1]
        goes_on = groups and not text.rstrip().endswith((".", "!", "?")) and (not first.isupper() or cue.split(" ")[0] == "I") and len(text) + 1 + len(cue) <= most
        if goes_on:
            groups[-1].append(i)
            text += " " + cue
        else:
            groups.append([i])
            text = cue
    return groups
