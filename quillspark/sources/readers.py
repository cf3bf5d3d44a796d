"""Readers: text, subtitles, books and documents, run stores, listings. Everything is read by Spark's own file sources."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_to_text

IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".webp")


def text_content(data: Column) -> Column:
    """UTF-8 text with one kind of line end; null for what is no UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(data.cast("string")), "\\r\\n?", "\n")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, content (null where it cannot be read as text, so no chunks come of it). Spark passes over
    empty files, which have no chunks either."""
    return read_binary(spark, path).select("path", text_content(F.col("content")).alias("content"))


def decode(data: Column) -> Column:
    """UTF-8 (a byte order mark is dropped), else Latin-1."""
    text = F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def read_binary(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Visible files, newest first: name, size, MB with two digits, time, extension."""
    name = F.element_at(F.split("path", "/"), -1)
    files = read_binary(spark, path).select(
        name.alias("filename"), F.col("path").alias("file_path"), F.col("length").alias("size_bytes"), F.bround(F.col("length") / 1048576, 2).alias("size_mb"),
        F.col("modificationTime").alias("modified_time"), F.coalesce(F.nullif(F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1), F.lit("")), F.lit("unknown")).alias("file_type"))
    return files.where(~F.col("filename").endswith(".tmp") & ~F.col("filename").startswith("tmp")).orderBy(F.desc("modified_time"), "filename")


def older_than(files: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Z28."""
    return files.where(F.col("modified_time") < as_of - F.expr(f"INTERVAL {hours} HOURS"))


def members(archives: DataFrame) -> DataFrame:
    """Members of zip archives: path, position, name, data (null for what is no archive). An archive is read in one task."""
    schema = "path string, position int, name string, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, i, n, z.read(n)) for i, n in enumerate(z.namelist()) if not n.endswith("/")]
                except zipfile.BadZipFile:
                    rows = [(path, None, None, None)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int32(), pa.string(), pa.binary()])], names=["path", "position", "name", "data"])

    return archives.select("path", "content").mapInArrow(run, schema)


def archive_errors(rows: DataFrame, required: tuple[str, ...], most: int = 10_000, bad: tuple[str, ...] = (".exe", ".bat", ".cmd", ".sh", ".js", ".vbs")) -> DataFrame:
    """path, error (null if the archive is sound)."""
    named = rows.groupBy("path").agg(
        F.count("name").alias("n"), *[F.count_if(F.col("name") == r).alias(f"r{i}") for i, r in enumerate(required)],
        F.max(F.when(F.lower("name").rlike("(" + "|".join(re.escape(b) for b in bad) + ")$"), F.col("name"))).alias("bad"))
    error = F.when(F.col("n") == 0, "Not a valid archive")
    for i, r in enumerate(required):
        error = error.when(F.col(f"r{i}") == 0, f"Missing {r}")
    return named.select("path", error.when(F.col("n") > most, "Too many files").when(F.col("bad").isNotNull(), F.concat(F.lit("Executable file: "), "bad")).alias("error"))


_OPF = {"o": "http://www.idpf.org/2007/opf"}


def _spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("path", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), ("id", pa.string()), ("href", pa.string()), ("media", pa.string())]
    for batch in batches:
        rows = []
        for path, name, data in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "data"))):
            root, base = ET.fromstring(data), posixpath.dirname(name)
            for i, item in enumerate(root.findall(".//o:manifest/o:item", _OPF)):
                href = item.get("href")
                rows.append((path, "item", i, item.get("id"), posixpath.join(base, href) if href else None, item.get("media-type")))
            rows += [(path, "ref", i, ref.get("idref"), None, None) for i, ref in enumerate(root.findall(".//o:spine/o:itemref", _OPF))]
            cover = next((m.get("content") for m in root.findall(".//o:meta", _OPF) if m.get("name") == "cover"), None)
            rows += [(path, "cover", 0, cover, None, None)] * (cover is not None)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def package_entries(rows: DataFrame) -> DataFrame:
    """Manifest items, spine references and the cover's id of each book, from its first ``.opf``."""
    first = rows.where(F.col("name").endswith(".opf")).groupBy("path").agg(F.min_by(F.struct("name", "data"), "position").alias("o"))
    return first.select("path", "o.name", "o.data").mapInArrow(_spine, "path string, kind string, ord int, id string, href string, media string")


def spine_join(entries: DataFrame) -> DataFrame:
    """Content files of a book in the order of its spine."""
    items = entries.where((F.col("kind") == "item") & F.col("href").isNotNull() & F.col("media").isin("application/xhtml+xml", "text/html"))
    refs = entries.where(F.col("kind") == "ref").select("path", "id", F.col("ord").alias("position"))
    return refs.join(items.select("path", "id", "href"), ["path", "id"]).select("path", "position", "href")


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """Path, position, href, html of every content file."""
    rows = members(read_binary(spark, path)).where("name IS NOT NULL")
    files = spine_join(package_entries(rows))
    return files.join(rows.select("path", F.col("name").alias("href"), F.col("data")), ["path", "href"]).select("path", "position", "href", decode(F.col("data")).alias("html"))


def epub_text(files: DataFrame, key: str = "path") -> DataFrame:
    """One text a book, files joined by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct("position", html_to_text(F.col("html")).alias("t"))))
    return files.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def detection_text(files: DataFrame, key: str = "path", enough: int = 10_000) -> DataFrame:
    """Files of a book in order until there are ``enough`` characters."""
    order = Window.partitionBy(key).orderBy("position")
    text = files.withColumn("t", html_to_text(F.col("html")))
    before = F.sum(F.length("t")).over(order) - F.length("t")
    parts = F.array_sort(F.collect_list(F.struct("position", "t")))
    return text.withColumn("b", before).where(F.col("b") < enough).groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def cover(entries: DataFrame, rows: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Path, href of the cover: by metadata, by a usual name, else the manifest's first image; of sound size and type."""
    images = entries.where((F.col("kind") == "item") & F.col("media").startswith("image/"))
    meta = entries.where(F.col("kind") == "cover").select("path", F.col("id").alias("cover_id"))
    ranked = images.join(meta, "path", "left").withColumn("rank", F.when(F.col("id") == F.col("cover_id"), 0).when(F.lower("href").rlike(r"(^|/)cover\.[a-z]+$"), 1).otherwise(2))
    sized = ranked.join(rows.select("path", F.col("name").alias("href"), F.length("data").alias("size")), ["path", "href"])
    good = sized.where((F.col("size") > 0) & (F.col("size") <= most_bytes) & F.lower("href").rlike("(" + "|".join(re.escape(i) for i in IMAGES) + ")$"))
    return good.groupBy("path").agg(F.min_by("href", F.struct("rank", "ord")).alias("href"))


# -- word-processor documents -------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_to_html(data: bytes) -> str:
    """Paragraphs, headings, bold, italics, line breaks and tables of ``word/document.xml``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def run(r) -> str:
        text = "".join(escape(t.text or "", quote=False) if t.tag == f"{_W}t" else "<br/>" if t.tag == f"{_W}br" else "" for t in r)
        props = r.find(f"{_W}rPr")
        for tag, name in (("b", "b"), ("i", "i")):
            if props is not None and props.find(f"{_W}{tag}") is not None and text:
                text = f"<{name}>{text}</{name}>"
        return text

    def block(e) -> str:
        if e.tag == f"{_W}tbl":
            cells = lambda row: "".join(f"<td>{''.join(block(x) for x in c)}</td>" for c in row.findall(f"{_W}tc"))
            return "<table>" + "".join(f"<tr>{cells(r)}</tr>" for r in e.findall(f"{_W}tr")) + "</table>"
        if e.tag != f"{_W}p":
            return ""
        style = e.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"Heading([1-6])", style.get(f"{_W}val") or "") if style is not None else None
        tag = f"h{level.group(1)}" if level else "p"
        return f"<{tag}>{''.join(run(r) for r in e.iter(f'{_W}r'))}</{tag}>"

    return "".join(block(e) for e in body)


def html_to_docx(html: str) -> bytes:
    """Paragraphs, headings, list items and table cells as paragraphs; ``br`` as a line break; the rest is skipped."""
    parts = []
    for tag, inner in re.findall(r"(?is)<(p|h[1-6]|li|td)\b[^>]*>(.*?)</\1>", html):
        text = re.sub(r"(?is)<(?!br\b)[^>]+>", "", inner)
        runs = "</w:t><w:br/><w:t xml:space=\"preserve\">".join(re.split(r"(?i)<br\s*/?>", text))
        style = f'<w:pPr><w:pStyle w:val="Heading{tag[1]}"/></w:pPr>' if tag[0].lower() == "h" else ""
        parts.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{runs}</w:t></w:r></w:p>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(parts)}</w:body></w:document>')
    return out.getvalue()


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Path, html; default font and size as metadata."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [docx_to_html(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.string())], names=["path", "html"])

    rows = read_binary(spark, path).select("path", "content").mapInArrow(run, "path string, html string")
    return rows.withColumn("metadata", F.create_map(F.lit("font"), F.lit("Calibri"), F.lit("size"), F.lit("11")))


# -- stores ------------------------------------------------------------------------------------------------------------

RUN_SCHEMA = """run_id string, started_at string, completed_at string, status string, evaluator_model string, models array<string>, languages array<string>,
  results array<struct<source_text_id: string, target_language: string, model: string, translated_text: string, error: string, translation_time_ms: long, timestamp: string,
    scores: struct<accuracy: double, fluency: double, style: double, overall: double, feedback: string>>>"""


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Whole-run JSON files, newest name first; unreadable ones and those without an id are skipped."""
    runs = spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    runs = runs.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("run_id IS NOT NULL")
    defaults = {"status": F.lit("unknown"), "models": F.array().cast("array<string>"), "languages": F.array().cast("array<string>")}
    return runs.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()}).orderBy(F.desc("file"))


def latest_run(runs: DataFrame) -> DataFrame:
    """O7."""
    return runs.agg(F.max_by("run_id", "file").alias("run_id"))


def run_results(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.posexplode("results").alias("ord", "r")).select("run_id", "ord", "r.*")


REPORT_SCHEMA = """run_id string, status string, total_iterations int, completed_iterations int,
  top_prompts array<struct<id: string, system_prompt: string, user_prompt: string, generation: int, fitness: double>>"""


def read_yaml(text: str):
    """YAML if a parser is installed."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("a YAML parser is needed for this file") from e
    return yaml.safe_load(text)


def language_dimension(spark: SparkSession, tree: dict) -> DataFrame:
    """Categories of languages to rows; codes are text, unknown categories become european_major."""
    known = ("european_major", "european_minor", "asian", "semitic", "indic", "classical")
    rows = [
        (str(x["code"]), x.get("name"), c if c in known else "european_major", x.get("native_name"), bool(x.get("is_rtl", x.get("rtl", False))), x.get("script"))
        for c, part in tree.items() for x in part
    ]
    return spark.createDataFrame(rows, "code string, name string, category string, native_name string, is_rtl boolean, script string")


def text_dimension(spark: SparkSession, texts: list[dict]) -> DataFrame:
    """S13."""
    rows = [(str(t["id"]), t.get("title"), t.get("author"), t.get("year"), (t.get("text") or t.get("content") or "").strip(), t.get("style")) for t in texts]
    return spark.createDataFrame(rows, "id string, title string, author string, year int, content string, style string")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Optimizer reports, with the ranked ``top_prompts`` as an array."""
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)


def best_prompt(reports: DataFrame, position: int = 1) -> DataFrame:
    """The prompt of a rank (1 is the best) of every report; no row where the report ranks fewer."""
    found = reports.select("run_id", F.try_element_at("top_prompts", F.lit(position)).alias("p")).where("p IS NOT NULL")
    return found.select("run_id", "p.*").withColumns({"generation": F.coalesce("generation", F.lit(0)), "fitness": F.coalesce("fitness", F.lit(0.0))})
