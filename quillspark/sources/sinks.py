"""Rebuilding of outputs and file sinks."""

from __future__ import annotations

import io
import unicodedata
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.placeholders import restore_tags

RULE = "─" * 40


def _joined(key: str, order: str, rows: DataFrame, *made: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, *[m.alias(f"m{i}") for i, m in enumerate(made)])))
    return rows.groupBy(key).agg(parts.alias("p"))


def rebuild_text(rows: DataFrame, key: str, order: str, original: str, translated: str) -> DataFrame:
    """K1: chunks, or their originals, by lines; and both with a rule between the pairs, none at the end."""
    text = F.coalesce(translated, original)
    both = F.concat_ws("\n\n", F.col(original), text, F.lit(RULE))
    made = _joined(key, order, rows, text, both)
    bilingual = F.array_join(F.transform("p", lambda x: x["m1"]), "\n\n")
    return made.select(
        key, F.array_join(F.transform("p", lambda x: x["m0"]), "\n").alias("plain"),
        F.regexp_replace(bilingual, f"\\n\\n{RULE}$", "").alias("bilingual"))


def rebuild_html(rows: DataFrame, key: str, order: str, text: str, tags: Column, original: str | None = None) -> DataFrame:
    """K4: chunks without a separator, tags put back; with ``original``, each pair in blocks of its own."""
    now = F.col(text)
    if original:
        now = F.concat(F.lit('<div class="original">'), F.col(original), F.lit('</div><div class="translation">'), now, F.lit("</div>"))
    made = _joined(key, order, rows, restore_tags(now, tags))
    return made.select(key, F.array_join(F.transform("p", lambda x: x["m0"]), "").alias("html"))


def replace_body(html: Column, body: Column) -> Column:
    """K5: the body's inner markup; nothing in it is read as a pattern."""
    at = F.regexp_extract(html, r"(?is)^(.*?<body[^>]*>)", 1)
    tail = F.regexp_extract(html, r"(?is)(</body>.*)$", 1)
    return F.when((at != "") & (tail != ""), F.concat(at, body, tail)).otherwise(html)


def pack_epub(members: dict[str, bytes]) -> bytes:
    """K6: the ``mimetype`` member first and stored, the rest deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), members.get("mimetype", b"application/epub+zip"), zipfile.ZIP_STORED)
        for name in sorted(m for m in members if m != "mimetype"):
            z.writestr(name, members[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_epubs(members: DataFrame, folder: str) -> DataFrame:
    """K6 over a corpus: ``book, name, data`` to one archive a book in ``folder`` (any file system Spark can write)."""
    def run(group):
        import pandas as pd

        return pd.DataFrame({"book": [group["book"].iloc[0]], "archive": [pack_epub(dict(zip(group["name"], group["data"])))]})

    made = members.groupBy("book").applyInPandas(run, "book string, archive binary")
    made.write.mode("overwrite").parquet(folder)
    return made.sparkSession.read.parquet(folder)


def update_metadata(opf: Column, language: Column, attribution: Column | None = None, compat: bool = False) -> Column:
    """K7: the language element, and an attribution appended to the description. ``compat`` takes the name's first two letters."""
    code = F.substring(F.lower(language), 1, 2) if compat else language
    out = F.regexp_replace(opf, F.lit(r"(?s)(<dc:language[^>]*>).*?(</dc:language>)"), F.concat(F.lit("$1"), code, F.lit("$2")))
    if attribution is not None:
        out = F.regexp_replace(out, F.lit(r"(?s)(<dc:description[^>]*>)(.*?)(</dc:description>)"), F.concat(F.lit("$1$2"), attribution, F.lit("$3")))
    return out


def write_csv(rows: DataFrame, folder: str) -> None:
    """K9."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def append_results(results: DataFrame, folder: str) -> None:
    """Results are appended under their run; nothing is written again."""
    results.write.mode("append").partitionBy("run_id").parquet(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    """K13, K14."""
    rows.write.mode("overwrite").json(folder)


def visual_length(text: str) -> int:
    """Columns on a screen: wide characters and those from U+1F300 on take two."""
    return sum(1 + (unicodedata.east_asian_width(ch) in "WF" or ch >= "\U0001f300") for ch in text)


def markdown_table(rows: DataFrame) -> str:
    """A report as a padded table, '' without rows; all its rows go through the driver, one a model, language or run."""
    body = [["" if v is None else str(v) for v in r] for r in rows.collect()]
    if not body:
        return ""
    wide = [max(map(visual_length, column)) for column in zip(rows.columns, *body)]
    padded = [[x + " " * (w - visual_length(x)) for x, w in zip(cells, wide)] for cells in (rows.columns, *body)]
    lines = [f"| {' | '.join(cells)} |" for cells in padded]
    return "\n".join([lines[0], f"|-{'-|-'.join('-' * w for w in wide)}-|", *lines[1:]])
