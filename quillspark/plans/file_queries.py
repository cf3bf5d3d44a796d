"""Queries over archives and files: books and documents are packed from the page table and read back, whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import html_to_text
from ..operators import effects, jobs, metrics, srt
from ..sources import readers, sinks
from .benchmark_queries import oracle_more
from .fixtures import oracle, table, view
from .text_queries import TEXT

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, query, sql=None, ctes=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = oracle_more(ctes, sql) if ctes else oracle(sql)


_BOOKS = 10


def archives(s, d):
    """Ten pages a book: package document, pages in reverse order of the manifest, a cover for every other book."""
    pages = table(s, d, "pages").select((F.col("page_id") / _BOOKS).cast("int").alias("book"), "page_id", "html")

    def pack(group):
        import pandas as pd

        rows = group.sort_values("page_id")
        book = int(rows["book"].iloc[0])
        items = [f'<item id="p{i}" href="p{i}.xhtml" media-type="application/xhtml+xml"/>' for i in reversed(rows["page_id"].tolist())]
        images = [f'<item id="i{k}" href="{n}" media-type="image/png"/>' for k, n in enumerate(["a.png", "cover.png"])]
        refs = [f'<itemref idref="p{i}"/>' for i in rows["page_id"]]
        meta = '<metadata><meta name="cover" content="i0"/></metadata>' if book % 2 else "<metadata/>"
        opf = f'<package xmlns="http://www.idpf.org/2007/opf">{meta}<manifest>{"".join(items + images)}</manifest><spine>{"".join(refs)}</spine></package>'
        files = {"mimetype": b"application/epub+zip", "c.opf": opf.encode(), "a.png": b"a", "cover.png": b"c"}
        if book % 3 == 0:
            files["run.exe"] = b"x"
        files |= {f"p{i}.xhtml": h.encode() for i, h in zip(rows["page_id"], rows["html"])}
        return pd.DataFrame({"path": [str(book)], "content": [sinks.pack_epub(files)]})

    return pages.groupBy("book").applyInPandas(pack, "path string, content binary")


def content(s, d):
    rows = readers.members(archives(s, d)).where("name IS NOT NULL")
    files = readers.spine_join(readers.package_entries(rows))
    return files.join(rows.select("path", F.col("name").alias("href"), "data"), ["path", "href"]).select("path", "position", "href", readers.decode(F.col("data")).alias("html"))


BOOK = "CAST(page_id // 10 AS VARCHAR)"
PLACE = "CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS INT)"
for _n in ("s4", "k6"):
    add(f"{_n}_book_scan", lambda s, d: content(s, d).select("path", "position", "href", F.md5("html").alias("digest")),
        f"SELECT {BOOK} AS path, {PLACE} AS position, 'p' || page_id || '.xhtml' AS href, md5(html) AS digest FROM pages")
add("j7_spine_join", lambda s, d: readers.spine_join(readers.package_entries(readers.members(archives(s, d)).where("name IS NOT NULL"))), f"SELECT {BOOK} AS path, {PLACE} AS position, 'p' || page_id || '.xhtml' AS href FROM pages")
add("s11_detection_text", lambda s, d: readers.detection_text(content(s, d)).select("path", F.md5("text").alias("digest")),
    f"SELECT path, md5(string_agg(t, ' ' ORDER BY page_id)) AS digest FROM (SELECT {BOOK} AS path, page_id, t, coalesce(sum(length(t)) OVER (PARTITION BY page_id // 10 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT page_id, {TEXT} AS t FROM pages)) WHERE before < 10000 GROUP BY 1")
add("s6_book_text", lambda s, d: readers.epub_text(content(s, d)).select("path", F.md5("text").alias("digest")),
    f"SELECT {BOOK} AS path, md5(string_agg(t, chr(10) || chr(10) ORDER BY page_id)) AS digest FROM (SELECT page_id, {TEXT} AS t FROM pages) GROUP BY 1")
for _n in ("s19", "z19"):
    add(f"{_n}_cover", lambda s, d: cover(s, d), f"SELECT path, CASE WHEN CAST(path AS INT) % 2 = 1 THEN 'a.png' ELSE 'cover.png' END AS href FROM (SELECT DISTINCT {BOOK} AS path FROM pages)")


def cover(s, d):
    rows = readers.members(archives(s, d)).where("name IS NOT NULL")
    return readers.cover(readers.package_entries(rows), rows)


def with_bad(s, d):
    bad = table(s, d, "pages").where("page_id % 50 = 0").select(F.concat(F.lit("bad"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    return archives(s, d).unionByName(bad)


add("f10_archive_checks", lambda s, d: readers.archive_errors(readers.members(with_bad(s, d)), ("mimetype", "c.opf")),
    f"SELECT path, CASE WHEN CAST(path AS INT) % 3 = 0 THEN 'Executable file: run.exe' END AS error FROM (SELECT DISTINCT {BOOK} AS path FROM pages) UNION ALL SELECT 'bad' || page_id, 'Not a valid archive' FROM pages WHERE page_id % 50 = 0")
for _n in ("s9", "k16"):
    add(f"{_n}_word_round_trip", lambda s, d: word(s, d), "SELECT doc_id, '<h2>' || source || '</h2><p>' || replace(replace(lang, '&', '&amp;'), '<', '&lt;') || '<br/>x</p>' AS html FROM documents")


def word(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("doc_id"), F.concat(F.lit("<h2>"), "source", F.lit("</h2><p>"), "lang", F.lit("<br/>x</p><hr/>")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [readers.docx_to_html(readers.html_to_docx(h)) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "html"])

    return rows.mapInArrow(run, "doc_id long, html string")


add("k5_replace_body", lambda s, d: table(s, d, "pages").select("page_id", F.md5(sinks.replace_body(F.col("html"), F.col("url"))).alias("digest")),
    "SELECT page_id, md5(CASE WHEN a <> '' AND b <> '' THEN a || url || b ELSE html END) AS digest FROM (SELECT *, regexp_extract(html, '(?is)^(.*?<body[^>]*>)', 1) AS a, regexp_extract(html, '(?is)(</body>.*)$', 1) AS b FROM pages)")
add("k7_metadata", lambda s, d: table(s, d, "pages").select("page_id", sinks.update_metadata(F.concat(F.lit("<dc:language>x</dc:language><dc:description>"), "url", F.lit("</dc:description>")), F.lit("German"), F.lit(" by us"), compat=True).alias("opf")),
    "SELECT page_id, '<dc:language>ge</dc:language><dc:description>' || url || ' by us</dc:description>' AS opf FROM pages")
add("s17_s18_listing", lambda s, d: readers.file_listing(s, f"{d}/nation.parquet").select("filename", "file_type"), "SELECT 'nation.parquet' AS filename, 'parquet' AS file_type")
add("s16_job_lookup", lambda s, d: view(s, d, "v_jobs").where("translation_id = 7").select("translation_id", "status", "file_type"), "SELECT translation_id, status, file_type FROM v_jobs WHERE translation_id = 7")
add("o7_latest_run", lambda s, d: readers.latest_run(view(s, d, "v_results").select(F.col("model").alias("run_id"), F.concat(F.lit("2024-"), F.lpad(F.col("ord").cast("string"), 9, "0")).alias("file"))), "SELECT arg_max(model, ord) AS run_id FROM v_results")
add("o10_set_difference", lambda s, d: table(s, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("l")).select(
        "source", F.array_join(F.array_sort(F.array_except(F.array(F.lit("en"), F.lit("it")), "l")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("l", F.array(F.lit("en"), F.lit("it")))), ",").alias("extra")),
    "SELECT source, array_to_string(list_sort(list_filter(['en', 'it'], lambda x: NOT list_contains(l, x))), ',') AS missing, array_to_string(list_sort(list_filter(l, lambda x: x NOT IN ('en', 'it'))), ',') AS extra FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY 1)")
add("e1_timecodes", lambda s, d: view(s, d, "v_cues").select("file_id", "idx", srt.from_ms(F.col("end_ms") * 977).alias("code"), srt.to_ms(srt.from_ms(F.col("end_ms") * 977)).alias("ms")),
    "SELECT file_id, idx, printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS code, m AS ms FROM (SELECT *, end_ms * 977 AS m FROM v_cues)")
add("e2_age_filter", lambda s, d: view(s, d, "v_jobs").withColumn("created_at", F.col("created_at").cast("timestamp")).select("translation_id", jobs.is_old(F.lit("2000-01-01").cast("timestamp"), 30).alias("old")),
    "SELECT translation_id, created_at <= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 30 DAY AND status IN ('paused', 'interrupted', 'error', 'completed') AS old FROM v_jobs")
add("w8_stability_window", lambda s, d: metrics.usage_window(table(s, d, "events").select("user_id", "event_id", F.col("value").cast("int").alias("used")), "user_id", "event_id", "used").select("user_id", "event_id", "max_usage"),
    "SELECT user_id, event_id, max(CAST(trunc(value) AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS max_usage FROM events")
add("j11_neighbours", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("before"), F.coalesce(F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("after")),
    "SELECT conv_id, turn, coalesce(lag(role) OVER w, '') AS before, coalesce(lead(role) OVER w, '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
add("t7_checkpoints", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", ((F.col("turn") + 1) % 5 == 0).alias("fifth"), (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))).alias("last")).where("fifth OR last").select("conv_id", "turn"),
    "SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE (turn + 1) % 5 = 0 OR turn = m")
add("z27_state_files", lambda s, d: table(s, d, "pages").select("page_id", F.col("url").alias("href"), F.concat(F.regexp_replace("url", r"[/\\]", "_"), F.lit(".json")).alias("file")), "SELECT page_id, url AS href, regexp_replace(url, '[/\\\\]', '_', 'g') || '.json' AS file FROM pages")
add("z28_old_files", lambda s, d: table(s, d, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp") - F.expr("INTERVAL 24 HOURS")).select("event_id"), "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-14 00:00:00'")
add("k10_k13_reports", lambda s, d: metrics.error_summary(view(s, d, "v_errors")).where("error_type IS NULL AND severity IS NULL").select("total", "critical"), "SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical FROM v_errors")
add("s14_s15_runs", lambda s, d: runs(s, d), "SELECT 'r' || source_text_id AS run_id, count(*) AS results, count(overall) AS scored FROM v_results GROUP BY 1")


def runs(s, d):
    """Runs as nested rows, flattened as they are read from their files."""
    r = view(s, d, "v_results")
    nested = r.groupBy(F.concat(F.lit("r"), F.col("source_text_id").cast("string")).alias("run_id")).agg(F.collect_list(F.struct("model", "overall")).alias("results"))
    return readers.run_results(nested).groupBy("run_id").agg(F.count("*").alias("results"), F.count("overall").alias("scored"))


add("s12_s13_dimensions", lambda s, d: readers.language_dimension(s, {"asian": [{"code": "ja", "name": "Japanese", "is_rtl": False}], "other": [{"code": 1, "name": "One", "is_rtl": True}]}).select("code", "category", "is_rtl"),
    "SELECT 'ja' AS code, 'asian' AS category, false AS is_rtl UNION ALL SELECT '1', 'european_major', true")
add("s6_plain_pages", lambda s, d: table(s, d, "pages").select("page_id", F.length(html_to_text(F.col("html"))).alias("n")), f"SELECT page_id, CAST(length({TEXT}) AS INT) AS n FROM pages")


def text_files(s, d):
    """Texts as files; every seventh is no UTF-8."""
    data = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("0D0A"))))
    return table(s, d, "documents").select(F.col("doc_id").alias("file_id"), readers.text_content(data).alias("content"))


add("s1_text_source", lambda s, d: text_files(s, d).select("file_id", F.col("content").isNotNull().alias("readable"), F.md5("content").alias("digest")),
    "SELECT doc_id AS file_id, doc_id % 7 <> 0 AS readable, CASE WHEN doc_id % 7 <> 0 THEN md5(replace(text, chr(13), chr(10)) || chr(10)) END AS digest FROM documents")


def reports(s, d):
    """A report a language, as JSON and back; its prompts are the sources, ranked by their summed lengths."""
    ranked = table(s, d, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("f"))
    prompt = F.struct(F.col("source").alias("id"), F.lit("s").alias("system_prompt"), F.lit("u").alias("user_prompt"), F.col("f").cast("double").alias("fitness"))
    rows = ranked.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("f")).alias("down"), "source", prompt.alias("p")))), lambda x: x["p"]).alias("top_prompts"))
    text = rows.select(F.to_json(F.struct(F.col("lang").alias("run_id"), "top_prompts")).alias("j"))
    return text.select(F.from_json("j", readers.REPORT_SCHEMA).alias("r")).select("r.*")


add("s20_best_prompt", lambda s, d: readers.best_prompt(reports(s, d), 2).select("run_id", "id", "generation", "fitness"),
    "SELECT lang AS run_id, source AS id, 0 AS generation, CAST(f AS DOUBLE) AS fitness FROM (SELECT lang, source, sum(n_chars) AS f, row_number() OVER (PARTITION BY lang ORDER BY sum(n_chars) DESC, source) AS r FROM documents GROUP BY 1, 2) WHERE r = 2")
add("k11_markdown_table", lambda s, d: s.createDataFrame([(sinks.markdown_table(by_source(s, d)),)], "page string"),
    """SELECT '| ' || rpad('source', a, ' ') || ' | ' || rpad('n', b, ' ') || ' |' || chr(10) || '|-' || repeat('-', a) || '-|-' || repeat('-', b) || '-|' || chr(10)
      || (SELECT string_agg('| ' || rpad(source, a, ' ') || ' | ' || rpad(n, b, ' ') || ' |', chr(10) ORDER BY source) FROM m) AS page
    FROM (SELECT CAST(greatest(6, max(length(source))) AS INT) AS a, CAST(greatest(1, max(length(n))) AS INT) AS b FROM m)""",
    "m AS (SELECT source, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY 1)")


def by_source(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


def updates(s, d):
    """A chunk's completion as an update; one line in seven belongs to no job (a negated key would: order 0 is its own), one in
    three brings its own stats."""
    line = F.col("l_linenumber")
    return table(s, d, "lineitem").select(
        F.when(line != 7, F.col("l_orderkey")).alias("translation_id"), line.alias("chunk"),
        F.when(line % 3 == 0, F.concat(F.lit("u"), line.cast("string"))).alias("stats"),
        F.when(line % 2 == 0, "llm_response").otherwise("info").alias("log_type"), F.concat(F.lit("r"), line.cast("string")).alias("response"))


progress_jobs = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("translation_id"), F.col("o_orderstatus").alias("stats"))
add("k18_progress_events", lambda s, d: effects.progress_events(updates(s, d), progress_jobs(s, d)).select("translation_id", "chunk", "stats"),
    "SELECT l_orderkey AS translation_id, l_linenumber AS chunk, CASE WHEN l_linenumber % 3 = 0 THEN 'u' || l_linenumber ELSE o_orderstatus END AS stats FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 7")
add("k18_last_translation", lambda s, d: effects.last_translations(updates(s, d), progress_jobs(s, d), "chunk"),
    "SELECT l_orderkey AS translation_id, 'r' || max(l_linenumber) AS last_translation FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 0 AND l_linenumber <> 7 GROUP BY 1")
