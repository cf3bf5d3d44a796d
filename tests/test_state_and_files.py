"""State machines in batches and streams; archives, books, runs and reports on disk."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import jobs, optimizer, translate
from quillspark.sources import readers, sinks
from quillspark.streaming import state


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, client string, ts double, used int, truncated boolean, ok boolean, token string").withColumn("ts", F.timestamp_seconds("ts"))


ROWS = [(i, "ab"[i % 2], float(i * 3), 1000 + 137 * i % 2500, i % 11 == 0, i % 3 == 0, "x") for i in range(120)]


def limiter_by_hand(times, most, window):
    log, out = [], []
    for t in times:
        log = [x for x in log if x > t - window]
        out.append(len(log) < most)
        if out[-1]:
            log.append(t)
    return out


def test_rate_limiter(spark):
    got = state.run_batch(events(spark, ROWS), state.rate_limiter(4, 60.0), "client").collect()
    for key in "ab":
        mine = [r.allowed for r in sorted((r for r in got if r.key == key), key=lambda r: r.tie)]
        assert mine == limiter_by_hand([r[2] for r in ROWS if r[1] == key], 4, 60.0)


def test_adaptive_context_grows_and_shrinks():
    m = state.adaptive_context()
    now, sizes = m.start, []
    for used, cut in [(2000, False), (4000, False), (100, True)] + [(100, False)] * 12:
        now, out = m.step(now, {"used": used, "truncated": cut})
        sizes.append(out["context"])
    assert sizes[:3] == [4096, 6144, 8192] and sizes[-1] < 8192 and min(sizes) >= 2048


def test_circuit_breaker():
    m = state.circuit_breaker(2, 60.0, 2)
    now, seen = m.start, []
    for ts, ok in [(0, False), (1, True), (2, False), (3, False), (10, True), (64, True), (65, True), (66, True)]:
        now, out = m.step(now, {"ts": float(ts), "ok": ok})
        seen.append((out["allowed"], out["state"]))
    assert seen == [(True, "closed"), (True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed")]


@pytest.mark.parametrize("machine", [state.rate_limiter(4, 60.0), state.adaptive_context(), state.circuit_breaker()], ids=["limiter", "context", "breaker"])
def test_stream_equals_batch(spark, tmp_path, machine):
    source = tmp_path / "in"
    rows = events(spark, ROWS)
    for part in range(3):
        rows.where(f"event_id >= {40 * part} AND event_id < {40 * part + 40}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(str(source))
    name = "out_" + machine.output.split()[0]
    query = state.run_stream(stream, machine, "client").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        query.processAllAvailable()
        assert query.exception() is None
        want = {tuple(r) for r in state.run_batch(rows, machine, "client").collect()}
        assert {tuple(r) for r in spark.table(name).collect()} == want
    finally:
        query.stop()


OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata><meta name="cover" content="img2"/></metadata><manifest>
<item id="c2" href="two.xhtml" media-type="application/xhtml+xml"/><item id="c1" href="one.xhtml" media-type="application/xhtml+xml"/>
<item id="img1" href="a.png" media-type="image/png"/><item id="img2" href="b.png" media-type="image/png"/><item id="css" href="s.css" media-type="text/css"/>
</manifest><spine><itemref idref="c1"/><itemref idref="c2"/><itemref idref="css"/></spine></package>"""


def test_books(spark, tmp_path):
    files = {"mimetype": b"application/epub+zip", "OEBPS/book.opf": OPF.encode(), "OEBPS/one.xhtml": b"<body><p>One &amp; all</p></body>",
             "OEBPS/two.xhtml": "<body>Zwei é<script>x</script></body>".encode(), "OEBPS/a.png": b"1", "OEBPS/b.png": b"2"}
    (tmp_path / "b.epub").write_bytes(sinks.pack_epub(files))
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    import zipfile

    first = zipfile.ZipFile(tmp_path / "b.epub").infolist()[0]
    assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED
    got = readers.read_epub(spark, str(tmp_path))
    assert [r.href for r in got.orderBy("position").collect()] == ["OEBPS/one.xhtml", "OEBPS/two.xhtml"]
    assert readers.epub_text(got).first().text == "One & all\n\nZwei é"
    assert readers.detection_text(got, enough=3).first().text == "One & all"
    rows = readers.members(readers.read_binary(spark, str(tmp_path)))
    errors = {r.path.rsplit("/")[-1]: r.error for r in readers.archive_errors(rows, ("mimetype",)).collect()}
    assert errors == {"b.epub": None, "bad.epub": "Not a valid archive"}
    sound = rows.where("name IS NOT NULL")
    assert readers.cover(readers.package_entries(sound), sound).first().href == "OEBPS/b.png"
    listing = readers.file_listing(spark, str(tmp_path)).collect()
    assert {r.file_type for r in listing} == {"epub"}
    assert readers.older_than(readers.file_listing(spark, str(tmp_path)), F.lit("2001-01-01").cast("timestamp"), 1).count() == 0


def test_word_documents(spark, tmp_path):
    html = "<h2>Title</h2><p>Hello<br/>you</p>"
    (tmp_path / "d.docx").write_bytes(readers.html_to_docx(html))
    assert readers.read_docx(spark, str(tmp_path)).first().html == html


def test_text_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é x".encode("latin-1"))
    assert readers.read_binary(spark, str(tmp_path)).select(readers.decode(F.col("content")).alias("t")).first().t == "é x"
    (tmp_path / "a.txt").write_text("two\nlines")
    assert readers.read_text(spark, str(tmp_path)).first().content == "two\nlines"


def test_runs_and_reports(spark, tmp_path):
    for i in (1, 2):
        run = {"run_id": f"r{i}", "models": ["m"], "results": [{"source_text_id": "1", "target_language": "fr", "model": "m", "translated_text": "x", "scores": {"accuracy": i, "overall": i}}]}
        (tmp_path / f"2024-0{i}.json").write_text(json.dumps(run))
    (tmp_path / "2024-09.json").write_text("{broken")
    runs = readers.read_runs(spark, str(tmp_path))
    assert [r.run_id for r in runs.collect()] == ["r2", "r1"] and runs.first().status == "unknown"
    assert readers.latest_run(runs).first().run_id == "r2"
    assert readers.run_results(runs).where("run_id = 'r2'").first().scores.overall == 2
    table = sinks.markdown_table(spark.createDataFrame([("日本", 1), (None, 22)], "name string, n int"))
    assert len({sinks.visual_length(line) for line in table.split("\n")}) == 1
    sinks.write_csv(runs.select("run_id"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    dim = readers.language_dimension(spark, {"asian": [{"code": "ja", "name": "Japanese"}], "odd": [{"code": 7, "name": "x"}]})
    assert {(r.code, r.category) for r in dim.collect()} == {("ja", "asian"), ("7", "european_major")}
    assert readers.text_dimension(spark, [{"id": 1, "text": " a "}]).first().content == "a"


def test_bodies_and_metadata(spark):
    one = spark.range(1)
    page = F.lit("<html><body class='x'>old</body></html>")
    assert one.select(sinks.replace_body(page, F.lit("a $1 \\ b")).alias("h")).first().h == "<html><body class='x'>a $1 \\ b</body></html>"
    opf = F.lit("<dc:language>en</dc:language>")
    assert one.select(sinks.update_metadata(opf, F.lit("German"), compat=True).alias("o")).first().o == "<dc:language>ge</dc:language>"


def test_upsert_is_idempotent_and_providers_plug_in(spark):
    writes = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c")], "job long, idx long, seq long, v string")
    once = jobs.upsert(writes, ["job", "idx"], ["seq"])
    again = jobs.upsert(once, ["job", "idx"], ["seq"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [(1, 1, 2, "b"), (1, 2, 1, "c")]
    translate.register("loud", lambda: lambda prompts: [p + "!" for p in prompts])
    got = translate.generate(writes, "v", "loud", distinct=True)
    assert {r.answer for r in got.collect()} == {"a!", "b!", "c!"}
    items = spark.createDataFrame([(i,) for i in range(4)], "ord long")
    assert optimizer.folds(items, 1, None).where("part = 'test'").count() == 4


def test_text_files_and_ranked_prompts(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("é\r\nx\ry".encode())
    (tmp_path / "t" / "b.txt").write_bytes(b"\xff")
    (tmp_path / "t" / "c.txt").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in readers.read_text(spark, str(tmp_path / "t")).collect()}
    assert got == {"a.txt": "é\nx\ny", "b.txt": None}  # and no row for the empty file
    report = {"run_id": "r", "top_prompts": [{"id": "p1", "fitness": 2.5, "generation": 3}, {"id": "p2"}]}
    (tmp_path / "report.json").write_text(json.dumps(report))
    reports = readers.read_report(spark, str(tmp_path / "report.json"))
    rank = lambda k: [(r.id, r.generation, r.fitness) for r in readers.best_prompt(reports, k).collect()]
    assert (rank(1), rank(2), rank(3)) == ([("p1", 3, 2.5)], [("p2", 0, 0.0)], [])


def test_table_of_wide_characters(spark):
    rows = spark.createDataFrame([("日本", None), ("😀", 5)], "a string, bb int")
    assert sinks.markdown_table(rows) == "| a    | bb |\n|------|----|\n| 日本 |    |\n| 😀   | 5  |"
    assert sinks.markdown_table(rows.limit(0)) == ""


def test_restored_tags_at_once_and_one_by_one(spark):
    from quillspark.functions import placeholders as p

    rows = [
        ("a[id0]b[id1][id0]", ["<b>", "</b>"], "a<b>b</b><b>"), ("[id5][id01][id99999999999]", ["<b>"], "[id5][id01][id99999999999]"),
        ("[id1]", ["x", "[id0]"], "x"), ("[id[id1]]", ["x", "0"], "x"), ("no [id0]", [], "no [id0]"), ("", ["x"], ""),
    ]
    df = spark.createDataFrame(rows, "t string, tags array<string>, want string")
    for r in df.select("want", p.restore_tags(F.col("t"), F.col("tags")).alias("got")).collect():
        assert r.got == r.want


def test_chunks_inside_a_row_match_the_exact_path(spark):
    from quillspark.functions import chunking

    texts = ["One. Two is longer. Three? Four! " * 9, "", None, "Alone.", "\n.\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = chunking.chunk_rows(docs, 20).orderBy("doc_id", "chunk_index").collect()
    for i, text in enumerate(texts):
        want = chunking.pack(chunking.py_sentences(text or ""), " ", 20)
        assert [r.content for r in rows if r.doc_id == i] == want
        assert sum(r.units for r in rows if r.doc_id == i) == len(chunking.py_sentences(text or ""))
