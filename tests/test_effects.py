"""Stubs of outward effects, SQL functions, the session."""

import pytest

from quillspark.functions import chunking, sql
from quillspark.operators import effects
from quillspark.plans.registry import ORACLES, QUERIES


def test_speech(spark):
    docs = spark.createDataFrame([(1, "Hello. World"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.audio) for r in effects.speak(docs, most=7, pause=0.0).collect()}
    assert got[1][:4] == b"RIFF" and len(got[1]) == 44 + 200 * len("Hello.World") and len(got[2]) == 44


def test_speech_in_parts(monkeypatch):
    """Audio of a batch of texts and of one long text leaves in bounded batches; parts, joined, are the files of one piece."""
    import pyarrow as pa

    monkeypatch.setattr(effects, "SPOOL", 1 << 20)  # also a file that does not stay in memory
    texts = ["", None, "Hello. World", "A sentence. " * 20_000, "x" * 7000] + ["Some words here. " * 60] * 200
    rows = [(i, i // 2 if i else None, t) for i, t in enumerate(texts)]
    asked = []

    class Numbered:
        mapInArrow = lambda self, f, ddl: asked.append(f)

    monkeypatch.setattr(effects, "_numbered", lambda docs: Numbered())
    effects.speak(None)
    effects.audio_sizes(None)
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["file", "doc_id", "text"])
    sent = list(asked[0](iter([batch])))
    assert max(b.nbytes for b in sent) <= effects.SENT + 2 * effects.PART
    parts: dict[int, list] = {}
    for b in sent:
        for r in b.to_pylist():
            assert r["part"] == len(parts.setdefault(r["file"], [])) and len(r["audio"]) <= effects.PART
            parts[r["file"]].append(r["audio"])
    gap = bytes(2 * int(0.5 * effects.RATE))
    for i, doc, text in rows:
        whole = gap.join(effects.silence(c) for c in effects.speech_chunks(effects.speech_text(text or "")))
        assert b"".join(parts[i]) == effects.wav_head(len(whole)) + whole
    sizes = [r for b in asked[1](iter([batch])) for r in b.to_pylist()]
    assert sizes == [{"doc_id": doc, "bytes": sum(map(len, parts[i])) - 44} for i, doc, _ in rows]


def test_speech_sizes(spark):
    """One row a document, also of a doc_id that is null or there twice; the sizes are those of the audio."""
    docs = spark.createDataFrame([(1, "Hello. World"), (1, "a" * 6000), (None, None), (2, "")], "doc_id long, text string")
    sizes = sorted(r["bytes"] for r in effects.audio_sizes(docs).collect())
    assert sizes == [0, 0, 200 * 12, 200 * 6000 + 24_000]
    made: dict[int, int] = {}
    for r in effects.speak(docs).collect():
        made[r.file] = made.get(r.file, -44) + len(r.audio)
    assert sorted(made.values()) == sizes


def test_heads_of_files_too_long_for_32_bits():
    assert effects.wav_head(5)[40:] == b"\5\0\0\0" and len(effects.wav_head(1 << 33)) == 44


def test_speech_text_drops_every_control_character():
    assert effects.speech_text("\u200bA\x00\u0301 \ue000“b”…\r\n\tc—d \U000e0001") == 'Á "b"... c-d'


def test_batches(spark):
    rows = effects.in_batches(spark.range(11), "id")
    assert [r["count"] for r in rows.groupBy("batch").count().orderBy("batch").collect()] == [5, 5, 1]


def test_progress_resumes(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.range(7).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    effects.push_progress(stream(), seen.append, str(tmp_path / "cp")).awaitTermination()
    spark.range(3).write.mode("append").parquet(source)
    effects.push_progress(stream(), seen.append, str(tmp_path / "cp")).awaitTermination()
    assert [e["rows"] for e in seen] == [7, 3]


def test_sql_functions(spark):
    sql.register(spark)
    text = "One sentence here. " * 40 + "\n\nLast."
    spark.createDataFrame([(1, text)], "id long, text string").createOrReplaceTempView("t_chunked")
    got = spark.sql("SELECT c.* FROM t_chunked, LATERAL chunk_text(text, 50) c ORDER BY chunk_index").collect()
    assert [r.main_content for r in got] == [c["main_content"] for c in chunking.chunks_of(text, 50)]
    assert spark.sql("SELECT has_loop(repeat('not sure. ', 15)) AS x, speech_text('a  b') AS y").first() == (True, "a b")


@pytest.mark.parametrize("name", ["k18_progress_events", "k18_last_translation"])
def test_seventh_lines_belong_to_no_job(spark, tmp_path, name):
    """Also where a negated key is a job's: 0 is its own, and jobs 5 and -5 are both there."""
    duckdb = pytest.importorskip("duckdb")
    lines = [(k, n) for k in (0, 1, 5, -5, None) for n in (1, 2, 3, 7, 7, None)] + [(9, 2), (9, 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    jobs = [(0, "F"), (1, None), (5, "O"), (-5, "P"), (None, "F")]
    spark.createDataFrame(jobs, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    made = QUERIES[name](spark, str(tmp_path))
    expected = con.execute(ORACLES[name])
    assert made.columns == [c[0] for c in expected.description]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(expected.fetchall(), key=str)
