"""The corpus pipeline on a small corpus: every stage against brute force on its own input, and the whole."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_python import DE, EN, brute_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sentence(rng, words, n=60):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = {"en": EN.split(), "de": DE.split()}
    rows = []
    for i in range(160):
        lang = "de" if i % 4 == 0 else "en"
        # Made-up endings keep texts apart; the language shows in the rest.
        text = " ".join(w + rng.choice(["", "", "s", "en" if lang == "de" else "ing"]) for w in sentence(rng, vocabulary[lang]).split())
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    rows.append((300, rows[5][1], "en", "src0", 0))
    rows.append((301, rows[5][1], "en", "src0", 0))
    rows.append((302, rows[8][1] + " tail", "de", "src0", 0))
    rows += [(400, "", "en", "src0", 0), (401, "123 !!", "en", "src1", 0), (402, None, "en", "src1", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 10 == 0)) for i in range(0, 160, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stage["language_id"](spark, docs, folder)
    assert kept.columns == COLUMNS
    texts = {i: t for i, t, *_ in rows}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == set(texts) - {400, 401, 402}  # clean documents stay
    unique = stage["exact_dedup"](spark, kept, folder)
    assert unique.columns == COLUMNS
    largest = {}
    for i in ids:
        largest[texts[i]] = max(i, largest.get(texts[i], -1))
    assert sorted(r.doc_id for r in unique.collect()) == sorted(largest.values())
    near = stage["near_dedup"](spark, unique, folder)
    classes = brute_classes([(i, texts[i]) for i in largest.values()])
    assert near.columns == COLUMNS and sorted(r.doc_id for r in near.collect()) == sorted(set(classes.values()))
    mixed = stage["mixing"](spark, near, folder)
    assert mixed.columns == COLUMNS and {r.doc_id for r in mixed.collect()} <= set(classes.values())
    packed = stage["packing"](spark, mixed, folder)
    total = {}
    for r in packed.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    tokens = {r.doc_id: r.doc_tokens for r in packed.collect()}
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(total) == set(copies) and all(total[i] == tokens[i] * copies[i] for i in total)


def test_run_is_the_stages_in_turn(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_empty_corpus(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        assert made.count() == 0
        if made.columns == COLUMNS:
            docs = made
