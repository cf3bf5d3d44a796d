"""Exact dedup, sharding, mixing and packing against brute force, with the odd cases of each docstring."""

import hashlib
import zlib

import numpy as np
import pytest

from quillspark.llm import exact_dedup, mixing, packing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, digest int, p int, w int, class int"


def docs(spark, pairs):
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, 1, 1, 1) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS)


PAIRS = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "é b"), (6, "long " * 30_000), (7, "a"), (7, "a"), (None, "a"), (None, "lonely")]


def index(spark, name):
    return exact_dedup.DigestIndex(spark, name, 4)


def test_exact_dedup(spark):
    idx = index(spark, "t_exact")
    try:
        got = exact_dedup.exact_dedup(docs(spark, PAIRS), idx, hot_share=3).collect()
        assert len(got) == len(PAIRS)
        by = {}
        for i, t in PAIRS:
            by.setdefault(t or "", []).append(i)
        for r in got:
            text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            known = [i for i in by[text] if i is not None]
            assert r.keep_id == (max(known) if known else None) and r.group_size == len(by[text])
            assert r.kept == (r.doc_id == r.keep_id)
        assert idx.read().count() == len(by)
        again = exact_dedup.exact_dedup(docs(spark, [(90, "a"), (91, "new")]), idx)
        assert {(r.doc_id, r.kept) for r in again.collect()} == {(90, False), (91, True)}
        redelivered = exact_dedup.exact_dedup(docs(spark, [(91, "new"), (92, "new"), (5, "é b")]), idx)
        assert {(r.doc_id, r.keep_id, r.kept) for r in redelivered.collect()} == {(91, 91, True), (92, 91, False), (5, 5, True)}
        assert exact_dedup.exact_dedup(docs(spark, []), idx).count() == 0
    finally:
        idx.drop()


@pytest.mark.parametrize("deliveries", [2, 5])
def test_deliveries_meet_the_digests_of_earlier_ones(spark, deliveries):
    idx = index(spark, f"t_deliveries_{deliveries}")
    pairs = [(i, f"text {i % 7}") for i in range(-30, 31)] + [(None, "text 3"), (None, "lonely"), (1 << 62, "far"), (-(1 << 61), "far")]
    try:
        got = exact_dedup.exact_dedup(docs(spark, pairs), idx, deliveries=deliveries).collect()
        keep = {}
        for i, t in pairs:
            keep[t] = max((x for x in (i, keep.get(t)) if x is not None), default=None)
        assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in got) == sorted((str(i), str(keep[t]), i == keep[t]) for i, t in pairs)
        assert idx.read().count() == len(keep)
        assert exact_dedup.DigestIndex(spark, f"t_deliveries_{deliveries}").buckets == idx.buckets
    finally:
        idx.drop()


def test_rows_without_in_both_ways(spark):
    """Keys beyond the slots, null keys, and columns named as the helper's own."""
    from quillspark.llm.common import rows_without

    rows = spark.createDataFrame([(i, f"t{i}", i, "x") for i in range(500)] + [(None, "n", 0, "x")], "_may long, text string, _row long, _map string")
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 3)] + [(None,)], "k long")
    out = rows_without(rows, {"k": rows["_may"]}, gone)
    assert out.columns == rows.columns and sorted(r._may for r in out.collect()) == [i for i in range(500) if i % 3]
    assert rows_without(rows, {"k": rows["_may"]}, gone.limit(0)).count() == 501


def test_drop_copies_keeps_columns(spark):
    idx = index(spark, "t_drop")
    try:
        out = exact_dedup.drop_copies(docs(spark, [(1, "a"), (2, "a"), (3, None), (4, "")]), idx)
        assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert sorted(r.doc_id for r in out.collect()) == [2, 4]
    finally:
        idx.drop()


def shard_by_hand(key, n):
    return max(range(n), key=lambda s: int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16))


def test_sharding(spark):
    pairs = PAIRS + [(i, "t%d" % i) for i in range(100, 400)]
    got = sharding.rendezvous(docs(spark, pairs), [1.0] * 5, block=64).collect()
    assert len(got) == len(pairs)
    slots = {}
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert r.shard == shard_by_hand(key, 5) and r.grown_shard == shard_by_hand(key, 6)
        assert r.grown_shard in (r.shard, 5)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in got}
    assert sizes[2] == (16, 0) and sizes[5] == (20, zlib.crc32("é b".encode()))
    assert sharding.rendezvous(docs(spark, []), [1.0] * 3).count() == 0


def test_sharding_follows_weights(spark):
    got = sharding.rendezvous(docs(spark, [(i, "x") for i in range(3000)]), [1.0, 3.0], new_weight=2.0).collect()
    assert 0.7 < np.mean([r.shard == 1 for r in got]) < 0.8
    assert all(r.grown_shard in (r.shard, 2) for r in got)
    assert 0.28 < np.mean([r.grown_shard == 2 for r in got]) < 0.39


def test_crowded_shard_blocks(spark):
    """A third of the rows have one id, a third none: their slots are gapless, and the others' run by id."""
    pairs = [(i, f"t{i}") for i in range(300)] + [(7, f"r{i % 50}") for i in range(300)] + [(None, "same")] * 300
    got = sharding.rendezvous(docs(spark, pairs), [1.0] * 4, block=32).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
    assert len(got) == 900 and all(sorted(s for s, _ in x) == list(range(len(x))) for x in slots.values())
    for x in slots.values():
        ids = [d for _, d in sorted(x) if d is not None and d != 7]
        assert [d // 32 for d in ids] == sorted(d // 32 for d in ids)
    once = sharding.rendezvous(docs(spark, [(i, "x") for i in range(500)]), [1.0] * 4, block=32).collect()
    for s in range(4):
        ids = [r.doc_id for r in sorted((r for r in once if r.shard == s), key=lambda r: r.slot)]
        assert ids == sorted(ids)


def test_mixing_posteriors_by_hand(spark):
    """Memberships of a classifier counted in Python; 20 domains, a very long text among them."""
    import math

    import xxhash

    bucket = lambda w: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(w.encode(), seed=42).intdigest()) % mixing.BUCKETS
    names = [f"d{k:02d}" for k in range(20)]
    words = [[f"w{k}x{j}" for j in range(12)] for k in range(20)]
    rng = np.random.default_rng(11)
    texts = {i: " ".join(rng.choice(words[i % 20] if j % 3 else words[(i + 1) % 20]) for j in range(9 + i % 5)) for i in range(200)}
    texts[200] = " ".join(rng.choice(words[3], 100_000))
    frame = docs(spark, list(texts.items()))
    model = mixing.train(frame, spark.createDataFrame([(i, names[i % 20]) for i in range(120)], "doc_id long, domain string"))
    assert model[0] == names
    counts = {d: [1.0] * mixing.BUCKETS for d in names}
    for i in range(120):
        for w in texts[i].split():
            counts[names[i % 20]][bucket(w)] += 1
    share = np.array([counts[d] for d in names])
    share = np.log(share / share.sum(1, keepdims=True))
    for r in mixing.posteriors(frame, *model).collect():
        found = [bucket(w) for w in texts[r.doc_id].split()]
        assert r.tokens == len(found)
        logs = (share - share[0])[:, found].sum(1) / math.sqrt(len(found))
        p = np.exp(logs - logs.max())
        assert np.allclose(r.p, p / p.sum(), atol=1e-9)


def test_targets_out_of_reach_are_met_as_nearly_as_can_be(spark):
    """No document is over 65 % a, so no rates give 7 to 3: the distance is that of a long run of plain least squares."""
    rng = np.random.default_rng(6)
    p = np.stack([np.linspace(0.35, 0.65, 40), np.linspace(0.65, 0.35, 40)], 1); t = rng.integers(1, 90, 40)
    frame = spark.createDataFrame([(i, int(t[i]), [float(x) for x in p[i]]) for i in range(40)], "doc_id long, tokens long, p array<double>")
    a = p * t[:, None]; want = t.sum() * np.array([0.7, 0.3]); gram = a.T @ p
    way = lambda r: (a.T @ r - want) @ np.linalg.solve(gram, a.T @ r - want)
    best = np.ones(40)
    for _ in range(50_000):
        best = np.maximum(0, best - p @ np.linalg.solve(gram, a.T @ best - want))
    fitted, _ = mixing.fit_rates(frame, ["a", "b"], {"a": 0.7, "b": 0.3})
    got = np.array([x.rate for x in fitted.orderBy("doc_id").collect()])
    assert (got >= 0).all() and way(best) <= way(got) * 1.0001 and way(got) <= way(best) + 0.05 * way(np.ones(40))
    with pytest.raises(RuntimeError, match="settled"):
        mixing.fit_rates(frame, ["a", "b"], {"a": 0.7, "b": 0.3}, most_steps=2)


def test_mixing_meets_targets(spark):
    rows = [(i, ("good prose fine " if i % 3 else "bad junk dull ") * (1 + i % 7)) for i in range(300)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(0, 300, 2)] + [(9999, 1, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs(spark, rows + [(1000, None), (1001, "")]), labels, {"high": 0.3, "low": 0.7}).collect()
    assert len(out) == 302 and all(r.rate >= 0 for r in out)
    names = out[0].domains
    tokens = np.array([r.tokens for r in out]); p = np.array([r.p for r in out]); rate = np.array([r.rate for r in out])
    got = (rate * tokens) @ p
    assert got.sum() == pytest.approx(tokens.sum(), rel=0.02)
    assert got[names.index("low")] / got.sum() == pytest.approx(0.7, abs=0.02)
    assert {r.tokens for r in out if r.doc_id in (1000, 1001)} == {0}


def test_rates_meet_targets_that_can_be_met(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3] * 3, 200); t = rng.integers(1, 500, 200)
    frame = spark.createDataFrame([(i, int(t[i]), [float(x) for x in p[i]]) for i in range(200)], "doc_id long, tokens long, p array<double>")
    fitted, steps = mixing.fit_rates(frame, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1}, tolerance=1e-5)
    assert fitted.columns == ["doc_id", "tokens", "p", "rate"]
    got = np.array([x.rate for x in fitted.orderBy("doc_id").collect()])
    assert (got >= 0).all() and np.abs((p * t[:, None]).T @ got - t.sum() * np.array([0.6, 0.3, 0.1])).max() < 1.1e-5 * t.sum() and steps


def test_mixing_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs(spark, [(1, "a b"), (1, "a b")]), none, {"unlabelled": 1.0}).collect()
    assert [(r.copies, r.domains) for r in out] == [(1, ["unlabelled"])]
    assert mixing.mix(docs(spark, []), none).count() == 0
    assert mixing.apply_mix(docs(spark, [(1, "a b"), (1, "a b")]), none).count() == 2


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_round_trip(spark, capacity):
    texts = PAIRS[:6] + [(i, "Word's Ünit%d, don't 12 x \x1fΣ <|endoftext|> " % i * (i % 60)) for i in range(10, 140)]
    texts = [(i, t if not t or len(t) < 9000 else t[:9000]) for i, t in texts]
    got = packing.pack(docs(spark, texts).repartition(3), packing.default_tokenizer(), capacity).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in texts:
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert packing.pack(docs(spark, []), packing.default_tokenizer()).count() == 0


def test_power_classes_never_pad(spark):
    got = packing.pack(docs(spark, [(i, "a b c d e f g " * 9 + "z") for i in range(77)]), packing.default_tokenizer(), 2048).collect()
    seq = {}
    for r in got:
        seq[r.sequence_id] = seq.get(r.sequence_id, 0) + r.length
    assert all(n & (n - 1) == 0 for s, n in seq.items() if s >> 49 <= 2048)


ODD = [
    "Word's Ünit, don't 12 x", "á É İstanbul ǅ ﬁne ² Ⅷ x² foo.bar__ _a_ 'tis ''s it's!!! a'b c's", "Σας ΣΑΣ", " lead trail \n", "", "\t", "a\x1fb",
    "naïve—dash “quotes” x‘s", "<|endoftext|> <| a |>", "日本語 テキスト。 word。", "aaa### bbb$$$ 'll ' s", "éé ́x", "l'été, d'accord!!",
]


@pytest.mark.parametrize("name, by_word", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_of_any_tokenizer(name, by_word):
    """Words are encoded one by one only under the rules that allow it; a cased, byte-level tokenizer gets whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    encode, plain = packing.WordIds(path), Tokenizer.from_file(path)
    assert encode.by_word is by_word
    for texts in (ODD, ODD[::-1], [" ".join(ODD) * 50], []):  # the second time from memory
        assert encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
