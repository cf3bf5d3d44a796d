"""Operators that run Python, against brute force, with the odd cases of each docstring."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import ann, common, language_id, license_scan, lm_scoring, near_dedup, suffix_dedup

EXTRA = "lang string, source string, node string, band int, gone int, block int, word string, kind string, host string, v int, id int, n int"
FILL = ("en", "s", "x", 1, 1, 1, "w", "k", "h", 1, 1, 1)


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, *FILL) for i, t in pairs], "doc_id long, text string, " + EXTRA)


def prose(rng, n, words=400):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(2 + i % 5)) + ("," if rng.random() < 0.1 else "") for i in (rng.randrange(words) for _ in range(n)))


# -- hashing ---------------------------------------------------------------------------------------------------------


def brute_words(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_words_and_spans():
    texts = ["A bc, d1é", None, "", "x", "..", "End ", "Next"]
    data, offsets = common.flat_bytes(pa.array(texts))
    low, start, end, row = common.words(data, offsets)
    got = [[] for _ in texts]
    for s, e, r in zip(start, end, row):
        got[r].append(low[s:e].tobytes())
    assert got == [brute_words(t) for t in texts]
    span = common.SpanHasher(np.frombuffer(b"abcXabcYabd", np.uint8))
    h = span(np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[1] != h[2]


# -- near duplicates -------------------------------------------------------------------------------------------------


def shingles(text):
    w = brute_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(pairs):
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            same = (pairs[i][1] or "") == (pairs[j][1] or "")
            union = len(sets[i] | sets[j])
            if same or (union and len(sets[i] & sets[j]) / union >= 0.8):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(pairs):
        groups.setdefault(root(i), []).append(d)
    return {d: min(x for x in g if x is not None) for g in groups.values() for d in g if d is not None and any(x is not None for x in g)}


def test_probability_jaccard_of_signatures():
    rng = np.random.default_rng(3)
    a = {int(k): float(w) for k, w in zip(rng.integers(1, 1 << 60, 40), rng.uniform(0.5, 3, 40))}
    b = {k: w * 1.4 for k, w in list(a.items())[:30]} | {int(k): 1.0 for k in rng.integers(1, 1 << 60, 10)}
    row = np.array([0] * len(a) + [1] * len(b))
    key = np.array([*a, *b], np.uint64)
    weight = np.array([*a.values(), *b.values()])
    sig = near_dedup.probminhash(row, key, weight, 2, 4096)
    keys = set(a) | set(b)
    want = sum(1 / sum(max(a.get(o, 0) / a[d], b.get(o, 0) / b[d]) for o in keys) for d in a if d in b)
    assert np.mean(sig[0] == sig[1]) == pytest.approx(want, abs=0.03)


def test_near_duplicates(spark):
    rng = random.Random(1)
    pairs = [(5, None), (6, ""), (7, "one two"), (8, "One, two!"), (9, "..."), (10, "?!"), (None, "lonely words of a null id here"), (11, "x " * 20_000)]
    for g in range(12):
        base = prose(rng, 120).split()
        for c in range(1 + g):
            now = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
                now[rng.randrange(len(now))] = "new%d" % rng.randrange(10**6)
            pairs.append((100 * g + 1000 + c, " ".join(now)))
    pairs += [pairs[-1], (3, pairs[-2][1])]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, pairs)).collect() if r.doc_id is not None}
    assert got == brute_classes(pairs)
    kept = near_dedup.drop_near_copies(docs(spark, pairs))
    assert kept.columns[:3] == ["doc_id", "text", "lang"]
    assert {r.doc_id for r in kept.collect()} - {None} == set(got.values())
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_uneven_counts_of_shingles(spark):
    """Texts of the same two halves, one or the other repeated 200 times: their sets are alike, so each pair is linked."""
    rng = random.Random(31)
    pairs = []
    for g in range(10):
        first, second = prose(rng, 60, 4000), prose(rng, 60, 4000)
        pairs += [(2 * g, " ".join([first] * 200 + [second])), (2 * g + 1, " ".join([first] + [second] * 200))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, pairs)).collect()}
    assert got == brute_classes(pairs) == {i: i - i % 2 for i in range(20)}


def test_band_keys_follow_from_sketches():
    rng = random.Random(32)
    base = prose(rng, 80, 4000).split()
    texts = pa.array([" ".join(base[:-k] + prose(rng, k, 4000).split()) for k in range(1, 30)])
    keys, sketch = near_dedup.sketches(texts)
    table_ = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(texts), -1)
    assert table_.shape[1] == near_dedup.REGISTERS + near_dedup.BANDS * near_dedup.ROWS
    for i in range(len(texts)):
        for j in range(i):
            shared = [b for b in range(near_dedup.BANDS) if keys[i][b] == keys[j][b]]
            if shared:
                assert near_dedup.first_shared(table_[[i]], table_[[j]], near_dedup.BANDS, near_dedup.ROWS)[0] == shared[0]


def test_close_pairs_are_all_close_pairs():
    rng = np.random.default_rng(4)
    group = np.sort(np.concatenate((rng.integers(0, 40, 150), np.full(90, 50))))
    centre = rng.integers(0, 256, (3, 64))
    sketch = np.where(rng.random((len(group), 64)) < 0.75, centre[rng.integers(0, 3, len(group))], rng.integers(0, 256, (len(group), 64))).astype(np.uint8)
    root = rng.integers(0, 60, len(group))
    i, j = near_dedup.close_pairs(group, root, sketch, 0.55, lag=8)
    want = {(a, b) for a in range(len(group)) for b in range(a + 1, len(group)) if group[a] == group[b] and root[a] != root[b] and (sketch[a] == sketch[b]).mean() >= 0.55}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) > 20


@pytest.mark.parametrize("block", [3, 2048])
def test_groups_that_no_hub_joins(spark, monkeypatch, block):
    """Chains of texts, and many texts that share a long passage: blocks of any size find the same classes."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    passage = prose(rng, 60).split()
    pairs = [(i, " ".join(passage + prose(rng, rng.randrange(8, 40), 4000).split())) for i in range(60)]
    chain = prose(rng, 100, 4000).split()
    for i in range(100, 140):
        chain = [*chain[5:], *prose(rng, 5, 4000).split()]
        pairs.append((i, " ".join(chain)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, pairs)).collect()}
    assert got == brute_classes(pairs)


def test_repeated_lines_do_not_part_near_copies(spark):
    """Each text repeats a line of its own 32 times: plain Jaccard is over 0.8, that of weights by count under 0.5."""
    rng = random.Random(21)
    pairs = []
    for g in range(40):
        shared = [f"s{g}w{i}" for i in range(124)]
        for c in range(2 if g % 2 else 5):
            line = ["line%d" % rng.randrange(10**9) for _ in range(9)]
            pairs.append((10 * g + c, " ".join(shared) + "\n" + "\n".join([" ".join(line)] * 32)))
    want = brute_classes(pairs)
    assert len(set(want.values())) == 40
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, pairs)).collect()} == want


# -- repeated strings ------------------------------------------------------------------------------------------------


def brute_removed(pairs, n):
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0] is None, pairs[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        raw = (pairs[i][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            w = raw[s : s + n]
            if w in seen:
                gone[s : s + n] = b"\x01" * n
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.setdefault(pairs[i][0], []).append((len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def test_suffix_dedup(spark):
    rng = random.Random(2)
    passages = [prose(rng, n) for n in (40, 60, 100, 18)]
    pairs = [(0, None), (1, ""), (2, "a" * 500), (3, "ab" * 300 + "é" * 90), (4, "a" * 99), (5, "a" * 100), (None, passages[0])]
    for i in range(10, 60):
        parts = [prose(rng, rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 60)
            parts += [p[cut:] if rng.random() < 0.5 else p, prose(rng, rng.randrange(3, 40))]
        pairs.append((i, " ".join(parts)))
    pairs += [(70, pairs[-1][1]), (71, pairs[-2][1][:-3] + "xyz"), (72, "é" * 200)]
    got = {}
    for r in suffix_dedup.suffix_dedup(docs(spark, pairs).repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = brute_removed(pairs, 100)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert suffix_dedup.suffix_dedup(docs(spark, [])).count() == 0


def test_suffix_dedup_of_repeated_rows(spark):
    rng = random.Random(4)
    text = prose(rng, 50)
    got = suffix_dedup.suffix_dedup(docs(spark, [(1, text), (1, text), (2, text[3:] + "tail"), (3, "short"), (3, "short")])).collect()
    n = len(text)
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, n), (2, n - 3), (3, 0), (3, 0)]


def test_long_rows_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_POSITION", np.uint64((1 << 11) - 1))
    data = np.random.default_rng(0).integers(97, 101, 5000).astype(np.uint8)
    parts = list(suffix_dedup._chunks(data, np.array([0, 5000]), 100))
    windows = [a + s for part, _, a in parts for s in range(len(part) - 99)]
    assert sorted(windows) == list(range(4901))


def test_collection_order_is_the_suffix_order():
    rng = random.Random(9)
    members = ["".join(rng.choice("ab") for _ in range(rng.randrange(8, 40))).encode() for _ in range(30)]
    member, at, joined = suffix_dedup.collection_order(members, 8)
    want = sorted((m[s:], i, s) for i, m in enumerate(members) for s in range(len(m) - 7))
    assert list(zip(member.tolist(), at.tolist())) == [(i, s) for _, i, s in want]
    assert joined[1:].tolist() == [a[0][:8] == b[0][:8] for a, b in zip(want, want[1:])]


# -- language model --------------------------------------------------------------------------------------------------


def test_lattices_sum_over_all_segmentations():
    pieces = {lm_scoring.SPACE: -2.0, b"a": -1.0, b"ab": -1.5, b"b": -2.5, lm_scoring.SPACE + b"a": -1.2, b"bab": -3.0}
    lattices = lm_scoring.Lattices(pieces)

    def total(text):
        return 1.0 if not text else sum(math.exp(lp) * total(text[len(p) :]) for p, lp in pieces.items() if text.startswith(p))

    def expected(text, count):
        out = dict.fromkeys(pieces, 0.0)

        def walk(rest, prob, used):
            if not rest:
                for p in used:
                    out[p] += count * prob / total(text)
            for p, lp in pieces.items():
                if rest.startswith(p):
                    walk(rest[len(p) :], prob * math.exp(lp), [*used, p])

        walk(text, 1.0, [])
        return list(out.values())

    words = [b"ab", b"babab", b"a", b"bbbbab"]
    assert np.allclose(lattices.marginals(words), [math.log(total(lm_scoring.SPACE + w)) for w in words])
    counts = np.array([1, 2, 3, 4])
    want = np.sum([expected(lm_scoring.SPACE + w, c) for w, c in zip(words, counts)], axis=0)
    assert np.allclose(lattices.expected(words, counts), want)


def test_lm_scores(spark):
    rng = random.Random(5)
    pairs = [(i, prose(rng, rng.randrange(1, 60)) + " Ünï\x0b x\x1fy ") for i in range(60)] + [(60, None), (61, ""), (62, "  "), (63, "w" * 3000), (None, "a b"), (7, "again")]
    got = lm_scoring.lm_scores(docs(spark, pairs).repartition(3), lm_scoring.default_vocabulary(), block_bytes=1500).collect()
    assert len(got) == len(pairs)
    held = lambda d: zlib.crc32(("null" if d is None else str(d)).encode()) % 5 == 1
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]
    counts = {}
    for d, t in pairs:
        if not held(d):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (-1 if d is None else d, held(d), len(tokens(t)), sum(w in counts for w in tokens(t)), total,
         round(sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(t)), 6)) for d, t in pairs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    trained = lm_scoring.lm_scores(docs(spark, pairs), lm_scoring.default_vocabulary()).agg({"score": "sum"}).first()[0]
    untrained = lm_scoring.lm_scores(docs(spark, pairs), lm_scoring.default_vocabulary(), prior_tokens=1e9).agg({"score": "sum"}).first()[0]
    assert trained > untrained
    assert lm_scoring.lm_scores(docs(spark, []), lm_scoring.default_vocabulary()).count() == 0


def test_vocabulary_is_a_distribution():
    logp = lm_scoring.vocabulary_scores(lm_scoring.default_vocabulary())
    assert math.fsum(map(math.exp, logp.values())) == pytest.approx(1.0)


# -- licenses --------------------------------------------------------------------------------------------------------


def brute_scan(text):
    words = [w.decode(errors="ignore") for w in brute_words(text)]
    base, places = set(), []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                base.add(label)
                places.append(i)
    labels, score = set(base), 0.0
    for line in (text or "").split("\n"):
        have = {w.decode(errors="ignore") for w in brute_words(line)}
        for label, template in license_scan.TEMPLATES:
            need = set(template.split())
            share = len(have & need) / len(need)
            if share >= 0.8 - 1e-12:
                labels.add(label)
                score = max(score, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1.0 if base else score, 9))


def test_license_scan(spark):
    rng = random.Random(6)
    pairs = [(0, None), (1, ""), (2, "Under the\nMIT license, and under THE mit LICENSE"), (3, "CC-BY-NC"), (4, "apache licenses version 2"), (5, "under the mit licenseé"), (None, "cc by nc")]
    for i in range(10, 200):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(license_scan.TEMPLATES)[1].split()
            kept = [w.upper() if rng.random() < 0.2 else w for w in words if rng.random() < rng.choice([1.0, 0.9, 0.8])]
            if rng.random() < 0.3:
                rng.shuffle(kept)
            parts.append(prose(rng, rng.randrange(0, 9)) + " " + " ".join(kept) + rng.choice([".", " ", " " + prose(rng, 5)]))
        pairs.append((i, "\n".join(parts)))
    pairs.append(pairs[-1])
    got = license_scan.license_scan(docs(spark, pairs)).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    want = sorted([(d, *brute_scan(t)) for d, t in pairs], key=key)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got], key=key) == want
    assert license_scan.license_scan(docs(spark, [])).count() == 0


def test_notices_over_line_ends(spark):
    """Notices wrapped as the standard files wrap them, and tokens scattered over one long line."""
    rng = random.Random(14)
    wrapped = [
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")"),
        ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
        ("gpl-3", "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"),
    ]
    pairs = [(i, prose(rng, 20) + "\n" + t + "\n" + prose(rng, 20)) for i, (_, t) in enumerate(wrapped)]
    pairs.append((3, " ".join(w + " " + prose(rng, 6) for w in wrapped[1][1].split())))
    for i in range(10, 90):
        words = [w for w in rng.choice(license_scan.TEMPLATES)[1].split() if rng.random() < 0.9]
        pairs.append((i, " ".join(w + rng.choice([" ", "\n", "\n\n", " qq "]) for w in [*words, *prose(rng, 4).split(), *words[:6], *words])))
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, pairs), wrapped=True).collect()}
    assert [(got[i].labels, got[i].score, got[i].n_blocks) for i in range(4)] == [("mit", 1.0, 1), ("bsd", 1.0, 1), ("gpl-3", 1.0, 1), ("", 0.0, 0)]
    for i, text in pairs:
        words, best, labels = [w.decode() for w in brute_words(text)], 0.0, set()
        for label, template in license_scan.TEMPLATES:
            need, n = set(template.split()), len(template.split())
            share = max(len(need & set(words[s : s + n])) / len(need) for s in range(max(1, len(words) - n + 1)))
            if share >= 0.8 - 1e-12:
                labels.add(label)
                best = max(best, share)
        base = set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == labels | base and got[i].score == pytest.approx(1.0 if base else best)


# -- nearest neighbours ----------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], "vec_id long, embedding array<float>, v int, key string, query int, leaf int")


def brute_nearest(rows, k=20, mod=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in good:
        if q % mod == 0:
            scored = sorted((-float((y * x).sum()), i) for i, y in good if i != q)
            out[q] = [(i, round(-s, 6)) for s, i in scored[:k]]
    return out


def as_lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    return out


def test_nearest_is_exact_where_all_leaves_are_taken(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 400)]
    rows += [(400, None), (420, [0.0] * 8), (440, [None] + [1.0] * 7), (460, [float("nan")] * 8), (480, [float("inf")] * 8), (500, [1.0]), (None, [1.0] * 8)]
    got = as_lists(ann.nearest(vectors(spark, rows), F.col("id") % 20 == 0).collect())
    assert got == brute_nearest(rows)
    few = [(0, [1.0] * 8), (1, [2.0] * 8), (20, [-1.0] * 8)]
    assert as_lists(ann.nearest(vectors(spark, few), F.col("id") % 20 == 0).collect()) == brute_nearest(few)
    assert ann.nearest(vectors(spark, []), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(vectors(spark, [(0, [0.0] * 8)]), F.col("id") % 20 == 0).count() == 0


def test_nearest_of_doubles_is_not_rounded(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(10)
    for unit in (1.0, 1e60):  # beyond a float's range as well
        rows = [(i, [unit, unit * i * 1e-12, *(unit * rng.normal(size=2)).tolist()]) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, F.col("id") % 20 == 0, k=5).collect()}
        for q in (0, 20, 40):
            x = np.array(rows[q][1])
            scored = sorted((-float((np.array(v) * x).sum()), i) for i, v in rows if i != q)
            for n, (s, i) in enumerate(scored[:5]):
                assert got[q, n + 1][0] == i and abs(got[q, n + 1][1] + s) <= 1e-14 * abs(s)


def test_nearest_recall(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).tolist()) for i in range(3000)]
    got = as_lists(ann.nearest(vectors(spark, rows), F.col("id") % 20 == 0, leaf=32, search_k=3000).collect())
    want = brute_nearest(rows)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    hard = [(i, rng.normal(size=8).tolist()) for i in range(6000)]  # nothing clusters: the walk is as long as it must be
    got, want = as_lists(ann.nearest(vectors(spark, hard), F.col("id") % 20 == 0, leaf=32).collect()), brute_nearest(hard)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


# -- language ID -----------------------------------------------------------------------------------------------------

EN = "the quick brown fox jumps over the lazy dog and then it went to the river with all of its friends"
DE = "der schnelle braune fuchs springt über den faulen hund und dann ging er mit allen freunden zum fluss"


def labelled(spark):
    rows = [(i, "en" if i % 2 else "de", " ".join(random.Random(i).sample((EN if i % 2 else DE).split(), 12))) for i in range(400)]
    return spark.createDataFrame([*rows, (None, None, "x"), (9, "en", None)], "key long, lang string, text string")


def test_language_model_and_evidence(spark):
    model = language_id.train(labelled(spark))
    assert model.languages == ["de", "en", "und"]
    pages = [(i, f"https://www.seite{i % 3}.example.de/x?y", f'<html lang="de"><p>{DE}</p><script>the the the</script>') for i in range(30)]
    pages += [(100, "https://www.seite1.example.de/", "<html><body>hm</body>"), (101, "http://x.example.com", "<html><body>hm</body>")]
    pages += [(102, "http://x.example.com:80/", f"<HTML LANG='de'>{EN}"), (103, None, None), (104, "nonsense", "<p>1234 !!</p>"), (105, None, f"<p>{EN}</p>"), (105, None, f"<p>{EN}</p>")]
    pages += [(106, "http://y.example.com", "<p>" + "漢字仮名交じり文の例です" * 20 + "</p>")]
    frame = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, kind string, n int")
    got = {r.id: r for r in language_id.identify(language_id.of_pages(frame), model).collect()}
    assert all(got[i].language == "de" and got[i].accepted for i in range(30))
    assert got[102].language == "en" and got[105].language == "en"  # the text outweighs what is declared
    assert got[100].language == "de"  # a short text follows its host
    assert got[103].language is None and not got[103].accepted and got[104].language is None
    assert got[106].language == "und" and not got[106].accepted
    assert language_id.identify(language_id.of_pages(frame), model).count() == len(pages)


def test_language_accuracy_and_filter(spark):
    model_docs = [(i, t, "en" if i % 2 else "de") for i, _, t in labelled(spark).where("lang IS NOT NULL AND text IS NOT NULL").rdd.map(tuple).collect()]
    frame = spark.createDataFrame([(i, t, lang, "s", 1, "h") for i, t, lang in model_docs] + [(900, None, "en", None, 1, "h"), (901, "", None, "s", 1, "h")],
                                  "doc_id long, text string, lang string, source string, n int, host string")
    kept = language_id.keep_identified(frame)
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 900 not in ids and 901 not in ids and len(ids) >= 0.99 * len(model_docs)
    test = spark.createDataFrame([(i, " ".join(random.Random(10_000 + i).sample((EN if i % 2 else DE).split(), 9)), "s") for i in range(200)], "doc_id long, text string, source string")
    got = language_id.identify(language_id.of_documents(test), language_id.train(labelled(spark))).collect()
    assert np.mean([r.language == ("en" if r.id % 2 else "de") for r in got]) >= 0.97
    none = language_id.train(spark.createDataFrame([], "key long, lang string, text string"))
    assert not any(r.accepted for r in language_id.identify(language_id.of_documents(test), none).collect())
    assert language_id.identify(language_id.of_documents(test.limit(0)), none).count() == 0


def test_every_labelled_language_is_known(spark):
    """40 languages of their own words: the rarest are told as well as the others."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400)]
    say = lambda g: " ".join(rng.choice(vocabulary[10 * g : 10 * g + 10]) for _ in range(30))
    rows = [(100 * g + i, f"l{g:02d}", say(g)) for g in range(40) for i in range(8 if g < 32 else 4)]
    model = language_id.train(spark.createDataFrame(rows, "key long, lang string, text string"), train_rows=200)
    assert model.languages == [*(f"l{g:02d}" for g in range(40)), "und"]
    documents = spark.createDataFrame([(g, f"s{g}", say(g)) for g in range(40)], "doc_id long, source string, text string")
    got = language_id.identify(language_id.of_documents(documents), model).collect()
    assert {r.id: (r.language, r.accepted) for r in got} == {g: (f"l{g:02d}", True) for g in range(40)}


def brute_posteriors(model_rows, items, trust=0.9, smoothing=20.0):
    """The fused posterior of every item, step by step from the definitions: (host, domain, suffix, declared, text) in."""

    def grams(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        framed = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low) + b" "
        return [(int.from_bytes(framed[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> (32 - language_id.BITS) for i in range(len(framed) - 2) if framed[i + 1] != 32]

    names = sorted({lang for lang, _ in model_rows})
    size = 1 << language_id.BITS
    counts = {x: {} for x in names}
    for lang, text in model_rows:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    mass = {x: sum(counts[x].values()) + 0.5 * size for x in names}
    known = len(model_rows)
    prior = [0.999 * sum(lang == x for lang, _ in model_rows) / known for x in names] + [0.001]
    dims = len(names) + 1

    def normal(logs):
        out = np.exp(np.array(logs) - max(logs))
        return out / out.sum()

    own, by_text, share, wide = [], [], {}, {}
    for host, domain, suffix, declared, text in items:
        found = grams(text or "")
        weigh = min(len(found), 4 * math.sqrt(len(found))) / max(len(found), 1)
        logs = [weigh * sum(math.log((counts[x].get(g, 0) + 0.5) / mass[x]) for g in found) for x in names] + [-weigh * len(found) * math.log(size)]
        if declared in names:
            logs = [v + math.log(trust if x == declared else (1 - trust) / (dims - 1)) for v, x in zip(logs, [*names, "und"])]
        own.append(logs if found else None)
        by_text.append(normal([v + math.log(p) for v, p in zip(logs, prior)]) if found else np.zeros(dims))
        share[host, domain, suffix] = share.get((host, domain, suffix), 0) + by_text[-1]
    everywhere = sum(share.values())
    whole = (everywhere + smoothing / dims) / (everywhere.sum() + smoothing)

    def smooth(inner, outer):
        return (inner + smoothing * outer) / (inner.sum() + smoothing)

    out = []
    for (host, domain, suffix, _, _), logs, mine in zip(items, own, by_text):
        if logs is None:
            out.append(None)
            continue
        speaks = np.array([smoothing if language_id.SUFFIXES.get(suffix) == x else 0.0 for x in [*names, "und"]])
        p1 = smooth(sum(v for (_, _, s), v in share.items() if s == suffix) + speaks, whole)
        p2 = smooth(sum(v for (_, d, s), v in share.items() if (d, s) == (domain, suffix)), p1)
        host_ = smooth(np.maximum(share[host, domain, suffix] - mine, 0), p2)
        out.append(normal([v + math.log(h) for v, h in zip(logs, host_)]))
    return [*names, "und"], out


def test_fused_posterior_by_hand(spark):
    """Language, confidence and acceptance of pages and documents against a recomputation of every step; a very long text too."""
    rng = random.Random(41)
    model_rows = [("en" if i % 2 else "de", " ".join(rng.sample((EN if i % 2 else DE).split(), 8))) for i in range(60)]
    model = language_id.train(spark.createDataFrame([(i, *r) for i, r in enumerate(model_rows)], "key long, lang string, text string"))
    pages, items = [], []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice((EN if lang == "en" else DE).split()) for _ in range(rng.choice([0, 1, 2, 5, 40])))
        name, domain, suffix = rng.choice([("a.b.de", "b.de", "de"), ("www.c.co.uk", "co.uk", "uk"), ("x.org", "x.org", "org"), ("y.org", "y.org", "org")])
        declared = rng.choice([None, "de", "en", "fr"])
        # As the operator sees it: tags are spaces.
        pages.append((i, f"https://{name}/{i}", (f'<html lang="{declared}">' if declared else "<html>") + f"<p>{text}</p>"))
        items.append((name, domain, suffix, declared, "  " + text + " "))
    long_ = " ".join(rng.choice(EN.split()) for _ in range(200_000))
    documents = [(100, "s1", long_), (101, "s1", ""), (102, "s2", DE), (103, None, EN), (103, None, EN)]
    items += [(f"source:{s or ''}", "source", "", None, t) for _, s, t in documents]
    frame = language_id.of_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).unionByName(
        language_id.of_documents(spark.createDataFrame(documents, "doc_id long, source string, text string")))
    names, want = brute_posteriors(model_rows, items)
    got = sorted(language_id.identify(frame, model).collect(), key=lambda r: r.id)
    assert len(got) == len(want)
    for r, p in zip(got, want):
        if p is None:
            assert r.language is None and not r.accepted
        else:
            assert r.language == names[int(p.argmax())] and r.confidence == pytest.approx(p.max(), abs=1e-4)
            assert r.accepted == (r.language != "und" and p.max() >= 0.5)


def test_full_license_texts_over_line_ends(spark):
    """Whole notices as license files print them, wrapped at 70 columns, among prose; a third of the words of one is none."""
    import textwrap

    rng, templates = random.Random(51), [*license_scan.TEMPLATES, *license_scan.TEXTS]
    pairs, want = [], []
    for i, (label, text) in enumerate(templates):
        body = textwrap.fill(text.capitalize().replace(" and ", ", and "), 70)
        pairs.append((i, prose(rng, 30) + "\n\n" + body + "\n\n" + prose(rng, 30)))
        want.append(label)
    long_ = max((t for _, t in templates), key=len).split()
    pairs.append((1000, prose(rng, 30) + " " + " ".join(long_[-len(long_) // 3 :])))
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, pairs), templates, wrapped=True).collect()}
    assert all(want[i] in got[i].labels.split(",") and got[i].score == 1.0 for i in range(len(want)))
    assert got[1000].labels == ""


# -- packing: what a worker holds -------------------------------------------------------------------------------------


def test_tokenizer_gets_words_in_turns():
    """Fresh words of a slice are many; the tokenizer keeps much of each, so it gets a bounded number at once."""
    from quillspark.llm import packing

    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(15_000)] + [f"x{i}y" for i in range(15_000)]
    rnd.shuffle(words)
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    ids = packing.WordIds(packing.default_tokenizer())
    whole, asked = ids._whole, []
    expected = whole(texts)
    ids._whole = lambda part: asked.append(sum(len(t.split()) for t in part)) or whole(part)
    assert ids.by_word and ids(texts) == expected
    assert max(asked) <= packing.TURN < sum(asked)


def test_batches_sent_to_python_are_bounded(spark):
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), common.batches_of(spark, 7):
        got = [r.n for r in spark.range(0, 100, 1, 2).mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 100 and max(got) == 7
        raise ZeroDivisionError
    assert spark.conf.get(key) == before
