"""Operators without SQL: hand-made cases and round trips."""

import random

import pytest

from quillspark.functions import chunking as c
from quillspark.functions import exact as e


def test_paragraph_packing():
    text = "\n\n".join(f"Paragraph {i} has some words in it." for i in range(10))
    made = c.chunks_of(text, 30)
    assert [w for m in made for w in m["main_content"].split()] == text.split()
    assert all(m["token_count"] <= 30 for m in made)
    assert made[0]["context_before"] == "" and made[1]["context_before"] == made[0]["main_content"].split("\n\n")[-1]
    assert made[-1]["context_after"] == "" and made[0]["context_after"] == made[1]["main_content"].split("\n\n")[0]
    assert c.chunks_of("  \n ") == [] and c.chunks_of(None) == []
    assert c.chunks_of(text, 30, soft_ratio=0.1) == made


def test_long_paragraphs_are_packed_from_sentences():
    text = "Short one.\n\n" + "This is a sentence. " * 50 + "\n\nLast."
    made = c.chunks_of(text, 50)
    # The first run of sentences fills its chunk, so the short prefix stays alone; before a shorter run it joins it.
    assert made[0]["main_content"] == "Short one." and made[1]["main_content"].startswith("This is") and made[-1]["main_content"] == "Last."
    joined = c.chunks_of("Short one.\n\n" + "A" * 72 + ". " + "B" * 72 + ".", 34)
    assert [m["main_content"] for m in joined] == ["Short one.\n\n" + "A" * 72 + ".", "B" * 72 + "."]
    assert all(m["token_count"] <= 2 * 50 for m in made)  # sums of rounded parts may pass the bound by a little
    assert [m["main_content"] for m in c.chunks_of("word " * 200, 50)] == ["word " * 200]


def test_carried_prefix_that_does_not_fit_stands_alone():
    units = ["x" * 30, "A" * 180 + ". " + "B" * 100 + "."]
    assert c.pack(units, "\n\n", 52) == [units[0], "A" * 180 + ".", "B" * 100 + "."]


def test_splitters_keep_all_words():
    text = " ".join(f"Sentence {i}, with a clause; and more." for i in range(60))
    for parts in (c.split_long(text, 40), c.force_split(text, 40), c.boundary_split(text, 4), c.speech_chunks(text, 200)):
        assert "".join("".join(parts).split()) == "".join(text.split())
    assert all(c.count_by_ratio(p) <= 40 for p in c.split_long(text, 40))
    assert c.split_long("Aaaa. Bbbb. Cccc.", 3) == ["Aaaa. Bbbb.", "Cccc."] and c.split_long("Aaaa. Bbbb. Cccc.", 3, compat=True) == ["Aaaa.Bbbb.", "Cccc."]
    assert "".join("".join(c.retry_split(text)).split()) == "".join(text.split())
    assert c.reduce_content("short") == "short" and len(c.reduce_content(text)) <= int(len(text) * 0.6)


def brute_loop(text, shortest=5, repetitions=10):
    tail = text[-3000:]
    if len(text) < shortest * repetitions:
        return False
    for n in range(shortest, min(80, len(tail) // repetitions)):
        need = repetitions if n < 20 else max(5, repetitions - 5)
        for s in range(len(tail) - n * need):
            phrase = tail[s : s + n]
            if any(ch.isalnum() for ch in phrase) and tail[s : s + n * need] == phrase * need:
                return True
    return False


def test_loops():
    rng = random.Random(3)
    for _ in range(60):
        phrase = "".join(rng.choice("ab .") for _ in range(rng.choice([3, 5, 7, 22, 30])))
        text = "".join(rng.choice("abc d") for _ in range(rng.randrange(60))) + phrase * rng.randrange(12) + "".join(rng.choice("abc d") for _ in range(rng.randrange(40)))
        assert e.has_loop(text) == brute_loop(text), text
    assert not e.has_loop("....." * 40) and e.has_loop("not sure. " * 15) and not e.has_loop("")


def test_loops_of_any_length():
    rng = random.Random(4)
    for _ in range(300):
        phrase = "".join(rng.choice("ab c.") for _ in range(rng.randint(1, 85)))
        text = "".join(rng.choice("abcd e") for _ in range(rng.randint(0, 150))) + phrase * rng.randint(3, 13) + "abc"[: rng.randint(0, 3)]
        assert e.has_loop(text) == brute_loop(text) == e.has_loop(text[-3000:]), text


def test_technical_spans():
    text = "Use `x = 1` at 3.5 MHz, $V_{cm}$ costs $5 and $10, see RS-485 and ```py\ncode```"
    found = {text[a:b]: n for a, b, n, _ in e.technical_spans(text)}
    assert found["`x = 1`"] == "inline_code" and found["3.5 MHz"] == "measurement" and found["$V_{cm}$"] == "latex_inline" and found["```py\ncode```"] == "code_block"
    spans = e.technical_spans(text)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert e.is_technical("`abcdefgh`") and not e.is_technical("plain words")


@pytest.mark.parametrize("html", ["<p>Hello <b>World</b></p>", "a < b", "", "<br/><hr/>x", "<p>Use `code` at 5 V now</p>", "1. <i>IV</i> text", "<p>é &lt;a&gt; &lt;b&gt; z</p>"])
def test_protection_round_trip(html):
    text, kept = e.protect(html)
    for i in reversed(range(len(kept))):
        text = text.replace(f"[id{i}]", kept[i])
    assert text == html
    assert "<" not in e.protect("<p>Hello <b>World</b></p>")[0]


def test_tags_round_trip(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import placeholders as p

    htmls = ["<p>Hello <b>World</b></p>", "x", "", "a < b <i>c</i>", "<p> </p>7<br/>text"]
    rows = spark.createDataFrame([(h,) for h in htmls], "h string").select("h", p.preserve_tags(F.col("h")).alias("x"))
    back = rows.select("h", "x.marked", p.restore_tags(F.col("x.marked"), F.col("x.tags")).alias("b")).collect()
    assert all(r.h == r.b for r in back)
    assert next(r.marked for r in back if r.h == htmls[0]) == "[id0]Hello [id1]World[id2]"


def test_placement():
    assert e.nearest_boundary("hello world", 4) in (5, 6) and e.nearest_boundary("abc", 0) == 0
    assert e.reinsert("hello world", [(0, 0.0), (1, 0.0), (2, 1.0)]) == "[id0][id1]hello world[id2]"
    assert e.reinsert("hello world", [(0, 0.0), (1, 0.0)], compat=True).startswith("[id1][id0]")
    out = e.align("[id0]Hello[id1] world[id2]", "Bonjour monde")
    assert [out.index(f"[id{i}]") for i in range(3)] == sorted(out.index(f"[id{i}]") for i in range(3)) and out.count("[id") == 3
    assert e.align("[id0]你好[id1]", "你好世界").count("[id") == 2 and e.align("", "") == ""


def test_marks():
    sid = "a3f9c2b8e1d4f6a7"
    for where in ("start", "end", "middle", "distributed"):
        assert e.detect_id(e.embed_id("some words to hide in", sid, where)) == f"SID:{sid}"
    places = lambda text, where: [i for i, ch in enumerate(e.embed_id(text, sid, where)) if ch in e.ZERO + e.ONE][0]
    assert [places("one two three four.", w) for w in ("start", "end", "middle")] == [3, 18, 13]
    assert places("oneword", "start") == places("oneword", "middle") == places("oneword", "distributed") == 7 and places("aa bbbbbbbb", "middle") == 2
    marked = e.embed_id("a b c d e f g h", sid, "distributed").split(" ")
    assert [len(w) > 1 for w in marked] == [False, False, True, False, True, False, True, False] and [len(w) - 1 for w in marked if len(w) > 1] == [53, 53, 54]
    assert e.embed_id("  ", sid) == "  " and e.detect_id("none") is None
    assert e.detect_id("".join(f"{ord(ch):08b}" for ch in "hello").translate({48: e.ZERO, 49: e.ONE})) is None  # bits that spell no id
    words = " ".join(f"w{i}" for i in range(40))
    spaced = e.embed_spaces(words, sid)
    assert spaced.split() == words.split() and spaced.count("  ") == f"{0xa3f9c2b8:b}".count("1") and e.detect_spaces(spaced) == "SID-a3f9c2b8"
    assert e.embed_spaces("a  b " * 40, sid) == "a  b " * 40 and e.embed_spaces("a " * 31 + "b", sid) == "a " * 31 + "b" and e.detect_spaces("a b") is None
    assert e.detect_mark(spaced) == "SID-a3f9c2b8" and e.detect_mark(e.embed_id(spaced, sid)) == f"SID:{sid}" and e.detect_mark("a b") is None
    assert e.speech_text("“A”\u0000 —  é…") == '"A" - é...'


def test_subtitle_round_trip(spark):
    from quillspark.operators import srt

    cues = spark.createDataFrame([(1, i, str(i + 1), i * 1000, i * 1000 + 900, t) for i, t in enumerate(["Hi", "two\nlines", "", "x" * 300, "y" * 300, "end"])],
                                 "file_id long, idx long, number string, start_ms long, end_ms long, text string")
    blocked = srt.blocks(cues)
    assert {r.idx: r.block for r in blocked.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    coded = srt.encode(blocked)
    from pyspark.sql import functions as F

    back = {r.idx: r.text for r in srt.decode(coded.withColumn("answer", F.col("content"))).collect()}
    assert back == {0: "Hi", 1: "two\nlines", 3: "x" * 300, 4: "y" * 300, 5: "end"}
    parsed = srt.parse(srt.rebuild(cues.where("text <> ''")).withColumnRenamed("srt", "content")).collect()
    assert [r.text for r in sorted(parsed, key=lambda r: int(r.number))] == ["Hi", "two\nlines", "x" * 300, "y" * 300, "end"]
    assert srt.merge_continuations(["I go", "to town.", "You stay", "I know"]) == [[0, 1], [2, 3]]


def test_html_white_space(spark):
    from pyspark.sql import functions as F

    pages = {
        "<p>a\n  b</p>\n<pre>x\n y</pre>": "<p>a b</p>\n<pre>x\n y</pre>",
        "<p>a</p><p>b</p>": "<p>a</p>\n<p>b</p>\n",
        "<ul><li>x</li> <li>y</li></ul>z": "<ul><li>x</li>\n<li>y</li>\n</ul>\nz",
        "<TD>a\r\nb\rc</TD>  <nav>n</nav>": "<TD>a b c</TD>\n<nav>n</nav>\n",
        "a<br/>\n  b  c<BR >d": "a<br/> b c<BR >d",
        "<style>p  {\n}</style><code>i  = 1</code> <CODE>a  b</code>": "<style>p  {\n}</style><code>i  = 1</code> <CODE>a  b</code>",
        "": "",
    }
    rows = spark.createDataFrame(list(pages.items()) + [(None, None)], "html string, want string")
    for r in rows.select("want", e.normalise_html(F.col("html")).alias("got")).collect():
        assert r.got == r.want


def test_splits_as_specified():
    assert c.retry_split("abc. " * 20) == (("abc. " * 10).strip(), ("abc. " * 10).strip())
    assert c.retry_split("x" * 265, 0.503) == ("x" * 133, "x" * 132)
    assert c.retry_split(" \n ") == (" \n ", "")
    lines = [f"line {i}" + ("." if i in (7, 9, 14) else "") for i in range(20)]
    assert c.retry_split("\n".join(lines)) == ("\n".join(lines[:8]), "\n".join(lines[8:]))
    plain = [f"line {i}" for i in range(7)]
    assert c.retry_split("\n".join(plain)) == ("\n".join(plain[:3]), "\n".join(plain[3:]))
    assert c.boundary_split("x" * 50, 3) == ["x" * 25, "x" * 12, "x" * 13]
    assert c.boundary_split("x" * 90, 3) == ["x" * 45, "x" * 22, "x" * 23]
    assert c.boundary_split("ab cd. " * 60, 3) == [("ab cd. " * 60)[k : k + 140].strip() for k in (0, 140, 280)]
    assert c.boundary_split("", 3) == [] and c.boundary_split("", 1) == [""]


def test_segments_are_merged():
    """Against a fold written out: sums of counts, no separators, an oversize one by itself."""
    import random

    rng = random.Random(2)
    for _ in range(30):
        segments = ["".join(rng.choice("ab. ") for _ in range(rng.choice([4, 40, 90, 400]))) + "." for _ in range(12)]
        want, total = [], None
        for s in segments:
            n = c.count_by_ratio(s)
            if n > 50:
                want, total = want + c.split_long(s, 50), None
            elif total is not None and total + n <= 50:
                want[-1], total = want[-1] + s, total + n
            else:
                want, total = want + [s], n
        assert c.merge_segments(segments, 50) == want
    assert c.merge_segments([], 50) == []


def test_pattern_counts(spark):
    from quillspark.operators import lookups

    texts = ["use `a` and `b` at 10 Mbps", "```x\n`y`\n``` $$z$$ MAX1482", "plain", None, "&lt;p&gt;x&lt;/p&gt; costs $5$ or $x_1$"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.pattern: r.n for r in lookups.pattern_counts(rows, "id", "text").collect()}
    want = {"total": 0}
    for t in texts:
        for _, _, name, _ in e.technical_spans(t or ""):
            want[name] = want.get(name, 0) + 1
            want["total"] += 1
    assert got == want and {"inline_code", "code_block", "html_entity_block", "technical_id", "latex_inline"} <= set(got)
