"""Queries whose operators scan texts in Python or keep state; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as c
from ..functions import exact as e
from ..functions import placeholders as p
from ..operators import effects, srt, translate
from ..streaming import state
from .benchmark_queries import oracle_more
from .fixtures import oracle, table, view
from .structure_queries import BLOCKS, MARKED, marked
from .text_queries import sql_strip

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, query, sql=None, ctes=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = oracle_more(ctes, sql) if ctes else oracle(sql)


def docs(s, d):
    return table(s, d, "documents")


def over(name, column, function, kind="array<string>", sql=None):
    add(name, lambda s, d: e.apply(docs(s, d), ["doc_id"], "text", function, column, kind), sql)


def parts_over(name, function, sql):
    """One row a part that is not empty, from 0."""
    made = lambda s, d: e.apply(docs(s, d), ["doc_id"], "text", function, "parts", "array<string>")
    add(name, lambda s, d: made(s, d).select("doc_id", F.posexplode("parts").alias("n", "part")).where("part <> ''"), sql)


over("c11_c12_split_long", "pieces", lambda t: c.split_long(t, 100))
over("c13_force_split", "pieces", lambda t: c.force_split(t, 100))
ENDS = """([.!?]["']|\\.\\)|[.!?:])$"""
parts_over("c14_retry_split", lambda t: list(c.retry_split(t)), f"""
SELECT doc_id, CAST(n AS INT) AS n, part FROM (
  SELECT doc_id, unnest([0, 1]) AS n, unnest(CASE WHEN NOT regexp_matches(text, '\\S') THEN [text, '']
    WHEN len(l) = 1 THEN [{sql_strip("substr(text, 1, length(text) // 2)")}, {sql_strip("substr(text, length(text) // 2 + 1)")}]
    ELSE [{sql_strip("array_to_string(l[1:place], chr(10))")}, {sql_strip("array_to_string(l[place + 1:], chr(10))")}] END) AS part FROM (
      SELECT *, coalesce(list_filter(range(greatest(1, len(l) // 2 - 4), least(len(l), len(l) // 2 + 5) + 1), lambda i: regexp_matches({sql_strip("l[i]")}, '{ENDS.replace("'", "''")}'))[1], len(l) // 2) AS place
      FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))) WHERE part <> ''""")
over("c15_reduce_content", "reduced", c.reduce_content, "string", f"""
SELECT doc_id, CASE WHEN goal >= length(text) THEN text WHEN length(sentences) > goal // 2 THEN sentences ELSE substr(text, 1, goal) END AS reduced FROM (
  SELECT *, regexp_extract(substr(text, 1, goal), '(?s)^(.*(?:{ENDS[:-1].replace("'", "''")}))', 1) AS sentences FROM (
    SELECT doc_id, text, greatest(200, CAST(floor(length(text) * 0.6::DOUBLE) AS BIGINT)) AS goal FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))""")


def cut_sql(rows, left):
    """The first of ``left`` shares of ``rest`` goes to ``p{left}``."""
    short = "length(rest) < 100"
    at = f"CASE WHEN {short} THEN length(rest) // 2 ELSE CAST(floor(length(rest) * (1.0::DOUBLE / {left})) AS BIGINT) END"
    piece = lambda x: f"CASE WHEN {short} THEN {x} ELSE {sql_strip(x)} END"
    return f"SELECT * EXCLUDE (rest, place), {piece('substr(rest, 1, place)')} AS p{left}, {piece('substr(rest, place + 1)')} AS rest FROM (SELECT *, {at} AS place FROM ({rows}))"


THIRDS = cut_sql(cut_sql("SELECT doc_id, coalesce(text, '') AS rest FROM documents", 3), 2)
parts_over("c16_boundary_split", lambda t: c.boundary_split(t, 3),
    f"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS n, unnest(l) AS part FROM (SELECT doc_id, list_filter([p3, p2, rest], lambda x: x <> '') AS l FROM ({THIRDS}))")
over("z14_overflow_parts", "parts", lambda t: next((b for b in (c.boundary_split(t, n) for n in (2, 3, 4)) if max(map(len, b)) < 2000), c.boundary_split(t, 4)))
over("c17_speech_chunks", "chunks", lambda t: c.speech_chunks(t, 500))
#: An id as sessions have it: 16 hex digits.
ID = "a3f9c2b8e1d4f6a7"
add("x2_repetition_loop", lambda s, d: e.apply(docs(s, d).select("doc_id", F.right("text", F.lit(3000)).alias("text")), ["doc_id"], "text", e.has_loop, "loops", "boolean"))
#: The marks of ``SID:`` and the id, by the rule: eight bits a character, U+200C for 0 and U+200D for 1.
MARKS = "array_to_string(list_transform(string_split('SID:{i}', ''), lambda ch: replace(replace(right(bin(ascii(ch) + 256), 8), '0', chr(8204)), '1', chr(8205))), '')".format(i=ID)
over("x21_embed_id", "marked", lambda t: e.embed_id(t, ID, "distributed"), "string", f"""
SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN text WHEN k < 3 THEN text || m ELSE
  array_to_string(list_transform(range(1, k + 1), lambda i: w[i] || CASE i - 1 WHEN k // 4 THEN substr(m, 1, t) WHEN 2 * k // 4 THEN substr(m, t + 1, t) WHEN 3 * k // 4 THEN substr(m, 2 * t + 1) ELSE '' END), ' ') END AS marked
FROM (SELECT *, len(w) AS k, length(m) // 3 AS t FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ') AS w, {MARKS} AS m FROM documents))""")
WIDE = f"SELECT doc_id, CASE WHEN contains(text, '  ') OR len(w) <= 32 THEN text ELSE w[1] || array_to_string(list_transform(range(2, len(w) + 1), lambda i: CASE WHEN i <= 33 AND (0x{ID[:8]} >> (33 - i)) & 1 = 1 THEN '  ' ELSE ' ' END || w[i]), '') END AS marked FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ') AS w FROM documents)".replace(f"0x{ID[:8]}", str(int(ID[:8], 16)))
over("x22_embed_spaces", "marked", lambda t: e.embed_spaces(t, ID), "string", WIDE)
over("x22_detect_spaces", "found", lambda t: e.detect_spaces(e.embed_spaces(t, ID)), "string",
    f"SELECT doc_id, CASE WHEN len(r) >= 32 THEN 'SID-' || printf('%08x', CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN length(r[i]) > 1 THEN CAST(1 AS BIGINT) << (32 - i) ELSE 0 END)) AS BIGINT)) END AS found FROM (SELECT doc_id, regexp_extract_all(marked, ' +') AS r FROM ({WIDE}))")
over("x23_speech_text", "spoken", e.speech_text, "string",
    "SELECT doc_id, trim(regexp_replace(replace(translate(nfc_normalize(regexp_replace(coalesce(text, ''), '[^\\PC\\n\\t]', '', 'g')), '“”„«»‘’—–', '\"\"\"\"\"''''--'), '…', '...'), '\\s+', ' ', 'g')) AS spoken FROM documents")
FOUND = f"SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN 'SID:{ID}' END AS found FROM documents"
add("x20_detect_id", lambda s, d: e.apply(docs(s, d), ["doc_id"], "text", lambda t: e.detect_id(e.embed_id(t, ID, "middle")), "found", "string"), FOUND)
add("z30_detect_mark", lambda s, d: e.apply(docs(s, d), ["doc_id"], "text", lambda t: e.detect_mark(e.embed_id(e.embed_spaces(t, ID), ID, "end")), "found", "string"), FOUND)
add("x1_technical_spans", lambda s, d: e.apply(table(s, d, "pages"), ["page_id"], "html", lambda t: [f"{a}-{b}:{n}" for a, b, n, _ in e.technical_spans(t)], "spans", "array<string>"))
add("p4_protect", lambda s, d: e.apply(table(s, d, "pages"), ["page_id"], "html", lambda t: e.protect(t)[0], "protected", "string"))
add("p5_is_technical", lambda s, d: e.apply(table(s, d, "pages"), ["page_id"], "url", e.is_technical, "technical", "boolean"))
add("x16_normalise_html", lambda s, d: table(s, d, "pages").select("page_id", e.normalise_html(F.col("html")).alias("normalised")))
add("p13_p14_reinsert", lambda s, d: e.apply(marked(s, d), ["doc_id"], "marked", lambda t: e.reinsert(t, [(0, 0.0), (1, 0.5), (2, 1.0)]), "placed", "string"))
add("p15_align", lambda s, d: e.apply(marked(s, d), ["doc_id"], "marked", lambda t: e.align(t, t.replace("[id", "(").replace("e", "E")), "aligned", "string"))
add("c19_merge_continuations", lambda s, d: e.apply(srt.plain_text(view(s, d, "v_cues")), ["file_id"], "plain", lambda t: [",".join(map(str, g)) for g in c19(t)], "groups", "array<string>"))


def c19(text):
    return srt.merge_continuations(c.py_sentences(text))


add("c6_chunk_defaults", lambda s, d: c.chunk_text(docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens")))
add("c9_merge_segments", lambda s, d: e.apply(marked(s, d).select("doc_id", p.split_at(F.col("marked"), p.split_points(F.col("marked"), F.array(*[F.lit(t) for t in eval(BLOCKS)]))).alias("segments")), ["doc_id"], "segments", lambda x: c.merge_segments(list(x), 100), "chunks", "array<string>"))
add("p16_three_phase", lambda s, d: translate.three_phase(three(s, d)).select("doc_id", "phase"),
    f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 1 WHEN doc_id % 2 = 0 AND doc_id % 3 = 2 THEN 2 ELSE 3 END AS phase FROM ({MARKED})")


def three(s, d):
    """First answers lose a placeholder unless doc_id divides by 3; texts whose own placeholders are not 0..4 end in phase 3."""
    first = F.when(F.col("doc_id") % 3 == 0, F.replace("marked", F.lit("e"), F.lit("E"))).otherwise(F.replace("marked", F.lit("[id4]"), F.lit("")))
    return marked(s, d).select("doc_id", F.col("marked").alias("text"), F.lit(5).alias("expected"), first.alias("first"))


add("t10_two_pass", lambda s, d: translate.two_pass(table(s, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"]),
    "SELECT conv_id, turn, regexp_replace(replace(text, 'e', 'E'), '^\\s+|\\s+$', '', 'g') AS result FROM conversations")
add("z32_single_cues", lambda s, d: translate.per_cue(view(s, d, "v_cues").select("file_id", "idx", "text")).select("file_id", "idx", "result"),
    "SELECT file_id, idx, regexp_replace(replace(text, 'e', 'E'), '^\\s+|\\s+$', '', 'g') AS result FROM v_cues")
add("z22_refine_cues", lambda s, d: translate.refine_cues(view(s, d, "v_cues").select("file_id", "idx", F.replace("text", F.lit("e"), F.lit("E")).alias("draft"), F.when(F.col("idx") % 2 == 0, F.concat("text", F.lit("!"))).alias("refined"))),
    "SELECT file_id, idx, coalesce(lag(replace(text, 'e', 'E')) OVER w, '') AS before, coalesce(lead(replace(text, 'e', 'E')) OVER w, '') AS after, CASE WHEN idx % 2 = 0 THEN text || '!' ELSE replace(text, 'e', 'E') END AS result FROM v_cues WINDOW w AS (PARTITION BY file_id ORDER BY idx)")
add("t1_rate_limiter", lambda s, d: state.run_batch(view(s, d, "v_requests"), state.rate_limiter(3, 3600.0), "client"))
add("t2_adaptive_context", lambda s, d: state.run_batch(table(s, d, "events").select("event_id", "user_id", "ts", (F.col("value") * 60).cast("int").alias("used"), (F.col("event_type") == "error").alias("truncated")), state.adaptive_context(), "user_id"))
add("t3_circuit_breaker", lambda s, d: state.run_batch(table(s, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok")), state.circuit_breaker(2), "user_id"))
add("t6_loop_watch", lambda s, d: state.run_batch(table(s, d, "conversations").select(F.col("turn").alias("event_id"), F.timestamp_seconds("turn").alias("ts"), "conv_id", F.col("text").alias("token")), state.loop_watch(e.has_loop), "conv_id"))
add("z29_remaining", lambda s, d: state.run_batch(view(s, d, "v_requests"), state.rate_limiter(), "client").groupBy("key").agg(F.max_by("remaining", F.col("tie")).alias("remaining")))
add("k17_speech", lambda s, d: effects.audio_sizes(docs(s, d)))
add("t9_batches", lambda s, d: effects.in_batches(docs(s, d).select("doc_id"), "doc_id"), "SELECT doc_id, doc_id // 5 AS batch FROM documents")
add("x19_language", lambda s, d: language(s, d))


def language(s, d):
    """A stop-word scorer: share of a text's words that are frequent in one language only, learnt from the table."""
    from ..operators.language import detect, profile

    rows = docs(s, d)
    return detect(rows, profile(rows))
