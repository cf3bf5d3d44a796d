"""Queries over placeholders, chunks, subtitles and rebuilt files with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunking as c
from ..functions import placeholders as p
from ..operators import srt
from .benchmark_queries import oracle_more
from .fixtures import oracle, table, view
from .text_queries import sql_strip

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, query, sql=None, ctes=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = oracle_more(ctes, sql) if ctes else oracle(sql)


# A whole text with five placeholders, one after each of its first five stretches of 40 characters; numbers vary with doc_id.
MARKED = "SELECT doc_id, array_to_string(list_transform(range(0, 6), lambda i: CASE WHEN i < 5 THEN substr(text, i * 40 + 1, 40) ELSE substr(text, 201) END || CASE WHEN i < 5 THEN '[id' || CAST((i * (1 + doc_id % 2) + CASE WHEN doc_id % 3 = 1 AND i = 2 THEN 1 ELSE 0 END) AS VARCHAR) || ']' ELSE '' END), '') AS marked FROM documents"


def marked(s, d):
    i = lambda k: (F.lit(k) * (1 + F.col("doc_id") % 2) + F.when((F.col("doc_id") % 3 == 1) & (F.lit(k) == 2), 1).otherwise(0)).cast("string")
    parts = [x for k in range(6) for x in ([F.substring("text", k * 40 + 1, 40) if k < 5 else F.expr("substring(text, 201)")] + ([F.concat(F.lit("[id"), i(k), F.lit("]"))] if k < 5 else []))]
    return table(s, d, "documents").select("doc_id", F.concat(*parts).alias("marked"))


IDS = "list_transform(regexp_extract_all(marked, '\\[id(\\d+)\\]', 1), lambda x: CAST(x AS INT))"
SPLIT = "regexp_split_to_array(marked, '\\[id\\d+\\]')"


def show(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda x: CAST(x AS VARCHAR)), ',')"


def rejoin(markers: str, parts: str = SPLIT) -> str:
    return f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda i: ({parts})[i] || coalesce(({markers})[i], '')), '')"


add("p1_codec", lambda s, d: marked(s, d).select("doc_id", p.remove_all(F.col("marked")).alias("plain"), p.max_index(F.col("marked")).alias("top"), F.array_join(p.indices(F.col("marked")).cast("array<string>"), ",").alias("found"), p.create(F.col("doc_id")).alias("made")),
    f"SELECT doc_id, regexp_replace(marked, '\\[id\\d+\\]', '', 'g') AS plain, coalesce(list_max({IDS}), -1) AS top, {show(IDS)} AS found, '[id' || doc_id || ']' AS made FROM ({MARKED})")
add("p10_renumber_local", lambda s, d: marked(s, d).select("doc_id", p.renumber_local(F.col("marked")).alias("local")),
    f"SELECT doc_id, {rejoin(str([f'[id{k}]' for k in range(5)]))} AS local FROM ({MARKED})")
add("p2_renumber", lambda s, d: marked(s, d).select("doc_id", p.renumber(F.col("marked"), 100).alias("renumbered")),
    f"SELECT doc_id, {rejoin(f'list_transform({IDS}, lambda j: chr(91) || {chr(39)}id{chr(39)} || CAST(list_position(u, j) + 99 AS VARCHAR) || chr(93))')} AS renumbered FROM (SELECT *, list_transform(list_sort(list_transform(list_distinct(ids), lambda v: {{'a': list_position(ids, v), 'b': v}})), lambda z: z.b) AS u FROM (SELECT *, {IDS} AS ids FROM ({MARKED})))")
add("p11_restore_global", lambda s, d: marked(s, d).select("doc_id", p.restore_global(F.col("marked"), F.array(F.lit(40), F.lit(41), F.lit(42))).alias("restored")),
    f"SELECT doc_id, {rejoin(f'list_transform({IDS}, lambda j: chr(91) || {chr(39)}id{chr(39)} || CAST(CASE WHEN j < 3 THEN j + 40 ELSE j END AS VARCHAR) || chr(93))')} AS restored FROM ({MARKED})")
TAGS = "['<p>','<b class=\"x\">','</b>','<br/>','</p>']"
add("p6_restore_tags", lambda s, d: marked(s, d).select("doc_id", p.restore_tags(F.col("marked"), F.array(*[F.lit(t) for t in eval(TAGS)])).alias("html")),
    "SELECT doc_id, " + "replace(" * 5 + "marked, '[id4]', '</p>'), '[id3]', '<br/>'), '[id2]', '</b>'), '[id1]', '<b class=\"x\">'), '[id0]', '<p>') AS html FROM (" + MARKED + ")")
add("p7_missing", lambda s, d: marked(s, d).select("doc_id", F.array_join(p.missing(F.col("marked"), F.lit(6)), ",").alias("missing")),
    f"SELECT doc_id, array_to_string(list_filter(['[id0]','[id1]','[id2]','[id3]','[id4]','[id5]'], lambda m: NOT contains(marked, m)), ',') AS missing FROM ({MARKED})")
add("p8_validate_strict", lambda s, d: marked(s, d).select("doc_id", p.validate(F.col("marked"), F.when(F.col("doc_id") % 5 == 0, 4).otherwise(5)).alias("message")),
    f"SELECT doc_id, CASE WHEN len({IDS}) <> e THEN 'Placeholder count mismatch: expected ' || e || ', found ' || len({IDS}) WHEN list_sort({IDS}) <> [0,1,2,3,4] THEN 'Placeholder indices not sequential: ' || {show(f'list_sort({IDS})')} END AS message FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 4 ELSE 5 END AS e FROM ({MARKED}))")
add("p9_error_details", lambda s, d: marked(s, d).select("doc_id", p.error_details(F.col("marked"), F.lit(5)).alias("e")).select("doc_id", "e.*"),
    f"SELECT doc_id, {show('list_filter([0,1,2,3,4], lambda a: NOT list_contains(ids, a))')} AS missing, {show('list_sort(list_distinct(list_filter(ids, lambda a: a > 4)))')} AS extra, {show('list_sort(list_distinct(list_filter(ids, lambda a: len(list_filter(ids, lambda b: a = b)) > 1)))')} AS repeated, list_sort(ids) <> ids AS out_of_order, CAST(len(ids) AS INT) AS found FROM (SELECT *, {IDS} AS ids FROM ({MARKED}))")
add("a28_placeholder_counts", lambda s, d: marked(s, d).select("doc_id", F.explode(p.indices(F.col("marked"))).alias("i")).groupBy("doc_id", "i").agg(F.count("*").alias("n")).where("n > 1"),
    f"SELECT doc_id, i, count(*) AS n FROM (SELECT doc_id, unnest({IDS}) AS i FROM ({MARKED})) GROUP BY 1, 2 HAVING count(*) > 1")
add("p12_relative_positions", lambda s, d: marked(s, d).select("doc_id", F.posexplode(p.relative_positions(F.col("marked"))).alias("n", "r")).select("doc_id", "n", "r.index", F.round("r.position", 6).alias("position")),
    f"SELECT doc_id, CAST(n - 1 AS INT) AS n, CAST(({IDS})[n] AS INT) AS index, round(CASE WHEN total > 0 THEN length(array_to_string(({SPLIT})[1:n], '')) * 1.0::DOUBLE / total ELSE (n - 1) / 5.0::DOUBLE END, 6) AS position FROM (SELECT *, length(regexp_replace(marked, '\\[id\\d+\\]', '', 'g')) AS total FROM ({MARKED})), (SELECT unnest(range(1, 6)) AS n)".replace("* 1.0::DOUBLE / total", "/ CAST(total AS DOUBLE)"))
add("p22_fix_mutated", lambda s, d: marked(s, d).select("doc_id", p.fix_mutated(F.replace("marked", F.lit("[id"), F.lit("[ID ")), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(F.concat(F.lit("[ID "), i.cast("string"), F.lit("]")).alias("mutated"), p.create(i).alias("right")))).alias("fixed")),
    f"SELECT doc_id, marked AS fixed FROM ({MARKED})")
TOKENS = "regexp_extract_all(html, '<[^>]+>|[^<]+|<')"
add("p3_preserve_tags", lambda s, d: table(s, d, "pages").select("page_id", "html", p.preserve_tags(F.col("html")).alias("x")).select("page_id", "x.marked", F.size("x.tags").alias("n_tags"), (p.restore_tags(F.col("x.marked"), F.col("x.tags")) == F.col("html")).alias("restored")),
    f"""SELECT page_id, string_agg(CASE WHEN k THEN '[id' || (g2) || ']' ELSE t END, '' ORDER BY g) AS marked, CAST(count(*) FILTER (k) AS INT) AS n_tags, true AS restored FROM (
      SELECT page_id, g, k, string_agg(t, '' ORDER BY n) AS t, (count(*) FILTER (k) OVER (PARTITION BY page_id ORDER BY g)) - 1 AS g2 FROM (
        SELECT *, sum(b) OVER (PARTITION BY page_id ORDER BY n) AS g FROM (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY page_id ORDER BY n) THEN 1 ELSE 0 END AS b FROM (
          SELECT *, regexp_full_match(t, '(?s)<[^>]+>') OR regexp_matches({sql_strip('t')}, '(?i)^[\\d.\\-–—)(\\sIVXLCDM]*$') AS k FROM (SELECT page_id, unnest({TOKENS}) AS t, generate_subscripts({TOKENS}, 1) AS n FROM pages))))
      GROUP BY page_id, g, k) GROUP BY page_id""")
add("c10_tag_class", lambda s, d: table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<[^>]+>"), 0)).alias("tag")).select("page_id", p.is_block_close(F.col("tag")).alias("closes"), p.is_block_open(F.col("tag")).alias("opens"), p.split_priority(F.col("tag")).alias("priority")).groupBy("page_id", "closes", "opens", "priority").agg(F.count("*").alias("n")),
    "SELECT page_id, regexp_matches(lower(t), '</(" + "|".join(p.BLOCK_TAGS) + ")[ >]') AS closes, regexp_matches(lower(t), '<(" + "|".join(p.BLOCK_TAGS) + ")[ >]') AS opens, CASE WHEN regexp_matches(lower(t), '</h[123]>') THEN 1 WHEN regexp_matches(lower(t), '</(h[456]|section|article)>') THEN 2 WHEN regexp_matches(lower(t), '</(p|div|blockquote)>') THEN 3 ELSE 4 END AS priority, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[^>]+>')) AS t FROM pages) GROUP BY 1, 2, 3, 4")
BLOCKS = "['<p>','</p>','<p>','</p>','<b>','</b>']"


#: Where numbers run 0 to 4, the second placeholder closes a block and the third opens one; elsewhere no place is safe.
CUT = f"CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 1 THEN length(array_to_string(({SPLIT})[1:2], '')) + 10 ELSE length(marked) END"


add("c7_split_points", lambda s, d: marked(s, d).select("doc_id", F.array_join(p.split_points(F.col("marked"), F.array(*[F.lit(t) for t in eval(BLOCKS)])).cast("array<string>"), ",").alias("points")),
    f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 1 THEN CAST({CUT} AS VARCHAR) ELSE '' END AS points FROM ({MARKED})")
add("c8_split_segments", lambda s, d: marked(s, d).select("doc_id", F.posexplode(p.split_at(F.col("marked"), p.split_points(F.col("marked"), F.array(*[F.lit(t) for t in eval(BLOCKS)])))).alias("n", "segment")),
    f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS n, segment FROM (SELECT doc_id, 0 AS k, substr(marked, 1, {CUT}) AS segment FROM ({MARKED}) UNION ALL SELECT doc_id, 1, substr(marked, {CUT} + 1) FROM ({MARKED})) WHERE regexp_matches(segment, '\\S')")

# chunking
SENT = "list_filter(list_transform(string_split(regexp_replace(text, '(\\.\"|\\?\"|!\"|\\.''|\\?''|!''|\\.\\)|\\.|!|\\?|:)', '\\1' || chr(1), 'g'), chr(1)), lambda z: " + sql_strip("z") + "), lambda z: z <> '')"
add("c2_paragraphs", lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(c.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n \n")))).alias("n", "paragraph")).select("doc_id", "n", F.md5("paragraph").alias("digest")),
    "SELECT doc_id, CAST(n - 1 AS INT) AS n, md5(l[n]) AS digest FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\\n\\s*\\n'), lambda z: regexp_matches(z, '\\S')) AS l FROM documents))")
add("c3_sentences", lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(c.sentences(F.col("text"))).alias("n", "sentence")).select("doc_id", "n", F.md5("sentence").alias("digest")),
    f"SELECT doc_id, CAST(n - 1 AS INT) AS n, md5(l[n]) AS digest FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, {SENT} AS l FROM documents))")
PACK = f"""u AS (SELECT doc_id, {SENT} AS l FROM documents),
z AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS s FROM u),
t AS (SELECT doc_id, p, s, CAST(floor(length(s) / 4.0::DOUBLE * 1.1::DOUBLE) AS INT) AS n FROM z),
g AS (SELECT doc_id, p, n AS now, 0 AS chunk FROM t WHERE p = 1
      UNION ALL SELECT t.doc_id, t.p, CASE WHEN g.now + t.n <= 2000 THEN g.now + t.n ELSE t.n END, CASE WHEN g.now + t.n <= 2000 THEN g.chunk ELSE g.chunk + 1 END FROM g JOIN t ON t.doc_id = g.doc_id AND t.p = g.p + 1),
k AS (SELECT doc_id, chunk AS chunk_index, string_agg(s, ' ' ORDER BY p) AS content, CAST(sum(n) AS INT) AS token_count, count(*) AS units FROM g JOIN t USING (doc_id, p) GROUP BY 1, 2)"""


def short(s, d):
    """Documents of which every sentence fits."""
    return c.chunk_rows(table(s, d, "documents"), 2000)


add("c4_pack_units", lambda s, d: short(s, d).select("doc_id", "chunk_index", F.md5("content").alias("digest"), "token_count", "units"), "SELECT doc_id, chunk_index, md5(content) AS digest, token_count, units FROM k", PACK)
add("a12_chunk_stats", lambda s, d: c.chunk_stats(short(s, d), 1500),
    "SELECT count(*) AS chunks, round(avg(token_count), 6) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, count(*) FILTER (token_count <= 1500) AS in_range, round(count(*) FILTER (token_count <= 1500) * 100.0::DOUBLE / count(*), 6) AS compliance FROM k", PACK)
add("w1_context", lambda s, d: c.with_context(short(s, d)).select("doc_id", "chunk_index", F.md5("context_before").alias("before"), F.md5("context_after").alias("after")),
    "SELECT doc_id, chunk_index, md5(coalesce(lag(content) OVER w, '')) AS before, md5(coalesce(lead(content) OVER w, '')) AS after FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)", PACK)
add("c5_chunk_text", lambda s, d: c.chunk_text(table(s, d, "documents")).select("doc_id", "chunk_index", "main_content", "token_count"))
add("w3_last_words", lambda s, d: context(s, d, "words"),
    "SELECT conv_id, turn, coalesce(lag(CASE WHEN turn % 3 <> 2 THEN array_to_string(w[greatest(1, len(w) - 24):], ' ') ELSE '' END) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '') AS w FROM conversations)")
add("w4_last_chars", lambda s, d: context(s, d, "chars"),
    "SELECT conv_id, turn, coalesce(last_value(CASE WHEN turn % 3 <> 2 THEN right(text, 200) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")


def context(s, d, kind):
    rows, order = table(s, d, "conversations"), Window.partitionBy("conv_id").orderBy("turn")
    ok = F.col("turn") % 3 != 2
    if kind == "words":
        w = F.filter(F.split("text", r"\s+"), lambda z: z != "")
        made = F.lag(F.when(ok, F.array_join(F.slice(w, F.greatest(F.size(w) - 24, F.lit(1)), 25), " ")).otherwise("")).over(order)
    else:
        made = F.last(F.when(ok, F.right("text", F.lit(200))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("conv_id", "turn", F.coalesce(made, F.lit("")).alias("context"))


# subtitles
CUES = "cues AS (SELECT file_id, idx, text, number, start_ms, end_ms FROM v_cues)"
FOLD = """o AS (SELECT file_id, idx, text, length(text) AS n, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS r FROM v_cues),
b AS (SELECT file_id, idx, text, r, 0 AS block, 1 AS lines, n AS chars FROM o WHERE r = 1
  UNION ALL SELECT o.file_id, o.idx, o.text, o.r, CASE WHEN b.lines >= 5 OR b.chars + o.n > 500 THEN b.block + 1 ELSE b.block END, CASE WHEN b.lines >= 5 OR b.chars + o.n > 500 THEN 1 ELSE b.lines + 1 END, CASE WHEN b.lines >= 5 OR b.chars + o.n > 500 THEN o.n ELSE b.chars + o.n END FROM b JOIN o ON o.file_id = b.file_id AND o.r = b.r + 1),
l AS (SELECT file_id, block, idx, text, row_number() OVER (PARTITION BY file_id, block ORDER BY idx) - 1 AS local FROM b),
e AS (SELECT file_id, block, string_agg('[' || local || ']' || text, chr(10) ORDER BY local) AS content, list(text ORDER BY local) AS t FROM l GROUP BY 1, 2)"""


def cues(s, d):
    return view(s, d, "v_cues")


def subtitle_files(s, d):
    return srt.rebuild(cues(s, d)).withColumnRenamed("srt", "content")


add("c18_subtitle_blocks", lambda s, d: srt.blocks(cues(s, d)).select("file_id", "idx", "block", "local"), "SELECT file_id, idx, block, CAST(local AS INT) AS local FROM l", FOLD)
add("p19_w2_encode", lambda s, d: srt.encode(srt.blocks(cues(s, d))).select("file_id", "block", "content", "before", "after"),
    "SELECT file_id, block, content, coalesce(lag(t[-1]) OVER w, '') AS before, coalesce(lead(t[1]) OVER w, '') AS after FROM e WINDOW w AS (PARTITION BY file_id ORDER BY block)", FOLD)
add("w5_carried_context", lambda s, d: srt.carried_context(srt.blocks(cues(s, d))),
    "SELECT file_id, block, coalesce(lag(c) OVER (PARTITION BY file_id ORDER BY block), '') AS context FROM (SELECT file_id, block, array_to_string(list_transform(range(1, len(t) + 1), lambda i: '[' || (i - 1) || ']' || t[i]), chr(10)) AS c FROM e)", FOLD)
add("p20_j5_decode", lambda s, d: srt.decode(srt.encode(srt.blocks(cues(s, d))).withColumn("answer", F.replace("content", F.lit("e"), F.lit("E")))).select("file_id", "idx", "text"),
    "SELECT file_id, idx, " + sql_strip("regexp_replace(replace(text, 'e', 'E'), '(\\S)[ \\t]+(\\[\\d+\\])', '\\1' || chr(10) || '\\2', 'g')") + " AS text FROM v_cues")
add("p21_fix_midline", lambda s, d: cues(s, d).select("file_id", "idx", p.fix_midline_tags(F.concat("text", F.lit(" [1] "), "text")).alias("fixed")),
    "SELECT file_id, idx, regexp_replace(text || ' [1] ' || text, '(\\S.*?)\\s+(\\[\\d+\\])', '\\1' || chr(10) || '\\2', 'g') AS fixed FROM v_cues")
add("p18_tags_present", lambda s, d: cues(s, d).select("file_id", "idx", p.subtitle_tags_present(F.concat(F.lit("[0]"), "text", F.when(F.col("idx") % 2 == 0, F.lit("[1]")).otherwise("")), F.lit(2)).alias("ok")), "SELECT file_id, idx, idx % 2 = 0 AS ok FROM v_cues")
ANSWERED = "SELECT file_id, idx, CASE WHEN idx % 3 < 2 THEN replace(text, 'e', 'E') ELSE text END AS text"
add("j6_apply_translations", lambda s, d: srt.apply_translations(cues(s, d), cues(s, d).where("idx % 3 < 2").select("file_id", "idx", F.replace("text", F.lit("e"), F.lit("E")).alias("text"))).select("file_id", "idx", "text"), ANSWERED + " FROM v_cues")
MS = "printf('%02d:%02d:%02d,%03d', {m} // 3600000, {m} // 60000 % 60, {m} // 1000 % 60, {m} % 1000)"
CUE = "number || chr(10) || " + MS.format(m="start_ms") + " || ' --> ' || " + MS.format(m="end_ms") + " || chr(10) || {t} || chr(10)"
add("k2_rebuild_srt", lambda s, d: srt.rebuild(cues(s, d)), "SELECT file_id, string_agg(" + CUE.format(t="text") + ", chr(10) ORDER BY idx) AS srt FROM v_cues GROUP BY 1")
add("k3_bilingual_srt", lambda s, d: srt.rebuild(cues(s, d).withColumn("original_text", F.col("text")).withColumn("text", F.replace("text", F.lit("e"), F.lit("E"))), True),
    "SELECT file_id, string_agg(" + CUE.format(t="text || chr(10) || replace(text, 'e', 'E')") + ", chr(10) ORDER BY idx) AS srt FROM v_cues GROUP BY 1")
add("s7_subtitle_text", lambda s, d: srt.plain_text(cues(s, d)), "SELECT file_id, string_agg(text, ' ' ORDER BY idx) AS plain FROM v_cues WHERE regexp_matches(text, '\\S') GROUP BY 1")
add("s2_parse_srt", lambda s, d: srt.parse(subtitle_files(s, d)).select("file_id", "number", srt.to_ms(F.col("start_time")).alias("start_ms"), srt.to_ms(F.col("end_time")).alias("end_ms"), "text"),
    "SELECT file_id, number, start_ms, end_ms, " + sql_strip("text") + " AS text FROM v_cues WHERE NOT contains(text, chr(10) || chr(10)) AND regexp_matches(text, '\\S')")

# rebuilding of texts
add("k1_rebuild_text", lambda s, d: rebuilt(s, d),
    "SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS plain, string_agg(text || chr(10) || chr(10) || t || chr(10) || chr(10) || repeat('─', 40), chr(10) || chr(10) ORDER BY turn) AS bilingual FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN replace(text, 'e', 'E') ELSE text END AS t FROM conversations) GROUP BY 1")


def rebuilt(s, d):
    from ..sources import sinks

    rows = table(s, d, "conversations").withColumn("t", F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit("e"), F.lit("E"))))
    return sinks.rebuild_text(rows, "conv_id", "turn", "text", "t").withColumn("bilingual", F.concat("bilingual", F.lit("\n\n" + "─" * 40)))


HTML = "marked"
add("k4_rebuild_html", lambda s, d: rebuilt_html(s, d),
    f"SELECT k AS doc, string_agg(r, '' ORDER BY doc_id) AS html FROM (SELECT doc_id, doc_id % 10 AS k, {'replace(' * 5} marked, '[id4]', '</p>'), '[id3]', '<br/>'), '[id2]', '</b>'), '[id1]', '<b class=\"x\">'), '[id0]', '<p>') AS r FROM ({MARKED})) GROUP BY 1")


def rebuilt_html(s, d):
    from ..sources import sinks

    rows = marked(s, d).select((F.col("doc_id") % 10).alias("doc"), F.col("doc_id").alias("n"), "marked")
    return sinks.rebuild_html(rows, "doc", "n", "marked", F.array(*[F.lit(t) for t in eval(TAGS)]))
