"""``[idN]`` placeholders and markup protection as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_non_translatable

PATTERN = r"\[id(\d+)\]"
#: Tags that open or close a block, and the levels of splitting behind them.
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "li", "tr", "td", "th")
CHAPTER_TAGS, SECTION_TAGS, PARAGRAPH_TAGS = ("h1", "h2", "h3"), ("h4", "h5", "h6", "section", "article"), ("p", "div", "blockquote")


def create(index: Column) -> Column:
    """P1."""
    return F.concat(F.lit("[id"), index.cast("string"), F.lit("]"))


def indices(text: Column) -> Column:
    """Numbers of all placeholders, in order of the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(PATTERN), 1), lambda x: x.cast("int"))


def remove_all(text: Column) -> Column:
    return F.regexp_replace(text, PATTERN, "")


def max_index(text: Column) -> Column:
    return F.coalesce(F.array_max(indices(text)), F.lit(-1))


def pieces(text: Column) -> Column:
    """Texts between the placeholders: one more than there are placeholders."""
    return F.split(text, r"\[id\d+\]", -1)


def _rejoin(text: Column, markers: Column) -> Column:
    """The pieces with other markers between them."""
    between = F.concat(markers, F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces(text), between, lambda a, b: F.concat(a, b)), "")


def renumber(text: Column, offset: int = 0) -> Column:
    """Numbers in order of first appearance; all at once, so no new number meets an old one."""
    order = F.array_distinct(indices(text))
    return _rejoin(text, F.transform(indices(text), lambda i: create((F.array_position(order, i) - 1 + offset).cast("int"))))


def renumber_local(text: Column) -> Column:
    """P10: every occurrence gets the next local number."""
    return _rejoin(text, F.transform(indices(text), lambda _, n: create(n)))


def restore_global(text: Column, global_indices: Column) -> Column:
    """Local numbers back to the global ones; unknown locals stay."""
    return _rejoin(text, F.transform(indices(text), lambda i: create(F.coalesce(F.try_element_at(global_indices, i + 1), i))))


def tokens(html: Column) -> Column:
    """Tags and the texts between them; a ``<`` that no tag begins with is a text."""
    return F.regexp_extract_all(html, F.lit(r"(<[^>]+>|[^<]+|<)"), 1)


#: Fences of protected and of free runs: code points that no text may contain.
_OPEN, _CLOSE, _FREE, _END = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def _fenced(html: Column) -> Column:
    """The text with a fence around every run of protected and of free tokens; fences that meet inside a run fall away."""
    def fence(t):
        kept = F.regexp_like(t, F.lit(r"(?s)^<[^>]+>$")) | is_non_translatable(t)
        return F.when(kept, F.concat(F.lit(_OPEN), t, F.lit(_CLOSE))).otherwise(F.concat(F.lit(_FREE), t, F.lit(_END)))
    joined = F.array_join(F.transform(tokens(html), fence), "")
    return F.replace(F.replace(joined, F.lit(_CLOSE + _OPEN), F.lit("")), F.lit(_END + _FREE), F.lit(""))


def preserve_tags(html: Column) -> Column:
    """Struct of the text with numbered placeholders and the protected strings in their order. Adjacent tags and what is
    not translatable between them share a placeholder."""
    fenced = _fenced(html)
    run = f"{_OPEN}[^{_CLOSE}]*{_CLOSE}"
    kept = F.regexp_extract_all(fenced, F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"), 1)
    free = F.transform(F.split(fenced, run, -1), lambda t, i: F.concat(F.when(i == 0, F.lit("")).otherwise(create(i - 1)), F.translate(t, _FREE + _END, "")))
    return F.struct(F.array_join(free, "").alias("marked"), kept.alias("tags"))


def restore_tags(text: Column, tags: Column) -> Column:
    """Highest number first, every occurrence. Where neither a tag nor the text between placeholders has a ``[``, no
    replacement makes a new placeholder, and one pass over the pieces does the same."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), 0)
    tag = lambda p: F.try_element_at(tags, F.regexp_extract(p, PATTERN, 1).try_cast("int") + 1)
    known = lambda p: create(F.regexp_extract(p, PATTERN, 1).try_cast("int")) == p
    at_once = _rejoin(text, F.transform(found, lambda p: F.coalesce(F.when(known(p), tag(p)), p)))
    one_by_one = F.aggregate(F.sequence(F.size(tags) - 1, F.lit(0), F.lit(-1)), text, lambda t, i: F.replace(t, create(i), F.element_at(tags, i + 1)))
    plain = ~F.contains(remove_all(text), F.lit("[")) & ~F.exists(tags, lambda t: F.contains(t, F.lit("[")))
    return F.when(F.size(tags) <= 0, text).when(plain, at_once).otherwise(one_by_one)


def missing(text: Column, expected: Column) -> Column:
    """Placeholders of 0..expected-1 that the text lacks."""
    wanted = F.when(expected > 0, F.sequence(F.lit(0), expected - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(wanted, lambda i: create(i)), lambda p: ~F.contains(text, p))


def validate(text: Column, expected: Column) -> Column:
    """Null if valid, else the complaint; the order in the text does not matter."""
    found = indices(text)
    n = F.size(found)
    wrong = F.array_sort(found) != F.sequence(F.lit(0), F.greatest(expected - 1, F.lit(0)))
    return (
        F.when(expected == 0, None)
        .when(n != expected, F.concat(F.lit("Placeholder count mismatch: expected "), expected.cast("string"), F.lit(", found "), n.cast("string")))
        .when(wrong, F.concat(F.lit("Placeholder indices not sequential: "), F.array_join(F.transform(F.array_sort(found), lambda i: i.cast("string")), ",")))
    )


def error_details(text: Column, expected: Column) -> Column:
    """Struct of missing, extra and repeated numbers, whether they are out of order, and the count found."""
    found = indices(text)
    want = F.when(expected > 0, F.sequence(F.lit(0), expected - 1)).otherwise(F.array().cast("array<int>"))
    distinct = F.array_distinct(found)
    repeated = F.filter(distinct, lambda i: F.size(F.filter(found, lambda j: j == i)) > 1)
    show = lambda a: F.array_join(F.transform(a, lambda i: i.cast("string")), ",")
    return F.struct(
        show(F.array_except(want, found)).alias("missing"), show(F.array_sort(F.array_except(found, want))).alias("extra"),
        show(F.array_sort(repeated)).alias("repeated"), (F.array_sort(found) != found).alias("out_of_order"), F.size(found).alias("found"))


def relative_positions(text: Column) -> Column:
    """Of each placeholder, the length of text before it over the length of all text; by number without any text."""
    parts, found = pieces(text), indices(text)
    total = F.length(remove_all(text))
    def at(i, n):
        before = F.length(F.array_join(F.slice(parts, 1, n + 1), ""))
        return F.struct(i.alias("index"), F.when(total > 0, before / total).otherwise(n / F.size(found)).alias("position"))
    return F.transform(found, at)


def fix_mutated(text: Column, pairs: Column) -> Column:
    """Array of (mutated, right) replaced one after the other."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["mutated"], p["right"]))


def subtitle_tags_present(text: Column, count: Column) -> Column:
    """All of [0]..[count-1]."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))
    return F.size(F.array_except(F.sequence(F.lit(0), count - 1), found)) == 0


def fix_midline_tags(text: Column) -> Column:
    """P21."""
    return F.regexp_replace(text, r"(\S.*?)\s+(\[\d+\])", "$1\n$2")


def _tag_any(tag: Column, names, form: str) -> Column:
    return F.regexp_like(F.lower(tag), F.lit("|".join(form.format(n) for n in names)))


def is_block_close(tag: Column) -> Column:
    """C10."""
    return _tag_any(tag, BLOCK_TAGS, "</{0}[ >]")


def is_block_open(tag: Column) -> Column:
    return _tag_any(tag, BLOCK_TAGS, "<{0}[ >]")


def split_priority(tag: Column) -> Column:
    """1 chapter, 2 section, 3 paragraph, 4 else."""
    close = "</{0}>"
    return F.when(_tag_any(tag, CHAPTER_TAGS, close), 1).when(_tag_any(tag, SECTION_TAGS, close), 2).when(_tag_any(tag, PARAGRAPH_TAGS, close), 3).otherwise(4)


def split_points(text: Column, tags: Column) -> Column:
    """Places behind a placeholder that closes a block while the next one opens one."""
    parts, found = pieces(text), indices(text)
    def end(n):  # place behind the n-th (0-based) placeholder
        before = F.length(F.array_join(F.slice(parts, 1, n + 1), ""))
        marks = F.aggregate(F.slice(found, 1, n + 1), F.lit(0), lambda a, i: a + F.length(create(i)))
        return (before + marks).cast("int")
    tag = lambda n: F.coalesce(F.try_element_at(tags, F.try_element_at(found, n + 1) + 1), F.lit(""))
    places = F.sequence(F.lit(0), F.size(found) - 2)
    good = F.filter(places, lambda n: is_block_close(tag(n)) & is_block_open(tag(n + 1)))
    return F.when(F.size(found) > 1, F.transform(good, end)).otherwise(F.array().cast("array<int>"))


def split_at(text: Column, points: Column) -> Column:
    """Non-blank segments between the points."""
    bounds = F.concat(F.array(F.lit(0)), points, F.array(F.length(text)))
    cut = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.substring(text, F.element_at(bounds, i) + 1, F.element_at(bounds, i + 1) - F.element_at(bounds, i)))
    return F.filter(cut, lambda s: F.regexp_like(s, F.lit(r"\S")))
