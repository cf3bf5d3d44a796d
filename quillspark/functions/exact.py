"""Text operators that need a scan of their own: repetition loops, technical spans, placement of placeholders, marks in text.

Each is a plain function of one text; ``apply`` runs it over Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply(rows: DataFrame, keys: list[str], column: str, function: Callable[[str], object], name: str, kind: str) -> DataFrame:
    """``keys`` and ``name`` = function(column); a null text is passed as ''."""
    fields = rows.select(*keys).schema.simpleString()[7:-1].replace(":", " ")
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([function(t or "") for t in batch.column(column).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), made], names=[*keys, name])

    return rows.select(*keys, column).mapInArrow(run, f"{fields}, {name} {kind}")


# -- X2: loops --------------------------------------------------------------------------------------------------------


def _distances(tail: str, shortest: int, repetitions: int) -> list[int]:
    """Lengths that a loop's phrase may have: how far off a few characters recur, looked for at places so dense that each loop
    has one with a whole phrase behind it."""
    few = min(shortest, 5)
    step = max(1, min(shortest * (repetitions - 1), 20 * 4) - few)
    found = set()
    for at in range(0, len(tail), step):
        sign, next_at = tail[at : at + few], at + shortest
        while (next_at := tail.find(sign, next_at, at + 79 + few)) >= 0:
            found.add(next_at - at)
            next_at += 1
    return sorted(found)


def has_loop(text: str, shortest: int = 5, repetitions: int = 10) -> bool:
    """Some phrase of 5 to 79 characters with a letter or digit repeats in the last 3000 characters: ``repetitions`` times,
    or five fewer (five at least) from 20 characters on. A loop that begins exactly where the last possible one would is missed.

    Equal characters at a distance of the phrase's length stand in runs. All phrases inside a run are rotations of one, so its
    first one speaks for them.
    """
    if len(text) < shortest * repetitions:
        return False
    tail = text[-3000:]
    signs, n = np.frombuffer(tail.encode("utf-32-le", "surrogatepass"), np.uint32), len(tail)
    for size in _distances(tail, shortest, repetitions):
        if size >= n // repetitions:
            break
        need = repetitions if size < 20 else max(5, repetitions - 5)
        same = signs[size:] == signs[:-size]
        if np.count_nonzero(same) < size * (need - 1):
            continue
        edges = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
        starts = edges[:-1][np.diff(edges) > size * (need - 1)] + 1
        if any(any(map(str.isalnum, tail[i : i + size])) for i in starts[starts < n - size * need]):
            return True
    return False


# -- X1: technical spans ----------------------------------------------------------------------------------------------

#: Name, priority and pattern of technical content.
SPANS = [
    ("code_block", 10, re.compile(r"```[\w]*.*?```", re.S)),
    ("latex_display", 10, re.compile(r"\$\$(.+?)\$\$", re.S)),
    ("html_entity_block", 9, re.compile(
        r"&(?:lt|gt|amp|quot|apos|#\d+|#x[0-9a-fA-F]+);(?:(?!&(?:lt|gt|amp|quot|apos|#)).)*?"
        r"(?:&(?:lt|gt|amp|quot|apos|#\d+|#x[0-9a-fA-F]+);(?:(?!&(?:lt|gt|amp|quot|apos|#)).)*?){2,}"
        r"&(?:lt|gt|amp|quot|apos|#\d+|#x[0-9a-fA-F]+);", re.S)),
    ("inline_code", 5, re.compile(r"`[^`]+`")),
    ("latex_inline", 5, re.compile(r"\$([^\$\n]+?)\$(?!\d)")),
    ("measurement", 3, re.compile(r"\b(\d+(?:\.\d+)?)\s*(ULs?|Mbps|kbps|Gbps|kHz|MHz|GHz|Hz|V|mV|mA|µA|uA|ms|ns|µs|us|Ω|ohm|W|kW|F|µF|uF|pF|H|mH|µH|uH)\b", re.I)),
    ("measurement_range", 3, re.compile(r"[+-]?\d+(?:\.\d+)?\s+to\s+[+-]?\d+(?:\.\d+)?\s*[A-Z]+\b", re.I)),
    ("technical_id", 2, re.compile(r"\b([A-Z]{2,}(?:[/-][A-Z\d]+)*(?:-[A-Z\d]+)?|[A-Z]+\d{3,})\b")),
]


def is_formula(content: str) -> bool:
    """X1b."""
    return bool(re.search(r"[_^\\{}]", content)) or not re.fullmatch(r"\d+(?:\.\d{1,2})?|[a-zA-Z]+", content)


def technical_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, name, priority) without overlaps: of two, the higher priority, then the longer, stays."""
    found = [
        (m.start(), m.end(), name, priority) for name, priority, pattern in SPANS for m in pattern.finditer(text)
        if name != "latex_inline" or is_formula(m.group(1))
    ]
    rank = lambda s: (s[3], s[1] - s[0])

    def settle(kept: list, span: tuple) -> list:
        apart = not kept or kept[-1][1] <= span[0]
        return [*kept, span] if apart else [*kept[:-1], max(kept[-1], span, key=rank)]

    return reduce(settle, sorted(found, key=lambda s: (s[0], -s[3])), [])


def is_technical(text: str) -> bool:
    """P5: spans cover more than 0.8 of the text."""
    body = text.strip()
    return bool(body) and sum(e - s for s, e, _, _ in technical_spans(body)) / len(body) > 0.8


def protect(html: str) -> tuple[str, list[str]]:
    """Text with placeholders, and what they stand for: tags (adjacent ones and what is not translatable between them
    fused), and each technical span by itself."""
    from_pattern = re.compile(r"(<[^>]+>)")
    nothing = re.compile(r"[\d.\-–—)(\s\u00a0\u2000-\u200f\u2028\u2029IVXLCDM]*", re.I)
    blocks = [s for s in technical_spans(html) if s[2] in ("code_block", "latex_display", "html_entity_block")]
    out: list[str] = []
    kept: list[str] = []
    fused = False

    def keep(part: str, alone: bool) -> None:
        nonlocal fused
        if fused and not alone:
            kept[-1] += part
            return
        out.append(f"[id{len(kept)}]")
        kept.append(part)
        fused = not alone

    def free(part: str) -> None:
        nonlocal fused
        for piece in from_pattern.split(part):
            if not piece:
                continue
            if from_pattern.fullmatch(piece) or nothing.fullmatch(piece.strip()):
                keep(piece, False)
                continue
            at = 0
            for s, e, _, _ in technical_spans(piece):
                if piece[at:s]:
                    out.append(piece[at:s])
                    fused = False
                keep(piece[s:e], True)
                at = e
            if piece[at:]:
                out.append(piece[at:])
                fused = False

    at = 0
    for s, e, _, _ in blocks:
        free(html[at:s])
        keep(html[s:e], True)
        at = e
    free(html[at:])
    return "".join(out), kept


# -- P13-P15: placement of placeholders --------------------------------------------------------------------------------

_BOUNDARY = re.compile(r"[\s.,;:!?()\[\]{}\"'«»“”‘’…、。，！？；：（）【】《》—–-]")


def nearest_boundary(text: str, at: int) -> int:
    """The place next to a boundary character that is nearest; the left one of two."""
    at = max(0, min(at, len(text)))
    if at in (0, len(text)):
        return at
    good = lambda i: i in (0, len(text)) or bool(_BOUNDARY.match(text[i]) or _BOUNDARY.match(text[i - 1]))
    for far in range(len(text) + 1):
        for i in (at - far, at + far):
            if 0 <= i <= len(text) and good(i):
                return i
    return at


def reinsert(text: str, positions: list[tuple[int, float]], compat: bool = False) -> str:
    """(number, relative place) into a text without placeholders; numbers at one place keep their order, or come out
    reversed with ``compat``."""
    placed = [(nearest_boundary(text, round(p * len(text))), n if not compat else -n, i) for n, (i, p) in enumerate(positions)]
    for at, _, index in sorted(placed, reverse=True):
        text = f"{text[:at]}[id{index}]{text[at:]}"
    return text


def align(original: str, translated: str, compat: bool = False) -> str:
    """The original's placeholders at the same relative places of a translation that lost them. ``compat`` measures raw
    starts against the length of the text alone, which shifts later ones to the end."""
    pattern = re.compile(r"\[id(\d+)\]")
    clean = pattern.sub("", original)
    positions, before = [], 0
    for m in pattern.finditer(original):
        start = m.start() if compat else m.start() - before
        positions.append((int(m.group(1)), min(1.0, start / len(clean) if clean else 0.0)))
        before += m.end() - m.start()
    last, placed = 0, []
    for index, p in positions:  # in order, never before the one ahead
        last = max(last, nearest_boundary(translated, round(p * len(translated))))
        placed.append((last, index))
    for at, index in reversed(placed):
        translated = f"{translated[:at]}[id{index}]{translated[at:]}"
    return translated


# -- X16, X20-X23: white space, marks, speech --------------------------------------------------------------------------


#: Stands for a guarded stretch while the rest is tidied; no character, so no text has it.
_GUARDED = "\ufdd0"
_GUARD = r"(?is)<(pre|code|script|style)[^>]*>.*?</\1>|<br\s*/?\s*>"
#: Tags that a new line follows, and the rules in their order.
_CLOSING = "p|div|li|h[1-6]|blockquote|section|article|header|footer|nav|aside|ol|ul|table|tr|td|th|dt|dd"
_TIDY = [
    (r"\r\n?", "\n"), (rf"(?i)(</(?:{_CLOSING})>)[ \t]*", "$1\n"), (r"(?<!>)[ \t]*\n(?!\n)[ \t]*", " "),
    (r" {2,}", " "), (r" \n", "\n"), (r"\n ", "\n"),
]


def normalise_html(html: Column) -> Column:
    """A line end after each closing block tag, those inside text become spaces, runs of spaces one; ``pre``, ``code``,
    ``script``, ``style`` and line breaks stay as they are."""
    guarded = F.regexp_extract_all(html, F.lit(_GUARD), F.lit(0))
    tidy = reduce(lambda t, rule: F.regexp_replace(t, *rule), _TIDY, F.array_join(F.split(html, _GUARD, -1), _GUARDED))
    parts = F.transform(F.split(tidy, _GUARDED, -1), lambda t, i: F.concat(t, F.coalesce(F.try_element_at(guarded, i + 1), F.lit(""))))
    return F.array_join(parts, "")


ZERO, ONE = "\u200c", "\u200d"


def embed_id(text: str, identifier: str, where: str = "middle") -> str:
    """``SID:`` and an id as zero-width bits: behind the first word, before a closing mark at the end, at the space next
    to the middle, or in thirds behind the words at a quarter, half and three quarters. A blank text stays as it is."""
    if not text.strip():
        return text
    marks = "".join(f"{ord(c):08b}" for c in f"SID:{identifier}").translate({ord("0"): ZERO, ord("1"): ONE})
    words = text.split(" ")
    if where == "distributed" and len(words) >= 3:
        third = len(marks) // 3
        for k, part in zip((1, 2, 3), (marks[:third], marks[third : 2 * third], marks[2 * third :])):
            words[k * len(words) // 4] += part
        return " ".join(words)
    at = {
        "start": len(words[0]), "end": len(text) - text.endswith((".", "!", "?")),
        "middle": next((i for i in (text.find(" ", len(text) // 2), text.rfind(" ", 0, len(text) // 2)) if i >= 0), len(text)),
    }.get(where, len(text))
    return text[:at] + marks + text[at:]


def detect_id(text: str) -> str | None:
    """``SID:`` and the 16 hex digits that zero-width bits spell."""
    bits = "".join("0" if c == ZERO else "1" for c in text if c in (ZERO, ONE))
    spelt = "".join(chr(int(bits[i : i + 8], 2)) for i in range(0, len(bits) - 7, 8))
    found = re.search("SID:[0-9a-f]{16}", spelt)
    return found and found[0]


#: Spaces that carry an id: 32 bits, its first eight hex digits.
SPACES = 32


def embed_spaces(text: str, identifier: str) -> str:
    """Of the first 32 spaces, a double one for each 1 of the id's first 32 bits. A text that has a double space already,
    or fewer spaces, stays as it is."""
    words = text.split(" ")
    if "  " in text or len(words) <= SPACES:
        return text
    wide = int(identifier[:8], 16)
    gaps = [" " * (1 + (wide >> (SPACES - 1 - i) & 1)) for i in range(SPACES)] + [" "] * len(words)
    return words[0] + "".join(g + w for g, w in zip(gaps, words[1:]))


def detect_spaces(text: str) -> str | None:
    """``SID-`` and the eight hex digits of the first 32 runs of spaces."""
    runs = re.findall(" +", text)[:SPACES]
    return f"SID-{sum((len(r) > 1) << (SPACES - 1 - i) for i, r in enumerate(runs)):08x}" if len(runs) == SPACES else None


def detect_mark(text: str) -> str | None:
    """By zero-width marks, else by spaces."""
    return detect_id(text) or detect_spaces(text)


#: Marks and what is written for them; no mark stands in what is written, so their order does not matter.
_PLAIN = {"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "…": "..."}


def speech_text(text: str) -> str:
    """No control characters, NFC, plain quotes and dashes, single spaces. Each step looks at distinct characters or runs
    over the text as one call."""
    unheard = [c for c in set(text) if c not in "\n\t" and unicodedata.category(c)[0] == "C"]
    if unheard:
        text = text.translate(dict.fromkeys(map(ord, unheard)))
    text = unicodedata.normalize("NFC", text)
    for mark, plain in _PLAIN.items():
        text = text.replace(mark, plain)
    return " ".join(text.split())
