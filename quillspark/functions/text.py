"""Text functions as Column expressions: cleaning, extraction, detection, estimates, file and path rules.

All are native expressions; ``(?U)`` makes Java's classes Unicode-aware where the semantics ask for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------------
#: Characters per token of a language; others take the default.
CHAR_RATIOS = {"english": 4.0, "french": 3.5, "spanish": 3.5, "german": 3.8, "italian": 3.6, "portuguese": 3.5, "russian": 3.2, "chinese": 1.5, "japanese": 2.0, "korean": 2.5, "arabic": 3.0}
DEFAULT_RATIO, MARGIN = 4.0, 1.1
CONTEXT_SIZES = (2048, 4096, 8192, 16384, 32768, 65536, 131072)
SUSPICIOUS = ("<script", "javascript:", "data:", "vbscript:", "onload=", "onerror=", "eval(", "document.cookie", "window.location", "<?php", "<%", "exec(", "system(", "shell_exec(")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"))
TEXT_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
EXTENSIONS = (".txt", ".epub", ".srt", ".docx")
FAMILY_CONTEXTS = (("gpt-4", 128000), ("gpt", 8192), ("claude", 100000), ("deepseek", 16384), ("mistral", 8192), ("gemma", 8192), ("qwen", 8192), ("llama", 4096), ("phi", 2048))
DEFAULT_CONTEXT = 2048
ALWAYS_THINKING = ("qwen3:30b", "qwen3-vl", "phi4-reasoning", "deepseek-r1", "qwq", "marco-o1", "exaone-deep")
MAY_THINK = ("qwen3:8b", "qwen3:14b", "qwen3:4b", "qwen3:1.7b", "qwen3:0.6b")
WEIGHTS = {"accuracy": 0.35, "fluency": 0.30, "style": 0.20, "overall": 0.15}
TEXT_SPECIFIC_TERMS = ("austen", "wilde", "doyle", "thoreau", "melville", "pride", "prejudice", "dorian", "gray", "scarlet", "walden", "moby", "dick", "ishmael", "watson", "holmes", "wotton", "afghanistan", "laburnum", "persian")
INVISIBLE = "\u200b\u200c\u200d\u2060"


def _replace_all(text: Column, pairs) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), pairs, text)


def strip(text: Column) -> Column:
    """All white space at both ends."""
    return F.regexp_replace(text, r"^[\s\u00a0\u2000-\u200a\u2028\u2029\u3000\u0085\x1C-\x1F]+|[\s\u00a0\u2000-\u200a\u2028\u2029\u3000\u0085\x1C-\x1F]+$", "")


# -- cleaning ---------------------------------------------------------------------------------------------------------


def clean_entities(text: Column) -> Column:
    """Each ``&nbsp;`` becomes U+00A0, then nine entities one after the other."""
    return _replace_all(F.replace(text, F.lit("&nbsp;"), F.lit("\u00a0")), ENTITIES)


def clean_spaces(text: Column) -> Column:
    """X13."""
    t = F.regexp_replace(text, r" +", " ")
    t = F.regexp_replace(t, r"\s+([.,!?;:])", "$1")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def drop_placeholders(text: Column) -> Column:
    """X15."""
    return F.regexp_replace(text, r"\[id\d+\]", "")


def custom_rule(pattern: str, replacement: str):
    """A replacement rule of the caller's."""
    return lambda text: F.regexp_replace(text, pattern, replacement)


class Rules:
    """An ordered list of Column -> Column rules; the default cleans entities, then spaces."""

    def __init__(self, rules=(clean_entities, clean_spaces)):
        self.rules = list(rules)

    def add(self, rule) -> Rules:
        return Rules([*self.rules, rule])

    def remove(self, rule) -> Rules:
        return Rules([r for r in self.rules if r is not rule])

    def __call__(self, text: Column) -> Column:
        return reduce(lambda t, rule: rule(t), self.rules, text)


def clean_for_detection(text: Column) -> Column:
    """White space, tags, addresses of the web, of mail; in this order."""
    t = F.regexp_replace(text, r"\s+", " ")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"https?://\S+", "")
    return strip(F.regexp_replace(t, r"\S+@\S+", ""))


def sample_for_detection(text: Column, most: int = 10_000, least: int = 50) -> Column:
    """Head, middle and tail of a long text; null for a short one."""
    part, n = most // 3, F.length(text)
    half = part // 2
    middle = F.substring(text, F.floor(n / 2).cast("int") - half + 1, 2 * half)
    cut = F.concat(F.substring(text, 1, part), F.lit(" "), middle, F.lit(" "), F.substring(text, n - part + 1, part))
    return F.when(n < least, None).when(n > most, cut).otherwise(text)


def strip_invisible(text: Column) -> Column:
    """Without zero-width marks."""
    return F.translate(text, INVISIBLE, "")


def has_invisible(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"[{INVISIBLE}]"))


def br_to_newline(html: Column) -> Column:
    """X38."""
    return F.regexp_replace(F.regexp_replace(html, r"<br\s*/?>", "\n"), r"<[^>]+>", "")


def html_to_text(html: Column) -> Column:
    """Without scripts, styles, tags; white space collapsed; then six entities in order."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return _replace_all(F.trim(F.regexp_replace(t, r"\s+", " ")), TEXT_ENTITIES)


def body_html(html: Column) -> Column:
    """The body's inner markup, '' without a body."""
    return strip(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1))


def srt_detection_text(content: Column) -> Column:
    """Lines that are neither blank, nor numbers, nor timecodes, joined by spaces."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))))
    keep = F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"^\d+$")) & ~F.contains(x, F.lit("-->")))
    return F.array_join(keep, " ")


# -- answers ----------------------------------------------------------------------------------------------------------


def extract_answer(raw: Column, tag: str = "TRANSLATION") -> Column:
    """Thinking is dropped, also an orphan end of it; then what the tags hold; null if there are none."""
    t = strip(raw)
    t = F.regexp_replace(t, r"(?is)<think>.*?</think>", "")
    t = strip(F.regexp_replace(t, r"(?is)^.*?</think>", ""))
    start, end = f"<{tag}>", f"</{tag}>"
    whole = F.startswith(t, F.lit(start)) & F.endswith(t, F.lit(end))
    inner = F.substring(t, F.lit(len(start) + 1), F.length(t) - len(start) - len(end))
    found = F.regexp_like(t, F.lit(f"(?s){start}.*?{end}"))
    return F.when(whole, strip(inner)).when(found, strip(F.regexp_extract(t, f"(?s){start}(.*?){end}", 1)))


def answer_or_raw(raw: Column, source: Column, has_placeholders: Column = None) -> Column:
    """The raw answer if tags are missing and it does not just repeat the source."""
    free = ~F.contains(raw, source) & ~(has_placeholders if has_placeholders is not None else F.lit(False))
    return F.coalesce(extract_answer(raw), F.when(free, strip(raw)))


def corrected_text(raw: Column, start: str = "<CORRECTED>", end: str = "</CORRECTED>") -> Column:
    """Between the tags, null without both in order."""
    a = F.locate(start, raw)
    tail = F.substring(raw, a + len(start), F.length(raw))
    b = F.locate(end, tail)
    return F.when((a > 0) & (b > 0), strip(F.substring(tail, F.lit(1), b - 1)))


def evaluation_scores(reply: Column) -> Column:
    """Struct of four scores (1..10, 5 where missing or no number) and feedback; null without a JSON object."""
    t = F.regexp_replace(strip(reply), r"^```(?:json)?\s*|\s*```$", "")
    body = F.regexp_extract(t, r"\{[^{}]*\}", 0)
    def score(name):
        value = F.get_json_object(body, f"$.{name}").try_cast("double")
        return F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.coalesce(value, F.lit(5.0)))).alias(name)
    feedback = F.substring(F.coalesce(F.get_json_object(body, "$.feedback"), F.lit("")), 1, 500).alias("feedback")
    return F.when(body != "", F.struct(*[score(n) for n in WEIGHTS], feedback))


def weighted_score(accuracy: Column, fluency: Column, style: Column, overall: Column) -> Column:
    """X11."""
    w = WEIGHTS
    return accuracy * w["accuracy"] + fluency * w["fluency"] + style * w["style"] + overall * w["overall"]


def failed_marker(error: Column, text: Column) -> Column:
    """X39."""
    return F.concat(F.lit("[TRANSLATION_ERROR: "), error, F.lit("] "), text)


# -- predicates -------------------------------------------------------------------------------------------------------


def is_non_translatable(text: Column) -> Column:
    """F3."""
    t = strip(F.coalesce(text, F.lit("")))
    return (t == "") | F.regexp_like(t, F.lit(r"(?i)^[\d.\-–—)(\s\u00a0\u2000-\u200f\u2028\u2029IVXLCDM]+$"))


def is_short_chunk(text: Column) -> Column:
    """passed through untranslated."""
    return F.length(strip(text)) <= 1


def should_use_original(original: Column, translated: Column) -> Column:
    """F5."""
    words = F.filter(F.split(F.lower(translated), r"\s+"), lambda w: w != "")
    repeats = (F.size(words) > 10) & (F.size(F.array_distinct(words)) / F.size(words) < 0.3)
    short = F.length(translated) < F.length(original) * 0.3
    return F.coalesce(strip(F.coalesce(translated, F.lit(""))) == "", F.lit(True)) | F.coalesce(short | repeats, F.lit(False))


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"[^/\\.](\.[^./\\]*)$", 1)


def file_type(path: Column) -> Column:
    """By extension, ``unknown`` for others."""
    ext = extension(path)
    return F.when(ext.isin(*EXTENSIONS), F.substring(ext, 2, 10)).otherwise("unknown")


def file_type_or_error(path: Column) -> Column:
    """Unknown extensions fail the query."""
    kind = file_type(path)
    return F.when(kind != "unknown", kind).otherwise(F.raise_error(F.concat(F.lit("Unsupported file type: "), extension(path))))


def filename_error(name: Column) -> Column:
    """first complaint about an upload's name, null if there is none."""
    base = F.element_at(F.split(strip(F.coalesce(name, F.lit(""))), "/"), -1)
    ext = extension(base)
    return (
        F.when(strip(F.coalesce(name, F.lit(""))) == "", "Filename cannot be empty")
        .when(base == "", "Invalid filename")
        .when(~ext.isin(*EXTENSIONS), F.concat(F.lit("File type '"), ext, F.lit("' not allowed")))
        .when(F.regexp_like(base, F.lit(r'[<>:"|?*\x00-\x1f]')), "Filename contains invalid characters")
        .when(F.length(base) > 255, "Filename too long")
    )


def path_error(name: Column, longest: int = 255) -> Column:
    """F7."""
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts])
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "Filename cannot be empty")
        .when(F.startswith(name, F.lit("/")) | F.startswith(name, F.lit("\\")), "Invalid filename: absolute path not allowed")
        .when(has("/../", "\\..\\", "/..", "\\.."), "Invalid filename: directory traversal not allowed")
        .when(has("/"), "Invalid filename: path separators not allowed")
        .when(F.length(name) > longest, f"Filename too long (max {longest} characters)")
        .when(F.contains(name, F.lit(":")) & (F.length(name) > 2) & (F.substring(name, 2, 1) == ":"), "Absolute paths not allowed")
    )


def suspicious_parts(text: Column, sample: int = 8192) -> Column:
    head = F.lower(F.substring(text, 1, sample))
    return F.filter(F.array(*[F.lit(p) for p in SUSPICIOUS]), lambda p: F.contains(head, p))


def special_ratio(text: Column, sample: int = 8192) -> Column:
    """Share of characters that are neither letters, numbers nor white space."""
    head = F.substring(text, 1, sample)
    return F.length(F.regexp_replace(head, r"[\p{L}\p{N}\s]", "")) / F.length(head)


def text_content_error(text: Column) -> Column:
    """F8: complaint about a text file, null if it is valid."""
    found = suspicious_parts(text)
    return F.when(F.size(found) > 0, F.concat(F.lit("Suspicious content detected: "), F.array_join(F.slice(found, 1, 3), ", "))).when(
        F.coalesce(F.length(text), F.lit(0)) == 0, "Empty file not allowed")


def srt_content_error(text: Column, most_cues: int = 10_000) -> Column:
    """F9."""
    found = suspicious_parts(text)
    cues = F.regexp_count(text, F.lit(r"(?m)^\d+\s*$"))
    return (
        F.when(strip(F.coalesce(text, F.lit(""))) == "", "Empty SRT file")
        .when(~F.regexp_like(text, F.lit(r"\d+\s*\n\d{2}:\d{2}:\d{2},\d{3}\s*-->")), "Invalid SRT structure")
        .when(F.size(found) > 0, F.concat(F.lit("Suspicious content detected: "), F.array_join(F.slice(found, 1, 3), ", ")))
        .when(cues > most_cues, "Too many subtitles")
    )


def safe_filename(name: Column) -> Column:
    """safe characters only, cut to 80 and the extension above 100; the prefix is a digest of the name."""
    base = F.element_at(F.split(strip(name), "/"), -1)
    safe = F.regexp_replace(base, r"[^A-Za-z0-9.\-_]", "_")
    suffix = F.regexp_extract(safe, r"[^.](\.[^.]+)$", 1)
    cut = F.concat(F.substring(safe, 1, 80), F.when(F.length(suffix) > 20, F.substring(suffix, -20, 20)).otherwise(suffix))
    return F.concat(F.substring(F.sha2(name, 256), 1, 16), F.lit("_"), F.when(F.length(safe) > 100, cut).otherwise(safe))


def slug(text: Column) -> Column:
    """F20."""
    t = F.regexp_replace(F.lower(text), r"[^a-z0-9\-_]", "-")
    return F.regexp_replace(F.regexp_replace(t, r"-+", "-"), r"^-+|-+$", "")


# -- estimates --------------------------------------------------------------------------------------------------------


def lookup(key: Column, pairs: dict, default=None) -> Column:
    made = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    found = F.try_element_at(made, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def estimate_tokens(text: Column, language: Column) -> Column:
    """Characters by the language's ratio, with a margin, truncated."""
    return F.coalesce((F.length(text) / lookup(F.lower(language), CHAR_RATIOS, DEFAULT_RATIO) * MARGIN).cast("int"), F.lit(0))


def round_to_context(n: Column) -> Column:
    """X4."""
    sizes = F.array(*[F.lit(x) for x in CONTEXT_SIZES])
    return F.coalesce(F.try_element_at(F.filter(sizes, lambda x: x >= n), F.lit(1)), n)


def optimal_chunk_size(context: Column) -> Column:
    """Lines of a block in half the context."""
    budget = context * 0.5 - 2000
    return F.when(budget <= 0, 5).otherwise(F.greatest(F.lit(5), F.least(F.lit(100), (budget / 23).cast("int"))))


def adjust_context(estimated: Column, thinking: Column, context: Column) -> Column:
    """The standard size for the estimate, twice the chunk, its overhead and room for thought; never below ``context``."""
    required = estimated + 2 * 450 + 50 + F.when(thinking, 2000).otherwise(0)
    return F.greatest(context, round_to_context(required))


def usage_ratio(used: Column, limit: Column) -> Column:
    """X27."""
    return F.when(limit > 0, used / limit).otherwise(0.0)


def completion_tokens(reported: Column, thinking: Column, content: Column) -> Column:
    """At least a third of the characters."""
    third = lambda c: F.floor(F.length(F.coalesce(c, F.lit(""))) / 3)
    return F.greatest(F.coalesce(reported, F.lit(0)).cast("long"), third(thinking) + third(content))


def request_cost(cost: Column, prompt: Column, completion: Column) -> Column:
    """X40."""
    return F.coalesce(cost, prompt * 0.50 / 1e6 + completion * 1.50 / 1e6)


def log_tokens(line: Column, name: str) -> Column:
    """Number after ``name=``, null if absent."""
    return F.nullif(F.regexp_extract(line, rf"{name}=(\d+)", 1), F.lit("")).cast("long")


def delay_ms(key: Column, index: Column) -> Column:
    """10 to 49 ms, decided by a digest."""
    return F.conv(F.substring(F.sha2(F.concat(key, F.lit("-"), index.cast("string")), 256), 1, 4), 16, 10).cast("int") % 40 + 10


def hash_bucket(key: Column) -> Column:
    """X31."""
    return F.substring(F.sha2(key, 256), 1, 4)


def retry_delay(attempt: Column, strategy: Column, initial: float = 1.0, base: float = 2.0, most: float = 60.0) -> Column:
    """X32, without jitter."""
    exponential, linear = F.lit(initial) * F.pow(F.lit(base), attempt - 1), F.lit(initial) * attempt
    return F.least(F.when(strategy == "immediate", 0.0).when(strategy == "linear", linear).otherwise(exponential), F.lit(most))


def severity(error_type: Column, is_ours: Column, recoverable: Column) -> Column:
    """X33."""
    return (
        F.when(is_ours & ~recoverable, "critical").when(is_ours, "error").when(F.contains(error_type, F.lit("Warning")), "warning")
        .when(F.contains(error_type, F.lit("Critical")) | F.contains(error_type, F.lit("Fatal")), "critical").otherwise("error")
    )


def mutation_weights(tokens: Column, fitness: Column, generation: Column) -> Column:
    """Weights of correct, simplify, reformulate, radical."""
    w = lambda *x: F.array(*[F.lit(v) for v in x])
    return F.when(tokens > 300, w(0.2, 0.5, 0.2, 0.1)).when(fitness < 6.0, w(0.5, 0.1, 0.2, 0.2)).when(generation < 3, w(0.2, 0.1, 0.2, 0.5)).otherwise(w(0.3, 0.2, 0.3, 0.2))


def prompt_tokens(prompt: Column) -> Column:
    """X35."""
    return F.floor(F.length(prompt) / 4)


def specific_terms(prompt: Column) -> Column:
    """Distinct terms of the texts that the prompt names."""
    low = F.lower(prompt)
    return F.size(F.filter(F.array(*[F.lit(t) for t in TEXT_SPECIFIC_TERMS]), lambda t: F.contains(low, t)))


# -- models and voices ------------------------------------------------------------------------------------------------


def matches_model(model: Column, pattern: str) -> Column:
    """F12."""
    m, p = F.lower(model), pattern.lower()
    rest = F.substring(m, len(p) + 1, 1)
    if ":" in p:
        return F.startswith(m, F.lit(p)) & ~F.regexp_like(rest, F.lit(r"[\p{L}\p{N}\-]"))
    return F.startswith(m, F.lit(p)) & rest.isin("", ":")


def thinking_behaviour(model: Column) -> Column:
    """The list of models that cannot stop comes first."""
    hit = lambda names: reduce(lambda a, b: a | b, [matches_model(model, n) for n in names])
    return F.when(hit(ALWAYS_THINKING), "uncontrollable").when(hit(MAY_THINK), "controllable")


def probe_behaviour(default: Column, enabled: Column, disabled: Column, unsupported: Column) -> Column:
    """From what three probes show; an unsupported parameter leaves the default's probe alone."""
    return (
        F.when(unsupported, F.when(default, "uncontrollable").otherwise("standard"))
        .when(disabled, "uncontrollable").when(enabled | default, "controllable").otherwise("standard")
    )


def model_warning(model: Column) -> Column:
    """Z33."""
    low = F.lower(model)
    size = F.regexp_extract(low, r":(\d+b)", 1)
    advice = (
        F.when(F.contains(low, F.lit("qwen3")) & ~F.contains(low, F.lit("instruct")),
               F.when(size != "", F.concat(F.lit("Recommended: qwen3:"), size, F.lit("-instruct"))).otherwise("Recommended: Use a Qwen3 instruct variant"))
        .when(F.contains(low, F.lit("phi4-reasoning")), "Recommended: phi4:latest")
        .when(F.contains(low, F.lit("deepseek")) | F.contains(low, F.lit("qwq")), "Recommended: Use a non-reasoning model")
    )
    text = F.lit("⚠️ This model cannot disable thinking mode (slower, uses more tokens)")
    return F.when(thinking_behaviour(model) == "uncontrollable", F.concat(text, F.coalesce(F.concat(F.lit("\n"), advice), F.lit(""))))


def family_context(model: Column) -> Column:
    """The first family whose name occurs."""
    low, out = F.lower(model), F
    for name, size in FAMILY_CONTEXTS:
        out = out.when(F.contains(low, F.lit(name)), size)
    return out.otherwise(DEFAULT_CONTEXT)


def first_truthy(*candidates: Column) -> Column:
    """The first that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in candidates])
