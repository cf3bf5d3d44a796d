"""Language of a text by its frequent words (X19): profiles are grouped counts, scoring is a join with a bounded profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_for_detection, lookup

#: Names of language codes.
NAMES = {"en": "English", "zh-cn": "Chinese", "zh-tw": "Chinese", "es": "Spanish", "fr": "French", "de": "German", "ja": "Japanese", "ko": "Korean", "pt": "Portuguese", "it": "Italian", "ru": "Russian", "ar": "Arabic", "hi": "Hindi", "nl": "Dutch", "pl": "Polish", "tr": "Turkish", "sv": "Swedish", "no": "Norwegian", "da": "Danish", "fi": "Finnish", "cs": "Czech", "el": "Greek", "he": "Hebrew", "th": "Thai", "vi": "Vietnamese", "id": "Indonesian", "ms": "Malay", "uk": "Ukrainian", "ro": "Romanian", "bg": "Bulgarian", "hr": "Croatian", "sr": "Serbian", "sk": "Slovak", "sl": "Slovenian", "et": "Estonian", "lv": "Latvian", "lt": "Lithuanian"}
PROFILE_WORDS = 300


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(clean_for_detection(text)), F.lit(r"(\p{L}+)"), 1)


def profile(labelled: DataFrame, size: int = PROFILE_WORDS) -> DataFrame:
    """The ``size`` words of each language with the largest share of its words: lang, word, weight."""
    counts = labelled.where("lang IS NOT NULL").select("lang", F.explode(_words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    ranked = counts.withColumn("weight", share).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    return ranked.where(F.col("r") <= size).select("lang", "word", "weight")


def detect(rows: DataFrame, profiles: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, code, name, confidence; code is null below the threshold. A document's words are counted before they are joined,
    and the profile has at most ``PROFILE_WORDS`` words a language."""
    words = rows.select("doc_id", F.explode(_words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    scores = words.join(F.broadcast(profiles), "word").groupBy("doc_id", "lang").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    best = scores.groupBy("doc_id").agg(F.max(F.struct("s", "lang"))["lang"].alias("code"), (F.max("s") / F.sum("s")).alias("confidence"))
    out = rows.select("doc_id").join(best, "doc_id", "left")
    sure = F.col("confidence") >= threshold
    return out.select("doc_id", F.when(sure, F.col("code")).alias("code"), F.when(sure, lookup(F.col("code"), NAMES)).alias("name"), F.bround(F.coalesce("confidence", F.lit(0.0)), 2).alias("confidence"))
