"""Vowels, vowel harmony and syllables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..functions.syllables import sentence_syllables, syllables
from ..vocab import ALPHABETS, BACK_VOWELS, FRONT_VOWELS, VOWELS

SHARES = tuple(f"syllable_{k}_ratio" for k in ("1", "2", "3", "4", "5", "6plus"))
VOWEL_KEYS = ("vowel_ratio", "front_vowel_ratio", "back_vowel_ratio")
HARMONY_KEYS = ("harmony_fronting_ratio", "harmony_rounding_ratio")
SYLLABLE_KEYS = ("syllable_count", "syllable_mean", *SHARES, "sent_syllable_mean")


def vowel_measures(text: str, lang: str) -> dict[str, Column]:
    """Shares of the alphabet's letters of the text."""
    low = T.lower(F.col(text), lang)
    kept = lambda chars: F.length(F.regexp_replace(low, f"[^{chars}]", ""))
    n = kept(ALPHABETS[lang])
    return {k: T.ratio(kept(v[lang]), n, 5) for k, v in zip(VOWEL_KEYS, (VOWELS, FRONT_VOWELS, BACK_VOWELS), strict=True)}


def harmony_measures(words: str) -> dict[str, Column]:
    """Of Turkish words with two vowels or more: all front or all back; and rounding, where a rounded vowel asks for a
    close rounded or an open unrounded one and an unrounded vowel for an unrounded one. `words` are lower-cased."""
    bare = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^aeıioöuü]", "")), lambda v: F.length(v) >= 2)
    return {
        "harmony_fronting_ratio": T.ratio(A.count(bare, lambda v: v.rlike("^([eiöü]+|[aıou]+)$")), F.size(bare), 5),
        "harmony_rounding_ratio": T.ratio(A.count(bare, lambda v: ~v.rlike("[aeıi][oöuü]|[oöuü][oöıi]")), F.size(bare), 5),
    }


def with_syllables(df: DataFrame, words: str, sentence_words: str, blank: Column, lang: str, lexicon=None, fallback=None) -> DataFrame:
    """Add `_syllables` (null for units that can't be read) and the nine measures; the means leave unreadable units out."""
    df = df.withColumn("_syllables", syllables(F.col(words), lang, lexicon, fallback)).withColumn("_per_sentence", sentence_syllables(F.col(sentence_words), lang, lexicon, fallback))
    return with_syllable_measures(df, blank).drop("_per_sentence")


def with_syllable_measures(df: DataFrame, blank: Column, per_sentence: str = "_per_sentence") -> DataFrame:
    """Add the nine measures of `_syllables` and of the sentences' syllables."""
    df = df.withColumn("_read", F.filter("_syllables", lambda h: h.isNotNull()))
    read, n = F.col("_read"), F.size("_read")
    made = {
        "syllable_count": F.when(blank, T.nan()).otherwise(A.total(read)),
        "syllable_mean": F.when(n > 0, T.rounded(A.mean(read), 4)).otherwise(T.nan()),
        **{k: T.ratio(A.equal(F.transform(read, lambda h: F.least(h, F.lit(6))), i), n) for i, k in enumerate(SHARES, 1)},
        "sent_syllable_mean": F.when(F.size(per_sentence) > 0, T.rounded(A.mean(F.col(per_sentence)), 4)).otherwise(T.nan()),
    }
    return df.withColumns(made).drop("_read")
