"""Punctuation, orthography and letters: regular expressions on the raw text, inside one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..vocab import ALPHABETS, SPACE_CLASS

# The marks of each kind, runs of three dots or more being one ellipsis.
MARKS = {"comma": ",", "period": ".", "semicolon": ";", "exclamation": "!", "colon": ":", "dash": "-–—", "ellipsis": "…", "paren": "()", "quote": "\"“”«»'‘’", "question": "?"}
KEYS = (
    "char_count", "digit_ratio", "punct_count", *(f"punct_{k}_ratio" for k in MARKS), "punct_char_ratio", "punct_entropy", "consecutive_punct_ratio", "whitespace_ratio",
    "punct_variety", "uppercase_ratio", "all_caps_word_ratio",
)
ALL = "".join(MARKS.values())


def _class(marks: str) -> str:
    return "[" + "".join("\\" + c if c in ".-()[]?!" else c for c in marks) + "]"


def mark_string(text: Column) -> Column:
    """The text with each ellipsis as one character, and without apostrophes inside words: what is left are its marks."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{3,}", "…"), r"(?<=\p{L})['’](?=\p{L})", "")


def with_punctuation(df: DataFrame, text: str, words: str) -> DataFrame:
    """Add the 20 measures; `words` are the forms as written. Marks count as neighbours where nothing stands between them.

    The text is cut down to its marks once, stretches of anything else being one x: all counts are of that short string.
    """
    # An apostrophe inside a word keeps its neighbours apart, so it becomes a letter here.
    whole = F.regexp_replace(F.regexp_replace(F.col(text), r"\.{3,}", "…"), r"(?<=\p{L})['’](?=\p{L})", "x")
    df = df.withColumn("_marks", F.regexp_replace(whole, f"[^{_class(ALL)[1:-1]}]+", "x"))
    of = lambda m: (F.length("_marks") - F.length(F.translate("_marks", m, ""))).cast("double")
    near = A.total(F.filter(F.split("_marks", "x"), lambda r: F.length(r) > 1), F.length)
    spelled = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"\P{L}", "")), lambda w: w != "")
    df = df.withColumns({"_kinds": F.array(*map(of, MARKS.values())), "_near": near, "_spelled": spelled, "_chars": F.length(text).cast("double")})
    df = df.withColumn("_n", A.total(F.col("_kinds")))
    chars, n, kinds, spelled = F.col("_chars"), F.col("_n"), F.col("_kinds"), F.col("_spelled")
    some, any_text = n > 0, chars > 0
    made = {
        "char_count": T.when_or_nan(any_text, chars),
        "digit_ratio": T.ratio(F.regexp_count(text, F.lit(r"\p{Nd}")), chars),
        "punct_count": T.when_or_nan(any_text, n),
        **{f"punct_{k}_ratio": T.ratio(F.get(kinds, F.lit(i)), n) for i, k in enumerate(MARKS)},
        "punct_char_ratio": T.ratio(n, chars),
        "punct_entropy": F.when(some, T.rounded(A.entropy(F.filter(kinds, lambda c: c > 0), n), 6)).otherwise(T.nan()),
        "consecutive_punct_ratio": T.ratio(F.col("_near"), n),
        "whitespace_ratio": T.ratio(F.regexp_count(text, F.lit(f"[{SPACE_CLASS}]")), chars),
        "punct_variety": T.when_or_nan(any_text, A.count(kinds, lambda c: c > 0)),
        "uppercase_ratio": T.ratio(A.count(spelled, lambda w: w.rlike(r"^\p{Lu}")), F.size(spelled)),
        "all_caps_word_ratio": T.ratio(A.count(spelled, lambda w: w.rlike(r"^\p{Lu}{2,}$")), F.size(spelled)),
    }
    return df.withColumns(made).drop("_marks", "_kinds", "_near", "_spelled", "_chars", "_n")


def letter_keys(lang: str) -> list[str]:
    return [f"char_{c}_ratio" for c in ALPHABETS[lang]]


def with_letters(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Add each letter's share of the alphabet's letters; NaN for all without any."""
    df = df.withColumn("_letters", F.regexp_replace(T.lower(F.col(text), lang), f"[^{ALPHABETS[lang]}]", ""))
    n = F.length("_letters")
    return df.withColumns({k: T.ratio(n - F.length(F.replace("_letters", F.lit(c), F.lit(""))), n) for k, c in zip(letter_keys(lang), ALPHABETS[lang], strict=True)}).drop("_letters")
