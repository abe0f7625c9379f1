"""Lexical richness: 35 measures of a text's words, of which 7 need lemmas or tags and 2 a table of word frequencies."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sampled
from ..functions import text as T
from ..functions.alignment import view_column, view_measures
from ..params import DEFAULT, FeatureParams
from ..vocab import CONTENT_POS, NOUN_POS

KEYS = (
    "lemma_count", "word_count", "word_len_mean", "entropy", "yule_k", "simpson_d", "ttr", "type_count", "hapax_count", "dislegomena_count", "brunet_w", "hapax_ratio",
    "hapax_token_ratio", "mattr", "herdan_c", "mtld", "dugast_u", "guiraud_r", "cttr", "summer_s", "maas_a2", "herdan_vm", "honore_r", "heaps_beta", "sichel_s", "noun_variation",
    "verb_variation", "adj_variation", "adv_variation", "wordfreq_mean", "wordfreq_rare_ratio", "vocd_d", "hdd", "msttr", "lexical_density",
)
#: Lemmas at or below this score count as rare.
RARE_ZIPF = 3.0


def closed_forms(df: DataFrame, words: str, freqs: str, blank: Column, p: FeatureParams = DEFAULT) -> dict[str, Column]:
    """Measures that are formulas of N, V, V1, V2 and the frequencies. `words` are lower-cased."""
    n, v = F.size(words).cast("double"), F.size(freqs).cast("double")
    v1, v2 = A.count(F.col(freqs), lambda f: f == 1).cast("double"), A.count(F.col(freqs), lambda f: f == 2).cast("double")
    s2 = A.total(F.col(freqs), lambda f: f.cast("double") * f)
    ln_n, ln_v = F.ln(n), F.ln(v)

    def made(test: Column, value: Column, digits: int) -> Column:
        return F.when(test, T.rounded(value, digits)).otherwise(T.nan())

    some = n > 0
    measured = lambda x: F.when(blank, T.nan()).otherwise(x)
    return {
        "word_count": measured(n),
        "type_count": measured(v),
        "hapax_count": measured(v1),
        "dislegomena_count": measured(v2),
        "word_len_mean": made(some, A.mean(F.col(words), F.length), 4),
        "ttr": made(some, v / n, 6),
        "entropy": made(some, A.entropy(F.col(freqs), n), 6),
        "yule_k": made(some, 1e4 * (s2 - n) / (n * n), 2),
        "simpson_d": made(n > 1, (s2 - n) / (n * (n - 1)), 6),
        "brunet_w": made(v > p.brunet_w_b, F.pow(n, F.pow(v - p.brunet_w_b, F.lit(-p.brunet_w_a))), 4),
        "hapax_ratio": made(some, v1 / v, 6),
        "hapax_token_ratio": made(some, v1 / n, 6),
        "sichel_s": made(some, v2 / v, 6),
        "herdan_c": made(n > 1, ln_v / ln_n, 5),
        "dugast_u": made((n >= 2) & (n != v), ln_n * ln_n / (ln_n - ln_v), 4),
        "guiraud_r": made(some, v / F.sqrt(n), 5),
        "cttr": made(some, v / F.sqrt(2 * n), 5),
        "summer_s": made((n >= 3) & (v >= 2), F.ln(ln_v) / F.ln(ln_n), 5),
        "maas_a2": made(n >= 2, (ln_n - ln_v) / (ln_n * ln_n), 6),
        "herdan_vm": made(some, F.sqrt(F.greatest(s2 / (n * n) - 1 / v, F.lit(0.0))), 6),
        "honore_r": made(some & (v1 != v), 100 * ln_n / (1 - v1 / v), 6),
    }


def hdd(freqs: str, n: Column, size: int) -> Column:
    """Mean chance of each type to be in a sample of `size` words; one product for each distinct frequency."""

    def seen(f: Column) -> Column:
        never = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(1.0), lambda a, i: a * (n - f - i) / (n - i))
        return F.when(n - f < size, F.lit(1.0)).otherwise(1 - never)

    spectrum = F.transform(F.array_distinct(freqs), lambda f: F.struct(f.alias("f"), A.count(F.col(freqs), lambda x: x == f).alias("k")))
    return F.when(n >= size, T.rounded(A.total(spectrum, lambda x: x["k"] * seen(x["f"].cast("double"))) / size, 5)).otherwise(T.nan())


def mattr(gaps: Column, n: Column, window: int) -> Column:
    """Mean type share of all windows. A word counts in the windows that hold it but not its occurrence before; summed
    over the words, that is closed, whatever the window."""
    last = n - window + 1

    def windows(x: Column) -> Column:
        first = F.greatest(F.coalesce(x["prev"], F.lit(0)) + 1, x["p"] - window + 1, F.lit(1))
        return F.greatest(F.lit(0), F.least(x["p"], last) - first + 1)

    return F.when(n >= 2 * window, T.rounded(A.total(gaps, windows) / (last * window), 5)).otherwise(T.nan())


def with_heaps(df: DataFrame, gaps: str, n: Column, points: int) -> DataFrame:
    """Add heaps_beta, the slope of ln V on ln N over `points` prefixes. Each step is a column, so that none is worked
    out again inside a lambda."""
    df = df.withColumn("_first", F.transform(F.filter(gaps, lambda x: x["prev"].isNull()), lambda x: x["p"]))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda k: F.floor(k * n / points))
    df = df.withColumn("_xy", F.transform(cuts, lambda c: F.struct(F.ln(c.cast("double")).alias("x"), F.ln(A.count(F.col("_first"), lambda q: q <= c).cast("double")).alias("y"))))
    df = df.withColumn("_m", F.struct((A.total(F.col("_xy"), lambda t: t["x"]) / points).alias("x"), (A.total(F.col("_xy"), lambda t: t["y"]) / points).alias("y")))
    m, xy = F.col("_m"), F.col("_xy")
    slope = A.total(xy, lambda t: (t["x"] - m["x"]) * (t["y"] - m["y"])) / A.total(xy, lambda t: (t["x"] - m["x"]) * (t["x"] - m["x"]))
    return df.withColumn("heaps_beta", F.when(n >= points, T.rounded(slope, 4)).otherwise(T.nan())).drop("_first", "_xy", "_m")


def msttr(words: str, n: Column, size: int) -> Column:
    """Mean type share of the full segments of `size` words."""
    k = F.floor(n / size).cast("int")
    types = F.transform(A.span(k), lambda s: F.size(F.array_distinct(F.slice(words, (s - 1) * size + 1, size))))
    return F.when(k >= 1, T.rounded(A.total(types) / (k * size), 5)).otherwise(T.nan())


def with_lexical(df: DataFrame, words: str, blank: Column, p: FeatureParams = DEFAULT, lang: str = "tr", only: set[str] | None = None, folds: dict[str, str] | None = None) -> DataFrame:
    """Add the measures that words alone give; `only` leaves the others out. No exchange. `folds` names columns that
    hold MTLD and voc-D, unrounded, already."""
    p.check()
    want = lambda *keys: only is None or bool(only & set(keys))
    n = F.size(words)
    df = A.with_frequencies(df, words, "_freqs")
    made = closed_forms(df, words, "_freqs", blank, p)
    made["hdd"] = hdd("_freqs", n.cast("double"), p.hdd_sample_size)
    made["msttr"] = msttr(words, n, p.msttr_segment_size)
    if want("mattr", "heaps_beta"):
        df = A.with_occurrences(df, words, "_occurrences")
        df = df.withColumn("_gaps", A.gaps("_occurrences"))
        made["mattr"] = mattr(F.col("_gaps"), n, p.mattr_window)
        if want("heaps_beta"):
            df = with_heaps(df, "_gaps", n, p.heaps_points)
    if want("mtld"):
        made["mtld"] = T.rounded(F.col(folds["mtld"]) if folds else sampled.mtld_column(F.col(words), p), 4)
    if want("vocd_d"):
        made["vocd_d"] = T.rounded(F.col(folds["vocd_d"]) if folds else sampled.vocd_column(F.col(words), p), 4)
    return df.withColumns({k: v for k, v in made.items() if want(k)})


def tagged(lemmas: str, pos: str, lang: str = "tr") -> dict[str, Column]:
    """Measures of aligned arrays of lemmas and tags of the words."""
    pairs = F.arrays_zip(F.col(lemmas).alias("l"), F.col(pos).alias("p"))
    within = lambda tags: F.filter(pairs, lambda x: x["p"].isin(*tags))
    types = lambda tags: F.size(F.array_distinct(F.transform(within(tags), lambda x: x["l"])))
    content = A.count(F.col(pos), lambda t: t.isin(*CONTENT_POS))
    kept = A.count(F.col(pos), lambda t: ~t.isin("PUNCT", "SYM"))
    return {
        "lemma_count": T.when_or_nan(F.size(lemmas) > 0, F.size(F.array_distinct(lemmas))),
        "noun_variation": T.ratio(types(NOUN_POS), content, 5),
        "verb_variation": T.ratio(types(("VERB",)), A.count(F.col(pos), lambda t: t == "VERB"), 5),
        "adj_variation": T.ratio(types(("ADJ",)), content, 5),
        "adv_variation": T.ratio(types(("ADV",)), content, 5),
        "lexical_density": T.ratio(content, kept, 5),
    }


def word_frequency(df: DataFrame, key: str, lemmas: str, pos: str, table: DataFrame | None, lang: str) -> DataFrame:
    """Add wordfreq_mean and wordfreq_rare_ratio from a table (lang, lemma, zipf); NaN without one. Lemmas that the table lacks score 0.

    Distinct content lemmas of each text meet the table in one join; the table is left to the planner, which broadcasts
    it if its statistics say that it is small. Rows of df that share a key share their scores' rows too, so keys have to
    be distinct.
    """
    if table is None:
        from ..errors import warn_missing

        warn_missing("a word frequency table", "wordfreq_mean, wordfreq_rare_ratio")
        return df.withColumns({"wordfreq_mean": T.nan(), "wordfreq_rare_ratio": T.nan()})
    each = df.select(key, F.explode(F.filter(F.arrays_zip(F.col(lemmas).alias("l"), F.col(pos).alias("p")), lambda x: x["p"].isin(*CONTENT_POS))).alias("x"))
    counted = each.groupBy(key, F.col("x.l").alias("lemma")).agg(F.count("*").alias("k"))
    scores = table.where(F.col("lang") == lang).groupBy("lemma").agg(F.max("zipf").alias("zipf"))
    z = F.coalesce("zipf", F.lit(0.0))
    out = counted.join(scores, "lemma", "left").groupBy(F.col(key).alias("_key")).agg(
        T.rounded(F.sum(F.col("k") * z) / F.sum("k"), 4).alias("wordfreq_mean"), T.rounded(F.sum(F.when(z <= RARE_ZIPF, F.col("k")).otherwise(0)) / F.sum("k"), 5).alias("wordfreq_rare_ratio")
    )
    joined = df.join(out, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({c: F.coalesce(c, T.nan()) for c in ("wordfreq_mean", "wordfreq_rare_ratio")})


#: Scores that a driver gathers at most; a larger table is met by a join.
MOST_SCORES = 300_000


def word_frequency_of_views(df: DataFrame, key: str, table: DataFrame, lang: str, text: str = "text", most: int = MOST_SCORES) -> DataFrame:
    """word_frequency over the word view of df's annotation columns. A table of up to `most` lemmas is read at once and
    travels with the tasks, so that neither words nor views are shuffled; with a larger one the view's lemmas meet it in
    word_frequency's join. In neither way is a lemma left out."""
    columns = set(df.columns)
    scores = table.where((F.col("lang") == lang) & F.col("lemma").isNotNull()).groupBy("lemma").agg(F.coalesce(F.max("zipf"), F.lit(0.0)).alias("zipf"))
    found = scores.limit(most + 1).toArrow()
    if found.num_rows > most:
        d = df.withColumn("_v", view_column(lang, columns, text))
        return word_frequency(d.withColumns({"_lem": F.col("_v.lemmas"), "_pos": F.col("_v.pos")}), key, "_lem", "_pos", table, lang)
    zipf = dict(zip(found["lemma"].to_pylist(), found["zipf"].to_pylist(), strict=True))
    content = frozenset(CONTENT_POS)

    def measure(v: dict) -> tuple[float, ...]:
        counted = Counter(w for w, t in zip(v["lemmas"], v["pos"], strict=True) if t in content)
        if not counted:
            return math.nan, math.nan
        each = [(k, zipf.get(w, 0.0)) for w, k in counted.items()]
        n = counted.total()
        return sum(k * z for k, z in each) / n, sum(k for k, z in each if z <= RARE_ZIPF) / n

    d = df.withColumn("_f", view_measures(lang, columns, ("mean", "rare"), measure, text, skip=("morph_tags", "morpheme_lists", "morpheme_alternatives"), sentences=False))
    return d.withColumns({"wordfreq_mean": T.rounded(F.col("_f.mean"), 4), "wordfreq_rare_ratio": T.rounded(F.col("_f.rare"), 5)}).drop("_f")
