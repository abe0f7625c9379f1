"""The driver's queries over the tables of a folder, and the SQL that DuckDB holds them against.

The tables hold no Turkish: queries with Turkish rules apply them to all texts alike, as rules. Measures that can't be
taken are null here, and the values are rounded on both sides by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import one_pass, readings, sampled, syllables
from .functions import text as T
from .functions.alignment import view_column
from .functions.sentences import count_column, sentence_column
from .operators import frequency, kalyoncu, lexical, morphology, ngrams, phonology, pos, punctuation, readability, sentence, workflows
from .params import DEFAULT
from .plans.analyze import analyze
from .plans.registry import feature_keys
from .sources.segments import segment
from .vocab import ALPHABETS, BEZIRCI, EDGE_MARKS, SYLLABLE_VOWELS_TR, SYMBOLS, TOKEN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SMALL = 64 << 20
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The table's columns. A small table may come in a single row group, which one task would read: below SMALL bytes its
    rows are dealt out to all cores. Larger ones stay as their files and row groups split them, without a shuffle."""
    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text", *more)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return docs.repartition(spark.sparkContext.defaultParallelism) if size < SMALL else docs


def nulls(df: DataFrame, *keep: str) -> DataFrame:
    """The columns named, doubles with null for NaN."""
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.select(*(F.nanvl(c, F.lit(None)).alias(c) if c in doubles else F.col(c) for c in keep))


def worded(df: DataFrame, lang: str = "en", text: str = "text") -> DataFrame:
    """Add `_forms` and `_w`, the words as written and lower-cased."""
    df = df.withColumn("_forms", T.words(F.col(text), lang))
    return df.withColumn("_w", F.transform("_forms", lambda w: T.lower(w, lang)))


# ---- SQL building blocks

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_EDGE = _Q(EDGE_MARKS)


def _r(x: str, digits: int, test: str = "true") -> str:
    return f"CASE WHEN {test} THEN floor(({x}) * 1e{digits} + 0.5) / 1e{digits} + 0.0 END"


def words_sql(table: str = "documents", key: str = "doc_id") -> str:
    """CTEs c (chunks), w (words with places p) and t (types with frequencies f)."""
    return f"""c AS (SELECT {key}, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS chunk, generate_subscripts(regexp_extract_all(text, '[^ \\t\\r\\n]+'), 1) AS i FROM {table}),
w AS (SELECT {key}, trim(chunk, {_EDGE}) AS form, lower(trim(chunk, {_EDGE})) AS w, i, row_number() OVER (PARTITION BY {key} ORDER BY i) AS p FROM c WHERE regexp_matches(trim(chunk, {_EDGE}), '[\\p{{L}}\\p{{N}}]')),
t AS (SELECT {key}, w, count(*) AS f, min(p) AS fp FROM w GROUP BY ALL)"""


_NV = """nv AS (SELECT d.doc_id, coalesce(sum(f), 0)::DOUBLE AS n, count(w)::DOUBLE AS v, coalesce(sum((f = 1)::INT), 0)::DOUBLE AS v1, coalesce(sum((f = 2)::INT), 0)::DOUBLE AS v2,
 coalesce(sum(f * f), 0)::DOUBLE AS s2, sum(f * length(w))::DOUBLE AS chars FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id)"""


def _closed(*keys: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = A.with_frequencies(worded(documents(spark, sf_dir)), "_w", "_f")
        made = lexical.closed_forms(d, "_w", "_f", T.is_blank(F.col("text")))
        return nulls(d.withColumns({k: made[k] for k in keys}), "doc_id", *keys)

    return run


def _register(name: str, f: Query, sql: str) -> None:
    f.__name__ = name
    query(sql)(f)


_CLOSED_SQL = {
    "word_count": "n", "type_count": "v", "hapax_count": "v1", "dislegomena_count": "v2", "word_len_mean": _r("chars / n", 4, "n > 0"), "ttr": _r("v / n", 6, "n > 0"),
    "hapax_ratio": _r("v1 / v", 6, "n > 0"), "hapax_token_ratio": _r("v1 / n", 6, "n > 0"), "sichel_s": _r("v2 / v", 6, "n > 0"), "guiraud_r": _r("v / sqrt(n)", 5, "n > 0"),
    "cttr": _r("v / sqrt(2 * n)", 5, "n > 0"), "herdan_c": _r("ln(v) / ln(n)", 5, "n > 1"), "dugast_u": _r("ln(n) * ln(n) / (ln(n) - ln(v))", 4, "n >= 2 AND n <> v"),
    "summer_s": _r("ln(ln(v)) / ln(ln(n))", 5, "n >= 3 AND v >= 2"), "maas_a2": _r("(ln(n) - ln(v)) / (ln(n) * ln(n))", 6, "n >= 2"),
    "yule_k": _r("1e4 * (s2 - n) / (n * n)", 2, "n > 0"), "simpson_d": _r("(s2 - n) / (n * (n - 1))", 6, "n > 1"), "brunet_w": _r("pow(n, pow(v - 20, -0.172))", 4, "v > 20"),
    "honore_r": _r("100 * ln(n) / (1 - v1 / v)", 6, "n > 0 AND v1 <> v"), "herdan_vm": _r("sqrt(greatest(s2 / (n * n) - 1 / v, 0))", 6, "n > 0"),
}
for _name, _keys in {
    "lexical_nv": ("word_count", "type_count", "hapax_count", "dislegomena_count", "word_len_mean"),
    "lexical_ttr_family": ("ttr", "guiraud_r", "cttr", "herdan_c", "dugast_u", "summer_s", "maas_a2"),
    "lexical_hapax": ("hapax_ratio", "hapax_token_ratio", "sichel_s"),
    "lexical_concentration": ("yule_k", "simpson_d", "brunet_w", "honore_r", "herdan_vm"),
}.items():
    _register(_name, _closed(*_keys), f"WITH {words_sql()}, {_NV} SELECT doc_id, " + ", ".join(f"{_CLOSED_SQL[k]} AS {k}" for k in _keys) + " FROM nv")
_register(
    "lexical_entropy", _closed("entropy"),
    f"WITH {words_sql()}, {_NV}, e AS (SELECT doc_id, -sum((f / n) * ln(f / n)) AS e FROM t JOIN nv USING (doc_id) GROUP BY doc_id) SELECT d.doc_id, {_r('e', 6)} AS entropy FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id",
)


@query(
    f"""WITH {words_sql()}, {_NV}, g AS (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id, w ORDER BY p), 0) AS prev FROM w),
m AS (SELECT doc_id, sum(greatest(0, least(p, n - 49) - greatest(prev + 1, p - 49, 1) + 1)) / ((any_value(n) - 49) * 50) AS x FROM g JOIN nv USING (doc_id) WHERE n >= 100 GROUP BY doc_id)
SELECT d.doc_id, {_r('x', 5)} AS mattr FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id"""
)
def lexical_mattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.with_occurrences(worded(documents(spark, sf_dir)), "_w", "_o").withColumn("_g", A.gaps("_o"))
    return nulls(d.withColumn("mattr", lexical.mattr(F.col("_g"), F.size("_w"), 50)), "doc_id", "mattr")


@query(
    f"""WITH {words_sql()}, {_NV}, s AS (SELECT doc_id, (p - 1) // 100 AS seg, count(DISTINCT w) AS x, count(*) AS k FROM w GROUP BY ALL),
m AS (SELECT doc_id, sum(x)::DOUBLE / (count(*) * 100) AS x FROM s WHERE k = 100 GROUP BY doc_id) SELECT d.doc_id, {_r('x', 5)} AS msttr FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id"""
)
def lexical_msttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(worded(documents(spark, sf_dir)).withColumn("msttr", lexical.msttr("_w", F.size("_w"), 100)), "doc_id", "msttr")


@query(
    f"""WITH {words_sql()}, {_NV}, cuts AS (SELECT doc_id, floor(k * n / 20) AS cut FROM nv, (SELECT unnest(range(1, 21)) AS k) WHERE n >= 20),
xy AS (SELECT cuts.doc_id, ln(any_value(cut)) AS x, ln(count(fp)) AS y FROM cuts JOIN t ON t.doc_id = cuts.doc_id AND fp <= cut GROUP BY cuts.doc_id, cut)
SELECT d.doc_id, {_r('s', 4)} AS heaps_beta FROM documents d LEFT JOIN (SELECT doc_id, regr_slope(y, x) AS s FROM xy GROUP BY doc_id) h ON h.doc_id = d.doc_id"""
)
def lexical_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.with_occurrences(worded(documents(spark, sf_dir)), "_w", "_o").withColumn("_g", A.gaps("_o"))
    return nulls(lexical.with_heaps(d, "_g", F.size("_w"), 20), "doc_id", "heaps_beta")


@query(
    f"""WITH {words_sql()}, {_NV}, sp AS (SELECT doc_id, f, count(*) AS k FROM t GROUP BY ALL),
x AS (SELECT sp.doc_id, f, any_value(k) AS k, CASE WHEN any_value(n) - f < 42 THEN 0.0 ELSE product((n - f - i) / (n - i)) END AS never FROM sp JOIN nv USING (doc_id), (SELECT unnest(range(42)) AS i) WHERE n >= 42 GROUP BY sp.doc_id, f),
m AS (SELECT doc_id, sum(k * (1 - never)) / 42 AS h FROM x GROUP BY doc_id) SELECT d.doc_id, {_r('h', 5)} AS hdd FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id"""
)
def lexical_hdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.with_frequencies(worded(documents(spark, sf_dir)), "_w", "_f")
    return nulls(d.withColumn("hdd", lexical.hdd("_f", F.size("_w").cast("double"), 42)), "doc_id", "hdd")


def _fold_sql(steps: str, limit: float = 0.72) -> str:
    """Factors of MTLD by one fold over a list of places: f closed factors, s the open one's start, t its types, r its share."""
    share = "((st.t + (el.q < st.s)::INT)::DOUBLE / (el.p - st.s + 1))"
    hit = f"{share} <= {limit}"
    step = f"{{'f': st.f + ({hit})::INT, 's': CASE WHEN {hit} THEN el.p + 1 ELSE st.s END, 't': CASE WHEN {hit} THEN 0 ELSE st.t + (el.q < st.s)::INT END, 'p': el.p, 'q': el.q, 'r': CASE WHEN {hit} THEN 1.0 ELSE {share} END}}"
    return f"list_reduce({steps}, lambda st, el: {step})"


_STEP = "{{'f': 0::INT, 's': 1::BIGINT, 't': 1::INT, 'p': ({p})::BIGINT, 'q': ({q})::BIGINT, 'r': 1.0::DOUBLE}}"


@query(
    f"""WITH {words_sql()}, {_NV}, g AS (SELECT doc_id, n, p, lag(p) OVER v AS prev, lead(p) OVER v AS next FROM w JOIN nv USING (doc_id) WHERE n >= 100 WINDOW v AS (PARTITION BY doc_id, w ORDER BY p)),
l AS (SELECT doc_id, any_value(n) AS n, list({_STEP.format(p='p', q='coalesce(prev, 0)')} ORDER BY p) AS a, list({_STEP.format(p='n + 1 - p', q='coalesce(n + 1 - next, 0)')} ORDER BY p DESC) AS b FROM g GROUP BY doc_id),
r AS (SELECT doc_id, n, {_fold_sql('a')} AS a, {_fold_sql('b')} AS b FROM l), f AS (SELECT doc_id, n, a.f + (1 - a.r) / (1 - 0.72::DOUBLE) AS a, b.f + (1 - b.r) / (1 - 0.72::DOUBLE) AS b FROM r)
SELECT d.doc_id, {_r('(n / a + n / b) / 2', 4, 'a > 0 AND b > 0')} AS mtld FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id"""
)
def lexical_mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(worded(documents(spark, sf_dir)).withColumn("mtld", T.rounded(sampled.mtld_column(F.col("_w"), DEFAULT), 4)), "doc_id", "mtld")


@query()
def lexical_vocd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(documents(spark, sf_dir).withColumn("vocd_d", T.rounded(sampled.vocd_of_texts(F.col("text"), "en", DEFAULT), 4)), "doc_id", "vocd_d")


_RANKS = "rk AS (SELECT doc_id, f::DOUBLE AS f, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, fp) AS r FROM t)"


@query(
    f"""WITH {words_sql()}, {_RANKS}, z AS (SELECT doc_id, count(*) AS v, abs(regr_slope(ln(f), ln(r))) AS s, regr_syy(ln(f), ln(r)) AS yy, regr_sxy(ln(f), ln(r)) AS xy, regr_sxx(ln(f), ln(r)) AS xx FROM rk GROUP BY doc_id)
SELECT d.doc_id, {_r('s', 4, 'v >= 10')} AS zipf_exponent, {_r('xy * xy / (xx * yy)', 4, 'v >= 10 AND yy > 1e-12')} AS zipf_r2 FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id"""
)
def zipf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.with_frequencies(worded(documents(spark, sf_dir)), "_w", "_f")
    return nulls(frequency.with_zipf(d, "_f", "_w", set()), "doc_id", "zipf_exponent", "zipf_r2")


@query(
    f"""WITH {words_sql()}, {_RANKS}, q AS (SELECT unnest(range(0, 101)) / 10.0::DOUBLE AS q),
z AS (SELECT doc_id, q, count(*) AS v, regr_syy(ln(f), ln(r + q)) - regr_sxy(ln(f), ln(r + q)) * regr_sxy(ln(f), ln(r + q)) / regr_sxx(ln(f), ln(r + q)) AS e, abs(regr_slope(ln(f), ln(r + q))) AS s FROM rk, q GROUP BY doc_id, q),
b AS (SELECT doc_id, arg_min(q, (round(e, 9), q)) AS q, arg_min(s, (round(e, 9), q)) AS s FROM z WHERE v >= 10 GROUP BY doc_id)
SELECT d.doc_id, {_r('q', 4)} AS zipf_mandelbrot_q, {_r('s', 4)} AS zipf_mandelbrot_s FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id"""
)
def zipf_mandelbrot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.with_frequencies(worded(documents(spark, sf_dir)), "_w", "_f")
    return nulls(frequency.with_zipf(d, "_f", "_w"), "doc_id", "zipf_mandelbrot_q", "zipf_mandelbrot_s")


_CURVE = f"""x AS (SELECT doc_id, f, r, lag(f) OVER (PARTITION BY doc_id ORDER BY r) AS prev, lead(f) OVER (PARTITION BY doc_id ORDER BY r) AS next FROM rk),
hp AS (SELECT doc_id, min(r) FILTER (WHERE f <= r) AS r0, count(*)::DOUBLE AS v, sum(f) AS n, max(f) AS f1, sum(r * f) AS rf, sum(sqrt((f - next) * (f - next) + 1)) AS len FROM x GROUP BY doc_id),
h AS (SELECT hp.*, CASE WHEN r0 IS NULL THEN v WHEN x.f = r0 THEN r0 ELSE floor((prev * r0 - x.f * (r0 - 1)) / (1 + prev - x.f) * 1e6 + 0.5) / 1e6 END::DOUBLE AS h FROM hp LEFT JOIN x ON x.doc_id = hp.doc_id AND x.r = hp.r0),
p AS (SELECT h.doc_id, sum(f) FILTER (WHERE r <= floor(h)) AS fh, sum(sqrt((f - next) * (f - next) + 1)) FILTER (WHERE r <= least(ceil(h), v - 1)) AS lh, sum((f / n) * (f / n)) AS rr FROM h JOIN x USING (doc_id) GROUP BY h.doc_id),
k AS (SELECT h.*, fh, lh, floor(rr * 1e6 + 0.5) / 1e6 AS rr, floor(((v + 1 - 2 * rf / n) / v) * 1e6 + 0.5) / 1e6 AS gini, floor(coalesce(len, 0) * 1e4 + 0.5) / 1e4 AS l4 FROM h JOIN p USING (doc_id))"""


@query(
    f"""WITH {words_sql()}, {_RANKS}, {_CURVE}
SELECT d.doc_id, h AS h_point, {_r('1 - (fh / n - h * h / (2 * n))', 6)} AS vocab_richness_r1, {_r('1 - gini', 6)} AS vocab_richness_r4, rr AS repeat_rate,
 {_r('(1 - sqrt(rr)) / (1 - 1 / sqrt(v))', 6, 'v > 1')} AS rr_mcintosh, gini AS gini_coef FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id"""
)
def h_point_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frequency.with_curve(A.with_frequencies(worded(documents(spark, sf_dir)), "_w", "_f"), "_f")
    return nulls(d, "doc_id", "h_point", "vocab_richness_r1", "vocab_richness_r4", "repeat_rate", "rr_mcintosh", "gini_coef")


@query(
    f"""WITH {words_sql()}, {_RANKS}, {_CURVE}
SELECT d.doc_id, l4 AS curve_length, {_r('1 - lh / len', 6, 'v >= 2')} AS curve_length_r, {_r('l4 * ln(n) / n', 4)} AS lambda_pa, {_r('sqrt(f1 * f1 + v * v) / h / ln(n)', 4, 'n > 1')} AS adjusted_modulus,
 {_r('acos(greatest(-1, least(1, ((1 - h) * (v - h) + (f1 - h) * (1 - h)) / (sqrt((1 - h) * (1 - h) + (f1 - h) * (f1 - h)) * sqrt((v - h) * (v - h) + (1 - h) * (1 - h))))))', 4, 'sqrt((1 - h) * (1 - h) + (f1 - h) * (f1 - h)) * sqrt((v - h) * (v - h) + (1 - h) * (1 - h)) <> 0')} AS writers_view_alpha
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id"""
)
def curve_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frequency.with_curve(A.with_frequencies(worded(documents(spark, sf_dir)), "_w", "_f"), "_f")
    return nulls(d, "doc_id", "curve_length", "curve_length_r", "lambda_pa", "adjusted_modulus", "writers_view_alpha")


# ---- punctuation and letters

_MARKED = "m AS (SELECT doc_id, text, regexp_replace(text, '\\.{3,}', '…', 'g') AS s, length(text)::DOUBLE AS chars FROM documents)"


def _marks_sql(marks: str) -> str:
    inside = "".join("\\" + c if c in ".-()[]?!" else c for c in marks).replace("'", "''")
    return f"length(s) - length(regexp_replace(s, '[{inside}]', '', 'g'))"


_KINDS = "k AS (SELECT doc_id, text, s, chars, " + ", ".join(f"({_marks_sql(m)})::DOUBLE AS {k}" for k, m in punctuation.MARKS.items()) + " FROM m)"
_N = " + ".join(punctuation.MARKS)


def _punctuated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return punctuation.with_punctuation(worded(documents(spark, sf_dir)), "text", "_forms")


@query(f"WITH {_MARKED}, {_KINDS}, n AS (SELECT *, {_N} AS n FROM k) SELECT doc_id, chars AS char_count, n AS punct_count, " + ", ".join(f"{_r(f'{k} / n', 6, 'n > 0')} AS punct_{k}_ratio" for k in punctuation.MARKS) + " FROM n")
def punct_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(_punctuated(spark, sf_dir), "doc_id", "char_count", "punct_count", *(f"punct_{k}_ratio" for k in punctuation.MARKS))


_TERMS = " + ".join(f"CASE WHEN {k} > 0 THEN ({k} / n) * ln({k} / n) ELSE 0 END" for k in punctuation.MARKS)
_ALL_MARKS = "".join("\\" + c if c in ".-()[]?!" else c for c in punctuation.ALL).replace("'", "''")


@query(
    f"""WITH {_MARKED}, {_KINDS}, n AS (SELECT *, {_N} AS n, {' + '.join(f'({k} > 0)::INT' for k in punctuation.MARKS)} AS kinds,
 list_sum(list_transform(regexp_extract_all(s, '[{_ALL_MARKS}]{{2,}}'), lambda x: length(x))) AS near FROM k)
SELECT doc_id, {_r('n / chars', 6, 'chars > 0')} AS punct_char_ratio, {_r(f'0.0 - ({_TERMS})', 6, 'n > 0')} AS punct_entropy, {_r('coalesce(near, 0) / n', 6, 'n > 0')} AS consecutive_punct_ratio,
 {_r("(length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / chars", 6, 'chars > 0')} AS digit_ratio, {_r("(length(text) - length(regexp_replace(text, '[ \\n\\t\\r]', '', 'g'))) / chars", 6, 'chars > 0')} AS whitespace_ratio,
 kinds::DOUBLE AS punct_variety FROM n"""
)
def punct_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(_punctuated(spark, sf_dir), "doc_id", "punct_char_ratio", "punct_entropy", "consecutive_punct_ratio", "digit_ratio", "whitespace_ratio", "punct_variety")


@query(
    f"""WITH {words_sql()}, l AS (SELECT doc_id, regexp_replace(form, '\\P{{L}}', '', 'g') AS x FROM w), n AS (SELECT doc_id, count(*)::DOUBLE AS n, sum(regexp_matches(x, '^\\p{{Lu}}')::INT)::DOUBLE AS u, sum(regexp_matches(x, '^\\p{{Lu}}{{2,}}$')::INT)::DOUBLE AS c FROM l WHERE x <> '' GROUP BY doc_id)
SELECT d.doc_id, {_r('u / n', 6)} AS uppercase_ratio, {_r('c / n', 6)} AS all_caps_word_ratio FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def orthography_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(_punctuated(spark, sf_dir), "doc_id", "uppercase_ratio", "all_caps_word_ratio")


def _letters(lang: str) -> tuple[Query, str]:
    low = "lower(translate(text, 'Iİ', 'ıi'))" if lang == "tr" else "lower(text)"
    keys = punctuation.letter_keys(lang)
    shares = ", ".join(f"{_r(f'(length(s) - length(replace(s, {_Q(c)}, {_Q("")})))::DOUBLE / length(s)', 6, 'length(s) > 0')} AS {k}" for k, c in zip(keys, ALPHABETS[lang], strict=True))
    sql = f"WITH l AS (SELECT doc_id, regexp_replace({low}, '[^{ALPHABETS[lang]}]', '', 'g') AS s FROM documents) SELECT doc_id, {shares} FROM l"
    return (lambda spark, sf_dir: nulls(punctuation.with_letters(documents(spark, sf_dir), "text", lang), "doc_id", *keys)), sql


for _lang in ("en", "tr"):
    _register(f"char_letter_shares_{_lang}", *_letters(_lang))


# ---- sounds


def _vowels(lang: str) -> tuple[Query, str]:
    from .vocab import BACK_VOWELS, FRONT_VOWELS, VOWELS

    low = "lower(translate(text, 'Iİ', 'ıi'))" if lang == "tr" else "lower(text)"
    part = lambda v: f"length(regexp_replace(s, '[^{v}]', '', 'g'))::DOUBLE / length(s)"
    shares = ", ".join(f"{_r(part(v[lang]), 5, 'length(s) > 0')} AS {k}" for k, v in zip(phonology.VOWEL_KEYS, (VOWELS, FRONT_VOWELS, BACK_VOWELS), strict=True))
    sql = f"WITH l AS (SELECT doc_id, regexp_replace({low}, '[^{ALPHABETS[lang]}]', '', 'g') AS s FROM documents) SELECT doc_id, {shares} FROM l"
    return (lambda spark, sf_dir: nulls(documents(spark, sf_dir).withColumns(phonology.vowel_measures("text", lang)), "doc_id", *phonology.VOWEL_KEYS)), sql


for _lang in ("en", "tr"):
    _register(f"vowel_shares_{_lang}", *_vowels(_lang))


@query(
    f"""WITH {words_sql()}, b AS (SELECT doc_id, regexp_replace(lower(translate(form, 'Iİ', 'ıi')), '[^aeıioöuü]', '', 'g') AS v FROM w),
n AS (SELECT doc_id, count(*)::DOUBLE AS n, sum(regexp_matches(v, '^([eiöü]+|[aıou]+)$')::INT)::DOUBLE AS f, sum((NOT regexp_matches(v, '[aeıi][oöuü]|[oöuü][oöıi]'))::INT)::DOUBLE AS r FROM b WHERE length(v) >= 2 GROUP BY doc_id)
SELECT d.doc_id, {_r('f / n', 5)} AS harmony_fronting_ratio, {_r('r / n', 5)} AS harmony_rounding_ratio FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def vowel_harmony_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("_w", F.transform(T.words(F.col("text"), "tr"), lambda w: T.lower(w, "tr")))
    return nulls(d.withColumns(phonology.harmony_measures("_w")), "doc_id", *phonology.HARMONY_KEYS)


# how a Turkish unit is read, in SQL: the tables are those of functions.readings

_LOW_TR = "lower(translate({}, 'Iİ', 'ıi'))"
_APOSTROPHES = "[''’]"


def _vowels_sql(x: str) -> str:
    return f"length(regexp_replace({_LOW_TR.format(x)}, '[^{SYLLABLE_VOWELS_TR}]', '', 'g'))"


def _said(words: str) -> int:
    return sum(map(syllables.vowels_tr, words.split()))


_ONES = [0, *(_said(w) for w in readings.TR_ONES[1:])]
_TENS = [0, *(_said(w) for w in readings.TR_TENS)]
_HUNDREDS = [0, 1, *(k + 1 for k in _ONES[2:])]


def _digits_sql(d: str) -> str:
    """Syllables of a string of digits, null from 10**15 on; with a leading zero digit by digit."""
    single = " + ".join(f"{_said(w)} * (length({d}) - length(replace({d}, '{i}', '')))" for i, w in enumerate(readings.TR_ONES))
    at = lambda j, k: f"substr(lpad({d}, 15, '0'), {3 * j + k}, 1)::INT + 1"
    under = lambda j: f"{_HUNDREDS}[{at(j, 1)}] + {_TENS}[{at(j, 2)}] + {_ONES}[{at(j, 3)}]"
    group = lambda j: f"substr(lpad({d}, 15, '0'), {3 * j + 1}, 3)"
    named = " + ".join(f"CASE WHEN {group(j)} = '000' THEN 0 ELSE {under(j)} + {_said(name)} END" for j, name in enumerate(("trilyon", "milyar", "milyon")))
    thousands = f"CASE {group(3)} WHEN '000' THEN 0 WHEN '001' THEN 1 ELSE {under(3)} + 1 END"
    return f"(CASE WHEN starts_with({d}, '0') THEN {single} WHEN length({d}) <= 15 THEN {named} + {thousands} + {under(4)} END)"


def _token_sql(x: str) -> str:
    """Syllables of a token, null if it can't be read."""
    bare = f"replace({x}, '.', '')"
    exact = " ".join(f"WHEN {_Q(k)} THEN {_said(v)}" for k, v in readings.TR_EXACT.items())
    listed = " ".join(f"WHEN {_Q(k)} THEN {_said(v)}" for k, v in readings.TR_ABBREVIATIONS.items())
    abbreviation = f"coalesce(CASE {bare} {exact} END, CASE {_LOW_TR.format(bare)} {listed} END)"
    letters = lambda y: f"CASE WHEN regexp_full_match({y}, '\\p{{L}}+') THEN CASE WHEN {_vowels_sql(y)} > 0 THEN {_vowels_sql(y)} WHEN regexp_full_match({y}, '\\p{{Lu}}+') THEN length({y}) END END"
    whole, part = f"replace(split_part({x}, ',', 1), '.', '')", f"split_part({x}, ',', 2)"
    number = f"CASE WHEN regexp_full_match({x}, '([0-9]{{1,3}}(\\.[0-9]{{3}})+|[0-9]+)(,[0-9]+)?') THEN {_digits_sql(whole)} + CASE WHEN {part} = '' THEN 0 ELSE {_said('virgül')} + {_digits_sql(part)} END END"
    first, second = (f"regexp_extract({x}, '([0-9]+)[:.]([0-9]+)', {k})" for k in (1, 2))
    clock = f"length({second}) = 2 AND TRY_CAST({first} AS HUGEINT) <= 24 AND {second} < '60' AND (contains({x}, ':') OR length({first}) <= 2)"
    hour = f"TRY_CAST({first} AS HUGEINT)::VARCHAR"
    time = f"CASE WHEN regexp_full_match({x}, '[0-9]+[:.][0-9]+') THEN CASE WHEN {clock} THEN {_digits_sql(hour)} + CASE WHEN {second} = '00' THEN 0 ELSE {_digits_sql(second)} END WHEN contains({x}, ':') THEN {_digits_sql(first)} + {_digits_sql(second)} END END"
    rank = f"TRY_CAST({bare} AS HUGEINT)::VARCHAR"
    ending = f"CASE WHEN regexp_matches({rank}, '([267]|[25]0)$') THEN 1 ELSE 2 END"  # behind iki, altı, yedi, yirmi and elli the suffix is one syllable
    ordinal = f"CASE WHEN regexp_full_match({x}, '[0-9]+\\.') AND length({rank}) <= 15 THEN {_digits_sql(rank)} + {ending} END"
    amount, unit = (f"regexp_extract({x}, '^([0-9]+(?:,[0-9]+)?)(\\p{{L}}+)$', {k})" for k in (1, 2))
    units = " ".join(f"WHEN {_Q(k)} THEN {_said(v)}" for k, v in readings.TR_UNITS_BEHIND_NUMBERS.items())
    unit_listed = f"coalesce(CASE {unit} {units} END, CASE {unit} {exact} END, CASE {_LOW_TR.format(unit)} {listed} END, {letters(unit)})"
    whole2, part2 = f"split_part({amount}, ',', 1)", f"split_part({amount}, ',', 2)"
    glued = f"CASE WHEN {amount} <> '' THEN {_digits_sql(whole2)} + CASE WHEN {part2} = '' THEN 0 ELSE {_said('virgül')} + {_digits_sql(part2)} END + {unit_listed} END"
    return f"coalesce({abbreviation}, {number}, {time}, {ordinal}, {glued}, {letters(x)})"


_SYMBOL_SYLLABLES = " + ".join(f"{_said(v)} * (length(edge) - length(replace(edge, {_Q(k)}, '')))" for k, v in readings.TR_SYMBOLS.items())
_INITIALS = "CASE WHEN regexp_full_match({0}, '(\\p{{L}}\\.)+\\p{{L}}?') THEN length(regexp_replace({0}, '\\P{{L}}', '', 'g')) END"


def units_tr_sql(table: str = "documents", key: str = "doc_id") -> str:
    """CTEs ending in hs (key, form, is_word, letters, h): every Turkish unit of a text with its syllables, null if unreadable."""
    alnum = "'[\\p{L}\\p{N}]'"
    return f"""uc AS (SELECT {key}, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS chunk, generate_subscripts(regexp_extract_all(text, '[^ \\t\\r\\n]+'), 1) AS i FROM {table}),
ut AS (SELECT {key}, i, chunk, trim(chunk, {_EDGE}) AS u, lead(chunk) OVER (PARTITION BY {key} ORDER BY i) AS nx FROM uc),
ua AS (SELECT *, substr(chunk, instr(chunk, u) + length(u)) AS af FROM ut WHERE u <> ''),
uf AS (SELECT {key}, i, CASE WHEN regexp_full_match(u, '[0-9]+') AND (starts_with(af, '.,') OR (af = '.' AND coalesce(regexp_matches(nx, {alnum}), false))) THEN u || '.' ELSE u END AS form, regexp_matches(u, {alnum}) AS is_word FROM ua
 WHERE regexp_matches(u, {alnum}) OR regexp_full_match(u, '[{SYMBOLS}]+')),
us AS (SELECT *, trim(form, {_Q(SYMBOLS)}) AS core, regexp_replace(form, '\\P{{L}}', '', 'g') AS letters, regexp_extract(form, '^([^''’]+){_APOSTROPHES}', 1) AS stem FROM uf),
ue AS (SELECT *, substr(form, 1, length(form) - length(ltrim(form, {_Q(SYMBOLS)}))) || CASE WHEN core = '' THEN '' ELSE substr(form, length(rtrim(form, {_Q(SYMBOLS)})) + 1) END AS edge, substr(form, length(stem) + 2) AS suffix FROM us),
tl AS (SELECT DISTINCT tok FROM (SELECT unnest([form, stem, core]) AS tok FROM ue UNION ALL SELECT unnest(string_split(core, '-')) FROM ue WHERE contains(core, '-'))),
th AS (SELECT tok, {_token_sql('tok')} AS h FROM tl),
u1 AS (SELECT ue.*, coalesce(a.h, CASE WHEN stem <> '' AND regexp_full_match(suffix, '(\\p{{L}}|{_APOSTROPHES})*') THEN b.h + {_vowels_sql('suffix')} END) AS h0, c.h AS h1 FROM ue LEFT JOIN th a ON a.tok = form LEFT JOIN th b ON b.tok = stem LEFT JOIN th c ON c.tok = core),
hp AS (SELECT {key}, i, CASE WHEN count(h) = count(*) THEN sum(h) END AS h2 FROM (SELECT {key}, i, unnest(string_split(core, '-')) AS part FROM u1 WHERE h0 IS NULL AND contains(core, '-')) LEFT JOIN th ON tok = part GROUP BY ALL),
hs AS (SELECT u1.{key}, form, is_word, letters, coalesce(h0, CASE WHEN core = '' THEN {_SYMBOL_SYLLABLES} ELSE {_SYMBOL_SYLLABLES} + coalesce(h1, CASE WHEN contains(core, '-') THEN h2 ELSE {_INITIALS.format('core')} END) END) AS h
 FROM u1 LEFT JOIN hp ON hp.{key} = u1.{key} AND hp.i = u1.i)"""


@query(
    f"""WITH {units_tr_sql()}, n AS (SELECT doc_id, count(h)::DOUBLE AS n, sum(h)::DOUBLE AS s, {', '.join(f'sum((h IS NOT NULL AND least(h, 6) = {i})::INT)::DOUBLE AS k{i}' for i in range(1, 7))} FROM hs WHERE is_word GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN regexp_matches(text, '[^ \\t\\r\\n]') THEN coalesce(s, 0.0) END AS syllable_count, {_r('s / n', 4, 'n > 0')} AS syllable_mean, """
    + ", ".join(f"{_r(f'k{i} / n', 6, 'n > 0')} AS {k}" for i, k in enumerate(phonology.SHARES, 1)) + " FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"
)
def syllable_distribution_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word unit of the texts under the Turkish rules: words, numbers, ordinals, times, abbreviations, suffixes."""
    d = documents(spark, sf_dir).withColumn("_w", T.words(F.col("text"), "tr")).withColumn("_s", F.array("_w"))
    d = phonology.with_syllables(d, "_w", "_s", T.is_blank(F.col("text")), "tr")
    return nulls(d, "doc_id", "syllable_count", "syllable_mean", *phonology.SHARES)


# ---- sentences

_CAP = "regexp_matches(nx, '^\\p{Lu}')"
_TOK = TOKEN.replace("'", "''")


def _abbreviated_sql(word: str) -> str:
    bare = f"replace({word}, '.', '')"
    return f"({bare} IN ({', '.join(map(_Q, readings.TR_EXACT))}) OR {_LOW_TR.format(bare)} IN ({', '.join(map(_Q, readings.TR_ABBREVIATIONS))}))"


def sentences_sql(table: str = "documents", key: str = "doc_id", kind: str = "default", lang: str = "en") -> str:
    """CTEs tk (tokens), b (with real ends), s (with sentence numbers), following the rule as windows over tokens."""
    ends, maybe = {"default": (".?!…", True), "kincaid": (".?!;…", True), "cetinkaya": (".?!:()…", False)}[kind]
    inside = "".join("\\" + c if c in ".?!()" else c for c in ends)
    opener = "regexp_matches(nx, '^[\"''“”‘’«»‹›—–\\-(\\[]')"
    cond = f"(contains(tok, ':') AND (nx IS NULL OR {opener} OR ({_CAP} AND regexp_matches(nx, '[\\p{{L}}\\p{{N}}]'))))" if maybe else "false"
    near = ""
    sure = "true"
    if lang == "tr":  # behind an abbreviation a dot ends a sentence only before a capital or nothing
        word = "CASE WHEN regexp_matches(tok, '[\\p{L}\\p{N}]') THEN tok END IGNORE NULLS"
        near = f", last_value({word}) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pw, first_value({word}) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nw"
        sure = f"NOT (tok = '.' AND pw IS NOT NULL AND nw IS NOT NULL AND {_abbreviated_sql('pw')} AND NOT regexp_matches(nw, '^\\p{{Lu}}'))"
    return f"""a0 AS (SELECT {key}, unnest(regexp_extract_all(text, '{_TOK}')) AS tok, generate_subscripts(regexp_extract_all(text, '{_TOK}'), 1) AS i FROM {table}),
a1 AS (SELECT *, regexp_matches(tok, '[\\p{{L}}\\p{{N}}]') AS al, lead(tok) OVER (PARTITION BY {key} ORDER BY i) AS nx{near} FROM a0),
a2 AS (SELECT *, NOT al AND ((regexp_matches(tok, '[{inside}]') AND {sure}) OR {cond}) AS pot, regexp_matches(tok, '^[“‘«‹(\\[—–\\-]') AS op, sum(al::INT) OVER (PARTITION BY {key} ORDER BY i) AS c FROM a1),
a3 AS (SELECT {key}, i, c > coalesce(lag(c) OVER (PARTITION BY {key} ORDER BY i), 0) AS real FROM a2 WHERE pot),
b AS (SELECT a2.*, coalesce(real, false) AS fin FROM a2 LEFT JOIN a3 USING ({key}, i)),
s0 AS (SELECT *, max(CASE WHEN fin THEN i END) OVER w AS lb, max(CASE WHEN al OR op THEN i END) OVER w AS ls, max(CASE WHEN al THEN i END) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS more FROM b
 WINDOW w AS (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, sum(((al OR op) AND lb IS NOT NULL AND (ls IS NULL OR ls < lb OR ls = lb) AND more IS NOT NULL)::INT) OVER (PARTITION BY {key} ORDER BY i) AS sid FROM s0)"""


def _count_sql(kind: str) -> str:
    return "SELECT doc_id, sum(fin::INT) + (max(CASE WHEN al THEN i END) > coalesce(max(CASE WHEN fin THEN i END), 0))::INT AS n FROM b GROUP BY doc_id"


@query(
    "SELECT d.doc_id, " + ", ".join(f"coalesce({k}.n, 0)::BIGINT AS {k}" for k in ("default_", "kincaid", "cetinkaya")) + " FROM documents d "
    + " ".join(f"LEFT JOIN (WITH {sentences_sql(kind=k.strip('_'))} {_count_sql(k)}) {k} ON {k}.doc_id = d.doc_id" for k in ("default_", "kincaid", "cetinkaya"))
)
def sentence_count_rulesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents(spark, sf_dir).withColumn("s", sentence_column(F.col("text"), None, "en"))
    return s.select("doc_id", *(F.col(f"s.n_{k.strip('_')}").cast("long").alias(k) for k in ("default_", "kincaid", "cetinkaya")))


def sentence_words_sql(table: str = "documents", key: str = "doc_id") -> str:
    """CTEs ending in lens (key, sid, len): words of each default sentence with a letter."""
    return f"""{sentences_sql(table, key)},
ch AS (SELECT {key}, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS chunk, generate_subscripts(regexp_extract_all(text, '[^ \\t\\r\\n]+'), 1) AS ci FROM {table}),
ct AS (SELECT {key}, ci, unnest(regexp_extract_all(chunk, '{_TOK}')) AS tok, generate_subscripts(regexp_extract_all(chunk, '{_TOK}'), 1) AS j FROM ch),
cn AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ci, j) AS i FROM ct),
pc AS (SELECT cn.{key}, ci, sid, trim(string_agg(cn.tok, '' ORDER BY i), {_EDGE}) AS piece FROM cn JOIN s USING ({key}, i) GROUP BY cn.{key}, ci, sid),
lens AS (SELECT {key}, sid, count(*) AS len FROM pc WHERE regexp_matches(piece, '[\\p{{L}}\\p{{N}}]') GROUP BY {key}, sid HAVING bool_or(regexp_matches(piece, '\\p{{L}}')))"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sentence.with_sentences(documents(spark, sf_dir), "text", None, "en")
    return d.withColumns(sentence.sentence_measures("en"))


@query(
    f"""WITH {sentence_words_sql()}, n AS (SELECT doc_id, avg(len) AS m, median(len) AS md, count(*)::DOUBLE AS n, avg((len < 8)::INT) AS sh, avg((len > 32)::INT) AS lo FROM lens GROUP BY doc_id)
SELECT d.doc_id, {_r('m', 4)} AS sent_len_mean, {_r('md', 4)} AS sent_len_median, n AS sent_count, {_r('sh', 6)} AS short_sent_ratio, {_r('lo', 6)} AS long_sent_ratio FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(_sentences(spark, sf_dir), "doc_id", "sent_len_mean", "sent_len_median", "sent_count", "short_sent_ratio", "long_sent_ratio")


@query(
    f"""WITH {sentence_words_sql()}, k AS (SELECT doc_id, len, count(*)::DOUBLE AS k FROM lens GROUP BY ALL), n AS (SELECT doc_id, sum(k) AS n FROM k GROUP BY doc_id),
e AS (SELECT doc_id, any_value(n) AS n, -sum((k / n) * ln(k / n)) AS e FROM k JOIN n USING (doc_id) GROUP BY doc_id),
q AS (SELECT doc_id, sid, sum(length(tok)) + count(*) - 1 AS chars, arg_max(rtrim(tok, '"''“”‘’«»‹›)]}}'), i) FILTER (WHERE rtrim(tok, '"''“”‘’«»‹›)]}}') <> '') AS fin FROM s GROUP BY ALL),
t AS (SELECT doc_id, avg(chars) AS c, avg((coalesce(regexp_matches(fin, '\\?[^\\p{{L}}\\p{{N}}]*$'), false))::INT) AS a FROM q GROUP BY doc_id)
SELECT d.doc_id, {_r('e + 0.0', 5, 'n >= 2')} AS sent_len_entropy, {_r('c', 4)} AS sent_len_char_mean, {_r('a', 5)} AS question_sent_ratio FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
)
def sentence_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(_sentences(spark, sf_dir), "doc_id", "sent_len_entropy", "sent_len_char_mean", "question_sent_ratio")


_TALK = "talk AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


@query(
    f"""WITH {_TALK}, pg AS (SELECT conv_id, unnest(string_split_regex(text, '\\n[ \\t]*\\n')) AS text, generate_subscripts(string_split_regex(text, '\\n[ \\t]*\\n'), 1) AS k FROM talk),
pk AS (SELECT conv_id, k, len(list_filter(regexp_extract_all(text, '[^ \\t\\r\\n]+'), lambda x: regexp_matches(trim(x, {_EDGE}), '[\\p{{L}}\\p{{N}}]'))) AS n FROM pg WHERE regexp_matches(text, '[^ \\t\\r\\n]')),
pn AS (SELECT conv_id, count(*)::DOUBLE AS p, avg(n) AS m FROM pk GROUP BY conv_id), {sentence_words_sql('talk', 'conv_id')}, sn AS (SELECT conv_id, count(*)::DOUBLE AS s FROM lens GROUP BY conv_id)
SELECT talk.conv_id, p AS para_count, {_r('m', 4)} AS para_len_mean, {_r('s / p', 4)} AS sents_per_para_mean FROM talk LEFT JOIN pn ON pn.conv_id = talk.conv_id LEFT JOIN sn ON sn.conv_id = talk.conv_id"""
)
def paragraph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of conversations, each turn being one or more."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    d = turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
    d = sentence.with_sentences(d, "text", None, "en").withColumns(sentence.paragraph_measures("text", "en"))
    return nulls(d, "conv_id", *sentence.PARAGRAPH_KEYS)


# ---- readability


@query(
    f"""WITH {words_sql()}, {sentences_sql()}, sc AS ({_count_sql('default')}), sy AS (SELECT doc_id, count(*) AS k FROM c WHERE regexp_matches(trim(chunk, {_EDGE}), '^[%$€£₺¢&+−=°§@×÷<>±]+$') GROUP BY doc_id),
wd AS (SELECT doc_id, count(*)::DOUBLE AS n, sum(length(regexp_replace(form, '\\P{{L}}', '', 'g')))::DOUBLE AS l, sum((length(regexp_replace(form, '\\P{{L}}', '', 'g')) >= 7)::INT)::DOUBLE AS lg FROM w GROUP BY doc_id),
x AS (SELECT d.doc_id, wd.n, l, lg, coalesce(sc.n, 0)::DOUBLE AS s, wd.n + coalesce(k, 0) AS m, length(regexp_replace(text, '[ \\n\\t\\r]', '', 'g'))::DOUBLE AS st FROM documents d LEFT JOIN wd ON wd.doc_id = d.doc_id LEFT JOIN sc ON sc.doc_id = d.doc_id LEFT JOIN sy ON sy.doc_id = d.doc_id)
SELECT doc_id, {_r('4.71 * st / m + 0.5 * m / s - 21.43', 4, 'n > 0 AND s > 0')} AS ari, {_r('5.88 * l / n - 29.6 * s / n - 15.8', 4, 'n > 0')} AS coleman_liau,
 {_r('n / s + 100 * lg / n', 4, 'n > 0 AND s > 0')} AS lix, {_r('lg / n', 5, 'n > 0')} AS long_word_ratio FROM x"""
)
def readability_ari_cli_lix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumns({"_u": T.units(F.col("text"), "en"), "_s": count_column(F.col("text"), None, "en")})
    d = d.withColumns({"_f": F.filter("_u", lambda u: u.rlike(T.ALNUM)), "_y": F.filter("_u", lambda u: ~u.rlike(T.ALNUM))})
    return nulls(d.withColumns(readability.general("text", "_f", "_y", F.col("_s"), "en")), "doc_id", "ari", "coleman_liau", "lix", "long_word_ratio")


_BEZIRCI = " + ".join(f"{v} * sum((h IS NOT NULL AND least(h, 6) = {k} AND is_word)::INT)" for k, v in BEZIRCI.items())


@query(
    f"""WITH sd AS (WITH {sentences_sql(lang='tr')} {_count_sql('default')}), sc AS (WITH {sentences_sql(kind='cetinkaya', lang='tr')} {_count_sql('cetinkaya')}), {units_tr_sql()},
u AS (SELECT doc_id, count(*) FILTER (WHERE is_word)::DOUBLE AS n, count(h) FILTER (WHERE is_word)::DOUBLE AS r, sum(h) FILTER (WHERE is_word)::DOUBLE AS hw, count(*)::DOUBLE AS m, count(h)::DOUBLE AS ra, sum(h)::DOUBLE AS ha,
 ({_BEZIRCI})::DOUBLE AS bz, count(*) FILTER (WHERE is_word AND length(letters) >= 7)::DOUBLE AS lg FROM hs GROUP BY doc_id),
x AS (SELECT d.doc_id, u.* EXCLUDE (doc_id), coalesce(sd.n, 0)::DOUBLE AS s, coalesce(sc.n, 0)::DOUBLE AS c FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN sd ON sd.doc_id = d.doc_id LEFT JOIN sc ON sc.doc_id = d.doc_id)
SELECT doc_id, {_r('198.825 - 40.175 * (hw / r) - 2.61 * n / s', 4, 'r > 0 AND s > 0')} AS atesman, {_r('118.823 - 25.987 * (ha / ra) - 0.971 * m / c', 4, 'ra > 0 AND c > 0')} AS cetinkaya_uzun,
 {_r('sqrt(n / s * bz / s)', 4, 'r > 0 AND s > 0')} AS bezirci_yilmaz, {_r('lg / n', 5, 'n > 0')} AS long_word_ratio FROM x"""
)
def readability_turkish(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = (*readability.TURKISH_KEYS, "long_word_ratio")
    return nulls(analyze(documents(spark, sf_dir), "tr", ["readability"], warn=False), "doc_id", *keys)


# how an English unit is read, in SQL, its syllables being those of the vowel-group rule


def _spoken(words: str) -> int:
    return sum(map(syllables.heuristic_en, words.split()))


_EN_ONES = [0, *(_spoken(w) for w in readings.EN_ONES[1:])]
_EN_TENS = [0, 0, *(_spoken(w) for w in readings.EN_TENS)]


def _below_hundred_sql(n: str) -> str:
    return f"CASE WHEN {n} < 20 THEN {_EN_ONES}[{n} + 1] ELSE {_EN_TENS}[{n} // 10 + 1] + {_EN_ONES}[{n} % 10 + 1] END"


def _single_en_sql(d: str) -> str:
    return " + ".join(f"{_spoken(w)} * (length({d}) - length(replace({d}, '{i}', '')))" for i, w in enumerate(readings.EN_ONES[:10]))


def _digits_en_sql(d: str) -> str:
    padded = f"lpad({d}, 15, '0')"
    group = lambda j: f"substr({padded}, {3 * j + 1}, 3)"
    hundreds = lambda j: f"CASE WHEN substr({group(j)}, 1, 1) = '0' THEN 0 ELSE {_EN_ONES}[substr({group(j)}, 1, 1)::INT + 1] + {_spoken('hundred')} END"
    under = lambda j: f"{hundreds(j)} + {_below_hundred_sql(f'(substr({group(j)}, 2, 2)::INT)')}"
    named = " + ".join(f"CASE WHEN {group(j)} = '000' THEN 0 ELSE {under(j)} + {_spoken(name)} END" for j, name in enumerate(("trillion", "billion", "million", "thousand")))
    return f"(CASE WHEN starts_with({d}, '0') THEN {_single_en_sql(d)} WHEN length({d}) <= 15 THEN {named} + {under(4)} END)"


def _token_en_sql(x: str) -> str:
    whole, part = f"replace(split_part({x}, '.', 1), ',', '')", f"split_part({x}, '.', 2)"
    century, rest = f"(substr({x}, 1, 2)::INT)", f"(substr({x}, 3, 2)::INT)"
    year = f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}') THEN CASE WHEN {century} BETWEEN 11 AND 19 OR ({century} = 20 AND {rest} >= 10) THEN {_below_hundred_sql(century)} + CASE WHEN {rest} = 0 THEN {_spoken('hundred')} WHEN {rest} < 10 THEN {_spoken('oh')} ELSE 0 END + {_below_hundred_sql(rest)} END END"
    number = f"CASE WHEN regexp_full_match({x}, '([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\\.[0-9]+)?') THEN {_digits_en_sql(whole)} + CASE WHEN {part} = '' THEN 0 ELSE {_spoken('point')} + {_single_en_sql(part)} END END"
    bare = f"lower(regexp_replace({x}, '{_APOSTROPHES}', '', 'g'))"
    groups = f"len(regexp_extract_all({bare}, '[aeiouy]+'))"
    silent = f"CASE WHEN regexp_matches({bare}, 'e$') AND NOT regexp_matches({bare}, '(le|ee)$') AND {groups} > 1 THEN 1 ELSE 0 END"
    return f"coalesce({year}, {number}, CASE WHEN regexp_full_match({bare}, '\\p{{L}}+') THEN greatest(1, {groups} - {silent}) END)"


def units_en_sql(table: str = "documents", key: str = "doc_id") -> str:
    """CTEs ending in hs (key, is_word, h): every English unit of a text with its syllables, null if unreadable."""
    alnum = "'[\\p{L}\\p{N}]'"
    said = " + ".join(f"{_spoken(v)} * (length(edge) - length(replace(edge, {_Q(k)}, '')))" for k, v in readings.EN_SYMBOLS.items())
    letters = "regexp_replace(core, '\\P{L}', '', 'g')"
    initials = f"CASE WHEN regexp_full_match(core, '(\\p{{L}}\\.)+\\p{{L}}?') THEN length({letters}) + 2 * (length({letters}) - length(regexp_replace({letters}, '[wW]', '', 'g'))) END"
    return f"""uc AS (SELECT {key}, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS chunk, generate_subscripts(regexp_extract_all(text, '[^ \\t\\r\\n]+'), 1) AS i FROM {table}),
uf AS (SELECT {key}, i, trim(chunk, {_EDGE}) AS form, regexp_matches(trim(chunk, {_EDGE}), {alnum}) AS is_word FROM uc WHERE regexp_matches(trim(chunk, {_EDGE}), {alnum}) OR regexp_full_match(trim(chunk, {_EDGE}), '[{SYMBOLS}]+')),
us AS (SELECT *, trim(form, {_Q(SYMBOLS)}) AS core FROM uf),
ue AS (SELECT *, substr(form, 1, length(form) - length(ltrim(form, {_Q(SYMBOLS)}))) || CASE WHEN core = '' THEN '' ELSE substr(form, length(rtrim(form, {_Q(SYMBOLS)})) + 1) END AS edge FROM us),
tl AS (SELECT DISTINCT tok FROM (SELECT unnest([form, core]) AS tok FROM ue UNION ALL SELECT unnest(string_split(core, '-')) FROM ue WHERE contains(core, '-'))),
th AS (SELECT tok, {_token_en_sql('tok')} AS h FROM tl),
u1 AS (SELECT ue.*, a.h AS h0, c.h AS h1 FROM ue LEFT JOIN th a ON a.tok = form LEFT JOIN th c ON c.tok = core),
hp AS (SELECT {key}, i, CASE WHEN count(h) = count(*) THEN sum(h) END AS h2 FROM (SELECT {key}, i, unnest(string_split(core, '-')) AS part FROM u1 WHERE h0 IS NULL AND contains(core, '-')) LEFT JOIN th ON tok = part GROUP BY ALL),
hs AS (SELECT u1.{key}, is_word, coalesce(h0, CASE WHEN core = '' THEN {said} ELSE {said} + coalesce(h1, CASE WHEN contains(core, '-') THEN h2 ELSE {initials} END) END) AS h
 FROM u1 LEFT JOIN hp ON hp.{key} = u1.{key} AND hp.i = u1.i)"""


@query(
    f"""WITH sd AS (WITH {sentences_sql()} {_count_sql('default')}), sk AS (WITH {sentences_sql(kind='kincaid')} {_count_sql('kincaid')}), {units_en_sql()},
u AS (SELECT doc_id, count(h) FILTER (WHERE is_word)::DOUBLE AS r, count(*)::DOUBLE AS m, count(h)::DOUBLE AS ra, sum(h)::DOUBLE AS ha, count(*) FILTER (WHERE is_word AND h >= 3)::DOUBLE AS p FROM hs GROUP BY doc_id),
x AS (SELECT d.doc_id, u.* EXCLUDE (doc_id), coalesce(sd.n, 0)::DOUBLE AS s, coalesce(sk.n, 0)::DOUBLE AS k FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN sd ON sd.doc_id = d.doc_id LEFT JOIN sk ON sk.doc_id = d.doc_id)
SELECT doc_id, {_r('206.835 - 1.015 * m / k - 84.6 * (ha / ra)', 4, 'ra > 0 AND k > 0')} AS flesch_reading_ease, {_r('0.39 * m / k + 11.8 * (ha / ra) - 15.59', 4, 'ra > 0 AND k > 0')} AS flesch_kincaid_grade,
 {_r('3.1291 + 1.043 * sqrt(p * 30 / s)', 4, 'r > 0 AND s >= 30')} AS smog, {_r('p / r', 5, 'r > 0')} AS polysyllabic_word_ratio FROM x"""
)
def readability_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formulas that need syllables, by the vowel-group rule, which stands in for a dictionary of the caller's."""
    m = analyze(documents(spark, sf_dir), "en", ["readability"], syllable_fallback=syllables.heuristic_en, warn=False)
    return nulls(m, "doc_id", *readability.ENGLISH_KEYS)


# ---- segments and phrases


def _segment_oracle(unit: str, size: int, fill: float) -> str:
    if unit == "char":
        return f"""WITH g AS (SELECT doc_id, k AS segment_id, substr(text, k * {size} + 1, {size}) AS text FROM documents, (SELECT unnest(range(0, 2000)) AS k) WHERE k * {size} < length(text))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY segment_id) - 1)::BIGINT AS segment_id, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM g WHERE length(text) >= {size * fill} AND regexp_matches(text, '[^ \\n\\t\\r]')"""
    return f"""WITH {words_sql()}, e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[ \\t\\r\\n]*[^ \\t\\r\\n]+')) AS part, generate_subscripts(regexp_extract_all(text, '[ \\t\\r\\n]*[^ \\t\\r\\n]+'), 1) AS i FROM documents),
g AS (SELECT doc_id, (p - 1) // {size} AS segment_id, min(i) AS a, max(i) AS b, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= {size * fill}),
x AS (SELECT g.doc_id, segment_id, ltrim(string_agg(part, '' ORDER BY i), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM g JOIN e ON e.doc_id = g.doc_id AND i BETWEEN a AND b GROUP BY ALL)
SELECT doc_id, segment_id::BIGINT AS segment_id, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM x"""


def _segmented(unit: str, size: int, fill: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = segment(documents(spark, sf_dir), size, fill, unit, "en")
        return s.select("doc_id", F.col("segment_id").cast("long").alias("segment_id"), F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))

    return run


for _unit, _size, _fill in (("word", 100, 1.0), ("word", 250, 0.5), ("char", 1000, 0.5)):
    _register(f"segment_{_unit}s_{_size}", _segmented(_unit, _size, _fill), _segment_oracle(_unit, _size, _fill))

_PHRASES = (["of", "the"], ["in", "the", "and"], ["the"])
_PIECES = f"{sentence_words_sql()}, pw AS (SELECT doc_id, sid, lower(piece) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY ci, sid) AS p FROM pc WHERE regexp_matches(piece, '[\\p{{L}}\\p{{N}}]')), pl AS (SELECT *, lead(x, 1) OVER (PARTITION BY doc_id, sid ORDER BY p) AS x1, lead(x, 2) OVER (PARTITION BY doc_id, sid ORDER BY p) AS x2 FROM pw)"


def _phrase_sql(phrase: list[str]) -> str:
    return " AND ".join(f"{c} = {_Q(w)}" for c, w in zip(("x", "x1", "x2"), phrase, strict=False))


@query(
    f"WITH {_PIECES}, n AS (SELECT doc_id, " + ", ".join(f"sum(({_phrase_sql(p)})::INT)::DOUBLE AS ngram_{'_'.join(p)}_count" for p in _PHRASES) + " FROM pl GROUP BY doc_id) SELECT d.doc_id, "
    + ", ".join(f"coalesce(ngram_{'_'.join(p)}_count, 0) AS ngram_{'_'.join(p)}_count" for p in _PHRASES) + " FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"
)
def ngram_phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ngrams.ngram_counts(documents(spark, sf_dir), [list(p) for p in _PHRASES], "en")
    return nulls(d, "doc_id", *(f"ngram_{'_'.join(p)}_count" for p in _PHRASES))


@query(f"WITH {_PIECES} SELECT x || ' ' || x1 AS match, count(*)::BIGINT AS n FROM pl WHERE x = 'of' AND x1 = 'the' GROUP BY ALL")
def ngram_phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.ngram_matches(documents(spark, sf_dir), ["of", "the"], "en").select("match", "n")


@query(
    f"WITH {_PIECES}, {words_sql()}, gw AS (SELECT source, count(*)::DOUBLE AS words FROM w JOIN documents USING (doc_id) GROUP BY source), gp AS (SELECT source, " + ", ".join(f"sum(({_phrase_sql(p)})::INT)::DOUBLE AS ngram_{'_'.join(p)}_count" for p in _PHRASES) + " FROM pl JOIN documents USING (doc_id) GROUP BY source), g AS (SELECT * FROM gw JOIN gp USING (source)) "
    + " UNION ALL ".join(f"SELECT source, 'ngram_{'_'.join(p)}_count' AS phrase, coalesce(ngram_{'_'.join(p)}_count, 0) AS n, {_r(f'1000 * coalesce(ngram_{chr(95).join(p)}_count, 0) / words', 6)} AS rate FROM g" for p in _PHRASES)
)
def phrase_rates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in 1,000 words of each source."""
    d = ngrams.ngram_counts(documents(spark, sf_dir, "source"), [list(p) for p in _PHRASES], "en")
    d = d.withColumn("words", F.size(T.words(F.col("text"), "en")).cast("double"))
    rates = workflows.phrase_rates(d, "source", "words", [f"ngram_{'_'.join(p)}_count" for p in _PHRASES])
    return nulls(rates.withColumn("rate", T.rounded(F.col("rate"), 6)), "source", "phrase", "n", "rate")


@query(
    f"""WITH {_PIECES}, n AS (SELECT source, x || ' ' || x1 AS match, count(*)::BIGINT AS n FROM pl JOIN documents USING (doc_id) WHERE x IN ('of') AND x1 IN ('the') GROUP BY ALL UNION ALL
 SELECT source, x || ' ' || x1, count(*)::BIGINT FROM pl JOIN documents USING (doc_id) WHERE x = 'to' AND x1 = 'the' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, match) AS r FROM n) SELECT source, match, n FROM r WHERE r <= 3"""
)
def phrase_top_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "source")
    both = ngrams.ngram_matches(d, ["of", "the"], "en", ["source"]).unionByName(ngrams.ngram_matches(d, ["to", "the"], "en", ["source"]))
    return workflows.top_matches(both, "source")


# ---- annotated texts: tags and lemmas by a rule on the token, the same on both sides

_TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "CCONJ", "AUX", "PROPN", "NUM", "X", "SCONJ")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with rule tokens, tags by the token's length and lemmas of its first letters: stand-ins for a model's."""
    d = documents(spark, sf_dir).withColumn("surface_tokens", T.tokens(F.col("text")))
    tag = lambda t: F.when(t.rlike(T.ALNUM), F.get(F.array(*map(F.lit, _TAGS)), F.pmod(F.length(t) * 5 + F.ascii(F.lower(t)), F.lit(len(_TAGS))))).otherwise("PUNCT")
    d = d.withColumn("upos", F.transform("surface_tokens", tag))
    d = d.withColumn("lemma_tokens", F.transform(F.filter("surface_tokens", lambda t: t.rlike(T.ALNUM)), lambda t: F.lower(F.substring(t, 1, 5))))
    return d.withColumn("morph_tags", F.transform("surface_tokens", lambda t: F.concat(F.lit("Case="), F.get(F.array(F.lit("Nom"), F.lit("Acc"), F.lit("Dat")), F.length(t) % 3), F.when(F.length(t) > 3, "|Number=Plur").otherwise("|Number=Sing"))))


def viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = annotated(spark, sf_dir)
    d = d.withColumn("_v", view_column("en", set(d.columns)))
    return d.withColumns({"_words": F.col("_v.words"), "_pos": F.col("_v.pos"), "_lem": F.col("_v.lemmas"), "_morph": F.col("_v.morph"), "_at": F.col("_v.sentence")})


_TAG_LIST = "[" + ", ".join(_Q(t) for t in _TAGS) + "]"
_VIEW = f"""{sentences_sql()},
ch AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS chunk, generate_subscripts(regexp_extract_all(text, '[^ \\t\\r\\n]+'), 1) AS ci FROM documents),
ct AS (SELECT doc_id, ci, chunk, unnest(regexp_extract_all(chunk, '{_TOK}')) AS tok, generate_subscripts(regexp_extract_all(chunk, '{_TOK}'), 1) AS j FROM ch),
cn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ci, j) AS i FROM ct),
ft AS (SELECT doc_id, ci, any_value(chunk) AS chunk, arg_min(tok, j) AS tok, min(i) AS i FROM cn WHERE regexp_matches(tok, '[\\p{{L}}\\p{{N}}]') GROUP BY ALL),
vw AS (SELECT ft.doc_id, ft.ci, trim(chunk, {_EDGE}) AS form, {_TAG_LIST}[((length(ft.tok) * 5 + unicode(lower(ft.tok))) % {len(_TAGS)}) + 1] AS pos, lower(substr(ft.tok, 1, 5)) AS lem, sid,
 'Case=' || ['Nom', 'Acc', 'Dat'][(length(ft.tok) % 3) + 1] || CASE WHEN length(ft.tok) > 3 THEN '|Number=Plur' ELSE '|Number=Sing' END AS morph,
 row_number() OVER (PARTITION BY ft.doc_id ORDER BY ft.ci) AS p FROM ft JOIN s ON s.doc_id = ft.doc_id AND s.i = ft.i WHERE regexp_matches(trim(chunk, {_EDGE}), '[\\p{{L}}\\p{{N}}]'))"""


@query(
    f"WITH {_VIEW}, n AS (SELECT doc_id, " + ", ".join(f"avg((pos = '{t}')::INT) AS {t.lower()}" for t in (*pos.COLUMN_POS, "PRON")) + ", count(*) FILTER (WHERE pos = 'VERB') AS vb, max(p) FILTER (WHERE pos = 'VERB') AS b, min(p) FILTER (WHERE pos = 'VERB') AS a, count(*) FILTER (WHERE pos = 'ADJ') AS aj FROM vw GROUP BY doc_id) SELECT d.doc_id, "
    + ", ".join(f"{_r(t.lower(), 5)} AS pos_{t.lower()}_ratio" for t in pos.COLUMN_POS)
    + f", {_r('pron', 5)} AS pronoun_ratio, {_r('(b - a)::DOUBLE / (vb - 1)', 4, 'vb >= 2')} AS verb_dist_mean, {_r('vb::DOUBLE / (vb + aj)', 5, 'vb + aj > 0')} AS activity_ratio FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"
)
def pos_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pos.with_pos(viewed(spark, sf_dir), "_pos", "_at")
    return nulls(d, "doc_id", *(f"pos_{t.lower()}_ratio" for t in pos.COLUMN_POS), "pronoun_ratio", "verb_dist_mean", "activity_ratio")


_ROUNDED = ", ".join(f"floor(avg((pos = '{t}')::INT) * 1e5 + 0.5) / 1e5" for t in pos.COLUMN_POS)


@query(
    f"""WITH {_VIEW}, q AS (SELECT doc_id, pos, count(*)::DOUBLE AS k FROM vw GROUP BY ALL), qn AS (SELECT doc_id, sum(k) AS n FROM q GROUP BY doc_id),
l AS (SELECT doc_id, sid, pos, count(*)::DOUBLE AS k FROM vw GROUP BY ALL), ln_ AS (SELECT doc_id, sid, sum(k) AS n FROM l GROUP BY ALL),
kl AS (SELECT l.doc_id, l.sid, sum((l.k / ln_.n) * ln((l.k / ln_.n) / (q.k / qn.n))) AS x FROM l JOIN ln_ USING (doc_id, sid) JOIN q ON q.doc_id = l.doc_id AND q.pos = l.pos JOIN qn ON qn.doc_id = l.doc_id GROUP BY ALL),
m AS (SELECT doc_id, abs(avg(x)) AS x FROM kl GROUP BY doc_id), sh AS (SELECT doc_id, [{_ROUNDED}] AS r FROM vw GROUP BY doc_id)
SELECT d.doc_id, {_r('list_stddev_pop(r)', 5)} AS posddev, {_r('x', 5)} AS posdiv FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN sh ON sh.doc_id = d.doc_id"""
)
def pos_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(pos.with_pos(viewed(spark, sf_dir), "_pos", "_at"), "doc_id", "posddev", "posdiv")


_TAGGED = (["ADJ", "NOUN"], ["OF", "NOUN"], ["NOUN", "the"], ["VERB", "DET", "NOUN"])


def _item_sql(k: int, x: str) -> str:
    item = ngrams.compile_phrase([x], "en")[0]
    column = {"pos": "pos", "lemma": "lem", "form": "low"}[item.field]
    return f"{column}{k} = {_Q(item.needle)}"


def _tagged_sql(phrase: list[str]) -> str:
    return " AND ".join([f"sid{len(phrase) - 1} = sid0", *(_item_sql(k, x) for k, x in enumerate(phrase))])


@query(
    f"WITH {_VIEW}, vx AS (SELECT doc_id, " + ", ".join(f"lead({e}, {k}) OVER q AS {c}{k}" for k in range(3) for c, e in (("pos", "pos"), ("lem", "lem"), ("low", "lower(form)"), ("sid", "sid")))
    + " FROM vw WINDOW q AS (PARTITION BY doc_id ORDER BY p)), n AS (SELECT doc_id, " + ", ".join(f"coalesce(sum(({_tagged_sql(x)})::INT), 0)::DOUBLE AS {ngrams.key_of(ngrams.compile_phrase(x, 'en'))}" for x in _TAGGED)
    + " FROM vx GROUP BY doc_id) SELECT d.doc_id, " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in (ngrams.key_of(ngrams.compile_phrase(x, "en")) for x in _TAGGED)) + " FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"
)
def ngram_tag_and_lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of tags, lemmas and forms over annotated texts."""
    keys = [ngrams.key_of(ngrams.compile_phrase(x, "en")) for x in _TAGGED]
    return nulls(ngrams.ngram_counts(viewed(spark, sf_dir), [list(x) for x in _TAGGED], "en", view="_v"), "doc_id", *keys)


_CONTENT = "pos IN ('NOUN', 'PROPN', 'VERB', 'ADJ', 'ADV')"


@query(
    f"""WITH {_VIEW}, k AS (SELECT doc_id, lem, count(*)::DOUBLE AS k, CASE WHEN length(lem) % 4 <> 0 THEN ((length(lem) * 7 + unicode(lem)) % 56)::DOUBLE / 8 ELSE 0 END AS z FROM vw WHERE {_CONTENT} GROUP BY ALL),
n AS (SELECT doc_id, sum(k * z) / sum(k) AS m, sum(CASE WHEN z <= 3 THEN k ELSE 0 END) / sum(k) AS r FROM k GROUP BY doc_id)
SELECT d.doc_id, {_r('m', 4)} AS wordfreq_mean, {_r('r', 5)} AS wordfreq_rare_ratio FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def lexical_word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content lemmas met with a table of scores; the table stands in for a public one and lacks lemmas of four letters."""
    d = annotated(spark, sf_dir)
    table = d.select(F.explode("lemma_tokens").alias("lemma")).where(F.length("lemma") % 4 != 0).distinct()
    table = table.select(F.lit("en").alias("lang"), "lemma", (F.pmod(F.length("lemma") * 7 + F.ascii("lemma"), F.lit(56)) / 8.0).alias("zipf"))
    return nulls(lexical.word_frequency_of_views(d, "doc_id", table, "en"), "doc_id", "wordfreq_mean", "wordfreq_rare_ratio")


@query(
    f"""WITH {_VIEW}, n AS (SELECT doc_id, count(DISTINCT lem)::DOUBLE AS l, count(*) FILTER (WHERE {_CONTENT})::DOUBLE AS c, count(*)::DOUBLE AS n, count(DISTINCT lem) FILTER (WHERE pos IN ('NOUN', 'PROPN')) AS nn,
 count(DISTINCT lem) FILTER (WHERE pos = 'VERB') AS vv, count(*) FILTER (WHERE pos = 'VERB')::DOUBLE AS v, count(DISTINCT lem) FILTER (WHERE pos = 'ADJ') AS aj, count(DISTINCT lem) FILTER (WHERE pos = 'ADV') AS av FROM vw GROUP BY doc_id)
SELECT d.doc_id, l AS lemma_count, {_r('nn / c', 5, 'c > 0')} AS noun_variation, {_r('vv / v', 5, 'v > 0')} AS verb_variation, {_r('aj / c', 5, 'c > 0')} AS adj_variation, {_r('av / c', 5, 'c > 0')} AS adv_variation, {_r('c / n', 5)} AS lexical_density
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def lexical_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = viewed(spark, sf_dir).withColumns(lexical.tagged("_lem", "_pos", "en"))
    return nulls(d, "doc_id", "lemma_count", "noun_variation", "verb_variation", "adj_variation", "adv_variation", "lexical_density")


@query(
    f"""WITH {_VIEW}, n AS (SELECT doc_id, count(DISTINCT (lem, lower(form)))::DOUBLE / count(DISTINCT lem) AS spl, {', '.join(f"avg((contains(morph, 'Case={v}'))::INT) AS c_{v.lower()}" for v in ('Nom', 'Acc', 'Dat'))}, avg(contains(morph, 'Number=Plur')::INT) AS pl FROM vw GROUP BY doc_id)
SELECT d.doc_id, {_r('spl', 5)} AS surface_per_lemma, {_r('c_nom', 5)} AS case_nom_ratio, {_r('c_acc', 5)} AS case_acc_ratio, {_r('c_dat', 5)} AS case_dat_ratio, {_r('pl', 5)} AS number_plur_ratio FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def morph_feature_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = viewed(spark, sf_dir).withColumns(morphology.tag_measures("_words", "_pos", "_lem", "_morph", "en"))
    return nulls(d, "doc_id", "surface_per_lemma", "case_nom_ratio", "case_acc_ratio", "case_dat_ratio", "number_plur_ratio")


@query(
    f"""WITH {_VIEW}, lt AS (SELECT doc_id, lem, count(*) AS f FROM vw GROUP BY ALL), tg AS (SELECT doc_id, lem, pos, count(*) AS k, min(p) AS fp FROM vw GROUP BY ALL),
lp AS (SELECT doc_id, lem, arg_max(pos, k * 1000000 - fp) AS pos FROM tg GROUP BY ALL),
rk AS (SELECT doc_id, lem, f::DOUBLE AS f, rank() OVER (PARTITION BY doc_id ORDER BY f DESC) + (count(*) OVER (PARTITION BY doc_id, f) - 1) / 2.0 AS ar, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC) AS r FROM lt),
xx AS (SELECT doc_id, f, r, lag(f) OVER (PARTITION BY doc_id ORDER BY r) AS prev FROM rk), hp AS (SELECT doc_id, min(r) FILTER (WHERE f <= r) AS r0, count(*)::DOUBLE AS v, max(f) AS f1 FROM xx GROUP BY doc_id),
h AS (SELECT hp.doc_id, f1, CASE WHEN r0 IS NULL THEN v WHEN xx.f = r0 THEN r0 ELSE floor((prev * r0 - xx.f * (r0 - 1)) / (1 + prev - xx.f) * 1e6 + 0.5) / 1e6 END::DOUBLE AS h FROM hp LEFT JOIN xx ON xx.doc_id = hp.doc_id AND xx.r = hp.r0),
w2 AS (SELECT h.doc_id, any_value(h) AS h, any_value(f1) AS f1, coalesce(sum((h - ar) * f) FILTER (WHERE ar < h AND {_CONTENT}), 0) AS a, coalesce(sum((2 * h - ar) * f) FILTER (WHERE ar < 2 * h AND {_CONTENT}), 0) AS b FROM h JOIN rk USING (doc_id) JOIN lp USING (doc_id, lem) GROUP BY h.doc_id)
SELECT d.doc_id, {_r('2 * a / (h * (h - 1) * f1)', 6, 'h > 1')} AS thematic_concentration, {_r('b / (h * (2 * h - 1) * f1)', 6, 'h > 0.5')} AS secondary_thematic_concentration FROM documents d LEFT JOIN w2 ON w2.doc_id = d.doc_id"""
)
def thematic_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = annotated(spark, sf_dir)
    d = d.withColumn("_t", frequency.thematic_of_views("en", set(d.columns)))
    d = d.withColumns({"thematic_concentration": T.rounded(F.col("_t.first"), 6), "secondary_thematic_concentration": T.rounded(F.col("_t.second"), 6)})
    return nulls(d, "doc_id", "thematic_concentration", "secondary_thematic_concentration")


_ROOTS, _SECOND, _THIRD = ("Noun", "Verb", "Adj", "Unk"), ("A3pl", "Acc", "Past", "Neg", "Pass", "Dat", "Able", "Fut"), ("Loc", "Cond", "Prog1", "Caus", "Gen", "Neces", "Narr")
_SHOWN = tuple(k for k in morphology.SUFFIX_KEYS if k != "zeyrek_verb_suffix_diversity")


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """annotated texts with analyses by a rule on the token: a root of three letters, a suffix of two, and the rest."""
    kind = lambda names, t, k: F.get(F.array(*map(F.lit, names)), F.pmod(F.length(t) * k + F.ascii(F.lower(t)), F.lit(len(names))))
    part = lambda tag, t, a, n, deriv: F.struct(tag.alias("tag"), F.lower(F.substring(t, a, n)).alias("surface"), deriv.alias("deriv"))

    def morphemes(t: Column) -> Column:
        root = part(kind(_ROOTS, t, 3), t, 1, 3, F.lit(False))
        second = part(kind(_SECOND, t, 1), t, 4, 2, F.length(t) % 2 == 0)
        third = part(kind(_THIRD, t, 5), t, 6, 1000, F.lit(False))
        return F.when(F.length(t) > 5, F.array(root, second, third)).when(F.length(t) > 3, F.array(root, second)).otherwise(F.array(root))

    return annotated(spark, sf_dir).withColumn("morpheme_lists", F.transform("surface_tokens", morphemes))


def _kind_sql(names: tuple[str, ...], k: int) -> str:
    return f"[{', '.join(map(_Q, names))}][((length(tok) * {k} + unicode(lower(tok))) % {len(names)}) + 1]"


_SUFFIXED = f"""ch AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS chunk, generate_subscripts(regexp_extract_all(text, '[^ \\t\\r\\n]+'), 1) AS ci FROM documents),
ct AS (SELECT doc_id, ci, chunk, unnest(regexp_extract_all(chunk, '{_TOK}')) AS tok, generate_subscripts(regexp_extract_all(chunk, '{_TOK}'), 1) AS j FROM ch),
ft AS (SELECT doc_id, ci, any_value(chunk) AS chunk, arg_min(tok, j) AS tok FROM ct WHERE regexp_matches(tok, '[\\p{{L}}\\p{{N}}]') GROUP BY ALL),
mo AS (SELECT doc_id, length(tok) AS n, {_kind_sql(_ROOTS, 3)} AS a, CASE WHEN length(tok) > 3 THEN {_kind_sql(_SECOND, 1)} END AS b, CASE WHEN length(tok) > 5 THEN {_kind_sql(_THIRD, 5)} END AS c
 FROM ft WHERE regexp_matches(trim(chunk, {_EDGE}), '[\\p{{L}}\\p{{N}}]')),
ml AS (SELECT *, a = 'Verb' AS verb, CASE WHEN c IN ('Prog1', 'Narr') THEN c WHEN b IN ('Past', 'Fut') THEN b END AS tense FROM mo WHERE a <> 'Unk')"""
_HELD = {"zeyrek_modal_possibility_ratio": "Able", "zeyrek_modal_necessity_ratio": "Neces", "zeyrek_negation_ratio": "Neg", "zeyrek_passive_ratio": "Pass", "zeyrek_conditional_suffix_ratio": "Cond", "zeyrek_causative_suffix_ratio": "Caus"}
_SUFFIX_SQL = {
    "zeyrek_agglutination_depth": _r("avg((n > 3)::INT + (n > 5)::INT)", 5), "zeyrek_suffix_char_length_ratio": _r("sum(greatest(n - 3, 0))::DOUBLE / sum(n)", 5), "zeyrek_suffix_bigram_entropy": _r("any_value(e) + 0.0", 5),
    "zeyrek_derivational_suffix_ratio": _r("sum((n > 3 AND n % 2 = 0)::INT)::DOUBLE / nullif(sum((n > 3)::INT + (n > 5)::INT), 0)", 5), "zeyrek_plural_ratio": _r("avg((b IS NOT DISTINCT FROM 'A3pl' AND NOT verb)::INT)", 5),
    "zeyrek_question_particle_ratio": "0.0", **{f"zeyrek_case_{c.lower()}_ratio": _r(f"avg((b IS NOT DISTINCT FROM '{c}' OR c IS NOT DISTINCT FROM '{c}')::INT)", 5) for c in morphology.CASES},
    **{k: _r(f"avg((b IS NOT DISTINCT FROM '{t}' OR c IS NOT DISTINCT FROM '{t}')::INT) FILTER (WHERE verb)", 5) for k, t in _HELD.items()},
    **{f"zeyrek_tense_{k}_ratio": _r(f"avg((tense IS NOT DISTINCT FROM '{t}')::INT) FILTER (WHERE verb)", 5) for k, t in (("past_def", "Past"), ("past_nar", "Narr"), ("present", "Prog1"), ("future", "Fut"))},
}


@query(
    f"""WITH {_SUFFIXED}, bg AS (SELECT doc_id, b, c, count(*)::DOUBLE AS k FROM ml WHERE c IS NOT NULL GROUP BY ALL), bn AS (SELECT doc_id, sum(k) AS m FROM bg GROUP BY doc_id),
be AS (SELECT doc_id, -sum((k / m) * ln(k / m)) AS e FROM bg JOIN bn USING (doc_id) GROUP BY doc_id), x AS (SELECT ml.doc_id, """
    + ", ".join(f"{_SUFFIX_SQL[k]} AS {k}" for k in _SHOWN) + " FROM ml LEFT JOIN be USING (doc_id) GROUP BY ml.doc_id) SELECT d.doc_id, " + ", ".join(_SHOWN) + " FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id"
)
def suffix_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of suffix chains, but for the seeded one."""
    d = analysed(spark, sf_dir)
    d = d.withColumn("_v", view_column("en", set(d.columns))).withColumns({"_m": F.col("_v.morphemes"), "_p": F.col("_v.pos")})
    return nulls(morphology.with_suffixes(d, "_m", "_p"), "doc_id", *_SHOWN)


_KNOWN = "the of and to in a is that it was for on are as with they be at one have this from or had by der die und en de la el le".split()


@query()
def kalyoncu_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Turkish readability components over analysed texts, with a short word list that stands in for the caller's."""
    d = analysed(spark, sf_dir)
    return nulls(d.withColumn("_k", kalyoncu.kalyoncu_of_views("tr", set(d.columns), _KNOWN)).select("doc_id", "_k.*"), "doc_id", *kalyoncu.KEYS)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with heads by a rule: in sentences of up to ten neighbouring tokens, the first is the root, an even
    token hangs from the one before, an odd one from the first."""
    d = annotated(spark, sf_dir)
    pieces = lambda u: F.transform(A.span(F.ceil(F.size(u) / 10).cast("int")), lambda k: F.slice(u, (k - 1) * 10 + 1, 10))
    head = lambda i: F.when(i == 0, 0).when(i % 2 == 0, i - 1).otherwise(0)
    dep = F.transform(A.let(F.col("upos"), pieces), lambda s: F.transform(s, lambda t, i: F.struct(i.alias("i"), t.alias("upos"), F.lit("dep").alias("rel"), head(i).cast("int").alias("head"))))
    return d.withColumn("dep_data", dep)


_PARSED = f"""tk AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOK}')) AS tok, generate_subscripts(regexp_extract_all(text, '{_TOK}'), 1) - 1 AS g FROM documents),
dp AS (SELECT doc_id, g // 10 AS sid, g % 10 AS i, CASE WHEN regexp_matches(tok, '[\\p{{L}}\\p{{N}}]') THEN {_TAG_LIST}[((length(tok) * 5 + unicode(lower(tok))) % {len(_TAGS)}) + 1] ELSE 'PUNCT' END AS pos,
 CASE WHEN g % 10 = 0 THEN 0 WHEN (g % 10) % 2 = 0 THEN g % 10 - 1 ELSE 0 END AS head FROM tk),
kp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sid ORDER BY i) AS o FROM dp WHERE pos <> 'PUNCT')"""


@query(
    f"""WITH {_PARSED}, ar AS (SELECT a.doc_id, a.sid, avg(abs(a.o - b.o)) AS x FROM kp a JOIN kp b ON a.doc_id = b.doc_id AND a.sid = b.sid AND b.i = a.head WHERE a.head <> a.i GROUP BY ALL), am AS (SELECT doc_id, list_sum(list(x ORDER BY sid)) / count(*) AS x FROM ar GROUP BY doc_id),
ds AS (SELECT doc_id, sid, avg(CASE WHEN head = 0 THEN 1 ELSE 2 END) AS x FROM kp WHERE head <> i GROUP BY ALL), dm AS (SELECT doc_id, list_sum(list(x ORDER BY sid)) / count(*) AS x FROM ds GROUP BY doc_id)
SELECT d.doc_id, {_r('am.x', 5)} AS arc_len_mean, {_r('dm.x', 5)} AS parse_depth_mean FROM documents d LEFT JOIN am ON am.doc_id = d.doc_id LEFT JOIN dm ON dm.doc_id = d.doc_id"""
)
def dependency_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(pos.with_dependencies(parsed(spark, sf_dir), "dep_data"), "doc_id", "arc_len_mean", "parse_depth_mean")


_FINAL = (*pos.FINAL_POS, "other")


@query(
    f"""WITH {_PARSED}, fn AS (SELECT doc_id, sid, arg_max(pos, i) AS pos FROM kp GROUP BY ALL), n AS (SELECT doc_id, """
    + ", ".join(f"avg((pos = '{t}')::INT) AS {t.lower()}" for t in pos.FINAL_POS) + f", avg((pos NOT IN ({', '.join(_Q(t) for t in pos.FINAL_POS)}))::INT) AS other FROM fn GROUP BY doc_id) SELECT d.doc_id, "
    + ", ".join(f"{_r(t.lower(), 5)} AS sentfinal_{t.lower()}_ratio" for t in _FINAL) + " FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"
)
def sentence_final_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls(pos.with_dependencies(parsed(spark, sf_dir), "dep_data"), "doc_id", *(f"sentfinal_{t.lower()}_ratio" for t in _FINAL))


# ---- over the matrix of measures

_MATRIX = ("ttr", "hapax_ratio", "guiraud_r", "word_len_mean")
_MATRIX_SQL = f"{words_sql()}, {_NV}, mx AS (SELECT nv.doc_id, source, " + ", ".join(f"{_CLOSED_SQL[k]} AS {k}" for k in _MATRIX) + " FROM nv JOIN documents USING (doc_id))"


def matrix(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    d = A.with_frequencies(worded(documents(spark, sf_dir, *more)), "_w", "_f")
    made = lexical.closed_forms(d, "_w", "_f", T.is_blank(F.col("text")))
    return d.withColumns({k: made[k] for k in _MATRIX}).select("doc_id", *more, *_MATRIX)


@query(f"WITH {_MATRIX_SQL} SELECT source, " + ", ".join(f"{_r(f'avg({k})', 6)} AS {k}" for k in _MATRIX) + " FROM mx GROUP BY source")
def matrix_label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = workflows.label_profile(matrix(spark, sf_dir, "source"), "source", list(_MATRIX))
    return nulls(p.withColumns({k: T.rounded(F.col(k), 6) for k in _MATRIX}), "source", *_MATRIX)


@query(f"WITH {_MATRIX_SQL}, u AS (UNPIVOT (SELECT {', '.join(_MATRIX)} FROM mx) ON {', '.join(_MATRIX)} INTO NAME measure VALUE value) SELECT measure, {_r('stddev_pop(value)', 6)} AS spread FROM u GROUP BY measure")
def matrix_most_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.most_variable(matrix(spark, sf_dir), list(_MATRIX)).withColumn("spread", T.rounded(F.col("spread"), 6))


_GROWING = (10, 50, 100, 400)


def _growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of the first 10, 50, 100 and 400 words of each text that has as many."""
    d = worded(documents(spark, sf_dir)).withColumn("size", F.explode(F.array(*map(F.lit, _GROWING)))).where(F.size("_w") >= F.col("size"))
    d = A.with_frequencies(d.withColumn("_w", F.slice("_w", F.lit(1), F.col("size"))), "_w", "_f")
    made = lexical.closed_forms(d, "_w", "_f", F.lit(False)) | {"msttr": lexical.msttr("_w", F.size("_w"), 100)}
    return d.withColumns({k: made[k] for k in ("ttr", "brunet_w", "guiraud_r", "msttr")}).select("doc_id", "size", "ttr", "brunet_w", "guiraud_r", "msttr")


_GROWING_SQL = f"{words_sql()}, sz AS (SELECT unnest([{', '.join(map(str, _GROWING))}]) AS size), gt AS (SELECT doc_id, size, w, count(*) AS f FROM w, sz WHERE p <= size GROUP BY ALL), gn AS (SELECT doc_id, size, sum(f)::DOUBLE AS n, count(*)::DOUBLE AS v FROM gt GROUP BY ALL HAVING sum(f) = size)"


@query(
    f"""WITH {_GROWING_SQL}, m AS (SELECT doc_id, 'ttr' AS measure, size FROM gn UNION ALL SELECT doc_id, 'guiraud_r', size FROM gn UNION ALL SELECT doc_id, 'brunet_w', size FROM gn WHERE v > 20 UNION ALL SELECT doc_id, 'msttr', size FROM gn WHERE size >= 100)
SELECT doc_id, measure, min(size)::INT AS size FROM m GROUP BY ALL"""
)
def matrix_nan_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.nan_map(_growing(spark, sf_dir), "doc_id", "size", ["ttr", "brunet_w", "guiraud_r", "msttr"])


@query(
    f"""WITH {_GROWING_SQL}, m AS (SELECT doc_id, 'ttr' AS measure, {_CLOSED_SQL['ttr']} AS x FROM gn UNION ALL SELECT doc_id, 'guiraud_r', {_CLOSED_SQL['guiraud_r']} FROM gn),
s AS (SELECT doc_id, measure, (max(x) - min(x)) / avg(x) AS s FROM m GROUP BY ALL) SELECT doc_id, measure, {_r('s', 6)} AS spread, s < 0.15 AS robust FROM s"""
)
def length_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = workflows.length_sensitivity(_growing(spark, sf_dir), "doc_id", ["ttr", "guiraud_r"], size="size")
    return nulls(s.withColumn("spread", T.rounded(F.col("spread"), 6)), "doc_id", "measure", "spread", "robust")


@query(
    f"""WITH {sentence_words_sql()}, o AS (SELECT source, len, row_number() OVER (PARTITION BY source ORDER BY len) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM lens JOIN documents USING (doc_id)),
pp AS (SELECT unnest([10, 50, 90]) AS percent) SELECT source, percent::INT AS percent, len::INT AS value FROM o, pp WHERE r = n * percent // 100"""
)
def sentence_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sentence.with_sentences(documents(spark, sf_dir, "source"), "text", None, "en")
    lengths = d.select("source", F.explode("_lettered").alias("len"))
    return workflows.percentile_by_index(lengths, "len", [10, 50, 90], ["source"])


@query(f"WITH {_MATRIX_SQL} SELECT quality::INT AS quality, count(*)::BIGINT AS n, {_r('avg(ttr)', 6)} AS ttr, {_r('avg(word_len_mean)', 6)} AS word_len_mean FROM mx JOIN labels USING (doc_id) GROUP BY quality")
def quality_by_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    j = matrix(spark, sf_dir).join(labels, "doc_id")
    return j.groupBy("quality").agg(F.count("*").alias("n"), *(T.rounded(F.avg(F.nanvl(k, F.lit(None))), 6).alias(k) for k in ("ttr", "word_len_mean")))


@query()
def corpus_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures that need no model, of all texts under Turkish rules, but for voc-D, whose seeded samples have a query
    of their own."""
    d = A.placed(documents(spark, sf_dir, "source"), {"_m": one_pass.measures_column(F.col("text"))})
    groups = ["frequency_structure", "sentence", "paragraph", "phonological", "readability", "punctuation", "chars"]
    keys = [*feature_keys("tr", groups), *one_pass.LEXICAL]
    made = {k: F.col(f"_m.{one_pass.FIELDS[k]}") if k in one_pass.FIELDS else T.nan() for k in keys}
    return nulls(d.select("doc_id", "source", *(x.alias(k) for k, x in made.items())), "doc_id", "source", *keys)
