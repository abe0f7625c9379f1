"""Known values of the measures and rules, and plans without exchange."""

import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import textloom
from textloom import errors, vocab
from textloom.functions import arrays as A
from textloom.functions import readings, sampled, sentences, syllables
from textloom.functions import text as T
from textloom.functions.alignment import word_tokens
from textloom.operators import frequency, kalyoncu, lexical, morphology, pos, workflows
from textloom.params import FeatureParams
from textloom.plans import registry
from textloom.plans.analyze import TAGGED_LEXICAL, analyze_text
from textloom.sources import corpus, segments
from textloom.sources.segments import segment_text, segments_column


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def units(spark, text, lang):
    r = rows(spark, [text]).select(T.words(F.col("text"), lang).alias("w"), T.symbols(F.col("text"), lang).alias("s")).first()
    return r["w"], r["s"]


WORDS = [
    ("tr", '"Ali," dedi (kısaca) - evet.', ["Ali", "dedi", "kısaca", "evet"], []),
    ("en", "I couldn't pay 32,008 for second-grade F.O.B. goods.", ["I", "couldn't", "pay", "32,008", "for", "second-grade", "F.O.B", "goods"], []),
    ("tr", "Fiyat % 50 ve $ ile # işareti", ["Fiyat", "50", "ve", "ile", "işareti"], ["%", "$"]),
    ("tr", "3. kat, 4., 5. ve 6. sınıf. Sonuç 3.", ["3.", "kat", "4.", "5.", "ve", "6.", "sınıf", "Sonuç", "3"], []),
    ("en", "Chapter 3. Next", ["Chapter", "3", "Next"], []),
]


@pytest.mark.parametrize("lang,text,words,symbols", WORDS)
def test_word_units(spark, lang, text, words, symbols):
    assert units(spark, text, lang) == (words, symbols)
    assert sentences.words(text, lang) == words


@pytest.mark.parametrize(
    "lang,text,n",
    [("tr", 'Ne?! Gitti... Bitti."', 3), ("tr", 'Ali dedi ki: "Geliyorum." Sonra çıktı.', 3), ("tr", "Şunları aldım: elma, armut.", 1), ("tr", "Saat 10:30 oldu. Gittik.", 2), ("en", "They won: we lost.", 1), ("en", "Items: apples, oranges.", 1), ("tr", "Tabloya bkz. ekte var. Sonra bitti.", 2), ("tr", "", 0), ("tr", "...", 0)],
)
def test_sentence_counts(lang, text, n):
    assert sentences.count(sentences.rule_tokens(text), "default", lang) == n


def test_colon_counts_in_one_set():
    assert sentences.count(sentences.rule_tokens("Şunları aldım: elma, armut."), "cetinkaya", "tr") == 2
    assert sentences.count("Dr. Smith paid on Jan. 3 . Then left .".split(), "default", "en") == 2


def naive_spans(tokens, lang):
    """The rule as a walk over the tokens."""
    out, start, opened, i = [], 0, False, 0
    letters = sentences.code(tokens, "default", lang)
    while i < len(tokens):
        if letters[i] == "w":
            opened = True
        elif opened and letters[i] in "eE":
            i += 1
            while i < len(tokens) and letters[i] in "em":
                i += 1
            out.append((start, i))
            start, opened = i, False
            continue
        i += 1
    if start < len(tokens):
        if out and "w" not in letters[start:]:
            out[-1] = (out[-1][0], len(tokens))
        else:
            out.append((start, len(tokens)))
    return out


def test_sentence_spans_against_a_walk():
    rng = random.Random(1)
    for _ in range(4000):
        tokens = [rng.choice(["a", "Bir", ".", "?", ":", "(", '"', ",", "…", "dr", "3"]) for _ in range(rng.randint(0, 14))]
        assert sentences.spans(tokens, "tr") == naive_spans(tokens, "tr"), tokens


def test_slices_cover_the_text():
    text = 'Geldi.Sonra gitti. "Evet" dedi.'
    toks = sentences.rule_tokens(text)
    cut = sentences.slices(text, toks, sentences.spans(toks, "tr"))
    assert "".join(cut) == text and sentences.words(cut[1], "tr") == ["Sonra", "gitti"]


TR_SYLLABLES = {
    "Kitaplarımızda": 6, "İSTANBUL": 3, "Ankara'da": 4, "kâğıt": 2, "TBMM": 4, "PTT": 3, "TBMM'de": 5, "cm'lik": 5, "1916": 7, "0": 2, "100": 1, "1000": 1, "101": 2, "2001": 4, "1000000": 3,
    "1.916": 7, "12.500.000": 8, "3,5": 4, "3,05": 6, "1916'da": 8, "0532": 6, "cm": 4, "kg.": 3, "km/s": 8, "m²": 4, "vb.": 4, "bkz.": 3, "T.C.": 8, "ABD": 3, "MÖ": 5, "MS": 5, "ms": 5, "Sn.": 2,
    "sn": 3, "3.": 3, "10:30": 3, "3kg": 4, "%50": 4, "Türk-İslam": 3, "A.Ş": 2, "4x4": None, "3x": None, "xyz": None, "m": None,
}


@pytest.mark.parametrize("unit,n", TR_SYLLABLES.items())
def test_turkish_syllables(unit, n):
    assert syllables.Counter("tr").unit(unit) == n


def test_english_syllables():
    lexicon = {"make": 1, "beautiful": 3, "fifty": 2, "percent": 2, "dollars": 2, "well": 1, "known": 1}
    c = syllables.Counter("en", lexicon)
    assert [c.unit(u) for u in ("make", "beautiful", "50%", "$", "W.H.O", "well-known", "3G", "unheard")] == [1, 3, 4, 2, 5, 2, None, None]
    assert syllables.Counter("en", fallback=syllables.heuristic_en).unit("table") == 2


def test_syllabify():
    for word, parts in {"kitap": "ki-tap", "program": "prog-ram", "kontrol": "kont-rol", "strateji": "stra-te-ji", "başöğretmen": "ba-şöğ-ret-men", "müdafaa": "mü-da-fa-a"}.items():
        assert "-".join(syllables.syllabify_tr(word)) == word.replace(word, parts)


def test_readings():
    assert readings.tr_number("1916") == "bin dokuz yüz on altı" and readings.tr_ordinal("4.") == "dördüncü" and readings.tr_time("10:00") == "on"
    assert readings.en_number("1905") == "nineteen oh five" and readings.en_number("2,000.5") == "two thousand point five" and readings.tr_number("1.5") is None


SPECTRA = {
    "T1": ({16: 1, 7: 3, 5: 2, 3: 4, 2: 11, 1: 98}, {"h_point": 5, "vocab_richness_r1": 0.835, "vocab_richness_r4": 0.696, "repeat_rate": 0.020, "rr_mcintosh": 0.946, "gini_coef": 0.30449, "curve_length": 129.356, "curve_length_r": 0.890, "lambda_pa": 3.749, "adjusted_modulus": 4.629, "writers_view_alpha": 1.955}),
    "T2": ({20: 1, 9: 1, 8: 1, 7: 1, 4: 5, 3: 6, 2: 14, 1: 92}, {"h_point": 4.75, "vocab_richness_r1": 0.838, "vocab_richness_r4": 0.649, "repeat_rate": 0.02147, "rr_mcintosh": 0.939, "gini_coef": 0.351, "curve_length": 134.2787, "curve_length_r": 0.866, "lambda_pa": 3.529, "adjusted_modulus": 4.864, "writers_view_alpha": 1.844}),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_published_spectra(spark, name):
    spectrum, expected = SPECTRA[name]
    words = [f"w{f}_{k}" for f, n in spectrum.items() for k in range(n) for _ in range(f)]
    d = frequency.with_curve(A.with_frequencies(spark.createDataFrame([(words,)], "w array<string>"), "w", "f"), "f").first()
    for key, value in expected.items():
        assert d[key] == pytest.approx(value, abs=1.1 * 10 ** -len(str(value).split(".")[-1]) if "." in str(value) else 0), key


def test_window_measures_against_definitions(spark):
    rng = random.Random(2)
    texts = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(0, 260))] for _ in range(25)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, w array<string>")
    got = {r["id"]: r for r in lexical.with_lexical(d, "w", F.lit(False), FeatureParams(mattr_window=20), only={"mattr", "msttr", "heaps_beta", "hdd", "mtld", "ttr"}).collect()}
    for i, t in enumerate(texts):
        n = len(t)
        mattr = sum(len(set(t[k : k + 20])) for k in range(n - 19)) / ((n - 19) * 20) if n >= 40 else math.nan
        segments = [len(set(t[k : k + 100])) / 100 for k in range(0, n - 99, 100)]
        hdd = sum(1 - math.prod((n - f - j) / (n - j) for j in range(42)) if n - f >= 42 else 1 for f in Counter(t).values()) / 42 if n >= 42 else math.nan
        for key, value, tol in (("mattr", mattr, 1e-5), ("msttr", sum(segments) / len(segments) if segments else math.nan, 1e-5), ("hdd", hdd, 1e-5)):
            assert (math.isnan(value) and math.isnan(got[i][key])) or got[i][key] == pytest.approx(value, abs=tol), (i, key)


def test_heaps(spark):
    texts = [["x"] * 300 + [str(i) for i in range(300)], [str(i) for i in range(1000)], ["x"] * 1000, ["x"] * 19]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, w array<string>")
    got = [r["heaps_beta"] for r in lexical.with_lexical(d, "w", F.lit(False), only={"heaps_beta"}).orderBy("id").collect()]
    assert got[:3] == [2.4791, 1.0, 0.0] and math.isnan(got[3])


def test_sampled_measures():
    words = [f"w{i % 37}" for i in range(400)]
    p = FeatureParams()
    assert sampled.vocd(words, p) == sampled.vocd(words, p) and 20 < sampled.vocd(words, p) < 60
    assert math.isnan(sampled.vocd(words[:40], p)) and math.isnan(sampled.mtld(words[:50], 0.72, 100))


def test_dependencies(spark):
    one = [(i, "PUNCT" if i in (1, 8) else "NOUN", "d", h) for i, h in enumerate([1, 2, 2, 2, 2, 3, 5, 5, 2])]
    five = [(i, "NOUN", "d", h) for i, h in enumerate([1, 2, 2, 2, 2])]
    d = spark.createDataFrame([(0, [one]), (1, [five]), (2, [five, [(0, "VERB", "root", 0)]]), (3, [])], "id int, dep array<array<struct<i:int,upos:string,rel:string,head:int>>>")
    got = {r["id"]: r for r in pos.with_dependencies(d, "dep").collect()}
    assert got[1]["arc_len_mean"] == 1.25 and got[2]["arc_len_mean"] == 1.25 and got[2]["sentfinal_verb_ratio"] == 0.5
    assert math.isnan(got[3]["arc_len_mean"]) and math.isnan(got[3]["sentfinal_noun_ratio"])


def morphemes(*parts):
    return [{"tag": t, "surface": s, "deriv": d} for t, s, d in parts]


def test_suffix_chains(spark):
    eve = morphemes(("Noun", "ev", False), ("A3sg", "", False), ("Dat", "e", False))
    geldi = morphemes(("Verb", "gel", False), ("Past", "di", False), ("A3sg", "", False))
    books = morphemes(("Noun", "kitap", False), ("Agt", "çı", True), ("Noun", "", False), ("A3pl", "lar", False))
    unknown = morphemes(("Unk", "xx", False))
    d = spark.createDataFrame([([eve, geldi, books, unknown], ["NOUN", "VERB", "NOUN", "X"])], "m array<array<struct<tag:string,surface:string,deriv:boolean>>>, p array<string>")
    r = morphology.with_suffixes(d, "m", "p").first()
    assert r["zeyrek_agglutination_depth"] == pytest.approx(4 / 3, abs=1e-5) and r["zeyrek_plural_ratio"] == pytest.approx(1 / 3, abs=1e-5)
    assert r["zeyrek_tense_past_def_ratio"] == 1 and r["zeyrek_case_dat_ratio"] == pytest.approx(1 / 3, abs=1e-5) and r["zeyrek_derivational_suffix_ratio"] == 0.25
    assert r["zeyrek_suffix_bigram_entropy"] == 0 and math.isnan(r["zeyrek_verb_suffix_diversity"])


def test_kalyoncu_rules():
    assert kalyoncu.spoken_words("%50'si") == ["yüzde", "elli"] and kalyoncu.number_words("3kg") == ["üç"] and kalyoncu.number_words("3m") == ["üç", "metre"]
    read = morphemes(("Verb", "oku", False), ("ByDoingSo", "yarak", True), ("Adv", "", False))
    assert kalyoncu.is_verbal(read) and kalyoncu.stem_of(read, "oku", "okuyarak") == ("oku", True)
    assert kalyoncu.in_list("kitabı", "kitab", False, frozenset(["kitap"])) and kalyoncu.in_list("gelir", "gel", True, frozenset(["gelmek"]))
    rng = random.Random(3)
    for _ in range(30):
        stems = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))]
        for w in (5, 20, 100):
            spans = [stems[i : i + w] for i in range(max(1, len(stems) - w + 1))]
            plain = 100 * sum(v == 1 for s in spans for v in Counter(s).values()) / sum(map(len, spans))
            assert kalyoncu.once_only(stems, w) == pytest.approx(plain)


def test_word_alignment():
    def at(text, tokens, marks):
        return word_tokens(text, tokens, ["PUNCT" if t in marks else "NOUN" for t in tokens], "tr")

    assert at("Türk-Amerikan ilişkisi", ["Türk", "-", "Amerikan", "ilişkisi"], "-") == [0, 3]
    assert at("It's John's book, don't.", ["It", "'s", "John", "'s", "book", ",", "do", "n't", "."], ",.") == [0, 2, 4, 6]
    assert at('"Ev" 3. kat', ['"', "Ev", '"', "3.", "kat"], "") == [1, 3, 4]


def test_counts_of_keys_and_one_full_row(spark):
    assert (len(registry.feature_keys("tr")), len(registry.feature_keys("en")), len(registry.GROUP_LABELS)) == (214, 181, 13)
    tokens = ["Ali", "eve", "geldi", ".", "Okul", "bitti", "."]
    upos = ["PROPN", "NOUN", "VERB", "PUNCT", "NOUN", "VERB", "PUNCT"]
    plain = [[("Noun", t.lower(), False)] for t in tokens]
    dep = [[(0, "PROPN", "nsubj", 2), (1, "NOUN", "obl", 2), (2, "VERB", "root", 2), (3, "PUNCT", "punct", 2)], [(0, "NOUN", "nsubj", 1), (1, "VERB", "root", 1), (2, "PUNCT", "punct", 1)]]
    d = spark.createDataFrame(
        [("Ali eve geldi. Okul bitti.", tokens, upos, ["ali", "ev", "gel", "okul", "bit"], ["Case=Nom"] * 7, plain, dep)],
        "text string, surface_tokens array<string>, upos array<string>, lemma_tokens array<string>, morph_tags array<string>, morpheme_lists array<array<struct<tag:string,surface:string,deriv:boolean>>>, dep_data array<array<struct<i:int,upos:string,rel:string,head:int>>>",
    )
    out = textloom.analyze(d, "tr", word_list=["okul"], warn=False)
    made = [c for c in out.columns if c not in d.columns]
    assert sorted(made) == sorted(registry.feature_keys("tr"))
    r = out.first().asDict()
    assert r["pos_verb_ratio"] == 0.4 and r["lemma_count"] == 5 and r["sent_count"] == 2 and r["case_nom_ratio"] == 1 and r["kalyoncu_ocu"] == 2.5 and r["arc_len_mean"] == 1.25
    for k in made:
        if registry.describe_feature(k)["scale"] == "ratio_0_1":
            assert math.isnan(r[k]) or 0 <= r[k] <= 1, k


def test_empty_texts_and_plans(spark):
    d = rows(spark, ["", None, "x", "!!"])
    groups = ["frequency_structure", "sentence", "paragraph", "phonological", "readability", "punctuation", "chars"]
    out = textloom.analyze(d, "tr", groups, warn=False)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert all(v is not None for k, v in r.asDict().items() if k not in ("id", "text"))
    first = out.orderBy("id").first().asDict()
    assert all(math.isnan(v) for k, v in first.items() if k not in ("id", "text"))


def test_refusals(spark):
    d = rows(spark, ["x"])
    for bad in ({"lang": "de"}, {"groups": ["nothing"]}, {"custom_ngrams": [[]]}, {"params": FeatureParams(mattr_window=0)}):
        with pytest.raises(ValueError):
            textloom.analyze(d, **{"lang": "tr", **bad})
    with pytest.raises(textloom.ModelNotFoundError):
        textloom.analyze(d, "en")
    with pytest.raises(ValueError):
        textloom.analyze(d.withColumnRenamed("id", "ttr"), "tr")
    with pytest.raises(KeyError):
        textloom.describe_feature("nothing")
    assert textloom.describe_feature("char_ğ_ratio")["group"] == "chars" and len(textloom.describe_feature("atesman")) == 12


def test_segments(spark):
    text = "bir iki, üç\n dört beş - altı yedi."
    for size, fill, unit in ((2, 1.0, "word"), (3, 0.3, "word"), (5, 1.0, "char"), (4, 0.5, "char")):
        got = rows(spark, [text]).select(segments_column(F.col("text"), size, fill, unit, "tr").alias("s")).first()["s"]
        assert got == segment_text(text, size, fill, unit, "tr")
    assert segment_text(text, 2)[1] == "üç\n dört" and segment_text("", 3) == []
    with pytest.raises(ValueError):
        segment_text(text, 0)


def test_ngrams(spark):
    d = rows(spark, ["Ha ha ha! Old house. The old house fell.", "", "old\nhouse"])
    from textloom.operators.ngrams import ngram_counts, ngram_matches

    got = ngram_counts(d, [["ha", "ha"], ["old", "house"]], "en").orderBy("id").collect()
    assert [r["ngram_ha_ha_count"] for r in got][0] == 2 and [r["ngram_old_house_count"] for r in got][::2] == [2, 1]
    assert math.isnan(got[1]["ngram_ha_ha_count"])
    assert [(r["match"], r["n"]) for r in ngram_matches(d, ["old", "house"], "en").collect()] == [("old house", 3)]


def test_corpus(spark, tmp_path):
    root = tmp_path / "c"
    (root / "haber").mkdir(parents=True)
    (root / "haber" / "a.txt").write_text("﻿bir iki üç", encoding="utf-8")
    (root / "Roman_Ev_1.txt").write_text("dört beş", encoding="utf-8")
    (root / "tek.txt").write_text("altı", encoding="utf-8")
    got = sorted(tuple(r) for r in textloom.read_corpus(spark, str(root)).collect())
    assert got == [("", "tek", 0, "altı"), ("Roman", "Ev_1", 0, "dört beş"), ("haber", "a", 0, "bir iki üç")]
    (root / "kötü.txt").write_bytes(b"a\xff")
    (root / "haber" / "b.txt").write_bytes(b"\xfe")
    with pytest.raises(textloom.LinguisticFeaturesError, match="2 file|1 file"):
        textloom.read_corpus(spark, str(root)).collect()
    table = tmp_path / "t.tsv"
    table.write_text('etiket\tmetin\nx\t"bir\niki"\n\ty\n', encoding="utf-8")
    assert sorted(tuple(r) for r in textloom.read_corpus(spark, str(table)).collect()) == [("", "t", 0, "y"), ("x", "t", 0, "bir\niki")]
    (tmp_path / "n.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        textloom.read_corpus(spark, str(tmp_path / "n.csv"))
    with pytest.raises(FileNotFoundError):
        textloom.read_corpus(spark, str(tmp_path / "none"))
    textloom.save_csv(textloom.analyze_corpus(spark, str(table), "tr", groups=["punctuation"]), str(tmp_path / "out.csv"))
    assert len((tmp_path / "out.csv").read_text().splitlines()) == 3


def test_stream_equals_batch(spark, tmp_path):
    from textloom.streaming.measures import measure_stream

    d = rows(spark, ["Bir iki.", "Üç dört beş!", ""])
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    measure_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "tr", ["punctuation", "chars"], once=True).awaitTermination()
    batch = textloom.analyze(d, "tr", ["punctuation", "chars"])
    same = lambda x: sorted(map(str, x.collect()))
    assert same(spark.read.parquet(str(tmp_path / "out"))) == same(batch)

# ---- long texts and rewritten rules


def test_sentences_of_long_texts_take_linear_time():
    began = time.time()
    for text in ("kelime " * 1_000_000, ". " * 300_000, "vb. " * 200_000, "Bu bir cümledir. " * 300_000):
        tokens = sentences.rule_tokens(text)
        cut = sentences.spans(tokens, "tr")
        assert cut[0][0] == 0 and cut[-1][1] == len(tokens) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    assert len(cut) == sentences.count(tokens) == 300_000
    assert time.time() - began < 40


def test_one_long_text_through_a_group(spark):
    """A text of 5 MB, 300,000 sentences of three words."""
    row = analyze_text(spark, "Bu bir cümledir. " * 300_000, "tr", groups=["sentence"], warn=False)
    assert row["sent_count"] == 300_000 and row["sent_len_mean"] == 3 and row["question_sent_ratio"] == 0


def walk_code(tokens, kind, lang):
    """The letters of tokens by looking left and right from each token."""
    ends, maybe = vocab.SENTENCE_SETS[kind]
    alnum = lambda t: any(c.isalnum() for c in t)
    out = []
    for i, t in enumerate(tokens):
        if alnum(t):
            out.append("w")
            continue
        ending = any(c in ends for c in t)
        if ending and lang == "tr" and t == ".":
            before = [x for x in tokens[:i] if alnum(x)]
            after = [x for x in tokens[i + 1 :] if alnum(x)]
            if before and readings.tr_abbreviation(before[-1]) is not None:
                ending = not after or after[0][0].isupper()
        elif not ending and any(c in maybe for c in t):
            nxt = tokens[i + 1] if i + 1 < len(tokens) else None
            ending = nxt is None or nxt[0] in vocab.NEW_SENTENCE_OPENERS or (alnum(nxt) and nxt[0].isupper())
        opener = t[0] in vocab.OPENERS_ONLY
        out.append(("E" if opener else "e") if ending else "o" if opener else "m")
    return "".join(out)


def test_sentence_letters_against_a_search_at_each_token():
    rng = random.Random(8)
    some = ["Dr", "vb", "kg", "ev", "Ev", "3", ".", "..", "?", "!", "…", ":", ";", "(", ")", "“", "”", "-", "«", "T.C", "!?"]
    for _ in range(4000):
        tokens = [rng.choice(some) for _ in range(rng.randint(0, 12))]
        for lang in ("tr", "en"):
            for kind in vocab.SENTENCE_SETS:
                letters = walk_code(tokens, kind, lang)
                assert sentences.code(tokens, kind, lang) == letters
                found = list(re.finditer("[^w]*w[^eE]*[eE]", letters))
                assert sentences.count(tokens, kind, lang) == len(found) + ("w" in letters[found[-1].end() if found else 0 :])


def test_mtld_against_the_definition():
    rng = random.Random(9)

    def factors(words):
        n, start = 0.0, 0
        for i in range(len(words)):
            share = len(set(words[start : i + 1])) / (i + 1 - start)
            if share <= 0.72:
                n, start = n + 1, i + 1
        return n + ((1 - share) / 0.28 if start < len(words) else 0)

    for kinds in (2, 30, 300, 5000):
        words = [str(rng.randrange(kinds)) for _ in range(rng.randint(100, 2500))]
        a, b = factors(words), factors(words[::-1])
        want = (len(words) / a + len(words) / b) / 2 if a and b else math.nan
        assert sampled.mtld(words, 0.72, 100) == pytest.approx(want, nan_ok=True)


def test_vocd_finds_the_least_squares():
    rng = random.Random(10)
    p = FeatureParams(vocd_num_samples=20, vocd_num_runs=1)
    words = [str(rng.randrange(150)) for _ in range(400)]
    draw, sizes = random.Random(p.vocd_random_seed), range(p.vocd_sample_min, p.vocd_sample_max + 1)
    shares = [sum(len(set(draw.sample(words, k))) / k for _ in range(20)) / 20 for k in sizes]
    error = lambda d: sum((d / k * (math.sqrt(1 + 2 * k / d) - 1) - s) ** 2 for k, s in zip(sizes, shares, strict=True))
    d = sampled.vocd(words, p)
    assert error(d) <= min(error(d * 1.0001), error(d * 0.9999))
    assert sampled.vocd([str(i) for i in range(100)], p) == pytest.approx(1e5)


@pytest.mark.parametrize("n", [50, 51, 128, 277, 278, 300, 400, 401, 513, 1024, 5000, 70000])
def test_vocd_draws_as_python_does(n):
    """The places that texts of one length share are those of random.sample, and many texts together get what each gets."""
    p = FeatureParams(vocd_num_samples=7, vocd_num_runs=2)
    rng = random.Random(n)
    texts = [[str(rng.randrange(30)) for _ in range(n)], [str(rng.randrange(9000)) for _ in range(n)]]
    draw, sizes = random.Random(p.vocd_random_seed).sample, range(p.vocd_sample_min, p.vocd_sample_max + 1)
    places, widths = sampled._samples(n, p)
    cuts = [0, *itertools.accumulate(widths.tolist())]
    assert [set(places[a:b].tolist()) for a, b in itertools.pairwise(cuts)] == [set(draw(range(n), k)) for _ in range(2) for k in sizes for _ in range(7)]
    assert sampled.vocd_all([*texts, ["a"]], p)[:2] == [sampled.vocd(t, p) for t in texts]
    codes = [sampled._numbered(t) for t in texts]
    draw = random.Random(p.vocd_random_seed).sample
    drawn = [draw(range(n), k) for _ in range(2) for k in sizes for _ in range(7)]
    for c in codes:
        plain = [sum(len(set(c[x].tolist())) for x in drawn[g : g + 7]) for g in range(0, len(drawn), 7)]
        assert sampled._types(c, places, np.repeat(np.arange(len(widths)), widths), 2 * len(sizes), 7) == plain


def test_vocd_of_many_texts_takes_little_time(spark):
    """4,800 samples for each of 400 texts; drawn one by one they took over 20 seconds."""
    rng = random.Random(3)
    texts = [[str(rng.randrange(150)) for _ in range(300 + 5 * (i % 4))] for i in range(400)]
    began = time.process_time()
    found = sampled.vocd_all(texts, FeatureParams())
    assert time.process_time() - began < 6 and not any(map(math.isnan, found))
    df = spark.createDataFrame([(" ".join(t),) for t in texts[:3]] + [(None,)], "text string").coalesce(1)
    out = df.select(sampled.vocd_of_texts(F.col("text"), "en", FeatureParams()).alias("d")).collect()
    assert [r["d"] for r in out[:3]] == found[:3] and out[3]["d"] is None or math.isnan(out[3]["d"])


def test_view_measures_equal_those_of_carried_views(spark):
    """Thematic concentration, word frequency and Kalyoncu's components, taken without sending the view back, are those of
    the view, over analyses of many kinds, empty and null texts; the view is made in portions of tokens."""
    from textloom import queries as Q
    from textloom.functions import alignment as L

    d = Q.analysed(spark, "/root/testdata/sf0.001").limit(60).drop("n_chars")
    null = F.col("doc_id") % 7 == 3
    d = d.withColumns({c: F.when(~null, F.col(c)) for c in d.columns if c != "doc_id"}).localCheckpoint()
    for lang in ("en", "tr"):
        v = d.withColumn("_v", L.view_column(lang, set(d.columns)))
        v = v.withColumns({"_k": kalyoncu.kalyoncu_column(F.col("_v"), Q._KNOWN), "_t": frequency.thematic_columns(F.col("_v.lemmas"), F.col("_v.pos"))})
        w = d.withColumns({"_k": kalyoncu.kalyoncu_of_views(lang, set(d.columns), Q._KNOWN), "_t": frequency.thematic_of_views(lang, set(d.columns))})
        taken = ["doc_id", "_k.*", "_t.*"]
        assert repr(sorted(map(tuple, v.select(taken).collect()))) == repr(sorted(map(tuple, w.select(taken).collect())))
    table = d.select(F.lit("en").alias("lang"), F.explode("lemma_tokens").alias("lemma")).distinct().withColumn("zipf", F.length("lemma") * 1.25)
    v = d.withColumn("_v", L.view_column("en", set(d.columns))).withColumns({"_l": F.col("_v.lemmas"), "_p": F.col("_v.pos")})
    taken = ["doc_id", "wordfreq_mean", "wordfreq_rare_ratio"]
    plain = sorted(map(repr, lexical.word_frequency(v, "doc_id", "_l", "_p", table, "en").select(taken).collect()))
    assert plain == sorted(map(repr, lexical.word_frequency_of_views(d, "doc_id", table, "en").select(taken).collect()))
    assert plain == sorted(map(repr, lexical.word_frequency_of_views(d, "doc_id", table, "en", most=5).select(taken).collect()))


def test_views_are_made_in_portions():
    """A batch of texts isn't turned into Python objects at once: at most 60,000 tokens are, or one text."""
    import pyarrow as pa

    from textloom.functions import alignment as L

    tokens = pa.array([["a"] * n for n in (10, 59_990, 1, 100_000, 5, 5)])
    assert [*L._portions(tokens)] == [(0, 2), (2, 1), (3, 1), (4, 2)]
    morpheme = lambda t: {"tag": t, "surface": None if t == "x" else t, "deriv": False}
    rows = [[[morpheme("a"), morpheme("x")], [], [morpheme("a")]], None, [], [[morpheme("x"), morpheme("a")], [morpheme("a")], [morpheme("a"), morpheme("x")]]]
    made = L.shared_morphemes(pa.array([None, *rows], type=pa.list_(L._M)).slice(1), {})
    assert made == rows and made[0][0] is made[3][2] and made[0][2] is made[3][1]


def test_numbers_are_spelled():
    for n, said in {1_000_000: "bir milyon", 1000: "bin", 2100: "iki bin yüz", 101_001: "yüz bir bin bir", 10**14: "yüz trilyon", 0: "sıfır"}.items():
        assert readings.tr_number(str(n)) == said
    for token, said in {"2005": "two thousand five", "2015": "twenty fifteen", "1900": "nineteen hundred", "1,918": "one thousand nine hundred eighteen", "007": "zero zero seven", "3.14": "three point one four", "0": "zero"}.items():
        assert readings.en_number(token) == said
    assert readings.tr_number("1" + "0" * 15) is None and readings.en_number("1" * 16) is None
    assert readings.tr_time("24:59") == "yirmi dört elli dokuz" and readings.tr_time("3:2") == "üç iki" and readings.tr_time("123.45") is None and readings.tr_time("9.05") == "dokuz sıfır beş"


def test_chunks_of_long_texts(spark):
    rng = random.Random(11)

    def plain(text, most):
        out, at = [], 0
        while len(text) - at > most:
            cut = next((i + len(e) for e in ("\n\n", "\n", ". ", " ") if (i := text.rfind(e, at, at + most)) >= 0), at + most)
            out.append(text[at:cut])
            at = cut
        return [c for c in [*out, text[at:]] if c.strip()]

    for _ in range(300):
        text = "".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "x" * 30, "é"]) for _ in range(rng.randint(0, 60)))
        most = rng.choice([1, 2, 10, 25, 500])
        assert segments.chunk_text(text, most) == (plain(text, most) if len(text) > most else [text])
    d = rows(spark, ["a b c", None]).select(segments.chunks_column(F.col("text"), 2).alias("c"))
    assert [r["c"] for r in d.collect()] == [["a ", "b ", "c"], None]


def test_workflows(spark):
    d = spark.createDataFrame([("a", 1.0, 5.0, 10.0), ("a", 2.0, 5.0, 30.0), ("b", math.nan, 5.0, 0.0)], "label string, x double, y double, n double")
    assert workflows.varying(d, ["x", "y"]) == ["x"]
    one, two = d.limit(1).select("x", "y"), spark.createDataFrame([(4.0, math.nan)], "x double, y double")
    assert [tuple(r) for r in workflows.compare(one, two, ["x", "y"]).collect()] == [("x", 1.0, 4.0, 3.0)]
    assert [tuple(r) for r in workflows.differences(d, d.withColumn("y", F.when(F.col("n") == 30, 6.0).otherwise(F.col("y"))), ["label", "n"], ["x", "y"]).collect()] == [("a", 30.0, "y")]
    rates = {(r["label"], r["phrase"]): (r["n"], r["rate"]) for r in workflows.phrase_rates(d, "label", "n", ["x", "y"]).collect()}
    assert rates == {("a", "x"): (3.0, 75.0), ("a", "y"): (10.0, 250.0), ("b", "y"): (5.0, None)}


def test_spread_at_its_limit_in_any_order(spark):
    """0.12 / 0.8 is the limit itself, 0.22 / 0.853333 lies half-way between two numbers of six digits."""
    texts = [(0.8, 0.86, 0.74), (0.9, 0.94, 0.72)]
    orders = [(i, p) for i, x in enumerate(texts) for p in itertools.permutations(x)]
    m = spark.createDataFrame([(k, i, v) for k, (i, p) in enumerate(orders) for v in p], "id int, kind int, ttr double").coalesce(1)
    out = workflows.length_sensitivity(m, "id", ["ttr"]).select("id", T.rounded(F.col("spread"), 6).alias("spread"), "robust").collect()
    assert {(orders[r["id"]][0], r["spread"], r["robust"]) for r in out} == {(0, 0.15, False), (1, 0.257813, False)}
    zero = workflows.length_sensitivity(spark.createDataFrame([(1, 0.0), (1, 0.0)], "id int, ttr double"), "id", ["ttr"]).first()
    assert zero["spread"] is None and zero["robust"] is None


def test_spreads_near_a_limit_are_the_sqls(spark, tmp_path):
    """Shares of types 0.8, 0.86 and 0.9 give a spread of 0.1171875, half-way between two numbers of six digits; as a quotient
    of doubles it is below in any order, for SQL too."""
    import duckdb
    from textloom import queries as Q

    def text(*types: int) -> str:
        """10, 50 and 100 words with so many types."""
        words, known = [], 0
        for size, v in zip((10, 50, 100), types, strict=True):
            new = [f"w{i}" for i in range(known, v)]
            words += new + ["w0"] * (size - len(words) - len(new))
            known = v
        return " ".join(words)

    rows = [(1, text(8, 43, 90)), (2, text(9, 43, 80)), (3, text(10, 50, 100)), (4, text(8, 45, 86)), (5, "too short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {(r["doc_id"], r["measure"]): (r["spread"], r["robust"]) for r in Q.length_sensitivity(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in out.items() if k[1] == "ttr"} == {(1, "ttr"): (0.117187, True), (2, "ttr"): (0.117187, True), (3, "ttr"): (0.0, True), (4, "ttr"): (0.117187, True)}
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert out == {(k, m): (s, r) for k, m, s, r in sql.execute(Q.SQL["length_sensitivity"]).fetchall()}


def test_spread_of_ordered_lengths(spark):
    """Values are added from the shortest length on, whatever the order of the rows; NaN and null are left out."""
    values = [(10, 0.74), (50, 0.8), (100, 0.86)]
    rows = [(k, n, v) for k, p in enumerate(itertools.permutations(values)) for n, v in p]
    rows += [(7, 10, 0.8), (7, 50, math.nan), (7, 100, None), (8, 10, math.nan), (9, 10, None), (10, 10, 0.0)]
    m = spark.createDataFrame(rows, "id int, size int, ttr double")
    out = {r["id"]: (r["spread"], r["robust"]) for r in workflows.length_sensitivity(m, "id", ["ttr"], size="size").collect()}
    spread = (0.86 - 0.74) / ((0.74 + 0.8 + 0.86) / 3)
    assert out == dict.fromkeys(range(6), (spread, spread < 0.15)) | {7: (0.0, True), 9: (None, None), 10: (None, None)}


def test_files_that_are_not_utf8_are_named(spark, tmp_path):
    for name, raw in {"a_x.txt": b"fine", "b_y.txt": b"ab\xff", "c_z.txt": "é".encode() + b"\xc3"}.items():
        (tmp_path / name).write_bytes(raw)
    with pytest.raises(errors.LinguisticFeaturesError) as e:
        corpus.read_folder(spark, str(tmp_path))
    said = str(e.value)
    assert "2 file(s)" in said and "b_y.txt (byte 2)" in said and "c_z.txt (byte 2)" in said and "a_x" not in said


def test_heads_with_gaps_and_circles(spark):
    """Depths and distances against a walk, for token numbers that aren't in a row, unknown heads and circles."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        made = []
        for _ in range(rng.randint(0, 3)):
            n = rng.randint(1, 9)
            ids = list(range(5, 5 + n)) if rng.random() < 0.5 else rng.sample(range(40), n)
            made.append([(i, rng.choice(["NOUN", "VERB", "PUNCT"]), "dep", rng.choice([*ids, 99]) if rng.random() < 0.9 else i) for i in ids])
        texts.append(made)

    def plain(made):
        arcs, depths = [], []
        for s in made:
            head, words = {i: h for i, _, _, h in s}, [i for i, p, _, _ in s if p != "PUNCT"]
            far = [abs(words.index(i) - words.index(head[i])) for i in words if head[i] != i and head[i] in words]
            deep = []
            for i in words:
                if head[i] == i:
                    continue
                at, seen = i, {i}
                while len(seen) <= 20 and at in head and head[at] not in seen:
                    at = head[at]
                    seen.add(at)
                deep.append(len(seen) - 1)
            arcs += [sum(far) / len(far)] if far else []
            depths += [sum(deep) / len(deep)] if deep else []
        mean = lambda x: round(sum(x) / len(x), 5) if x else None
        return mean(arcs), mean(depths)

    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, dep array<array<struct<i: int, upos: string, rel: string, head: int>>>")
    got = {r["id"]: tuple(None if math.isnan(v) else v for v in (r["arc_len_mean"], r["parse_depth_mean"])) for r in pos.with_dependencies(d, "dep").collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain(t), abs=2e-5, nan_ok=True) if None not in plain(t) else got[i] == plain(t), (i, t)


def test_one_pass_is_the_columns(spark, tmp_path):
    """The matrix of one pass is analyze's, on all kinds of texts; and what is kept of chunks changes nothing."""
    from textloom.functions import one_pass
    from textloom.queries import QUERIES

    rng = random.Random(11)
    parts = "ev Evler İSTANBUL ışık IŞIK Dr. dr Sn MS 3. 3., 12:30 1.500,5 1999 %5 5% $ & €20 a²b 10km 5m TBMM'de o'nun km/s m² x-y A.B. vb. kâğıt … ... .. ? ! ?! : ; , « » “Ali” (bak) [1] — - ' ’ don't".split()
    parts += ["end.Next", "www.a.com/b", "son?(", "!?\")", "of", "the", "ÀÉ", "ǅ", "中文", "Ⅷ", "½", "ev%%%", "son.&&", "ntl$$", "NTL$", "dr%", "dr.", "vb.%", "m%", "a.%", "iki-%", "\u0301a", "σΣ", "🙂", "a🙂b", "_", "a_b", "***", "word.###", "...a", "a...", "'a'", "''", "\n\n", "\n \t\n", "\r\n\r\n", "\u00a0", "\u2028"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.choice((1, 3, 12, 60, 300)))) for _ in range(60)]
    texts += ["".join(rng.choice("aEıİI.,?! :;'’-(\n3%…“") for _ in range(rng.choice((4, 40, 400)))) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(3000)}." for _ in range(3000)), "ev " * 150, " ".join("abcçdefgğhıi"), "", None, " \n", "...", "3.", "3. ", "a: b", "a: B", "a. b", "Dr. Ali", "ev.", ".ev"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r.asDict() for r in QUERIES["corpus_feature_matrix"](spark, str(tmp_path)).collect()}
    groups = ["lexical", "frequency_structure", "sentence", "paragraph", "phonological", "readability", "punctuation", "chars"]
    whole = textloom.analyze(spark.read.parquet(f"{tmp_path}/documents.parquet"), "tr", groups, warn=False)
    missing = set(whole.columns) - set(next(iter(found.values())))
    assert missing == {"text", *TAGGED_LEXICAL, "wordfreq_mean", "wordfreq_rare_ratio", "vocd_d"}
    null = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    wanted = {r["doc_id"]: {k: null(v) for k, v in r.asDict().items() if k not in missing} for r in whole.collect()}
    for i, t in enumerate(texts):
        wrong = {k: (found[i][k], v) for k, v in wanted[i].items() if found[i][k] != v}
        assert not wrong, (i, t, wrong)
    few, fresh = one_pass.Measurer(), [one_pass.Measurer()(t) for t in texts]
    for _ in range(2):
        again = []
        for i, t in enumerate(texts):
            if i % 7 == 0:
                few._forget()
            again.append(few(t))
        assert all(a == pytest.approx(b, abs=0, rel=0, nan_ok=True) for a, b in zip(again, fresh, strict=True))


def test_one_pass_takes_little_time():
    """Three hundred texts of new words; the matrix took over 80 milliseconds of CPU for each text of sf0.1."""
    from textloom.functions import one_pass

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) + rng.choice(("", "", "", ".", ",")) for _ in range(300)) for _ in range(300)]
    measure = one_pass.Measurer()
    began = time.process_time()
    assert all(measure(t)["word_count"] == 300 for t in texts)
    assert time.process_time() - began < 3


def test_python_gets_narrow_rows(spark, tmp_path):
    """Spark keeps the rows that wait for Python with all their columns: none of them is a working column."""
    from textloom.queries import QUERIES

    texts = ["Ali of the eve geldi. 3. kez mi? " * 4, "", None]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["corpus_feature_matrix"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
        if node.nodeName().startswith("ArrowEvalPython"):
            out = node.child().output()
            found.append({out.apply(i).name() for i in range(out.size())})
    assert found and all(c <= {"doc_id", "text", "source", "folds", "_text"} for c in found)
