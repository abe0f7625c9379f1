"""The features: keys by group in the order of their columns, and what is known about each."""

from __future__ import annotations

import re

from ..operators import frequency, kalyoncu, lexical, morphology, phonology, pos, punctuation, readability, sentence
from ..vocab import ALPHABETS, check_lang

GROUP_LABELS = {
    "lexical": "Lexical richness and frequency", "frequency_structure": "Frequency structure", "sentence": "Sentences", "paragraph": "Paragraphs", "pos": "Parts of speech",
    "syntactic": "Dependencies", "morphological": "Morphological features of tags", "morphological_zeyrek": "Turkish suffix chains", "phonological": "Sounds and syllables",
    "readability": "Readability", "punctuation": "Punctuation and orthography", "chars": "Letters", "custom_ngrams": "Phrases of the caller",
}
TURKISH_ONLY = frozenset((*phonology.HARMONY_KEYS, *readability.TURKISH_KEYS, *kalyoncu.KEYS, *morphology.SUFFIX_KEYS))
ENGLISH_ONLY = frozenset((*readability.ENGLISH_KEYS, "ari", "coleman_liau", "lix"))
GROUP_KEYS = {
    "lexical": lexical.KEYS,
    "frequency_structure": frequency.KEYS,
    "sentence": sentence.KEYS,
    "paragraph": sentence.PARAGRAPH_KEYS,
    "pos": pos.KEYS,
    "syntactic": pos.DEPENDENCY_KEYS,
    "morphological": morphology.KEYS,
    "morphological_zeyrek": morphology.SUFFIX_KEYS,
    "phonological": (*phonology.VOWEL_KEYS, *phonology.HARMONY_KEYS, *phonology.SYLLABLE_KEYS),
    "readability": (*readability.GENERAL_KEYS["en"], *readability.TURKISH_KEYS, *kalyoncu.KEYS, *readability.ENGLISH_KEYS),
    "punctuation": punctuation.KEYS,
}
#: Annotation columns that a group can't do without.
GROUP_NEEDS = {"pos": "tags", "syntactic": "dep_data", "morphological": "morph_tags", "morphological_zeyrek": "morpheme_lists"}

_RAW, _SENT, _TAGS = ("raw_text",), ("raw_text", "surface_tokens"), ("raw_text", "surface_tokens", "pos_data")
_LEMMAS = ("raw_text", "surface_tokens", "lemma_tokens", "pos_data")
GROUP_INPUTS = {
    "lexical": _RAW, "frequency_structure": _LEMMAS, "sentence": _SENT, "paragraph": _RAW, "pos": _TAGS, "syntactic": ("dep_data",), "morphological": (*_TAGS, "morph_tags"),
    "morphological_zeyrek": (*_TAGS, "morpheme_lists"), "phonological": _RAW, "readability": _SENT, "punctuation": _RAW, "chars": _RAW, "custom_ngrams": _LEMMAS,
}
FEATURE_INPUTS = {
    **dict.fromkeys(("lemma_count", "noun_variation", "verb_variation", "adj_variation", "adv_variation", "wordfreq_mean", "wordfreq_rare_ratio", "surface_per_lemma"), _LEMMAS),
    **dict.fromkeys(("zipf_exponent", "zipf_r2", "zipf_mandelbrot_q", "zipf_mandelbrot_s", "polysyllabic_word_ratio", "long_word_ratio"), _RAW),
    **dict.fromkeys(("sent_len_char_mean", "question_sent_ratio"), ("surface_tokens",)), **dict.fromkeys(("sents_per_para_mean", "sent_syllable_mean"), _SENT),
    "lexical_density": _TAGS, **dict.fromkeys(kalyoncu.KEYS, (*_LEMMAS, "morpheme_lists")),
}
GROUP_SCALES = {"sentence": "length", "paragraph": "length", "readability": "score", "custom_ngrams": "count"}
_SCALES = {
    "count": "lemma_count word_count sent_count char_count type_count hapax_count dislegomena_count para_count syllable_count punct_count punct_variety zeyrek_verb_suffix_diversity",
    "length": "word_len_mean verb_dist_mean arc_len_mean parse_depth_mean zeyrek_agglutination_depth syllable_mean sent_syllable_mean kalyoncu_ocu",
    "nats": "entropy sent_len_entropy posdiv zeyrek_suffix_bigram_entropy punct_entropy",
    "ratio_0_1": "short_sent_ratio long_sent_ratio question_sent_ratio polysyllabic_word_ratio long_word_ratio",
    "score": "yule_k brunet_w mtld dugast_u guiraud_r cttr summer_s maas_a2 herdan_vm honore_r vocd_d heaps_beta wordfreq_mean zipf_exponent zipf_mandelbrot_q zipf_mandelbrot_s h_point "
    "curve_length lambda_pa adjusted_modulus writers_view_alpha thematic_concentration secondary_thematic_concentration surface_per_lemma",
}
FEATURE_SCALES = {k: scale for scale, keys in _SCALES.items() for k in keys.split()} | {"question_sent_ratio": "ratio_0_1"}
FEATURE_PARAMS = {
    "mattr": ("mattr_window",), "mtld": ("mtld_threshold", "mtld_min_tokens"), "hdd": ("hdd_sample_size",), "msttr": ("msttr_segment_size",),
    "vocd_d": ("vocd_sample_min", "vocd_sample_max", "vocd_num_samples", "vocd_num_runs", "vocd_min_tokens", "vocd_random_seed"), "brunet_w": ("brunet_w_a", "brunet_w_b"),
    "heaps_beta": ("heaps_points",), "zeyrek_verb_suffix_diversity": ("verb_suffix_window", "verb_suffix_num_samples", "verb_suffix_random_seed"),
    "short_sent_ratio": ("short_sent_threshold",), "long_sent_ratio": ("long_sent_threshold",), "parse_depth_mean": ("max_parse_depth",),
    **dict.fromkeys(("kalyoncu_ttr", "kalyoncu_k1", "kalyoncu_k2", "kalyoncu_k3"), ("kalyoncu_ttr_window",)),
}

#: Formulas: N words, V types, V1 and V2 types that stand once and twice, f frequencies, r ranks, p = f/N, h the h-point.
FORMULAS = {
    "lemma_count": "distinct lemmas", "word_count": "N", "word_len_mean": "mean code points of a word", "entropy": "-sum p ln p", "yule_k": "10^4 (sum f^2 - N) / N^2",
    "simpson_d": "sum f(f-1) / (N(N-1))", "ttr": "V / N", "type_count": "V", "hapax_count": "V1", "dislegomena_count": "V2", "brunet_w": "N^((V-b)^-a)", "hapax_ratio": "V1 / V",
    "hapax_token_ratio": "V1 / N", "mattr": "mean V/N of all windows", "herdan_c": "ln V / ln N", "mtld": "mean words per factor, forward and backward",
    "dugast_u": "(ln N)^2 / (ln N - ln V)", "guiraud_r": "V / sqrt N", "cttr": "V / sqrt 2N", "summer_s": "ln ln V / ln ln N", "maas_a2": "(ln N - ln V) / (ln N)^2",
    "herdan_vm": "sqrt(sum p^2 - 1/V)", "honore_r": "100 ln N / (1 - V1/V)", "heaps_beta": "slope of ln V(n) on ln n", "sichel_s": "V2 / V",
    "noun_variation": "noun types / content words", "verb_variation": "verb types / verbs", "adj_variation": "adjective types / content words", "adv_variation": "adverb types / content words",
    "wordfreq_mean": "mean Zipf score of content lemmas", "wordfreq_rare_ratio": "content lemmas scored 3 or less", "vocd_d": "D of TTR(n) = (D/n)(sqrt(1 + 2n/D) - 1)",
    "hdd": "mean chance of a type in a sample of 42", "msttr": "mean V/N of full segments", "lexical_density": "content words / words",
    "zipf_exponent": "slope of ln f on ln r", "zipf_r2": "R2 of that line", "zipf_mandelbrot_q": "q of ln f on ln(r + q)", "zipf_mandelbrot_s": "slope at that q",
    "h_point": "where f(r) = r, interpolated", "vocab_richness_r1": "1 - (F(floor h) - h^2 / 2N)", "vocab_richness_r4": "1 - Gini", "repeat_rate": "sum p^2",
    "rr_mcintosh": "(1 - sqrt RR) / (1 - 1/sqrt V)", "gini_coef": "(V + 1 - 2 sum r p) / V", "curve_length": "L = sum sqrt((f(r) - f(r+1))^2 + 1)", "curve_length_r": "1 - L(h) / L",
    "lambda_pa": "L ln N / N", "adjusted_modulus": "sqrt(f(1)^2 + V^2) / h / ln N", "writers_view_alpha": "angle at (h, h) to (1, f(1)) and (V, 1)",
    "thematic_concentration": "sum 2(h - r) f / (h(h-1) f(1)), content words above h", "secondary_thematic_concentration": "sum (2h - r) f / (h(2h-1) f(1))",
    "sent_len_mean": "mean words of a sentence", "sent_len_median": "median words of a sentence", "sent_count": "sentences with a letter", "sent_len_char_mean": "mean code points of a sentence",
    "short_sent_ratio": "sentences below the short limit", "long_sent_ratio": "sentences above the long limit", "sent_len_entropy": "entropy of sentence lengths",
    "question_sent_ratio": "sentences that end in a question mark", "para_count": "paragraphs", "para_len_mean": "words / paragraphs", "sents_per_para_mean": "sentences / paragraphs",
    "pronoun_ratio": "pronouns / words", "verb_dist_mean": "mean distance of neighbouring verbs", "activity_ratio": "verbs / (verbs + adjectives)", "posddev": "deviation of the twelve tag shares",
    "posdiv": "mean divergence of sentences' tags from the text's", "arc_len_mean": "mean distance to the head", "parse_depth_mean": "mean steps to the root",
    "surface_per_lemma": "distinct (lemma, form) / lemmas", "voice_pass_ratio": "passive verbs / verbs", "vowel_ratio": "vowels / letters", "front_vowel_ratio": "front vowels / letters",
    "back_vowel_ratio": "back vowels / letters", "harmony_fronting_ratio": "words all front or all back", "harmony_rounding_ratio": "words that keep rounding harmony",
    "syllable_count": "syllables", "syllable_mean": "syllables / readable words", "sent_syllable_mean": "syllables / sentences", "long_word_ratio": "words of seven letters or more",
    "ari": "4.71 strokes/words + 0.5 words/sentences - 21.43", "coleman_liau": "5.88 letters/words - 29.6 sentences/words - 15.8", "lix": "words/sentences + 100 long/words",
    "atesman": "198.825 - 40.175 syllables/word - 2.610 words/sentence", "cetinkaya_uzun": "118.823 - 25.987 syllables/word - 0.971 words/sentence",
    "bezirci_yilmaz": "sqrt(words/sentence (0.84 H3 + 1.5 H4 + 3.5 H5 + 26.25 H6))", "flesch_reading_ease": "206.835 - 1.015 words/sentence - 84.6 syllables/word",
    "flesch_kincaid_grade": "0.39 words/sentence + 11.8 syllables/word - 15.59", "smog": "3.1291 + 1.0430 sqrt(30 poly / sentences)", "polysyllabic_word_ratio": "words of three syllables or more",
    "kalyoncu_kl": "words off the list, percent", "kalyoncu_ttr": "stems that stand once in a window, percent", "kalyoncu_kco": "complex sentences, percent",
    "kalyoncu_yco": "verbals per ten sentences", "kalyoncu_ocu": "words per sentence", "kalyoncu_k1": "-29.829 + .508 KL + 1.191 TTR + .733 KCO - .66 OCU",
    "kalyoncu_k2": "25.457 + .877 KL + .668 TTR + .333 OCU", "kalyoncu_k3": "25.153 + .834 KL + .686 TTR + .226 YCO", "kalyoncu_k4": "43.368 + 1.008 KL + .624 OCU",
    "char_count": "code points", "digit_ratio": "decimal digits / code points", "punct_count": "marks", "punct_char_ratio": "marks / code points", "punct_entropy": "entropy of the kinds of marks",
    "consecutive_punct_ratio": "marks next to a mark / marks", "whitespace_ratio": "white space / code points", "punct_variety": "kinds of marks", "uppercase_ratio": "words that begin with a capital",
    "all_caps_word_ratio": "words of two capitals or more and nothing else",
}
_FAMILIES = (
    (r"pos_(\w+)_ratio", "words tagged {} / words"), (r"sentfinal_(\w+)_ratio", "sentences whose last word is tagged {}"), (r"punct_(\w+)_ratio", "{} marks / marks"),
    (r"char_(.)_ratio", "the letter {} / letters"), (r"syllable_(\w+)_ratio", "words of {} syllables / readable words"), (r"ngram_(.+)_count", "matches of the phrase {}"),
    (r"(tense|aspect|case|person|number)_(\w+)_ratio", "words with {}={} / words with {}"), (r"zeyrek_(\w+)", "suffix measure: {}"),
)
CITATIONS = {
    "yule_k": "Yule 1944", "simpson_d": "Simpson 1949", "brunet_w": "Brunet 1978", "mattr": "Covington & McFall 2010", "herdan_c": "Herdan 1960", "herdan_vm": "Herdan 1955",
    "mtld": "McCarthy & Jarvis 2010", "dugast_u": "Dugast 1978", "guiraud_r": "Guiraud 1954", "cttr": "Carroll 1964", "summer_s": "Somers 1966", "maas_a2": "Maas 1972",
    "honore_r": "Honoré 1979", "heaps_beta": "Heaps 1978", "sichel_s": "Sichel 1975", "vocd_d": "Malvern & Richards 1997", "hdd": "McCarthy & Jarvis 2007", "msttr": "Johnson 1944",
    "entropy": "Shannon 1948", "zipf_exponent": "Zipf 1949", "zipf_r2": "Zipf 1949", "zipf_mandelbrot_q": "Mandelbrot 1953", "zipf_mandelbrot_s": "Mandelbrot 1953", "h_point": "Popescu et al. 2009",
    "gini_coef": "Popescu et al. 2009", "curve_length": "Popescu et al. 2009", "lambda_pa": "Popescu et al. 2011", "adjusted_modulus": "Popescu et al. 2009", "writers_view_alpha": "Popescu et al. 2009",
    "thematic_concentration": "Popescu et al. 2009", "atesman": "Ateşman 1997", "cetinkaya_uzun": "Çetinkaya 2010", "bezirci_yilmaz": "Bezirci & Yılmaz 2010", "flesch_reading_ease": "Flesch 1948",
    "flesch_kincaid_grade": "Kincaid et al. 1975", "smog": "McLaughlin 1969", "ari": "Smith & Senter 1967", "coleman_liau": "Coleman & Liau 1975", "lix": "Björnsson 1968", **dict.fromkeys(kalyoncu.KEYS, "Kalyoncu 2025"),
}
#: What a sentence, word or syllable is for a group or key.
DEFINITIONS = {
    "default": "sentences end at . ? ! … and, before a new sentence, at :", "kincaid": "the default's marks and ;", "cetinkaya": "the default's marks, brackets and every :", "parser": "the parser's sentences",
    "space_unit": "what stands between white space, without marks at its edges, with a letter or digit", "space_unit_with_symbols": "space units and symbols that are read aloud",
    "token": "a model's token that isn't a mark", "analysed": "a word with a morphological analysis", "vowel_count": "vowels of the word as it is read", "dictionary": "a pronouncing dictionary",
}
GROUP_DEFINITIONS = {
    "sentence": {"sentence": "default", "word": "space_unit"}, "syntactic": {"sentence": "parser", "word": "token"}, "custom_ngrams": {"sentence": "default", "word": "space_unit"},
    "morphological_zeyrek": {"word": "analysed"}, **{g: {"word": "space_unit"} for g in ("lexical", "frequency_structure", "paragraph", "pos", "morphological", "readability", "phonological")},
}
FEATURE_DEFINITIONS = {
    **dict.fromkeys(("atesman", "bezirci_yilmaz", "smog"), {"sentence": "default", "word": "space_unit", "syllable": "per_language"}),
    "cetinkaya_uzun": {"sentence": "cetinkaya", "word": "space_unit_with_symbols", "syllable": "per_language"}, "ari": {"sentence": "default", "word": "space_unit_with_symbols"},
    **dict.fromkeys(("flesch_reading_ease", "flesch_kincaid_grade"), {"sentence": "kincaid", "word": "space_unit_with_symbols", "syllable": "per_language"}),
    **dict.fromkeys(("coleman_liau", "lix"), {"sentence": "default", "word": "space_unit"}), **dict.fromkeys(phonology.SYLLABLE_KEYS, {"word": "space_unit", "syllable": "per_language"}),
}
SYLLABLE_OF = {"tr": "vowel_count", "en": "dictionary"}


def group_keys(group: str, lang: str) -> list[str]:
    """Static keys and letters of a group in one language; a group that a language lacks is empty."""
    check_lang(lang)
    if group == "chars":
        return punctuation.letter_keys(lang)
    other = TURKISH_ONLY if lang == "en" else ENGLISH_ONLY
    return [k for k in GROUP_KEYS.get(group, ()) if k not in other]


def feature_keys(lang: str, groups: list[str] | None = None) -> list[str]:
    """All keys of a language in column order."""
    return [k for g in groups or GROUP_LABELS for k in group_keys(g, lang)]


def check_groups(groups: list[str] | None) -> None:
    if unknown := [g for g in groups or () if g not in GROUP_LABELS]:
        raise ValueError(f"Unknown group(s): {unknown}. Available: {list(GROUP_LABELS)}")


def get_group(key: str) -> str:
    """The group of a key; KeyError for one that doesn't exist."""
    for group, keys in GROUP_KEYS.items():
        if key in keys:
            return group
    if (m := re.fullmatch("char_(.)_ratio", key)) and m[1] in "".join(ALPHABETS.values()):
        return "chars"
    if re.fullmatch("ngram_.+_count", key):
        return "custom_ngrams"
    raise KeyError(f"Unknown feature key: {key!r}")


def _formula(key: str) -> str:
    if key in FORMULAS:
        return FORMULAS[key]
    for pattern, said in _FAMILIES:
        if m := re.fullmatch(pattern, key):
            parts = [x.replace("_ratio", "").replace("_", " ") for x in m.groups()]
            return said.format(*(parts + parts[:1] if said.count("{}") > len(parts) else parts))
    return key


def describe_feature(key: str, lang: str | None = None) -> dict:
    """What is known about a feature, in twelve fields; `lang` picks the language's own definitions."""
    if lang is not None:
        check_lang(lang)
    group = get_group(key)
    words = FEATURE_DEFINITIONS.get(key, GROUP_DEFINITIONS.get(group, {}))

    def told(name: str):
        if name != "per_language":
            return {"name": name, "description": DEFINITIONS[name]}
        own = lang or ("tr" if key in TURKISH_ONLY else "en" if key in ENGLISH_ONLY else None)
        each = {x: {"name": n, "description": DEFINITIONS[n]} for x, n in SYLLABLE_OF.items()}
        return each[own] if own else each

    needs = GROUP_NEEDS.get(group) or ("tags" if FEATURE_INPUTS.get(key) in (_LEMMAS, _TAGS) else "text")
    citation = CITATIONS.get(key)
    return {
        "key": key, "group": group, "group_label": GROUP_LABELS[group], "description": f"{GROUP_LABELS[group]}: {_formula(key)}", "formula": _formula(key),
        "scale": FEATURE_SCALES.get(key) or GROUP_SCALES.get(group, "ratio_0_1"), "inputs": FEATURE_INPUTS.get(key) or GROUP_INPUTS[group], "params": FEATURE_PARAMS.get(key, ()),
        "requires": needs, "citation": citation, "references": (citation,) if citation else (), "definitions": {t: told(n) for t, n in words.items()},
    }


def registry_frame(spark):
    """The registry as a DataFrame: key, group, scale, formula, citation, inputs, params, and the languages that have it."""
    rows = []
    for g in GROUP_LABELS:
        for k in dict.fromkeys([*group_keys(g, "tr"), *group_keys(g, "en")]):
            d = describe_feature(k)
            rows.append((k, g, d["scale"], d["formula"], d["citation"], list(d["inputs"]), list(d["params"]), [x for x in ("tr", "en") if k in group_keys(g, x)]))
    return spark.createDataFrame(rows, "key string, `group` string, scale string, formula string, citation string, inputs array<string>, params array<string>, languages array<string>")
