"""Alphabets, tag sets, sentence marks. No Spark here."""

from __future__ import annotations

# Fixed values that results depend on.
ALPHABETS = {"tr": "abcçdefgğhıijklmnoöprsştuüvyz", "en": "abcdefghijklmnopqrstuvwxyz"}
VOWELS = {"tr": "aeıioöuü", "en": "aeiou"}
FRONT_VOWELS = {"tr": "eiöü", "en": "ei"}
BACK_VOWELS = {"tr": "aıou", "en": "aou"}
SYLLABLE_VOWELS_TR = "aeıioöuüâîû"
COLUMN_POS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV", "DET", "ADP", "INTJ", "CCONJ", "SCONJ", "NUM", "AUX")
FINAL_POS = (*COLUMN_POS, "PRON")
UPOS = frozenset("ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split())
NON_WORD_POS = ("PUNCT", "SYM")
NOUN_POS = ("NOUN", "PROPN")
CONTENT_POS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
EDGE_MARKS = ".,;:!?…\"'“”‘’«»()[]{}–—-/*"
SYMBOLS = "%$€£₺¢&+−=°§@×÷<>±"
SENTENCE_SETS = {"default": (".?!…", ":"), "kincaid": (".?!;…", ":"), "cetinkaya": (".?!:()…", "")}
NEW_SENTENCE_OPENERS = "\"'“”‘’«»‹›—–-(["
OPENERS_ONLY = "“‘«‹([—–-"
CLOSERS = "\"'“”‘’«»‹›)]}"
LONG_WORD_LETTERS = 7
SMOG_LEAST_SENTENCES = 30
BEZIRCI = {3: 0.84, 4: 1.5, 5: 3.5, 6: 26.25}
SENTENCE_LENGTHS = {"tr": (4, 17), "en": (8, 32)}
#: What counts as white space, as the inside of a character class.
SPACE_CLASS = "\\x09-\\x0D\\x1C-\\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Rule tokens: numbers with inner marks, words with inner apostrophes or hyphens, runs of dots, single marks.
TOKEN = r"\p{N}+[:.,]\p{N}+|[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|\.{2,}|[^" + SPACE_CLASS + r"\p{L}\p{N}]"


def check_lang(lang: str) -> None:
    if lang not in ALPHABETS:
        raise ValueError(f"Unsupported language: {lang!r}. Expected one of: {sorted(ALPHABETS)}")


def lower_for(text: str, lang: str) -> str:
    """Lower case by the language's own rule: in Turkish, I goes to ı and İ to i."""
    return (text.replace("I", "ı").replace("İ", "i") if lang == "tr" else text).lower()
