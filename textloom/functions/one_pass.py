"""All measures of a text that need no model, under Turkish rules, in one pass of Python: analyze's, voc-D aside.

No step crosses white space but sentences and ordinals. So what a white-space chunk is worth (its word, syllables, letters,
marks, tokens) is found once and kept in a row of numbers; a text is the numbers of its chunks, and most measures are sums of
their rows. Sentences are walked over the chunks with marks; of stretches without marks only both ends matter to the rules.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import frequency, kalyoncu, phonology, punctuation, readability, sentence
from ..params import DEFAULT, FeatureParams, sentence_thresholds
from ..vocab import ALPHABETS, BACK_VOWELS, BEZIRCI, EDGE_MARKS, FRONT_VOWELS, LONG_WORD_LETTERS, NEW_SENTENCE_OPENERS, OPENERS_ONLY, SENTENCE_SETS, SYLLABLE_VOWELS_TR, SYMBOLS, VOWELS, lower_for
from . import sampled
from . import sentences as S
from .readings import SYMBOL_READINGS, TR_ABBREVIATIONS, TR_EXACT, tr_abbreviation
from .syllables import Counter

LANG = "tr"
NAN = math.nan
#: Measures that need annotations.
MISSING = (*frequency.KEYS[4:], *kalyoncu.KEYS)
#: The lexical measures of words alone.
LEXICAL = (
    "heaps_beta", "word_count", "type_count", "hapax_count", "dislegomena_count", "word_len_mean", "ttr", "entropy", "yule_k", "simpson_d", "brunet_w", "hapax_ratio",
    "hapax_token_ratio", "sichel_s", "herdan_c", "dugast_u", "guiraud_r", "cttr", "summer_s", "maas_a2", "herdan_vm", "honore_r", "hdd", "msttr", "mattr", "mtld",
)
KEYS = (
    *frequency.KEYS[:4], *sentence.KEYS, *sentence.PARAGRAPH_KEYS, *phonology.VOWEL_KEYS, *phonology.HARMONY_KEYS, *phonology.SYLLABLE_KEYS,
    *readability.GENERAL_KEYS[LANG], *readability.TURKISH_KEYS, *punctuation.KEYS, *punctuation.letter_keys(LANG), *LEXICAL,
)
#: Names of the fields in a struct, where the letters i and ı would be taken for one.
FIELDS = {k: f"m{i}" for i, k in enumerate(KEYS)}

# What is kept of a chunk. SYL0 to SYL6 mark the syllables of a readable word, six standing for more; KIND is the first mark.
_FACTS = (
    "TYPE WORD SYMBOL WIDTH LONG SYMBOL_SUNG SYMBOL_READ SPELLED UPPER CAPS HARMONIC FRONTED ROUNDED SYL0 SYL1 SYL2 SYL3 SYL4 SYL5 SYL6 SUNG READ "
    "CHARS TOKENS TOKEN_CHARS DIGITS MARKED DOTTED NEAR KIND"
).split()
_AT = {k: i for i, k in enumerate(_FACTS)}
_KINDS = {c: i for i, marks in enumerate(punctuation.MARKS.values()) for c in marks}
#: A comma behind a word means nothing to any sentence: it ends none, begins none, and hides no question.
_COMMA = ("", ",")
_SENTENCE = [_AT[k] for k in ("WORD", "SPELLED", "READ", "SUNG")]
_WIDTH = _AT["KIND"] + len(punctuation.MARKS)
_ALPHABET = np.array([ord(c) for c in ALPHABETS[LANG]])
_OF = {name: np.array([c in v[LANG] for c in ALPHABETS[LANG]]) for name, v in zip(phonology.VOWEL_KEYS, (VOWELS, FRONT_VOWELS, BACK_VOWELS), strict=True)}
_WEIGHTS = [BEZIRCI.get(k, 0.0) for k in range(7)]
_NO_SOUND, _LONG_VOWEL = re.compile(f"[^{SYLLABLE_VOWELS_TR}\n]+"), re.compile("[âîû]+")
_HARMONIC, _UNROUND = re.compile("[eiöü]+|[aıou]+"), re.compile("[aeıi][oöuü]|[oöuü][oöıi]")
_UNSUNG = (0,) * 9
_LETTERS = re.compile(r"([\W_]*)([^\W\d_]+)([\W_]*)")
_READ_ALOUD, _SYMBOLS_READ = frozenset(TR_ABBREVIATIONS), "".join(SYMBOL_READINGS[LANG])
_BLANK_LINE, _DOTS = re.compile(r"\n[ \t]*\n"), re.compile(r"\.{3,}")
#: Chunks that are kept at most between texts, and types up to which tables for the fit of Zipf and Mandelbrot are kept.
MOST_CHUNKS, MOST_RANKS = 400_000, 2048


def _rounded(x: float, digits: int) -> float:
    return x if math.isnan(x) else math.floor(x * 10.0**digits + 0.5) / 10.0**digits + 0.0


def _ratio(part: float, whole: float, digits: int = 6) -> float:
    return _rounded(part / whole, digits) if whole else NAN


def _total(x: np.ndarray) -> float:
    """The sum from left to right."""
    return float(np.add.accumulate(x)[-1]) if len(x) else 0.0


def _sung(n: int | None) -> tuple:
    """SYL0 to READ of a word of n syllables, None being one that can't be read."""
    return _UNSUNG if n is None else (*(int(i == min(n, 6)) for i in range(7)), n, 1)


def _marks(chunk: str) -> tuple[list[int], int]:
    """How many marks of each kind a chunk has, and how many stand next to another one."""
    counts, near, run = [0] * len(punctuation.MARKS), 0, 0
    chunk = _DOTS.sub("…", chunk)
    last = len(chunk) - 1
    for i, c in enumerate(chunk):
        k = _KINDS.get(c)
        if k is None or (c in "'’" and 0 < i < last and chunk[i - 1].isalpha() and chunk[i + 1].isalpha()):
            near += run if run > 1 else 0
            run = 0
        else:
            counts[k] += 1
            run += 1
    return counts, near + (run if run > 1 else 0)


class _Mark:
    """What a token without a letter or number is to the three sets of ending marks."""

    def __init__(self, token: str):
        self.ends = tuple(not frozenset(SENTENCE_SETS[k][0]).isdisjoint(token) for k in SENTENCE_SETS)
        self.maybe = tuple(not e and not frozenset(SENTENCE_SETS[k][1]).isdisjoint(token) for k, e in zip(SENTENCE_SETS, self.ends, strict=True))
        self.opener = token[0] in OPENERS_ONLY
        self.plain = not any(self.ends) and not any(self.maybe)


class _Table:
    """Rows of numbers by key."""

    def __init__(self, width: int):
        self.known: dict = {}
        self.rows = np.zeros((256, width), "i4")

    def add(self, key, row: tuple) -> int:
        number = self.known[key] = len(self.known)
        if number == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[number] = row
        return number


class Measurer:
    """Measures texts one by one. What it keeps of chunks never changes a result."""

    def __init__(self, p: FeatureParams = DEFAULT):
        p.check()
        self.p, self.limits = p, sentence_thresholds(p, LANG)
        self.heard = Counter(LANG)
        self.said = {c: sum(self.heard.token(w) or 0 for w in words.split()) for c, words in SYMBOL_READINGS[LANG].items()}
        self.marks: dict[str, _Mark] = {}
        self.sounds, self.edges = _Table(9 + 3), _Table(3 + len(punctuation.MARKS))
        self.edge_tokens: list[tuple] = []
        self.never: dict[tuple[int, int], float] = {}
        self.logs = np.zeros(1)
        self.ranks: tuple | None = None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.types: dict[str, int] = {}
        self.tokens: dict[int, Sequence[tuple[str, bool]]] = {}
        self.facts = np.zeros((4096, _WIDTH), "i4")

    # ---- chunks

    def _sound(self, vowels: str) -> tuple:
        """Facts of a word's vowels, HARMONIC to READ, the syllables being the vowels."""
        bare = _LONG_VOWEL.sub("", vowels)
        harmony = (1, int(_HARMONIC.fullmatch(bare) is not None), int(_UNROUND.search(bare) is None)) if len(bare) >= 2 else (0, 0, 0)
        return (*harmony, *_sung(len(vowels)))

    def _word(self, unit: str) -> tuple:
        """A word's facts, up to READ."""
        low = lower_for(unit, LANG)
        harmony = self._sound(_NO_SOUND.sub("", low))[:3]
        spelled = "".join(filter(str.isalpha, unit))
        upper = bool(spelled) and spelled[0].isupper()
        caps = upper and len(spelled) >= 2 and all(map(str.isupper, spelled))
        k = self.types.setdefault(low, len(self.types))
        return (k, 1, 0, len(low), int(len(spelled) >= LONG_WORD_LETTERS), 0, 0, int(bool(spelled)), int(upper), int(caps), *harmony, *_sung(self._heard(unit)))

    def _heard(self, unit: str) -> int | None:
        """Counter's answer, which its rules take long to find for letters, alone or with marks behind them: but for
        abbreviations they are sung by their vowels, or spelled; symbols at the end are read aloud; other marks, such as in
        `end.%%`, leave no token, and no initials or hyphen, before the symbols."""
        if unit.isalpha() and tr_abbreviation(unit) is None:
            return len(_NO_SOUND.sub("", lower_for(unit, LANG))) or (len(unit) if unit.isupper() else None)
        m = _LETTERS.fullmatch(unit)
        if m and not m[1] and m[3] and len(m[2]) > 1 and m[2].isalpha() and not any(c in m[3] for c in "-'’") and tr_abbreviation(unit) is None:
            rest = m[3].rstrip(_SYMBOLS_READ)
            if not rest:
                n = self._heard(m[2])
                return None if n is None else n + sum(map(self.said.__getitem__, m[3]))
            if tr_abbreviation(m[2] + rest) is None:
                return None
        return self.heard(unit)

    def _words(self, units: list[str], to: np.ndarray) -> None:
        """_word of words of letters into the rows of `to`; they are lower-cased and cut down to their vowels together. They
        are sung by their vowels, as Counter's rules have it, but for abbreviations and those without any."""
        together = lower_for("\n".join(units), LANG)
        lows, vowels = together.split("\n"), _NO_SOUND.sub("", together).split("\n")
        types = self.types
        to[:, 0] = [types.setdefault(x, len(types)) for x in lows]
        to[:, 1] = to[:, _AT["SPELLED"]] = 1
        to[:, _AT["WIDTH"]] = list(map(len, lows))
        to[:, _AT["LONG"]] = np.array(list(map(len, units))) >= LONG_WORD_LETTERS
        for i, u in enumerate(units):
            if u[0].isupper():
                to[i, _AT["UPPER"]] = 1
                to[i, _AT["CAPS"]] = len(u) >= 2 and u.isupper() and all(map(str.isupper, u))
        known = self.sounds.known
        sounds = [known[v] if v in known else self.sounds.add(v, self._sound(v)) for v in vowels]
        to[:, _AT["HARMONIC"] : _AT["READ"] + 1] = self.sounds.rows[sounds]
        rare = [i for i, v in enumerate(vowels) if not v] if "" in vowels else []
        if not _READ_ALOUD.isdisjoint(lows) or not TR_EXACT.keys().isdisjoint(units):
            rare += [i for i, x in enumerate(lows) if x in _READ_ALOUD or units[i] in TR_EXACT]
        for i in rare:
            to[i, : _AT["READ"] + 1] = self._word(units[i])

    def _edge(self, edge: tuple[str, str]) -> tuple:
        """What the marks before and behind a chunk's letters add to it: numbers of tokens and of their code points, marks
        that stand next to another one, kinds. Their tokens are kept beside it."""
        before, after = (tuple((t, False) for t in S.rule_tokens(x)) for x in edge)
        self.edge_tokens.append((before, after))
        (one, near), (two, more) = map(_marks, edge)
        return len(before) + len(after), sum(map(len, edge)), near + more, *map(sum, zip(one, two, strict=True))

    def _learn(self, keys: Collection[str]) -> None:
        """Number chunks and put what is known of them into the table."""
        if len(self.sounds.known) > MOST_CHUNKS or len(self.edges.known) > MOST_CHUNKS:
            self.sounds, self.edges = _Table(9 + 3), _Table(3 + len(punctuation.MARKS))
            self.edge_tokens.clear()
        alone, other, edged, cores, edges = [], [], [], [], []
        known = self.edges.known
        for key in keys:
            if key.isalpha():
                alone.append(key)
            elif (m := _LETTERS.fullmatch(key)) and m[2] == key.strip(EDGE_MARKS) and m[2].isalpha():
                front, core, back = m.groups()
                edged.append(key)
                cores.append(core)
                edges.append(known[front, back] if (front, back) in known else self.edges.add((front, back), self._edge((front, back))))
            else:
                other.append(key)
        first, plain = len(self.known), len(alone) + len(edged)
        while first + len(keys) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        to = self.facts[first : first + plain]
        units = alone + cores
        self.known.update(zip(alone + edged, range(first, first + plain), strict=True))
        if units:
            self._words(units, to)
            to[:, _AT["CHARS"]] = list(map(len, alone + edged))
            to[:, _AT["TOKENS"]] = 1
            to[:, _AT["TOKEN_CHARS"]] = list(map(len, units))
        if edged:
            marks, to = self.edges.rows[edges], to[len(alone) :]
            to[:, [_AT["TOKENS"], _AT["TOKEN_CHARS"]]] += marks[:, :2]
            to[:, _AT["MARKED"]] = np.array(edges) != self.edges.known.get(_COMMA, -1)
            to[:, _AT["NEAR"] :] = marks[:, 2:]
            for number, core, e in zip(range(first + len(alone), first + plain), cores, edges, strict=True):
                before, after = self.edge_tokens[e]
                self.tokens[number] = (*before, (core, True), *after)
        for key in other:
            number = len(self.known)
            self.facts[number] = self._learn_any(key)

    def _learn_any(self, key: str) -> tuple:
        """A chunk by the rules themselves. A key that ends in a space is of an ordinal, which keeps its dot."""
        number = len(self.known)
        self.known[key] = number
        raw = key.rstrip(" ")
        toks = S.rule_tokens(raw)
        flagged = [(t, S.has_alnum(t)) for t in toks]
        marked = not (len(toks) == 1 and flagged[0][1])
        if marked:
            self.tokens[number] = flagged
        kinds, near = _marks(raw)
        unit, dotted = raw.strip(EDGE_MARKS), False
        if unit.isdigit():
            after = raw[raw.index(unit) + len(unit) :]
            dotted = after == "." and key == raw
            if after.startswith(".,") or key != raw:
                unit += "."
        if S.has_alnum(unit):
            facts = self._word(unit)
        else:
            symbol = bool(unit) and all(c in SYMBOLS for c in unit)
            n = self.heard(unit) if symbol else None
            facts = (-1, 0, int(symbol), 0, 0, n or 0, int(n is not None), 0, 0, 0, 0, 0, 0, *_UNSUNG)
        return (*facts, len(raw), len(toks), sum(map(len, toks)), sum(map(str.isdecimal, raw)), marked, dotted, near, *kinds)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        if fresh := set(chunks).difference(self.known):
            self._learn(fresh)
        return np.fromiter(map(self.known.__getitem__, chunks), "i8", len(chunks))

    # ---- sentences

    def _walk(self, chunks: list[str], ids: np.ndarray, marked: np.ndarray) -> tuple[list[int], list[tuple[int, int]], list[tuple[str, bool]], list[int]]:
        """Sentences under each set of marks; ranges of the default ones over the tokens that matter; those, whether they are
        words; and the chunks that they are in."""
        toks: list[tuple[str, bool]] = []
        at: list[int] = []
        first = 0
        for i in [*np.flatnonzero(marked).tolist(), len(chunks)]:
            if first < i:
                toks.append((chunks[first].rstrip(","), True))
                at.append(first)
                if first < i - 1:
                    toks.append((chunks[i - 1].rstrip(","), True))
                    at.append(i - 1)
            if i < len(chunks):
                these = self.tokens[int(ids[i])]
                toks += these
                at += [i] * len(these)
            first = i + 1
        n, ahead = len(toks), 0  # ahead: the next word, once it was asked for
        counts, worded = [0, 0, 0], [False, False, False]
        ranges: list[tuple[int, int]] = []
        start, closed, before = 0, False, ""
        for i, (t, is_word) in enumerate(toks):
            if is_word:
                if closed:
                    ranges.append((start, i))
                    start, closed = i, False
                worded = [True, True, True]
                before = t
                continue
            if t == ".":
                if ahead <= i:
                    ahead = i + 1
                    while ahead < n and not toks[ahead][1]:
                        ahead += 1
                if ahead < n and not toks[ahead][0][0].isupper() and tr_abbreviation(before) is not None:  # an abbreviation's own dot
                    continue
                for k in (0, 1, 2):
                    counts[k] += worded[k]
                closed = closed or worded[0]
                worded = [False, False, False]
                continue
            m = self.marks.get(t)
            if m is None:
                if len(self.marks) > 100_000:
                    self.marks.clear()
                m = self.marks[t] = _Mark(t)
            if m.plain:
                if closed and m.opener:
                    ranges.append((start, i))
                    start, closed = i, False
                continue
            after, its_word = toks[i + 1] if i + 1 < n else (None, False)
            might = after is None or after[0] in NEW_SENTENCE_OPENERS or (its_word and after[0].isupper())
            ends = [e or (x and might) for e, x in zip(m.ends, m.maybe, strict=True)]
            if closed and m.opener:
                ranges.append((start, i))
                start, closed = i, False
            closed = closed or (ends[0] and worded[0])
            for k in (0, 1, 2):
                if ends[k] and worded[k]:
                    counts[k] += 1
                    worded[k] = False
        if closed or (start < n and (worded[0] or not ranges)):
            ranges.append((start, n))
        elif start < n:
            ranges[-1] = (ranges[-1][0], n)
        return [c + w for c, w in zip(counts, worded, strict=True)], ranges, toks, at

    def _sentences(self, text: str, chunks: list[str], plain: np.ndarray, rows: np.ndarray, dotted: Sequence[int]) -> dict:
        """The word counts of sentences with a letter, how many sentences there are and ask, counts under each set of marks,
        syllables of the sentences and how many of these have a readable word. `plain` has no ordinals; `rows` are the facts
        with them, and `dotted` their places."""
        counts, ranges, toks, at = self._walk(chunks, plain, rows[:, _AT["MARKED"]])
        asking = 0
        for a, b in ranges:
            last, is_word = toks[b - 1]
            asking += last == "?" or (last != "." and not is_word and S.asks([t for t, _ in toks[a:b]]))
        out = {"counts": counts, "n": len(ranges), "asking": asking, "lengths": [], "sung": 0, "singing": 0}
        if not ranges:
            return out
        starts, inside = [0], False
        for a, _ in ranges[1:]:
            c, k = at[a], a - 1
            while k >= 0 and at[k] == c and not inside:
                inside = toks[k][1]
                k -= 1
            starts.append(c)
        if inside:  # a sentence begins inside a chunk, which is cut: the rules are applied to the parts
            every = S.rule_tokens(text)
            words = [S.words(s, LANG) for s in S.slices(text, every, S.spans(every, LANG))]
            sung = self.heard.sums(words)
            return out | {"lengths": [len(w) for w in words if any(c.isalpha() for u in w for c in u)], "sung": sum(sung), "singing": len(sung)}
        # the last chunk of a sentence has no chunk behind it, and is no ordinal
        own = rows[:, _SENTENCE]
        ends = {k - 1 for k in (*starts[1:], len(chunks))} if len(dotted) else ()
        for i in dotted:
            if i in ends:
                own[i] = self.facts[plain[i], _SENTENCE]
        of = np.add.reduceat(own, starts, axis=0)
        return out | {"lengths": of[of[:, 1] > 0, 0].tolist(), "sung": int(of[:, 3].sum()), "singing": int(np.count_nonzero(of[:, 2]))}

    # ---- words

    def _log(self, most: int) -> np.ndarray:
        if len(self.logs) <= most:
            self.logs = np.array([0.0, *(math.log(k) for k in range(1, 2 * most + 1))])
        return self.logs

    def _never(self, n: int, f: int) -> float:
        """The chance of a word of frequency f to be in no sample for HD-D."""
        got = self.never.get((n, f))
        if got is None:
            got = 1.0
            for i in range(self.p.hdd_sample_size):
                got = got * (n - f - i) / (n - i)
            if len(self.never) > 200_000:
                self.never.clear()
            self.never[n, f] = got
        return got

    def _mandelbrot(self, freqs: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """sampled.mandelbrot, whose errors are first taken from sums; that near the least one are worked out as there."""
        v = len(freqs)
        if v > MOST_RANKS or float(y @ y) < 1e-6:
            return sampled.mandelbrot(freqs)
        if self.ranks is None:
            x = np.log(np.arange(1, MOST_RANKS + 1) + sampled.GRID[:, None])
            self.ranks = x, np.cumsum(x, axis=1), np.cumsum(x * x, axis=1)
        x, sums, squares = self.ranks
        yy = float(y @ y)
        xx = squares[:, v - 1] - sums[:, v - 1] ** 2 / v
        error = yy - (x[:, :v] @ y) ** 2 / xx
        near = np.flatnonzero(error <= error.min() + 1e-8 * (1 + yy))
        if len(near) > 1 or error.min() < 1e-6:
            return sampled.mandelbrot(freqs)
        q = int(near[0])
        own = x[q, :v] - x[q, :v].mean()
        return float(sampled.GRID[q]), abs(float(own @ y) / float(own @ own))

    def _lexical(self, codes: np.ndarray, width: int, blank: bool) -> dict[str, float]:
        p, n = self.p, len(codes)
        order = np.argsort(codes, kind="stable")
        ordered = codes[order]
        again = ordered[1:] == ordered[:-1]
        seen = np.full(n, -1)
        seen[order[1:][again]] = order[:-1][again]
        first = np.flatnonzero(np.concatenate(([True], ~again))) if n else np.zeros(0, "i8")
        freqs = np.sort(np.diff(first, append=n))[::-1]
        v = len(freqs)
        times = np.bincount(freqs)
        found = np.flatnonzero(times)
        spectrum = dict(zip(found.tolist(), times[found].tolist(), strict=True))
        v1, v2 = spectrum.get(1, 0), spectrum.get(2, 0)
        s2 = float(sum(f * f * k for f, k in spectrum.items()))
        out = dict.fromkeys((*frequency.KEYS[:4], *LEXICAL), NAN)
        if not blank:
            out |= {"word_count": float(n), "type_count": float(v), "hapax_count": float(v1), "dislegomena_count": float(v2)}
        if not n:
            return out
        logs = self._log(n)
        ln_n, ln_v, r = math.log(n), math.log(v), _rounded
        share = freqs / n
        out |= {
            "word_len_mean": r(width / n, 4), "ttr": r(v / n, 6), "entropy": r(0.0 - _total(share * np.log(share)), 6), "yule_k": r(1e4 * (s2 - n) / (n * n), 2),
            "hapax_ratio": r(v1 / v, 6), "hapax_token_ratio": r(v1 / n, 6), "sichel_s": r(v2 / v, 6), "guiraud_r": r(v / math.sqrt(n), 5), "cttr": r(v / math.sqrt(2 * n), 5),
            "herdan_vm": r(math.sqrt(max(s2 / (n * n) - 1 / v, 0.0)), 6),
        }
        if n > 1:
            out |= {"simpson_d": r((s2 - n) / (n * (n - 1)), 6), "herdan_c": r(ln_v / ln_n, 5), "maas_a2": r((ln_n - ln_v) / (ln_n * ln_n), 6)}
            if n != v:
                out["dugast_u"] = r(ln_n * ln_n / (ln_n - ln_v), 4)
        if v > p.brunet_w_b:
            out["brunet_w"] = r(n ** ((v - p.brunet_w_b) ** -p.brunet_w_a), 4)
        if n >= 3 and v >= 2:
            out["summer_s"] = r(math.log(ln_v) / math.log(ln_n), 5)
        if v1 != v:
            out["honore_r"] = r(100 * ln_n / (1 - v1 / v), 6)
        size = p.hdd_sample_size
        if n >= size:
            chance = 0.0
            for f, k in sorted(spectrum.items(), reverse=True):
                chance += k * (1.0 if n - f < size else 1 - self._never(n, f))
            out["hdd"] = r(chance / size, 5)
        if k := n // p.msttr_segment_size:
            upto = k * p.msttr_segment_size
            begin = np.arange(upto) // p.msttr_segment_size * p.msttr_segment_size
            out["msttr"] = r(int(np.count_nonzero(seen[:upto] < begin)) / upto, 5)
        if n >= 2 * p.mattr_window:
            last, at = n - p.mattr_window + 1, np.arange(1, n + 1)
            begin = np.maximum(np.maximum(seen + 2, at - p.mattr_window + 1), 1)
            out["mattr"] = r(int(np.maximum(np.minimum(at, last) - begin + 1, 0).sum()) / (last * p.mattr_window), 5)
        if n >= p.heaps_points:
            cuts = np.arange(1, p.heaps_points + 1) * n // p.heaps_points
            x, y = logs[cuts], logs[np.cumsum(seen < 0)[cuts - 1]]
            x, y = x - _total(x) / p.heaps_points, y - _total(y) / p.heaps_points
            out["heaps_beta"] = r(_total(x * y) / _total(x * x), 4)
        out["mtld"] = r(sampled.mtld_of(seen, p.mtld_threshold, p.mtld_min_tokens), 4)
        if v >= 10:
            x, y = logs[1 : v + 1], logs[freqs]
            x, y = x - _total(x) / v, y - _total(y) / v
            xx, xy, yy = _total(x * x), _total(x * y), _total(y * y)
            out["zipf_exponent"] = r(abs(xy / xx), 4)
            if yy > 1e-12:
                out["zipf_r2"] = r(xy * xy / (xx * yy), 4)
            q, s = self._mandelbrot(freqs.astype(float), y)
            out |= {"zipf_mandelbrot_q": r(q, 4), "zipf_mandelbrot_s": r(s, 4)}
        return out

    # ---- texts

    def __call__(self, text: str | None) -> dict[str, float]:
        """All of KEYS, NaN for what can't be measured; a null text is empty."""
        text = text or ""
        if len(self.known) > MOST_CHUNKS:
            self._forget()
        chunks = text.split()
        plain = self._numbers(chunks)
        rows = self.facts[plain]
        dotted = [i for i in np.flatnonzero(rows[:, _AT["DOTTED"]]).tolist() if i + 1 < len(chunks) and rows[i + 1, _AT["WORD"]]]
        for i in dotted:
            rows[i] = self.facts[self._numbers([chunks[i] + " "])[0]]
        sums = rows.sum(axis=0, dtype="i4").tolist()
        of = dict(zip(_FACTS, sums, strict=False))
        n, chars = of["WORD"], len(text)
        codes = rows[:, _AT["TYPE"]]
        out = self._lexical(codes[codes >= 0], of["WIDTH"], not chunks)

        s = self._sentences(text, chunks, plain, rows, dotted)
        u = s["lengths"]
        r, k = _rounded, len(u)
        if k:
            ordered = sorted(u)
            out |= {"sent_len_mean": r(sum(u) / k, 4), "sent_len_median": r((ordered[(k - 1) // 2] + ordered[k // 2]) / 2, 4), "sent_count": float(k)}
        else:
            out |= dict.fromkeys(("sent_len_mean", "sent_len_median", "sent_count"), NAN)
        short, long = self.limits
        out["sent_len_char_mean"] = r((of["TOKEN_CHARS"] + of["TOKENS"] - s["n"]) / s["n"], 4) if s["n"] else NAN
        out |= {"short_sent_ratio": _ratio(sum(x < short for x in u), k), "long_sent_ratio": _ratio(sum(x > long for x in u), k), "sent_len_entropy": NAN, "question_sent_ratio": _ratio(s["asking"], s["n"], 5)}
        if k >= 2:
            each: dict[int, int] = {}
            for x in u:
                each[x] = each.get(x, 0) + 1
            entropy = 0.0
            for c in each.values():
                entropy += (c / k) * math.log(c / k)
            out["sent_len_entropy"] = r(0.0 - entropy, 5)

        paragraphs = sum(1 for x in _BLANK_LINE.split(text.replace("\r\n", "\n")) if x and not x.isspace()) if chunks else 0
        out["para_count"] = float(paragraphs) if paragraphs else NAN
        out["para_len_mean"] = _ratio(n, paragraphs, 4)
        out["sents_per_para_mean"] = r(k / paragraphs, 4) if paragraphs and k else NAN

        points = np.frombuffer(lower_for(text, LANG).encode("utf-32-le", "surrogatepass"), "u4")
        letters = np.bincount(points[points < 512].astype("i8"), minlength=512)[_ALPHABET]
        all_letters = int(letters.sum())
        for key, kept in _OF.items():
            out[key] = _ratio(int(letters[kept].sum()), all_letters, 5)
        shares = (np.floor(letters / all_letters * 1e6 + 0.5) / 1e6).tolist() if all_letters else [NAN] * len(letters)
        out |= zip(_LETTER_KEYS, shares, strict=True)
        out |= {"harmony_fronting_ratio": _ratio(of["FRONTED"], of["HARMONIC"], 5), "harmony_rounding_ratio": _ratio(of["ROUNDED"], of["HARMONIC"], 5)}

        read, sung = of["READ"], of["SUNG"]
        out["syllable_count"] = float(sung) if chunks else NAN
        out["syllable_mean"] = _ratio(sung, read, 4)
        for i, key in enumerate(phonology.SHARES, 1):
            out[key] = _ratio(of[f"SYL{i}"], read)
        out["sent_syllable_mean"] = _ratio(s["sung"], s["singing"], 4)

        out["long_word_ratio"] = _ratio(of["LONG"], n, 5)
        default, _, cetinkaya = s["counts"]
        out |= dict.fromkeys(readability.TURKISH_KEYS, NAN)
        if read and default:
            out["atesman"] = r(198.825 - 40.175 * (sung / read) - 2.61 * n / default, 4)
            out["bezirci_yilmaz"] = r(math.sqrt(n / default * sum(of[f"SYL{i}"] * w for i, w in enumerate(_WEIGHTS)) / default), 4)
        every = read + of["SYMBOL_READ"]
        if every and cetinkaya:
            out["cetinkaya_uzun"] = r(118.823 - 25.987 * ((sung + of["SYMBOL_SUNG"]) / every) - 0.971 * (n + of["SYMBOL"]) / cetinkaya, 4)

        kinds = sums[_AT["KIND"] :]
        marks = sum(kinds)
        out |= {"char_count": float(chars) if chars else NAN, "punct_count": float(marks) if chars else NAN, "punct_variety": float(sum(c > 0 for c in kinds)) if chars else NAN}
        out |= {"digit_ratio": _ratio(of["DIGITS"], chars), "punct_char_ratio": _ratio(marks, chars), "whitespace_ratio": _ratio(chars - of["CHARS"], chars)}
        for name, c in zip(punctuation.MARKS, kinds, strict=True):
            out[f"punct_{name}_ratio"] = _ratio(c, marks)
        entropy = 0.0
        for c in kinds:
            if c:
                entropy += (c / marks) * math.log(c / marks)
        out["punct_entropy"] = r(0.0 - entropy, 6) if marks else NAN
        out |= {"consecutive_punct_ratio": _ratio(of["NEAR"], marks), "uppercase_ratio": _ratio(of["UPPER"], of["SPELLED"]), "all_caps_word_ratio": _ratio(of["CAPS"], of["SPELLED"])}
        return out


_LETTER_KEYS = punctuation.letter_keys(LANG)


@cache
def _measurer(p: FeatureParams) -> Measurer:
    """A worker's own, which keeps what it knows of chunks from task to task."""
    return Measurer(p)


def measures_column(text: Column, p: FeatureParams = DEFAULT) -> Column:
    """struct of FIELDS, one for each of KEYS, as an Arrow UDF."""

    @F.arrow_udf("struct<" + ", ".join(f"{x}: double" for x in FIELDS.values()) + ">")
    def run(texts: pa.Array) -> pa.Array:
        measure = _measurer(p)
        made = np.empty((len(texts), len(KEYS)))
        for i, t in enumerate(texts):
            m = measure(t.as_py())
            made[i] = [m[k] for k in KEYS]
        return pa.StructArray.from_arrays([pa.array(column) for column in np.ascontiguousarray(made.T)], names=list(FIELDS.values()))

    return run(text)
