"""Toxicity by weak supervision.

Many lexicon and pattern voters say toxic, clean or nothing about a text. A generative label model estimates, from their
votes on a bounded sample and without its labels, how often each voter says what about toxic and about clean texts, and
how voters depend on each other: the votes of a class are a tree of pairwise tables, the tree of the greatest mutual
information, so that voters that repeat one another count once. Its posterior alone trains a linear classifier on lexicon
hits and patterns, which scores all texts.

The lexicons: general ones of English, German, French and Spanish insults; one of words that stand in toxic labelled
texts far more often than in clean ones; and one of beginnings of words of that kind. Labels serve for these two, on one
half of the sample, and for the prior; the posterior is that of the other half.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, batch, fold_of, labelled_sample

#: Insults, by what they are about; each list is a voter.
LEXICONS = {
    "mind": "idiot idiots moron morons imbecile cretin dolt dunce halfwit nitwit simpleton fool dumbass clueless brainless braindead idiotic moronic dumb stupid".split(),
    "standing": "loser losers clown clowns jerk creep freak wretch coward spineless miserable shameful".split(),
    "dirt": "scum scumbag trash garbage filth vermin pig parasite vile revolting repulsive disgusting".split(),
    "worth": "pathetic worthless useless ugly despicable contemptible hateful".split(),
    "obscene": "bastard bitch asshole damn crap shit fuck fucking sucks".split(),
    "german": "dumm idiotisch trottel vollidiot arschloch abschaum versager widerlich erbärmlich wertlos schwachkopf miststück".split(),
    "french": "connard connasse salaud crétin imbécile débile abruti pourriture ordure dégoûtant minable".split(),
    "spanish": "estúpido estúpida imbécil asqueroso patético inútil basura escoria cabrón pendejo payaso".split(),
}
SECOND_PERSON = re.compile(r"\b(?:you|your|du|ihr|tu|vous|usted|eres)\b(?:\W+\w+){0,3}\W+(?:idiot|moron|loser|clown|trash|scum|stupid|pathetic|worthless|disgusting|dumb|fool|useless)", re.I)
SHOUT = re.compile(r"(?:\b[A-Z]{3,}\b\W+){4}")
EXCLAIM = re.compile(r"!{2,}")
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """`sample`: the most labelled rows that voters, label model and classifier use, of texts of `longest` bytes at most."""

    sample: int = 6000
    longest: int = 32_768
    learned_words: int = 400
    learned_stems: int = 60
    least_support: int = 5
    least_lift: float = 20.0
    stem_lift: float = 10.0
    rounds: int = 40
    steps: int = 400
    l2: float = 1e-3


#: Learned words and stems are shared out to so many voters each.
LEARNED = 4
GENERAL = tuple(LEXICONS)
N_GROUPS = len(GENERAL) + 2 * LEARNED
N_EXTRA = 2 * N_GROUPS + 6


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    groups: tuple[int, ...]  # of each word: the place of its lexicon, then LEARNED groups of words and of stems (these end in *)
    weight: np.ndarray
    bias: float


class Reader:
    """Lexicon hits of whole texts: an Aho-Corasick automaton finds the words, which count where they stand alone, and the stems, which count at the front of a word."""

    def __init__(self, words: tuple[str, ...], groups: tuple[int, ...]):
        import ahocorasick

        self.words, self.groups, self.automaton = words, groups, ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, bool]]] = {}
        for i, w in enumerate(words):
            by_text.setdefault(w.rstrip("*"), []).append((i, w.endswith("*")))
        for w, entries in by_text.items():
            self.automaton.add_word(w, (len(w), entries))
        if words:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> Counter:
        low, found = (text or "").lower(), Counter()
        if not low or not self.words:
            return found
        for end, (n, entries) in self.automaton.iter(low):
            a, b = end - n, end + 1
            if a >= 0 and (low[a].isalnum() or low[a] == "_"):
                continue
            alone = b >= len(low) or not (low[b].isalnum() or low[b] == "_")
            for i, stem in entries:
                if alone or stem:
                    found[i] += 1
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Of each word ln(1 + hits); of each group too; then distinct hits, their share of the words, patterns; hits of each group in 100 words."""
        text = text or ""
        h, n = self.hits(text), len(self.words)
        x = np.zeros(n + N_EXTRA)
        for i, k in h.items():
            x[i] = math.log1p(k)
            x[n + self.groups[i]] += k
        total = sum(h.values())
        x[-N_GROUPS:] = np.minimum(100 * x[n : n + N_GROUPS] / (1 + text.count(" ")), 3)
        x[n : n + N_GROUPS] = np.log1p(x[n : n + N_GROUPS])
        patterns = (bool(total and p.search(text)) for p in (SECOND_PERSON, SHOUT, EXCLAIM))
        x[n + N_GROUPS : -N_GROUPS] = min(len(h), 5), len(h) >= 2, min(50.0 * total / (1 + text.count(" ")), 3), *patterns
        return x


def votes(x: np.ndarray, n: int) -> np.ndarray:
    """1 toxic, -1 clean, 0 nothing, from features of n words. A voter for each group of words, which votes from 3 hits in
    1,000 words on; for two and for three distinct hits; for dense and for sparse hits; for no hit; for each pattern."""
    group, distinct, dense = x[:, -N_GROUPS:], x[:, n + N_GROUPS], x[:, n + N_GROUPS + 2]
    toxic = [group[:, g] >= 0.3 for g in range(N_GROUPS)]
    toxic += [distinct >= 2, distinct >= 3, dense >= 0.3, dense >= 1.0, *(x[:, n + N_GROUPS + 3 + i] > 0 for i in range(3))]
    clean = [distinct == 0, dense < 0.1]
    return np.array([np.where(t, 1, 0) for t in toxic] + [np.where(c, -1, 0) for c in clean]).T


def _tree(information: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(voter, its parent or -1), parents first: the spanning forest of the greatest information, of edges above `least`."""
    k = len(information)
    out: list[tuple[int, int]] = []
    best, parent = np.zeros(k), np.full(k, -1)
    left = set(range(k))
    while left:
        j = max(left, key=lambda i: (best[i], -i))
        left.discard(j)
        out.append((j, int(parent[j])))
        nearer = information[j] > np.maximum(best, least)
        best, parent = np.where(nearer, information[j], best), np.where(nearer, j, parent)
    return out


@dataclass(frozen=True)
class Labels:
    """What the label model has estimated: the posterior of toxic of each row; for clean and toxic the rates of each voter's
    three votes and the joint rates of each two voters' votes; the voters with their parents, parents first."""

    posterior: np.ndarray
    rates: np.ndarray
    pairs: np.ndarray
    tree: list[tuple[int, int]]


def label_model(v: np.ndarray, prior: float, rounds: int, least: float = 0.01) -> Labels:
    """Expectation maximisation of two classes, in each of which the votes (-1, 0, 1) are a tree of pairwise tables.

    The tree is that of the greatest mutual information of two votes given the class, estimated anew in every round.
    """
    n, k = v.shape
    onehot = np.stack([v == c for c in (-1, 0, 1)], axis=2).astype("f8")
    flat = onehot.reshape(n, 3 * k)
    base = math.log(prior / (1 - prior))
    # the start: a vote count in which voters that nearly always vote alike share one vote
    c = v - v.mean(axis=0)
    spread = np.maximum(c.std(axis=0), 1e-9)
    alike = np.abs(c.T @ c / max(1, n) / np.outer(spread, spread)) >= 0.9
    np.fill_diagonal(alike, True)
    post = 1 / (1 + np.exp(-np.clip(base + 2.0 * (v / alike.sum(axis=0)).sum(axis=1), -8, 8)))
    rates = pairs = tree = None
    for _ in range(rounds):
        pairs, rates = np.empty((2, k, 3, k, 3)), np.empty((2, k, 3))
        for c, q in enumerate((1 - post, post)):
            pairs[c] = ((flat * q[:, None]).T @ flat).reshape(k, 3, k, 3)
            pairs[c] = (pairs[c] + 0.1) / (q.sum() + 0.9)
            rates[c] = (np.tensordot(q, onehot, (0, 0)) + 0.3) / (q.sum() + 0.9)
        ratio = np.log(pairs) - np.log(rates[:, :, :, None, None]) - np.log(rates[:, None, None, :, :])
        information = np.einsum("c,cjakb,cjakb->jk", np.array([1 - post.mean(), post.mean()]), pairs, ratio)
        np.fill_diagonal(information, 0)
        tree = _tree(information, least)
        z = np.full(n, base)
        for j, up in tree:
            lift = np.log(rates[1, j]) - np.log(rates[0, j])
            if up < 0:
                z += onehot[:, j] @ lift
            else:  # the vote given its parent's
                given = np.log(pairs[:, up, :, j, :]) - np.log(pairs[:, up, :, j, :].sum(axis=2, keepdims=True))
                z += np.einsum("na,ab,nb->n", onehot[:, up], given[1] - given[0], onehot[:, j])
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return Labels(post, rates, pairs, tree)


def _learned(rows: list[tuple[str, int]], have: set[str], s: Settings) -> tuple[list[str], list[str]]:
    """Words and stems of toxic texts that the lexicons lack, by how much more often they stand there than in clean texts."""
    words, stems = (Counter(), Counter()), (Counter(), Counter())
    for t, y in rows:
        found = set(WORD.findall(t.lower()))
        words[y].update(found)
        stems[y].update({w[:k] for w in found for k in range(4, min(9, len(w)))})
    n = [max(1, sum(1 for _, y in rows if y == c)) for c in (0, 1)]

    def best(df: tuple[Counter, Counter], support: float, least: float, most: int) -> list[str]:
        lift = {w: (k / n[1]) / ((df[0][w] + 0.5) / n[0]) for w, k in df[1].items() if k >= support and len(w) > 2 and w not in have}
        return sorted((w for w, v in lift.items() if v >= least), key=lambda w: (-df[1][w], w))[:most]

    chosen: list[str] = []
    for w in best(stems, max(2 * s.least_support, 0.02 * n[1]), s.stem_lift, 20 * s.learned_stems):
        if len(chosen) < s.learned_stems and not any(w.startswith(c) or h.startswith(w) for c in chosen for h in have):
            chosen.append(w)
    return best(words, s.least_support, s.least_lift, s.learned_words), [w + "*" for w in chosen]


def fit(rows: list[tuple[str, int]], s: Settings = Settings()) -> Model:
    """Train on (text, 0 or 1) rows: learned words from one half and the prior from the labels, all else from the votes on
    the other half. Without rows, the general lexicons decide alone."""
    rows = [(t, int(bool(y))) for t, y in rows]
    groups = {w: g for g, name in enumerate(GENERAL) for w in LEXICONS[name]}
    new_words, new_stems = _learned(rows[::2], set(groups), s)
    for first, new in ((len(GENERAL), new_words), (len(GENERAL) + LEARNED, new_stems)):
        groups |= {w: first + i % LEARNED for i, w in enumerate(new) if w not in groups}
    words = tuple(sorted(groups))
    kinds = tuple(groups[w] for w in words)
    n = len(words)
    if not rows:
        weight = np.zeros(n + N_EXTRA)
        weight[n : n + N_GROUPS] = 3.0
        return Model(words, kinds, weight, -2.0)
    reader = Reader(words, kinds)
    prior = float(np.clip(np.mean([y for _, y in rows]), 0.01, 0.5))
    x = np.array([reader.features(t) for t, _ in (rows[1::2] or rows)])
    target = label_model(votes(x, n), prior, s.rounds).posterior
    # full-batch logistic regression on the posterior, by accelerated gradient steps
    w, b, mw, mb = np.zeros(x.shape[1]), math.log(prior / (1 - prior)), 0.0, 0.0
    scale = 1 / (np.linalg.norm(x, 2) ** 2 / len(x) / 4 + s.l2 + 0.25)
    for _ in range(s.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        mw = 0.9 * mw - scale * (x.T @ (p - target) / len(x) + s.l2 * w)
        mb = 0.9 * mb - scale * (p - target).mean()
        w, b = w + mw, b + mb
    return Model(words, kinds, w, float(b))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs; null and empty texts have no hits.

    Repeated rows are scored alike; a null id counts as held out; other columns are left aside.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m.words, m.groups)
        for b in it:
            z = np.array([float(reader.features(t) @ m.weight) + m.bias for t in b.column(2).to_pylist()], "f8")
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield batch(**{id_col: b.column(0)}, held_out=b.column(1), score=pa.array(p), predicted=pa.array((p >= threshold).astype("i4")))

    d = docs.select(id_col, (fold_of(F.col(id_col)) == 0).alias("held_out"), text_col)
    return arrow_pass(d, run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on labels.toxic outside the held-out fold, then score all documents."""
    return score(docs, fit(labelled_sample(docs, labels, "toxic", settings.sample, settings.longest), settings))
