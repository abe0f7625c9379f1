"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi search.

The automaton reports, for each end position, every piece that ends there (it follows the output links from the
longest suffix that is a piece to the shorter ones); each report relaxes the best path to that position.

In a model of type unigram the best path is that of the greatest sum of piece scores. In a model of type BPE scores are
merge ranks, whose sum says nothing; what a path must not have is a step from a piece to a next one that the merges
would have joined or cut otherwise. Of the pieces that end at a position one alone may follow its best path, so that the
search gives the library's own ids, in one pass. Whether two pieces may stand side by side is worked out from the merges
of the two and kept.

Pieces hold U+2581 at their front only (or are runs of it), so that no piece crosses from a word into the space behind
it: the best path of a text is the best paths of its words in a row, and a word's path is kept for its next occurrence.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, batch, portions

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Automaton:
    """Aho-Corasick: states are the beginnings of pieces. `ends[s]` has the (length, id) of every piece that ends in state
    s, the longest first: those of s itself, then along the output links. `step[s]` has the next states by character; those
    over the failure links are added when they are first asked for, up to `most` of them."""

    def __init__(self, ids: dict[str, int], most: int = 300_000):
        self.step: list[dict[str, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for p, i in ids.items():
            at = 0
            for c in p:
                to = self.step[at].setdefault(c, len(self.step))
                if to == len(self.step):
                    self.step.append({})
                at = to
            own[at] = (len(p), i)
        n = len(self.step)
        self.tree = [dict(d) for d in self.step]
        self.fail, self.ends, self.left = [0] * n, [()] * n, most
        self.ends[0] = ()
        queue = [0]
        for s in queue:  # by growing depth
            for c, to in self.tree[s].items():
                self.fail[to] = self._over(self.fail[s], c) if s else 0
                self.ends[to] = ((own[to],) if to in own else ()) + self.ends[self.fail[to]]
                queue.append(to)

    def _over(self, s: int, c: str) -> int:
        while s and c not in self.tree[s]:
            s = self.fail[s]
        return self.tree[s].get(c, 0)

    def to(self, s: int, c: str) -> int:
        """The state behind s and c."""
        found = self.step[s].get(c)
        if found is None:
            found = self._over(s, c)
            if found and self.left:
                self.left -= 1
                self.step[s][c] = found
        return found


class Codec:
    """Encoder and decoder of one model file. At most `cache` words keep their ids, and at most `pairs` pairs of pieces
    their verdict; a full table starts anew."""

    #: Longer words, in characters, are not kept, so that the cache is of bounded size.
    LONG = 64

    def __init__(self, model: str, cache: int = 200_000, pairs: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = size = sp.get_piece_size()
        self.pieces = pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {pieces[i]: (sp.get_score(i), i) for i in normal}
        self.merges = all(float(s).is_integer() for s, _ in self.score.values())  # ranks, not logarithms
        self.unknown_id = sp.unk_id()
        self.unknown = min(s for s, _ in self.score.values()) - 10.0
        self.automaton = Automaton({p: i for p, (_, i) in self.score.items()})
        self.length = [len(p) for p in pieces]
        self.bytes_of = [b""] * size
        for i in normal:
            self.bytes_of[i] = pieces[i].replace(SPACE, " ").encode()
        for v, i in self.byte_id.items():
            self.bytes_of[i] = bytes([v])
        self.bytes_of[self.unknown_id] = " ⁇ ".encode()
        self.most, self.most_pairs = cache, pairs
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _fallback(self, ch: str) -> list[int]:
        return [self.byte_id.get(b, self.unknown_id) for b in ch.encode()] if self.byte_id else [self.unknown_id]

    def merged(self, s: str) -> list[str]:
        """The pieces that the merges leave of a string: the best-ranked pair of neighbours is joined, the leftmost of equals."""
        parts = list(s)
        while True:
            ranked = [(-self.score[x][0], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score]
            if not ranked:
                return parts
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        found = self.pairs[a * self.size + b] = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return found

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids, as bytes, of the best path of each word; its spaces are U+2581.

        Words go in order, so that what a word begins with like the one before it is not searched again.
        """
        found: dict[str, bytes] = {}
        states, best, last = [0], [0.0], [-1]  # of each position: the automaton's state, the path's score and last piece
        before = ""
        relax = self._by_merges if self.merges else self._by_scores
        for w in sorted(set(words)):
            k = 0
            for x, y in zip(before, w, strict=False):
                if x != y:
                    break
                k += 1
            before = w
            del states[k + 1 :], best[k + 1 :], last[k + 1 :]
            relax(w, k, states, best, last)
            path: list[int] = []
            p = len(w)
            while p:
                if (i := last[p]) >= 0:
                    path.append(i)
                    p -= self.length[i]
                else:  # a character without a piece
                    path.extend(reversed(self._fallback(w[p - 1])))
                    p -= 1
            path.reverse()
            found[w] = array("i", path).tobytes()
        return [found[w] for w in words]

    def _by_merges(self, w: str, p: int, states: list[int], best: list[float], last: list[int]) -> None:
        size, verdict, step, ends, to = self.size, self.pairs.get, self.automaton.step, self.automaton.ends, self.automaton.to
        s = states[p]
        for c in w[p:]:
            p += 1
            s = step[s].get(c) or to(s, c)
            for length, i in ends[s]:
                a = last[p - length]
                if a < 0:
                    break
                ok = verdict(a * size + i)
                if self._may_follow(a, i) if ok is None else ok:
                    break
            else:
                i = -1
            states.append(s)
            last.append(i)

    def _by_scores(self, w: str, p: int, states: list[int], best: list[float], last: list[int]) -> None:
        """The greatest sum of scores. Of equal ones, the longer last piece wins."""
        s = states[p]
        for c in w[p:]:
            p += 1
            s = self.automaton.to(s, c)
            top, piece, single = 0.0, -1, False
            for length, i in self.automaton.ends[s]:
                v = best[p - length] + self.score[self.pieces[i]][0]
                single = length == 1
                if piece < 0 or v > top:
                    top, piece = v, i
            v = best[p - 1] + self.unknown
            if not single and (piece < 0 or v > top):
                top, piece = v, -1
            states.append(s)
            best.append(top)
            last.append(piece)

    def _keys(self, text: str) -> list[str]:
        """The words of a text as keys of the cache: a word behind one space as itself, others with U+2581 before them;
        the empty key is a U+2581 of the text itself, which has no piece: its bytes stand for it."""
        if SPACE in text:
            parts = [self._keys_of(p.replace(" ", SPACE)) for p in (" " + text).split(SPACE)]
            return [k for i, part in enumerate(parts) for k in ([""] * (i > 0) + part)]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return self._keys_of(SPACE + text.replace(" ", SPACE))
        return text.split(" ")

    @staticmethod
    def _keys_of(s: str) -> list[str]:
        return [w[1:] if len(w) > 1 and w[0] == SPACE != w[1] else SPACE + w for w in CHUNK.findall(s)]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts with the leading space that the model puts before them; none for null and empty texts."""
        keys = [self._keys(t) if t else [] for t in texts]
        need = set().union(*keys)
        new = need - self.cache.keys()
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
            new = need
        if "" in new:
            self.cache[""] = array("i", self._fallback(SPACE)).tobytes()
            new.discard("")
        words = list(new)
        self.cache.update(zip(words, self.viterbi([w[1:] if w[0] == SPACE else SPACE + w for w in words]), strict=True))
        out = [np.frombuffer(b"".join(map(self.cache.__getitem__, k)), "<i4") for k in keys]
        for w in words:
            if len(w) > self.LONG:
                del self.cache[w]
        return out

    def forget(self) -> None:
        """Let go of all words and pairs: a worker that waits for its next task, of whatever kind, holds no more than the model."""
        self.cache.clear()
        self.pairs.clear()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """The text of the ids, without the leading space of encode()."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace")[1:] if len(raw) else ""


_CODECS: dict[str, Codec] = {}


def codec(model: str | None = None) -> Codec:
    """One codec for each model file and Python worker."""
    model = model or default_model()
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and `ids` (array<int>). Null and empty texts have no ids; repeated rows stay."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in portions(it, 1, 1000, 8 << 20):
            ids = c.encode_many(part.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype("i4")
            flat = np.concatenate([np.empty(0, "<i4"), *ids])
            yield batch(**{id_col: part.column(0)}, ids=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
        c.forget()

    return arrow_pass(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: its id and the text of its ids; null ids give an empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in it:
            yield batch(**{id_col: b.column(0)}, text=pa.array([c.decode(i or []) for i in b.column(1).to_pylist()], pa.string()))

    return arrow_pass(encoded.select(id_col, ids_col), run, f"`{id_col}` {id_type}, text string")


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers),
    n_bytes of the decoded text, and round_trip, whether it equals the text (null counts as empty)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in portions(it, 1, 1000, 8 << 20):
            n, crc, size, same = [], [], [], []
            texts = b.column(1).to_pylist()
            for t, ids in zip(texts, c.encode_many(texts), strict=True):
                back = c.decode(ids.tolist())
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
                size.append(len(back.encode()))
                same.append(back == (t or ""))
            yield batch(**{id_col: b.column(0)}, n_pieces=pa.array(n, pa.int64()), ids_crc32=pa.array(crc, pa.int64()), n_bytes=pa.array(size, pa.int64()), round_trip=pa.array(same, pa.bool_()))
        c.forget()

    return arrow_pass(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, n_pieces long, ids_crc32 long, n_bytes long, round_trip boolean")
