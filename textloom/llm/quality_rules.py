"""Quality rules: word and line counts, then zstandard compression bands over whole texts and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_pass, batch

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Compression limits. `limits`: from so many bytes on, the least and greatest ratio (compressed by raw size).

    Short texts carry the frame's own bytes, so that below 200 bytes no upper limit holds. Printable noise, such as
    base64, compresses to about three quarters, prose of 1,000 bytes or more to three fifths at most. A text of several
    chunks goes, too, if more than `bad_share` of its full chunks lie outside `chunk_limits`.

    The ratio of a whole text falls with its length, also that of clean prose (0.42 at 30 KB, under 0.39 at 300 KB). From
    `long_bytes` on the least ratio therefore is one of equal pieces: the mean of all chunks, the last one flush with the
    end, is `long_least` at least, whatever the length.
    """

    level: int = 3
    limits: tuple[tuple[int, float, float], ...] = ((0, 0.35, 1e9), (200, 0.52, 0.95), (500, 0.485, 0.82), (1000, 0.45, 0.74), (2000, 0.425, 0.70), (5000, 0.408, 0.68), (10000, 0.388, 0.68))
    chunk_bytes: int = 4096
    chunk_limits: tuple[float, float] = (0.37, 0.70)
    bad_share: float = 0.5
    long_bytes: int = 16384
    long_least: float = 0.42

    def of(self, n: int) -> tuple[float, float]:
        low, high = 0.0, 1e9
        for start, a, b in self.limits:
            if n >= start:
                low, high = a, b
        return low, high


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has none of them.

    bytes.split() splits at exactly the six ASCII spaces that end a word here.
    """
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return n, len(text) - spaces, sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words inside windows of k words that are found twice or more in the text."""
    n = len(words)
    if n <= k:
        return 0
    windows = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    hit: set[int] = set()
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit.add(i)
            hit.add(j)
    total, end = 0, 0
    for i in sorted(hit):
        total += i + k - max(i, end)
        end = i + k
    return total


def compression_ok(raw: bytes, bands: Bands, zc: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, its full chunks, those out of their band, and the verdict. Empty: 0, 0, 0, kept."""
    if not raw:
        return 0.0, 0, 0, True
    ratio = len(zc.compress(raw)) / len(raw)
    low, high = bands.of(len(raw))
    size, chunks, bad = bands.chunk_bytes, 0, 0
    least = ratio
    if len(raw) >= 2 * size:
        pieces = [len(zc.compress(raw[i : i + size])) / size for i in range(0, len(raw) - size + 1, size)]
        chunks = len(pieces)
        bad = sum(not bands.chunk_limits[0] <= r <= bands.chunk_limits[1] for r in pieces)
        if len(raw) >= bands.long_bytes:
            if len(raw) % size:
                pieces.append(len(zc.compress(raw[-size:])) / size)
            low, least = bands.long_least, sum(pieces) / len(pieces)
    return ratio, chunks, bad, low <= least and ratio <= high and bad <= bands.bad_share * chunks


def judge(text: str | None, bands: Bands, zc: zstandard.ZstdCompressor) -> tuple:
    n, chars, symbols, dup, rep = counts(text)
    failed = n < 10 or 100 * rep > 20 * n
    ratio, chunks, bad, fits = compression_ok((text or "").encode("utf-8", "surrogatepass"), bands, zc)
    return n, chars, symbols, dup, rep, failed, not failed and fits, ratio, chunks, bad


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "zstd_ratio": pa.float64(), "n_chunks": pa.int64(), "n_bad_chunks": pa.int64(),
}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long"


def quality_rules(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, the counts, base_failed, kept and the compression figures.

    A null or empty text has no words, so that it fails the base rule and isn't kept. Repeated rows are judged
    each; a null id stays null; other columns are left aside; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zc = zstandard.ZstdCompressor(level=bands.level)
        for b in it:
            rows = list(zip(*(judge(t, bands, zc) for t in b.column(1).to_pylist()), strict=True)) or [[]] * len(COLUMNS)
            yield batch(**{id_col: b.column(0)}, **{k: pa.array(r, t) for (k, t), r in zip(COLUMNS.items(), rows, strict=True)})

    return arrow_pass(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, {SCHEMA}")


def keep_good(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, in one pass and without a join."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zc = zstandard.ZstdCompressor(level=bands.level)
        for b in it:
            i = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([judge(t, bands, zc)[6] for t in b.column(i).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
