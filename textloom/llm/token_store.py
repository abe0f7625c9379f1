"""Token-ID output: a content-addressed store of id chunks with document recipes and Merkle manifests.

A rolling hash over a window of ids cuts each document's ids into chunks, so that equal stretches of ids give equal
chunks wherever they stand. A chunk is named by the SHA-256 of its ids and stored once. A document is a recipe: the
names of its chunks in order, its place in the stream of all ids, and the Merkle root of the names. Each part of the
recipes has a manifest row with the Merkle root of its documents' roots.

Files (Parquet, written by Spark's writers only): `objects/kind=chunk` (key, data: zstandard frame of the ids as
little-endian integers of `width` bytes), `objects/kind=recipe`, `recipes` (part, doc_id, start, n_tokens, names,
root; ascending doc_id) and `manifest`.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import arrow_pass, batch, portions, shared_dir

WINDOW, LEAST, MOST, MASK = 16, 128, 4096, 511
LOT = 10_000
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of the tokenizers library for whole texts, put together from those of their pieces, many texts at a time.

    Pieces begin at a space or line feed. Where that stands alone between other characters, the library's own
    pre-tokenizer cuts before it as well; and it cuts between a letter or digit and the marks behind it. So the ids of the
    pieces' cores and marks in a row are the ids of the text. Arrow splits the texts and numbers their distinct parts; the
    library sees each part once, as long as it is among the `most` that are kept. Texts with other white space around a
    space or line feed, or at their ends, go to it in whole; so do all texts if the tokenizer isn't byte-level, or changes
    texts before it cuts them. Ids that don't fit into `width` bytes raise an error.
    """

    #: So many new parts make one text for the library; its time for each grows with the text.
    JOIN = 16
    ODD = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}](?:[ \n]|\z)|\A[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|<\|"
    #: ASCII marks at the end of a piece, behind a letter or digit that every version of Unicode has.
    MARKS = r"[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}](?P<marks>[!-/:-@\[-`{-~]+)\z"

    def __init__(self, path: str, width: int = 2, most: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width, self.kind, self.most = width, f"<u{width}", most
        if self.tok.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"ids of {self.tok.get_vocab_size()} pieces don't fit into {width} bytes")
        form = json.loads(self.tok.to_str())
        cutter = form.get("pre_tokenizer") or {}
        #: Whether texts may be cut at spaces: the library cuts there itself and changes nothing before or behind it.
        self.pieces = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not form.get("normalizer") and not form.get("truncation")
        self.size_of = np.ones(self.tok.get_vocab_size(), "i8")  # byte-level pieces spell a byte by one character
        for piece, i in self.tok.get_vocab().items():
            self.size_of[i] = len(piece)
        self._forget()

    def _forget(self) -> None:
        """No part is known: `start` and `length` say where in `ids` each part of `known` has its ids."""
        self.known = pa.array([], pa.large_string())
        self.start, self.length, self.ids = np.empty(0, "i8"), np.empty(0, "i4"), np.empty(0, self.kind)

    def alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> None:
        """Ids of new parts from the library. JOIN of those that begin with white space make one text, whose ids are cut by
        the bytes that each stands for; marks are asked for one by one."""
        fits = pc.match_substring_regex(new, r"\A[ \n]").to_numpy(zero_copy_only=False)
        joined, single = new.filter(pa.array(fits)), new.filter(pa.array(~fits))
        found = self.alone(["".join(joined[k : k + self.JOIN].to_pylist()) for k in range(0, len(joined), self.JOIN)])
        ids = np.concatenate([np.empty(0, self.kind), *found])
        ends, want = np.cumsum(self.size_of[ids]), np.cumsum(pc.binary_length(joined).to_numpy())
        at = np.searchsorted(ends, want)
        if len(want) and (at[-1] != len(ids) - 1 or (ends[at] != want).any()):  # an id across two parts: ask for each
            found = self.alone(joined.to_pylist())
            ids, lengths = np.concatenate(found), [len(f) for f in found]
        else:
            lengths = np.diff(at + 1, prepend=0)
        marks = self.alone(single.to_pylist())
        ids = np.concatenate([ids, *marks])
        length = np.array([*lengths, *map(len, marks)], "i8")
        self.known = pa.concat_arrays([self.known, joined, single])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length.astype("i4")])
        self.ids = np.concatenate([self.ids, ids.astype(self.kind)])

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """Where each of some parts is among the known ones; new ones are learned."""
        coded = parts.dictionary_encode()
        if len(self.known) > self.most:
            self._forget()
        number = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(pc.is_null(number))
        if len(new):
            first = len(self.known)
            self._learn(new)
            order = pc.index_in(new, value_set=self.known.slice(first)).to_numpy() + first
            place = pc.fill_null(number, -1).to_numpy().astype("i8")
            place[place < 0] = order
        else:
            place = number.to_numpy().astype("i8")
        return place[coded.indices.to_numpy()]

    def _cut(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece the numbers of its core and of the marks behind it, -1 without any."""
        whole = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(pa.scalar(" ", pieces.type), pieces, pa.scalar("", pieces.type)))
        marks = pc.struct_field(pc.extract_regex(whole, self.MARKS), [0])
        some = pc.is_valid(marks)
        size = pc.fill_null(pc.binary_length(marks), 0).to_numpy(zero_copy_only=False).astype("i8")
        has = some.to_numpy(zero_copy_only=False)
        # cores are the pieces' bytes less those of the marks
        offsets = np.frombuffer(whole.buffers()[1], "i8", len(whole) + 1, 8 * whole.offset)
        begin, end = offsets[:-1], offsets[1:] - size
        data = np.frombuffer(whole.buffers()[2], "u1")
        length = end - begin
        ends = np.cumsum(length)
        core = pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(np.concatenate([[0], ends]).astype("i8")), pa.py_buffer(data[np.repeat(begin - ends + length, length) + np.arange(ends[-1])]))
        number = self._numbers(pa.concat_arrays([core, marks.filter(some).cast(core.type)]))
        behind = np.full(len(whole), -1)
        behind[has] = number[len(whole) :]
        return number[: len(whole)], behind

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null and empty texts have none."""
        out = [b""] * len(texts)
        if self.pieces:
            odd = pc.fill_null(pc.match_substring_regex(pa.array(texts, pa.large_string()), self.ODD), False).to_numpy(zero_copy_only=False)
        else:
            odd = np.array([bool(t) for t in texts], bool)
        whole = np.flatnonzero(odd).tolist()
        for i, ids in zip(whole, self.alone([texts[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        rest = np.flatnonzero([bool(t) and not o for t, o in zip(texts, odd.tolist(), strict=True)])
        if not len(rest):
            return out
        # a line feed in front makes the first word a piece like others; its id is left out again
        split = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in rest.tolist()], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        core, marks = self._cut(coded.dictionary)
        at = coded.indices.to_numpy()
        core, marks = core[at], marks[at]
        two = marks >= 0
        upto = np.cumsum(1 + two)
        parts = np.empty(upto[-1], "i8")
        parts[upto - 1 - two] = core
        parts[upto[two] - 1] = marks[two]
        start, length = self.start[parts], self.length[parts]
        ends = np.cumsum(length, dtype="i8")
        ids = self.ids[np.repeat(start - ends + length, length) + np.arange(ends[-1])]
        last = np.concatenate([[0], ends])[np.concatenate([[0], upto])[split.offsets.to_numpy()]]
        for i, a, b in zip(rest.tolist(), last[:-1].tolist(), last[1:].tolist(), strict=True):
            out[i] = ids[a + 1 : b].tobytes()
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """One encoder for each tokenizer and Python worker, so that a worker's next task knows the parts of the last one."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


_POWERS = np.ones(1, "u8"), np.ones(1, "u8")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _MULT, "u8"), np.full(size, _INV, "u8")
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0][:n], _POWERS[1][:n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks. The hash of a window is the polynomial of its ids modulo 2**64; its high bits decide, at
    LEAST ids from the last cut at the earliest and MOST at the latest."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    up, down = _powers(n)
    x = ids.astype("u8") + np.uint64(1)
    x = (x * np.uint64(0xD6E8FEB86659FD93)) ^ (x << np.uint64(21))
    total = np.cumsum(x * down, dtype="u8")
    total[WINDOW:] = total[WINDOW:] - total[:-WINDOW]
    h = total * up
    marks = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
    out, last = [], 0
    for m in marks.tolist():
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < n:
            out.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def merkle(names: list[bytes]) -> bytes:
    """Root of the binary hash tree over the names; an odd last one moves up as it is. None: the hash of nothing."""
    if not names:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\x00" + n).digest() for n in names]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


@cache
def _shift(n_bytes: int) -> tuple[int, ...]:
    """What n_bytes zero bytes do to a CRC-32, as the images of its 32 bits."""
    op = tuple([0xEDB88320] + [1 << i for i in range(31)])  # one zero bit
    power, out = n_bytes * 8, tuple(1 << i for i in range(32))
    while power:
        if power & 1:
            out = tuple(_apply(op, v) for v in out)
        op = tuple(_apply(op, v) for v in op)
        power >>= 1
    return out


def _apply(op: tuple[int, ...], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= op[i]
        v >>= 1
        i += 1
    return out


def combine(crc_a: int, crc_b: int, n_bytes_b: int) -> int:
    """CRC-32 of a + b from those of a and b."""
    return _apply(_shift(n_bytes_b), crc_a) ^ crc_b


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write the store below `path`.

    Documents stand in ascending id order, nulls first, equal ids by their chunks' names; repeated rows are repeated
    documents that share their chunks. Null and empty texts hold end_id alone. An empty table gives empty files.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = f"<u{width}"

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zc, seen = encoder(tokenizer, width), zstandard.ZstdCompressor(level=1), set()
        end = np.array([end_id], kind).tobytes()
        for some in portions(it, 1, 2000, 6 << 20):
            if some.num_rows:
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for i, raw in zip(some.column(0).to_pylist(), enc.batch(some.column(1).to_pylist()), strict=True):
                    ids = np.frombuffer(raw + end, kind)
                    names, last = [], 0
                    for stop in cuts(ids):
                        piece = ids[last:stop].tobytes()
                        names.append(name := hashlib.sha256(piece).digest())
                        last = stop
                        if name not in seen:
                            if len(seen) < 200_000:
                                seen.add(name)
                            for c, v in zip(cols, ("chunk", name, zc.compress(piece), None, None, None), strict=True):
                                c.append(v)
                    key = hashlib.sha256(b"".join([b"-" if i is None else i.to_bytes(8, "big", signed=True), *names])).digest()
                    for c, v in zip(cols, ("recipe", key, None, i, len(ids), names), strict=True):
                        c.append(v)
                yield batch(kind=pa.array(cols[0], pa.string()), key=pa.array(cols[1], pa.binary()), data=pa.array(cols[2], pa.binary()), doc_id=pa.array(cols[3], pa.int64()), n_tokens=pa.array(cols[4], pa.int64()), names=pa.array(cols[5], pa.list_(pa.binary())))

    rows = arrow_pass(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), encode, "kind string, key binary, data binary, doc_id long, n_tokens long, names array<binary>")
    # a document's key is its id and content, so that a repeated task writes the same rows; equal documents are counted
    first = rows.groupBy("kind", "key").agg(*(F.first(c).alias(c) for c in ("data", "doc_id", "n_tokens", "names")), F.count("*").alias("copies"))
    first.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    spark = docs.sparkSession
    recipes = spark.read.schema("key binary, data binary, doc_id long, n_tokens long, names array<binary>, copies long, kind string").parquet(f"{path}/objects").where("kind = 'recipe'")
    # a row for each copy, in two steps of at most LOT rows from one
    recipes = recipes.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / LOT))))
    recipes = recipes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(LOT), F.col("copies") - F.col("lot") * LOT))))
    recipes = recipes.select("doc_id", "n_tokens", "names", F.xxhash64("names").alias("tie"))
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def roots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in it:
            n = b.column("n_tokens").to_numpy(zero_copy_only=False)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield batch(part=pa.array([part] * len(n), pa.int32()), doc_id=b.column("doc_id"), offset=pa.array(before, pa.int64()), n_tokens=b.column("n_tokens"), names=b.column("names"), root=pa.array([merkle(x) for x in b.column("names").to_pylist()], pa.binary()))

    arrow_pass(ordered, roots, "part int, doc_id long, offset long, n_tokens long, names array<binary>, root binary").write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(spark, path).write.parquet(f"{path}/manifest")


RECIPES = "part int, doc_id long, offset long, n_tokens long, names array<binary>, root binary"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each part of the recipes: documents, ids, ids before it, and the Merkle root of its documents' roots."""

    def tree(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, n = None, [], 0
        done: list[tuple] = []
        for b in it:
            for p, k, r in zip(*(b.column(c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
                if p != part and part is not None:
                    done.append((part, len(names), n, merkle(names)))
                    names, n = [], 0
                part = p
                names.append(r)
                n += k
        if part is not None:
            done.append((part, len(names), n, merkle(names)))
        cols = list(zip(*done, strict=True)) or [[]] * 4
        yield batch(part=pa.array(cols[0], pa.int32()), n_docs=pa.array(cols[1], pa.int64()), n_tokens=pa.array(cols[2], pa.int64()), root=pa.array(cols[3], pa.binary()))

    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("part", "offset", "doc_id", "n_tokens", "root")
    by_part = arrow_pass(recipes.repartition("part").sortWithinPartitions("part", "offset"), tree, "part int, n_docs long, n_tokens long, root binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    return by_part.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_chunks(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(name, crc, n_bytes): every stored chunk, its name checked against its ids, with the CRC-32 of these as
    unsigned 32-bit integers. A chunk that isn't what its name says raises an error."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zd = zstandard.ZstdDecompressor()
        for b in it:
            names, crc, size = b.column(0).to_pylist(), [], []
            for name, data in zip(names, b.column(1).to_pylist(), strict=True):
                raw = zd.decompress(data)
                if hashlib.sha256(raw).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                wide = np.frombuffer(raw, f"<u{width}").astype("<u4")
                crc.append(zlib.crc32(wide))
                size.append(wide.nbytes)
            yield batch(name=b.column(0), crc=pa.array(crc, pa.int64()), n_bytes=pa.array(size, pa.int64()))

    chunks = spark.read.schema("key binary, data binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'")
    return arrow_pass(chunks.select("key", "data"), run, "name binary, crc long, n_bytes long")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    starts = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("_before"))
    return recipes.join(starts, "part").withColumn("start", F.col("_before") + F.col("offset")).drop("_before")


def verify(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, n_chunks. The CRC of a document is put together from those
    of its chunks in recipe order; recipes whose Merkle root or length doesn't agree with their chunks raise an error."""
    placed = _placed(spark, path)
    each = placed.select("doc_id", "start", "n_tokens", "root", F.posexplode("names").alias("pos", "name"))
    joined = each.join(read_chunks(spark, path, width), "name", "left")
    # start alone names a document: every document holds one id at least
    docs = joined.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("pos", "name", "crc", "n_bytes"))).alias("parts"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            crcs, count = [], []
            for n, root, parts in zip(*(b.column(c).to_pylist() for c in ("n_tokens", "root", "parts")), strict=True):
                if any(p["crc"] is None for p in parts) or sum(p["n_bytes"] for p in parts) != 4 * n or merkle([p["name"] for p in parts]) != root:
                    raise ValueError("a recipe doesn't agree with its chunks")
                crc = 0
                for p in parts:
                    crc = combine(crc, p["crc"], p["n_bytes"])
                crcs.append(crc)
                count.append(len(parts))
            yield batch(doc_id=b.column("doc_id"), start=b.column("start"), n_tokens=b.column("n_tokens"), ids_crc32=pa.array(crcs, pa.int64()), n_chunks=pa.array(count, pa.int64()))

    return arrow_pass(docs, run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Per document, from the files: doc_id, start and all its ids (array<int>), checked chunk by chunk."""
    chunks = spark.read.schema("key binary, data binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'").select(F.col("key").alias("name"), "data")
    each = _placed(spark, path).select("doc_id", "start", F.posexplode("names").alias("pos", "name"))
    docs = each.join(chunks, "name").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("pos", "name", "data"))).alias("parts"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zd = zstandard.ZstdDecompressor()
        for b in it:
            out = []
            for parts in b.column("parts").to_pylist():
                raws = [zd.decompress(p["data"]) for p in parts]
                if any(hashlib.sha256(r).digest() != p["name"] for r, p in zip(raws, parts, strict=True)):
                    raise ValueError("a chunk is damaged")
                out.append(np.frombuffer(b"".join(raws), f"<u{width}").astype("i4"))
            yield batch(doc_id=b.column("doc_id"), start=b.column("start"), ids=pa.array([o.tolist() for o in out], pa.list_(pa.int32())))

    return arrow_pass(docs, run, "doc_id long, start long, ids array<int>")


def token_store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the store (below the shared folder unless a path is given) and return verify()'s rows, read from its files."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer)
    return verify(spark, path)
