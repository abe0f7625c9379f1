"""N-gram Jaccard join: a grouped prefix join over the sets of word shingles.

Documents with the same set form one class. A class's shingles are put in one global order, rare before common; two
sets of Jaccard similarity t can only link if the first n - ceil(t n) + 1 shingles of each, their prefixes, share one.
Classes with identical prefixes and size form one group. Groups meet through the shingles of their prefixes and pass
the length, position and signature filters as pairs; only then are they expanded into their members, and each pair of classes is
verified on whole sets.

A shingle that many groups hold in their prefix would make a pair of each two of them. There, first, the groups are
verified against a few pivots only, in rounds: the links make components, and the next pivots come from outside the
shingle's largest one. Afterwards only groups outside of it are compared with the others, as pairs inside a component
can add no connection. So no link between different components is lost, and a large group of near copies costs a few
passes over its members.

Before whole texts travel, pairs of classes meet a second signature, with a bit for each shingle: sets of thousands of
shingles, whose short signatures are full, are told apart by it without their texts.

The order comes from a sketch of fixed size that counts all shingles of all documents in `SLOTS` counters; ties go by
the shingle's hash. Any order gives the same links; a good one only keeps the candidates few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, batch, components, drop, hold, portions

SLOTS = 1 << 20
SLICES = 32
#: Texts are cut into shingles so many, or so many bytes, at a time.
ROWS, BYTES = 1000, 6 << 20
#: Bits of the filter that picks the texts to verify: 16 for each wanted text, and a power of two between these.
FILTER_BITS = (1 << 16, 1 << 30)


#: A random number for each place in a word, modulo 256, and byte.
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 1 << 16, dtype="u8")
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of words: the sum of the numbers of their bytes, each in its place, mixed."""
    offsets = np.frombuffer(words.buffers()[1], "i4", len(words) + 1, 4 * words.offset).astype("i8")
    lengths = np.diff(offsets)
    if not len(words) or not offsets[-1] > offsets[0]:
        return np.zeros(len(words), "u8")
    data = np.frombuffer(words.buffers()[2], "u1")[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    value = _TABLE[(place & 255) << 8 | data]
    if lengths.max() > 256:
        value *= (2 * (place >> 8) + 1).astype("u8")
    out = np.zeros(len(words), "u8")
    full = lengths > 0
    out[full] = np.add.reduceat(value, starts[full])
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k neighbours."""
    n = len(h)
    x = np.full(n - k + 1, 0x9E3779B97F4A7C15 + k, "u8")
    for i in range(k):
        x = (x ^ h[i : n - k + 1 + i]) * _MIX
        x ^= x >> np.uint64(32)
    return x


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles; with fewer words than `width`, of the whole sequence;
    none without words. Lower case changes A-Z alone, words are cut at the six ASCII spaces, in all texts at once."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(low)
    coded = split.flatten().dictionary_encode()
    h = word_hashes(coded.dictionary)[coded.indices.to_numpy()]
    ends = split.offsets.to_numpy().tolist()
    empty = pc.equal(low, "").to_pylist()
    every = _mixed(h, width) if len(h) >= width else None
    for a, b, none in zip(ends, ends[1:], empty, strict=False):
        if none:
            yield np.empty(0, "u8")
            continue
        x = np.sort(every[a : b - width + 1]) if b - a >= width else _mixed(h[a:b], b - a)
        new = np.empty(len(x), bool)
        new[0] = True
        np.not_equal(x[1:], x[:-1], out=new[1:])
        yield x[new]


def shingles(text: str | None, width: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), width))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Name of a set, and a second hash, both signed 64-bit integers."""
    h = xxhash.xxh3_128_intdigest(s.tobytes(), len(s))
    return tuple(np.array([h & 0xFFFFFFFFFFFFFFFF, h >> 64], "u8").view("i8").tolist())


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype("i8")


def least_overlap(n1, n2, percent: int):
    """Least common shingles of two linked sets: percent * (n1 + n2) / (100 + percent), rounded up."""
    return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent) - F.lit(1e-9))


def _scan(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(slice, counts): of each task its part of the sketch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SLOTS, "u4")
        for b in portions(it, 0, ROWS, BYTES):
            found = np.concatenate([np.empty(0, "u8"), *shingle_sets(b.column(0), width)])
            sketch += np.bincount(_slots(found), minlength=SLOTS).astype("u4")
        parts = sketch.reshape(SLICES, -1)
        used = [i for i in range(SLICES) if parts[i].any()]
        yield batch(slice=pa.array(used, pa.int32()), counts=pa.array([parts[i].tobytes() for i in used], pa.binary()))

    return arrow_pass(docs.select(text_col), run, "slice int, counts binary")


def _sketch(scan: DataFrame) -> np.ndarray:
    """The summed sketch, SLOTS numbers of 32 bits, in the driver."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(c, "u4").astype("u8")
                total[i] = total[i] + part if i in total else part
        rows = [np.minimum(v, 0xFFFFFFFF).astype("u4").tobytes() for v in total.values()]
        yield batch(slice=pa.array(list(total), pa.int32()), counts=pa.array(rows, pa.binary()))

    parts = scan.repartition(SLICES, "slice")
    sketch = np.zeros((SLICES, SLOTS // SLICES), "u4")
    for r in arrow_pass(parts, add, "slice int, counts binary").collect():
        sketch[r["slice"]] = np.frombuffer(r["counts"], "u4")
    return sketch.reshape(-1)


def signature(s: np.ndarray) -> np.ndarray:
    """Four 64-bit integers: of each of 256 classes of shingles, whether the set has an odd number of them.

    Sets that differ in d shingles differ in d bits at most, so that more bits than a link allows rule it out.
    """
    bits = np.bincount((s & np.uint64(255)).astype("i8"), minlength=256) & 1
    return np.packbits(bits.astype("u1"), bitorder="little").view("i8")


def wide_signature(s: np.ndarray) -> bytes:
    """The same with a power of two of classes, 256 or the next one to the number of shingles."""
    size = max(256, 1 << (len(s) - 1).bit_length())
    bits = np.bincount((s & np.uint64(size - 1)).astype("i8"), minlength=size) & 1
    return np.packbits(bits.astype("u1"), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two wide signatures differ; the longer one is folded to the length of the other."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    size = 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _prefixes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, n, node, check, prefix, s0..s3, wide), a row for each row of docs: the set's size, its name and
    second hash, its first shingles in the order of the sketch, and its signatures. A set that the task has seen already
    has neither prefix nor signatures."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = shared.value, set()
        for b in portions(it, 2, ROWS, BYTES):
            names, n, prefix, sig = [], [], [], []
            for s in shingle_sets(b.column(2), width):
                k = len(s)
                n.append(k)
                names.append(h := set_hash(s) if k else (None, None))
                whole = h[0] << 64 ^ h[1] if k else 0
                if not k or whole in seen:
                    prefix.append(None)
                    sig.append((None,) * 5)
                    continue
                if len(seen) < 200_000:
                    seen.add(whole)
                take = k - -(-percent * k // 100) + 1
                prefix.append(s[np.argsort(count[_slots(s)], kind="stable")[:take]].view("i8"))
                sig.append((*signature(s).tolist(), wide_signature(s)))
            name = {c: pa.array([x[i] for x in names], pa.int64()) for i, c in enumerate(("node", "check"))}
            sigs = {f"s{i}": pa.array([x[i] for x in sig], pa.int64()) for i in range(4)}
            yield batch(doc_id=b.column(0), text_hash=b.column(1), n=pa.array(n, pa.int64()), **name, prefix=pa.array(prefix, pa.list_(pa.int64())), **sigs, wide=pa.array([x[4] for x in sig], pa.binary()))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text_col).alias("text_hash"), text_col)
    return arrow_pass(d, run, "doc_id long, text_hash string, n long, node long, check long, prefix array<long>, s0 long, s1 long, s2 long, s3 long, wide binary")


def _bit(text_hash, size: int):
    """A text's bit in a filter of `size` bits, a power of two up to 2 ** 32."""
    return F.pmod(F.conv(F.substring(text_hash, 1, 8), 16, 10).cast("long"), F.lit(size))


def _filter_bits(hashes: DataFrame, size: int) -> bytes:
    """A bit for each class of the column `hash`."""
    slices = 64

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for b in it:
            at = b.column(0).to_numpy()
            for i in np.unique(at // (size // slices)).tolist():
                bits.setdefault(i, np.zeros(size // slices, "u1"))[at[at // (size // slices) == i] % (size // slices)] = 1
        yield batch(slice=pa.array(list(bits), pa.int32()), bits=pa.array([np.packbits(x).tobytes() for x in bits.values()], pa.binary()))

    bit = _bit("hash", size)
    some = hashes.select(bit.alias("bit")).distinct().repartition(slices, (F.col("bit") / F.lit(size // slices)).cast("int"))
    out = np.zeros((slices, size // slices // 8), "u1")
    for r in arrow_pass(some, pack, "slice int, bits binary").collect():
        out[r["slice"]] = out[r["slice"]] | np.frombuffer(r["bits"], "u1")
    return out.tobytes()


def _with_texts(docs: DataFrame, text_col: str, hashes: DataFrame, wanted: int) -> DataFrame:
    """(hash, text) of the texts whose hash is in the column `hash`, and of some more; `wanted` is about how many."""
    size = min(max(1 << (16 * wanted).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(hashes, size))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = np.frombuffer(shared.value, "u1"), set()
        for b in it:
            at = b.column(0).to_numpy(zero_copy_only=False)
            wanted = (have[at >> 3] >> (7 - (at & 7)).astype("u1")) & 1 == 1
            names = b.column(1)
            for i in np.flatnonzero(wanted).tolist():
                if (h := names[i].as_py()) in seen:
                    wanted[i] = False
                elif len(seen) < 100_000:
                    seen.add(h)
            yield b.select([1, 2]).filter(pa.array(wanted))

    d = docs.where(F.col(text_col).isNotNull()).select(F.md5(text_col).alias("hash"), F.col(text_col).alias("text")).select(_bit("hash", size).alias("bit"), "hash", "text")
    return arrow_pass(d, run, "hash string, text string").groupBy("hash").agg(F.first("text").alias("text"))


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, ha, hb): of pairs (a, b) of classes those that sizes and wide signatures allow, with their texts' hashes."""
    of = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"), F.col("text_hash").alias(f"h{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    both = both.withColumn("_most", F.col("na") + F.col("nb") - 2 * least_overlap(F.col("na"), F.col("nb"), percent))
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in it:
            near = [differing(x, y) <= most for x, y, most in zip(*(some.column(i).to_pylist() for i in (4, 5, 6)), strict=True)]
            yield some.select([0, 1, 2, 3]).filter(pa.array(near, pa.bool_()))

    return arrow_pass(both.select("a", "b", "ha", "hb", "wa", "wb", "_most"), run, "a long, b long, ha string, hb string")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b, ha, hb) of classes and their texts' hashes, (a, b) of those whose whole sets link.

    The texts travel, not the sets: they are a third of the size, and a set is cut again where it is needed.
    """
    both = pairs.join(texts.toDF("ha", "ta"), "ha").join(texts.toDF("hb", "tb"), "hb").select("a", "b", "ta", "tb")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in portions(portions(it, 2, ROWS, BYTES), 3, ROWS, BYTES):
            a, b = some.column(0).to_pylist(), some.column(1).to_pylist()
            # each class is cut once, at the place where it comes first
            first = {x: (2, i) for i, x in reversed(list(enumerate(a)))}
            first |= {x: (3, i) for i, x in reversed(list(enumerate(b))) if x not in first}
            sets: dict[int, np.ndarray] = {}
            for c in (2, 3):
                nodes = [x for x, (at, _) in first.items() if at == c]
                texts = some.column(c).take(pa.array([first[x][1] for x in nodes], pa.int64()))
                sets.update(zip(nodes, shingle_sets(texts, width), strict=True))
            link = []
            for x, y in zip(a, b, strict=True):
                sa, sb = sets[x], sets[y]
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                link.append(100 * common >= percent * (len(sa) + len(sb) - common))
            yield some.select([0, 1]).filter(pa.array(link, pa.bool_()))

    return arrow_pass(both, run, "a long, b long")


def _expand(group_pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of the members of paired groups."""
    a, b = members.select(F.col("gid").alias("g1"), F.col("node").alias("x")), members.select(F.col("gid").alias("g2"), F.col("node").alias("y"))
    pairs = group_pairs.join(a, "g1").join(b, "g2").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _named_apart(scan: DataFrame, early: list[str], scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """The scan and its classes, a row for each name; sets that share a name by chance get names of their own.

    A name stands for different sets if their second hashes differ. There are few of these, if any: they are counted, and
    renamed by a broadcast join.
    """

    def classes_of(scan: DataFrame) -> DataFrame:
        given = ("n", "gid", "prefix_check", *(f"s{i}" for i in range(4)), "wide")
        each = scan.where("prefix is not null").withColumns({"gid": F.xxhash64("n", "prefix"), "prefix_check": F.xxhash64(F.lit(5), "prefix")})
        some = each.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.min("check").alias("check"), F.max("check").alias("other"), *(F.first(c).alias(c) for c in given))
        return hold(some, scratch)

    classes = classes_of(scan)
    most = 100_000
    twice = classes.where("check <> other").select(F.col("node").alias("_node"), F.col("check").alias("_check")).limit(most).collect()
    if len(twice) == most:
        raise ValueError("too many sets share a name: the hash doesn't tell them apart")
    if twice:
        names = F.broadcast(scan.sparkSession.createDataFrame(twice, "_node long, _check long"))
        other = F.col("_node").isNotNull() & (F.col("check") != F.col("_check"))
        joined = scan.join(names, scan["node"] == names["_node"], "left")
        scan = hold(joined.withColumn("node", F.when(other, F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("_node", "_check"), early)
        classes = classes_of(scan)
    return scan, classes


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hot: int = 16, rounds: int = 4) -> DataFrame:
    """(doc_id, n_shingles, node, component_id, text_hash, stays), a row for each row of docs.

    Two documents link when 100 * |A and B| >= percent * |A or B|; component_id is the smallest id that links reach.
    Null and empty texts have no shingles, no node, and their own id as component. A null id never becomes a
    component's id unless all of its are null. Repeated rows stay, each with the same component. Ids are integers;
    other columns are left aside. An empty table gives an empty result. text_hash is the text's MD5; stays is true for
    rows without shingles, and for the rows of one document of each component, that of the least (doc_id, text_hash).
    Shingles that more than `hot` groups hold are met by pivots first, in `rounds` rounds at most; both only bear on the
    work, not on the result. Tables in between are deleted; the one that the result reads stays in the shared folder.
    """
    spark, early, scratch = docs.sparkSession, [], []
    sketch = _sketch(_scan(docs, text_col, width))
    scan, classes = _named_apart(hold(_prefixes(docs, id_col, text_col, width, percent, sketch), early), early, scratch)
    sig = [f"s{i}" for i in range(4)]
    members = classes.select("node", "gid")
    # a group's name can stand for several prefixes by chance: it then has no size, and passes the filters. Nor is the
    # signature of a group of several anyone's
    one, alike = F.count("*") == 1, F.min("prefix_check") == F.max("prefix_check")
    made = (F.when(alike, F.first("n")).alias("n"), F.count("*").alias("size"), F.min("node").alias("low"), *(F.when(one, F.first(c)).alias(c) for c in sig))
    groups = hold(classes.groupBy("gid").agg(*made), scratch)
    rows = hold(scan.select("doc_id", "n", "node", "text_hash"), scratch)
    # dealt out by shingle once; members of a group, and repeats of a class, give the same rows
    posted = scan.where("prefix is not null").select(F.xxhash64("n", "prefix").alias("gid"), F.posexplode("prefix").alias("pos", "tok")).repartition("tok").groupBy("tok", "gid").agg(F.first("pos").alias("pos"))
    shared = posted.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    postings = hold(posted.join(shared, "tok").join(groups.select("gid", "n", *sig), "gid"), scratch)
    del posted, shared, scan
    drop(spark, early)

    def fits(p: DataFrame) -> DataFrame:
        """The length filter, the bound on the overlap by the places of the common shingle, and the signatures' bound."""
        n1, n2 = F.col("n1"), F.col("n2")
        overlap = least_overlap(n1, n2, percent)
        rest = F.least(n1 - F.col("pos1"), n2 - F.col("pos2"))
        differ = sum((F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in sig[1:]), F.bit_count(F.col("s01").bitwiseXOR(F.col("s02"))))
        sure = lambda test: F.coalesce(test, F.lit(True))
        return p.where(sure(100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & sure(rest >= overlap) & sure(differ <= n1 + n2 - 2 * overlap))

    side = lambda p, i, *more: p.select("tok", *more, *(F.col(c).alias(f"{c}{i}") for c in ("gid", "n", "pos", *sig)))
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def group_components(known: DataFrame) -> DataFrame:
        """(gid, lo, hi): least and greatest component of a group's members."""
        placed = members.join(known, "node", "left").select("gid", F.coalesce("comp", "node").alias("comp"))
        return placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))

    def marked(some: DataFrame, of_groups: DataFrame) -> DataFrame:
        """Postings with the component of their group; a group whose members disagree is its own."""
        comp = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.xxhash64("gid")).alias("comp")
        return some.join(of_groups.select("gid", comp), "gid")

    def outside(some: DataFrame) -> DataFrame:
        """Postings that aren't in their shingle's largest component: each pair of components has one of these."""
        main = some.groupBy("tok", "comp").agg(F.count("*").alias("k")).groupBy("tok").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
        return some.join(main, "tok").where("comp <> main")

    def verified(near: DataFrame, keep: list[str]) -> DataFrame:
        """(a, b): the links among near pairs, by whole texts."""
        hashes = near.select(F.col("ha").alias("hash")).unionByName(near.select(F.col("hb").alias("hash"))).distinct()
        texts = _with_texts(docs, text_col, hashes, 2 * near.count())
        return hold(_linked(near, texts, width, percent), keep)

    # rounds of pivots where many groups hold a shingle
    busy = hold(postings.where(F.col("df") > hot), scratch)
    own = members.join(groups.where("size > 1").select("gid", "low"), "gid").where("node <> low").select(*ordered(F.col("low"), F.col("node")))
    kept = len(scratch)
    near = hold(_near(own, classes, percent), scratch)
    links = verified(near, scratch)
    known = components(links, scratch)
    first_of = groups.select("gid", "low")
    entry = F.struct("gid", "n", "pos", *sig, "comp")
    for round_ in range(rounds):
        step: list[str] = []
        now = hold(marked(busy, group_components(known)), step)
        picks = outside(now).groupBy("tok").agg(*(F.min_by(entry, F.xxhash64("gid", F.lit(4 * round_ + i))).alias(f"p{i}") for i in range(4)))
        pivots = picks.select("tok", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(4))))).alias("p")).select("tok", "p.*")
        met = fits(side(pivots, 1, F.col("comp").alias("comp1")).join(side(now, 2, F.col("comp").alias("comp2")), "tok").where("comp1 <> comp2"))
        met = met.select(*ordered(F.col("gid1"), F.col("gid2"))).distinct().toDF("g1", "g2")
        pairs = met.join(first_of.toDF("g1", "x"), "g1").join(first_of.toDF("g2", "y"), "g2").select(*ordered(F.col("x"), F.col("y")))
        new = verified(hold(_near(pairs, classes, percent), step), step)
        if new.isEmpty():
            drop(spark, step)
            break
        old = scratch[kept:]
        del scratch[kept:]
        links = hold(links.unionByName(new), scratch)
        known = components(links, scratch)
        drop(spark, old + step)

    # all that is left to compare, in whole
    step = []
    of_groups = hold(group_components(known), step)
    now = hold(marked(postings, of_groups), step)
    pairs = side(outside(now), 1, F.col("comp").alias("comp1")).join(side(now, 2, F.col("comp").alias("comp2")), "tok").where("comp1 <> comp2")
    found = fits(pairs).select(F.least("gid1", "gid2").alias("g1"), F.greatest("gid1", "gid2").alias("g2")).distinct()
    split = of_groups.where("lo <> hi").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    late: list[str] = []
    near = hold(_near(_expand(found.unionByName(split), members), classes, percent), late)
    drop(spark, step)
    links = verified(near, late)
    # the components so far are nodes now: many links between two of them are one edge
    at = lambda d, c: d.join(known.toDF(c, f"_{c}"), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    merged = components(at(at(links, "a"), "b").where("a <> b").distinct(), late).toDF("comp", "_comp")

    keyed = rows.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(merged, "comp", "left")
    keyed = hold(keyed.withColumn("comp", F.coalesce("_comp", "comp")).drop("_comp"))
    drop(spark, scratch + late)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    least = keyed.where("comp is not null").groupBy("comp").agg(F.coalesce(first, F.min(F.struct("doc_id", "text_hash"))).alias("least"))
    out = keyed.join(least, "comp", "left")
    alone = F.col("comp").isNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "node", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), "text_hash",
        (alone | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("text_hash").eqNullSafe(F.col("least.text_hash")))).alias("stays"),
    )


def oracle(width: int = 3, percent: int = 90, table: str = "documents") -> str:
    """DuckDB SQL for (doc_id, n_shingles, component_id), by joining all shingles: for small tables."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM {table}),
s AS (SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
 ELSE list_distinct([array_to_string(words[i:i + {width - 1}], ' ') FOR i IN range(1, len(words) - {width - 2})]) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c a ON a.rep = x JOIN c b ON b.rep = y WHERE 100 * shared >= {percent} * (len(a.sh) + len(b.sh) - shared)),
d AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rep AS v, rep AS u FROM c UNION SELECT r.v, d.y FROM r JOIN d ON r.u = d.x),
k AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.sh) > 0 AND c.sh = s.sh LEFT JOIN k ON k.v = c.rep"""
