"""The pipeline against the same five steps done plainly, and on odd and empty tables."""

import hashlib
import os
import random

import pytest
import sentencepiece
import zstandard

import corpus_pipeline
from textloom.llm import quality_rules, sentencepiece_codec
from textloom.llm.common import shared_dir

from .test_llm_operators import DOC, brute_classes, brute_hits, plain_counts, plain_lines


def vocabulary(seed, n=4000):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]


def plain_kept(text):
    """The verdict of the quality rules, step by step."""
    n, _, _, _, rep = plain_counts(text)
    if n < 10 or 100 * rep > 20 * n:
        return False
    b = quality_rules.Bands()
    raw = text.encode()
    size = lambda x: len(zstandard.ZstdCompressor(level=b.level).compress(x)) / len(x)
    low, high = [(a, z) for start, a, z in b.limits if len(raw) >= start][-1]
    ratio = least = size(raw)
    chunks = [raw[i : i + b.chunk_bytes] for i in range(0, len(raw), b.chunk_bytes)]
    full = [size(c) for c in chunks if len(c) == b.chunk_bytes] if len(raw) >= 2 * b.chunk_bytes else []
    if full and len(raw) >= b.long_bytes:
        pieces = full + ([size(raw[-b.chunk_bytes :])] if len(chunks[-1]) < b.chunk_bytes else [])
        low, least = b.long_least, sum(pieces) / len(pieces)
    bad = sum(not b.chunk_limits[0] <= r <= b.chunk_limits[1] for r in full)
    return low <= least and ratio <= high and bad <= b.bad_share * len(full)


def plain_pipeline(rows, items):
    rows = [r for r in rows if plain_kept(r[1])]
    by_place = plain_lines([(k, t, s) for k, (_, t, s) in enumerate(rows)], 10)
    rows = [(i, by_place[k][0], s) for k, (i, _, s) in enumerate(rows)]
    classes = brute_classes([t for _, t, _ in rows], 5, 80)
    least = {}
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())
    for k, r in enumerate(rows):
        c = classes[k][1]
        least[c] = min(least.get(c, key(r)), key(r))
    rows = [r for k, r in enumerate(rows) if r[0] is None or not classes[k][0] or key(r) == least[classes[k][1]]]
    hits = brute_hits(dict(enumerate(t for _, t, _ in rows)), items)
    rows = [r for k, r in enumerate(rows) if not hits[k][4]]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    return sorted(((i, sp.encode(t)) for i, t, _ in rows), key=str)


def write(spark, path, rows, items):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)
    docs.repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def made(seed):
    rng = random.Random(seed)
    words = vocabulary(seed)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.choice([8, 20, 40]))) for i in range(6)] + [(6, None)]
    frame = [f"all rights {prose(6)}" for _ in range(3)]
    rows = []
    for i in range(40):
        rows.append((i, "\n".join([prose(rng.choice([30, 80, 200])), *rng.sample(frame, rng.randint(1, 2))]), f"site{i % 13}"))
    for i in range(40, 52):  # near copies: a word or two of a long text differ
        w = rows[rng.randrange(8)][1].split(" ")
        w[rng.randrange(len(w))] = "zzz"
        rows.append((i, " ".join(w), f"site{i % 13}"))
    rows += [(52 + k, f"{prose(60)} {items[k][1]} {prose(20)}", "site1") for k in range(6)]  # contaminated
    rows += [(60, f"{prose(900)} {items[1][1]}", "site2")]  # a benchmark passage in less than a twentieth
    rows += [(61, None, "site3"), (62, "", None), (63, "few words", "site4"), (64, "spam " * 300, "site5"), (65, "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(3000)), "site6")]
    rows += [(2, prose(70), "site7"), (2, rows[5][1], "site8"), (None, prose(50), None), (None, rows[6][1], "site1"), rows[9], rows[9]]
    rows += [(70, prose(30_000), "site9")]
    return rows, items


@pytest.mark.parametrize("seed", [1])
def test_pipeline_against_plain_steps(spark, tmp_path, seed):
    rows, items = made(seed)
    path = write(spark, tmp_path, rows, items)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:").replace("///", "/")))
    got = sorted(((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, path).collect()), key=str)
    want = plain_pipeline(rows, items)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert got == want
    assert 40 < len(got) < len(rows) - 10
    left = set(os.listdir(shared_dir(spark).removeprefix("file:").replace("///", "/"))) - before
    assert len(left) <= 12  # the last stage's input and what the operators' results read


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, items = made(3)
    path = write(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as _bad", "2 as key", "3 as node", "4 as gone", "5 as row")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert out.where("_bad <> 1 or key <> 2 or node <> 3 or gone <> 4 or `row` <> 5").count() == 0


def test_near_duplicates_go_by_id_and_text(spark, tmp_path):
    a, b = " ".join(vocabulary(5, 60)), " ".join(vocabulary(6, 60))
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, a + " more", "en", "s", 1), (2, b, "en", "s", 1)], DOC)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, a), (2, b)]


def test_pipeline_of_nothing(spark, tmp_path):
    path = write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
    nothing = write(spark, tmp_path / "rejected", [(1, None, None), (2, "", "x"), (2, "too short", "x")], [(1, "some words")])
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_quality_verdicts_against_plain_steps():
    rng = random.Random(9)
    words = vocabulary(9)
    zc = zstandard.ZstdCompressor(level=quality_rules.Bands().level)
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 10, 12, 40, 90, 300, 900, 1500, 4000, 20_000)]
    noise = lambda n: "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(n))
    texts += [" ".join(noise(60) for _ in range(n)) for n in (1, 5, 20, 200)]
    texts += [" ".join(rng.choice(words[:k]) for _ in range(n)) for k in (12, 40, 200) for n in (60, 600, 6000)]
    texts += [texts[8] + " " + " ".join(noise(60) for _ in range(n)) for n in (20, 100, 800)]
    texts += ["é" * 40 + " ".join(words[:50]), None, "", " \n", "x" * 9000]
    verdicts = [quality_rules.judge(t, quality_rules.Bands(), zc)[6] for t in texts]
    assert verdicts == [plain_kept(t) for t in texts]
    assert 5 < sum(verdicts) < len(texts) - 5
