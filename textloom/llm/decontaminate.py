"""Benchmark decontamination with a positional inverted index, with DataFrame functions only.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). The postings of the training
texts, (term, document, position), are stored once for the terms that the searches ask for, and serve all of them.

An exact search starts from a window's two rarest terms: their posting lists, each less the term's offset in the item,
are intersected on (document, item, shift). As every window holds its own rarest terms, every occurrence is found. A
posting also has the words around it, on which the rest of the window is then checked word by word. A proximity search
intersects the lists of an item's rarest words by a range of positions instead of a shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of digits, a-z and letters beyond ASCII, A-Z lower-cased; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), lambda w: w != "")


def _small(terms: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Broadcast a term table only where it is counted to be small."""
    n = terms.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("b")).first()
    return F.broadcast(terms) if n["n"] <= most_rows and (n["b"] or 0) <= most_bytes else terms


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text", most_rows: int = 200_000, most_bytes: int = 8 << 20) -> DataFrame:
    """(term, df): how often each of the terms stands in all texts; 0 for those that don't."""
    found = docs.select(F.explode(words_of(F.col(text_col))).alias("term")).join(_small(terms, most_rows, most_bytes), "term").groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, reach: int = 12, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most_rows: int = 200_000, most_bytes: int = 8 << 20) -> DataFrame:
    """The stored postings (term, key, pos, before, after): position from 0, up to `reach` words before and after it.

    `terms` limits the index to what searches need; without it all terms are stored. With `path` the index is written
    there, to be read again by later searches; else into the shared folder. Terms that are few are looked up where the
    texts are. If they are many, postings of three numbers and a word are dealt out to them, and those that are left meet
    their document once: no row of a word ever takes its whole document along.
    """
    d = docs.select(document_key(id_col, text_col).alias("key"), words_of(F.col(text_col)).alias("w"))
    sought = None if terms is None else _small(terms, most_rows, most_bytes)
    if sought is None or sought is not terms:  # no terms, or a broadcast of few
        each = d.select("key", "w", F.posexplode("w").alias("pos", "term"))
        each = each if sought is None else each.join(sought, "term")
    else:
        hits = d.select("key", F.posexplode("w").alias("pos", "term")).join(terms, "term").groupBy("key").agg(F.collect_set(F.struct("pos", "term")).alias("hits"))
        each = d.dropDuplicates(["key"]).join(hits, "key").select("key", "w", F.inline("hits"))
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    out = each.select("term", "key", "pos", F.slice("w", first + 1, F.col("pos") - first).alias("before"), F.slice("w", F.col("pos") + 2, F.lit(reach)).alias("after"))
    if path is None:
        return hold(out)
    out.write.parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def windows(items: DataFrame, counts: DataFrame, size: int = 13) -> DataFrame:
    """(item, n, words, p1, p2): for each window of an item the places of its rarest and second rarest word."""
    each = items.select("item", F.posexplode("words").alias("pos", "term")).join(counts, "term")
    back = each.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", "df", "term"))).alias("t"))
    n = F.size("t")
    span = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    order = lambda s: F.sort_array(F.transform(F.slice("t", s, size), lambda x: F.struct(x["df"].alias("df"), x["term"].alias("term"), x["pos"].alias("pos"))))
    pairs = F.array_distinct(F.transform(span, lambda s: F.struct(F.get(order(s), F.lit(0))["pos"].alias("p1"), F.coalesce(F.get(order(s), F.lit(1))["pos"], F.get(order(s), F.lit(0))["pos"]).alias("p2"))))
    return back.select("item", n.alias("n"), F.transform("t", lambda x: x["term"]).alias("words"), F.explode(pairs).alias("p")).select("item", "n", "words", "p.p1", "p.p2")


def bench_items(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, ids, words): items by their words; `ids` are those of all rows with the same words. Items without words drop out."""
    w = bench.select(F.col(id_col).cast("string").alias("id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    return w.groupBy("words").agg(F.collect_set("id").alias("ids")).select(F.xxhash64("words").alias("item"), "ids", "words")


def rare_words(items: DataFrame, counts: DataFrame, most: int = 3) -> DataFrame:
    """(item, k, rank, term): an item's k rarest distinct words, `most` at most, the rarest having rank 0."""
    each = items.select("item", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term")
    rare = each.groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "term"))), 1, most).alias("t"))
    return rare.select("item", F.size("t").alias("k"), F.posexplode("t").alias("rank", "x")).select("item", "k", "rank", "x.term")


def anchors_of(win: DataFrame) -> DataFrame:
    """(item, place, term): the places from which exact searches start."""
    places = win.select("item", F.explode(F.array("p1", "p2")).alias("place"), "words").distinct()
    return places.select("item", "place", F.get("words", F.col("place")).alias("term"))


def phrase_matches(index: DataFrame, win: DataFrame, size: int = 13) -> DataFrame:
    """(key, item, first, last): stretches of documents, by their keys, that are occurrences of windows of an item.

    The index has to hold the terms of anchors_of(win) and `size` - 1 words around each posting.
    """
    lists = index.join(anchors_of(win), "term").withColumn("shift", F.col("pos") - F.col("place"))
    rarest = lists.join(win.select("item", F.col("p1").alias("place"), "p2", "n", "words"), ["item", "place"])
    second = lists.select("key", "item", "shift", F.col("place").alias("p2")).distinct()
    both = rarest.join(second, ["key", "item", "shift", "p2"], "left_semi")
    # equal words in a row to the left and to the right of the rarest word
    p = F.col("place")
    front = F.reverse("before")
    item_front = F.reverse(F.slice("words", F.lit(1), p))
    item_after = F.slice("words", p + 2, F.lit(size - 1))

    def run(a: Column, b: Column) -> Column:
        same = F.arrays_zip(a.alias("a"), b.alias("b"))
        unequal = F.filter(F.transform(same, lambda x, i: F.when(x["a"].eqNullSafe(x["b"]), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
        return F.coalesce(F.array_min(unequal), F.size(same))

    both = both.select("key", "item", "pos", "n", p.alias("place"), run(front, item_front).alias("l"), run(F.col("after"), item_after).alias("r"))
    both = both.where(F.col("l") + F.col("r") + 1 >= F.least("n", F.lit(size)))
    return both.select("key", "item", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + F.col("r")).alias("last")).distinct()


def proximity_matches(index: DataFrame, rare: DataFrame, slop: int = 20) -> DataFrame:
    """(key, item, pos): places of an item's rarest word with its other rare words within `slop` words, in any order.

    An item with fewer distinct words asks for all that it has. One pass over the postings of a document and item, in the
    order of their positions.
    """
    around = Window.partitionBy("key", "item").orderBy("pos").rangeBetween(-slop, slop)
    lists = index.select("term", "key", "pos").join(rare, "term").withColumn("found", F.size(F.collect_set("rank").over(around)))
    return lists.where("rank = 0 and found = k").select("key", "item", "pos").distinct()


def _judged(docs: DataFrame, bench: DataFrame, size: int, id_col: str, text_col: str, item_id: str, item_text: str, near: bool = False) -> DataFrame:
    """(id, key, n_words, n_hit, n_items, joined, contaminated), a row for each row of docs; with `near` also n_near."""
    items = hold(bench_items(bench, item_id, item_text))
    counts = hold(term_counts(docs, items.select(F.explode("words").alias("term")).distinct(), text_col))
    win = hold(windows(items, counts, size))
    terms = anchors_of(win).select("term")
    if near:
        rare = hold(rare_words(items, counts))
        terms = terms.unionByName(rare.select("term"))
    index = build_index(docs, terms.distinct(), size - 1, id_col, text_col)
    found = phrase_matches(index, win, size).join(items.select("item", "ids"), "item")
    spans = F.sort_array(F.collect_set(F.struct("first", "last")))
    by_doc = found.groupBy("key").agg(spans.alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    # stretches may overlap: words up to `end` are counted
    total = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(a["end"], x["first"] - 1))).alias("n"), F.greatest(a["end"], x["last"]).alias("end")),
        lambda a: a["n"],
    )
    by_doc = by_doc.select("key", total.cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("joined"))
    if near:
        ids = proximity_matches(index, rare).select("key", "item").distinct().join(items.select("item", "ids"), "item")
        by_near = ids.groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_set("ids")))).cast("long").alias("n_near"))
        by_doc = by_doc.join(by_near, "key", "full")
    base = docs.select(F.col(id_col).alias("id"), document_key(id_col, text_col).alias("key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = base.join(by_doc, "key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near), a row for each row of docs.

    n_near is the number of items whose rarest three words stand within 20 words of the rarest, in any order. Null and empty texts have no words and aren't contaminated; null or empty items have no window; rows of the
    benchmark with the same words all count as items, under their distinct non-null ids. Repeated documents get equal
    rows. Without items, nothing is contaminated. Other columns are left aside.
    """
    out = _judged(docs, bench, size, id_col, text_col, item_id, item_text, near=True)
    counts = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_items", "n_near")}
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", counts["n_items"], F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"), "contaminated", counts["n_near"])


def clean_documents(docs: DataFrame, bench: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, whatever their names.

    Null and empty texts stay; repeated rows are judged alike, and rows of one id but different texts each by their text;
    an empty table stays empty, and an empty benchmark takes nothing away.
    """
    bad = _judged(docs, bench, size, id_col, text_col, item_id, item_text).where("contaminated").select("key").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), document_key(id_col, text_col).alias("key"))
    return rows.join(hold(bad), "key", "left_anti").select("row.*")


def oracle(size: int = 13, table: str = "documents", bench: str = "benchmark") -> str:
    """DuckDB SQL for the rows of decontaminate(), for distinct doc_ids: windows as texts, joined on equality."""
    w = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, {w} AS w FROM {table}), b AS (SELECT item_id, {w} AS w FROM {bench}),
k AS (SELECT item_id, least(len(w), {size}) AS n, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM k),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
h AS (SELECT doc_id, i, g.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM g) g JOIN win ON win.n = g.n AND win.x = g.x),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
tc AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
rk AS (SELECT item_id, t.term, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), t.term) AS r FROM (SELECT DISTINCT item_id, unnest(w) AS term FROM b) t LEFT JOIN tc ON tc.term = t.term),
oc AS (SELECT doc_id, item_id, r, pos FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d) JOIN rk USING (term) WHERE r <= 3),
nm AS (SELECT a.doc_id, a.item_id, a.pos, count(DISTINCT o.r) AS found FROM oc a JOIN oc o ON o.doc_id = a.doc_id AND o.item_id = a.item_id AND abs(o.pos - a.pos) <= 20 WHERE a.r = 1 GROUP BY ALL),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nm JOIN (SELECT item_id, least(max(r), 3) AS k FROM rk GROUP BY item_id) USING (item_id) WHERE found = k GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
 CAST(coalesce(n_near, 0) AS BIGINT) AS n_near FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN nn ON nn.doc_id = d.doc_id"""
