"""Line dedup by distinct-site spread, with DataFrame functions only.

Each line's sites go into a HyperLogLog sketch; sketches of the same line hash merge by aggregation, partly before the
shuffle, so that a line which stands in a third of all documents is one sketch per task. Lines whose estimate lies
near the threshold are counted exactly. A line on `min_sites` sites or more is boilerplate and leaves every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is cut from both ends of a line before it is compared.
BLANK = " \t\r\x0b\x0c"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def lines_of(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """(site, line): hashes of every non-blank line of every text; a null site counts as a site of its own."""
    site = F.coalesce(F.xxhash64(F.lit(1), F.col(site_col)), F.lit(0))
    lines = docs.select(site.alias("site"), F.explode(F.split(text_col, "\n", -1)).alias("raw"))
    return lines.select("site", _trim(F.col("raw")).alias("raw")).where("raw <> ''").select("site", F.xxhash64("raw").alias("line"))


def boilerplate(docs: DataFrame, min_sites: int = 10, lg_k: int = 12, band: float = 0.1, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(line): hashes of the lines on min_sites sites or more.

    The sketch's standard error is about 1.04 / sqrt(2 ** lg_k), 1.6 %; estimates within `band` of the threshold, six
    times that, are replaced by exact distinct counts.
    """
    lines = lines_of(docs, site_col, text_col)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", lg_k).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = spread.where(F.col("sites") >= min_sites * (1 - band))
    from .common import hold

    spread = hold(spread)
    near = spread.where(F.col("sites") < min_sites * (1 + band)).select("line")
    exact = lines.join(near, "line").distinct().groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("sites") >= min_sites * (1 + band)).select("line").unionByName(exact.select("line"))


def line_dedup(docs: DataFrame, min_sites: int = 10, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **sketch) -> DataFrame:
    """docs with its own columns, the text without boilerplate lines, and n_lines and n_removed (non-blank lines).

    The order of the lines that stay is kept. A document all of whose lines are boilerplate is a copy of a page, not a
    frame around one: it stays as it is, for the near-duplicate stage. Null texts stay null, with 0 lines; empty and
    blank texts stay; repeated rows are treated alike, and rows of one id but different texts each by their text; an empty
    table stays empty. The two new columns replace any of the same name; all others keep their values, whatever their names.
    """
    from .common import hold

    bad = hold(boilerplate(docs, min_sites, site_col=site_col, text_col=text_col, **sketch).distinct())
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    own = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0)
    rows = docs.select(own.alias("row"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"))
    lines = F.split("text", "\n", -1)
    each = rows.select("key", F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(_trim(x))))).alias("line"))
    found = each.join(bad, "line").groupBy("key").agg(F.collect_set("line").alias("bad"))
    out = rows.join(found, "key", "left").withColumn("stays", F.when(F.col("bad").isNotNull(), F.filter(lines, lambda x: ~F.array_contains("bad", F.xxhash64(_trim(x))))))
    full = lambda a: F.coalesce(F.size(F.filter(a, lambda x: _trim(x) != "")), F.lit(0)).cast("long")
    out = out.withColumns({"n": F.when(F.col("text").isNull(), 0).otherwise(full(lines)), "m": F.when(F.col("stays").isNotNull(), full(F.col("stays")))})
    cut = F.col("m") > 0
    text = F.when(cut, F.array_join("stays", "\n")).otherwise(F.col("text"))
    given = {text_col: text, "n_lines": F.col("n").cast("long"), "n_removed": F.when(cut, F.col("n") - F.col("m")).otherwise(0).cast("long")}
    names = [*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    return out.select(*((given[c] if c in given else F.col("row")[c]).alias(c) for c in names))


def oracle(min_sites: int = 10, table: str = "documents", columns: str = "doc_id, n_lines, n_removed, length(coalesce(kept, '')) AS n_chars, md5(kept) AS text_md5") -> str:
    """DuckDB SQL, exact throughout, for distinct doc_ids."""
    chars = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""WITH l AS (SELECT doc_id, coalesce(source, chr(0)) AS site, raw, i, trim(raw, {chars}) AS line FROM (
 SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {table})),
bad AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
d AS (SELECT doc_id, count(*) FILTER (WHERE l.line <> '') AS n, count(*) FILTER (WHERE bad.line IS NOT NULL) AS m,
 string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE bad.line IS NULL) AS kept FROM l LEFT JOIN bad ON l.line = bad.line GROUP BY doc_id),
r AS (SELECT t.*, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(CASE WHEN n > m THEN m ELSE 0 END AS BIGINT) AS n_removed,
 CASE WHEN n > m AND m > 0 THEN kept ELSE text END AS kept FROM {table} t LEFT JOIN d ON t.doc_id = d.doc_id)
SELECT {columns} FROM r"""
