"""Corpora: folders of text files and delimited files, read by Spark, checked for UTF-8."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..errors import LinguisticFeaturesError
from .segments import check_arguments, segment

# Headers that are looked for, the first that is there wins.
LABEL_HEADERS = "label Label etiket Etiket ETIKET author Author yazar Yazar kategori category".split()
TEXT_HEADERS = "text Text metin Metin METIN content".split()
SOURCE_HEADERS = "source Source kaynak Kaynak başlık title book file".split()


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


@F.pandas_udf(LongType())
def _first_bad_byte(contents: pd.Series) -> pd.Series:
    """Of each content the first byte that can't be read as UTF-8."""

    def offset(raw: bytes) -> int | None:
        try:
            bytes(raw).decode("utf-8")
        except UnicodeDecodeError as e:
            return e.start
        return None

    return contents.map(offset)


def _invalid(rows: DataFrame) -> LinguisticFeaturesError | None:
    """An error that names every file that isn't UTF-8, with the first offset that can't be read. The offsets are found
    where the files are read; paths and offsets alone come to the driver."""
    bad = rows.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", _first_bad_byte("content").alias("at")).collect()
    if not bad:
        return None
    return LinguisticFeaturesError(f"{len(bad)} file(s) are not valid UTF-8:\n" + "\n".join(f"  {r['path']} (byte {r['at']})" for r in sorted(bad)))


def _without_bom(c):
    return F.regexp_replace(c, "^﻿", "")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(label, source, text) of `path/<label>/*.txt`, and of `path/*.txt` named Label_Title.txt; a name without _ has an
    empty label. All files that aren't UTF-8 are named in one error."""
    fs, root = _fs(spark, path)
    deep = [str(s.getPath()) for s in fs.listStatus(root) if s.isDirectory()]
    files = lambda p: [str(s.getPath()) for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(p)) if s.isFile() and s.getPath().getName().endswith(".txt")]
    inner, outer = [d for d in deep if files(d)], bool(files(path))
    read = lambda p: spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(p).select("path", "content")
    name = F.regexp_extract("path", r"([^/]*)\.txt$", 1)
    empty = spark.createDataFrame([], "label string, source string, text string")
    parts, raw = [empty], []
    if inner:
        rows = read(inner)
        raw.append(rows)
        parts.append(rows.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("label"), name.alias("source"), F.col("content").cast("string").alias("text")))
    if outer:
        rows = read(path)
        raw.append(rows)
        title = F.regexp_extract(name, "^[^_]*_(.+)$", 1)
        parts.append(rows.select(F.when(title != "", F.regexp_extract(name, "^([^_]*)_", 1)).otherwise("").alias("label"), F.when(title != "", title).otherwise(name).alias("source"), F.col("content").cast("string").alias("text")))
    for rows in raw:
        if error := _invalid(rows):
            raise error
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("text", _without_bom(F.col("text")))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(label, source, text) of a CSV file, or of a .tsv file with tabs. No text header is an error; without a source
    header the file's name stands in."""
    if error := _invalid(spark.read.format("binaryFile").load(path).select("path", "content")):
        raise error
    sep = "\t" if path.lower().endswith(".tsv") else ","
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', sep=sep, inferSchema=False)
    names = {c.lstrip("﻿"): c for c in rows.columns}
    first = lambda headers: next((names[h] for h in headers if h in names), None)
    text, label, source = first(TEXT_HEADERS), first(LABEL_HEADERS), first(SOURCE_HEADERS)
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if text is None:
        if not rows.columns or not rows.take(1):
            return spark.createDataFrame([], "label string, source string, text string")
        raise ValueError(f"{path}: no text column found. Expected one of these headers: {TEXT_HEADERS}")
    pick = lambda c, missing: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c else F.lit(missing)
    return rows.select(pick(label, "").alias("label"), pick(source, stem).alias("source"), pick(text, "").alias("text"))


def read_corpus(spark: SparkSession, path: str, segment_size: int | None = None, min_fill: float = 1.0, unit: str = "word", lang: str = "tr") -> DataFrame:
    """(label, source, segment_id, text) of a folder or delimited file; FileNotFoundError before anything is read."""
    if segment_size is not None:
        check_arguments(segment_size, unit, lang)
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"Path not found: {path}")
    rows = read_table(spark, path) if fs.getFileStatus(p).isFile() else read_folder(spark, path)
    return segment(rows, segment_size, min_fill, unit, lang).select("label", "source", "segment_id", "text")
