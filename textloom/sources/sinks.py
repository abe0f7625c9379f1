"""Writers."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_matrix(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a matrix of measures as Parquet, or as CSV files with a header and `nan` for NaN; the schema keeps the names."""
    if form == "parquet":
        df.write.parquet(path)
        return
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    text = [F.when(F.isnan(c), "nan").otherwise(F.col(c).cast("string")).alias(c) if c in doubles else F.col(c) for c in df.columns]
    df.select(*text).write.csv(path, header=True, quote='"', escape='"')


def save_csv(records: Iterable[Mapping[str, object]] | DataFrame, path: str) -> None:
    """One UTF-8 CSV file of records, with the columns of the first; nothing for no records. A DataFrame is streamed
    through the driver row by row, a partition at a time: for tables that one file can hold."""
    rows = (r.asDict() for r in records.toLocalIterator()) if isinstance(records, DataFrame) else iter(records)
    first = next(rows, None)
    if first is None:
        return
    with Path(path).open("w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, fieldnames=list(first))
        out.writeheader()
        out.writerow(first)
        out.writerows(rows)
