"""Measures on streams: analyze() has no aggregate and no join without a Zipf table, so a stream of texts passes through
it as a batch does, without state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.analyze import analyze


def measure_stream(texts: DataFrame, path: str, checkpoint: str, lang: str = "tr", groups: list[str] | None = None, once: bool = False, **options) -> StreamingQuery:
    """Append the measures of arriving texts to Parquet below `path`; `once` takes what is there and ends."""
    if options.get("zipf_table") is not None:
        raise ValueError("a Zipf table needs a grouped join, which a stream without watermark can't have")
    writer = analyze(texts, lang, groups, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
