"""Correct a stream of reads with a model built beforehand.

Each read is corrected by itself, so the query has no state, no watermark and
no shuffle; the filter and the score cutoffs stay as they were built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from readmend.config import ConfigError, QualityProfile
from readmend.operators.correct import corrected
from readmend.operators.repair import Searcher, ShippedSearcher


def correct_stream(reads: DataFrame, searcher: Searcher, k: int, quality: QualityProfile,
                   max_extension: int = 5, trim: bool = True) -> DataFrame:
    """Streaming reads (seq, qual, any other columns) to corrected ones. Tests that
    move to the data need finished tables, so the filter must have one part."""
    if reads.isStreaming and not isinstance(searcher, ShippedSearcher):
        raise ConfigError("a stream is corrected with a filter of one part, or shipped k-mers")
    return corrected(reads, searcher, k, quality, max_extension, trim)


def start_correction(reads: DataFrame, searcher: Searcher, k: int, quality: QualityProfile,
                     path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append corrected reads to a parquet folder."""
    writer = correct_stream(reads, searcher, k, quality).writeStream.format("parquet").option(
        "path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**trigger).start() if trigger else writer.start()
