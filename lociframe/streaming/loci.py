"""Per-locus operators over streams of text files.

They keep no state from line to line, so a streaming table of lines takes the same plan as a
table at rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lociframe.model import FilterParams
from lociframe.operators.filters import filter_loci
from lociframe.sources import sync


def sync_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``loci`` of sync files as they arrive in ``folder``."""
    return sync.parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def scan_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, weights: Sequence[float], scan: Callable[[DataFrame], DataFrame], p: FilterParams = FilterParams()) -> StreamingQuery:
    """Filter arriving loci, apply ``scan``, and append its rows to Parquet files in ``out``."""
    rows = scan(filter_loci(sync_stream(spark, folder), weights, p))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
