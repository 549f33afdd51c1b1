"""Which quotes occur in texts that arrive as a stream; beyond what the batch queries need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from provenant.operators.quotecheck import contained


def watch(quotes: DataFrame, texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends pairs (quote_id, text_id) of texts (a stream of text_id, text) to Parquet files in path.

    quotes are a table, few enough for one automaton (contained joins more, which streams can't). Each text is judged once,
    without state; checkpoint must be a folder that all machines share.
    """
    return contained(quotes, texts).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
