"""Raw export lines that arrive as files in a folder, parsed as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trussline.operators.reject_rows import parse_records, record_lines

LINES = "line_id long, file_id string, line_no int, line string"


def parse_stream(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, tables: tuple[str, ...] = ("TASK", "TASKPRED")) -> StreamingQuery:
    """Parse each batch of Parquet files of raw lines; ``sink`` gets its records and number.

    A file's lines must arrive in one batch, as headers govern the records after them. The
    checkpoint makes a batch's files count once if the query is restarted.
    """
    lines = spark.readStream.schema(LINES).parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        sink(parse_records(record_lines(batch, tables)), number)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
