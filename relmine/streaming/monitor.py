"""Streaming monitor: the row-local operators on a ``readStream`` source.

Prompt features (QF/LF) and faithfulness (FG1–FG7) are pure projections, so
the same functions run on a streaming DataFrame; state-free, no watermark
needed. Output goes to any sink; the checkpoint location is the query's own
folder under the one that ``spark.checkpoint.dir`` names, the same after a
restart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from relmine.operators import faithfulness as FG
from relmine.operators import features as QF
from relmine.session import checkpoint_dir, shared_dir

RAG_SCHEMA = "conv_id bigint, turn bigint, context string, response string"


def rag_stream(spark: SparkSession, source_dir: str, schema: str = RAG_SCHEMA, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source_dir)


def score_stream(stream: DataFrame, context: str = "context", response: str = "response") -> DataFrame:
    """FG1–FG7 plus the prompt features of the context, per arriving row."""
    scored = FG.faithfulness(stream, context, response)
    return QF.extract(scored, text_column=context)


def start(
    scored: DataFrame,
    sink: str = "parquet",
    path: str | None = None,
    query_name: str | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start ``scored`` into a sink.

    File sinks go on exactly where they stopped if the checkpoint folder is
    the same, so it must be given, or follow from ``query_name`` and a set
    ``spark.checkpoint.dir``; anything else is an error. The memory sink
    cannot go on and gets a fresh folder."""
    spark = scored.sparkSession
    if checkpoint is None and sink == "memory":
        checkpoint = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if checkpoint is None:
        named = shared_dir(spark)
        if not named or not query_name:
            raise ValueError("give a checkpoint folder, or a query name and spark.checkpoint.dir: a restart needs the same one")
        checkpoint = f"{named.rstrip('/')}/streams/{query_name}"
    w = scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    if sink == "memory":
        return w.format("memory").start()
    return w.format(sink).start(path)
