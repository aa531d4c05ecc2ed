"""Streams: delivered files cut into chunks as they arrive, and the newest turns of each session as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.operators.chunking import ChunkRules, extract_chunks
from docweave.operators.evidence import KEPT_TURNS


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1_000) -> DataFrame:
    """Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_chunks(docs: DataFrame, key: str, markdown: str, target: str, checkpoint: str, rules: ChunkRules | None = None) -> StreamingQuery:
    """Chunks of all files that are there, appended once each; a later run takes only what is new.

    Documents are independent, so the stream keeps no state: the checkpoint holds which files are done.
    """
    chunks = extract_chunks(docs, key, markdown, rules=rules)
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def newest_turns(turns: DataFrame, session: str, order: str, text: str, keep: int = KEPT_TURNS) -> DataFrame:
    """`session`, `order`, `text` of the newest `keep` turns of each session that got new ones; state is `keep` turns a session."""
    kinds = dict(turns.dtypes)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for part in parts:
            held = sorted([*held, *zip(part[order].tolist(), part[text].tolist())], key=lambda t: t[0])[-keep:]
        state.update(([o for o, _ in held], [t for _, t in held]))
        yield pd.DataFrame({session: [key[0]] * len(held), order: [o for o, _ in held], text: [t for _, t in held]})

    out = f"`{session}` {kinds[session]}, `{order}` {kinds[order]}, `{text}` string"
    return turns.select(session, order, text).groupBy(session).applyInPandasWithState(fold, out, f"orders array<{kinds[order]}>, texts array<string>", "update", GroupStateTimeout.NoTimeout)
