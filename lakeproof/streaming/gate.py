"""The gate over files that keep arriving: each repository is gated once, wherever a run breaks off and however often it is listed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeproof.plans.gate import INVENTORY, gate
from lakeproof.sources.staging import written

_KNOWN = f"{INVENTORY}, print string, listing string"


def _listings(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A repository's first listing, and those later ones that say something else, each once a batch; the state is the first one's print."""
    told: dict[str, pd.DataFrame] = {}
    for part in rows:
        for mark, same in part.groupby("print"):
            told.setdefault(mark, same.head(1))
    marks = sorted(told)
    if state.exists:
        (first,) = state.get
    else:
        first = marks[0]
        state.update((first,))
        yield told[first].assign(listing="first")
    for mark in marks:
        if mark != first:
            yield told[mark].assign(listing="changed")


def gate_stream(spark: SparkSession, inventory_path: str, results_path: str, checkpoint: str) -> StreamingQuery:
    """Gate the JSON-lines inventories that are at ``inventory_path`` and not done yet, then stop.

    The first listing of a repository counts, of several in one batch the one with the smallest hash. That hash is kept as keyed state in the checkpoint, over restarts: listings that
    come again are left out, and those that say something else go to ``results_path``/changed, ungated. A task holds one repository's different listings of a batch. Results are in
    ``results_path``/results, each batch in a folder of its own that a repeated batch writes anew. Rows without a repository are left out.
    """

    def batch(df: DataFrame, number: int) -> None:
        listed = written(df, "listed")
        gate(listed.where("listing = 'first'").drop("print", "listing")).write.mode("overwrite").parquet(f"{results_path}/results/batch={number}")
        listed.where("listing = 'changed'").drop("listing").write.mode("overwrite").parquet(f"{results_path}/changed/batch={number}")

    stream = spark.readStream.schema(INVENTORY).json(inventory_path).where("repo is not null")
    marked = stream.withColumn("print", F.sha2(F.to_json(F.struct("bundle_files", "gguf_files", "chat_template")), 256))
    listed = marked.groupBy("repo").applyInPandasWithState(_listings, _KNOWN, "print string", "append", GroupStateTimeout.NoTimeout)
    return listed.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
