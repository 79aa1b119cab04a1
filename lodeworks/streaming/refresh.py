"""Structured Streaming over a source tree: new or touched files trigger the batch refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.models import Embedder
from ..plans.index import NoSources, build_index
from ..sources.files import MAX_BYTES


def watch(spark: SparkSession, repo: str, checkpoint: str, embedder: Embedder | None = None, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Refresh the index of ``repo`` whenever files arrive. The refresh compares hashes, so a batch run twice, or one that
    the index itself caused, changes nothing; deletions are seen with the next arrival."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").load(repo).where(f"length <= {MAX_BYTES}").select("path")
    )

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            try:
                build_index(batch.sparkSession, repo, embedder)
            except NoSources:
                pass

    writer = files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
