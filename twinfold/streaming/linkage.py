"""Streaming forms of linking, cleaning and exact-duplicate removal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from twinfold.config import LINK_THRESHOLD, MatchConfig
from twinfold.operators.blocking import Rule
from twinfold.operators.clean import preprocess, with_errors
from twinfold.operators.link import base_lookup, link_records
from twinfold.operators.scoring import MatchModel


def link_stream(arriving: DataFrame, base: DataFrame, blocking: Sequence[Rule], model: MatchModel,
                out_path: str, checkpoint: str, threshold: float = LINK_THRESHOLD,
                available_now: bool = False) -> StreamingQuery:
    """Match each micro-batch of arriving records against a base table.

    The base table of cleaned records is keyed and stored once; a batch only
    joins with those keys.  A batch writes one folder named by its id, so a batch that is run
    again after a failure replaces its own output instead of repeating it.
    """
    index = base_lookup(base, blocking, model, threshold)

    def write(batch: DataFrame, batch_id: int) -> None:
        links = link_records(batch, base, blocking, model, threshold, index)
        links.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def clean_stream(arriving: DataFrame, rules: Mapping[str, Column], config: MatchConfig = MatchConfig()) -> DataFrame:
    """Cleaned records with the list of broken rules; stateless, so it follows any source."""
    return preprocess(with_errors(arriving, rules), config)


def distinct_stream(arriving: DataFrame, keys: Sequence[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key, however late it comes; the keys seen so far are in the state store.

    With ``event_time`` and ``delay`` (such as "2 days") a key is held until the
    watermark, the latest time seen less ``delay``, has passed the time of its
    first row by ``delay``: the state stays bounded, repetitions within ``delay``
    are dropped, a later one counts as new, and a row older than the watermark
    is late and dropped.  Without them every key is held for ever, which asks for a
    state store on disk (``spark.sql.streaming.stateStore.providerClass``).
    """
    if (event_time is None) != (delay is None):
        raise ValueError("event_time and delay belong together")
    if event_time is None:
        return arriving.dropDuplicates(list(keys))
    return arriving.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def write_distinct(arriving: DataFrame, keys: Sequence[str], out_path: str, checkpoint: str, available_now: bool = False,
                   event_time: str | None = None, delay: str | None = None) -> StreamingQuery:
    """:func:`distinct_stream` appended to Parquet.

    No batch reads what earlier ones wrote, and one that runs again after a failure adds nothing twice.
    """
    writer = (distinct_stream(arriving, keys, event_time, delay).writeStream.format("parquet").option("path", out_path)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_parquet_now(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over the input that is available and append it to Parquet."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
