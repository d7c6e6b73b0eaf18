"""Incremental and stateful runs with Structured Streaming.

A stage is a function of the articles that are still to be handled. Fed by a stream, it sees each new file once; the
checkpoint remembers which, so a restarted run does the rest only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mapwright.functions.keys import normalized
from mapwright.functions.vocab import is_generic
from mapwright.operators import resolve

NAMED = "company_name string, article_id long, item long, raw_name string, name string, method string"


def run_available(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], max_files: int | None = None) -> None:
    """Hand every file that has arrived since the last run to ``handle`` (batch, number), then stop."""
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", max_files) if max_files else stream
    query = stream.parquet(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class _FirstSpelling(StatefulProcessor):
    """State of one normalised name of a company: its first spelling and that one's article."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "name string, article_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(["article_id", "item", "raw_name"])
        known = self.known.get() if self.known.exists() else None
        if known is None and key[1]:
            known = (batch["raw_name"].iloc[0], int(batch["article_id"].iloc[0]))
            self.known.update(known)
        asks = ~batch["generic"] & bool(key[1])
        met = asks & (batch["article_id"] > known[1]) if known else asks
        name = batch["raw_name"].where(~asks, known[0]) if known else batch["raw_name"]
        yield pd.DataFrame({"company_name": key[0], "article_id": batch["article_id"], "item": batch["item"], "raw_name": batch["raw_name"], "name": name, "method": met.map({True: "exact", False: None}).astype(object)})


def known_names_stream(mentions: DataFrame) -> DataFrame:
    """Mentions with the first spelling of their name, kept as state by company and normalised name.

    mentions: a stream of company_name, article_id, item, raw_name, whose articles arrive in order of ``article_id``;
    rows of one batch arrive in no order. The rules are those of :func:`resolve.resolve_exact`: a name is known to later
    articles only, generic names never ask, and names that normalise to nothing are new each time. Needs the session's
    ``spark.sql.streaming.stateStore.providerClass`` to be that of RocksDB.
    """
    keyed = mentions.withColumns({"norm": F.coalesce(normalized(F.col("raw_name")), F.lit("")), "generic": F.coalesce(is_generic(F.col("raw_name")), F.lit(False))})
    return keyed.groupBy("company_name", "norm").transformWithStateInPandas(_FirstSpelling(), NAMED, "Append", "None")


class NamesByBatch:
    """Mentions of a stream, resolved batch by batch by similarity too: a handler for :func:`run_available`.

    Whether a name stands for itself depends on names under other keys, so no state of a single key can settle it. The
    names known so far are a table instead, a folder a batch, and :func:`resolve.resolve` works on a batch with these as
    stored names, in rounds spread over all names. Fed in order of arrival it ends where one run over everything does.

    Every folder is written under its batch's number and replaces what an attempt before left there, so a batch that is
    handed over twice changes nothing; batches after it are never read. Names are read by company as folders.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: float = resolve.THRESHOLD) -> None:
        self.spark, self.folder, self.threshold = spark, folder.rstrip("/"), threshold

    def _read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(path.toString())
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def names(self, before: int | None = None) -> DataFrame:
        """``company_name, name, known_at`` of the names known before a batch."""
        return self._read("names", "name string, known_at string, company_name string", before)

    def resolved(self, schema: str) -> DataFrame:
        """All mentions so far with ``name`` and ``method``; ``schema`` is that of the mentions."""
        return self._read("mentions", f"{schema}, name string, method string")

    def __call__(self, batch: DataFrame, number: int) -> None:
        named, place = resolve.resolve(batch, self.threshold, self.names(number)), f"{self.folder}/mentions/batch={number}"
        named.write.mode("overwrite").parquet(place)
        named = self.spark.read.schema(named.schema).parquet(place)
        keyed = named.withColumns({"norm": normalized(F.col("name")), "at": resolve.moment(named)}).where("method is null and norm <> ''")
        new = keyed.groupBy("company_name", "norm").agg(F.min_by("name", F.struct("at", "item")).alias("name"), F.min("at").alias("known_at"))
        old = self.names(number).select("company_name", normalized(F.col("name")).alias("norm"))
        new.join(old, ["company_name", "norm"], "left_anti").drop("norm").write.mode("overwrite").partitionBy("company_name").parquet(f"{self.folder}/names/batch={number}")
