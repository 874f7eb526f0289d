"""Processing of document versions: one event log, folded into the state of every version.

Events: event_id (rising with time), kind (``upload``, ``retry`` or ``reference``), institution_id, document_id, version_id,
content (what could be read of the file; null where it could not), error (why not). A version is uploaded once.

* An upload whose content the tenant has already is rejected (``duplicate``); later events of its version find nothing.
* An upload or a retry is an attempt. It ends ``processed`` with the text, or ``failed`` with a reason and without text.
* After a message has cited a version (``reference``), retries of it are ``refused``, for its text must not change.
* A retry or reference of a version that was never uploaded is ``unknown``.

``states`` folds a whole log by aggregation alone. ``process`` does the same to a stream: first by tenant and checksum, then by
version, each with keyed state, so verdicts reach across batches and restarts. Its sink writes a folder for each batch, the
texts before the verdicts, and a batch that runs again overwrites its own folder; ``current`` reads the last attempt of each
version, so a new text takes the place of the old at once and a failed version has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from proofloom.functions.text import useful_characters

EVENT = "event_id long, kind string, institution_id string, document_id long, version_id long, content string, error string"
VERDICT = "event_id long, kind string, version_id long, verdict string, reason string, attempt int, text string"


def failure(content: Column, error: Column) -> Column:
    """Why an attempt fails, null where it does not."""
    return F.when(error.isNotNull(), error).when(content.isNull(), "unreadable").when(useful_characters(content) == 0, "blank_text")


def _checksum() -> Column:
    """Of what an upload holds; a file that could not be read equals no other."""
    return F.coalesce(F.sha2("content", 256), F.concat(F.lit("version "), F.col("version_id").cast("string")))


# ---- a whole log ------------------------------------------------------------------------------------------------


def states(events: DataFrame) -> DataFrame:
    """institution_id, version_id, status, reason, attempts, n_refused, text_sha256: every uploaded version after all events.

    Rejected uploads have the status ``duplicate``. Only aggregations and joins on keys: a content that a third of all uploads share
    is combined within tasks to one row, and no events of a version are gathered.
    """
    marked = events.withColumns({"reason": failure(F.col("content"), F.col("error")), "checksum": _checksum()})
    flat = marked.select("event_id", "kind", "institution_id", "version_id", "reason", "checksum")
    uploads = flat.filter("kind = 'upload'")
    first = uploads.groupBy("institution_id", "checksum").agg(F.min("event_id").alias("first_id"))
    own = F.min(F.when(F.col("kind") == "upload", F.col("event_id")))
    cited = F.min(F.when(F.col("kind") == "reference", F.col("event_id")))
    # A citation before the upload cites nothing; it is left out when the upload is known.
    bounds = flat.groupBy("version_id").agg(own.alias("upload_id"))
    later = flat.join(bounds, "version_id").filter(F.col("event_id") >= F.col("upload_id"))
    closed = later.groupBy("version_id").agg(cited.alias("closed_id"))
    tries = later.filter("kind <> 'reference'").join(closed, "version_id")
    counts = (F.col("closed_id").isNull()) | (F.col("event_id") < F.col("closed_id"))
    last = F.max_by(F.struct("reason", "checksum"), F.when(counts, F.col("event_id")))
    folded = tries.groupBy("version_id").agg(last.alias("last"), F.count_if(counts).cast("int").alias("attempts"), F.count_if(~counts).cast("int").alias("n_refused"))
    winners = first.select(F.col("first_id").alias("event_id"), F.lit(True).alias("accepted"))
    named = uploads.select("event_id", "institution_id", "version_id").join(winners, "event_id", "left").join(folded, "version_id")
    taken = F.coalesce("accepted", F.lit(False))
    failed = F.col("last.reason")
    return named.select(
        "institution_id", "version_id", F.when(~taken, "duplicate").when(failed.isNull(), "processed").otherwise("failed").alias("status"), F.when(taken, failed).alias("reason"),
        F.when(taken, F.col("attempts")).otherwise(0).alias("attempts"), F.when(taken, F.col("n_refused")).otherwise(0).alias("n_refused"), F.when(taken & failed.isNull(), F.col("last.checksum")).alias("text_sha256"),
    )


# ---- a stream ---------------------------------------------------------------------------------------------------


class _Contents(StatefulProcessor):
    """Keyed by tenant and checksum: the first upload passes as it is, every other one as a duplicate."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._owner = handle.getValueState("owner", "version_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._owner.exists()
        best = None  # only one row is held, however many uploads have this content
        for part in rows:
            if not known:
                part = (part if best is None else pd.concat([best, part])).sort_values("event_id")
                best, part = part.head(1), part.iloc[1:]
            if len(part):
                yield part.assign(kind="duplicate", content=None)[_EVENT_COLUMNS]
        if best is not None:
            self._owner.update((int(best["version_id"].iloc[0]),))
            yield best[_EVENT_COLUMNS]

    def close(self) -> None:
        pass


class _Versions(StatefulProcessor):
    """Keyed by version: the verdict of each event. The state is a status, whether it was cited, and the attempts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "status string, cited boolean, attempts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, cited, attempts = self._state.get() if self._state.exists() else (None, False, 0)
        out = []
        for event in pd.concat(list(rows)).sort_values("event_id").itertuples(index=False):
            reason = None if pd.isna(event.reason) else event.reason
            text = None
            if event.kind == "duplicate":
                verdict, status, reason = "duplicate", "duplicate", None
            elif event.kind != "upload" and status in (None, "duplicate"):
                verdict, reason = "unknown", None
            elif event.kind == "reference":
                verdict, cited, reason = "cited", True, None
            elif cited:
                verdict, reason = "refused", None
            else:
                attempts += 1
                verdict = status = "processed" if reason is None else "failed"
                text = event.content if reason is None else None
            out.append((event.event_id, event.kind, event.version_id, verdict, reason, attempts, text))
        if status is not None:
            self._state.update((status, cited, attempts))
        yield pd.DataFrame(out, columns=["event_id", "kind", "version_id", "verdict", "reason", "attempt", "text"])

    def close(self) -> None:
        pass


_EVENT_COLUMNS = [part.split()[0] for part in EVENT.split(", ")] + ["reason"]


def verdicts(events: DataFrame) -> DataFrame:
    """One row of ``VERDICT`` for each event of a stream."""
    marked = events.withColumn("reason", failure(F.col("content"), F.col("error")))
    uploads = marked.filter("kind = 'upload'").withColumn("checksum", _checksum())
    passed = uploads.groupBy("institution_id", "checksum").transformWithStateInPandas(_Contents(), f"{EVENT}, reason string", "append", "none")
    rest = marked.filter("kind <> 'upload'")
    every = passed.select(*_EVENT_COLUMNS).unionByName(rest.select(*_EVENT_COLUMNS))
    return every.groupBy("version_id").transformWithStateInPandas(_Versions(), VERDICT, "append", "none")


def process(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Verdicts to ``out``/verdicts, texts of processed attempts to ``out``/texts; ends when no event is left.

    The session keeps its keyed state in RocksDB (``spark.sql.streaming.stateStore.providerClass``); another store is an error of Spark.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.filter("verdict = 'processed'").select("version_id", "event_id", "text").write.mode("overwrite").parquet(f"{out}/texts/batch={number}")
        kept.drop("text").write.mode("overwrite").parquet(f"{out}/verdicts/batch={number}")
        kept.unpersist()

    return verdicts(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """version_id, status, reason, attempts, n_refused, text of each uploaded version after the batches written so far."""
    rows = spark.read.parquet(f"{out}/verdicts").filter("verdict not in ('unknown', 'cited')")
    decided = F.col("verdict") != "refused"
    last = F.max_by(F.struct("verdict", "reason", "attempt", "event_id"), F.when(decided, F.col("event_id")))
    folded = rows.groupBy("version_id").agg(last.alias("l"), F.count_if(~decided).cast("int").alias("n_refused"))
    flat = folded.select("version_id", F.col("l.verdict").alias("status"), "l.reason", F.col("l.attempt").alias("attempts"), "n_refused", "l.event_id")
    texts = spark.read.parquet(f"{out}/texts").select("version_id", "event_id", "text")
    return flat.join(texts, ["version_id", "event_id"], "left").drop("event_id")
