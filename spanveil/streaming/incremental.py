"""Documents that keep coming: each batch is redacted with the tokens of all before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanveil.plans.session import RedactionSession


def redact_stream(docs: DataFrame, namespace: str, root: str, output: str, checkpoint: str, available_now: bool = True, **how) -> StreamingQuery:
    """Writes redacted documents to a Parquet folder, one subfolder a batch.

    The namespace is loaded and saved for each batch, so the query is its only writer. A
    batch that is run again after a failure writes over what it had written; tokens that
    it had already saved are found again and not given out anew.
    """

    def batch(rows: DataFrame, number: int) -> None:
        session = RedactionSession(rows.sparkSession, namespace, root, **how)
        done = session.redacted(rows)
        done.select(*rows.columns, "redacted", "n_entities").write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
