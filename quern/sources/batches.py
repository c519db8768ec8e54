"""Arrow batches of texts that are sent to Python."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession | None = None) -> None:
    """Holds Arrow batches of the session, or the active one, at BATCH_ROWS rows and BATCH_BYTES at most: a default batch of 10,000 texts stands in the
    JVM, outside its heap, and several times in each Python worker. Without a session there is nothing to hold."""
    spark = spark or SparkSession.getActiveSession()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)) if spark else ():
        now = int(re.sub("[^0-9-]", "", spark.conf.get(key)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
