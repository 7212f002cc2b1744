"""Written cuts of lineage for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

#: Rows and bytes that a Python worker gets at once where the session has the default; a row may be a whole document.
BATCH_ROWS, BATCH_DEFAULT, BATCH_CONF = 512, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, BYTES_CONF = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Have Python workers get little at a time, unless the session says otherwise. It stays so for the session."""
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
        spark.conf.set(BYTES_CONF, str(BATCH_BYTES))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table or text in the shared folder that ``spark.checkpoint.dir`` names.

    Where that is unset a folder of this session is made, but only if all runs in this process: on a cluster each
    executor would write to a disk of its own, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tables-")
        folder = _OWN[app]
    return f"{folder.rstrip('/')}/{app}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which ends its lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
