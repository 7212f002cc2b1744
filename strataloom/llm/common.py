"""What the operators share: the shared scratch folder, written cuts of lineage, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and all runs in this process, as in tests, a folder of this session is made. On a
    cluster each executor would write to a disk of its own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _OWN.get(spark.sparkContext.applicationId)
        if folder is None:
            folder = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return folder.rstrip("/")


_OWN: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes that a Python worker gets at once where the session has the default. A batch is held several times over,
#: by the executor and by the worker, and texts are long.
BATCH_ROWS, BATCH_DEFAULT, BATCH_CONF = 512, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, BYTES_CONF = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Have Python workers get little at a time, unless the session says otherwise.

    It stays so for the session: what an operator returns runs only when its caller asks for it.
    """
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
        spark.conf.set(BYTES_CONF, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    Unlike a local checkpoint the table outlives any executor. The shuffle files of the plan that fills it are
    of no more use and go when it is written; that setting holds for the session meanwhile.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def dropped(spark: SparkSession) -> None:
    """Delete what this application has written into the shared folder; call it when its results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(quoted(column)), F.lit(""))


def quoted(name: str) -> str:
    """A column of any name, one with a dot or a backtick included."""
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, *replaced: str) -> tuple[list[Column], list[Column]]:
    """(in, back): the caller's columns but for ``replaced``, under numbers on the way in and under their names on the way back.

    So no name of theirs meets a name of the work, whatever it is.
    """
    own = [c for c in docs.columns if c not in replaced]
    return [F.col(quoted(c)).alias(f"own_{i}") for i, c in enumerate(own)], [F.col(f"own_{i}").alias(c) for i, c in enumerate(own)]


def crc_mod(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
