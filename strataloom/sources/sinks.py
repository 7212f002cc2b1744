"""Snapshots, exports and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Immutable snapshots of tables under a root; the last pointer names the current one, so readers see one state.

    Pointers are numbered and never change. A new one is written aside and moved into place by one rename, which fails
    if another writer was faster.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _pointers(self) -> list[str]:
        if not self._fs().exists(self._path("_pointers")):
            return []
        return sorted(f.getPath().getName() for f in self._fs().listStatus(self._path("_pointers")))

    def current(self) -> str | None:
        found = self._pointers()
        return self.spark.read.text(f"{self.root}/_pointers/{found[-1]}").collect()[0][0] if found else None

    def publish(self, name: str, tables: dict[str, DataFrame]) -> None:
        """Write all tables, then add the pointer; a reader never sees half of it."""
        number = len(self._pointers())
        for table, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.root}/{name}/{table}")
        self.spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(f"{self.root}/_next/{name}")
        fs = self._fs()
        fs.mkdirs(self._path("_pointers"))
        if fs.exists(self._path(f"_pointers/{number:012d}")) or not fs.rename(self._path(f"_next/{name}"), self._path(f"_pointers/{number:012d}")):
            raise RuntimeError(f"another snapshot was published before {name}")

    def read(self, table: str, name: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name or self.current()}/{table}")

    def updated(self, table: str, key: str, fresh: DataFrame, gone: DataFrame) -> DataFrame:
        """The current rows without those of fresh or gone keys, and the fresh ones."""
        old = self.read(table)
        drop = fresh.select(key).unionByName(gone.select(key)).distinct()
        return old.join(drop, key, "left_anti").unionByName(fresh)


def append_note(spark: SparkSession, path: str, ts, agent: str, kind: str, body: str) -> None:
    spark.createDataFrame([(ts, agent, kind, body)], "ts timestamp, agent string, kind string, body string").write.mode("append").parquet(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """(value): a result object a row, with a fingerprint that does not depend on the line."""
    finger = F.sha2(F.concat_ws("|", "rule", "path", "message"), 256)
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.struct(finger.alias("primary")).alias("partialFingerprints"))).alias("value"))


def annotations(evidence: DataFrame, source: str) -> DataFrame:
    """Evidence as facts whose identifier comes from their content."""
    body = F.to_json(F.struct("path", "line", "rule", "message"))
    return evidence.select(F.lit(source).alias("source_id"), F.lit("annotation").alias("kind"), "severity", "path", "line", body.alias("body"), F.sha2(body, 256).alias("sha256"))


def mermaid(edges: DataFrame, top: int = 50) -> str:
    """A diagram of the strongest boundaries (from_component, to_component, observations)."""
    rows = edges.orderBy(F.col("observations").desc(), "from_component", "to_component").limit(top).collect()
    ids = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in (r["from_component"], r["to_component"])}))}
    clean = lambda s: "".join(c for c in s if c.isprintable() and c not in '"<>')
    lines = ["graph LR", *(f'  {i}["{clean(n)}"]' for n, i in ids.items()), *(f"  {ids[r['from_component']]} -->|{r['observations']}| {ids[r['to_component']]}" for r in rows)]
    return "\n".join(lines)
