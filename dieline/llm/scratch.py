"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup of at most this many bytes, by its rows and the items of its arrays, is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if its rows are proven to be small enough; pass a written table, which is cheap to measure."""
    each = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("array", "map"):
            each = each + 16 + 16 * F.coalesce(F.size(F.col(f"`{field.name}`")), F.lit(0))
        elif kind in ("string", "binary"):
            each = each + 16 + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        else:
            each = each + 8 * (len(field.dataType.fields) if kind == "struct" else 1)
    size = df.agg(F.sum(each.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: Where the shared folder is a mounted path, Hadoop's local file system writes a checksum file beside each file
#: and starts two processes to set their modes; raw access does neither. Other file systems ignore this.
_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Shuffle files go with the write that needs them, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, local sessions get a temporary one; others must set it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dieline-"))
        found = sc.getCheckpointDir()
    return found


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, not a recomputation.

    Every table goes when its session ends, or earlier by drop().
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)

    def save(self, df: DataFrame, name: str, by: tuple[str, ...] = (), hashes: tuple[str, ...] = ()) -> DataFrame:
        """Write df, in folders by some columns, and read it back. Rows keep whatever ids the plan gave them. Columns of hashes are written without dictionaries, which don't shorten them."""
        schema = df.schema
        path = f"{self.root}/{name}"
        conf, was = self.spark.conf, self.spark.conf.get(_CLEAN, None)
        conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").options(**_RAW, **{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).partitionBy(*by).parquet(path)
        finally:
            conf.set(_CLEAN, was) if was is not None else conf.unset(_CLEAN)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self._fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)
