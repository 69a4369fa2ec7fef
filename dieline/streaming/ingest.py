"""STDF files that arrive in a folder, into a catalog, and tailed streams of records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import stdf
from ..sources.storage import Catalog

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New STDF files of a folder and of those below it, as a stream."""
    found = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return found.option("pathGlobFilter", stdf._GLOB).load(folder)


def ingest(files: DataFrame, catalog: Catalog, checkpoint: str, options: dict | None = None, strict: bool = False) -> StreamingQuery:
    """Each file's rows as its current version in the catalog; what was seen before isn't converted again.

    A batch that is replayed after a failure finds its files' versions by content and changes nothing, so
    sources come in exactly once. Files that can't be read go to _errors/ of the dataset as rows (source_id, error) and hold nothing up.
    query.stop() cancels between sources (T5).
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        folder = f".staging-batch-{number}"
        try:
            # the batch's rows are written once; every source then reads its own
            stdf.read_rows(rows, strict).write.mode("overwrite").parquet(catalog.files.path(f"{folder}/rows"))
            stdf.hashed(rows).write.mode("overwrite").parquet(catalog.files.path(f"{folder}/hashes"))
            read = spark.read.parquet(catalog.files.path(f"{folder}/rows"))
            good, bad = stdf.sorted_out(read)
            bad.select("source_id", "error", F.lit(number).alias("batch")).write.mode("overwrite").parquet(catalog.files.path(f"_errors/batch={number}"))
            hashes = spark.read.parquet(catalog.files.path(f"{folder}/hashes")).filter("error IS NULL")
            hashes = hashes.join(bad.select(F.col("source_id").alias("path")).distinct(), "path", "left_anti")
            sources = [(r["path"], r["sha256"]) for r in hashes.orderBy("path").collect()]  # at most files_per_batch
            whole = stdf.identified(good)
            catalog.convert(((p, sha, whole.filter(F.col("source_id") == p)) for p, sha in sources), options, continue_on_error=True)
        finally:
            catalog.files.delete(folder)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "lot string, sequence bigint, parts string"
_DONE = "source_id string, head_num int, site_num int, offset bigint, prr_offset bigint, part_number bigint"


def tailed_attempts(records: DataFrame) -> DataFrame:
    """The tests of completed attempts of a stream of records (source_id, head_num, site_num, offset, mnemonic).

    State is kept per source and position: the offsets of an open attempt's tests, and how many attempts there were.
    A position's records must arrive in the order of their batches; within a batch they are ordered by offset. PTRs of an attempt
    are given out when its PRR comes, so a part that never closes gives nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open, number, tests = state.get if state.exists else (False, 0, [])
        tests, out = list(tests), []
        rows = pd.concat(list(batches)).sort_values("offset")
        for offset, kind in zip(rows["offset"], rows["mnemonic"], strict=True):
            if kind == "PIR" or not is_open:
                is_open, number, tests = True, number + 1, []
            if kind == "PTR":
                tests.append(int(offset))
            elif kind == "PRR":
                out += [(*key, t, int(offset), number) for t in tests]
                is_open, tests = False, []
        state.update((is_open, number, tests))
        yield pd.DataFrame(out, columns=["source_id", "head_num", "site_num", "offset", "prr_offset", "part_number"])

    wanted = records.filter(F.col("mnemonic").isin("PIR", "PTR", "PRR"))
    return wanted.groupBy("source_id", "head_num", "site_num").applyInPandasWithState(
        run, _DONE, "open boolean, number bigint, tests array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
