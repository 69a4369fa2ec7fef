"""EAV rows in files: schema check, Parquet with a manifest, partitioned datasets, and a versioned catalog.

All file work goes through Hadoop's FileSystem, so that paths may lie wherever Spark reads. Executors write
data; the driver renames folders and writes small JSON documents. The catalog document is the commit
point: data that no catalog names does not exist.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "eav-v2"
#: The columns of stored EAV rows, in order; those marked ! hold no nulls.
COLUMNS = (
    "lot_id! string, wafer_id string, part_id! string, head_num! smallint, site_num! smallint, x_coord smallint, y_coord smallint, hard_bin! int, soft_bin! int, "
    "part_pass! boolean, test_num! bigint, test_txt string, test_type! string, result float, test_pass boolean, lo_limit float, hi_limit float, units string, "
    "test_time_ms bigint, part_sequence! bigint, part_merge_key string"
)
REQUIRED = tuple(c.split("!")[0].strip() for c in COLUMNS.split(",") if "!" in c)
_TYPES = {"string": T.StringType, "smallint": T.ShortType, "int": T.IntegerType, "bigint": T.LongType, "boolean": T.BooleanType, "float": T.FloatType}
SCHEMA = T.StructType([T.StructField(c.split()[0], _TYPES[c.split()[1]]()) for c in COLUMNS.replace("!", "").split(", ")])
CATALOG = "_catalog.json"
MANIFEST = "_manifest.json"
RECEIPT = "_SUCCESS.json"


class Files:
    """The few file operations of the driver, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Atomically: a temporary file in the same folder, then a rename over the old one."""
        own = f"{name}.tmp-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(self.path(own)), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        self.rename(own, name)

    def create(self, name: str, text: str) -> bool:
        """Writes a file only if there is none yet; tells whether it did."""
        try:
            stream = self._fs.create(self._path(self.path(name)), False)
        except Exception as error:
            if "already exists" in str(error) or "FileAlreadyExists" in str(error):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def rename(self, old: str, new: str) -> None:
        source, target = self._path(self.path(old)), self._path(self.path(new))
        if self._fs.exists(target):
            self._fs.delete(target, True)
        if not self._fs.rename(source, target):
            raise OSError(f"can't rename {old} to {new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)

    def names(self, folder: str = "") -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path(folder))))


def stored(rows: DataFrame) -> DataFrame:
    """The columns of the schema, in order; a null where none may be fails the job."""
    types = {f.name: f.dataType for f in SCHEMA}
    kept = [F.col(c).cast(types[c]) for c in types]

    def sure(name: str, value: Column) -> Column:
        return F.when(value.isNull(), F.raise_error(F.lit(f"{name} is null")).cast(types[name])).otherwise(value) if name in REQUIRED else value

    return rows.select(*(sure(n, v).alias(n) for n, v in zip(types, kept, strict=True)))


def checked(df: DataFrame) -> DataFrame:
    """Df if its names and types are exactly the schema's."""
    want = [(f.name, f.dataType.simpleString()) for f in SCHEMA]
    if df.dtypes != want:
        raise ValueError(f"not {SCHEMA_VERSION} rows, convert the sources again: {sorted(set(df.dtypes) ^ set(want))}")
    return df


def read_eav(spark: SparkSession, *paths: str) -> DataFrame:
    """Stored rows of folders, with the order of arrival as obs_ord. Columns and filters reach the scan."""
    found = spark.read.parquet(*paths)
    checked(found.select(*(c for c in found.columns if c in SCHEMA.names)))
    return found.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("obs_ord"))


# ---- one folder with a manifest


def write_eav(spark: SparkSession, rows: DataFrame, path: str, overwrite: bool = True) -> dict:
    """Rows in a folder that appears whole or not at all, with a manifest of its totals.

    Without overwrite, an existing folder's totals are returned and nothing is read or written.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    files = Files(spark, parent)
    if not overwrite and files.exists(f"{name}/{MANIFEST}"):
        found = json.loads(files.read(f"{name}/{MANIFEST}"))
        if found.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"{path} holds {found.get('schema_version')} rows, not {SCHEMA_VERSION}")
        return found | {"reused": True}
    for left in files.names():
        if left.startswith(f".{name}.staging-"):
            files.delete(left)
    staging = f".{name}.staging-{uuid.uuid4().hex}"
    try:
        stored(rows).write.parquet(files.path(staging))
        total = spark.read.schema(SCHEMA).parquet(files.path(staging)).count()
        parts = [n for n in files.names(staging) if n.startswith("part-")]
        manifest = {"schema_version": SCHEMA_VERSION, "rows": total, "files": len(parts)}
        files.write(f"{staging}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
        files.rename(staging, name)
    finally:
        files.delete(staging)
    return manifest | {"reused": False}


# ---- partition values

#: The folder names of null and empty partition values, and the longest name.
NULL_VALUE, EMPTY_VALUE, LONGEST = "__HIVE_DEFAULT_PARTITION__", "__empty", 180
KEYS = ("lot_id", "wafer_id")


def partition_value(value: Column) -> Column:
    """P11, SC5: the folder name of a value: all bytes but A-Z, 0-9, _ and - in percent notation, as is the first _ of a name in __.

    Built on hex digits, so that it needs no Python: each pair of digits is kept or turned back into its character.
    """
    pairs = F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit("(..)"), F.lit(1))
    safe = r"\A(2D|3[0-9]|4[1-9A-F]|5[0-9AF])\z"  # - 0-9 A-Z _
    plain = F.transform(pairs, lambda h: F.when(h.rlike(safe), F.char(F.conv(h, 16, 10).cast("bigint"))).otherwise(F.concat(F.lit("%"), h)))
    text = F.regexp_replace(F.array_join(plain, ""), r"\A__", "%5F_")
    named = F.when(value.isNull(), F.lit(NULL_VALUE)).when(value == "", F.lit(EMPTY_VALUE)).otherwise(text)
    return F.when(F.length(named) > LONGEST, F.raise_error(F.lit("partition value is too long")).cast("string")).otherwise(named)


def _keys(keys: Iterable[str]) -> list[str]:
    found = [k.replace("-", "_") for k in keys]
    if not found or len(set(found)) < len(found) or set(found) - set(KEYS):
        raise ValueError(f"partition keys must be distinct and among {KEYS}: {found}")
    return found


def homogeneous(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """K4: rows, after a check that each source has one value of each key."""
    found = _keys(keys)
    odd = rows.groupBy("source_id").agg(*(F.count_distinct(F.coalesce(F.concat(F.lit("="), k), F.lit("-"))).alias(k) for k in found))
    bad = odd.filter(" OR ".join(f"{k} > 1" for k in found)).select("source_id").limit(1).collect()
    if bad:
        raise ValueError(f"source {bad[0][0]} has several values of {found}")
    return rows


def partitioned(rows: DataFrame, path: str, keys: Iterable[str], rows_per_file: int = 65_536, mode: str = "errorifexists") -> None:
    """K5: rows in folders by their encoded keys, in files of at most rows_per_file.

    Rows are dealt by key and order of arrival, so a hot key has many tasks, and sorted by key, so a task has one open writer.
    """
    found = _keys(keys)
    folders = [f"{k}_key" for k in found]
    out = stored(rows).withColumns({f: partition_value(F.col(k)) for f, k in zip(folders, found, strict=True)})
    out = out.repartition(*folders, F.floor(F.col("part_sequence") / rows_per_file)).sortWithinPartitions(*folders, "part_sequence")
    out.write.mode(mode).partitionBy(*folders).option("maxRecordsPerFile", rows_per_file).parquet(path)


# ---- catalog


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def source_id(path: str) -> str:
    return _sha(path)


class Catalog:
    """A dataset of sources whose current versions a catalog document names.

    Each version lies in its own folder of objects/, named by source, content and options, and is never
    changed. A new revision of the document replaces a source's entry; readers see the old or the new one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    # -- the document
    def load(self) -> dict:
        if not self.files.exists(CATALOG):
            return {"version": 1, "schema_version": SCHEMA_VERSION, "revision": 0, "sources": {}, "run": None}
        found = json.loads(self.files.read(CATALOG))
        if found.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"the catalog is of {found.get('schema_version')}, not {SCHEMA_VERSION}")
        return found

    def publish(self, document: dict) -> dict:
        document = document | {"revision": document["revision"] + 1}
        self.files.write(CATALOG, json.dumps(document, sort_keys=True, indent=1))
        return document

    @contextmanager
    def locked(self):
        """C4: one writer at a time; a lock file is created only where there is none."""
        if not self.files.create(".lock", uuid.uuid4().hex):
            raise RuntimeError(f"{self.files.root} is locked by another writer; after a crash, call recover(force=True)")
        try:
            yield
        finally:
            self.files.delete(".lock")

    # -- one source
    def _fragments(self, folder: str) -> list[dict]:
        """The files of a version with their rows and hashes, computed by executors; names go to the driver."""
        path = self.files.path(folder)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        hashes = files.select("path", F.sha2("content", 256).alias("sha256"))
        counts = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
        name = F.regexp_extract("path", f"({folder}/.*)\\z", 1)
        found = hashes.select(name.alias("path"), "sha256").join(counts.select(name.alias("path"), "rows"), "path", "left")
        return [{"path": r["path"], "rows": r["rows"] or 0, "sha256": r["sha256"]} for r in found.orderBy("path").collect()]  # a source's files

    def put(self, path: str, content_sha: str, rows: DataFrame, options: dict | None = None) -> dict:
        """One source's rows as its current version; the same content and options are reused after a check."""
        document, source = self.load(), source_id(path)
        made = _sha(json.dumps([source, content_sha, options or {}], sort_keys=True))
        folder = f"objects/{made}"
        known = document["sources"].get(source)
        if known and known["generation"] == made and self._sound(known):
            return known | {"reused": True}
        staging = f".staging-{uuid.uuid4().hex}"
        try:
            partitioned(rows, self.files.path(staging), (options or {}).get("keys", KEYS), (options or {}).get("rows_per_file", 65_536))
            fragments = [f | {"path": f["path"].replace(staging, folder, 1)} for f in self._fragments(staging)]
            receipt = {"version": 2, "rows": sum(f["rows"] for f in fragments), "fragments": fragments}
            self.files.write(f"{staging}/{RECEIPT}", json.dumps(receipt, sort_keys=True))
            if not self.files.exists("objects"):
                self.files._fs.mkdirs(self.files._path(self.files.path("objects")))
            self.files.rename(staging, folder)
        finally:
            self.files.delete(staging)
        entry = {"source_path": path, "source_sha256": content_sha, "options_sha256": _sha(json.dumps(options or {}, sort_keys=True)), "generation": made, **receipt}
        document["sources"][source] = entry
        self.publish(document)
        return entry | {"reused": False}

    def _sound(self, entry: dict) -> bool:
        folder = f"objects/{entry['generation']}"
        return self.files.exists(f"{folder}/{RECEIPT}") and self._fragments(folder) == entry["fragments"]

    # -- all sources
    def convert(self, sources: Iterable[tuple[str, str, DataFrame]], options: dict | None = None, continue_on_error: bool = False, digest=None) -> dict:
        """put() each (path, sha256, rows); the run's status and totals are in the document.

        The first failure ends the run unless continue_on_error; sources done before it stay. digest(path), if
        given, hashes a source again afterwards; a source that changed meanwhile fails.
        """
        with self.locked():
            run = {"id": uuid.uuid4().hex, "status": "running", "completed": 0, "failures": [], "rows": 0, "fragments": 0}
            self.publish(self.load() | {"run": run})
            seen: set[str] = set()
            for path, sha, rows in sources:
                if path in seen:  # U2
                    continue
                seen.add(path)
                try:
                    entry = self.put(path, sha, rows, options)
                    if digest is not None and digest(path) != sha:
                        raise ValueError("the source changed during its conversion")
                    run |= {"completed": run["completed"] + 1, "rows": run["rows"] + entry["rows"], "fragments": run["fragments"] + len(entry["fragments"])}
                except Exception as error:
                    run["failures"].append({"source": path, "error": str(error).splitlines()[0][:500]})
                    if not continue_on_error:
                        self.publish(self.load() | {"run": run | {"status": "failed"}})
                        raise
            status = "complete" if not run["failures"] else "partial" if run["completed"] else "failed"
            self.publish(self.load() | {"run": run | {"status": status}})
            return run | {"status": status}

    def current(self) -> DataFrame:
        """source_id, path and rows of each current fragment."""
        rows = [(s, f["path"], f["rows"], f["sha256"]) for s, e in sorted(self.load()["sources"].items()) for f in e["fragments"]]
        seen = [r[1] for r in rows]
        if len(set(seen)) < len(seen):  # U5
            raise ValueError("the catalog names a fragment twice")
        return self.spark.createDataFrame(rows, "source_id string, path string, rows bigint, sha256 string")

    def rows(self) -> DataFrame:
        """The rows of all current versions, with source_id and obs_ord (source, fragment, row)."""
        entries = {s: [self.files.path(f["path"]) for f in e["fragments"]] for s, e in sorted(self.load()["sources"].items())}
        paths = [p for ps in entries.values() for p in ps]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA).withColumns({"source_id": F.lit(""), "obs_ord": F.struct(F.lit("").alias("source_id"), F.lit("").alias("file"), F.lit(0).alias("row"))})
        place = F.regexp_extract("_metadata.file_path", r"(objects/.*)\z", 1)
        found = self.spark.read.schema(SCHEMA).parquet(*paths).select("*", place.alias("path"), F.col("_metadata.row_index").alias("row"))
        named = self.current().select(F.regexp_replace("path", "%", "%25").alias("quoted"), F.col("path").alias("plain"), "source_id")
        named = named.select("source_id", F.explode(F.array_distinct(F.array("quoted", "plain"))).alias("path"))
        found = found.join(named, "path")
        return found.select(*SCHEMA.names, "source_id", F.struct("source_id", F.col("path").alias("file"), "row").alias("obs_ord"))

    def verify(self) -> dict:
        """Every named fragment is there with its rows and hash, and ids, totals and paths are consistent; raises otherwise."""
        document = self.load()
        self.current()
        for source, entry in document["sources"].items():
            if source != source_id(entry["source_path"]):
                raise ValueError(f"source {source} doesn't belong to {entry['source_path']}")
            folder = f"objects/{entry['generation']}/"
            if any(not f["path"].startswith(folder) or ".." in f["path"] for f in entry["fragments"]):
                raise ValueError(f"a fragment of {entry['source_path']} lies outside its folder")
            if entry["rows"] != sum(f["rows"] for f in entry["fragments"]):
                raise ValueError(f"the totals of {entry['source_path']} differ")
            if not self._sound(entry):
                raise ValueError(f"fragments of {entry['source_path']} are missing or changed")
        return {"sources": len(document["sources"]), "rows": sum(e["rows"] for e in document["sources"].values()), "revision": document["revision"]}

    def recover(self, force: bool = False) -> list[str]:
        """Drops what an interrupted run left and marks the run; force also drops its lock."""
        if force:
            self.files.delete(".lock")
        with self.locked():
            left = [n for n in self.files.names() if n.startswith(".staging-") or n.startswith(f"{CATALOG}.tmp-")]
            for name in left:
                self.files.delete(name)
            document = self.load()
            if document["run"] and document["run"]["status"] == "running":
                self.publish(document | {"run": document["run"] | {"status": "interrupted"}})
            return left

    def guard(self, output: str) -> str:
        """A report may not overwrite the dataset."""
        inside = output.rstrip("/").removeprefix(self.files.root)
        if inside != output.rstrip("/") and (inside in ("", f"/{CATALOG}") or inside.startswith("/objects")):
            raise ValueError("the output would overwrite the dataset")
        return output
