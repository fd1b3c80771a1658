"""Folders of JSON documents with one document per key, replaced in whole steps.

Documents lie in generation folders, one sub-folder per hash bucket of the key. A manifest names
the generation that holds each bucket. A run rewrites only the buckets in which something
changes, into a new generation, and then puts a manifest of the next number into place by a
rename that fails if that number exists. So a run that fails has no effect, a run that is repeated
changes nothing, and a reader sees all of a run or nothing.
"""

from __future__ import annotations

import json
import uuid
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from dialogweave.session import written

BUCKETS = 64
_BODY = "value string, _bucket int"


class ConcurrentWrite(RuntimeError):
    """Another run has put its manifest into place first; nothing of this one is visible."""


def _place(spark: SparkSession, path: str):
    """The folder as a Hadoop path with its file context."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    folder = folder.getFileSystem(conf).makeQualified(folder)
    return jvm, folder, folder.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)


def _manifest(spark: SparkSession, path: str) -> Optional[dict]:
    """The newest manifest: number, buckets, and the generation of each filled bucket."""
    jvm, folder, fs, _ = _place(spark, path)
    home = jvm.org.apache.hadoop.fs.Path(folder, "_manifest")
    if not fs.exists(home):
        return None
    numbers = [int(n[:-5]) for s in fs.listStatus(home) if (n := s.getPath().getName()).endswith(".json")]
    if not numbers:
        return None
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(home, f"{max(numbers):012d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, manifest: dict) -> None:
    jvm, folder, fs, context = _place(spark, path)
    home = jvm.org.apache.hadoop.fs.Path(folder, "_manifest")
    draft = jvm.org.apache.hadoop.fs.Path(home, f".{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(home, f"{manifest['number']:012d}.json")
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, final, plain)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise ConcurrentWrite(f"{path} has a manifest {manifest['number']}") from e
        raise


def _folders(path: str, manifest: dict, buckets: Optional[Sequence[int]] = None) -> list[str]:
    held = manifest["generations"]
    chosen = held if buckets is None else [str(b) for b in buckets if str(b) in held]
    return [f"{path.rstrip('/')}/{held[b]}/_bucket={b}" for b in chosen]


def _stored(spark: SparkSession, path: str, manifest: Optional[dict], buckets: Optional[Sequence[int]] = None) -> DataFrame:
    folders = _folders(path, manifest, buckets) if manifest else []
    if not folders:
        return spark.createDataFrame([], _BODY)
    return spark.read.schema("value string").option("recursiveFileLookup", "true").text(folders).select(
        "value", F.regexp_extract(F.col("_metadata.file_path"), r"_bucket=(\d+)/", 1).cast("int").alias("_bucket")
    )


def _with_key(lines: DataFrame, fields) -> DataFrame:
    """Adds the key as it stands in the document, as JSON text."""
    return lines.withColumn("_key", F.to_json(F.from_json("value", fields)))


def write_keyed(docs: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS) -> bool:
    """Documents into a keyed folder: a key's document replaces the one before, other keys keep
    theirs. True if anything changed.

    Every row is one document; of several rows with one key the one greatest as JSON text counts.
    ``buckets`` holds for a folder's first run. Unchanged documents are not written again unless
    their bucket is. Raises ``ConcurrentWrite`` if another run was faster.
    """
    spark = docs.sparkSession
    before = _manifest(spark, path)
    buckets = before["buckets"] if before else buckets
    fields = StructType([docs.schema[k] for k in key])
    lines = _with_key(docs.select(F.to_json(F.struct(*docs.columns)).alias("value")), fields)
    lines = lines.groupBy("_key").agg(F.max("value").alias("value")).withColumn(
        "_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")
    )
    lines = written(lines, "incoming")
    held = _with_key(_stored(spark, path, before), fields)
    changed = written(lines.join(held.select("_key", "value"), ["_key", "value"], "left_anti"), "changed")
    touched = sorted(r[0] for r in changed.select("_bucket").distinct().collect())
    if not touched:
        if before is None:
            _put(spark, path, {"number": 1, "buckets": buckets, "generations": {}})
        return False
    kept = _with_key(_stored(spark, path, before, touched), fields).join(changed.select("_key"), "_key", "left_anti")
    generation = f"generation-{uuid.uuid4().hex}"
    rows = kept.select("_bucket", "value").unionByName(changed.select("_bucket", "value"))
    rows.repartition("_bucket").write.partitionBy("_bucket").text(f"{path.rstrip('/')}/{generation}")
    held_by = dict(before["generations"]) if before else {}
    held_by |= {str(b): generation for b in touched}
    _put(spark, path, {"number": before["number"] + 1 if before else 1, "buckets": buckets, "generations": held_by})
    return True


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The current documents as JSON lines ``value``."""
    return _stored(spark, path, _manifest(spark, path)).select("value")


def read_keyed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The current documents of a keyed folder; none where nothing has been written."""
    return read_lines(spark, path).select(F.from_json("value", schema).alias("_d")).select("_d.*")


def remove_unused(spark: SparkSession, path: str) -> int:
    """Deletes generations that the newest manifest does not name, with the older manifests; for
    when no reader and no run is under way. Returns the number of generations deleted."""
    manifest = _manifest(spark, path)
    jvm, folder, fs, _ = _place(spark, path)
    used = set(manifest["generations"].values()) if manifest else set()
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("generation-") and s.getPath().getName() not in used]
    for place in gone:
        fs.delete(place, True)
    for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder, "_manifest")) if manifest else []:
        if s.getPath().getName() < f"{manifest['number']:012d}.json":
            fs.delete(s.getPath(), False)
    return len(gone)
