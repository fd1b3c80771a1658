"""Token totals kept by signed changes.

A batch holds the additive effect of its changes on (source, lang, tokenizer_version): what a
change takes away counts negative, what it adds positive. Its job writes the effects to a folder of
its own under ``data``; then a file ``commits/<batch>`` that names this folder is renamed into
place, which fails if the batch has one. So a job that dies at any point has no effect, of two
drivers with one batch one counts, and replaying a batch changes nothing.

``compact`` maintains the total: it adds the batches committed since the last base to it and
names the new base, with the batches it holds, in ``bases/<number>`` in the same way. The totals
are the newest base and the batches it does not hold. The lists of batches are read by the driver:
a line per batch, never a row of data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogweave.llm.sentencepiece_codec import process_codec

KEYS = ("source", "lang", "tokenizer_version")
CHANGES = (
    "change_id string, action string, source string, lang string, old_version string, old_tokens long, "
    "new_version string, new_tokens long"
)


EFFECTS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollup:
    """The rollup under ``path``, a folder that all executors reach, on a file system whose
    rename is atomic."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        """A path in the rollup with its file system."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.makeQualified(place), files

    def _names(self, folder: str) -> list[str]:
        place, files = self._place(folder)
        found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return sorted(n for n in found if not n.startswith("."))

    def _read(self, name: str) -> dict:
        place, files = self._place(name)
        stream = files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _claim(self, name: str, content: dict) -> bool:
        """Puts a file into place whole, or leaves the one that is there; whether it did."""
        final, files = self._place(name)
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, plain)
            return True
        except Exception:
            files.delete(draft, False)
            if files.exists(final):
                return False
            raise

    def _remove(self, folder: str) -> None:
        place, files = self._place(f"data/{folder}")
        files.delete(place, True)

    def _base(self) -> dict:
        numbers = self._names("bases")
        return self._read(f"bases/{numbers[-1]}") if numbers else {"number": 0, "folder": None, "batches": []}

    def committed(self, batch: str) -> bool:
        """Whether the batch counts."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError("a batch id has letters, digits, - and _ only")
        place, files = self._place(f"commits/{batch}")
        return files.exists(place)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (columns: CHANGES; others are not read) once; False if it
        was there already, also where another driver's job for it ended first.

        insert adds (new_version, new_tokens), delete takes (old_version, old_tokens) away,
        revise does both. Changes with the same change_id in a batch count once, those with a
        NULL change_id each; batches do not look at each other's change_ids. NULL tokens count
        0; NULL source, language or version is a key of its own. Another action fails the batch.
        An empty batch is committed empty."""
        if self.committed(batch):
            return False
        folder = f"{batch}-{uuid.uuid4().hex}"
        signed_effects(changes).write.parquet(f"{self.path}/data/{folder}")
        won = self._claim(f"commits/{batch}", {"folder": folder})
        if not won:
            self._remove(folder)
        return won

    def _sums(self, base: dict, batches: list[str]) -> DataFrame:
        folders = [self._read(f"commits/{b}")["folder"] for b in batches] + ([base["folder"]] if base["folder"] else [])
        if not folders:
            return self.spark.createDataFrame([], EFFECTS)
        held = self.spark.read.schema(EFFECTS).parquet(*(f"{self.path}/data/{f}" for f in folders))
        sums = held.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def _later(self, base: dict) -> list[str]:
        return sorted(set(self._names("commits")) - set(base["batches"]))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over the committed batches; keys
        that add up to nothing are left out."""
        base = self._base()
        return self._sums(base, self._later(base))

    def compact(self) -> bool:
        """Adds the batches committed since to the base, so that reading does not grow with the
        history; False if there are none or another driver was faster. Batches stay committed."""
        base = self._base()
        later = self._later(base)
        if not later:
            return False
        folder = f"base-{uuid.uuid4().hex}"
        self._sums(base, later).write.parquet(f"{self.path}/data/{folder}")
        number = base["number"] + 1
        won = self._claim(f"bases/{number:012d}", {"number": number, "folder": folder, "batches": base["batches"] + later})
        if not won:
            self._remove(folder)
        return won

    def remove_unused(self) -> int:
        """Deletes the folders that no commit since the base and no newest base names, and the older
        bases; for when no reader and no job is under way. Returns the number of folders."""
        base = self._base()
        used = {self._read(f"commits/{b}")["folder"] for b in self._later(base)} | {base["folder"]}
        gone = [n for n in self._names("data") if n not in used]
        for folder in gone:
            self._remove(folder)
        for name in self._names("bases")[:-1]:
            place, files = self._place(f"bases/{name}")
            files.delete(place, False)
        return len(gone)


def signed_effects(changes: DataFrame) -> DataFrame:
    """The sums of what the changes add and take away, by key."""
    columns = [c.split()[0] for c in CHANGES.split(", ")]
    named = changes.select(*columns)
    once = named.where("change_id is not null").dropDuplicates(["change_id"]).union(named.where("change_id is null"))
    known = F.col("action").isin("insert", "delete", "revise")
    checked = F.when(known, F.col("action")).otherwise(F.raise_error(F.lit("unknown action")).cast("string"))
    taken = F.struct(F.col("old_version").alias("tokenizer_version"), F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce("old_tokens", F.lit(0))).cast("long").alias("n_tokens"))
    added = F.struct(F.col("new_version").alias("tokenizer_version"), F.lit(1).cast("long").alias("n_docs"), F.coalesce("new_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    effects = F.when(checked == "insert", F.array(added)).when(F.col("action") == "delete", F.array(taken)).otherwise(F.array(taken, added))
    each = once.select("source", "lang", F.explode(effects).alias("e")).select("source", "lang", "e.*")
    return each.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and n_tokens of each row's whole text; NULL and empty texts have 0."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = process_codec(model)
        for batch in batches:
            joined = (codec.encode_joined(t)[0] for t in batch.column(len(keep)).to_pylist())
            counts = [ids.count(",") + bool(ids) for ids in joined]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long"
    return docs.select(*keep, text_col).mapInArrow(run, schema)
