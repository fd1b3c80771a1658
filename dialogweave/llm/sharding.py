"""Shards balanced in bytes, tokens and rows by vector bin packing.

Equal texts form a group and stay together. A group is a vector (bytes, tokens, rows). Groups
are items of their own as far as the driver's table of items allows (see ``_runs``); of the
others, those of one class, whose vectors agree in the power of two of every measure, share
items, so an item points where its groups do. Items are placed in order of size, each into the
shard where the dot product of the item and the shard's residual capacity is highest, among
those with room for it: in all three if there are such, else in bytes. A group larger than a
shard's fair share can't stay whole in balanced shards: it is divided by a hash of its rows'
numbers into parts of a fraction of a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from dialogweave.llm.common import shuffle_parts, written

RUNS = 4096  # items of small groups: at most 4 * RUNS, and 2 a class
LARGE = 4096  # groups above total / LARGE are items of their own: fewer than 3 * LARGE of them
PARTS = 16  # parts to a shard of groups that exceed one: fewer than 3 * 2 * 16 * shards of them
MEASURES = ("size", "tokens", "rows")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (row: bytes, tokens, rows), largest items first; bytes come first
    where the three can't be balanced together."""
    total = items.sum(axis=0).astype(float)
    scale = np.where(total > 0, total, 1.0) / shards
    share = items / scale
    left = np.ones((shards, items.shape[1]))
    chosen = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.sum(axis=1), -share.max(axis=1))):
        room = left >= share[i] - 1e-12
        if room.all(axis=1).any():
            able = room.all(axis=1)
        elif room[:, 0].any():
            able = room[:, 0]
        else:  # no shard has room for the bytes: the one with most
            able = left[:, 0] == left[:, 0].max()
        best = int(np.argmax(np.where(able, left @ share[i], -np.inf)))
        chosen[i] = best
        left[best] -= share[i]
    return chosen


def balanced_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens), a row per row of docs.

    size is the bytes of the UTF-8 text plus 1; tokens counts its words. The law is ``bytes``:
    the shards' sums of size are near equal, and so are their tokens and rows as far as the
    groups allow. slot numbers each shard's rows from 0 without gaps. NULL texts have size 1,
    CRC 0 and form a group, apart from the group of empty texts. NULL ids and repeated rows
    are rows like others. grown_shard is NULL. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.coalesce(F.md5(text_col), F.lit("null")).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    groups = written(rows.groupBy("group").agg(*_sums(F.count("*"))), "groups")
    totals = groups.agg(*_sums(F.sum("rows")), F.count("*").alias("groups")).first()
    fair = {c: max(1, -(-(totals[c] or 0) // shards)) for c in MEASURES}
    shares = F.greatest(*(F.col(c) / F.lit(fair[c]) for c in MEASURES))
    parts = F.when(shares > 1, F.ceil(shares * PARTS)).otherwise(1).cast("long")
    large = groups.where(shares > shards / LARGE).select("group", F.col("group").alias("item"), parts.alias("parts"))
    small = _runs(groups.where(shares <= shards / LARGE), totals)
    part = F.pmod(F.xxhash64("row"), F.col("parts")).alias("part")
    # Only large groups have many rows, and they are few: no key of the shuffled join is hot.
    found = rows.join(F.broadcast(large), "group", "left")
    rest = found.where("item is null").drop("item", "parts").join(small, "group").withColumn("parts", F.lit(1).cast("long"))
    tagged = written(
        found.where("item is not null").unionByName(rest).select("doc_id", "size", "text_crc32", "tokens", "row", "item", part), "tagged"
    )
    weights = tagged.groupBy("item", "part").agg(*_sums(F.count("*"))).collect()  # bounded, see RUNS, LARGE and PARTS
    items = sorted(weights, key=lambda r: (r["item"], r["part"]))
    chosen = place(np.array([[r[c] for c in MEASURES] for r in items], float).reshape(-1, 3), shards)
    plan = spark.createDataFrame(
        [(r["item"], r["part"], int(s)) for r, s in zip(items, chosen, strict=True)], "item string, part long, shard int"
    )
    placed = tagged.join(F.broadcast(plan), ["item", "part"]).select("doc_id", "size", "text_crc32", "tokens", "row", "shard")
    return _with_slots(written(placed, "placed"), shuffle_parts(spark))


def _sums(rows: Column) -> list[Column]:
    return [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), rows.alias("rows")]


def _runs(groups: DataFrame, totals: Row) -> DataFrame:
    """(group, item) of groups(group, size, tokens, rows).

    A class gets items by its weight and by its number of groups, whichever gives more; as many
    as it has groups give each group its own, fewer are shared by a hash. There are at most a
    hundred thousand classes whatever the input (a power of two for each of three 63-bit
    measures, of which tokens and rows never exceed bytes), in practice some hundred."""
    power = F.concat_ws(".", *(F.floor(F.log2(F.col(c) + 1)).cast("string") for c in MEASURES))
    classed = groups.withColumn("class", power)
    weight = F.greatest(*(F.sum(c) / F.lit(max(1, totals[c] or 0)) for c in MEASURES), F.count("*") / F.lit(max(1, totals["groups"])))
    counts = classed.groupBy("class").agg(F.ceil(weight * RUNS).alias("runs"), F.count("*").alias("n"))
    run = F.concat_ws("/", "class", F.pmod(F.xxhash64("group"), F.col("runs")).cast("string"))
    return classed.join(F.broadcast(counts), "class").select("group", F.when(F.col("runs") >= F.col("n"), F.col("group")).otherwise(run).alias("item"))


def _with_slots(rows: DataFrame, parts: int) -> DataFrame:
    """Numbers each shard's rows without gaps: within cells by id, the cells one after the
    other, so that no shard is sorted in one task. Cells are drawn by row, not by id or text."""
    cells = 4 * parts
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    counts = rows.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "row")
    numbered = rows.withColumn("inner", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "cell"]).select(  # a row per shard and cell
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("inner")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
