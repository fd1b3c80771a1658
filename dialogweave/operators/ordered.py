"""Order-dependent building blocks that never put one conversation into one task.

Rows have a key and an order within it. A key with more than ``2**bits`` rows is *long* and
is cut into blocks of that many consecutive rows, by rank, so a block holds a bounded number of
rows and a key has as few blocks as its rows need, whatever the values of ``seq``: dense,
clock-like or with gaps. Rows are shuffled by (key, block) once and windows run inside blocks.
What must cross a block border is carried by a *directory*: one narrow row per block of the long
keys. Where no key is long there are no blocks: windows run per key, without directory or join.

``blocks_of`` finds the blocks of a table in one pass over key and order. Operators do that
themselves, or take the blocks of a table with the same keys and order, such as their input's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Optional

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialogweave.session import written

BLOCK_BITS = 16
BLOCK = "_block"

# Limits of one part of a text or list, whatever the values of ``seq``.
PART_ROWS = 1 << 16
PART_BYTES = 64 << 20

_BEFORE = (Window.unboundedPreceding, -1)


# --- distributed ordinal --------------------------------------------------------------


def with_ordinal(df: DataFrame, key: str, order: list[str], name: str = "ordinal", total: Optional[str] = None) -> DataFrame:
    """Adds ``name``: the place of each row, from 0, among those of its key by ``order``; and
    with ``total`` the number of these rows. NULL is a key like others.

    Rows are ranged over all partitions by (key, order), so a key of any length is spread, and
    written with their place in the partition. What is counted behind is one row per partition
    and key. Rows equal in ``order`` have any order among themselves, but keep it.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = written(
        numbered.repartitionByRange(parts, key, *order, "_tie")
        .sortWithinPartitions(key, *order, "_tie")
        .drop("_tie")
        .select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")),
        "ordinal",
    )
    runs = ranged.groupBy(F.col("_pid").alias("_p"), F.col(key).alias("_k")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    of_key = Window.partitionBy("_k")
    earlier = F.coalesce(F.sum("_rows").over(of_key.orderBy("_p").rowsBetween(*_BEFORE)), F.lit(0))
    shifts = runs.select(
        "_p", "_k", (earlier - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_key).alias("_total")
    )
    joined = ranged.join(shifts, (F.col("_pid") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    ordinal = (F.col("_at") + F.col("_shift")).alias(name)
    return joined.select(*df.columns, ordinal, *([F.col("_total").alias(total)] if total else []))


@dataclass(frozen=True)
class Blocks:
    """Where the blocks of long keys begin.

    ``starts`` has ``_long_key`` and ``_starts``, the ascending orders at which the blocks begin,
    or is None where no key is long; ``most`` is the largest number of blocks of a key.
    """

    starts: Optional[DataFrame] = None
    most: int = 1

    @property
    def single(self) -> bool:
        return self.starts is None


def blocks_of(
    df: DataFrame, key: str = "conversation_id", order: str = "seq", bits: int = BLOCK_BITS
) -> Blocks:
    """The blocks of a table: one pass over key and order, and a ranking of long keys' orders.

    Any table whose rows have these keys and orders may use them. Blocks of a part of the rows
    hold fewer rows, of more rows more.
    """
    placed = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(
        F.col(key).alias("_long_key"), F.col(order).cast("bigint").alias("_o")
    )
    counts = placed.groupBy("_long_key").agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0] or 0
    if largest <= 1 << bits:
        return Blocks()
    long = written(counts.where(F.col("_n") > 1 << bits).select("_long_key"), "long-keys")
    ranked = with_ordinal(placed.join(long, "_long_key", "left_semi"), "_long_key", ["_o"])
    firsts = ranked.where(F.col("ordinal").bitwiseAND((1 << bits) - 1) == 0)
    # Rows at the same place stay together: a place that fills a block begins one.
    starts = firsts.groupBy("_long_key").agg(F.array_sort(F.collect_set("_o")).alias("_starts"))
    return Blocks(written(starts, "blocks"), -(-largest >> bits))


def _found(starts: Column, value: Column) -> Column:
    """How many of the ascending ``starts`` are at most ``value``, by halving."""
    halvings = F.sequence(F.floor(F.log2(F.size(starts))).cast("int"), F.lit(0), F.lit(-1))
    steps = F.transform(halvings, lambda i: F.pow(F.lit(2), i).cast("int"))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda pos, step: F.when(F.get(starts, pos + step - 1) <= value, pos + step).otherwise(pos),
    )


def with_block(df: DataFrame, blocks: Blocks, key: str = "conversation_id", order: str = "seq") -> DataFrame:
    """Adds the row's block, counted from 0 in each key; 0 in keys that are not long."""
    if blocks.single:
        return df.withColumn(BLOCK, F.lit(0).cast("bigint"))
    value = F.col(order).cast("bigint")
    place = F.greatest(_found(F.col("_starts"), value) - 1, F.lit(0))
    return (
        df.join(blocks.starts, F.col(key) == F.col("_long_key"), "left")
        .withColumn(BLOCK, F.when(F.col("_starts").isNull(), 0).otherwise(place).cast("bigint"))
        .drop("_long_key", "_starts")
    )


# --- blocks and their directory -------------------------------------------------------


def _packed(df: DataFrame, blocks: Blocks, key: str, order: str) -> DataFrame:
    """Key, order, block, and the whole row as one struct ``_e``.

    Windows take ``_e`` itself, so a row's texts cross the shuffle once. A row without key
    or order has no place in a sequence; filtering it here, as the joins on both would,
    lets every branch read the same shuffle.
    """
    placed = df.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    packed = placed.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.struct(*df.columns).alias("_e"))
    return with_block(packed, blocks, "_key", "_order").select("_key", "_order", BLOCK, "_e")


def in_block(blocks: Blocks, key: str, order: str = "seq"):
    """The window of a block; per key where there are no blocks, so that what is grouped by key
    afterwards needs no other shuffle."""
    return Window.partitionBy(*([key] if blocks.single else [key, BLOCK])).orderBy(order)


def across_blocks(key: str):
    return Window.partitionBy(key).orderBy(BLOCK)


def block_directory(blocked: DataFrame, key: str, totals: dict[str, Column] | None = None) -> DataFrame:
    """One row per block of every key with several blocks.

    Columns: key, ``_block``, ``_rows`` (rows in the block), ``_rows_before``, and for each
    entry of ``totals`` its sum over all earlier blocks. Counting is combined map-side, and
    only (key, block) partials are shuffled.
    """
    totals = totals or {}
    per_block = blocked.groupBy(key, BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(e).alias(n) for n, e in totals.items()]
    )
    order = across_blocks(key)
    before = order.rowsBetween(*_BEFORE)
    several = F.lag(BLOCK).over(order).isNotNull() | F.lead(BLOCK).over(order).isNotNull()
    return (
        per_block.select(
            key,
            BLOCK,
            "_rows",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals],
            several.alias("_several"),
        )
        .where("_several")
        .drop("_several")
    )


def prefix_scan(
    states: DataFrame, key: str, merge: Callable[[Column, Column], Column], blocks: Blocks
) -> DataFrame:
    """Per block, ``_state`` merged over all strictly earlier blocks of its key; the first has none.

    states has key, ``_block`` and ``_state``, a row for every block, and NULL for blocks in
    which nothing happened. ``merge(earlier, later)`` is associative and its result no larger than a state may be. Each step joins every block with
    the one twice as far back and is written, so the steps are as many as the logarithm of the
    number of blocks and no task sees more than two states of a key at a time.
    """
    states = written(states.select(key, BLOCK, "_state"), "scan")
    distance = 1
    while distance < blocks.most:
        back = states.select(key, (F.col(BLOCK) + distance).alias(BLOCK), F.col("_state").alias("_earlier"))
        both = merge(F.col("_earlier"), F.col("_state"))
        merged = F.when(F.col("_earlier").isNull(), F.col("_state")).when(F.col("_state").isNull(), F.col("_earlier")).otherwise(both)
        states = written(states.join(back, [key, BLOCK], "left").select(key, BLOCK, merged.alias("_state")), "scan")
        distance *= 2
    return states.withColumn(BLOCK, F.col(BLOCK) + 1)


# --- operators on ordered rows --------------------------------------------------------


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    key: str = "conversation_id",
    order: str = "seq",
    bits: int = BLOCK_BITS,
    blocks: Optional[Blocks] = None,
) -> DataFrame:
    """Adds, per row, each expression's sum over the strictly earlier rows of its key.

    Rows without order have no place: they add to no sum and see none.
    """
    blocks = blocks or blocks_of(df, key, order, bits)
    placed = {n: F.when(F.col(order).isNotNull(), e) for n, e in sums.items()}
    blocked = with_block(df, blocks, key, order)
    before = in_block(blocks, key, order).rowsBetween(*_BEFORE)

    def seen(total: Column) -> Column:
        return F.when(F.col(order).isNull(), 0).otherwise(F.coalesce(total, F.lit(0))).cast("bigint")

    local = blocked.select("*", *[seen(F.sum(e).over(before)).alias(n) for n, e in placed.items()])
    if blocks.single:
        return local.select(*df.columns, *sums)
    carried = {f"_c_{n}": e for n, e in placed.items()}
    directory = block_directory(blocked, key, carried).drop("_rows", "_rows_before")
    joined = local.join(directory, [key, BLOCK], "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col(order).isNull(), 0).otherwise(F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
    )


def running_last(
    df: DataFrame,
    values: dict[str, Column],
    key: str = "conversation_id",
    order: str = "seq",
    bits: int = BLOCK_BITS,
    blocks: Optional[Blocks] = None,
) -> DataFrame:
    """Adds, per row, each expression's last non-NULL value among the rows of its key with a
    smaller ``order``. Rows at the same place do not see each other; rows without key or order
    have no place and are left out."""
    placed = df.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    placed = placed.withColumn(order, F.col(order).cast("bigint"))
    blocks = blocks or blocks_of(placed, key, order, bits)
    blocked = with_block(placed, blocks, key, order)
    before = in_block(blocks, key, order).rangeBetween(*_BEFORE)
    local = blocked.select("*", *[F.last(e, ignorenulls=True).over(before).alias(n) for n, e in values.items()])
    if blocks.single:
        return local.select(*df.columns, *values)
    per_block = blocked.groupBy(key, BLOCK).agg(
        *[F.max_by(e, F.when(e.isNotNull(), F.col(order))).alias(f"_c_{n}") for n, e in values.items()]
    )
    earlier = across_blocks(key).rowsBetween(*_BEFORE)
    directory = per_block.select(
        key,
        BLOCK,
        *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values],
        F.lag(BLOCK).over(across_blocks(key)).isNotNull().alias("_follows"),
    ).where("_follows")
    joined = local.join(directory.drop("_follows"), [key, BLOCK], "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(n), F.col(f"_c_{n}")).alias(n) for n in values])


def with_next(
    df: DataFrame,
    columns: list[str],
    key: str = "conversation_id",
    order: str = "seq",
    bits: int = BLOCK_BITS,
    blocks: Optional[Blocks] = None,
) -> DataFrame:
    """Adds ``_next``: struct of the given columns of the following row, NULL at the end."""
    blocks = blocks or blocks_of(df, key, order, bits)
    rows = _packed(df, blocks, key, order)
    window = in_block(blocks, "_key", "_order")
    following_row = F.lead("_e").over(window).alias("_following")
    if blocks.single:
        joined = rows.select("_e", following_row)
    else:
        following = (
            block_directory(rows, "_key")
            .select("_key", BLOCK, F.lead(BLOCK).over(across_blocks("_key")).alias("_to"))
            .where(F.col("_to").isNotNull())
        )
        # First row of each block that follows another one, addressed to that other block.
        firsts = rows.withColumn("_is_first", F.lag("_order").over(window).isNull()).where("_is_first")
        heads = (
            following.select("_key", F.col(BLOCK).alias("_from"), F.col("_to").alias(BLOCK))
            .join(firsts.select("_key", BLOCK, F.col("_e").alias("_head")), ["_key", BLOCK])
            .select("_key", F.col("_from").alias(BLOCK), "_head")
        )
        joined = (
            rows.withColumn("_lead", F.lead("_e").over(window))
            .join(heads, ["_key", BLOCK], "left")
            .select("_e", F.coalesce("_lead", "_head").alias("_following"))
        )
    return joined.select(
        "_e.*",
        F.when(
            F.col("_following").isNotNull(), F.struct(*[F.col(f"_following.{c}") for c in columns])
        ).alias("_next"),
    )


def with_last_rows(
    df: DataFrame,
    n: int,
    key: str = "conversation_id",
    order: str = "seq",
    bits: int = BLOCK_BITS,
    blocks: Optional[Blocks] = None,
) -> DataFrame:
    """Adds ``_frame``: the last ``n`` rows up to and including the current one, in order."""
    blocks = blocks or blocks_of(df, key, order, bits)
    rows = _packed(df, blocks, key, order)
    window = in_block(blocks, "_key", "_order")
    local = rows.withColumn(
        "_local", F.collect_list("_e").over(window.rowsBetween(-(n - 1), 0))
    )
    if n == 1 or blocks.single:
        return local.select("_e.*", F.col("_local").alias("_frame"))
    # Blocks that still need rows of this one: fewer than n-1 rows lie in between.
    ahead = across_blocks("_key").rowsBetween(1, n - 1)
    through = F.col("_rows_before") + F.col("_rows")
    targets = (
        block_directory(rows, "_key")
        .select(
            "_key",
            BLOCK,
            "_rows",
            through.alias("_through"),
            F.collect_list(F.struct(F.col(BLOCK).alias("to"), F.col("_rows_before").alias("at")))
            .over(ahead)
            .alias("_ahead"),
        )
        .select("_key", BLOCK, "_rows", "_through", F.explode("_ahead").alias("_t"))
        .where(F.col("_t.at") - F.col("_through") < n - 1)
        .select("_key", BLOCK, "_rows", F.col("_t.to").alias("_to"))
    )
    numbered = rows.withColumn("_rn", F.row_number().over(window))
    tails = (
        targets.join(numbered, ["_key", BLOCK])
        .where(F.col("_rn") > F.col("_rows") - (n - 1))
        .groupBy("_key", F.col("_to").alias(BLOCK))
        .agg(F.array_sort(F.collect_list(F.struct("_order", "_e"))).alias("_tail"))
    )
    whole = F.when(F.col("_tail").isNull(), F.col("_local")).otherwise(
        F.concat(F.transform("_tail", lambda t: t["_e"]), "_local")
    )
    return local.join(tails, ["_key", BLOCK], "left").select(
        "_e.*", last_of(whole, n).alias("_frame")
    )


def with_earlier(
    df: DataFrame,
    entries: Column,
    latest: Callable[[Column], Column],
    key: str = "conversation_id",
    order: str = "seq",
    bits: int = BLOCK_BITS,
    blocks: Optional[Blocks] = None,
) -> DataFrame:
    """Adds ``_earlier``: the state of all strictly earlier rows, an array.

    ``entries`` is a row's array of entries or NULL, and ``latest`` turns the entries of
    consecutive rows into a state that stands for them: no longer than some bound (such as the
    flow), and the same whether taken at once or from the states of pieces. So what a block hands
    on is bounded, and blocks are scanned in logarithmic steps (see ``prefix_scan``).
    """
    blocks = blocks or blocks_of(df, key, order, bits)
    blocked = with_block(df, blocks, key, order).withColumn("_own", entries)
    before = in_block(blocks, key, order).rowsBetween(*_BEFORE)
    local = blocked.withColumn("_local", latest(F.flatten(F.collect_list("_own").over(before))))
    if blocks.single:
        return local.select(*df.columns, F.col("_local").alias("_earlier"))
    per_block = blocked.where(F.col(key).isNotNull() & F.col(order).isNotNull()).groupBy(key, BLOCK).agg(
        latest(F.flatten(F.collect_list("_own"))).alias("_state")
    )
    every = blocks.starts.select(F.col("_long_key").alias(key), F.posexplode("_starts").alias(BLOCK, "_at"))
    states = every.withColumn(BLOCK, F.col(BLOCK).cast("bigint")).join(per_block, [key, BLOCK], "left")
    carried = prefix_scan(states, key, lambda a, b: latest(F.concat(a, b)), blocks).withColumnRenamed("_state", "_carried")
    whole = F.when(F.col("_carried").isNull(), F.col("_local")).otherwise(latest(F.concat("_carried", "_local")))
    return local.join(carried, [key, BLOCK], "left").select(*df.columns, whole.alias("_earlier"))


def last_of(array: Column, n: int) -> Column:
    """Last ``n`` elements; unlike a negative slice start it also works on short arrays."""
    return F.slice(array, F.greatest(F.lit(1), F.size(array) - (n - 1)), n)


# --- texts and lists in parts ---------------------------------------------------------


def with_part(
    df: DataFrame,
    size: Column,
    key: str = "conversation_id",
    order: str = "seq",
    bits: int = BLOCK_BITS,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Adds ``part``: a new one begins after every ``part_rows`` rows and ``part_bytes`` bytes.

    Rows and bytes are counted from the start of the key, so gaps in ``order`` do not matter.
    Parts ascend from 0; where a row passes both limits a number is left out. ``size`` is a
    row's bytes, NULL counts 0.

    Where parts begin is found from key, order and size alone, and only for keys beyond a limit;
    the rows themselves look their part up and move once, when they are grouped.
    """
    narrow = df.select(
        F.col(key).alias("_pk"), F.col(order).cast("bigint").alias("_o"),
        F.coalesce(size.cast("bigint"), F.lit(0)).alias("_size"),
    )
    totals = narrow.groupBy("_pk").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_bytes"))
    beyond = (F.col("_n") > part_rows) | (F.col("_bytes") >= part_bytes)
    largest = totals.agg(F.max(F.when(beyond, F.col("_n")))).first()[0]
    if largest is None:
        return df.withColumn("part", F.lit(0).cast("bigint"))
    long = written(totals.where(beyond).select("_pk"), "long-keys")
    rows = narrow.where("_o is not null").join(long, "_pk", "left_semi")
    counted = running_sums(
        rows, {"_rows_so_far": F.lit(1), "_bytes_so_far": F.col("_size")}, "_pk", "_o", bits
    )
    part = F.floor(F.col("_rows_so_far") / part_rows) + F.floor(F.col("_bytes_so_far") / part_bytes)
    begins = counted.groupBy("_pk", part.cast("bigint").alias("p")).agg(F.min("_o").alias("o"))
    starts = written(
        begins.groupBy("_pk").agg(F.array_sort(F.collect_list(F.struct("o", "p"))).alias("_begins"))
        .select("_pk", F.transform("_begins", lambda b: b["o"]).alias("_starts"), F.transform("_begins", lambda b: b["p"]).alias("_parts")),
        "parts",
    )
    place = F.greatest(_found(F.col("_starts"), F.col(order).cast("bigint")) - 1, F.lit(0))
    found = F.when(F.col("_starts").isNull() | F.col(order).isNull(), 0).otherwise(F.get("_parts", place))
    return (
        df.join(starts, F.col(key) == F.col("_pk"), "left")
        .withColumn("part", found.cast("bigint"))
        .drop("_pk", "_starts", "_parts")
    )


def text_parts(
    df: DataFrame,
    piece: Column,
    separator: str,
    key: str = "conversation_id",
    order: str = "seq",
    bits: int = BLOCK_BITS,
    name: str = "text",
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Ordered concatenation per key, in parts bounded by rows and bytes (see ``with_part``).

    A key within both limits has exactly one part holding its whole text; a longer one has
    several, whose texts in ``part`` order, joined by the separator, are the whole text.
    """
    pieces = df.select(key, order, piece.alias("_piece"))
    return (
        with_part(pieces, F.octet_length("_piece"), key, order, bits, part_rows, part_bytes)
        .groupBy(key, "part")
        .agg(_ordered_concat(F.col("_piece"), order, separator).alias(name))
    )


def _ordered_concat(piece: Column, order: str, separator: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p"))))
    return F.array_join(F.transform(pairs, lambda e: e["p"]), separator)


def list_parts(
    df: DataFrame,
    columns: list[str],
    key: str = "conversation_id",
    order: str = "seq",
    bits: int = BLOCK_BITS,
    name: str = "entries",
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Ordered array per key, in parts bounded by rows and bytes (see ``text_parts``)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*columns).alias("e"))))
    size = F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in columns]))
    return (
        with_part(df.select(key, order, *columns), size, key, order, bits, part_rows, part_bytes)
        .groupBy(key, "part")
        .agg(F.transform(pairs, lambda p: p["e"]).alias(name))
    )
