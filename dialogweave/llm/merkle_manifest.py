"""Merkle manifest of a dataset: rows as leaves, a tree per source, and a tree of the sources.

Nodes of one level are joined with their siblings by computed index (XOR in binary trees, slot
offsets otherwise); the node in slot zero then emits the parent. Each level is a table of its
own, a third as long as the one below (for three slots), and proofs are handed down the same
tables from the top, so all levels together move about one and a half times the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogweave.llm.common import shuffle_parts, written

_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as a leaf holds it: ``-`` for NULL, else its UTF-8 byte count, ``:``, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place (from 0) in its group by ``order``, and ``n``, the group's rows.

    NULL is a group like others. Rows are ranged over all partitions by (group, order), so a
    group of any size is spread; what is counted afterwards is one row per partition and group.
    Rows alike in all of ``order`` are placed in any order.
    """
    spark = rows.sparkSession
    keyed = written(rows.withColumn("_tie", F.monotonically_increasing_id()), "keyed")
    place = F.monotonically_increasing_id()
    ranged = written(
        keyed.repartitionByRange(max(shuffle_parts(spark), 1), group, *order, "_tie")
        .sortWithinPartitions(group, *order, "_tie").drop("_tie")
        .select("*", F.spark_partition_id().alias("_pid"), place.bitwiseAND((1 << 33) - 1).alias("_at")),
        "ranged",
    )
    runs = ranged.groupBy("_pid", F.col(group).alias("_g")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_g")
    earlier = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_pid").alias("_p"), "_g", F.sum("_rows").over(whole).alias("n"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    joined = ranged.join(runs, (F.col("_pid") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")


def _sibling(idx: Column, offset: int, fanout: int) -> Column:
    """Index of the node ``offset`` slots on, round the run."""
    if fanout == 2:
        return idx.bitwiseXOR(F.lit(1).cast("long"))
    slot = idx % fanout
    return idx - slot + (slot + offset) % fanout


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, n, digest, left, right): nodes with the joined digests of their run's others."""
    joined = nodes
    for offset in range(1, fanout):
        other = nodes.select("tree", F.col("idx").alias(f"_i{offset}"), F.col("digest").alias(f"_d{offset}"))
        joined = joined.withColumn(f"_i{offset}", _sibling(F.col("idx"), offset, fanout)).join(
            other, ["tree", f"_i{offset}"], "left"
        )
    others = [(F.col(f"_i{o}"), F.coalesce(F.col(f"_d{o}"), F.lit(""))) for o in range(1, fanout)]
    # Round the run from the node's slot: what lies right comes first, then what lies left.
    left = F.concat(F.lit(""), *[F.when(i < F.col("idx"), d).otherwise("") for i, d in others])
    right = F.concat(F.lit(""), *[F.when(i > F.col("idx"), d).otherwise("") for i, d in others])
    return joined.select("tree", "idx", "n", "digest", left.alias("left"), right.alias("right"))


def merkle_trees(leaves: DataFrame, fanout: int = 3) -> tuple[DataFrame, DataFrame]:
    """Roots (tree, root) and proofs (tree, idx, proof) of all trees over leaves(tree long, idx
    long, n long, digest string), ``idx`` being 0 to ``n`` - 1 in each tree.

    While a tree has several nodes on a level, every ``fanout`` consecutive ones (the last run:
    fewer, even one) become the digest of their joined digests. A lone leaf is its tree's root
    and has an empty proof. ``proof`` lists, from the leaf up, the digests left and right of the
    node in its run.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    levels, roots = [], [leaves.where("n = 1").select("tree", F.col("digest").alias("root"))]
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.where("n > 1").select("tree", "idx", "n", "digest")
    while most > 1:
        level = written(_level(nodes, fanout), "level")
        levels.append(level)
        most = -(-most // fanout)
        parents = level.where(F.col("idx") % fanout == 0).select(
            "tree", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"),
            digest(F.col("digest"), F.col("right")).alias("digest"),
        )
        roots.append(parents.where("n = 1").select("tree", F.col("digest").alias("root")))
        nodes = parents.where("n > 1")
    proofs, none = None, F.array().cast(_STEP)
    for level in reversed(levels):
        step = F.array(F.struct("left", "right")).cast(_STEP)
        above = F.floor(F.col("idx") / fanout)
        if proofs is None:
            proofs = level.select("tree", "idx", step.alias("proof"))
            continue
        parents = proofs.select("tree", F.col("idx").alias("_above"), F.col("proof").alias("_proof"))
        proofs = (
            level.withColumn("_above", above).join(parents, ["tree", "_above"], "left")
            .select("tree", "idx", F.concat(step, F.coalesce("_proof", none)).alias("proof"))
        )
    lone = leaves.where("n = 1").select("tree", "idx", none.alias("proof"))
    all_roots = roots[0]
    for more in roots[1:]:
        all_roots = all_roots.union(more)
    return all_roots, lone if proofs is None else proofs.union(lone)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right; of nothing if there are none."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def leaf_digest(rows: DataFrame, fields: list[str], changed: dict[str, Column] | None = None) -> Column:
    """A row's leaf: H of the named fields in order, some of them as changed."""
    changed = changed or {}
    return digest(*[field(changed.get(f, F.col(f))) for f in fields])


def manifest(
    rows: DataFrame,
    fields: list[str],
    id_col: str = "doc_id",
    source_col: str = "source",
    fanout: int = 3,
    suspect: Column | None = None,
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, proof, presented) of every row.

    Leaves of one source ascend by id (NULL first; rows with equal ids by their leaf, equal rows
    in any order) and form a tree whose root is the source's subroot; the subroots, by source
    (NULL first, by UTF-8 bytes), form the tree of the root. ``proof`` runs from the leaf through
    the subroot to the root. ``presented`` is the leaf as a receiver gets it: where ``suspect``,
    with the fields of ``altered`` in place of the row's own; elsewhere the leaf itself.

    Texts may be NULL, empty or of any length; they are read once, to be hashed. An empty table
    has no rows. Only the named columns are read; others do not matter, whatever their names.
    """
    presented = leaf_digest(rows, fields, altered) if altered else leaf_digest(rows, fields)
    own = leaf_digest(rows, fields)
    if suspect is not None:
        presented = F.when(suspect, presented).otherwise(own)
    hashed = rows.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), own.alias("leaf"), presented.alias("presented")
    )
    placed = numbered(hashed, "_source", ["_id", "leaf"])
    sources = placed.groupBy("_source").agg(F.max("n").alias("_n")).withColumn("_all", F.lit(0))
    sources = written(
        numbered(sources, "_all", ["_source"])
        .select(F.col("_source").alias("_name"), F.col("idx").alias("tree"), F.col("n").alias("n_sources")),
        "sources",
    )
    leaves = written(
        placed.join(sources, F.col("_source").eqNullSafe(F.col("_name")))
        .select("_id", "leaf", "presented", "tree", "idx", "n"),
        "leaves",
    )
    subroots, proofs = merkle_trees(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")), fanout)
    subroots = written(subroots.select("tree", F.col("root").alias("subroot")), "subroots")
    tops = subroots.join(sources, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("n_sources").alias("n"),
        F.col("subroot").alias("digest"),
    )
    root, upper = merkle_trees(tops, fanout)
    upper = upper.join(root, "tree").select(F.col("idx").alias("tree"), F.col("proof").alias("_upper"), "root")
    above = written(subroots.join(upper, "tree"), "above")
    return (
        leaves.join(proofs, ["tree", "idx"]).join(above, "tree")
        .select(
            F.col("_id").alias(id_col), "leaf", "subroot", "root",
            F.concat("proof", "_upper").alias("proof"), "presented",
        )
    )


def verified_manifest(rows: DataFrame, fields: list[str], suspect: Column, altered: dict[str, Column], **names) -> DataFrame:
    """The manifest with each row's proof digest, and whether the leaf as presented leads to the root."""
    id_col = names.get("id_col", "doc_id")
    made = manifest(rows, fields, suspect=suspect, altered=altered, **names)
    back = made.withColumn("folded_root", folded(F.col("presented"), F.col("proof")))
    return back.select(
        id_col, "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
