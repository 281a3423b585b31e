"""Merkle manifest of a dataset: a leaf a row, a tree a source, a tree over the sources, and a proof for every leaf.

Leaves of a group are numbered by a range sort, cut into aligned blocks of ``FANOUT ** LEVELS`` leaves, and each block
builds its own subtree. The blocks then go through a butterfly exchange: in round r the (at most three) blocks whose
numbers differ in digit r alone, base three, swap the roots of the subtrees that they stand for, and each hashes the common
ancestor for itself. After the last round every block has the root and the upper part of its leaves' proofs; nothing
travels down again. Rounds move a row a block, so their number and size are the logarithm and a 729th of the leaves.

All of it is DataFrame functions: no driver loop over rows, no broadcast, no task with a whole source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scope

FANOUT = 3
#: Levels that a block builds alone: it holds at most FANOUT ** LEVELS leaves.
LEVELS = 6

_STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A value as it is hashed: `-` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def group_key(source: Column) -> Column:
    """Orders null before the empty string before all others, bytewise, and is itself never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _run(level: Column, i: Column, fanout: int) -> Column:
    return F.slice(level, i * fanout + 1, F.lit(fanout))


def _raised(level: Column, fanout: int) -> Column:
    """The next level of an array of digests: every ``fanout`` in a row become one; the last run may be shorter."""
    runs = F.floor((F.size(level) + (fanout - 1)) / fanout).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.concat_ws("", _run(level, i, fanout)), 256))


def _levels(leaves: Column, height: Column, fanout: int) -> Column:
    """The arrays of all levels of a block, from its leaves to ``height`` levels above."""
    def grow(levels: Column, _: Column) -> Column:
        return F.concat(levels, F.array(_raised(F.element_at(levels, -1), fanout)))

    # a sequence can't be empty
    return F.when(height > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(height, F.lit(1))), F.array(leaves), grow)).otherwise(F.array(leaves))


def _siblings(levels: Column, at: Column, height: Column, fanout: int) -> Column:
    """What stands left and right of a leaf's ancestor in its run, level by level."""
    def step(j: Column) -> Column:
        level = F.element_at(levels, j + 1)
        node = F.floor(at / F.pow(F.lit(float(fanout)), j)).cast("int")
        digit = node % fanout
        left, right = F.slice(level, node - digit + 1, digit), F.slice(level, node + 2, fanout - 1 - digit)
        return F.struct(F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right"))

    return F.when(height > 0, F.transform(F.sequence(F.lit(0), F.greatest(height, F.lit(1)) - 1), step)).otherwise(F.array().cast(f"array<{_STEP}>"))


def numbered(scope: Scope, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with `_at`, their place from 0 in their group by ``order``, and `_size`, the group's size.

    Rows are range-sorted over all groups; places are counted within a range and group, to which the sizes of the group's
    earlier ranges are added. A group of a third of all rows is spread like any other."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id())
    dealt = scope.store(dealt, "merkle-ranges")  # the ranges come from samples: fix them
    held = dealt.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_held"))
    every = Window.partitionBy(group)
    before = held.select(
        "_range", group, F.sum("_held").over(every).alias("_size"),
        F.coalesce(F.sum("_held").over(every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    place = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(before, ["_range", group]).withColumn("_at", F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def _exchange(blocks: DataFrame, rounds: int, fanout: int) -> DataFrame:
    """The butterfly: (_group, _block, _blocks, _node) to the same rows with `_upper`, the proof above each block, and
    `_node` now the group's root.

    In the last, incomplete subtree of a level some blocks are missing whose partners still have to hear of it; the blocks
    that are there speak for them, evenly."""
    state = blocks.withColumn("_upper", F.array().cast(f"array<{_STEP}>"))
    for r in range(rounds):
        span = fanout**r
        active = F.col("_blocks") > span
        digit = F.floor(F.col("_block") / span) % fanout
        offset = F.col("_block") % span
        # blocks in this subtree: span, but for the last one
        there = F.least(F.lit(span), F.col("_blocks") - (F.col("_block") - offset))
        heard = state.select("*", F.floor(F.col("_block") / (span * fanout)).alias("_parent"), digit.alias("_digit"),
                             F.explode(F.when(active & (there < span), F.sequence(offset, F.lit(span - 1).cast("long"), there)).otherwise(F.array(offset))).alias("_offset"))
        swap = Window.partitionBy("_group", "_parent", "_offset")
        heard = heard.withColumn("_swapped", F.sort_array(F.collect_list(F.struct("_digit", "_node")).over(swap))).filter(F.col("_offset") == offset)

        def beside(smaller: bool) -> Column:
            mates = F.filter("_swapped", lambda x: (x["_digit"] < F.col("_digit")) if smaller else (x["_digit"] > F.col("_digit")))
            return F.concat_ws("", F.transform(mates, lambda x: x["_node"]))

        step = F.struct(beside(True).alias("left"), beside(False).alias("right"))
        parent = F.sha2(F.concat_ws("", F.transform("_swapped", lambda x: x["_node"])), 256)
        state = heard.select(
            "_group", "_block", "_blocks",
            F.when(active, parent).otherwise(F.col("_node")).alias("_node"),
            F.when(active, F.concat("_upper", F.array(step))).otherwise(F.col("_upper")).alias("_upper"),
        )
    return state


def trees(scope: Scope, rows: DataFrame, group: str, order: list[str], digest: str, keep: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """A tree for each group over the digests of its rows in order.

    Returns the blocks (`_group`, `_block`, `_leaves`: structs of ``keep``, the digest as `_digest` and its `_proof` inside
    the block) and the uppers (`_group`, `_block`, `_node`: the group's root, `_upper`: the proof above the block)."""
    size = fanout**levels
    at = numbered(scope, rows.select(F.col(group).alias("_group"), *[c for c in dict.fromkeys([*order, *keep]) if c != group], F.col(digest).alias("_digest")), "_group", order)
    blocks = at.groupBy("_group", F.floor(F.col("_at") / size).alias("_block"), "_size").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_digest", *keep))).alias("_rows"))
    # a block of a larger group always builds all its levels; a group within a block stops at its root
    needed = F.when(F.col("_size") > size, F.lit(levels)).otherwise(sum((F.col("_size") > fanout**j).cast("int") for j in range(levels)))
    blocks = blocks.withColumn("_height", needed).withColumn("_levels", _levels(F.col("_rows._digest"), F.col("_height"), fanout))
    leaves = F.transform("_rows", lambda x, i: F.struct(*[x[c].alias(c) for c in ("_digest", *keep)], _siblings(F.col("_levels"), i, F.col("_height"), fanout).alias("_proof")))
    blocks = scope.store(
        blocks.select("_group", "_block", F.ceil(F.col("_size") / size).alias("_blocks"), F.element_at(F.element_at("_levels", -1), 1).alias("_node"), leaves.alias("_leaves")),
        "merkle-blocks",
    )
    most = blocks.agg(F.max("_blocks")).first()[0] or 1
    rounds = next(r for r in range(64) if fanout**r >= most)
    tops = blocks.select("_group", "_block", "_blocks", "_node")
    single = tops.filter("_blocks = 1").withColumn("_upper", F.array().cast(f"array<{_STEP}>"))
    upper = single.unionByName(_exchange(tops.filter("_blocks > 1"), rounds, fanout)) if rounds else single
    return blocks.select("_group", "_block", "_leaves"), scope.store(upper.select("_group", "_block", "_node", "_upper"), "merkle-uppers")


def fold(start: Column, proof: Column) -> Column:
    """The root that a digest leads to beside the siblings of its proof."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(proof, lambda step: F.concat(step["left"], step["right"]))), 256)


def manifest(docs: DataFrame, leaf_columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), source: str = "source", order: str = "doc_id", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Every row's leaf, `subroot` (its source's), `root` and `proof`: structs of the digests left and right of its
    ancestor, level by level up to the root.

    ``keep``: named columns to carry along (a second digest, for instance). Texts are hashed where they are read; only
    digests and ids move. Null columns are hashed as `-`; the null source is a group of its own and comes first; rows of one
    ``order`` value, null among them and first, stand in the order of their leaves, so repeated rows, which have equal
    leaves, give the same rows whichever comes first. An empty table gives no rows. Other columns are not looked at."""
    names = [docs.select(c).columns[0] for c in keep]
    with Scope(docs.sparkSession) as scope:
        # names of the caller's go behind aliases at once, so that none can meet those used below
        rows = docs.select(F.col(order).alias("_order"), group_key(F.col(source)).alias("_key"), leaf(*map(F.col, leaf_columns)).alias("_own_leaf"),
                           *[c.alias(f"_keep{k}") for k, c in enumerate(keep)])
        rows = scope.store(rows, "merkle-leaves")  # the range sort reads its rows twice; not the texts
        kept = ["_order", *[f"_keep{k}" for k in range(len(keep))]]
        blocks, uppers = trees(scope, rows, "_key", ["_order", "_own_leaf"], "_own_leaf", kept)
        subroots = uppers.filter("_block = 0").select(F.lit(0).alias("_all"), F.col("_group").alias("_name"), F.col("_node").alias("_subroot"))
        top_blocks, top_uppers = trees(scope, subroots, "_all", ["_name"], "_subroot", ["_name"])
        tops = top_blocks.join(top_uppers, ["_group", "_block"]).select("_node", "_upper", F.explode("_leaves").alias("_leaf"))
        tops = tops.select(F.col("_leaf._name").alias("_group"), F.col("_node").alias("_root"), F.concat("_leaf._proof", "_upper").alias("_top"))
        # the few rows a block meet their source's part of the proof before the blocks' many leaves do
        above = uppers.join(tops, "_group").select("_group", "_block", F.col("_node").alias("_subroot"), "_root", F.concat("_upper", "_top").alias("_above"))
        rows = blocks.join(above, ["_group", "_block"]).select("_subroot", "_root", "_above", F.explode("_leaves").alias("_leaf"))
        out = rows.select(
            F.col("_leaf._order").alias(order), F.col("_leaf._digest").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
            F.concat("_leaf._proof", "_above").alias("proof"), *[F.col(f"_leaf._keep{k}").alias(n) for k, n in enumerate(names)],
        )
        return scope.result(out, "merkle-proofs")


def verify(proofs: DataFrame, seen: str) -> DataFrame:
    """`folded_root`, the root that the digest in column ``seen`` leads to, and `verified`: whether it is the root."""
    return proofs.withColumn("folded_root", fold(F.col(seen), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, and whether each one still verifies after tampering: where the crc32 of the decimal doc_id
    is even, line breaks go from the text. A null doc_id isn't tampered with."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    seen = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text).alias("seen")
    out = verify(manifest(docs, keep=(seen,)), "seen")
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")
