"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import Scope, Stored


def components(edges: DataFrame, a: str = "a", b: str = "b", scope: Scope | None = None) -> DataFrame:
    """node, label: the least node that can be reached. Nodes are those with an edge; edges may repeat or be loops. The
    table of labels goes with the scope.

    Every round takes the least label among a node's neighbours and then follows the label's own label, so a chain halves
    its length. Labels and edges are tables in the shared folder, so a lost executor costs no more than one round, and
    both sides of each join are shuffled, so Spark splits the partition of a node with very many edges."""
    one, other = F.col(a).cast("long"), F.col(b).cast("long")
    sides = edges.where(one != other).select(F.array(F.struct(one.alias("u"), other.alias("v")), F.struct(other.alias("u"), one.alias("v"))).alias("e"))
    edges_of = Stored(sides.select(F.inline("e")).distinct(), "edges")
    both = edges_of.df
    labels = Stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        heard = both.join(labels.df.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("heard"))
        lower = Stored(labels.df.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "lower")
        further = lower.df.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = Stored(lower.df.join(further, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        lower.drop()
        labels.drop()
        changed = jumped.df.where("label <> old").limit(1).count()
        labels = jumped
        if not changed:
            edges_of.drop()
            if scope:
                scope.holds(labels.path)
            return labels.df.select("node", "label")
