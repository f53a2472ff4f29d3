"""Connected components of a graph given by its edges, in about log(n) rounds of joins.

Each vertex points to a label, at first its smallest neighbour. In a round every vertex offers the smallest label
among its neighbours to itself and to the vertex that it points to, and then points to its label's label. The
tables of a round are written to the checkpoint folder and those of the round before are dropped.

Vertices with very many neighbours are no burden: offers are minima, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import drop_written, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) of all vertices of ``edges`` (a, b), bigint; label is the smallest vertex of the component."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both, edge_path = written(both)
    labels, path = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        pointed = labels.join(near, "v").select(F.col("label").alias("v"), "near")
        offers = near.union(pointed).groupBy("v").agg(F.min("near").alias("offer"))
        step = labels.join(offers, "v").select("v", F.col("label").alias("old"), F.least("label", "offer").alias("m"))
        further = labels.select(F.col("v").alias("m"), F.col("label").alias("further"))
        new, new_path = written(step.join(further, "m").select("v", "old", F.least("m", "further").alias("label")))
        moved = new.where("old <> label").limit(1).count()
        drop_written(spark, path)
        labels, path = new.select("v", "label"), new_path
        if not moved:
            drop_written(spark, edge_path)
            return labels
