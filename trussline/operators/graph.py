"""Connected components of undirected links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.operators.common import cut, hot_values, salted_join


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): each node with the least id of its component.

    ``nodes``: id, without nulls, repeated ids count once. ``links``: a, b; links to a node
    that is not in ``nodes``, and null ends, are ignored. Every round each node takes the least
    label among its own and its neighbours', and then the label of its label, so that the reach
    at least doubles along chains of labels. The rounds end when no label moves.
    """
    state = cut(nodes.select("id").where(F.col("id").isNotNull()).distinct().withColumn("comp", F.col("id")))
    known = state.select("id")
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).where("id <> other").distinct()
    both = cut(both.join(known, "id", "left_semi").join(known.select(F.col("id").alias("other")), "other", "left_semi"))
    hot = hot_values(both, ["other"])["other"]
    while True:
        near = salted_join(both, state.withColumnRenamed("id", "other"), ["other"], F.col("other").isin(hot) if hot else F.lit(False), F.col("id"), "inner").groupBy("id").agg(F.min("comp").alias("near"))
        lower = state.join(near, "id", "left").select("id", F.least("comp", "near").alias("low"), "comp")
        label = state.select(F.col("id").alias("low"), F.col("comp").alias("further"))
        often = hot_values(state, ["comp"])["comp"]
        moved = cut(salted_join(lower, label, ["low"], F.col("low").isin(often) if often else F.lit(False), F.col("id")).select("id", F.least("low", "further").alias("comp"), (F.least("low", "further") < F.col("comp")).alias("moved")))
        state = moved.select("id", "comp")
        if moved.where("moved").isEmpty():
            return state
