"""Connected components by rounds of least labels with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import drop, written


def components(edges: DataFrame) -> DataFrame:
    """u, root for edges (u, v): every node's least reachable node. Each round's labels are a written table; the one before goes."""
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both-ways")
    label = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("root")), "labels")
    while True:
        near = both.join(label.toDF("v", "r"), "v").groupBy("u").agg(F.min("r").alias("m"))
        step = label.join(near, "u").select("u", "root", F.least("root", "m").alias("new"))
        far = step.select(F.col("u").alias("new"), F.col("new").alias("far"))
        jump = written(step.join(far, "new").select("u", "root", F.least("new", "far").alias("new")), "labels")
        drop(label)
        changed = bool(jump.filter("root <> new").take(1))
        label = written(jump.select("u", F.col("new").alias("root")), "labels")
        drop(jump)
        if not changed:
            drop(both)
            return label
