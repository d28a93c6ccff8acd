"""Connected components by repeated least labels with pointer jumping."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder of ``spark.checkpoint.dir``; a local session may do with a folder of its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shardwright-ckpt-"))
    return df.checkpoint(eager=True)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component``: the least node reachable; ``nodes`` has ``node``, ``edges`` has ``u, v``."""
    both = checkpointed(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = checkpointed(nodes.select("node", F.col("node").alias("component")))
    for _ in range(max_rounds):
        around = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("_m"))
        least = labels.join(around, labels["node"] == around["u"], "left").select("node", F.col("component").alias("_was"), F.least("component", F.coalesce("_m", "component")).alias("component"))
        jump = least.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        after = checkpointed(least.join(jump, least["component"] == jump["_n"]).select("node", "_was", F.least("component", "_c").alias("component")))
        labels = after.select("node", "component")
        if after.where("_was != component").isEmpty():
            return labels
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
