"""Connected components of a link table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.store import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node in links (a, b): label is the least node of its component.

    Labels pass along links and jump to the label's label, so rounds grow with the logarithm of a component's diameter. Each round is
    a table in the shared folder; only the number of changes reaches the driver."""
    ways = links.select("a", "b").where("a <> b").distinct()
    ways = written(ways.union(ways.select("b", "a")).select(F.col("a").alias("src"), F.col("b").alias("dst")), "ways")
    labels = written(ways.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    for _ in range(most_rounds):
        heard = ways.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy("dst").agg(F.min("label").alias("heard"))
        met = labels.join(heard, F.col("node") == F.col("dst")).select("node", "label", F.least("label", "heard").alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = written(met.join(far, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
