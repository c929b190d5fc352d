"""Connected components of a table of links, as a loop of DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import save


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id that it reaches.

    In turn, every root hooks onto the smallest root next to it, and labels jump to their labels' labels, until
    nothing changes. Each turn writes its labels; rows never gather by component.
    """
    both = save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "components-links")
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "components")
    while True:
        # labels of neighbours reach both the id and the root that it has so far
        beside = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("least"))
        seen = labels.join(beside, "id").select("id", "component", F.least("component", "least").alias("least"))
        hooked = seen.groupBy("component").agg(F.min("least").alias("root"))
        step = seen.join(hooked, "component").select("id", F.col("component").alias("was"), F.least("least", "root").alias("component"))
        step = save(step, "components-hooked")
        up = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        jumped = save(step.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("top", "component")).alias("component")), "components")
        labels = jumped.select("id", "component")
        if not jumped.filter("component <> was").limit(1).count():
            return labels
