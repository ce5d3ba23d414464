"""Connected components of a graph of any size, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.session import stage


def connected(edges: DataFrame) -> DataFrame:
    """`node` and `root` (the least node of its component) of every node of `edges` (`u`, `v`: long) but the roots.

    Each round hooks every node onto its least neighbour, if that is lower, follows these chains to their ends, and goes on
    with the edges between different ends only, which are few after the first round.  Minima are combined before the
    shuffle; no node's neighbours are gathered.  Rounds are written to the shared folder; `edges` are read twice."""
    ordered = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    links, roots = ordered(edges), None
    while True:
        hooked = stage(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
        if roots is not None and not hooked.limit(1).count():
            return roots
        while True:
            up = hooked.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            higher = hooked.join(up.hint("merge"), "root", "left")
            higher = stage(higher.select("node", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved")))
            hooked = higher.drop("moved")
            if not higher.where("moved").limit(1).count():
                break
        end = lambda df, of: df.join(
            hooked.select(F.col("node").alias(of), F.col("root").alias("end")).hint("merge"), of, "left"  # noqa: B023
        ).withColumn(of, F.coalesce("end", of)).drop("end")
        links = stage(ordered(end(end(links, "u"), "v")).distinct())
        roots = hooked if roots is None else stage(end(roots, "root").select("node", "root").union(hooked.select("node", "root")))
