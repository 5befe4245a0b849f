"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import settle

#: Members from which on a component's id is sent to its rows, as long as so few components have them.
LARGE, MOST_LARGE_SENT = 500, 1_000_000


def with_least_id(rows: DataFrame, id_: str, large: int = LARGE) -> DataFrame:
    """`rows` (written, with `component`) with the smallest id of each row's component, `component_id`.

    The rows of a large component are not brought together for it: its one id is sent to them where
    they lie. There is at most one such component for each `large` rows, and they are counted first.
    """
    names = [c for c in rows.columns if c != "component"]
    least = settle(rows.groupBy("component").agg(F.min(id_).alias("component_id"), F.count(F.lit(1)).alias("members")))
    hot = least.where(F.col("members") >= large).select(F.col("component").alias("hot"), "component_id")
    if hot.count() > MOST_LARGE_SENT:
        return rows.join(least, "component").select(*names, "component_id")
    sent = rows.join(F.broadcast(hot), F.col("component") == F.col("hot"))
    rest = rows.join(F.broadcast(hot.select("hot")), F.col("component") == F.col("hot"), "left_anti")
    rest = rest.join(least.where(F.col("members") < large), "component")
    return sent.select(*names, "component_id").unionByName(rest.select(*names, "component_id"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest of them;
    rounds grow with the logarithm of the longest chain. Minima are taken before rows move, and each
    round is written, so its lineage is one table.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links = settle(links.where("a <> b").distinct())
    before = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = settle(small.union(least).distinct())
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
