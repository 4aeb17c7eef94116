"""Connected components of a table of links, by alternating star operations.

Each round hangs every node's larger neighbours on the least node around it (large star) and then
every node on its least neighbour (small star); the links end as stars around the least
node of each component, in a number of rounds that grows with the logarithm of the longest path.
Every round is two aggregations with map-side minima and two equi-joins, which Spark splits when a
node has very many links; rounds are cut by reliable checkpoints. Links never leave the cluster.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale


def _hang(links: DataFrame) -> DataFrame:
    """links (u, v): every v of u with the least node among u and its v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(links: DataFrame, a="a", b="b", most_rounds=64) -> DataFrame:
    """node, root: for every node that has a link to another node, the least node of its component."""
    pairs = links.select(F.least(a, b).alias("m"), F.greatest(a, b).alias("v")).where("m is not null and v is not null and m < v").distinct()
    pairs, before = scale.pin(pairs), None
    for _ in range(most_rounds):
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("m", "v").cast("decimal(20,0)")).cast("decimal(38,0)")).first()
        if state == before or state[0] == 0:
            return pairs.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(pairs.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
        before = state
        both = pairs.select(F.col("m").alias("u"), "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = _hang(both).where("v > u").select("v", "m").distinct()
        down = large.where("m < v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = _hang(down)
        small = hung.select("v", "m").unionByName(hung.select(F.col("u").alias("v"), "m")).where("m < v").distinct()
        pairs = scale.pin(small)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
