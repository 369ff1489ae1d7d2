"""Connected components of a link table, by star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has a link to another one, with the smallest node reachable from it.

    Rounds alternate two steps. Large star: every node tells its larger neighbours the smallest node it sees. Small
    star: every node tells its smaller neighbours the same. The links become one star around each root within a
    number of rounds that grows with the logarithm of the size. Neighbours are never gathered: the smallest one is an
    aggregate that is combined before the shuffle, and it meets the links in a join that can be split if a node has
    very many. Every round is a table in the shared folder. Links with a null end and links to itself do nothing.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u > v").distinct(),
        "links",
    )
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u > v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
