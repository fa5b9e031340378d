"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, released, stored


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, about one for each b: its least a, and a chain through all a of each b.

    The sets of a are made per b, so a b must have few a; an a may have any number of b. Equal sets give one chain.
    """
    sets = edges.where("a <> b").groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("s"))
    stars = sets.select(F.get("s", F.lit(0)).alias("a"), "b")
    pairs = F.transform(F.slice("s", F.lit(2), F.size("s") - 1), lambda x, i: F.struct(F.get("s", i).alias("a"), x.alias("b")))
    chains = sets.where(F.size("s") > 1).select("s").distinct().select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct()
    return stars.unionByName(chains)


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id that an edge (a, b) names.

    Each round every id takes the least grandparent among its neighbours, its parent is hooked to it, and paths are
    halved; the number of rounds is about the logarithm of the longest path. All sums over neighbours combine
    before the shuffle, and the rows of a hub or of a large component are spread in the joins. A round's table goes when
    the next one is written.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b")
    both_at = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    both = spark.read.schema("a long, b long").parquet(both_at)
    hubs = hot_keys(both, "b")
    parents_at = stored(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("p"), F.lit(True).alias("moved")), "parents")
    while True:
        parents = spark.read.schema("id long, p long, moved boolean").parquet(parents_at)
        if not parents.where("moved").limit(1).count():
            released(spark, both_at)
            return parents.select("id", F.col("p").alias("component"))
        parents = parents.drop("moved")
        grand = join_hot(parents, parents.select(F.col("id").alias("p"), F.col("p").alias("g")), "p", "id").select("id", "p", "g")
        near = join_hot(both, grand.select(F.col("id").alias("b"), "g"), "b", "a", hubs).groupBy("a").agg(F.min("g").alias("m"))
        seen = grand.join(near.withColumnRenamed("a", "id"), "id")
        offers = seen.select(F.col("p").alias("id"), "m").unionByName(seen.select("id", F.least("m", "g").alias("m")))
        best = offers.groupBy("id").agg(F.min("m").alias("m"))
        now = parents.join(best, "id").select("id", F.least("p", "m").alias("p"), (F.col("m") < F.col("p")).alias("moved"))
        before, parents_at = parents_at, stored(now, "parents")
        released(spark, before)


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components ``labels`` (id, component) joined further by ``edges`` between components."""
    further = components(edges).select(F.col("id").alias("component"), F.col("component").alias("over"))
    return labels.join(further, "component", "left").select("id", F.coalesce("over", "component").alias("component"))
