"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two grouped minima with map-side combining plus an equi-join that
adaptive execution can split, so a vertex with very many links is no bottleneck.
Edges are rewritten to the shared folder each round and the round before is
deleted. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ionlake.llm.shared import Stage


def components(links: DataFrame, stage: Stage | None = None) -> DataFrame:
    """(vertex, component) for every end of a link (a long, b long); component is the smallest reachable.

    Null ends and self links are ignored; repeated links and either direction are fine.
    """
    spark = links.sparkSession
    stage = stage or Stage(spark, "components")
    clean = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = stage.keep(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    state = None
    turn = 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        seen = Observation()
        small = small.filter("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        edges = stage.keep(small, f"edges{turn}")
        stage.drop(f"edges{turn - 1}")
        if seen.get == state:
            break
        state = seen.get
    stars = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()
