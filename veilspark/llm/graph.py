"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch

MOST_ROUNDS = 60


def components(edges: DataFrame, work: Scratch, name: str, files: int = 1) -> DataFrame:
    """edges(a, b) -> (node, label) for every node of an edge; label is the least node reachable.

    Each round turns the edges into stars around smaller nodes: nodes above u move to the least neighbour of u (large
    star), then nodes below u do (small star). Only minima are gathered, never a list of neighbours, so a hub is
    folded on the map side; each round is written in `files` files. An empty edge table gives an empty result; null ends are left out.
    """
    edges = work.put(edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().coalesce(files), f"{name}-0")
    sign = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    for i in range(1, MOST_ROUNDS):
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo != hi").distinct()
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
        edges = work.put(small.where("lo != hi").distinct().coalesce(files), f"{name}-{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("connected components didn't settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
