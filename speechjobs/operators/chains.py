"""Chains of links in many groups at once, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir


def reached(links: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at: the places that are reached from starts (keys, at) along links (keys, at, to), one link a place at most.

    After k rounds the links are 2^k long and the first 2^k places of a chain are found, so a group may be of any size, in
    any number of tasks; chains end, as links lead forward.
    """
    ensure_checkpoint_dir(links.sparkSession)
    jump, found = links.select(*keys, "at", "to").checkpoint(), starts.select(*keys, "at").checkpoint()
    while not jump.isEmpty():
        found = found.unionByName(found.join(jump, [*keys, "at"]).select(*keys, F.col("to").alias("at"))).distinct().checkpoint()
        second = jump.select(*keys, F.col("at").alias("_via"), "to")
        jump = jump.select(*keys, "at", F.col("to").alias("_via")).join(second, [*keys, "_via"]).select(*keys, "at", "to").checkpoint()
    return found
