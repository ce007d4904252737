"""Key ranges reached in hops, for chunks that ask for something about each of their keys.

With C chunks and R ranges, a row for each chunk and range would be C x R rows. Here a row goes to one of ``fan`` wide
ranges; there the rows of some ``fan`` chunks are merged into one that asks once for each key, and it is split over
``fan`` narrower ranges, until a range is narrow enough to be answered by one task. After each hop the ranges are
``fan`` times as many and the groups of chunks as many times fewer, so every hop has as many groups as there are
ranges in the end, each of about a chunk's size, and sends ``fan`` rows from each: R x fan x hops rows, and hops is
the logarithm of R. Answers go back the same way: each group keeps where its senders' keys stand among its own.

One hop is a plain exchange of chunks and ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Most rows that a chunk or a group of chunks sends in one hop.
FAN = 512


class Route:
    """At least ``ranges`` key ranges in as few hops as ``most`` rows for each sender and hop allow."""

    def __init__(self, ranges: int, most: int | None = None):
        most, self.hops = most or FAN, 1
        while most**self.hops < ranges:
            self.hops += 1
        self.fan = 1
        while self.fan**self.hops < ranges:
            self.fan += 1

    def ranges(self, hop: int) -> int:
        return self.fan**hop

    def groups(self, hop: int) -> int:
        """Groups of chunks that meet apart in each range of a hop; one in the last."""
        return self.fan ** (self.hops - hop)

    def sender(self, hop: int, bucket: int, group: int) -> int:
        """The number under which a group of a hop asks in the next one."""
        return bucket * self.groups(hop) + group


def exchange(asks: DataFrame, route: Route, name: str, relayed: Callable, schema: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """The rows that reach the last hop, and what the groups of each hop before keep for the way back (:func:`returned`).

    ``asks``: rows with ``bucket`` (the range of the first hop) and ``chunk`` (who asks); ``by``: columns that keep
    exchanges of one table apart. ``relayed(hop)`` merges the rows of one group; it returns rows of ``schema`` with
    bucket, grp and chunk for the next hop, and one row whose ``kids`` names its senders.
    """
    kept = []
    if route.hops > 1:
        asks = asks.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(route.groups(1))).cast("int"))
    for hop in range(1, route.hops):
        sent = materialise(asks.groupBy(*by, "bucket", "grp").applyInPandas(relayed(hop), schema), f"{name}-hop{hop}", drop_shuffles=True)
        kept.append(sent.where("kids IS NOT NULL"))
        asks = sent.where("kids IS NULL")
    return asks, kept


def returned(told: DataFrame, kept: list[DataFrame], give: Callable, schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Answers of the last hop taken back to the chunks; ``give(hop)`` turns a group's answers into its senders'."""
    for hop in range(len(kept), 0, -1):
        told = kept[hop - 1].groupBy(*by, "chunk").cogroup(told.groupBy(*by, "chunk")).applyInPandas(give(hop), schema)
    return told
