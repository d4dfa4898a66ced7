"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm.shared import stored
from quittance.operators.spread import find_hot_keys, left_join


#: Links, or fingerprints, that a stored file holds about, and the files that there may be of fewer.
LINKS_A_FILE = 100_000
FEW_FILES = 8


def files_for(rows: int) -> int:
    """How many files a table of at most so many short rows asks for."""
    return max(FEW_FILES, -(-rows // LINKS_A_FILE))


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (a, b), each with what ``least`` says of its a; those of a hub are dealt over many tasks.

    Both sides hold every a, so the left join is a plain one.
    """
    return left_join(links, least, "a", "b", find_hot_keys(links, "a"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it instead."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them instead."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    others = _with_least(links, least).where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionAll(least.select("a", F.col("least").alias("b")))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame, purpose: str = "links", most: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); ``root`` is the least node reachable.

    Alternating stars: each round links nodes to smaller ones, which halves paths, until nothing
    changes. Links are never gathered: a round is a minimum per node, taken on every task first, and
    a join in which the links of a node that has a large part of them are dealt over as many tasks
    as they need. Its result is a stored table of no more files than its links ask for: each costs
    its executor a few processes, so many tiny ones cost more than the links. ``most`` is a number
    of links that there are about at most, where one is known beforehand.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = links.distinct()
    links = stored(links if most is None else links.coalesce(files_for(most)), purpose)
    mark = _mark(links)
    while True:
        # Neither star makes more than twice as many links, however many partitions they lie in.
        files = files_for(mark[0])
        larger = stored(_large_star(links).coalesce(files), purpose)
        links = stored(_small_star(larger).distinct().coalesce(files), purpose)
        before, mark = mark, _mark(links)
        if mark == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
