"""Shards by balanced label propagation: linked documents move together, sizes stay equal.

Documents with the same link value (by default the same text) are neighbours. Each starts in some
shard, sizes at most one row apart. Round by round, documents ask to move to the shards where most
of their neighbours are; a move is granted against a move the other way or against a document
without neighbours, so the sizes never change; when nobody can move any more, it ends.

Documents of a group that are in the same shard have the same neighbours, so they are counted, not
listed: a *cell* is (group, shard, documents). A group has no more cells than there are shards,
however many documents it has, and a round moves cells or parts of cells. Only at the end do rows
take the places that the cells hold.

Everything here is DataFrame operations. Sums in order run in two steps, buckets first, so that no
task sees more than a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quittance.llm.shared import numbered, stored

#: Buckets of the running sums over cells.
BUCKETS = 256
#: Rows that one task lays out together at the end.
STRETCH = 1024


def _running(df: DataFrame, keys: list[str], bucket: Column, order: str, amount: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over all earlier rows of the same ``keys``.

    Earlier is by bucket, then by ``order``. The sums of whole buckets meet first, at most
    one row per bucket and key; rows are only ordered within their bucket.
    """
    df = df.withColumn("_bucket", bucket)
    earlier = Window.unboundedPreceding, -1
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*earlier)
    whole = df.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_all"))
    whole = whole.withColumn("_before", F.coalesce(F.sum("_all").over(over), F.lit(0))).drop("_all")
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(*earlier)
    return (
        df.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(whole, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_bucket", "_before", "_within")
    )


def _requests(cells: DataFrame, spare: DataFrame, room: int) -> DataFrame:
    """(grp, shard, target, n): the cells that want to move to a cell with more neighbours.

    A group leads in as many shards as its documents fill, where it is largest, open shards first;
    its other cells ask for one of these in turn. A shard is open while it holds a document without
    neighbours, which can make way; into another, documents can only be swapped. Every move goes to
    a cell no smaller than the one it leaves, so links kept whole only grow and the rounds end.
    """
    rank = Window.partitionBy("grp").orderBy(F.desc("open"), F.desc("n"), F.xxhash64("grp", "shard"))
    group = Window.partitionBy("grp")
    ranked = (
        cells.join(F.broadcast(spare.select("shard", (F.col("spare") > 0).alias("open"))), "shard")
        .withColumn("place", F.row_number().over(rank) - 1)
        .withColumn("leads", F.ceil(F.sum("n").over(group) / room).cast("int"))
        .withColumn("lead", F.col("place") < F.col("leads"))
    )
    leaders = F.sort_array(F.collect_list(F.when(F.col("lead"), F.struct("place", "shard", "n"))).over(group))
    nth = F.element_at("leaders", F.pmod(F.col("place"), F.size("leaders")).cast("int") + 1)
    return (
        ranked.withColumn("leaders", leaders)
        .where(~F.col("lead"))
        .withColumn("to", nth)
        .where((F.col("n") < F.col("to.n")) | (F.col("n") == F.col("to.n")) & (F.col("place") > F.col("to.place")))
        .select("grp", "shard", F.col("to.shard").alias("target"), "n")
    )


def _granted(requests: DataFrame, spare: DataFrame) -> DataFrame:
    """(grp, shard, target, moved): what of the requests is granted, sizes staying as they are."""
    asked = requests.groupBy("shard", "target").agg(F.sum("n").alias("asked"))
    back = asked.select(
        F.col("target").alias("shard"), F.col("shard").alias("target"), F.col("asked").alias("back")
    )
    over = Window.partitionBy("target").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("asked") - F.col("swapped")
    quotas = (
        asked.join(back, ["shard", "target"], "left")
        .withColumn("swapped", F.least("asked", F.coalesce("back", F.lit(0))))
        .withColumn("rest_before", F.coalesce(F.sum(rest).over(over), F.lit(0)))
        .join(spare.withColumnRenamed("shard", "target"), "target")
        .withColumn(
            "quota",
            F.col("swapped") + F.greatest(F.lit(0), F.least(rest, F.col("spare") - F.col("rest_before"))),
        )
        .select("shard", "target", "quota")
    )
    bucket = F.pmod(F.xxhash64("grp"), F.lit(BUCKETS))
    queue = _running(requests, ["shard", "target"], bucket, "grp", "n", "before")
    return (
        queue.join(F.broadcast(quotas), ["shard", "target"])  # a row per pair of shards at most
        .withColumn("moved", F.least("n", F.col("quota") - F.col("before")))
        .where("moved > 0")
        .select("grp", "shard", "target", "moved")
    )


def _propagate(cells: DataFrame, sizes: DataFrame, room: int, rounds: int) -> DataFrame:
    """The cells after all rounds; ``sizes`` (shard, size) hold throughout."""
    for _ in range(rounds):
        held = cells.groupBy("shard").agg(F.sum("n").alias("held"))
        spare = sizes.join(held, "shard", "left").select(
            "shard", (F.col("size") - F.coalesce("held", F.lit(0))).alias("spare")
        )
        moves = stored(_granted(_requests(cells, spare, room), spare), "shard-moves")
        if moves.isEmpty():
            break
        changed = cells.unionByName(moves.select("grp", "shard", (-F.col("moved")).alias("n")))
        changed = changed.unionByName(moves.select("grp", F.col("target").alias("shard"), F.col("moved").alias("n")))
        cells = stored(changed.groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "shard-cells")
    return cells


def shards(
    docs: DataFrame,
    n_shards: int = 40,
    rounds: int = 8,
    link: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    Law ``rows``: the shards' row counts are at most one apart. Slots of a shard run from 0
    without a gap. ``size`` is the text's bytes plus 16. ``link`` says which rows are neighbours,
    those with an equal value; a missing value counts as empty. With the text as the link, missing
    and empty texts are neighbours. Missing and repeated ids are rows like any others; no rows give
    no rows. Other columns are never read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    linked_by = F.coalesce(link.cast("string"), F.lit("")) if link is not None else text
    rows = stored(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.unhex(F.sha2(linked_by.cast("binary"), 256)).alias("digest"),
        ),
        "shard-rows",
    )
    # Groups are runs of positions; where a run starts names its group from here on.
    rows = numbered(rows, "digest", "id", "crc", purpose="shard-positions")
    groups = stored(
        rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("grp")).drop("digest"),
        "shard-groups",
    )
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = F.pmod(F.col("grp") + F.col("j"), F.lit(n_shards)).cast("int")
    cells = stored(
        groups.where("n > 1")
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(n_shards)).cast("int") - 1)))
        .select("grp", at.alias("shard"), (F.floor((F.col("n") - F.col("j") - 1) / n_shards) + 1).alias("n")),
        "shard-cells",
    )
    of_shard = F.floor((F.lit(total) + n_shards - 1 - F.col("id")) / n_shards)
    sizes = docs.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"), of_shard.alias("size"))
    cells = _propagate(cells, sizes, max(1, total // n_shards), rounds)

    # Linked documents take the first slots of a shard, cell by cell, the others those that are left.
    earlier = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("first", F.col("grp") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    bucket = F.pmod(F.xxhash64("grp"), F.lit(BUCKETS))
    placed = _running(placed, ["shard"], bucket, "grp", "n", "slot").select("first", "n", "shard", "slot")
    held = {r["shard"]: r["held"] for r in cells.groupBy("shard").agg(F.sum("n").alias("held")).collect()}
    ends, starts, taken = [], [], 0
    for s in range(n_shards):  # a number for each shard
        size = (total + n_shards - 1 - s) // n_shards
        starts.append(taken - held.get(s, 0))
        taken += size - held.get(s, 0)
        ends.append(taken)
    width = max(1, -(-total // max(BUCKETS, total // 50_000 + 1)))
    single = _running(
        groups.where("n = 1").withColumn("one", F.lit(1)).withColumn("all", F.lit(0)),
        ["all"],
        F.floor(F.col("grp") / width),
        "grp",
        "one",
        "nth",
    )
    shard = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("nth")))
    single = single.withColumn("shard", shard).select(
        F.col("grp").alias("first"),
        F.lit(1).cast("long").alias("n"),
        "shard",
        (F.col("nth") - F.element_at(F.array(*map(F.lit, starts)), F.col("shard") + 1)).alias("slot"),
    )
    return _laid_out(rows, placed.unionByName(single)).select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _laid_out(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` with the shard and slot of the run (first, n, shard, slot) their position is in.

    Runs cover all positions once. Both sides are cut into equal stretches of positions, so no
    task gets more than its share, however long a run or large a group.
    """
    stretch = F.floor(F.col("position") / STRETCH)
    low, high = F.floor(F.col("first") / STRETCH), F.floor((F.col("first") + F.col("n") - 1) / STRETCH)
    pieces = (
        runs.withColumn("stretch", F.explode(F.sequence(low, high)))
        .withColumn("position", F.greatest("first", F.col("stretch") * STRETCH))
        .select("stretch", "position", F.struct("first", "shard", "slot").alias("run"))
    )
    both = rows.withColumn("stretch", stretch).unionByName(pieces, allowMissingColumns=True)
    # A run's piece comes before the row at the same position.
    over = Window.partitionBy("stretch").orderBy("position", F.col("run").isNull())
    held = F.last("run", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    return (
        both.withColumn("held", held)
        .where("run IS NULL")
        .withColumn("shard", F.col("held.shard"))
        .withColumn("slot", F.col("held.slot") + F.col("position") - F.col("held.first"))
    )
