"""Sharding by balanced label propagation over groups of linked documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans import materialise, running_total


def allowed_flows(asked: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the documents that ask to move from one shard to another may, so that no shard takes in more than it gives away and has free.

    All are let go first; then shards that would overflow turn away what is too much, the largest streams first,
    which may fill others, until none overflows. Two opposite streams pass each other even where all shards are full.
    """
    flows = dict(asked)
    while True:
        net = [sum(n for (_, to), n in flows.items() if to == s) - sum(n for (of, _), n in flows.items() if of == s) - f for s, f in enumerate(free)]
        over = max(range(len(free)), key=lambda s: net[s])
        if net[over] <= 0:
            return flows
        if net[over] > sum(n for (_, to), n in flows.items() if to == over):
            raise ValueError("a shard holds more than its quota")
        for key in sorted((k for k in flows if k[1] == over), key=lambda k: (-flows[k], k)):
            turned = min(flows[key], net[over])
            flows[key] -= turned
            net[over] -= turned


def propagate(cells: DataFrame, quotas: list[int], bins: int = 512, rounds: int = 20) -> tuple[DataFrame, list[int]]:
    """Move linked documents towards their neighbours' shards: cells (gid, shard, n) of documents of one group in one shard.

    In a round every group tells its cells, by a join, the shard that most of its documents hold (of equals the
    one with the larger hash), and all others ask to move there. What may move between two shards is ``allowed_flows``; documents
    are let through in seeded order, summed by ``running_total``, so no shard's stream gathers in one task, and a cell may be let through
    in part. Documents of a cell are alike, so they travel as a count. Only streams and loads, one number for each pair of shards,
    reach the driver. The documents that a group has in its shard only grow in number, so the pairs of linked documents in different
    shards shrink with every round that moves any; it ends when none may.

    Returns the cells, and the pairs cut at first and after each round.
    """
    cells, told = materialise(cells.select("gid", "shard", F.col("n").cast("bigint").alias("n")), "cells"), []
    for turn in range(rounds):
        best = cells.groupBy("gid").agg(F.max(F.struct("n", F.xxhash64("gid", "shard").alias("h"), "shard"))["shard"].alias("want"), F.sum("n").alias("linked"))
        asks = cells.join(best, "gid")
        found = asks.groupBy("shard", "want").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("linked") - F.col("n"))).alias("cut")).collect()  # shards x shards
        streams = {(r.shard, r.want): r.n for r in found}
        told.append(sum(r.cut for r in found) // 2)
        load = [sum(n for (of, _), n in streams.items() if of == s) for s in range(len(quotas))]
        flows = allowed_flows({k: n for k, n in streams.items() if k[0] != k[1]}, [q - used for q, used in zip(quotas, load, strict=True)])
        flows = {k: n for k, n in flows.items() if n > 0}
        if not flows:
            break
        let = F.create_map(*[F.lit(x) for (of, to), n in sorted(flows.items()) for x in (of * len(quotas) + to, n)])
        movers = running_total(asks.where("shard <> want"), ["shard", "want"], F.xxhash64(F.lit(turn), "gid"), ["gid"], F.col("n"), "before", bins)
        stream = F.coalesce(let[F.col("shard") * len(quotas) + F.col("want")], F.lit(0))
        movers = movers.withColumn("moved", F.least("n", F.greatest(stream - F.col("before"), F.lit(0))).cast("bigint"))
        there = movers.select("gid", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("moved")).alias("n")), F.struct(F.col("want").alias("shard"), F.col("moved").alias("n")))).alias("c")).select("gid", "c.*")
        after = asks.where("shard = want").select("gid", "shard", "n").unionByName(there).groupBy("gid", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        cells = materialise(after, "cells")
    return cells, told


def _spread(groups: list, free: list[int]) -> list[tuple[str, int, int]]:
    """Cells of fewer groups than shards, each in the fewest shards that have room: the emptiest first until the rest fits into one; ``free`` shrinks."""
    cells = []
    for r in sorted(groups, key=lambda r: (-r.n, r.gid)):
        left = r.n
        while left:
            room = [s for s, f in enumerate(free) if f >= left]
            shard = min(room, key=lambda s: free[s]) if room else max(range(len(free)), key=lambda s: free[s])
            taken = min(left, free[shard])
            free[shard] -= taken
            left -= taken
            cells.append((r.gid, shard, taken))
    return cells


def _rehomed(groups: DataFrame, own: DataFrame, free: list[int], bins: int) -> DataFrame:
    """Cells of groups (gid, n) that go whole to a shard with room, in rounds; ``own`` are their cells before.

    A group asks for the shard with room that most of its documents hold; a shard grants in seeded order while it has
    room, at least one group a round. What fits nowhere whole at last are fewer groups than shards, since each is larger
    than all that any shard has free: those are spread.
    """
    spark, parts, turn = groups.sparkSession, [], 0
    held = own.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("own"))  # a cell for each shard at most
    rest = materialise(groups.select("gid", "n").join(held, "gid"), "rest")
    while True:
        room = F.filter(F.transform(F.array(*[F.lit(f).cast("bigint") for f in free]), lambda f, s: F.struct(F.coalesce(F.col("own")[s], F.lit(0)).alias("own"), F.xxhash64("gid", s).alias("h"), s.alias("shard"), f.alias("free"))), lambda c: c["free"] >= F.col("n"))
        asks = rest.withColumn("best", F.array_max(room)).select("gid", "n", "own", F.col("best.shard").alias("want"), F.col("best.free").alias("free"))
        asking = asks.where("want is not null")
        if asking.isEmpty():
            break
        asking = running_total(asking, ["want"], F.xxhash64(F.lit(turn), "gid"), ["gid"], F.col("n"), "before", bins)
        asking = materialise(asking.withColumn("granted", F.col("before") + F.col("n") <= F.col("free")), "asks")
        parts.append(asking.where("granted").select("gid", F.col("want").alias("shard"), "n"))
        for r in parts[-1].groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row for each shard
            free[r.shard] -= r.n
        rest, turn = materialise(asking.where("not granted").select("gid", "n", "own").unionByName(asks.where("want is null").select("gid", "n", "own")), "rest"), turn + 1
    cells = _spread(rest.select("gid", "n").collect(), free)  # fewer groups than shards
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(cells, "gid string, shard int, n bigint").coalesce(1))


def place_groups(cells: DataFrame, quotas: list[int], bins: int) -> tuple[DataFrame, list[int]]:
    """Cells (gid, shard, n) of all linked documents within quotas, and the pairs cut at first and after each round of propagation.

    Groups that no shard could hold are fewer than shards and are spread first. All others propagate; those that
    a full shard kept from coming together are then taken up and go whole where there is room (``_rehomed``).
    """
    spark, free = cells.sparkSession, list(quotas)
    groups = cells.groupBy("gid").agg(F.sum("n").alias("n"))
    large = groups.where(F.col("n") > max(quotas)).collect()  # fewer than shards
    spread = spark.createDataFrame(_spread(large, free), "gid string, shard int, n bigint").coalesce(1)
    rest = cells.where(~F.col("gid").isin([r.gid for r in large])) if large else cells
    inside, told = propagate(_within(rest, free, bins), free, bins)
    whole = materialise(inside.groupBy("gid").agg(F.sum("n").alias("n"), F.count("*").alias("parts")), "groups")
    cut = whole.where("parts > 1")
    if not cut.isEmpty():
        kept = inside.join(whole.where("parts = 1").select("gid"), "gid", "left_semi")
        for r in kept.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row for each shard
            free[r.shard] -= r.n
        inside = kept.unionByName(_rehomed(cut, inside.join(cut.select("gid"), "gid", "left_semi"), free, bins))
    return materialise(inside.unionByName(spread), "cells"), told


def _within(cells: DataFrame, free: list[int], bins: int) -> DataFrame:
    """The cells, dealt anew where a shard holds more than it has free: the overhang, in seeded order, fills the others' gaps."""
    load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    over = {s: load.get(s, 0) - f for s, f in enumerate(free) if load.get(s, 0) > f}
    if not over:
        return cells
    room, at = [], 0
    for s, f in enumerate(free):
        if f > load.get(s, 0):
            room.append((at, at + f - load.get(s, 0), s))
            at = room[-1][1]
    keep = F.create_map(*[F.lit(x) for s, f in enumerate(free) for x in (s, f)])
    ranked = running_total(cells, ["shard"], F.xxhash64(F.lit(-1), "gid"), ["gid"], F.col("n"), "before", bins)
    stays = ranked.withColumn("stay", F.least("n", F.greatest(keep[F.col("shard")] - F.col("before"), F.lit(0))))
    moved = running_total(stays.where("stay < n").withColumn("all", F.lit(0)), ["all"], F.xxhash64("gid", "shard"), ["gid", "shard"], F.col("n") - F.col("stay"), "start", bins)
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("s")) for a, b, s in room])
    stop = F.col("start") + F.col("n") - F.col("stay")
    pieces = F.transform(ends, lambda r: F.struct(r["s"].alias("shard"), (F.least(r["b"], stop) - F.greatest(r["a"], F.col("start"))).cast("bigint").alias("n")))
    dealt = moved.select("gid", F.explode(pieces).alias("c")).select("gid", "c.shard", "c.n").where("n > 0")
    left = stays.select("gid", "shard", F.col("stay").cast("bigint").alias("n")).where("n > 0")
    return left.unionByName(dealt).groupBy("gid", "shard").agg(F.sum("n").alias("n"))


def shard_documents(docs: DataFrame, shards: int = 8, bins: int = 512) -> DataFrame:
    """Deal documents to shards of equal row counts, keeping linked documents together.

    Documents with equal texts are linked (null equals null). They start in a
    shard drawn from doc_id; ``propagate`` moves them to their neighbours' shards, at every size of
    the table, while no shard exceeds its quota (rows // shards, one more for the first
    remainder). Documents without a link then fill every shard up to its quota,
    so row counts differ by one at most. A group for which no shard has room is
    spread over as few shards as have room for it when it is placed.

    Takes doc_id, text; returns doc_id, size (UTF-8 bytes + 1), text_crc32 (0 for
    null), law = "rows", shard, slot (0 upwards without gaps in a shard), linked
    (documents of equal text). Repeated rows are rows of their own. Empty in,
    empty out.
    """
    text = F.col("text")
    rows = materialise(
        docs.select(
            "doc_id",
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("gid"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        ).withColumn("h", F.xxhash64("doc_id", "gid")),
        "rows",
    )
    cells = rows.groupBy("gid", F.pmod("h", F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    cells = materialise(cells.withColumn("linked", F.sum("n").over(Window.partitionBy("gid"))).where("linked > 1"), "groups")  # a cell for each shard at most
    total = rows.count()
    quotas = [total // shards + int(s < total % shards) for s in range(shards)]
    groups = cells.select("gid", "linked").distinct()
    cells, _ = place_groups(cells.select("gid", "shard", "n"), quotas, bins)

    # documents of a group take its cells in order of their rank in the group
    upto = Window.partitionBy("gid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = cells.withColumn("until", F.sum("n").over(upto)).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("until", "shard"))).alias("ranges"))  # a cell for each shard at most
    linked = rows.join(groups, "gid")
    linked = running_total(linked, ["gid"], F.col("h"), ["doc_id", "size"], F.lit(1), "rank", 64)
    linked = linked.join(ranges, "gid").withColumn("shard", F.filter("ranges", lambda r: F.col("rank") < r["until"])[0]["shard"])
    load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}

    # unlinked documents fill what is free
    alone = rows.join(groups.select("gid"), "gid", "left_anti").withColumn("linked", F.lit(1).cast("bigint")).withColumn("shard", F.lit(None).cast("int"))
    filled, steps = 0, []
    for s, q in enumerate(quotas):
        filled += q - (load.get(s) or 0)
        steps.append((filled, s))
    alone = running_total(alone.withColumn("all", F.lit(0)), ["all"], F.col("h"), ["doc_id", "size"], F.lit(1), "rank", bins * 8)
    pick = F.coalesce(*[F.when(F.col("rank") < F.lit(until), F.lit(s)) for until, s in steps])
    columns = ["doc_id", "size", "text_crc32", "h", "linked", "shard"]
    dealt = materialise(alone.withColumn("shard", pick).select(*columns).unionByName(linked.select(*columns)), "dealt")
    out = running_total(dealt, ["shard"], F.col("h"), ["doc_id", "size", "text_crc32"], F.lit(1), "slot", bins)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")
