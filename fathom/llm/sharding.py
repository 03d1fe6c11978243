"""Sharding by balanced label propagation.

Documents with a common group key (here: equal texts) are linked. Every
linked document starts in a shard given by its row id; then rounds of joins
move documents towards the shard that holds most of their neighbours, under
capacity quotas: a shard takes no more than its share of the rows. A full
shard is closed to others, so a group larger than one shard fills one shard
after the other. Documents without links are placed last,
where room is left, and a final step moves the few documents over a quota,
so the law holds exactly.

Law ``rows``: shard sizes in documents differ by at most one.

A round works with the documents per (group, shard): a hot group is one row
of counts, joined back to its documents with Spark's skew handling. The
quotas work on a table of moves wanted by (from, to, gain level), at most
shards x shards x 64 rows on the driver: what leaves a shard makes room in
it, the highest gains go first. Where only some of a level's moves fit, a hash of the row id chooses them. Each round is stored, so a lost
executor repeats one round. Rounds go on until no move is wanted or
``PATIENCE`` rounds have not lowered the number of cut links; the placement
with the fewest is kept.

Null and empty texts are equal texts of one byte each. Repeated rows are
documents of their own. Ties go to the present shard, then to the lower
number. An empty table gives no rows. Columns beside doc_id and text are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ROW_ID, dense_positions, store, text_or_empty, with_row_id

PATIENCE = 3    # rounds without fewer cut links before propagation ends
CLOSED = 200    # a shard with less than this part of its quota left is full


def shard_quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def allowed_flows(asked: dict[tuple[int, int, int], int], held: list[int], quotas: list[int]) -> dict[tuple[int, int, int], float]:
    """How many of the moves asked for, by (from, to, gain level), may go.

    Two shards may always exchange as many as both sides ask for. Of the
    rest, what comes into a shard is scaled down, again and again, to its room
    and what leaves it. A pair's highest gains go first."""
    shards = range(len(quotas))
    wanted = [[float(sum(n for k, n in asked.items() if k[:2] == (a, b))) for b in shards] for a in shards]
    swap = [[min(wanted[a][b], wanted[b][a]) for b in shards] for a in shards]
    rest = [[wanted[a][b] - swap[a][b] for b in shards] for a in shards]
    for _ in range(64):
        for s in shards:
            into, room = sum(rest[a][s] for a in shards), max(0, quotas[s] - held[s]) + sum(rest[s])
            if into > room:
                for a in shards:
                    rest[a][s] *= room / into
    # what scaling has not settled yet: room alone
    for s in shards:
        into, room = sum(rest[a][s] for a in shards), max(0, quotas[s] - held[s]) + sum(rest[s])
        if into > room + 0.5:
            for a in shards:
                rest[a][s] *= max(0, quotas[s] - held[s]) / into
    flow = {}
    for a in shards:
        for b in shards:
            left = swap[a][b] + rest[a][b]
            for k in sorted((k for k in asked if k[:2] == (a, b)), key=lambda k: -k[2]):
                flow[k] = min(left, asked[k])
                left -= flow[k]
    return flow


def cut_links(per_group: DataFrame, shards: int) -> int:
    """Links between documents of one group in different shards, from the
    group's documents per shard (_c0, _c1, ...)."""
    sizes = [F.col(f"_c{s}").cast("decimal(38,0)") for s in range(shards)]
    every = sum(sizes[1:], sizes[0])
    cut = (every * every - sum((c * c for c in sizes[1:]), sizes[0] * sizes[0])) / 2
    return int(per_group.agg(F.sum(cut.cast("decimal(38,0)"))).first()[0] or 0)


def group_shards(state: DataFrame, shards: int) -> DataFrame:
    """Documents per (_group, shard): _c0, _c1, ..."""
    return state.groupBy("_group").agg(*[F.count(F.when(F.col("_shard") == s, 1)).alias(f"_c{s}") for s in range(shards)])


def propagate(members: DataFrame, shards: int, quotas: list[int], patience: int = PATIENCE) -> DataFrame:
    """(_row_id, _shard) of every row in ``members`` (_row_id, _group).

    Rows may be members of several groups; their neighbours are the members
    of all of these. A document moves only to a shard where it has more
    neighbours, or as many and a lower number, so no two documents swap for
    ever. In each round the shard with most askers, if it could not take half
    of them, is closed for as long as it is full: the others then look for
    their next best. Ends when none asks, no link is cut, or ``patience``
    rounds have brought no fewer cut links; the best placement is returned.
    Fewer than ``patience`` rounds lie between two records, and the cut is a
    whole number, so it ends."""
    spark = members.sparkSession
    state = store(members.withColumn("_shard", F.pmod(F.xxhash64(ROW_ID), F.lit(shards)).cast("int")), "shards")
    # hashes choose who moves, so counts are met up to their spread
    soft = [max(0, q - math.isqrt(9 * q)) for q in quotas]
    closed = [False] * shards
    least, best, idle, round_ = None, state, 0, 0
    while True:
        per_group = store(group_shards(state, shards), "group-shards")
        cut = cut_links(per_group, shards)
        if least is None or cut < least:
            least, best, idle = cut, state, 0
        else:
            idle += 1
        if not cut or idle >= patience:
            break
        located = {r["_shard"]: r["n"] for r in state.select(ROW_ID, "_shard").distinct().groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        held = [located.get(s, 0) for s in range(shards)]
        open_ = [not c or q - h > q // CLOSED for c, q, h in zip(closed, soft, held)]
        near = (state.join(per_group, "_group").groupBy(ROW_ID, "_shard").agg(*[F.sum(f"_c{s}").alias(f"_c{s}") for s in range(shards)]))
        # the count decides, then the lower shard; closed shards attract nobody
        score = F.array(*[F.when(F.lit(open_[s]) | (F.col("_shard") == s), F.col(f"_c{s}") * shards + (shards - 1 - s)).otherwise(-1) for s in range(shards)])
        wish = near.select(ROW_ID, "_shard", score.alias("_score")).withColumn("_most", F.array_max("_score"))
        wish = wish.select(ROW_ID, "_shard", (F.array_position("_score", F.col("_most")) - 1).cast("int").alias("_to"),
                           (F.col("_most") - F.element_at("_score", F.col("_shard") + 1)).alias("_gain")).where("_gain > 0")
        wish = store(wish.select(ROW_ID, F.col("_shard").alias("_from"), "_to", F.floor(F.log2("_gain")).cast("int").alias("_level")), "moves")
        asked = {(r["_from"], r["_to"], r["_level"]): r["n"] for r in wish.groupBy("_from", "_to", "_level").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not asked:
            break
        flow = allowed_flows(asked, held, soft)
        came = {s: (sum(n for k, n in asked.items() if k[1] == s), sum(n for k, n in flow.items() if k[1] == s)) for s in range(shards)}
        closed = [c and not o for c, o in zip(closed, open_)]
        if full := [s for s, (wanted, got) in came.items() if wanted > 2 * got]:
            closed[max(full, key=lambda s: came[s][0])] = True
        rows = F.broadcast(spark.createDataFrame([(*k, n / asked[k]) for k, n in flow.items()], "_from int, _to int, _level int, _share double"))
        dice = F.pmod(F.xxhash64(ROW_ID, F.lit(round_)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moved = wish.join(rows, ["_from", "_to", "_level"]).where(dice < F.col("_share")).select(ROW_ID, "_to")
        state = store(state.join(moved, ROW_ID, "left").select(ROW_ID, "_group", F.coalesce("_to", "_shard").alias("_shard")), "shards")
        round_ += 1
    return best.select(ROW_ID, "_shard").distinct()


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law ("rows"), shard, slot
    (0, 1, 2, ... in each shard) and grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = text_or_empty()
    base = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                                   F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("_group")), "documents")
    quotas = shard_quotas(base.count(), shards)
    sizes = store(base.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_group"), "linked-groups")
    members = store(base.join(sizes, "_group").select(ROW_ID, "_group"), "members")
    state = store(propagate(members, shards, quotas), "propagated")

    # the law: rows over a quota, and all rows without links, fill what is left
    count = lambda df: {r["_shard"]: r["n"] for r in df.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = count(state)
    over = F.broadcast(spark.createDataFrame([(s, int(q)) for s, q in enumerate(quotas)], "_shard int, _quota long"))
    ranked = dense_positions(state, "_shard", held, "_i").join(over, "_shard")
    fixed = ranked.select(ROW_ID, F.when(F.col("_i") < F.col("_quota"), F.col("_shard")).otherwise(-1).alias("_fixed"))
    placed = store(base.join(fixed, ROW_ID, "left").withColumn("_shard", F.coalesce("_fixed", F.lit(-1))).drop("_fixed", "_group"), "placed")
    free = placed.where("_shard < 0")
    room = [q - min(q, held.get(s, 0)) for s, q in enumerate(quotas)]
    ends = [sum(room[:s + 1]) for s in range(shards)]
    pool = dense_positions(free, "_shard", {-1: sum(room)}, "_i")
    into = F.coalesce(*[F.when(F.col("_i") < e, F.lit(s)) for s, e in enumerate(ends)])
    every = store(placed.where("_shard >= 0").unionByName(pool.withColumn("_shard", into).drop("_i")), "all-placed")
    return dense_positions(every, "_shard", dict(enumerate(quotas)), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
