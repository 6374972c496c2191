"""Balanced label propagation: linked rows move to their neighbours' shards.

Links are given as (row, hub) memberships, so a group of any size is a star and
no pairs arise.  Rows start evenly spread, whatever their links; only hubs that
no shard holds fill whole shards, and one more, at once.  In a round each hub that is
split counts its rows by shard and bids for one shard with room for all of
them: the one with half of its rows, or one drawn by room.  A shard takes the
largest bids that its quota holds beside the hubs that lie in it whole, and the
rows of these hubs ask to move there.  Moves go round cycles of shards, into
free places, or in exchange for rows whose hubs have no shard yet, so loads
never pass their quota.  Rounds end when no hub is split or ``IDLE`` in turn
bring no more pairs together.  Rows without links fill what remains, which
evens the shards out exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import let, materialize, met, scratch

#: Rows that one task numbers.
CHUNK = 50_000
#: Rounds in turn that bring no more pairs together, after which propagation ends.
IDLE = 2


def numbered(rows: DataFrame, n: int, by: list[str], near: str = "row") -> DataFrame:
    """``rows`` with ``nth``, from 0 without gaps in each group of ``by``; rows of one ``near`` follow each other.

    Rows are numbered in chunks dealt by a hash of ``near``; a small table of
    chunk sizes gives each chunk its first number.
    """
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(near), F.lit(max(1, -(-n // CHUNK)))).cast("int"))
    ranked = dealt.withColumn("nth", F.row_number().over(W.partitionBy(*by, "chunk").orderBy(*dict.fromkeys((near, "row")))).cast("long"))
    sizes = dealt.groupBy(*by, "chunk").agg(F.count("*").alias("size"))
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return ranked.join(first, [*by, "chunk"]).withColumn("nth", F.col("nth") - 1 + F.col("first")).drop("chunk", "first")


def pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), index.cast("int") + 1)


def among(ends: list[int], at: Column) -> Column:
    """The number of the first of the ascending ``ends`` beyond ``at``."""
    return let(at, lambda x: F.size(F.filter(F.array(*(F.lit(int(e)).cast("long") for e in ends)), lambda e: e <= x)))


def dealt(links: DataFrame, quotas: list[int]) -> DataFrame:
    """``row, shard`` of every linked row before the first round, loads within the quotas.

    A hub that no shard holds fills whole shards and one more; the other rows
    are spread over what is left of all shards, in no order.
    """
    hubs = links.groupBy("hub").agg(F.count("*").alias("n"))
    large = hubs.filter(F.col("n") > max(quotas)).select("hub")  # fewer than the shards, for each link of a row
    bound = materialize(links.join(F.broadcast(materialize(large)), "hub").groupBy("row").agg(F.min("hub").alias("hub")))
    sizes = [(r.hub, r.n) for r in bound.groupBy("hub").agg(F.count("*").alias("n")).orderBy("hub").collect()]
    free, runs, rest = list(quotas), [], []

    def lay(hub, at: int, n: int, s: int) -> None:
        runs.append((hub, at, at + n, s))
        free[s] -= n

    for hub, n in sizes:
        at = 0
        for s, q in enumerate(quotas):
            if 0 < q == free[s] and n - at >= q:
                lay(hub, at, q, s)
                at += q
        rest.append((n - at, hub, at))
    for n, hub, at in sorted(rest, key=lambda r: -r[0]):
        while n:
            s = min(range(len(free)), key=lambda s: (free[s] < n, free[s] if free[s] >= n else -free[s]))
            part = min(n, free[s])
            lay(hub, at, part, s)
            n, at = n - part, at + part
    schema = T.StructType([bound.schema["hub"], *(T.StructField(c, T.LongType()) for c in ("first", "stop")), T.StructField("shard", T.IntegerType())])
    placed = F.broadcast(links.sparkSession.createDataFrame(runs, schema).withColumnRenamed("hub", "of"))
    ranked = numbered(bound, sum(n for _, n in sizes), ["hub"])
    laid = ranked.join(placed, (F.col("hub") == F.col("of")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("stop"))).select("row", "shard")
    laid = materialize(laid)
    load = {r.shard: r.n for r in laid.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = np.array([q - load.get(s, 0) for s, q in enumerate(quotas)], np.int64)
    rest = links.select("row").distinct().join(laid.select("row"), "row", "left_anti")
    n = rest.count()
    # every shard takes its share of the rows, so that all have room to move in
    at = (F.col("nth") * int(free.sum()) / max(1, n)).cast("long")
    return laid.unionByName(numbered(rest, n, []).select("row", among(np.cumsum(free).tolist(), at).alias("shard")))


def grants(asked: np.ndarray, load: np.ndarray, quotas: list[int], idle: np.ndarray | None = None) -> np.ndarray:
    """How many of the ``asked[from, to]`` moves to make at once so that no load passes its quota (or what it was).

    Moves round cycles of shards leave the loads as they are and come first,
    until no cycle is left; then moves fill free places, and the places that
    they give up.  Then, if ``idle[shard]`` rows may lie anywhere, they change
    places with those that still ask; these moves back are in the result too.
    """
    left, alive, path = asked.astype(np.int64), np.ones(len(quotas), bool), []
    np.fill_diagonal(left, 0)
    while alive.any():
        path = path or [int(alive.argmax())]
        u = path[-1]
        ways = np.where(alive, left[u], 0)
        v = int(ways.argmax())
        if not ways[v]:  # no cycle goes through u
            alive[u] = False
            path.pop()
        elif v in path:
            cycle = path[path.index(v) :]
            edges = (cycle, [*cycle[1:], v])
            left[edges] -= left[edges].min()
            path = path[: path.index(v)]
        else:
            path.append(v)
    free = np.maximum(np.array(quotas) - load, 0)
    while True:
        gain = np.minimum(left, free)
        u, v = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[u, v]:
            break
        left[u, v] -= gain[u, v]
        free[u] += gain[u, v]
        free[v] -= gain[u, v]
    moves = asked - left
    np.fill_diagonal(moves, 0)
    if idle is not None:
        idle = idle.copy()
        for v in range(len(quotas)):
            for u in np.flatnonzero(left[:, v]):
                n = min(int(left[u, v]), int(idle[v]))
                moves[u, v] += n
                moves[v, u] += n
                idle[v] -= n
    return moves


def bids(hubs: DataFrame, room: list[int], turn: int, n: int) -> DataFrame:
    """``hub, to`` of the split hubs that get a shard: ``hubs(hub, of, at)``, ``at`` their rows by shard; ``n`` hubs.

    ``room`` is what each shard's quota leaves.  In every shard the largest
    bids are taken as far as it goes; many hubs are dealt into chunks that
    share it out.
    """
    rooms = F.array(*(F.lit(int(r)).cast("long") for r in room))
    most = F.array_max(F.map_values("at"))
    major = F.array_min(F.map_keys(F.map_filter("at", lambda k, v: v == most)))
    half = (most * 2 >= F.col("of")) & (F.element_at(rooms, major + 1) >= F.col("of"))
    fits = F.transform(rooms, lambda r: F.when(r >= F.col("of"), r).otherwise(F.lit(0).cast("long")))
    whole = F.aggregate(fits, F.lit(0).cast("long"), lambda s, x: s + x)

    def drawn(total: Column) -> Column:
        at = F.pmod(F.xxhash64("hub", F.lit(turn)), F.greatest(total, F.lit(1)))
        begin = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("to"), F.lit(0).alias("i"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.when((s["to"] < 0) & (s["sum"] + x > at), s["i"]).otherwise(s["to"]).alias("to"), (s["i"] + 1).alias("i"))
        return F.aggregate(fits, begin, step)["to"]

    bid = hubs.select("hub", "of", F.when(half, major).otherwise(let(whole, drawn)).cast("int").alias("to")).filter("to >= 0")
    parts = max(1, -(-n // CHUNK))
    chunk = bid.withColumn("chunk", F.pmod(F.xxhash64("hub"), F.lit(parts)))
    sums = F.sum("of").over(W.partitionBy("to", "chunk").orderBy(F.desc("of"), "hub").rowsBetween(W.unboundedPreceding, 0))
    return chunk.withColumn("sum", sums).filter(F.col("sum") * parts <= F.element_at(rooms, F.col("to") + 1)).select("hub", "to")


def propagate(links: DataFrame, quotas: list[int], rounds: int | None = None, log: list | None = None) -> DataFrame:
    """``row, shard`` of every linked row, loads within the quotas; ``rounds`` bounds the rounds, None does not.

    A round writes the hubs' counts, the rows that move or may, and the
    memberships with their rows' new shards.  ``log`` takes (pairs together,
    moves asked, moves granted) of each.
    """
    shards, most = len(quotas), max(1, *quotas)
    memberships = links.count()
    here = materialize(links.join(dealt(links, quotas), "row"))
    best, best_pairs, idle_rounds, turn = here, -1, 0, 0
    while True:
        counts = here.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        hubs = materialize(counts.groupBy("hub").agg(F.sum("n").alias("of"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("at")))  # at most one entry a shard
        squares = F.aggregate(F.map_values("at"), F.lit(0).cast("long"), lambda s, x: s + x * (x - 1))
        split = (F.size("at") > 1) & (F.col("of") <= most)
        pairs, n = hubs.agg(F.sum(squares), F.count_if(split)).first()
        pairs = pairs or 0
        idle_rounds = 0 if pairs > best_pairs else idle_rounds + 1
        if pairs > best_pairs:
            best, best_pairs = here, pairs
        if not n or idle_rounds == IDLE or turn == rounds:
            break
        # A row is held by its largest hub that lies in one shard, or that no shard holds.
        open_hubs = hubs.filter(split)
        held = met(here, hubs.filter(~split).select("hub", "of"), memberships).groupBy("row", "shard").agg(F.max("of").alias("held"))
        held = materialize(held)
        load, fixed = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        for r in here.select("row", "shard").distinct().groupBy("shard").agg(F.count("*").alias("n")).collect():
            load[r.shard] = r.n
        for r in held.groupBy("shard").agg(F.count("*").alias("n")).collect():
            fixed[r.shard] = r.n
        taken = materialize(bids(open_hubs, [int(q - f) for q, f in zip(quotas, fixed)], turn, n).join(open_hubs.select("hub", "of"), "hub"))
        wishes = met(here, open_hubs.select("hub", "of").join(taken.select("hub", "to"), "hub", "left"), memberships)
        near = F.when(F.col("of") * 1000 > memberships, F.xxhash64("hub", "row")).otherwise(F.xxhash64("hub"))  # the rows of large hubs are dealt out
        top = F.max_by(F.struct("to", near.alias("near"), "of"), F.when(F.col("to").isNotNull(), F.struct("of", "to")))
        wish = wishes.groupBy("row", "shard").agg(top.alias("top"), F.first(near).alias("own"))
        wish = wish.join(held.select("row", "held"), "row", "left").filter(F.coalesce(F.col("top.of") > F.col("held"), F.col("held").isNull()))
        moves = materialize(wish.select("row", "shard", F.coalesce("top.to", F.lit(-1)).alias("to"), F.coalesce("top.near", "own").alias("near")).filter("to != shard"))
        asked, loose = np.zeros((shards, shards), np.int64), np.zeros(shards, np.int64)
        for r in moves.groupBy("shard", "to").agg(F.count("*").alias("n")).collect():
            if r.to < 0:
                loose[r.shard] = r.n
            else:
                asked[r.shard, r.to] = r.n
        given = grants(asked, load, quotas, loose)
        if log is not None:
            log.append((pairs, int(asked.sum()), int(given.sum())))
        turn += 1
        if not given.any():
            continue
        # In each shard those that ask go as granted, one hub after the other; those that may lie anywhere fill what is asked back.
        size = int(asked.sum() + loose.sum())
        back = np.maximum(given - asked, 0)
        given = np.minimum(given, asked)
        may = pick([int(x) for x in given.ravel()], F.col("shard") * shards + F.col("to"))
        granted = numbered(moves.filter("to >= 0"), size, ["shard", "to"], "near").filter(F.col("nth") < may).select("row", "to")
        ends = F.array(*(F.array(*(F.lit(int(x)).cast("long") for x in np.cumsum(row))) for row in back))
        place = let(F.struct(F.element_at(ends, F.col("shard") + 1).alias("e"), "nth"), lambda x: F.size(F.filter(x["e"], lambda e: e <= x["nth"])))
        swapped = numbered(moves.filter("to < 0"), size, ["shard"], "near").withColumn("to", place.cast("int")).filter(F.col("to") < shards).select("row", "to")
        here = materialize(here.join(granted.unionByName(swapped), "row", "left").select("row", "hub", F.coalesce("to", "shard").alias("shard")))
    return best.groupBy("row").agg(F.min("shard").alias("shard"))


def shard(rows: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """``row, shard, slot`` for every ``row`` of ``rows``, counts of shards at most one apart.

    ``row`` is a unique long; ``links(row, hub)`` may name rows more than once
    and hubs of any type; hubs with one row bind nothing.  No rows give an
    empty result.  ``slot`` runs from 0 without gaps in each shard.
    """
    n = rows.count()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    sizes = materialize(links.groupBy("hub").agg(F.count("*").alias("of")).filter("of > 1"))
    bound = materialize(met(links, sizes, links.count()).select("row", "hub"))
    placed = materialize(numbered(propagate(bound, quotas), n, ["shard"]))
    load = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    held = [min(q, load.get(s, 0)) for s, q in enumerate(quotas)]
    kept = placed.filter(F.col("nth") < pick(quotas, F.col("shard"))).select("row", "shard", F.col("nth").alias("slot"))
    free = numbered(rows.select("row").join(kept.select("row"), "row", "left_anti"), n, [])
    ends, total = [], 0
    for q, h in zip(quotas, held):
        total += q - h
        ends.append(total)
    stops = F.array(*(F.lit(e).cast("long") for e in ends))
    filled = free.withColumn("shard", let(F.col("nth"), lambda x: F.size(F.filter(stops, lambda e: e <= x))))
    first = [h - (e - (q - h)) for q, h, e in zip(quotas, held, ends)]
    filled = filled.select("row", "shard", (F.col("nth") + pick(first, F.col("shard"))).alias("slot"))
    return kept.unionByName(filled)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` in a shard, rows with equal texts together as far as quotas allow.

    Columns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  Law
    ``rows``: counts of shards are at most one apart.  A null text has no bytes
    and is linked with empty texts; ids are carried only, so they may be null
    or repeated; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with scratch(docs.sparkSession) as keep:
        base = materialize(
            docs.select(
                F.monotonically_increasing_id().alias("row"),
                F.col(id_col).cast("bigint").alias("doc_id"),
                (F.octet_length(text).cast("long") + 16).alias("size"),
                F.crc32(text.cast("binary")).alias("text_crc32"),
                F.xxhash64(text).alias("hub"),
            )
        )
        links = base.select("row", F.struct("hub", "text_crc32", "size").alias("hub"))
        placed = shard(base.select("row"), links, shards)
        return keep(base.join(placed, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
