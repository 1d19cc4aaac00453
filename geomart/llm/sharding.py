"""Sharding by balanced label propagation over documents with equal texts.

Every document begins in the shard its doc_id hashes to. In each round the documents of a group vote, by bytes, for the
shards they lie in; joins bring the vote back and documents outside their group's leading shard ask to move there. A
shard admits movers, in a fixed order, up to a quota: linked documents may fill it to `fill` of the mean size. A group
too large for one shard leads in as many shards as it needs. When no document moves any more, unlinked documents flow
from shards above the mean to shards below it, small ones last, until sizes are even; where documents are few, single
moves and swaps between the fullest and the emptiest shards do the rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_unique, running_total


def _loads(state: DataFrame, shards: int, *more: Column) -> np.ndarray:
    """Bytes by shard; at most `shards` rows reach the driver."""
    loads = np.zeros(shards)
    for row in state.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
        loads[row["shard"]] = row["bytes"]
    return loads


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), index + 1)


def propagate(linked: DataFrame, groups: DataFrame, shards: int, mean: float, fill: float, rounds: int) -> DataFrame:
    """linked: doc_id, copy, size, group, shard; groups: group, group_bytes. The same rows with the shards they move to."""
    for _ in range(rounds):
        votes = linked.groupBy("group", "shard").agg(F.sum("size").alias("bytes"))
        order = Window.partitionBy("group").orderBy(F.desc("bytes"), F.xxhash64("group", "shard"))
        lead = votes.join(groups, "group").withColumn("place", F.row_number().over(order) - 1).withColumn("leads", F.least(F.lit(shards), F.greatest(F.lit(1), F.ceil(2 * F.col("group_bytes") / F.lit(mean)).cast("int")))).filter("place < leads")
        led = lead.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "shard"))), lambda x: x["shard"]).alias("goals"))
        asking = join_unique(linked, cut(led, "leads"), ["group"]).withColumn("to", F.when(F.array_contains("goals", F.col("shard")), F.lit(None)).otherwise(F.element_at("goals", F.pmod(F.xxhash64("doc_id", "copy"), F.size("goals")).cast("int") + 1)))
        asking = cut(asking.drop("goals"), "asking")
        free = np.maximum(0, fill * mean - _loads(linked, shards))
        movers = running_total(asking.filter("to is not null"), ["to"], ["group", "doc_id", "copy"], F.col("size"), "before")
        moved = movers.withColumn("shard", F.when(F.col("before") + F.col("size") <= _pick(free, F.col("to")), F.col("to")).otherwise(F.col("shard")))
        now = cut(asking.filter("to is null").unionByName(moved.drop("before")), "labels")
        changed = now.filter("shard = to").limit(1).count()
        linked = now.drop("to")
        if not changed:
            break
    return linked


def even_out(state: DataFrame, shards: int, near: float = 1e-4, passes: int = 20) -> DataFrame:
    """state: doc_id, copy, size, shard, linked. Moves documents from shards above the mean size to those below it.

    Each pass uses unlinked documents of the least size class (power of two) that still suffices, so the last passes
    leave differences of about one small document; linked documents move only where unlinked ones don't suffice. It ends
    when the largest excess is at most `near` of the mean or no pass makes it smaller.
    """
    last, prior = float("inf"), state
    for _ in range(passes):
        kinds = state.groupBy("shard", "linked", F.floor(F.log2(F.col("size").cast("double"))).cast("int").alias("kind")).agg(F.sum("size").alias("bytes")).collect()  # shards x 2 x 63 rows at most
        loads = np.zeros(shards)
        for row in kinds:
            loads[row["shard"]] += row["bytes"]
        over = np.maximum(0, loads - loads.mean())
        if over.max(initial=0) >= last:
            return prior
        if over.max(initial=0) < max(1.0, near * loads.mean()):
            break
        last, prior = over.max(), state
        for with_linked, kind in [(False, k) for k in range(64)] + [(True, k) for k in range(64)]:
            have = np.zeros(shards)
            for row in kinds:
                if row["kind"] <= kind and (with_linked or not row["linked"]):
                    have[row["shard"]] += row["bytes"]
            if (have >= over).all():
                break
        able = (F.col("size") < F.lit(float(2 ** (kind + 1)))) & (F.lit(with_linked) | ~F.col("linked")) & (_pick(over, F.col("shard")) > 0)
        flow = running_total(state.filter(able), ["shard"], ["doc_id", "copy"], F.col("size"), "before")
        starts = np.concatenate([[0], np.cumsum(over)])
        under = np.cumsum(np.maximum(0, loads.mean() - loads))
        middle = F.col("before") + F.col("size") / 2
        at = _pick(starts[:-1], F.col("shard")) + middle
        goal = F.least(sum((F.when(at >= F.lit(float(x)), 1).otherwise(0) for x in under), F.lit(0)), F.lit(int(np.argmax(under))))
        flow = flow.withColumn("shard", F.when(middle < _pick(over, F.col("shard")), goal).otherwise(F.col("shard"))).drop("before")
        state = cut(state.filter(~able).unionByName(flow), "even")
    return state


def transfers(loads: np.ndarray, held: list[dict[int, int]], near: float) -> dict[int, int]:
    """Single moves and swaps that make sizes more even; held: copy and size of each shard's documents that may go. The shard each moved copy ends in.

    A transfer from the fullest shard to the emptiest that gains by it, or to the emptiest from the fullest that does,
    comes as close as it can to half of their difference. Each one lowers the sum of squared sizes, so it ends: when all
    sizes are within `near` of the mean, or no transfer helps.
    """
    loads, held, moved = loads.copy(), [dict(h) for h in held], {}
    while np.abs(loads - loads.mean()).max(initial=0) > near * loads.mean():
        rank = np.argsort(loads)
        pairs = [(rank[-1], e) for e in rank[:-1]] + [(f, rank[0]) for f in rank[:0:-1]]
        for full, empty in pairs:
            apart = loads[full] - loads[empty]
            out, back = list(held[full].items()), [(None, 0), *held[empty].items()]
            if not out or apart < 2:
                continue
            gain = np.array([size for _, size in out])[:, None] - np.array([size for _, size in back])[None, :]
            off = np.where((gain > 0) & (gain < apart), np.abs(2 * gain - apart), np.inf)
            at = np.unravel_index(off.argmin(), off.shape)
            if np.isfinite(off[at]):
                (copy, size), (other, smaller) = out[at[0]], back[at[1]]
                held[empty][copy], moved[copy] = held[full].pop(copy), int(empty)
                if other is not None:
                    held[full][other], moved[other] = held[empty].pop(other), int(full)
                loads[full] -= size - smaller
                loads[empty] += size - smaller
                break
        else:
            return moved
    return moved


def settle(state: DataFrame, shards: int, near: float = 1e-4) -> DataFrame:
    """The same rows after transfers, with unlinked documents first and linked ones where these don't suffice, until sizes are within `near` of the mean or no transfer among the documents on offer helps.

    A shard offers one document of each size class, 2 ** 16 classes in all shards and 32 octaves; so no more than that,
    times two, reaches the driver, and as much is broadcast.
    """
    per = max(1, 65_536 // (32 * shards))
    for with_linked in (False, True):
        last = float("inf")
        while True:
            loads = _loads(state, shards)
            off = float(((loads - loads.mean()) ** 2).sum())
            if np.abs(loads - loads.mean()).max(initial=0) <= near * loads.mean() or off >= last:
                break
            last = off
            kind = F.floor(F.log2(F.col("size").cast("double")) * per)
            offered = state.filter(F.lit(with_linked) | ~F.col("linked")).groupBy("shard", kind.alias("kind")).agg(F.min(F.struct("copy", "size")).alias("one"))
            held: list[dict[int, int]] = [{} for _ in range(shards)]
            for row in offered.select("shard", "one.copy", "one.size").collect():
                held[row["shard"]][row["copy"]] = row["size"]
            moved = transfers(loads, held, near)
            if not moved:
                break
            goals = state.sparkSession.createDataFrame(list(moved.items()), "copy long, goal int")
            state = cut(state.join(F.broadcast(goals), "copy", "left").withColumn("shard", F.coalesce("goal", "shard")).drop("goal"), "settled")
    return state


def shard_documents(docs: DataFrame, shards: int = 40, fill: float = 0.9, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null), group_docs.

    A null text counts as an empty one. Equal texts are one group; repeated rows are members like others. Shard sizes in
    bytes are near equal; slots of a shard run from 0 without a gap. An empty table gives an empty table; columns beside
    doc_id and text are not read. A null doc_id is kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode(text, "UTF-8")).alias("group"))
    base = cut(base.withColumn("copy", F.monotonically_increasing_id()), "sizes")
    total = base.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    mean = (total["bytes"] or 0) / shards or 1.0
    groups = cut(base.groupBy("group").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("group_docs")).filter("group_docs > 1"), "groups")
    state = join_unique(base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(shards)).cast("int")), groups, ["group"], "left")
    state = cut(state.withColumn("linked", F.col("group_docs").isNotNull()), "state")
    linked = propagate(state.filter("linked").select("doc_id", "copy", "size", "group", "shard"), groups.select("group", "group_bytes"), shards, mean, fill, rounds)
    moved = state.filter("not linked").select("doc_id", "copy", "size", "shard", "linked").unionByName(linked.select("doc_id", "copy", "size", "shard", F.lit(True).alias("linked")))
    placed = running_total(settle(even_out(cut(moved, "moved"), shards), shards).select("copy", "shard"), ["shard"], ["copy"], F.lit(1), "slot")
    return state.select("copy", "doc_id", "size", "text_crc32", F.coalesce("group_docs", F.lit(1)).alias("group_docs")).join(placed, "copy").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_docs")
