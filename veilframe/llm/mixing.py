"""Mixing sources to target weights by Pfair scheduling.

A stream of slots is shared among sources; each slot takes one block of `block` documents. Block i of a source with weight
p/Q is released at slot floor(i*Q/p) and due at ceil((i+1)*Q/p); of the released blocks the one with the earliest deadline
goes first. On one processor that meets every deadline, so after any slot t a source has had more than t*p/Q - 1 and fewer
than t*p/Q + 1 blocks. Whole weights with sum Q make the schedule repeat every Q slots, so the driver schedules one period
(Q entries, whatever the corpus holds) and block i of a source follows in closed form.

The stream is as long as the slowest source needs to be read whole once; a source that its weight runs through sooner
starts again, so each document comes at least once and the parts match the whole weights to less than one block; these differ
from the weights asked for by less than 1/PERIOD each, with at most PERIOD / 8 sources (beyond that the period grows with them).
Inside a source documents follow a hash of their id, rows of equal or null ids a hash of all their columns (maps aside), so the
order is the same however the rows are dealt, but for rows that are equal in all. The index of a document is an offset of its hash
bucket plus its rank in the bucket, and buckets are cut by both hashes, so a hot source or a hot id is spread over all of them.

Defined cases: null source is a source of its own; null text and empty texts are ordinary documents; repeated rows are
ordinary documents, each with a place of its own; an empty table gives an empty stream; further columns pass through unless
they are named `epoch`, `slot` or `position`, which then carry this operator's values.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import shuffle_partitions, table

#: Slots of one period: weights are rounded to multiples of 1 / PERIOD.
PERIOD = 1000
BLOCK = 8
#: Of a source's documents; the same whatever the session's settings, as the order depends on it.
BUCKETS = 1 << 14
#: Weights default to shares of the documents raised to this power: small sources count for more than their size.
POWER = 0.7


def whole_weights(weights: Mapping, period: int = PERIOD) -> dict:
    """Positive whole weights with sum max(period, 8 * sources), by largest remainders."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    period = max(period, 8 * len(weights))
    total, order = sum(weights.values()), sorted(weights, key=lambda s: (s is None, str(s)))
    spare = period - len(order)
    exact = {s: weights[s] / total * spare for s in order}
    parts = {s: 1 + int(exact[s]) for s in order}
    left = period - sum(parts.values())
    for s in sorted(order, key=lambda s: int(exact[s]) - exact[s])[:left]:
        parts[s] += 1
    return parts


def one_period(parts: Mapping) -> dict:
    """source -> slots of its blocks in one period of earliest-deadline-first."""
    period = sum(parts.values())
    order = {s: k for k, s in enumerate(parts)}
    waiting = [(0, order[s], s, 0) for s in parts]  # release, tie, source, block
    heapq.heapify(waiting)
    ready: list = []
    slots: dict = {s: [] for s in parts}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, k, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // parts[s]), k, s, i))
        due, k, s, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        slots[s].append(t)
        if i + 1 < parts[s]:
            heapq.heappush(waiting, ((i + 1) * period // parts[s], k, s, i + 1))
    return slots


def numbered(docs: DataFrame, group: Column, key: Column, buckets: int = BUCKETS) -> DataFrame:
    """Add _group, _index: gapless positions from 0 inside each group, in an order given by a hash of key and then of all columns."""
    every = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    hashed = docs.withColumn("_group", group).withColumn("_hash", F.xxhash64(key)).withColumn("_tie", F.xxhash64(*every))
    dealt = hashed.withColumn("_bucket", F.expr(f"pmod(hash(_hash, _tie), {buckets})").cast("int"))
    sizes = dealt.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_group").alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy("_bucket", "_group").orderBy("_hash", "_tie")) - 1
    ranked = dealt.withColumn("_rank", rank)
    return (
        ranked.join(offsets, (F.col("_group") == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_index", F.col("_before") + F.col("_rank"))
        .drop("_hash", "_tie", "_bucket", "_rank", "_g", "_b", "_before")
    )


def pfair_mix(docs: DataFrame, weights: Mapping | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """docs with epoch, slot and position; a document that the stream comes back to has a row for each time.

    weights: source -> weight, for every source in docs; by default shares of the documents to the power POWER.
    """
    if block < 1:
        raise ValueError("block must be positive")
    spark = docs.sparkSession
    group = F.coalesce(F.col("source").cast("string"), F.lit("\x00"))
    # a row for each source: as many as the caller has weights for
    sizes = {r["_group"]: r["n"] for r in docs.groupBy(group.alias("_group")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        weights = {s: n**POWER for s, n in sizes.items()}
    else:
        weights = {"\x00" if s is None else str(s): w for s, w in weights.items()}
    if missing := sorted(set(sizes) - set(weights)):
        raise ValueError(f"no weight for {missing[:5]}")
    own = [c for c in docs.columns if c not in ("epoch", "slot", "position")]
    held = [f"_c{i}" for i in range(len(own))]
    # columns have other names inside, so that further ones can't clash with ours
    rows = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(own, held, strict=True)])
    parts = whole_weights({s: weights[s] for s in sizes}, period) if sizes else {}
    turn = one_period(parts) if parts else {}
    total = sum(parts.values())
    slots = max((-(-(-(-sizes[s] // block) + 1) * total // parts[s]) for s in parts), default=0)
    plan = [
        (s, sizes[s], parts[s], (slots // total) * parts[s] + sum(t < slots % total for t in turn[s]), turn[s]) for s in parts
    ]
    at = spark.createDataFrame(plan, "_s string, _n long, _p long, _blocks long, _turn array<int>")
    named = dict(zip(own, held, strict=True))
    source = F.coalesce(F.col(named["source"]).cast("string"), F.lit("\x00"))
    placed = numbered(rows, source, F.col(named["doc_id"]))
    again = placed.join(F.broadcast(at), F.col("_group") == F.col("_s")).withColumn(  # one period's slots in all
        "_at", F.explode(F.expr(f"sequence(_index, greatest(_index, _blocks * {block} - 1), _n)"))
    )
    slot = f"(_block div _p) * {total} + _turn[cast(_block % _p as int)]"
    return (
        again.where(F.col("_at") < F.col("_blocks") * block)
        .withColumn("_block", F.expr(f"_at div {block}"))
        .select(
            *[F.col(h).alias(c) for c, h in named.items()],
            F.expr("_at div _n").alias("epoch"),
            F.expr(slot).alias("slot"),
            F.expr(f"({slot}) * {block} + _at % {block}").alias("position"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The stream itself, with the columns of docs, each file a run of it in order."""
    clash = {c: f"_own_{c}" for c in ("epoch", "slot", "position") if c in docs.columns}
    stream = pfair_mix(docs.withColumnsRenamed(clash))
    n = shuffle_partitions(docs.sparkSession)
    ordered = stream.repartitionByRange(n, "position").sortWithinPartitions("position")
    return ordered.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def op9_query(spark, sf_dir: str) -> DataFrame:
    return pfair_mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select(
        "doc_id", "source", "epoch", "slot", "position"
    )
