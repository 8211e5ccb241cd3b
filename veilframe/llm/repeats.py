"""Repeated passages by a prefix-free parse, from suffix arrays of its parse and of its dictionary.

A rolling hash of a few units (bytes, or words) triggers a cut, at places that depend on nothing else, so equal passages are
parsed alike. A string of `length` units (a window) belongs to its first trigger: d units before it, the end of a
dictionary phrase, and length - d units from it on, the beginning of a suffix of the parse. Two windows are equal if and only if
their d is equal, their phrases have the last d units in common and their suffixes the first length - d. A phrase with the
suffix that follows it, cut off after `length` units as a longer order can't change what repeats, is a context; its windows
are an interval of d.

Windows without a trigger in reach take the first of a denser set of triggers (twice), which depends on the window alone too; what is left
(runs of one letter, say) goes window by window.

1. Contexts are sorted by hashes of half a window's units after the trigger (another row: before it) and of all their units. Those that
   stand twice or more, as highly repetitive text is made of, are neighbours: all their windows repeat, and each is handled once
   from here on. A window that two different contexts share has half its units on one side of the trigger, so contexts whose halves no
   other one has are done with.
2. Only the rest, distinct contexts that share half a window, need their units.
3. The others' suffixes are sorted: the suffix array of the parse, with the longest common prefix (LCP) of neighbours. Their phrases
   are sorted by their reversed units: the order of all the dictionary's phrase suffixes, with the longest common suffix (LCS) of
   neighbours. A neighbour in the first order with both proves an interval of d from length - LCP to LCS; the largest LCP and the
   largest LCS bound what may repeat.
4. Windows inside the bounds that no neighbour proves are put in corpus order one by one, by 128-bit hashes.

Orders are range sorts, which split the most frequent passage over as many partitions as it fills; the first and last rows of each
sorted partition (two a partition) are compared with their neighbours on the driver. Texts stay where they are, in blocks of some MB that
are written once, bucketed; only places and the units of contexts travel.

Where `words` is given, strings of that many words are windows too, equal when their words are, whatever blanks stand between. They
go through the same parse and orders, with words in place of bytes. A window of `length` bytes then goes through them only where it
holds fewer whole words than that, as the others are caught by words; a context goes if any of its windows does, so equal
windows go together.

Defined cases: null text counts as empty; texts under `length` bytes keep all; repeated rows and ids are documents of
their own, so each is removed where long enough; an empty table gives no rows; further columns pass through unless they
start with `_rep_`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilframe.llm.blocks import release
from veilframe.llm.common import shuffle_partitions, stored, stored_by, table

LENGTH = 400
#: Units of a trigger, and bits that make one place in 128 bytes, or one word in 16, a trigger, and those of the denser sets: of a
#: parse by bytes, by words.
BYTES, WORDS = (12, 7, 4, 2), (3, 4, 2, 1)
CHUNK = 1 << 18
#: Bytes of text and documents of a block. Packed, a block stays below half a megabyte, above which the JVM's collector keeps a value in
#: regions of its own.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 4096
#: Neighbours on either side that are compared in the parse's order.
NEAR = 3


class Rolling:
    """Hashes of any substring of a buffer, modulo 2**64, from prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(2**61, 2**62)) * 2 + 1
        self.base, self.back = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(self.up) <= len(data):
            n = max(len(data) + 1, 2 * len(self.up))
            grown = [np.full(n, x, np.uint64) for x in (self.base, self.back)]
            for g in grown:
                g[0] = 1
            self.up, self.down = (np.cumprod(g, dtype=np.uint64) for g in grown)
        own = self.table[data] if data.dtype == np.uint8 else _mixed(data ^ self.table[0])
        terms = own * self.up[: len(data)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, start, end):
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, value) of the runs first, first + 1, ... of the given lengths."""
    count = np.maximum(count, 0)
    which = np.repeat(np.arange(len(count)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word in data."""
    blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    turn = np.diff(blank.astype(np.int8))
    return np.nonzero(turn == -1)[0], np.nonzero(turn == 1)[0]


def word_hashes(by: Rolling, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in data."""
    start, end = word_edges(data)
    by.load(data)
    return _mixed(by.of(start, end)), start, end


def _light(start: np.ndarray, end: np.ndarray, size: int, length: int, words: int) -> np.ndarray:
    """How many of the windows of `length` bytes that start before each place hold fewer than `words` whole words."""
    begun, ended = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=size + 1))]) for x in (start, end))
    p = np.arange(max(0, size - length + 1))
    return np.concatenate([[0], np.cumsum(ended[p + length + 1] - begun[p] < words)])


class Contexts:
    """The parse of the documents units[edges[k]:edges[k + 1]]: for each context its document, the place of its trigger, the units before
    (l) and after (r) that place; `lone`: (document, place) of each window without a trigger in reach."""

    def __init__(self, one: Rolling, two: Rolling, units: np.ndarray, edges: np.ndarray, length: int, scale: tuple[int, ...]):
        trigger, *levels = scale
        one.load(units)
        two.load(units)
        spot = np.arange(max(0, len(units) - trigger + 1))
        spelt = one.of(spot, spot + trigger)
        # runs of windows to parse: at first, all of each document
        doc, start, stop = np.arange(len(edges) - 1), edges[:-1], edges[1:] - length
        found = []
        for bits in levels:
            some = start <= stop
            doc, start, stop = doc[some], start[some], stop[some]
            hit = spot[(spelt >> np.uint64(64 - bits)) == 0]
            # triggers that windows of a run hold whole
            i, j = np.searchsorted(hit, start), np.searchsorted(hit, stop + length - trigger, "right")
            run, k = _runs(i, j - i)
            trig, new = hit[k], np.concatenate([[True], run[1:] != run[:-1]])[: len(run)]
            before = np.where(new, start[run], np.concatenate([[0], trig[:-1] + 1])[: len(trig)])
            reach = length - trigger + 1  # windows that start fewer units before a trigger hold it whole
            l, r = np.minimum(trig - before, reach - 1), np.minimum(length, stop[run] + length - trig)
            full = l + r >= length
            found.append((doc[run][full], trig[full], l[full], r[full]))
            # windows without one: before a trigger, and after the last one of a run
            tail = start.copy()
            np.maximum.at(tail, run, trig + 1)
            doc, start, stop = np.concatenate([doc[run], doc]), np.concatenate([before, tail]), np.concatenate([np.minimum(trig - reach, stop[run]), stop])
        self.doc, self.trig, self.l, self.r = (np.concatenate(x) for x in zip(*found, strict=True))
        which, place = _runs(start, stop - start + 1)
        self.lone = doc[which], place

    def choose(self, some: np.ndarray) -> None:
        self.doc, self.trig, self.l, self.r = self.doc[some], self.trig[some], self.l[some], self.r[some]


def _halves(length: int) -> tuple[int, int]:
    """(least units after a trigger, least units before it) of which any window has one or the other."""
    return length // 2, length - length // 2


def _half_keys(one: Rolling, trig: np.ndarray, l: np.ndarray, r: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the halves after and before the trigger; where there are fewer units the key isn't used."""
    after, before = _halves(length)
    ahead = _mixed(one.of(trig, trig + np.minimum(r, after)))
    back = _mixed(one.of(trig - np.minimum(l, before), trig) + np.uint64(length))
    return ahead.view(np.int64), back.view(np.int64)


def _window_keys(one: Rolling, two: Rolling, a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return _mixed(one.of(a, a + length)).view(np.int64), _mixed(two.of(a, a + length)).view(np.int64)


#: place: document of the block, place in its text, and whether units are words; lr: units before and after a trigger, or -1: a lone
#: window.
PARSED = "k long, c long, bid long, place long, lr long"


def _place(doc, at, kind):
    return (doc << 33) + (at << 1) + kind


def _at(place: np.ndarray) -> np.ndarray:
    return (place >> 1) & 0xFFFFFFFF


def _parse_rows(p: Contexts, one: Rolling, two: Rolling, bid: int, docs: np.ndarray, edges: np.ndarray, length: int, kind: int) -> Iterator[pd.DataFrame]:
    trig, l, r = p.trig, p.l, p.r
    after, before = _halves(length)
    ahead, back = _half_keys(one, trig, l, r, length)
    c = _mixed(two.of(trig - l, trig + r) + _mixed((l.astype(np.uint64) << np.uint64(32)) + r.astype(np.uint64))).view(np.int64)
    place, lr = _place(docs[p.doc], trig - edges[p.doc], kind), (l << 32) + r
    for k, has in ((ahead, r >= after), (back, l >= before)):
        yield pd.DataFrame({"k": k[has], "c": c[has], "bid": bid, "place": place[has], "lr": lr[has]})
    doc, at = p.lone
    if len(doc):
        k, c = _window_keys(one, two, at, length)
        yield pd.DataFrame({"k": k, "c": c, "bid": bid, "place": _place(docs[doc], at - edges[doc], kind), "lr": -1})


def _table(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def _texts(held: pa.Table, text_col: str) -> list[bytes]:
    return [t or b"" for t in held.column(text_col).cast(pa.binary()).to_pylist()]


def _blocks(docs: DataFrame, text_col: str) -> DataFrame:
    """(bid, body): documents, all columns, in blocks; written once, bucketed by bid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, size, rows = TaskContext.get().partitionId(), 0, 0, 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + count]), pa.array([sink.getvalue().to_pybytes()])], names=["bid", "body"])

        for batch in batches:
            at = 0
            for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist(), 1):
                size, rows = size + n + 64, rows + 1
                if size >= BLOCK_BYTES or rows == BLOCK_ROWS:
                    held.append(batch.slice(at, k - at))
                    yield flush()
                    held, size, rows, count, at = [], 0, 0, count + 1, k
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield flush()
        release()

    return stored_by(docs.mapInArrow(run, "bid long, body binary"), "texts", "bid", shuffle_partitions(docs.sparkSession))


def _parsed(text_col: str, length: int, words: int | None, light: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two, three = Rolling(1), Rolling(2), Rolling(3)
        least = length if words is None else min(length, 2 * words - 1)

        def flush(bid: int, docs: list, texts: list) -> Iterator[pd.DataFrame]:
            docs = np.array(docs, np.int64)
            data, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
            p = Contexts(one, two, data, edges, length, BYTES)
            if words is None:
                yield from _parse_rows(p, one, two, bid, docs, edges, length, 0)
                return
            spaced = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # a blank after each, so that words end
            hashes, start, end = word_hashes(three, spaced)
            if light:
                few = _light(start, end, len(spaced), length, words)
                at = p.trig + p.doc
                p.choose(few[at + 1 - length + p.r] > few[at - p.l])
                doc, at = p.lone
                thin = few[at + doc + 1] > few[at + doc]
                p.lone = doc[thin], at[thin]
            yield from _parse_rows(p, one, two, bid, docs, edges, length, 0)
            edges = np.searchsorted(start, edges + np.arange(len(edges)))
            yield from _parse_rows(Contexts(one, two, hashes, edges, words, WORDS), one, two, bid, docs, edges, words, 1)

        for batch in batches:
            for bid, body in zip(batch["bid"], batch["body"], strict=True):
                docs, texts, size = [], [], 0
                for doc, text in enumerate(_texts(_table(body), text_col)):
                    if len(text) >= least:
                        docs.append(doc)
                        texts.append(text)
                        size += len(text)
                    if size >= CHUNK:
                        yield from flush(bid, docs, texts)
                        docs, texts, size = [], [], 0
                if docs:
                    yield from flush(bid, docs, texts)
            release()

    return run


#: what: 0 a context that shares a half with another one, 1 the first, 2 the last, 3 the only run of equal rows in a partition, 4 a row
#: that stands twice or more. n: 1, or 2 for more; several: whether the run beside it has the same k.
RUN = "what int, part int, k long, c long, bid long, place long, lr long, n int, several boolean"
RUN_NAMES = [c.split()[0] for c in RUN.split(", ")]


def _equal_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal k and c in a partition sorted by them."""
    part, held, first = TaskContext.get().partitionId(), None, True

    def out(rows: pd.DataFrame, what: int) -> pd.DataFrame:
        return rows.assign(what=what, part=part).reindex(columns=RUN_NAMES)

    def twice(rows: pd.DataFrame) -> pd.DataFrame:
        return out(rows.assign(n=2, several=False), 4)

    for batch in batches:
        if not len(batch):
            continue
        k, c = batch["k"].to_numpy(np.int64), batch["c"].to_numpy(np.int64)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        if held is not None:
            new[0] = k[0] != held["k"].iloc[0] or c[0] != held["c"].iloc[0]
        again = ~new
        yield twice(batch[again | np.concatenate([again[1:], [False]])])
        if held is not None and again[0] and held["n"].iloc[0] == 1:
            yield twice(held)
        heads = np.nonzero(new)[0]
        size = np.diff(np.concatenate([heads, [len(k)]]))
        runs = batch.iloc[heads].assign(n=np.minimum(size, 2).astype(np.int32), several=False)
        if held is not None:
            lead = heads[0] if len(heads) else len(k)
            held["n"] = min(2, int(held["n"].iloc[0]) + int(lead))
            runs = pd.concat([held, runs], ignore_index=True)
        rk = runs["k"].to_numpy(np.int64)
        same = rk[1:] == rk[:-1]
        several = runs["several"].to_numpy(bool)
        several[1:] |= same
        several[:-1] |= same
        runs["several"] = several
        done, held = runs.iloc[:-1], runs.iloc[-1:].copy()
        if first and len(done):
            yield out(done.iloc[:1], 1)
            done, first = done.iloc[1:], False
        yield out(done[done["several"].to_numpy(bool) & (done["lr"].to_numpy(np.int64) >= 0)], 0)
    if held is not None:
        yield out(held, 3 if first else 2)


#: The order of parsed rows. Ranges of it come from rows of one block in SAMPLED, and LEAST_BLOCKS blocks at least: SAMPLES for each range.
ORDER = ["k", "c", "bid", "place"]
SAMPLED, LEAST_BLOCKS, SAMPLES = 16, 32, 60


def _some(parse, take: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """At most `take` parsed rows of each block, and how many each of them stands for."""
        for batch in batches:
            for at in range(len(batch)):
                found = [x for x in parse(iter([batch.iloc[at : at + 1]])) if len(x)]
                if found:
                    rows = pd.concat(found, ignore_index=True)[ORDER]
                    some = rows.iloc[np.random.default_rng(1).permutation(len(rows))[:take]]
                    yield some.assign(weight=len(rows) / len(some))

    return run


def _bounds(blocks: DataFrame, parse, parts: int) -> list[np.ndarray]:
    """The first row of each range but the first, as columns of ORDER: ranges of near equal numbers of rows. Sampled here, as Spark's sample
    for its own ranges would parse all texts once more."""
    n = blocks.count()
    share = max(1, min(SAMPLED, n // LEAST_BLOCKS))
    some = blocks.where(F.pmod(F.xxhash64("bid"), F.lit(share)) == 0)
    schema = ", ".join(f"{c} long" for c in ORDER) + ", weight double"
    got = some.mapInPandas(_some(parse, -(-SAMPLES * parts * share // max(1, n))), schema).toPandas().sort_values(ORDER)
    upto = got["weight"].to_numpy().cumsum()
    if not len(upto):
        return [np.zeros(0, np.int64)] * len(ORDER)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts))
    return [got[c].to_numpy(np.int64)[at] for c in ORDER]


def _range_of(rows: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted bounds are not above each row, column by column."""
    low, high = (np.searchsorted(bounds[0], rows[0], side) for side in ("left", "right"))
    if len(rows) == 1:
        return high
    open_, out = np.nonzero(low < high)[0], low.copy()
    for i in np.unique(low[open_]):
        some = open_[low[open_] == i]
        j = high[some[0]]
        out[some] += _range_of([x[some] for x in rows[1:]], [b[i:j] for b in bounds[1:]])
    return out


def _ranged(parse, bounds: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parse(batches):
            yield rows.assign(range=_range_of([rows[c].to_numpy(np.int64) for c in ORDER], bounds))

    return run


def _contexts(blocks: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """(contexts that share a half with another one: bid, place, lr, n; rows that stand twice or more: bid, place, lr)."""
    spark, parts = blocks.sparkSession, shuffle_partitions(blocks.sparkSession)
    rows = blocks.mapInPandas(_ranged(parse, _bounds(blocks, parse, parts)), f"{PARSED}, range int")
    dealt = rows.repartitionById(parts, "range").drop("range").sortWithinPartitions(*ORDER)
    runs = stored(dealt.mapInPandas(_equal_rows, RUN), "runs")
    ends = sorted(runs.where("what BETWEEN 1 AND 3").collect(), key=lambda r: (r["part"], r["what"] == 2))  # two rows a partition
    chains: list[list[dict]] = []  # equal runs on both sides of partitions' ends
    last = None
    for r in map(lambda r: r.asDict(), ends):
        beside = last is not None and last["part"] != r["part"]
        if beside and (last["k"], last["c"]) == (r["k"], r["c"]):
            chains[-1].append(r)
        else:
            if beside and last["k"] == r["k"]:
                last["several"] = r["several"] = True
            chains.append([r])
        last = r
    left, twice = [], []
    for chain in chains:
        n, head = min(2, sum(r["n"] for r in chain)), chain[0]
        if n == 2:
            twice += [(r["bid"], r["place"], r["lr"]) for r in chain if r["n"] == 1]
        if any(r["several"] for r in chain) and head["lr"] >= 0:
            left.append((head["bid"], head["place"], head["lr"], n))
    more = spark.createDataFrame(left, "bid long, place long, lr long, n int")
    return (
        runs.where("what = 0").select("bid", "place", "lr", "n").union(more),
        runs.where("what = 4").select("bid", "place", "lr").union(spark.createDataFrame(twice, "bid long, place long, lr long")),
    )


CONTEXT = "kind int, bid long, place long, n int, ahead long, back long, l binary, r binary"


def _fetched(text_col: str, lengths: tuple[int, int | None]):
    """The units of contexts: r from the trigger on, l before it, the nearest first."""

    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        one, three, out = Rolling(1), Rolling(3), []
        names = [c.split()[0] for c in CONTEXT.split(", ")]
        if not len(asked) or not len(block):
            return pd.DataFrame(columns=names)
        texts = _texts(_table(block["body"].iloc[0]), text_col)
        asked = asked.drop_duplicates("place")
        places = asked["place"].to_numpy(np.int64)
        for (doc, kind), rows in asked.groupby([places >> 33, places & 1]):
            data = np.frombuffer(texts[doc], np.uint8)
            units = word_hashes(three, data)[0] if kind else data
            one.load(units)
            place, lr = rows["place"].to_numpy(np.int64), rows["lr"].to_numpy(np.int64)
            trig, l, r = _at(place), lr >> 32, lr & 0xFFFFFFFF
            ahead, back = _half_keys(one, trig, l, r, lengths[kind])
            spots = list(zip(trig.tolist(), l.tolist(), r.tolist(), strict=True))
            before, behind = [units[t - a : t][::-1].tobytes() for t, a, _ in spots], [units[t : t + b].tobytes() for t, _, b in spots]
            out.append(pd.DataFrame({"kind": kind, "bid": rows["bid"], "place": place, "n": rows["n"], "ahead": ahead, "back": back, "l": before, "r": behind}))
        release()
        return pd.concat(out)[names]

    return run


def _padded(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    size = values.map(len).to_numpy(np.int64)
    width = max(1, int(size.max(initial=0)))
    return np.frombuffer(b"".join([v.ljust(width, b"\0") for v in values]), np.uint8).reshape(-1, width), size


def _common(held: tuple[np.ndarray, np.ndarray], step: int) -> np.ndarray:
    """Bytes that each row and the one `step` rows on begin with."""
    rows, size = held
    differ = rows[:-step] != rows[step:]
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(first, np.minimum(size[:-step], size[step:]))


#: what: 0 a row of the order, 1 the first, 2 the last of a partition. before: units of the phrase; m, mm: largest LCP, LCS;
#: proof: pairs of numbers, each an interval of d that a neighbour proves.
ORDERED = "what int, part int, kind int, bid long, place long, n int, ahead long, back long, before int, behind int, m int, mm int, proof binary, l binary, r binary"
NAMES = [c.split()[0] for c in ORDERED.split(", ")]


def _ordered(lengths: tuple[int, int | None], deep: bool):
    """Rows of a sorted partition with what their neighbours tell. deep: sorted by suffixes, else by phrases alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, done, first = TaskContext.get().partitionId(), None, 0, True
        near = NEAR if deep else 1

        def told(rows: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
            """rows[lo:hi], whose neighbours are all in rows."""
            kind, n = rows["kind"].to_numpy(), len(rows)
            unit, length = np.where(kind, 8, 1), np.where(kind, lengths[1] or 0, lengths[0])
            phrases, suffixes = _padded(rows["l"]), _padded(rows["r"]) if deep else None
            m, mm = np.zeros(n, np.int32), np.zeros(n, np.int32)
            proof = np.full((n, 2 * near, 2), -1, np.int32)
            for s in range(1, min(near, n - 1) + 1):
                like = kind[:-s] == kind[s:]
                lcs = np.where(like, _common(phrases, s) // unit[s:], 0)
                lcp = np.where(like, _common(suffixes, s) // unit[s:], 0) if deep else np.zeros(n - s, np.int64)
                if s == 1:
                    for a, x in ((m, lcp), (mm, lcs)):
                        np.maximum(a[:-1], x, out=a[:-1], casting="unsafe")
                        np.maximum(a[1:], x, out=a[1:], casting="unsafe")
                ok = (length[s:] - lcp <= lcs) & like
                both = np.stack([np.where(ok, np.maximum(length[s:] - lcp, 0), -1), np.where(ok, lcs, -1)], 1)
                proof[:-s, 2 * s - 2], proof[s:, 2 * s - 1] = both, both
            out = rows.iloc[lo:hi].copy()
            size = out["l"].map(len).to_numpy() // unit[lo:hi]
            behind = out["r"].map(len).to_numpy() // unit[lo:hi] if deep else 0
            proofs = [p[p[:, 0] >= 0].tobytes() if deep else None for p in proof[lo:hi]]
            out = out.assign(what=0, part=part, before=size, behind=behind, m=m[lo:hi], mm=mm[lo:hi], proof=proofs, l=None, r=None)
            return out.reindex(columns=NAMES)

        def end(row: pd.DataFrame, what: int) -> pd.DataFrame:
            return row.assign(what=what, part=part).reindex(columns=NAMES)

        for batch in batches:
            if not len(batch):
                continue
            if first:
                yield end(batch.iloc[:1], 1)
                first = False
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            upto = max(done, len(rows) - near)
            if upto > done:
                yield told(rows, done, upto)
            keep = max(0, upto - near)
            held, done = rows.iloc[keep:].reset_index(drop=True), upto - keep
        if held is not None:
            if done < len(held):
                yield told(held, done, len(held))
            yield end(held.iloc[-1:], 2)
        release()

    return run


def _met(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) if x.any() else n


@contextmanager
def _few_samples(spark: SparkSession) -> Iterator[None]:
    """Bounds of ranges come from sampled keys on the driver, which are some 400 bytes here: 60 a partition, 600,000 in all."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    old = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(20, 200_000 // shuffle_partitions(spark)))))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _array(contexts: DataFrame, lengths: tuple[int, int | None], deep: bool, label: str) -> DataFrame:
    """The order of contexts with what neighbours tell, those on the other side of a partition's end among them."""
    spark = contexts.sparkSession
    # contexts with equal suffixes are dealt by their place, so that no passage is too frequent for a partition; inside it they follow
    # their phrases, as near ones prove most
    unit = "r" if deep else "l"
    order = ["kind", "r", "l", "bid", "place"] if deep else ["kind", "l", "bid", "place"]
    rows = contexts if deep else contexts.select("kind", "bid", "place", "l")
    with _few_samples(spark):
        dealt = rows.repartitionByRange("kind", unit, "bid", "place").sortWithinPartitions(*order)
        told = stored(dealt.mapInPandas(_ordered(lengths, deep), ORDERED), label)
    ends = told.where("what > 0").collect()  # two rows a partition
    firsts, lasts = ({r["part"]: r for r in ends if r["what"] == w} for w in (1, 2))
    more, parts = [], sorted(firsts)
    for left, right in zip(parts, parts[1:], strict=False):
        a, b = lasts[left], firsts[right]
        if a["kind"] != b["kind"]:
            continue
        unit, length = (8, lengths[1]) if a["kind"] else (1, lengths[0])
        lcs = _met(a["l"], b["l"]) // unit
        lcp = _met(a["r"], b["r"]) // unit if deep else 0
        proof = np.array([max(length - lcp, 0), lcs], np.int32).tobytes() if deep and length - lcp <= lcs else b""
        more += [(r["bid"], r["place"], lcp, lcs, bytearray(proof)) for r in (a, b)]
    ways = told.where("what = 0").drop("what", "part", "l", "r")
    extra = spark.createDataFrame(more, "bid long, place long, m int, mm int, proof binary")
    return ways.unionByName(extra, allowMissingColumns=True)


#: what: 0 a proven interval of d, 1 one that nothing proves, 2 one that may repeat.
SETTLED = "what int, bid long, place long, k long, a int, b int"


def _settled(lengths: tuple[int, int | None]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                length = lengths[x.kind]
                low, high = max(0, length - x.behind, length - x.m), min(x.before, x.mm)
                if low > high:
                    continue

                def put(what: int, a: int, b: int, x=x, length=length) -> None:
                    turn = _halves(length)[1]  # up to here the half after the trigger is whole
                    for k, i, j in ((x.ahead, a, min(b, turn)), (x.back, max(a, turn + 1), b)):
                        if i <= j:
                            out.append((what, x.bid, x.place, k, i, j))

                put(2, low, high)
                if x.n > 1:  # stands twice: all its windows repeat
                    continue
                at = low
                for a, b in sorted(map(tuple, np.concatenate([np.frombuffer(p, np.int32) for p in x.proofs] or [np.zeros(0, np.int32)]).reshape(-1, 2).tolist())):
                    if a > at:
                        put(1, at, min(a - 1, high))
                    if b >= max(a, at):
                        out.append((0, x.bid, x.place, 0, max(a, at), b))
                        at = b + 1
                    if at > high:
                        break
                if at <= high:
                    put(1, at, high)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SETTLED.split(", ")])

    return run


WINDOW = "core long, whole long, bid long, doc int, span long"


def _asked(lengths: tuple[int, int | None]):
    """The windows a <= d <= b of contexts, one by one."""

    def run(held: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        one, two, out = Rolling(1), Rolling(2), [pd.DataFrame(columns=[c.split()[0] for c in WINDOW.split(", ")])]
        rows = held.merge(ask[["place", "a", "b"]], on="place")
        for kind, every in rows.groupby("kind"):
            for at in range(0, len(every), 1000):
                some = every.iloc[at : at + 1000]
                dtype = np.uint64 if kind else np.uint8
                texts = [np.concatenate([np.frombuffer(l, dtype)[::-1], np.frombuffer(r, dtype)]) for l, r in zip(some["l"], some["r"], strict=True)]
                size = np.array([len(l) for l in some["l"]], np.int64) // dtype().itemsize
                base = np.cumsum([0, *map(len, texts)])[:-1] + size
                units = np.concatenate(texts)
                one.load(units)
                two.load(units)
                a, b = some["a"].to_numpy(np.int64), some["b"].to_numpy(np.int64)
                which, d = _runs(a, b - a + 1)
                core, whole = _window_keys(one, two, base[which] - d, lengths[kind])
                place = some["place"].to_numpy(np.int64)[which]
                out.append(pd.DataFrame({"core": core, "whole": whole, "bid": some["bid"].to_numpy(np.int64)[which], "doc": place >> 33, "span": _span(_at(place) - d, 1, kind)}))
        release()
        return pd.concat(out[1:] or out)

    return run


def _span(start, n, kind):
    """Of n windows from start on; Spark columns or numbers."""
    return start * (1 << 25) + (kind * (1 << 24) + n)


MARK = "what int, part int, core long, whole long, bid long, doc int, span long"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """what 0: windows that a neighbour equals; 1, 2: the first and the last of a partition."""
    part, last = TaskContext.get().partitionId(), None
    names = [c.split()[0] for c in MARK.split(", ")]
    for batch in batches:
        if not len(batch):
            continue
        if last is None:
            yield batch.iloc[:1].assign(what=1, part=part)[names]
        rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
        core, whole = rows["core"].to_numpy(np.int64), rows["whole"].to_numpy(np.int64)
        same = (core[1:] == core[:-1]) & (whole[1:] == whole[:-1])
        no = np.zeros(1, bool)
        yield rows[np.concatenate([no, same]) | np.concatenate([same, no])].assign(what=0, part=part)[names]
        last = rows.iloc[-1:]
    if last is not None:
        yield last.assign(what=2, part=part)[names]


def _equal(windows: DataFrame) -> DataFrame:
    """(bid, doc, span) of the windows that equal another one; some may come twice."""
    spark, order = windows.sparkSession, ["core", "whole", "bid", "doc", "span"]
    dealt = windows.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = stored(dealt.mapInPandas(_neighbours, MARK), "windows")
    ends = marks.where("what > 0").collect()  # two rows a partition
    firsts, lasts = ({r["part"]: r for r in ends if r["what"] == w} for w in (1, 2))
    parts, more = sorted(firsts), []
    for left, right in zip(parts, parts[1:], strict=False):
        a, b = lasts[left], firsts[right]
        if (a["core"], a["whole"]) == (b["core"], b["whole"]):
            more += [(r["bid"], r["doc"], r["span"]) for r in (a, b)]
    return marks.where("what = 0").select("bid", "doc", "span").union(spark.createDataFrame(more, "bid long, doc int, span long"))


def _repeats(blocks: DataFrame, text_col: str, length: int, words: int | None, light: bool) -> DataFrame:
    """(bid, doc, span) of windows that repeat."""
    lengths, parts = (length, words), shuffle_partitions(blocks.sparkSession)
    left, twice = _contexts(blocks, _parsed(text_col, length, words, light))
    doc, at, kind = F.expr("cast(place >> 33 as int)"), F.expr("(place >> 1) & 4294967295"), F.expr("place & 1")
    before, behind = F.expr("lr >> 32"), F.expr("lr & 4294967295")
    low = F.greatest(F.lit(0), F.when(kind == 1, F.lit(words or 0)).otherwise(F.lit(length)) - behind)
    span = F.when(F.col("lr") < 0, _span(at, F.lit(1), kind)).otherwise(_span(at - before, before - low + 1, kind))
    whole = twice.select("bid", doc.alias("doc"), span.alias("span"))
    fetched = blocks.groupBy("bid").cogroup(left.groupBy("bid")).applyInPandas(_fetched(text_col, lengths), CONTEXT)
    contexts = stored_by(fetched, "suffixes", "bid", parts)
    phrases = _array(contexts, lengths, False, "phrase_order").select("bid", "place", "mm")
    told = _array(contexts, lengths, True, "parse_order").unionByName(phrases, allowMissingColumns=True)
    scalars = [F.max(c).alias(c) for c in ("kind", "n", "ahead", "back", "before", "behind", "m", "mm")]
    each = told.groupBy("bid", "place").agg(*scalars, F.collect_list("proof").alias("proofs"))
    settled = stored(each.mapInPandas(_settled(lengths), SETTLED), "settled")
    proven = settled.where("what = 0").select("bid", doc.alias("doc"), _span(at - F.col("b"), F.col("b") - F.col("a") + 1, kind).alias("span"))
    open_ = settled.where("what = 1").groupBy("k").agg(F.min("a").alias("_a"), F.max("b").alias("_b"))
    ask = (
        settled.where("what = 2").join(open_, "k")
        .select("bid", "place", F.greatest("a", "_a").alias("a"), F.least("b", "_b").alias("b")).where("a <= b")
    )
    looked = contexts.groupBy("bid").cogroup(ask.groupBy("bid")).applyInPandas(_asked(lengths), WINDOW)
    return reduce(DataFrame.union, [whole, proven, _equal(looked)])


def _spans(marks: np.ndarray, length: int, words: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Maximal runs (start, end) that windows of bytes cover, in bytes; those that windows of words cover, in words."""
    out = []
    for kind, width in ((0, length), (1, words)):
        some = marks[(marks >> 24) & 1 == kind]
        a, n = some >> 25, some & ((1 << 24) - 1)
        b = a + n - 1 + (width or 0)
        order = np.lexsort([b, a])
        out.append(_merged(a[order], b[order]))
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    top = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > top[:-1]])
    return a[new], top[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(a) - 1]])]


def _kept(text_col: str, length: int, words: int | None, remove_words: bool):
    def one(text: bytes, marks: np.ndarray) -> tuple:
        (a, b), (first, upto) = _spans(marks, length, words)
        if remove_words and len(first):
            start, end = word_edges(np.frombuffer(text, np.uint8))
            x, y = np.concatenate([a, start[first]]), np.concatenate([b, end[upto - 1]])
            order = np.lexsort([y, x])
            a, b = _merged(x[order], y[order])
        starts, ends = [0, *b.tolist()], [*a.tolist(), len(text)]
        kept = b"".join(text[i:j] for i, j in zip(starts, ends, strict=True))
        return len(text), len(text) - len(kept), len(a), kept, int((upto - first).sum())

    def run(block: pa.Table, marks: pa.Table) -> pa.Table:
        held = _table(block.column("body")[0].as_py())
        doc, span = (marks.column(c).to_numpy().astype(np.int64) for c in ("doc", "span"))
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(held.num_rows + 1))
        span = span[order]
        rows = [one(t, span[edges[k] : edges[k + 1]]) for k, t in enumerate(_texts(held, text_col))]
        held = held.drop_columns([text_col])
        for (name, kind), of in zip(ADDED.items(), zip(*rows, strict=True), strict=True):
            held = held.append_column(pa.field(name, kind), pa.chunked_array([pa.array(of, kind)]))
        release()
        return held.combine_chunks()

    return run


ADDED = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "n_passage_words": pa.int64()}


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", words: int | None = None, passages: int | None = None) -> DataFrame:
    """docs without the text, and n_bytes, n_removed, n_spans, kept (binary): each text without the bytes that a string of
    `length` bytes, or of `words` words, covers that also starts anywhere else. passages: strings of that many words are looked for, but
    not removed; n_passage_words counts the words that they, or those of `words` words, cover."""
    if length < 4 * BYTES[0]:
        raise ValueError(f"length must be {4 * BYTES[0]} at least")
    if words is not None and passages is not None:
        raise ValueError("words are removed or counted, not both")
    if (n := words or passages) is not None and n < 4 * WORDS[0]:
        raise ValueError(f"words must be {4 * WORDS[0]} at least")
    own = [f"_rep_{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index(text_col)]
    renamed = docs.toDF(*own)
    held = _blocks(renamed, text)
    marks = _repeats(held, text, length, n, words is not None)
    rest = renamed.drop(text)
    added = "n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long"
    schema = StructType([*rest.schema.fields, *StructType.fromDDL(added).fields])
    done = held.groupBy("bid").cogroup(marks.groupBy("bid")).applyInArrow(_kept(text, length, n, words is not None), schema)
    return done.toDF(*[c for c in docs.columns if c != text_col], *ADDED)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", words: int | None = None) -> DataFrame:
    """docs, all columns, with repeated bytes taken out of the text (and n_chars, where there is one, counted anew). A character that
    loses some of its bytes goes whole."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index(text_col)]
    bare = without_repeats(docs.toDF(*own), length, text, words)
    whole = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("utf-8", "ignore")), "string")
    done = bare.withColumn(text, whole("kept"))
    if "n_chars" in docs.columns:
        n = own[docs.columns.index("n_chars")]
        done = done.withColumn(n, F.length(text).cast(docs.schema["n_chars"].dataType))
    return done.select(*own).toDF(*docs.columns)


def op8_query(spark, sf_dir: str) -> DataFrame:
    """Bytes go by strings of 400 bytes; n_passage_words tells of passages of over 50 words, most of which are shorter than that."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=51).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words"
    )
