"""SimHash near-duplicates by generalised pigeonhole search.

The 64 bits of a fingerprint are put in m groups, correlated bits together. Where two fingerprints differ in at most T bits,
any thresholds t_1..t_m with sum T - m + 1 have a group in which they differ in at most t_i bits (-1: the group is not
probed). Each fingerprint takes its own thresholds: a small dynamic program over the groups minimises the probes it sends
plus the candidates it will meet, estimated from the counts of group values. It probes every value within t_i of its own, and
candidates are verified on all 64 bits.

A group value that more than HOT fingerprints share is not paired up. Fingerprints that probe or hold one go another exact way,
linear in their number: two fingerprints differ in at most 2 bits if and only if some third word differs in at most one bit
from each, so each fingerprint is keyed by itself and its 64 one-bit neighbours, and a key (65 fingerprints at most) links its
own to the least. Only distinct fingerprints take part, so copies of a text cost one. T over 2 takes as many such steps as
needed: it is refused here.

Defined cases: null text counts as empty; texts without words have fingerprint zero and are linked like any other; repeated
rows are members of one class; a null id never names a class that has another; an empty table gives no rows; further columns
are ignored by `near_duplicates` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.blocks import release
from veilframe.llm.common import Scratch, stored, table
from veilframe.llm.components import components

BITS, SEED, HOT = 64, 42, 48


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def simhash(text: str | None, width: int = 3) -> int:
    words = word_list(text)
    return int(_majority(shingle_hashes(words, width))) if words else 0


def _majority(hashes: np.ndarray) -> np.uint64:
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*[words[k:] for k in range(width)], strict=False)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.uint64, len(words) - width + 1)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = np.fromiter((simhash(t or "", width) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": got.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, so that nulls stay apart from ids
    return rows.mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


def bit_groups(fps: DataFrame, m: int, width: int = BITS) -> list[list[int]]:
    """m groups of near-equal size, correlated bits together, from the joint counts of all fingerprints."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS), np.float64), 0
        for b in batches:
            for at in range(0, len(b), 50_000):
                part = b["fp"].to_numpy(np.int64)[at : at + 50_000].view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": i, "j": j, "both": both[i, j].astype(np.int64), "n": n})

    sums = fps.mapInPandas(count, "i int, j int, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("x"), F.sum("n").alias("n"))
    got = sums.toPandas()  # 2,080 rows, whatever the input
    joint, n = np.zeros((BITS, BITS)), max(1, int(got["n"].max()) if len(got) else 1)
    joint[got["i"], got["j"]] = joint[got["j"], got["i"]] = got["x"] / n
    mean = np.diag(joint)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    alike = np.abs((joint - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(alike, 0)
    free, groups = list(range(width)), []
    for size in [width // m + (k < width % m) for k in range(m)]:
        own = [max(free, key=lambda b: (alike[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (alike[b, own].sum(), -b)))
            free.remove(own[-1])
        groups.append(sorted(own))
    return groups


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in some)) for e in range(most + 1) for some in combinations(bits, e)]


def allocation(counts: list[Column], groups: list[list[int]], distance: int, n: int) -> Column:
    """array<int>: each group's threshold, by dynamic programming over the groups; cost: probes sent and candidates met."""
    budget = distance - len(groups) + 1

    def cost(k: int, e: int) -> Column:
        if e < 0:
            return F.lit(0.0)
        probes = len(_flips(groups[k], e))
        return F.lit(probes + (probes - 1) * n / 2.0 ** len(groups[k])) + counts[k]

    best = {0: F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("t"))}
    for k in range(len(groups)):
        new: dict[int, list[Column]] = {}
        for spent, got in best.items():
            for e in range(-1, distance + 1):
                rest = len(groups) - 1 - k
                if spent + e - rest <= budget <= spent + e + rest * distance:
                    step = F.struct((got["cost"] + cost(k, e)).alias("cost"), F.concat(got["t"], F.array(F.lit(e))).alias("t"))
                    new.setdefault(spent + e, []).append(step)
        best = {s: F.least(*x) if len(x) > 1 else x[0] for s, x in new.items()}
    return best[budget]["t"]


def links(fps: DataFrame, distance: int = 2, width: int = BITS, hot_from: int = HOT) -> DataFrame:
    """(r, a, b): edges whose components are those of all pairs of fingerprints with the same r that differ in at most `distance` of
    their `width` bits.

    fps: r int, fp long (no bit beyond width), distinct, written.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distances from 0 to 2 have an exact way for hot values")
    n = max([r["count"] for r in fps.groupBy("r").count().collect()], default=0)  # one row for each kind of fingerprint
    # three groups hold few fingerprints in a value up to 16 times as many values, beyond that two groups do
    groups = bit_groups(fps, 3 if n < 16 << (width // 3) else 2, width)
    masks = [_signed(sum(1 << b for b in g)) for g in groups]
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("g"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for k, x in enumerate(masks)]))
    held = fps.select("r", "fp", values.alias("x")).select("r", "fp", "x.g", "x.v")
    key = ["r", "g", "v"]
    sizes = stored(held.groupBy(*key).agg(F.count(F.lit(1)).alias("c")), "values")
    own = held.join(sizes, key).groupBy("r", "fp").agg(
        *[F.max(F.when(F.col("g") == k, F.col("c"))).cast("double").alias(f"c{k}") for k in range(len(groups))]
    )
    asked = own.withColumn("t", allocation([F.col(f"c{k}") for k in range(len(groups))], groups, distance, n))
    flips = [[F.array(*[F.lit(x) for x in _flips(g, e)]) for e in range(distance + 1)] for g in groups]

    def probes(k: int) -> Column:
        value, none = F.col("fp").bitwiseAND(F.lit(masks[k])), F.array().cast("array<struct<g:int,v:bigint>>")
        out = F.when(F.col("t")[k] < 0, none)
        for e in range(distance + 1):
            made = F.transform(flips[k][e], lambda f: F.struct(F.lit(k).alias("g"), value.bitwiseXOR(f).alias("v")))
            out = out.when(F.col("t")[k] == e, made)
        return out

    sent = asked.select("r", "fp", F.explode(F.concat(*[probes(k) for k in range(len(groups))])).alias("x")).select(
        "r", F.col("fp").alias("q"), "x.g", "x.v"
    )
    # values that one fingerprint alone holds and asks for are left out: it would only meet itself
    met = stored(
        sent.join(sizes, key).where((F.col("c") > 1) | (F.col("v") != F.col("q").bitwiseAND(_mask(masks)))), "probes"
    )
    cool = held.join(sizes.where(F.col("c") <= hot_from), key, "left_semi")
    differ = F.bit_count(F.col("q").bitwiseXOR(F.col("fp")))
    near = (
        met.where(F.col("c") <= hot_from)
        .join(cool, key)
        .where((F.col("q") != F.col("fp")) & (differ <= distance))
        .select("r", F.col("q").alias("a"), F.col("fp").alias("b"))
    )
    hot = met.where(F.col("c") > hot_from)
    some = hot.select("r", F.col("q").alias("fp")).union(
        held.join(hot.select(*key).distinct(), key, "left_semi").select("r", "fp")
    ).distinct()
    keys = F.array(F.lit(0), *([F.lit(_signed(1 << b)) for b in range(width)] if distance else []))
    keyed = some.select("r", "fp", F.explode(F.transform(keys, lambda f: F.col("fp").bitwiseXOR(f))).alias("z"))
    if distance == 1:  # two that differ in one bit: the key is one of them
        keyed = keyed.join(some.select("r", F.col("fp").alias("z")), ["r", "z"], "left_semi")
    star = keyed.groupBy("r", "z").agg(F.collect_list("fp").alias("of")).where(F.size("of") > 1)  # width + 1 at most
    starred = star.select("r", F.array_min("of").alias("a"), F.explode("of").alias("b")).where("a <> b")
    return near.union(starred).distinct()


def _mask(masks: list[int]) -> Column:
    out = F.when(F.col("g") == 0, F.lit(masks[0]))
    for k, x in enumerate(masks[1:], 1):
        out = out.when(F.col("g") == k, F.lit(x))
    return out


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs."""
    with Scratch(docs.sparkSession) as work:
        marked = work.keep(fingerprints(docs, width), "simhash")
        distinct = stored(marked.select(F.lit(0).alias("r"), "fp").distinct(), "distinct")
        roots = components(links(distinct, distance).select("a", "b"))
        named = distinct.join(roots, distinct["fp"] == roots["a"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
        least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
        by_root = named.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
        classes = work.keep(named.join(by_root, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Of `one_of_each`: words of a shingle, bands of a text, the chance that a pair at the asked similarity shares one, and verified
#: pairs that one task settles in one pass.
WORDS, BANDS, FOUND, FEW = 5, 20, 0.99, 50_000


def band_rows(similarity: float) -> int:
    """Least hashes of a band: as many as leave a pair at `similarity` a chance of FOUND to share one of BANDS."""
    return max([1, *(r for r in range(1, 13) if 1 - (1 - similarity**r) ** BANDS >= FOUND)])


def band_values(text: str | None, similarity: float) -> np.ndarray:
    """BANDS numbers. A least hash agrees with a chance of the Jaccard index itself, wherever the edits lie."""
    words, r = word_list(text), band_rows(similarity)
    if not words:
        return np.zeros(BANDS, np.int64)
    rng = np.random.default_rng(SEED)
    by, turn = (rng.integers(0, 2**63, BANDS * r, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    h, least = shingle_hashes(words, WORDS), np.full(BANDS * r, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 512):  # bounds the hashes of a very long text
        np.minimum(least, ((h[at : at + 512, None] ^ turn) * by).min(0), out=least)
    rows = least.reshape(BANDS, r)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in rows], np.uint64).view(np.int64)


#: Bits of a text's parity sketch, as so many columns of 64.
SKETCH = [f"b{k}" for k in range(16)]


def sketch(text: str | None) -> tuple[int, np.ndarray]:
    """The number of distinct WORDS-word shingles, and for each of 64 * len(SKETCH) cells whether an odd number of these falls into it. A
    cell in which two texts differ holds a shingle that one of them alone has, so the cells that differ are no more than such shingles."""
    words = word_list(text)
    h = np.unique(shingle_hashes(words, WORDS)) if words else np.zeros(0, np.uint64)
    cells = 64 * len(SKETCH)
    odd = np.bincount((h % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return len(h), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_be_alike(similarity: float, a: str = "x", b: str = "y") -> Column:
    """False only where two texts' sketches prove a Jaccard index below `similarity`: with n and m shingles and d that one text alone has, it
    is (n + m - d) / (n + m + d)."""
    col = lambda side, c: F.col(f"{side}.{c}")
    differ = sum((F.bit_count(col(a, c).bitwiseXOR(col(b, c))) for c in SKETCH[1:]), F.bit_count(col(a, SKETCH[0]).bitwiseXOR(col(b, SKETCH[0]))))
    least = F.greatest(differ, F.abs(col(a, "n") - col(b, "n")))
    return least * (1 + similarity) <= (col(a, "n") + col(b, "n")) * (1 - similarity) + 1e-6


def jaccard(a: str | None, b: str | None, width: int = WORDS) -> float:
    x, y = (set(shingle_hashes(w, width).tolist()) if (w := word_list(t)) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def one_of_each(docs: DataFrame, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the copies and near copies of a document that stays.

    Equal texts leave their first row. Texts are near copies when the Jaccard index of their WORDS-word shingles is `similarity` or
    more. They are searched for by SimHash, as in `near_duplicates`: texts whose fingerprints are linked at two bits or fewer are
    candidates. That finds only very close copies, so BANDS bands of least hashes add further candidates: texts that share any
    of these. In the order of the rows, a row goes if a candidate before it that stays is alike to it, and else stays: so a row goes only for a row that stays,
    and no two candidates that stay are alike.

    Each round compares the rows of a band value with its first `most` undecided ones: their sketches where they meet, and the texts of
    those pairs alone whose sketches don't prove that they are not alike. A row that is among these in all its
    bands has met all candidates before it, so the verified pairs decide it, unless they hang on one that isn't. `most`
    grows until no band value is shared by undecided rows: the first round takes the bulk of large groups of near copies in
    linear time, and only rows that are alike to none are compared with each other.
    """
    own = [f"_c{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index(text_col)]
    held = stored(docs.toDF(*own).withColumn("_rid", F.monotonically_increasing_id()), "held")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bands = [band_values(t, similarity) for t in b["text"]]
            sums = [xxhash.xxh128_hexdigest((t or "").encode("utf-8", "surrogatepass")) for t in b["text"]]
            fps = np.fromiter((simhash(t) for t in b["text"]), np.uint64, len(b)).view(np.int64)
            sizes, odd = zip(*[sketch(t) for t in b["text"]], strict=True) if len(b) else ((), np.zeros((0, len(SKETCH)), np.int64))
            release()
            yield pd.DataFrame({"_rid": b["_rid"], "sum": sums, "fp": fps, "bands": bands, "n": sizes} | dict(zip(SKETCH, np.array(odd).T, strict=True)))

    sketched = ", ".join(f"{c} long" for c in ("n", *SKETCH))
    marks = held.select("_rid", F.col(text).alias("text")).mapInPandas(mark, f"_rid long, sum string, fp long, bands array<long>, {sketched}")
    marks = stored(marks, "marks")
    first = marks.groupBy("sum").agg(F.min("_rid").alias("_rid"))
    with Scratch(docs.sparkSession) as work:
        firsts = stored(marks.join(first, ["sum", "_rid"]).drop("sum"), "firsts")
        linked = _linked(firsts.select("_rid", "fp"))
        bands = firsts.select("_rid", F.posexplode("bands").alias("band", "value"))
        shared = work.keep(_shared(bands.union(linked)).join(firsts.select("_rid", "n", *SKETCH), "_rid"), "shared")
    texts = held.select("_rid", F.col(text).alias("text"))
    alike = F.pandas_udf(lambda a, b: pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    gone, most = None, 1
    while not shared.isEmpty():
        with Scratch(docs.sparkSession) as work:
            rank = F.row_number().over(Window.partitionBy("band", "value").orderBy("_rid"))
            heads = stored(shared.withColumn("k", rank).where(F.col("k") <= most).drop("k"), "heads")
            unmet = shared.join(heads, ["band", "value", "_rid"], "left_anti").select("_rid").distinct()
            unmet = stored(unmet, "unmet")
            same = (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & (F.col("x._rid") < F.col("y._rid"))
            met = heads.alias("x").join(shared.alias("y"), same & may_be_alike(similarity))
            pairs = stored(met.select(F.col("x._rid").alias("x"), F.col("y._rid").alias("y")).distinct(), "pairs")
            both = pairs.join(texts.toDF("y", "ty"), "y").join(texts.toDF("x", "tx"), "x")
            near = stored(both.where(alike("tx", "ty") >= similarity).select("x", "y"), "near")
            went, open_ = _decided(near, unmet)
            went, open_ = work.keep(went, "gone"), stored(open_.union(unmet).distinct(), "open")
            gone = went if gone is None else gone.union(went)
            left = shared.join(open_, "_rid", "left_semi").join(went, "_rid", "left_anti")
            shared = work.keep(_shared(left.select(*shared.columns)), "shared")
        most *= 8
    kept = held.join(first.select(F.col("_rid").alias("_f")), F.col("_rid") == F.col("_f"), "left_semi")
    if gone is not None:
        kept = kept.join(gone.select(F.col("_rid").alias("_g")), F.col("_rid") == F.col("_g"), "left_anti")
    return kept.select(*own).toDF(*docs.columns)


def _linked(marks: DataFrame, distance: int = 2) -> DataFrame:
    """(_rid, band, value): the class of a row's fingerprint among all that generalised pigeonhole search links, as a further band."""
    distinct = stored(marks.select(F.lit(0).alias("r"), "fp").distinct(), "distinct")
    roots = components(links(distinct, distance).select("a", "b"))
    named = marks.join(roots, marks["fp"] == roots["a"], "left")
    return named.select("_rid", F.lit(BANDS).alias("band"), F.coalesce("root", "fp").alias("value"))


def _shared(bands: DataFrame) -> DataFrame:
    """The bands' values that more than one row has."""
    many = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return bands.join(many.drop("c"), ["band", "value"], "left_semi")


def _decided(near: DataFrame, unmet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_rid that go, _rid that stay open though met), from the pairs of alike rows x < y; unmet rows may only go or stay open.

    A row that no pair has as y, and that is met, stays, and all y of its pairs go. That is repeated until few pairs are left
    or none changes; few are settled in one pass in the order of y.
    """
    flags = [unmet.select(F.col("_rid").alias(c), F.lit(True).alias(f"{c}_open")) for c in ("x", "y")]
    left = near.join(flags[0], "x", "left").join(flags[1], "y", "left").select("x", "y", *[F.coalesce(f"{c}_open", F.lit(False)).alias(f"{c}_open") for c in ("x", "y")])
    left, gone = stored(left, "left"), near.select(F.col("y").alias("_rid")).limit(0)
    while left.count() > FEW:
        free = left.where(~F.col("x_open")).join(left.select(F.col("y").alias("x")).distinct(), "x", "left_anti")
        went = stored(free.select(F.col("y").alias("_rid")).distinct(), "went")
        if went.isEmpty():
            return gone, left.select(F.col("y").alias("_rid")).distinct()
        gone = gone.union(went)
        for c in ("x", "y"):
            left = left.join(went.withColumnRenamed("_rid", c), c, "left_anti")
        left = stored(left.select("x", "y", "x_open", "y_open"), "left")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        goes: dict[int, bool] = {}  # a row that is not here stays if it is met
        now, stays_before, open_before, is_open = None, False, False, False

        def close() -> None:
            if now is not None and (stays_before or open_before or is_open):
                goes[now] = stays_before

        for b in batches:
            for x, y, xo, yo in zip(*[b[c].tolist() for c in ("x", "y", "x_open", "y_open")], strict=True):
                if y != now:
                    close()
                    now, stays_before, open_before, is_open = y, False, False, yo
                if x not in goes:
                    stays_before, open_before = stays_before or not xo, open_before or xo
                elif not goes[x]:
                    open_before = True
        close()
        yield pd.DataFrame({"_rid": list(goes), "goes": list(goes.values())}).astype({"_rid": "int64", "goes": "bool"})

    said = stored(left.repartition(1).sortWithinPartitions("y").mapInPandas(settle, "_rid long, goes boolean"), "settled")
    return gone.union(said.where("goes").select("_rid")), said.where("not goes").select("_rid")


def op7_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
