"""Document fingerprints of closed syncmers.

A K-word window is kept when the smallest hash among its S-word windows is its first or its last: the choice depends on
nothing outside the window, so an edit changes only the K-word windows that touch it and equal passages keep equal anchors
wherever they stand. A fingerprint is the list of kept windows in text order, each as eight hex digits of its hash, a colon and
its distance in words to the next one (0 for the last). A text with words that keeps no window, or has fewer than K words, has
the hash of its whole word sequence.

Two anchors match when their hashes and the distances to the next anchors agree: that is a comparison by position which an edit
elsewhere doesn't shift. The likeness of two fingerprints is the share of anchors that match, repeats counted: matched over all
of both less matched, and 1 for two empty ones. Everything is DataFrame expressions.

Defined cases: null text counts as empty; texts without words have the empty fingerprint; repeated rows and equal ids are
ordered by text; an empty table gives no rows; further columns are ignored. Words are what blanks part, so a text without
blanks is one word and alike only to its equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import BLANK, let, shuffle_partitions, table

K, S = 5, 2


#: An anchor is one number, 2**GAP_BITS times its hash plus its distance to the next one.
GAP_BITS = 31


def anchors(text: Column) -> Column:
    """array<bigint> of the kept windows in text order. text: not null."""
    core = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    inner = K - S + 1

    def of_words(h: Column) -> Column:
        small = F.transform(
            F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)])
        )
        closed = let(
            small,
            lambda m: F.filter(
                F.sequence(F.lit(0), F.size(h) - K),
                lambda i: F.least(F.get(m, i), F.get(m, i + (inner - 1)))
                <= F.least(*[F.get(m, i + j) for j in range(1, inner - 1)]),
            ),
        )
        kept = let(
            closed,
            lambda at: F.transform(
                at,
                lambda i, n: F.shiftleft(F.xxhash64(*[F.get(h, i + j) for j in range(K)]).bitwiseAND(F.lit(0xFFFFFFFF)), GAP_BITS)
                + F.coalesce(F.get(at, n + 1) - i, F.lit(0)),
            ),
        )
        total = F.aggregate(h, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)).bitwiseAND(F.lit(0xFFFFFFFF))
        whole = F.array(F.shiftleft(total, GAP_BITS))
        some = let(kept, lambda k: F.when(F.size(k) == 0, whole).otherwise(k))
        return F.when(F.size(h) < K, whole).otherwise(some)

    words = F.split(core, BLANK)
    none = F.array().cast("array<bigint>")
    return F.when(core == "", none).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_words))


def fingerprint(marks: Column) -> Column:
    def spelt(x: Column) -> Column:
        gap = x.bitwiseAND(F.lit((1 << GAP_BITS) - 1))
        return F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, GAP_BITS))), 8, "0"), F.lit(":"), gap.cast("string"))

    return F.array_join(F.transform(marks, spelt), " ")


def likeness(a: Column, b: Column) -> Column:
    """Where no anchor repeats, matches are the intersection. Else each gets a last bit for its side; in the sorted numbers of both,
    equal ones are a run, and a match is the smaller of two runs that differ in that bit alone: linear but for the sort, however
    often an anchor repeats."""

    def numbers(marks: Column, side: int) -> Column:
        return F.transform(marks, lambda x: F.shiftleft(x, 1).bitwiseOR(F.lit(side).cast("long")))

    def matched(s: Column) -> Column:
        def of_runs(at: Column) -> Column:
            def smaller(p: Column, k: Column) -> Column:
                then, end = F.get(at, k + 1), F.coalesce(F.get(at, k + 2), F.size(s))
                return F.when((F.get(s, p) % 2 == 0) & (F.get(s, then) == F.get(s, p) + 1), F.least(then - p, end - then)).otherwise(F.lit(0))

            return F.aggregate(F.transform(at, smaller), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))

        runs = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(runs, of_runs)

    total = F.size(a) + F.size(b)
    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    runs_of_both = let(F.sort_array(F.concat(numbers(a, 0), numbers(b, 1))), matched)
    both = F.when(once, F.size(F.array_intersect(a, b))).otherwise(runs_of_both).cast("double")
    return F.when(total == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.greatest(total, F.lit(1)) - both))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The general operator: docs with `anchors` and `fingerprint`."""
    marked = docs.withColumn("anchors", anchors(F.coalesce(F.col(text_col), F.lit(""))))
    return marked.withColumn("fingerprint", fingerprint(F.col("anchors")))


def id_ranges(docs: DataFrame, parts: int) -> Column:
    """A column that cuts doc_id into about `parts` ranges in ascending order, a function of doc_id alone.

    Up to 255 quantile bounds, found in one scan of the ids, are searched by a tree of comparisons; between two bounds the ids
    are cut evenly.
    """
    leaves = min(parts, 256)
    each = -(-parts // leaves)
    found = docs.agg(
        F.min("doc_id").alias("lo"),
        F.max("doc_id").alias("hi"),
        F.percentile_approx("doc_id", [k / leaves for k in range(1, leaves)] or [0.5], 10000).alias("at"),
    ).first()
    if found["lo"] is None:
        return F.lit(0).cast("long")
    bounds = [found["lo"], *sorted({b for b in found["at"] if found["lo"] < b <= found["hi"]}), found["hi"] + 1]

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            step = max(1, -(-(bounds[hi] - bounds[lo]) // each))
            return F.lit(lo * each) + F.expr(f"(doc_id - ({bounds[lo]}L)) div {step}L")
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid, hi))

    return F.coalesce(search(0, len(bounds) - 1), F.lit(-1)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, anchors, next_text, next_anchors); next: by descending doc_id, after the last the first."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = base.withColumn("part", id_ranges(base, 8 * n))
    # the first row of each range (one row a range) is also put after the last row of the range before it
    heads = ranged.groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "text")).alias("h"))
    desc = Window.orderBy(F.col("part").desc())
    before = F.coalesce(F.lag("part").over(desc), F.first("part").over(Window.orderBy("part")))
    tails = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("h.text").alias("text"), before.alias("part"), F.lit(True).alias("tail"))
    rows = ranged.select("doc_id", "text", "part", F.lit(False).alias("tail")).unionByName(tails)
    # anchors are made after the exchange, so that it carries texts alone
    dealt = rows.repartitionByRange(n, "part").withColumn("anchors", anchors(F.col("text")))
    along = Window.partitionBy("part").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return (
        dealt.withColumn("next_text", F.lead("text").over(along))
        .withColumn("next_anchors", F.lead("anchors").over(along))
        .where(~F.col("tail"))
        .select("doc_id", "text", "anchors", "next_text", "next_anchors")
    )


def op4_query(spark, sf_dir: str) -> DataFrame:
    chain = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    made = chain.withColumn("edited", edited).withColumn("edited_anchors", anchors(F.col("edited")))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
