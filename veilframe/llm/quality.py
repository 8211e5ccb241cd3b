"""Quality rules with thresholds learnt from mergeable quantile sketches.

Each metric is an integer, a ratio in thousandths. A sketch is a table of (group, metric, value, count), its values rounded down to
DIGITS binary digits: quantiles have a relative error below 1/64 at any size, a group has some hundred values at most, whatever
the ratios are, and merging is the addition of counts, exact whatever the order. Sketches are kept for each (lang, source),
merged into one for each lang and one for all; a group with fewer than MIN_DOCS documents uses the next wider one. A document is rejected where a metric exceeds q75 + FENCE * max(q75 - q25, FLOOR[metric]) of its
group: quartiles stay put while less than a quarter of a group is junk. Everything is DataFrame expressions.

Defined cases: null or blank text has no words and fails the base rule; null lang or source is a group of its own; ties
with a threshold are kept; repeated rows are judged alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import BLANK, let, stored, table

WINDOW = 8
MIN_DOCS = 200
FENCE = 6
#: The least quartile distance of a metric, in thousandths: below it a group is too even to judge by its spread.
FLOOR = {"symbols": 15, "dup_lines": 40, "upper": 40, "shouts": 15}
#: Binary digits that a sketch keeps of a value.
DIGITS = 7


def repeated_words(words: Column, n_words: Column) -> Column:
    """How many words stand in WINDOW-word windows that are found twice or more in the text."""

    def count(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, i: ((i > 0) & (x["g"] == F.get(s, i - 1)["g"]))
                    | (F.coalesce(x["g"] == F.get(s, i + 1)["g"], F.lit(False))),
                ),
                lambda x: x["i"],
            ),
        )
        return let(
            F.sort_array(twice),
            lambda at: F.aggregate(
                F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ),
        )

    grams = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.sequence(F.lit(0), n_words - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        ),
    )
    return F.when(n_words <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(
            grams,
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(count(g)),
        )
    )


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _n_upper, _n_shouts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    core = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = docs.withColumn("_words", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK)))
    out = out.withColumn("_n_words", F.size("_words").cast("long"))
    counted = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("_n_symbols"),
        counted.cast("long").alias("_n_dup_lines"),
        F.size(F.split(text, "\n")).cast("long").alias("_n_lines"),
        repeated_words(F.col("_words"), F.size("_words")).alias("_n_repeat_words"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("_n_upper"),
        F.regexp_count(text, F.lit(r"!")).cast("long").alias("_n_shouts"),
    )


BASE_FAILED = "(_n_words < 20 OR 100 * _n_repeat_words > 30 * _n_words)"
METRICS = {
    "symbols": "(1000 * _n_symbols) div greatest(1, _n_words)",
    "dup_lines": "(1000 * _n_dup_lines) div greatest(1, _n_lines)",
    "upper": "(1000 * _n_upper) div greatest(1, _word_chars)",
    "shouts": "(1000 * _n_shouts) div greatest(1, _n_words)",
}


def rounded(value: Column) -> Column:
    """A sketch's value of a metric's value."""
    return let(F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0)), lambda cut: F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut))



def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, value, n) of the documents that pass the base rule."""
    good = measured.where(f"NOT {BASE_FAILED}").select(
        "lang", "source", *[rounded(F.expr(e)).alias(f"m_{m}") for m, e in METRICS.items()]
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m_{m}").alias("value")) for m in METRICS]))
    return (
        good.select("lang", "source", pairs.alias("x"))
        .groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _docs, one limit for each metric) from a sketch with those keys."""
    group = Window.partitionBy(*keys, "metric")
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.select("*", F.sum("n").over(upto).alias("_upto"), F.sum("n").over(group).alias("_all"))
    quart = ranked.groupBy(*keys, "metric").agg(
        F.min(F.when(4 * F.col("_upto") >= F.col("_all"), F.col("value"))).alias("q25"),
        F.min(F.when(4 * F.col("_upto") >= 3 * F.col("_all"), F.col("value"))).alias("q75"),
        F.max("_all").alias("_all"),
    )
    floor = reduce(lambda acc, m: acc.when(F.col("metric") == m, FLOOR[m]), METRICS, F.when(F.lit(False), 0))
    limit = F.col("q75") + FENCE * F.greatest(F.col("q75") - F.col("q25"), floor)
    return quart.groupBy(*keys).agg(
        F.max("_all").alias("_docs"),
        *[F.max(F.when(F.col("metric") == m, limit)).alias(f"_limit_{m}") for m in METRICS],
    )


def judged(measured: DataFrame, sketch: DataFrame) -> DataFrame:
    """Add base_failed and kept. The sketches are small beside the documents: some hundred values for each group."""
    levels = [(sketch, ["lang", "source"]), (merged(sketch, ["lang"]), ["lang"]), (merged(sketch, []), [])]
    out = measured
    for depth, (level, keys) in enumerate(levels):
        found = limits(level, keys)
        named = found.select(
            *[F.col(k).alias(f"_k{depth}_{k}") for k in keys],
            F.col("_docs").alias(f"_docs{depth}"),
            *[F.col(f"_limit_{m}").alias(f"_l{depth}_{m}") for m in METRICS],
        )
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{depth}_{k}")) for k in keys], F.lit(True))
        # the widest level is one row
        out = out.join(named if keys else F.broadcast(named), on, "left")
    pick = [F.col("_docs0") >= MIN_DOCS, F.col("_docs1") >= MIN_DOCS, F.lit(True)]

    def limit(m: str) -> Column:
        value = F.when(pick[0], F.col(f"_l0_{m}"))
        for depth in (1, 2):
            value = value.when(pick[depth], F.col(f"_l{depth}_{m}"))
        return value

    bad = reduce(lambda a, b: a | b, [F.coalesce(F.expr(e) > limit(m), F.lit(False)) for m, e in METRICS.items()])
    return out.select(
        *[F.col(f"`{c}`") for c in measured.columns],
        F.expr(BASE_FAILED).alias("base_failed"),
        (~F.expr(BASE_FAILED) & ~bad).alias("kept"),
    )


FEATURES = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_lines", "_n_repeat_words", "_n_upper", "_n_shouts"]


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every document."""
    narrow = with_features(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", *FEATURES)
    measured = stored(narrow, "quality")  # a few numbers for each document; read for the sketches and for the verdict
    return judged(measured, sketches(measured))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns as they were."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    # clashing names of further columns can't meet ours: they are renamed while the rules run
    renamed = docs.toDF(*own)
    at = {c.lower(): own[i] for i, c in enumerate(docs.columns) if c in ("doc_id", "text", "lang", "source")}
    wide = renamed.select("*", *[F.col(at[c]).alias(c) for c in ("text", "lang", "source")])
    measured = stored(with_features(wide), "measured")  # counted once, for the sketches and for the verdict
    sketch = stored(sketches(measured), "sketch")  # so small that its limits are broadcast, and documents don't move
    return judged(measured, sketch).where("kept").select(*own).toDF(*docs.columns)


def op10_query(spark, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"),
        "base_failed",
        "kept",
    )
