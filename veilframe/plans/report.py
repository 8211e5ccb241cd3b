"""Sinks of results, cached reports, and the scorecard."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veilframe.functions.features import mapped


def write_csv(df: DataFrame, path: str) -> str:
    """A single CSV file of that name, with a heading: for summaries, not for rows of ratings."""
    spark, part = df.sparkSession, f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").csv(part, header=True)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, to = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    made = next(s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
    files.delete(to, True)
    files.rename(made, to)
    files.delete(folder, True)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_all(folder: str, csv: bool = True, **tables: DataFrame) -> list[str]:
    put, ending = (write_csv, ".csv") if csv else (write_parquet, ".parquet")
    return [put(df, f"{folder}/{name}{ending}") for name, df in tables.items()]


#: Names of the files of a sweep over noise, and of predictions for held-out pairs.
SWEEP_FILES = ("noise_attack_raw_results", "noise_attack_summary", "noise_attack_main_table")
PREDICTIONS_FILE = "probe_predictions_als"


def write_sweep(folder: str, raw: DataFrame, summary: DataFrame, main: DataFrame) -> list[str]:
    return write_all(folder, **dict(zip(SWEEP_FILES, (raw, summary, main), strict=True)))


def write_predictions(folder: str, predictions: DataFrame) -> list[str]:
    """Predictions for held-out pairs grow with the data: a folder of Parquet files."""
    return write_all(folder, csv=False, **{PREDICTIONS_FILE: predictions})


def print_json(report: dict) -> str:
    text = json.dumps(report, indent=2, sort_keys=True)
    print(text)
    return text


def cached(spark, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made first if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        write_parquet(compute(), path)
        return spark.read.parquet(path)


def version_tagged(summary: DataFrame, version: str = "original_non_anonymized") -> DataFrame:
    """A summary with the version of the data set that it is about."""
    return summary.withColumn("dataset_version", F.lit(version))


LABELS = {
    "original_movie_rating_month": "Original",
    "remove_month": "No month",
    "year_only": "Year only",
    "coarsen_rating": "Coarse rating",
    "remove_month_and_coarsen_rating": "No month, coarse rating",
    "add_rating_noise": "Noisy rating",
    "movie_only": "Movie only",
}
NUMBERED = {"^remove_rare_movies_min_([0-9]+)(?:_users)?$": "No rare movies, users >= ", "^k_suppress_movie_rating_month_k([0-9]+)$": "Suppressed, k >= "}


def presented(summary: DataFrame, column: str = "release_name") -> DataFrame:
    """Readable names, in the order of the list; those of the two releases with a number in their name carry it."""
    place = F.coalesce(*[F.when(F.col(column) == k, i) for i, k in enumerate(LABELS)], F.lit(len(LABELS)))
    label = mapped(F.col(column), LABELS)
    for pattern, text in NUMBERED.items():
        number = F.regexp_extract(column, pattern, 1)
        label = F.when(number != "", F.concat(F.lit(text), number)).otherwise(label)
    return summary.withColumn("_place", place).orderBy("_place", column).withColumn("label", label).drop("_place")


def scorecard(utility: DataFrame, attack: DataFrame, neighbours: DataFrame | None = None, n_known: int = 3) -> DataFrame:
    """Utility, candidate-set risk at n_known facts and nearest-neighbour risk of each release, best utility first."""
    risk = attack.where(F.col("n_known") == n_known).select("release_name", "pct_unique", "avg_surety_pct", "avg_candidate_size")
    out = utility.join(risk, "release_name", "left")
    if neighbours is not None:
        out = out.join(neighbours, "release_name", "left")
    return out.orderBy(F.col("rmse").asc_nulls_last(), "release_name")


def pivoted(summary: DataFrame, rows: str, columns: str, value: str) -> DataFrame:
    return summary.groupBy(rows).pivot(columns).agg(F.first(value))
