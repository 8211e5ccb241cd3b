import io
import zipfile

import pytest

from veilframe.cli import main
from veilframe.sources import files as fs
from veilframe.sources import tables
from veilframe.sources.header_block import read_pairs, read_ratings
from veilframe.sources.html_ratings import extract_ratings, page_rows

from .conftest import RATINGS


def paths(folder):
    return [str(folder / f"combined_data_{k}.txt") for k in (1, 2, 3, 4)]


def test_header_state_ends_with_its_file(spark, data_folder):
    got = read_ratings(spark, paths(data_folder)).collect()
    assert sorted(map(tuple, got)) == sorted(RATINGS)


def test_items_carry_over_splits(spark, tmp_path):
    want = [(m, c, c % 5 + 1, "2005-01-01") for m in range(1, 40) for c in range(m * 100, m * 100 + 57)]
    lines, seen = [], None
    for m, c, r, day in want:
        if m != seen:
            lines.append(f"{m}:")
            seen = m
        lines.append(f"{c},{r},{day}")
    (tmp_path / "a.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = read_ratings(spark, str(tmp_path / "a.txt"))
        assert got.rdd.getNumPartitions() >= 1
        assert sorted(map(tuple, got.collect())) == sorted(want)
        first = read_ratings(spark, str(tmp_path / "a.txt"), max_rows=100)
        assert sorted(map(tuple, first.collect())) == sorted(want[:100])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_folders_of_parts(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text(f"9{k},1,2001-01-01\n{k + 1}:\n10,{k + 1},2005-01-01\n")
    got = read_ratings(spark, str(tmp_path)).select("movie_id", "rating").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2), (3, 3)]


def test_filters_and_pairs(spark, data_folder):
    pairs = read_pairs(spark, str(data_folder / "probe.txt"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 10)]
    assert read_ratings(spark, paths(data_folder), movie_ids=[1]).count() == 3
    assert read_ratings(spark, paths(data_folder), movie_ids=[1], exclude_pairs=pairs).count() == 2
    assert read_ratings(spark, paths(data_folder), include_date=False).columns == ["movie_id", "customer_id", "rating"]


def test_titles_keep_commas(spark, data_folder):
    got = {r.movie_id: (r.year, r.title) for r in tables.read_titles(spark, str(data_folder / "movie_titles.csv")).collect()}
    assert got == {1: (1999, "Night Train"), 2: (None, 'Amélie "x"'), 3: (2001, "Movie, With Comma")}


def test_profile_and_census(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Unnamed: 0,title,year,user,rating\n0,"A, b",(1999),u,8\n1,C,,u,bad\n')
    got = tables.read_profile(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in got] == [("A, b", 1999, "u", 8.0)]
    schema = tables.names_schema("|x\nage: continuous.\nwork-class: Private, State-gov.\n")
    (tmp_path / "c.data").write_text("39, State-gov, <=50K.\n?, Private, >50K\n")
    got = tables.read_census(spark, str(tmp_path / "c.data"), schema).collect()
    assert [tuple(r) for r in got] == [(39.0, "State-gov", "<=50K"), (None, "Private", ">50K")]
    (tmp_path / "z.csv").write_text("Zip,Age\n01234,5\n")
    assert tables.read_people(spark, str(tmp_path / "z.csv")).first().Zip == "01234"


SCRIPT = '<script id="__NEXT_DATA__">{"a": [{"titleText": {"text": "T"}, "releaseYear": {"year": 1999}, "userRating": {"value": 9}}, {"titleText": {"text": "T"}, "releaseYear": {"year": 1999}, "userRating": {"value": 9}}, {"originalTitleText": "S", "rating": 7}]}</script><script>{bad</script>'
ITEM = '<li class="ipc-metadata-list-summary-item"><h3>12. Some Film</h3><span>2001</span><br><span class="ipc-rating-star--rating">7.9</span><span class="ipc-rating-star--rating">4</span></li>'


def test_pages(spark):
    assert page_rows(SCRIPT, "u") == [("T", 1999, "u", 9.0), ("S", None, "u", 7.0)]
    assert page_rows(ITEM + SCRIPT, "u") == [("Some Film", 2001, "u", 4.0)]
    assert page_rows(None, "u") == [] and page_rows("<html>", "u") == []
    pages = spark.createDataFrame([(1, SCRIPT), (2, None)], "page_id int, html string")
    assert extract_ratings(pages).count() == 2


def test_files(data_folder, tmp_path):
    assert fs.verify_files(data_folder)["ok"] and fs.missing_files(tmp_path)
    assert fs.first_folder([tmp_path, data_folder]) == data_folder
    with pytest.raises(FileNotFoundError):
        fs.first_folder([tmp_path])
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        fs.unpack(tmp_path / "evil.zip", tmp_path / "in")
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a/b.txt", "x")
    fs.unpack(tmp_path / "good.zip", tmp_path / "in")
    assert (tmp_path / "in/a/b.txt").read_text() == "x"
    got = fs.download("any", tmp_path / "d.bin", opener=lambda url: io.BytesIO(b"abc"))
    assert got.read_bytes() == b"abc"
    with pytest.raises(ValueError):
        fs.scrape_ratings("ur1", "u", lambda url: "<html>")
    assert fs.ratings_url("https://x/ratings") == "https://x/ratings" and fs.ratings_url("/user/ur7/").endswith("/user/ur7/ratings")
    with pytest.raises(ValueError):
        fs.ratings_url("/")
    (data_folder / fs.PAIRS_FILE).rename(tmp_path / "pairs")
    assert not fs.verify_files(data_folder)["ok"] and fs.verify_files(data_folder, pairs=False)["ok"]
    (tmp_path / "pairs").rename(data_folder / fs.PAIRS_FILE)


def test_commands(spark, data_folder, tmp_path, capsys):
    assert main(["verify-data", "--data", str(data_folder)]) == 0
    (tmp_path / "p.csv").write_text("title,year,user,rating\nThe Night Train,1999,u,10\nMovie With Comma,2001,u,8\n")
    out = str(tmp_path / "out")
    assert main(["linkage-attack", "--data", str(data_folder), "--out", out, "--profile", str(tmp_path / "p.csv"), "--user", "U"]) == 0
    top = spark.read.csv(f"{out}/linkage_U_candidates.csv", header=True).orderBy("rank").first()
    assert top["customer_id"] == "10"
    assert sorted(p.name for p in (tmp_path / "out").glob("*.csv")) == [f"linkage_U_{x}.csv" for x in ("candidates", "facts", "matched_titles")]
    assert all((tmp_path / "out" / f"linkage_U_{x}.csv").is_file() for x in ("candidates", "facts", "matched_titles"))
    assert main(["--data-dir", str(data_folder), "verify-data", "--require-probe"]) == 0
    assert main(["linkage-attack", "--data", str(data_folder), "--out", out, "--profile", str(tmp_path / "p.csv"), "--user", "nobody"]) == 1
    assert "error:" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["privacy-eval", "--trials", "0"])


def test_flags_and_defaults():
    from veilframe.cli import build_parser

    parse = build_parser().parse_args
    demo = parse(["run-demo"])
    assert (demo.rare_min, demo.epochs, demo.top_n, demo.trials, demo.max_rows, demo.user) == (100, 6, 25, 50, 200_000, "planktonrules")
    link = parse(["--output-dir", "o", "linkage-attack", "--no-fuzzy", "--imdb-csv", "p.csv"])
    assert (link.out, link.no_fuzzy, link.profile, link.top_n) == ("o", True, "p.csv", 50)
    rmse = parse(["rmse-eval", "--holdout", "probe", "--max-scan-rows", "9", "--test-fraction", "0.3", "--regularization", "5"])
    assert (rmse.holdout, rmse.max_scan_rows, rmse.test_share, rmse.reg, rmse.epochs, rmse.rare_min) == ("probe", 9, 0.3, 5.0, 8, 500)
    page = parse(["scrape-imdb", "--user", "u", "--ratings-url", "https://x", "--sleep-seconds", "0"])
    assert (page.ratings_url, page.sleep_seconds) == ("https://x", 0.0)
    assert str(parse(["download-netflix", "--archive", "a.zip"]).archive) == "a.zip"


def test_named_sinks(spark, tmp_path):
    from veilframe.plans import report

    df = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int")
    made = report.write_sweep(str(tmp_path), df, df, report.version_tagged(df))
    assert [p.rsplit("/", 1)[1] for p in made] == ["noise_attack_raw_results.csv", "noise_attack_summary.csv", "noise_attack_main_table.csv"]
    assert spark.read.csv(made[2], header=True).first().dataset_version == "original_non_anonymized"
    assert spark.read.parquet(*report.write_predictions(str(tmp_path), df)).count() == 2
    calls = []
    for _ in range(2):
        assert report.cached(spark, str(tmp_path / "c"), lambda: calls.append(1) or df).count() == 2
    assert len(calls) == 1
    names = spark.createDataFrame([("remove_rare_movies_min_20",), ("movie_only",)], "release_name string")
    assert [r.label for r in report.presented(names).collect()] == ["Movie only", "No rare movies, users >= 20"]
    assert report.pivoted(df, "x", "y", "y").count() == 2


def test_first_rows_and_limits(spark, data_folder):
    from veilframe.operators import bias
    from veilframe.sources.header_block import read_ratings

    files = [str(data_folder / f) for f in fs.RATING_FILES]
    every = read_ratings(spark, files)
    for n in (1, 3, 5, 8, 20):
        assert read_ratings(spark, files, max_rows=n).count() == min(n, 8)
        got = bias.first_rows(every, n, ["movie_id", "customer_id"]).orderBy("movie_id", "customer_id").collect()
        assert got == every.orderBy("movie_id", "customer_id").limit(n).collect()
        assert bias.sampled(every, n).count() == min(n, 8)
