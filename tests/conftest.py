import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


RATINGS = [
    (1, 10, 5, "2005-01-01"),
    (1, 20, 1, "2005-01-02"),
    (1, 30, 5, "2005-01-03"),
    (2, 10, 2, "2005-02-01"),
    (2, 20, 5, "2005-02-02"),
    (2, 30, 3, "2005-02-03"),
    (3, 10, 4, "2005-03-01"),
    (3, 20, 2, "2005-03-02"),
]


@pytest.fixture(scope="session")
def ratings(spark):
    return spark.createDataFrame(RATINGS, "movie_id int, customer_id int, rating int, date string").cache()


@pytest.fixture(scope="session")
def titles(spark):
    return spark.createDataFrame([(1, 1999, "Night Train"), (2, 2000, "Small Drama"), (3, 2001, "Movie, With Comma")], "movie_id int, year int, title string")


@pytest.fixture(scope="session")
def data_folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    lines: dict[int, list[str]] = {}
    for m, c, r, day in RATINGS:
        lines.setdefault(m, [f"{m}:"]).append(f"{c},{r},{day}")
    (d / "combined_data_1.txt").write_text("99,1,2001-01-01\n\n" + "\n".join(x for m in lines for x in lines[m]) + "\n\n", "latin-1")
    (d / "combined_data_2.txt").write_text("7,3,2001-01-01\n", "latin-1")  # no header of its own
    for k in (3, 4):
        (d / f"combined_data_{k}.txt").write_text("")
    (d / "movie_titles.csv").write_bytes("id,year,title\n1,1999,Night Train\n\n2,NULL,Amélie \"x\"\n3,2001,Movie, With Comma\nbad\n".encode("latin-1"))
    (d / "probe.txt").write_text("1:\n10\n")
    return d
