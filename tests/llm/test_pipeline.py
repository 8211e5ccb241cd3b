import corpus_pipeline
from veilframe.llm import queries
from veilframe.llm.common import stored

from .cases import documents, none, prose


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "mix_sources", "bpe_encode"]
    held = queries.queries()
    assert {n.split("_")[0] for n in held} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}


def test_stages_keep_columns_and_take_effect(spark):
    made = [(i, prose(500 + i, 120), "en", f"s{i % 2}", 0) for i in range(20)]
    shared = prose(999, 90)
    made += [(20 + k, prose(600 + k, 80) + " " + shared + " " + prose(700 + k, 80), "en", "s0", 0) for k in range(3)]
    made += [(30, made[0][1], "en", "s1", 0), (31, "too short", "en", "s1", 0), (32, None, None, None, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        docs = stored(stage(spark, docs, ""), name)
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == before
        if name == "suffix_array_dedup":
            assert not [r for r in docs.collect() if shared[:420] in r.text]
    assert sizes[0] == 24 and sizes[1] == 23 and sizes[2] == 23 and sizes[3] >= 23 and sizes[4] == sizes[3]
    assert docs.where("n_tokens <> size(ids)").count() == 0


def test_passages_of_51_short_words_go(spark):
    shared = " ".join(f"{'abcdefghij'[k % 10]}{k}" for k in range(51))
    made = [(k, prose(800 + k, 80) + " " + shared + " " + prose(850 + k, 80), 0) for k in range(3)] + [(3, prose(804, 90), 0)]
    docs = spark.createDataFrame(made, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    assert len(shared) < 200 and got[3] == made[3][1]
    for k in range(3):
        assert got[k] == made[k][1].replace(shared, "")


def test_odd_and_no_documents(spark):
    for docs in (documents(spark), none(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_stages_delete_what_earlier_ones_left(spark, tmp_path):
    from pathlib import Path

    from veilframe.llm.common import Stages

    made = []

    def stage(spark, docs, sf_dir):
        out = stored(docs, "left")
        made.append(out.inputFiles()[0].removeprefix("file:").replace("//", "/"))
        return out.select("id")

    run = Stages()(stage)
    first = run(spark, spark.range(9).coalesce(1), "")
    run(spark, first, "")  # reads what the first left
    assert [Path(p).exists() for p in made] == [True, True]
    first.write.parquet(str(tmp_path / "a"))
    run(spark, spark.read.parquet(str(tmp_path / "a")), "")
    assert [Path(p).exists() for p in made] == [False, False, True]
