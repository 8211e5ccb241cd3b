"""From raw documents to token ids: quality, near copies, repeated passages, mixing, BPE.

STAGES: (name, function) in order; each function takes (spark, docs, sf_dir). Its result is written and read again as the
docs of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import bpe, mixing, quality, repeats, simhash
from veilframe.llm.common import Stages, stored, table
from veilframe.session import reachable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null, empty and blank texts have no words and go; repeated rows are judged alike; ties with a
    limit stay; null lang or source is a group; an empty table gives none."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8. Equal texts, null and empty ones among them, leave their first
    row; of near copies the row that comes first stays; an empty table gives none."""
    return simhash.one_of_each(docs, similarity=0.8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes or more, that stand elsewhere too go, wherever they stand. Every row stays, if need be with
    an empty text; null texts become empty; repeated rows are documents of their own; an empty table gives none."""
    return repeats.remove_repeats(docs, words=51)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream of documents at the sources' target weights; small sources come around again, with the same doc_id. Null source is a
    source; null ids, repeated rows and ties follow a hash of all columns; an empty table gives none."""
    return mixing.mixed_documents(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to, for each document of the stream. Null and empty texts have no ids; null
    and repeated doc_id stay; an empty table gives none."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


_tidy = Stages()
#: Each deletes the tables that stages before it stored on their way: their results have been written and read again by then.
STAGES = [(f.__name__, _tidy(f)) for f in (quality_rules, simhash_near_dedup, suffix_array_dedup, mix_sources, bpe_encode)]

#: SQL can't express sketches' joined thresholds with SimHash classes, byte-level repeats, EDF schedules or BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(reachable(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
