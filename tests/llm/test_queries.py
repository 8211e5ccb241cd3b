"""Each query of the training-data operators, held against its contract on a small table."""

import hashlib
import struct
import zlib

import pytest

from veilframe.llm import queries

from .cases import SCHEMA, TEXTS, rows
from .test_dedup import classes, plain_removal, plain_simhash
from .test_text_operators import base_counts, plain_scores

DATA = [(r[0], r[1]) for r in rows()[:-2]]


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows()[:-2], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 1)) for i in range(len(DATA))], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    turns = [(c, t, r, f"{r} {c} says {t}") for c in range(6) for t, r in enumerate(("user", "assistant", "user", "assistant"))]
    spark.createDataFrame([*turns, (9, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def got(spark, folder):
    return lambda name: queries.queries()[name](spark, folder).collect()


def by_id(found):
    out = {r.doc_id: r for r in found}
    assert len(found) == len(out) == len(DATA)
    return out


def test_scores(got):
    want = plain_scores([((i, i), t) for i, t in DATA])
    for i, r in by_id(got("op1_lm_score")).items():
        held, n, known, total, base, score = want[i, i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and abs(r.score - score) <= 0.03 * n


def test_shards(got):
    found = by_id(got("op2_byte_shards"))
    for i, t in DATA:
        b = (t or "").encode()
        assert (found[i].size, found[i].text_crc32, found[i].law, found[i].grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
    for s in range(8):
        assert sorted(r.slot for r in found.values() if r.shard == s) == list(range(sum(r.shard == s for r in found.values())))


def test_toxicity(got):
    for i, r in by_id(got("op3_toxicity")).items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_chat(got):
    found = {r.conv_id: r for r in got("op5_chat_format")}
    assert set(found) == {-7, 9, *range(6)}
    probe = "</s>[INST] ok [/INST]"
    r = found[-7]
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(probe), sha(probe.encode()))
    assert r.turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n".encode()) and r.formatted_chars > 2 * len(probe)
    assert (found[9].n_turns, found[9].loss_chars, found[9].turns_sha256) == (1, 0, sha(b"user\n\n"))
    said = "".join(f"assistant 3 says {t}" for t in (1, 3))
    assert (found[3].n_turns, found[3].loss_sha256) == (4, sha(said.encode()))


def test_bpe(got):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = by_id(got("op6_bpe"))
    for i, text in DATA:
        ids = t.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), sha(packed), sha(t.decode(ids, skip_special_tokens=False).encode()))


def test_simhash(got):
    found = by_id(got("op7_simhash"))
    fps = [plain_simhash(t) for _, t in DATA]
    of = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for (i, _), fp, c in zip(DATA, fps, of, strict=True):
        assert (found[i].fingerprint, found[i].component_id) == (f"{fp:016x}", min(j for (j, _), o in zip(DATA, of, strict=True) if o == c))


def test_repeats(got):
    found = by_id(got("op8_repeats"))
    texts = [(t or "").encode() for _, t in DATA]
    for (i, t), want in zip(DATA, plain_removal(texts, 400), strict=True):
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want and r.n_passage_words <= len((t or "").split())
    assert found[0].n_passage_words == 300 and found[3].n_passage_words == 0


def test_quality(got):
    for i, r in by_id(got("op10_quality_rules")).items():
        want = base_counts(TEXTS[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.kept and r.base_failed)


def test_pipeline(spark, folder):
    found = queries.queries()["pipeline"](spark, folder).collect()
    assert found and all(r.n_tokens == len(r.ids) for r in found) and {r.doc_id for r in found} <= {i for i, _ in DATA}
    assert all("light</w>" in r.decoded for r in found if r.n_tokens > 500)
