import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import bpe, chat, eliasfano, lm, mixing, quality, sharding, syncmers, toxicity

from .cases import TEXTS, documents, none, rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(t):
    return [w for w in SPACE.split(t or "") if w]


# --- sharding -----------------------------------------------------------------------------------------------------------
def test_shards_against_a_running_sum(spark):
    got = sharding.byte_shards(documents(spark), 4).collect()
    want, at = [], 0
    sizes = [(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in rows()]
    sizes.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    total, slots = sum(s for *_, s in sizes), Counter()
    for i, c, s in sizes:
        shard = min(3, 4 * (2 * at + s) // (2 * total))
        want.append((i, s, c, shard, slots[shard]))
        slots[shard] += 1
        at += s
    key = lambda x: (x[0] is None, x[0] or 0, x[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sharding.byte_shards(none(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.byte_shards(documents(spark), 0)


# --- quality ------------------------------------------------------------------------------------------------------------
def base_counts(t):
    w, lines = words_of(t), (t or "").split("\n")
    full = [x for x in lines if words_of(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), len(hit)


def test_quality_counts(spark):
    got = quality.assess(documents(spark)).where("doc_id is not null").collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = base_counts(TEXTS[r.doc_id])
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and (not failed or not r.kept)
    assert quality.assess(none(spark)).count() == 0


def test_adaptive_thresholds_follow_the_group(spark):
    """Symbols are usual in one source and junk in another."""
    plain = " ".join(f"word{k}" for k in range(60))
    made = [(i, f"{plain} n{i} " + ("# " * (12 + i % 3) if i % 2 else ""), "en", "code" if i % 2 else "prose") for i in range(600)]
    made.append((1000, plain + " # $ % " * 20, "en", "prose"))
    made.append((1001, plain + " # " * 13, "en", "code"))
    got = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000] and got[1001] and all(got[i] for i in range(600))


def test_sketches_merge_to_the_whole(spark):
    measured = quality.with_features(documents(spark).select("doc_id", "lang", "source", "text"))
    whole = quality.merged(quality.sketches(measured), [])
    straight = quality.merged(quality.sketches(measured.withColumn("lang", F.lit("x"))), [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, straight.collect()))


# --- syncmers -----------------------------------------------------------------------------------------------------------
def long64(x):
    return x - (1 << 64) if x >> 63 else x


def hash_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), seed)
    return long64(seed)


def plain_anchors(t):
    h = [long64(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words_of(t)]
    if not h:
        return []
    small = [hash_longs(h[i : i + 2]) for i in range(len(h) - 1)]
    keep = [i for i in range(len(h) - 4) if min(small[i], small[i + 3]) <= min(small[i + 1], small[i + 2])]
    if not keep:
        acc = 42
        for x in h:
            acc = hash_longs([acc, x])
        return [(acc & 0xFFFFFFFF, 0)]
    return [(hash_longs(h[i : i + 5]) & 0xFFFFFFFF, then - i) for i, then in zip(keep, [*keep[1:], keep[-1]], strict=True)]


def plain_likeness(a, b):
    x, y = Counter(plain_anchors(a)), Counter(plain_anchors(b))
    both = sum((x & y).values())
    either = x.total() + y.total() - both
    return both / either if either else 1.0


def spelt(marks):
    return " ".join(f"{h:08x}:{gap}" for h, gap in marks)


def test_syncmers_by_hand(spark):
    got = syncmers.fingerprints(documents(spark).where("doc_id is not null")).collect()
    for r in got:
        marks = plain_anchors(TEXTS[r.doc_id])
        assert [(x >> 31, x & (2**31 - 1)) for x in r.anchors] == marks and r.fingerprint == spelt(marks)


def test_short_texts_without_syncmers_have_a_fingerprint(spark):
    texts = [" ".join(f"t{i}x{j}" for j in range(n)) for n in range(1, 9) for i in range(100 * n, 100 * n + 40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, ""])], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(df).collect()}
    assert got.pop(len(texts)) == "" and len(set(got.values())) == len(texts) and all(got.values())
    near = df.crossJoin(df.select(F.col("text").alias("other"))).where("text < other").select(
        syncmers.likeness(syncmers.anchors(F.col("text")), syncmers.anchors(F.col("other"))).alias("x")
    )
    assert near.where("x > 0").count() == 0


def test_syncmer_query_by_its_contract(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"v{i}" for i in rng.integers(0, 40, n)) for n in [*range(9), 60, 200, 300, 300, 400]]
    texts += [None, "a b " * 300, "c a b " * 200, texts[10], "Ünïcode 中文 😀 words go here and on " * 9]
    data = [(int(i), t) for i, t in zip(rng.permutation(1000)[: len(texts)], texts, strict=True)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in syncmers.op4_query(spark, str(tmp_path)).collect()}
    order = sorted(data, reverse=True)
    for k, (i, t) in enumerate(order):
        t, then = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + then[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (spelt(plain_anchors(t)), spelt(plain_anchors(edited)))
        assert r.near_edited == pytest.approx(plain_likeness(t, edited)) and r.near_next == pytest.approx(plain_likeness(t, then))
    assert len(got) == len(data)


def test_next_documents(spark):
    plain = [(i, f"text {i} " * (i + 1)) for i in range(25)]
    got = {r.doc_id: r.next_text for r in syncmers.with_next(spark.createDataFrame(plain, "doc_id long, text string")).collect()}
    assert got == {i: plain[i - 1][1] for i in range(25)}
    odd = syncmers.with_next(documents(spark))
    assert odd.count() == len(rows()) and odd.where("next_text is null").count() == 0
    assert syncmers.with_next(none(spark)).count() == 0
    one = syncmers.with_next(spark.createDataFrame([(5, "alone")], "doc_id long, text string")).first()
    assert one.next_text == "alone"


# --- chat ---------------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    import public_tokenizers

    said = ["hello", "", None, "</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>", "back\\slash \\<| \\\\", "  lead and trail \n", "😀é中文 ", "a" * 20000]
    turns = [(c, t, r, said[(c + t) % len(said)], "x") for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    turns += [(None, 0, "user", "q", "x"), (None, 0, "assistant", "a", "x"), (50, None, "assistant", "first", "x"), (50, 1, None, "second", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df, public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    assert len(got) == 14
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or ""))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t, _ in own)
        loss = "".join(t or "" for _, _, r, t, _ in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), sha(whole), len(loss), sha(loss))
    assert chat.formatted(df.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_masks_by_binary_search():
    starts, ends = np.array([0, 2, 5, 5, 9]), np.array([2, 5, 6, 6, 12])
    token, low, high = chat.overlaps(starts, ends, [(1, 4), (5, 6), (10, 20)])
    assert list(zip(token.tolist(), low.tolist(), high.tolist(), strict=True)) == [(0, 1, 2), (1, 2, 4), (2, 5, 6), (4, 10, 12)]


# --- BPE ----------------------------------------------------------------------------------------------------------------
def test_bpe_as_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = bpe.encoded(documents(spark), path).collect()
    assert len(got) == len(rows())
    for r in got:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "no id here at all") or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(none(spark), path).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------------
def test_one_period_is_pfair():
    parts = mixing.whole_weights({"a": 5.0, "b": 3.3, "c": 0.2, None: 1.0}, 97)
    assert sum(parts.values()) == 97
    slots = mixing.one_period(parts)
    assert sorted(t for s in slots.values() for t in s) == list(range(97))
    for s, p in parts.items():
        for t in range(98):
            assert abs(sum(x < t for x in slots[s]) - t * p / 97) < 1


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "s0" if i % 3 == 0 else f"s{i % 5}", i) for i in range(500)], "doc_id long, source string, slot int")
    got = mixing.pfair_mix(docs, block=4, period=100).collect()
    at = sorted(r.position for r in got)
    assert at == list(range(len(got))) and {r.doc_id for r in got} == set(range(500))
    size = Counter("s0" if i % 3 == 0 else f"s{i % 5}" for i in range(500))
    parts = mixing.whole_weights({s: n**0.7 for s, n in size.items()}, 100)
    source = {r.position: r.source for r in got}
    seen: Counter = Counter()
    for slot in range(len(got) // 4):
        block = {source[4 * slot + k] for k in range(4)}
        assert len(block) == 1  # a slot is one source's
        seen.update(block)
        assert all(abs(seen[s] - (slot + 1) * p / sum(parts.values())) < 1 for s, p in parts.items())
    times = Counter(r.doc_id for r in got)
    for s in size:
        own = [n for i, n in times.items() if ("s0" if i % 3 == 0 else f"s{i % 5}") == s]
        assert max(own) - min(own) <= 1
    odd = mixing.mixed_documents(documents(spark))
    assert odd.columns == documents(spark).columns and odd.select("doc_id", "text").distinct().count() == len(rows()) - 1
    assert mixing.mixed_documents(none(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.pfair_mix(docs, {"s0": 1.0})


def plain_stream(sizes, parts, block):
    """Sources by slot, by a simulation of earliest deadline first over the whole stream."""
    total, done, out = sum(parts.values()), Counter(), []
    while any(done[s] * block < n for s, n in sizes.items()) or len(out) < max(-(-(-(-n // block) + 1) * total // parts[s]) for s, n in sizes.items()):
        t = len(out)
        ready = [(-(-(done[s] + 1) * total // parts[s]), k, s) for k, s in enumerate(parts) if done[s] * total // parts[s] <= t]
        out.append(min(ready)[2])
        done[out[-1]] += 1
    return out


def test_stream_by_simulation(spark):
    made = [(i, f"s{min(i % 7, 3)}") for i in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, source string")
    got = mixing.pfair_mix(docs, block=3, period=40).collect()
    size = Counter(s for _, s in made)
    parts = mixing.whole_weights({s: n**0.7 for s, n in size.items()}, 40)
    want = plain_stream(size, parts, 3)
    assert {r.slot: r.source for r in got} == dict(enumerate(want)) and len(got) == 3 * len(want)


def test_ties_have_the_same_places_however_rows_are_dealt(spark):
    made = [(None if i % 9 == 0 else i // 10, f"text {i}", f"s{i % 2}") for i in range(400)] + [(3, "same", "s0")] * 5
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = [sorted((r.position, r.text) for r in mixing.pfair_mix(docs.repartition(n)).collect()) for n in (3, 7)]
    assert got[0] == got[1] and Counter(t for _, t in got[0])["same"] >= 5 and len({t for _, t in got[0]}) == 401


def test_mixing_query_by_its_contract(spark, tmp_path):
    made = [(i, f"t{i}", f"s{i % 3}") for i in range(90)]
    spark.createDataFrame(made, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op9_query(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(90)) and sorted(r.position for r in got) == list(range(len(got)))


# --- language model -----------------------------------------------------------------------------------------------------
def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (5, 5), (1000, 10**9), (5000, 6000), (300, 2**45)):
        v = np.unique(rng.integers(0, top, n)) if n else np.zeros(0, np.int64)
        e = eliasfano.EliasFano.build(v)
        assert (e.get(np.arange(len(v))) == v).all()
        q = np.concatenate([v, rng.integers(0, top + 5, 500)])
        place = {x: k for k, x in enumerate(v.tolist())}
        assert e.find(q).tolist() == [place.get(x, -1) for x in q.tolist()]
    with pytest.raises(ValueError):
        eliasfano.EliasFano.build(np.array([2, 1]))


def plain_scores(texts):
    tokens = {k: (t or "").encode().lower().split() + [b""] for k, t in texts}
    known = lambda k: zlib.crc32(str(k[0]).encode() if k[0] is not None else b"") % 7 != 2
    c, c2, c3 = Counter(), Counter(), Counter()
    for k, x in tokens.items():
        if known(k):
            s = ["<s>", "<s>", *x]
            c.update(x)
            c2.update(zip(s[1:], s[2:], strict=False))
            c3.update(zip(s, s[1:], s[2:], strict=False))
    n, v = sum(c.values()), len(c)
    cv, tv, cu, tu = Counter(), Counter(), Counter(), Counter()
    for (a, _), k in c2.items():
        cv[a] += k
        tv[a] += 1
    for (a, b, _), k in c3.items():
        cu[a, b] += k
        tu[a, b] += 1
    out = {}
    for k, x in tokens.items():
        s, score, base = ["<s>", "<s>", *x], 0.0, 0.0
        for u, a, w in zip(s, s[1:], s[2:], strict=False):
            p = (c[w] + 1) / (n + v + 1)
            base += math.log10(p)
            if cv[a]:
                p = (c2[a, w] + tv[a] * p) / (cv[a] + tv[a])
            if cu[u, a]:
                p = (c3[u, a, w] + tu[u, a] * p) / (cu[u, a] + tu[u, a])
            score += math.log10(p)
        out[k] = (not known(k), len(x), sum(c[w] > 0 for w in x), n, base, score)
    return out


@pytest.mark.parametrize("hot", [None, 40, 0])
def test_scores_by_hand(spark, hot):
    keyed = [((r[0], k), r[1]) for k, r in enumerate(rows())]
    want: dict = {}
    for (i, _), x in plain_scores(keyed).items():
        want.setdefault(i, []).append(x)
    got: dict = {}
    for r in lm.scores(documents(spark), lm.HOT if hot is None else hot).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for i, found in got.items():
        for r, w in zip(found, want[i], strict=True):
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6
            assert abs(r.score - w[5]) <= 0.03 * r.n_tokens


def test_scores_of_nothing(spark):
    assert lm.scores(none(spark)).count() == 0


def test_questions_are_the_only_table_left_and_need_no_exchange(spark):
    from veilframe.llm import common

    start = len(common._written)
    got = lm.scores(documents(spark), 25)
    assert [p.rpartition("/")[2].split("_")[1] for p in common._written[start:]] == ["questions"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    # by shard and by block: the sums of hot words' contexts; the result by block
    assert plan.count("Exchange hashpartitioning(shard") == 1 and plan.count("Exchange hashpartitioning") == 3


def test_hot_words_have_the_same_scores(spark):
    got = [{r.doc_id: r.score for r in lm.scores(documents(spark).where("doc_id > 1"), hot).collect()} for hot in (lm.HOT, 25)]
    assert got[0] == got[1] and len(got[0]) > 10


def test_questions_of_one_turn_stand_at_a_time(spark, monkeypatch):
    from pathlib import Path

    from veilframe.llm import common
    from veilframe.session import checkpoint_folder

    shared = Path(checkpoint_folder(spark).removeprefix("file:"))
    tables = lambda label: set(shared.glob(f"veilframe_{label}_*"))
    size = lambda p: sum(x.stat().st_size for x in p.glob("*.parquet"))
    finished, standing = lm.blocks.finished, []
    monkeypatch.setattr(lm.blocks, "finished", lambda *x: standing.append(len(tables("questions") - before)) or finished(*x))
    monkeypatch.setattr(lm, "TURN_PARTS", 1)
    monkeypatch.setattr(lm, "TURN_TOKENS", 1)
    docs, got, sizes = documents(spark), [], []
    for turns in (1, None, 3):
        for hot in (lm.HOT, 25):
            before, start, standing[:] = tables("questions"), len(common._written), []
            got.append(sorted(lm.scores(docs, hot, turns).collect(), key=str))
            assert standing == [0] * (turns or lm.TURNS)
            labels = [Path(p).name.removeprefix("veilframe_").replace("-", "_").split("_")[0] for p in common._written[start:]]
            assert labels == ["sums"] * (len(standing) - 1) + ["questions"]
            (left,) = tables("questions") - before
            sizes.append(size(left))
    assert all(x == got[0] for x in got) and len(got[0]) == len(rows())
    assert sizes[2] < 0.8 * sizes[0]


def test_trie_with_sums_from_outside():
    """A hot word's successors are spread over shards: what sums over them comes from outside."""
    uni = lm.Unigrams(1000, 10, 5)
    v, u, w, n = np.array([3, 3, 7]), np.array([0, 6, 2]), np.array([1, 4, 1]), np.array([30, 10, 2])
    ints = lambda *x: np.array(x, np.int64)
    sums = lm.Sums(ints(3, 7), ints(400, 5), ints(60, 3), ints(0, 0, 1, 1), ints(0, 6, 2, 5), ints(100, 20, 2, 3), ints(9, 4, 1, 2))
    trie = lm.Trie.build(v, u, w, n, np.log10(np.array([0.1, 0.05, 0.1])), sums)
    got = trie.log(ints(3, 3, 7, 7, 9, 7), ints(0, 0, 2, 1, 0, 5), ints(1, 9, 1, 1, 1, 8), np.log10(np.array([0.1, 0.2, 0.1, 0.1, 0.3, 0.2])))
    p3, p7 = (30 + 60 * 0.1) / 460, (2 + 3 * 0.1) / 8
    want = [(30 + 9 * p3) / 109, 9 / 109 * 60 / 460 * 0.2, (2 + p7) / 3, p7, 0.3, 2 / 5 * 3 / 8 * 0.2]
    assert np.abs(got - np.log10(want)).max() < 0.06 and uni.log(np.array([9]))[0] == np.log10(10 / 1011)


def test_words_meet_once_and_sums_are_small(spark, monkeypatch):
    met, answered = [], lm.blocks.answered
    monkeypatch.setattr(lm.blocks, "answered", lambda *x: met.append(x) or answered(*x))
    assert lm.scores(documents(spark)).count() == len(rows())
    assert len(met) == 1  # the corpus's figures come with the words' counts
    rng = np.random.default_rng(2)
    n, ints = 4000, lm.blocks.pack_ints
    one, many, own = (ints(np.array(x, np.int64)) for x in ([1], np.arange(300) > 0, np.arange(300)))
    pick = [rng.integers(0, 300, n) for _ in range(2)]
    asked = [7, 5, one, ints(np.zeros(1, np.int64)), many, many, own, ints(np.zeros(n, np.int64)), *map(ints, pick), ints(np.arange(n)), ints(np.arange(n) % 2), None]
    q = lm.Questions(pd.DataFrame([asked], columns=[x.split()[0] for x in lm.QUESTION.split(", ")]))
    got = q.answers(lm.Unigrams(100_000, 300, 50))
    assert sum(len(x) for x in got.iloc[0] if isinstance(x, bytes)) < 6 * n  # not a float for each document


def test_questions_are_ordered_by_three_numbers():
    rng = np.random.default_rng(3)
    for top in (50, 2**31 - 1):
        v, u, w = (rng.integers(top - 40, top, 3000) for _ in range(3))
        order = lm._by_three(v, u, w)
        plain = np.lexsort((w, u, v))
        assert all((x[order] == x[plain]).all() for x in (v, u, w))


# --- toxicity -----------------------------------------------------------------------------------------------------------
def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            old, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, old + (x != y))
    return d[-1]


def test_automata_against_distances():
    rng = np.random.default_rng(5)
    terms = [("scum", False), ("idiot", False), ("disgusting", False), ("vermin", False), ("badstem", True), ("lowei", True)]
    lexicon = toxicity.Lexicon()
    for t in terms:
        lexicon.add(*t)
    letters = "abcdegilmnoqrstuvwxyz"
    for _ in range(4000):
        term, _ = terms[rng.integers(len(terms))]
        word = list(term)
        for _ in range(rng.integers(0, 4)):
            k, ch = rng.integers(0, len(word) + 1), letters[rng.integers(len(letters))]
            word[k : k + rng.integers(0, 2)] = [ch] * rng.integers(0, 2)
        word = "".join(word)
        want = 0
        for t, stem in terms:
            most = 0 if len(t) < (7 if stem else 5) else 1 if len(t) < 9 else 2
            best = min(distance(word[:k], t) for k in range(len(word) + 1)) if stem else distance(word, t)
            if best <= most:
                want = min(want or 2, 1 if best == 0 else 2)
        assert lexicon.match(word) == want, word


def test_quotation():
    words = 'he said "you idiot" and left'.split()
    assert toxicity._quoted(words, 3) and not toxicity._quoted("you idiot and left".split(), 1)
    assert toxicity._quoted("man nennt «den idiot» hier".split(), 3)


def test_toxicity_learns_and_holds_out(spark):
    clean = [f"this is a calm text number {i} about gardens and rivers and {i * 7} stones" for i in range(300)]
    bad = [f"you are a {w} and a grubwit{i} number {i}" for i, w in enumerate(["idiot", "moron", "scum"] * 30)]
    docs = [(i, t) for i, t in enumerate(clean + bad)] + [(900, "you are an idoit and a mor0n"), (901, ""), (902, None)]
    labels = [(i, int(i >= 300)) for i in range(390)] + [(900, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    got = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    held = [i for i in range(390) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and all(got[i].predicted == int(i >= 300) for i in held)
    assert got[901].predicted == 0 and got[902].score == got[901].score
    blank = toxicity.fit(df, lab.where("false"))
    assert {r.score for r in toxicity.scored(documents(spark), blank).collect()} == {0.0}
    assert toxicity.scored(none(spark), model).count() == 0


def test_a_tasks_shards_are_added_up():
    ints = lm.blocks.pack_ints
    row = lambda bid, doc, x: [bid, ints(np.diff(doc, prepend=0)), *[ints(np.array(x) * k) for k in (1, 2, 0)], None]
    made = [row(1, [0, 3], [5, 6]), row(2, [4], [1]), row(1, [2, 3], [7, 300])]
    batches = [pd.DataFrame(made[:1], columns=lm.PARTIAL_NAMES), pd.DataFrame([*made[1:], [2, None, None, None, None, b"x"]], columns=lm.PARTIAL_NAMES)]
    got = pd.concat(list(lm._together(iter(batches))))
    assert got["bid"].tolist() == [2, 1, 2] and got["own"].iloc[0] == b"x"
    said = got.iloc[1]
    assert np.cumsum(lm.blocks.unpack_ints(said["doc"])).tolist() == [0, 2, 3]
    assert [lm.blocks.unpack_ints(said[c]).tolist() for c in ("coarse", "fine", "bare")] == [[5, 7, 306], [10, 14, 612], [0, 0, 0]]


def test_buckets_of_a_sequence_that_span_words():
    rng = np.random.default_rng(8)
    for values in (np.sort(rng.integers(0, 10**6, 3000)), np.arange(5000), np.concatenate([np.arange(400), [10**9]])):
        made, known = eliasfano.EliasFano.build(values), set(values.tolist())
        asked = np.concatenate([values, values + 1, rng.integers(-5, 10**6, 2000)])
        at = made.find(asked)
        assert ((at >= 0) == [x in known for x in asked.tolist()]).all()
        assert (values[at[at >= 0]] == asked[at >= 0]).all()
