import hashlib
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import components, repeats, simhash

from .cases import TEXTS, WORDS, documents, none, prose, rows


# --- components ---------------------------------------------------------------------------------------------------------
def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.a: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {x: min(y for y in parent if find(y) == find(x)) for x in parent}
    assert got == {x: r for x, r in want.items() if x != r}


def test_components_of_nothing_and_scratch(spark):
    from veilframe.llm import common

    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 2), (3, 3), (4, 5), (5, 4)], "x long, y long")
    assert [tuple(r) for r in components.components(odd).collect()] == [(5, 4)]
    with common.Scratch(spark) as work:
        gone = common.stored(spark.range(3), "gone")
        kept = work.keep(spark.range(4), "kept")
        there = common._written[-2:]
    assert kept.count() == 4 and there[1] in common._written and there[0] not in common._written
    assert gone.columns == ["id"]


# --- SimHash ------------------------------------------------------------------------------------------------------------
def plain_simhash(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(keys, near):
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(keys))]


def test_near_duplicates_by_brute_force(spark):
    got = sorted(simhash.near_duplicates(documents(spark)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    data = sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain_simhash(t) for _, t in data]
    assert [int(r.fingerprint, 16) for r in got] == fps
    of = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {c: min((i for (i, _), o in zip(data, of, strict=True) if o == c and i is not None), default=None) for c in of}
    assert [r.component_id for r in got] == [least[c] for c in of]
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_links_through_hot_values(spark):
    """Hundreds of fingerprints that share nearly all bits, and others: the star way and the pair way agree with brute force."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(400)}
    fps |= {int(x) for x in rng.integers(0, 2**62, 300)}
    fps |= {x ^ 1 ^ (1 << 40) for x in list(fps)[:50]}
    fps = sorted(simhash._signed(x) for x in fps)
    for distance in (0, 1, 2):
        df = spark.createDataFrame([(0, x) for x in fps], "r int, fp long")
        got = {r.a: r.root for r in components.components(simhash.links(df, distance).select("a", "b")).collect()}
        of = classes(fps, lambda a, b, d=distance: ((a ^ b) & (2**64 - 1)).bit_count() <= d)
        want = {x: min(y for y, o in zip(fps, of, strict=True) if o == c) for x, c in zip(fps, of, strict=True)}
        assert got == {x: r for x, r in want.items() if x != r}


def test_thresholds_are_unequal_where_a_value_is_hot(spark):
    groups = [list(range(0, 22)), list(range(22, 43)), list(range(43, 64))]
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (5000.0, 1.0, 1.0), (1.0, 900.0, 900.0)], "c0 double, c1 double, c2 double")
    got = [r[0] for r in df.select(simhash.allocation([F.col(c) for c in df.columns], groups, 2, 1000)).collect()]
    assert got[0] == [0, 0, 0] and got[1][0] == -1 and sum(got[1]) == 0 and got[2] == [2, -1, -1]


def test_correlated_bits_share_a_group(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (3000, 64))
    x[:, [3, 50, 33]] = x[:, [3]]
    fps = [(0, simhash._signed(sum(1 << b for b in range(64) if row[b]))) for row in x]
    groups = simhash.bit_groups(spark.createDataFrame(fps, "r int, fp long"), 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({3, 50, 33} <= set(g) for g in groups)


def test_one_of_each_stays(spark):
    rng = np.random.default_rng(9)
    texts = [prose(100 + k, 250) for k in range(12)]
    for k in range(6):
        words = texts[k].split(" ")
        words[int(rng.integers(len(words)))] = "edited"
        texts.append(" ".join(words))  # one word of 250: far above 0.8
    texts += [texts[11], texts[11]]
    far = texts[0].split(" ")
    for k in range(0, 250, 6):
        far[k] = WORDS[k % len(WORDS)] + "x"
    texts.append(" ".join(far))
    df = spark.createDataFrame([(i, t, f"r{i}") for i, t in enumerate(texts)], "doc_id long, text string, sum string").coalesce(1)
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert got == set(range(12)) | {len(texts) - 1}
    assert simhash.jaccard(texts[0], texts[12]) >= 0.8 > simhash.jaccard(texts[0], texts[-1])
    odd = simhash.one_of_each(documents(spark))
    kept = [r.text or "" for r in odd.collect()]
    assert odd.columns == documents(spark).columns and len(kept) == len(set(kept))
    assert simhash.one_of_each(none(spark)).count() == 0


def test_near_copies_are_found_wherever_the_edits_lie(spark):
    rng = np.random.default_rng(12)
    found, texts = {"scattered": [], "block": []}, []
    for kind, of in found.items():
        while len(of) < 150:
            a = [f"v{i}" for i in rng.integers(0, 5000, 400)]
            b, at = list(a), int(rng.integers(0, 350))
            if kind == "block":
                b[at : at + 40] = [f"b{i}" for i in rng.integers(0, 10**6, 40)]
            else:
                for k in rng.choice(400, 9, replace=False):
                    b[k] = f"e{k}"
            a, b = " ".join(a), " ".join(b)
            if 0.8 <= simhash.jaccard(a, b) < 0.84:
                of.append((simhash.band_values(a, 0.8) == simhash.band_values(b, 0.8)).any())
                texts += [(a, b)] if kind == "block" and len(texts) < 40 else []
        assert np.mean(of) >= 0.95, kind
    df = spark.createDataFrame([(i, t) for i, pair in enumerate(texts) for t in pair], "doc_id long, text string")
    assert simhash.one_of_each(df).count() <= 42  # of 80


def plain_greedy(texts, similarity=0.8):
    sets = [set(simhash.shingle_hashes(simhash.word_list(t), 5).tolist()) for t in texts]
    kept = []
    for i, s in enumerate(sets):
        if not any(len(s & sets[j]) >= similarity * len(s | sets[j]) for j in kept):
            kept.append(i)
    return kept


def test_no_two_that_stay_are_alike(spark, monkeypatch):
    rng = np.random.default_rng(21)

    def edited(words, n):
        words = list(words)
        for k in rng.choice(len(words), n, replace=False):
            words[k] = f"e{rng.integers(10**6)}"
        return words

    chain = [[f"v{i}" for i in rng.integers(0, 5000, 300)]]
    while len(chain) < 60:
        chain.append(edited(chain[-1], 2))  # revisions: each like its neighbours, not like the far ones
    base = [f"v{i}" for i in rng.integers(0, 5000, 200)]
    cloud = [edited(base, int(rng.integers(2, 6))) for _ in range(60)]  # some alike, some not, to nearly all others
    texts = [" ".join(w) for w in chain + cloud]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = plain_greedy(texts)
    assert 12 < len(want) < 100
    for few in (50_000, 10):  # settled in one pass, or step by step first
        monkeypatch.setattr(simhash, "FEW", few)
        assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == want


def test_texts_are_compared_only_where_sketches_allow_it(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base, texts = [f"v{i}" for i in range(300)], []
    for _ in range(80):  # a cloud of revisions of one text, nearly none alike to another
        words = list(base)
        for k in rng.choice(300, 8, replace=False):
            words[k] = f"e{rng.integers(10**6)}"
        texts.append(" ".join(words))
    texts += [texts[0] + " more", None, "", " ", "a b", "a b c"]
    sketches, limit = [simhash.sketch(t) for t in texts], (1 - 0.8) / (1 + 0.8)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            (n, x), (m, y) = sketches[i], sketches[j]
            if simhash.jaccard(a, b) >= 0.8:
                assert max(np.bitwise_count(x ^ y).sum(), abs(n - m)) <= limit * (n + m) + 1e-9
    monkeypatch.setattr(simhash, "band_values", lambda t, s: np.zeros(simhash.BANDS, np.int64))  # all are candidates
    seen, plain = [], simhash.stored

    def stored(df, label):
        out = plain(df, label)
        seen.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(simhash, "stored", stored)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == plain_greedy(texts)
    assert sum(seen) < 200  # of over 3,000 pairs


# --- repeats ------------------------------------------------------------------------------------------------------------
def plain_removal(texts, length):
    seen = Counter()
    for b in texts:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_repeats_by_brute_force(spark):
    rng = np.random.default_rng(4)
    word = bytes(rng.integers(97, 123, 3000, dtype=np.uint8)).decode()
    more = ["a" * 1500, "a" * 399, "a" * 401, "ab" * 900, word, word[100:900] + "X" + word[900:2000], word[5:406], "é" * 500, "-" * 2000 + word[:450], word[:399], "zz" + word[700:1100] + "yy"]
    texts = [r[1] for r in rows()] + more
    texts = [t[:20000] if t else t for t in texts]
    for length in (400, 150):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in repeats.without_repeats(df, length).withColumn("sha", F.sha2("kept", 256)).collect()}
        want = plain_removal([(t or "").encode() for t in texts], length)
        assert got == dict(enumerate(want))


def test_repeats_in_place(spark):
    got = repeats.remove_repeats(documents(spark))
    assert got.columns == documents(spark).columns and got.count() == len(rows())
    assert got.where("n_chars <> length(text)").count() == 0
    by = {r.doc_id: r.text for r in got.where("doc_id between 1 and 20").collect()}
    assert by[3] == TEXTS[3] and len(by[1]) < 200  # one of a kind, and a copy
    assert repeats.remove_repeats(none(spark)).count() == 0


def plain_word_removal(texts, words):
    seen = Counter()
    for t in texts:
        w = t.split()
        seen.update(tuple(w[p : p + words]) for p in range(len(w) - words + 1))
    out = []
    for t in texts:
        w, gone = t.split(), set()
        for p in range(len(w) - words + 1):
            if seen[tuple(w[p : p + words])] > 1:
                gone.update(range(p, p + words))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def test_repeated_passages_of_words_by_brute_force(spark):
    rng = np.random.default_rng(8)
    made = [prose(900 + k, int(rng.integers(60, 400))) for k in range(30)]
    shared = [prose(950 + k, n) for k, n in enumerate((51, 50, 52, 51, 75))]
    texts = [t + "\n" + shared[k % 5].replace(" ", "  " if k % 2 else " ") + "\t" + made[-k] for k, t in enumerate(made[:20])]
    texts += [shared[0], shared[1] + " x", "so " * 200, "", "a " * 50, "é ü " * 40, " ".join(shared[:3])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: bytes(r.kept).decode().split() for r in repeats.without_repeats(df, 10**6, words=51).collect()}
    assert got == dict(enumerate(plain_word_removal(texts, 51)))


def test_long_words_go_by_bytes(spark):
    long = " ".join(f"{k:03d}{'y' * 17}" for k in range(30))  # 629 bytes in 30 words
    long2 = "".join(f"{k:04d}" for k in range(120))  # 480 bytes without a blank
    texts = [prose(970 + k, 40) + " " + x + ("." if k % 2 else "") for k, x in enumerate((long, long, long2, long2))]
    texts += [texts[0][-200:] + " alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in repeats.without_repeats(df, words=51).collect()}
    want = {r.doc_id: bytes(r.kept).decode() for r in repeats.without_repeats(df).collect()}
    assert got == want and all(len(got[k]) < 400 for k in range(4)) and got[4] == texts[4]


def test_every_window_has_one_context_or_stands_alone():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 101, n, dtype=np.uint8)) for n in (2000, 400, 399, 0, 1700)] + [b"a" * 900]
    data, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    p = repeats.Contexts(repeats.Rolling(1), repeats.Rolling(2), data, edges, 400, repeats.BYTES)
    seen = [(d, t - k - edges[d]) for d, t, l, r in zip(p.doc, p.trig, p.l, p.r, strict=True) for k in range(max(0, 400 - r), l + 1)]
    seen += [(d, x - edges[d]) for d, x in zip(*p.lone, strict=True)]
    assert sorted(seen) == [(d, x) for d, t in enumerate(texts) for x in range(len(t) - 399)]


def test_passages_with_edits_by_brute_force(spark):
    """Many partial copies of a few passages: neighbours in the two orders don't prove all, so windows are put in order one by one."""
    rng = np.random.default_rng(14)
    base = [bytes(rng.integers(97, 123, 1500, dtype=np.uint8)) for _ in range(3)]
    texts = []
    for k in range(120):
        own = bytearray(base[k % 3])
        for at in rng.integers(0, 1500, int(rng.integers(0, 4))):
            own[int(at)] = 65 + k % 20
        a, z = sorted(int(x) for x in rng.integers(0, 1500, 2))
        texts.append((bytes(rng.integers(97, 123, 30, dtype=np.uint8)) + bytes(own[a:z]) + bytes(rng.integers(97, 123, 30, dtype=np.uint8))).decode())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for length in (400, 97):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in repeats.without_repeats(df, length).withColumn("sha", F.sha2("kept", 256)).collect()}
        assert got == dict(enumerate(plain_removal([t.encode() for t in texts], length)))


def test_passages_are_counted_and_not_removed(spark):
    texts = [prose(900, 90) + " " + prose(901, 51) + " x", "y " + prose(901, 51).replace("\n", " "), prose(902, 80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_passage_words) for r in repeats.without_repeats(df, passages=51).collect()}
    assert got == {0: (0, 51), 1: (0, 51), 2: (0, 0)}


def test_checksums_decide_who_trains():
    assert zlib.crc32(b"7") % 7 == (zlib.crc32(str(7).encode()) % 7)


def test_near_copies_are_searched_for_by_simhash_too(spark, monkeypatch):
    """A close copy goes by its fingerprint alone, without a band of least hashes; linked texts that aren't alike stay."""
    words = [f"w{k}" for k in range(3000)]
    edits = (" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(100, 3000, 100))
    away = lambda t: bin(simhash.simhash(t) ^ simhash.simhash(" ".join(words))).count("1")
    texts = [" ".join(words), next(t for t in edits if 1 <= away(t) <= 2), " ".join(reversed(words))]
    numbers = iter(range(10**6))
    monkeypatch.setattr(simhash, "band_values", lambda *_: np.array([next(numbers) + k * 10**6 for k in range(simhash.BANDS)], np.int64))
    linked = simhash._linked(spark.createDataFrame([(k, int(np.uint64(simhash.simhash(t)).view(np.int64))) for k, t in enumerate(texts)], "_rid long, fp long"))
    value = {r["_rid"]: r["value"] for r in linked.collect()}
    assert value[0] == value[1] != value[2] and {r["band"] for r in linked.collect()} == {simhash.BANDS}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [0, 2]


def test_texts_are_parsed_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    shared = [bytes(rng.integers(97, 123, 500, dtype=np.uint8)).decode() for _ in range(9)]
    texts = [shared[k % 9] + str(k) for k in range(320)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(32)
    parsed, parse = spark.sparkContext.accumulator(0), repeats._parsed

    def counting(*options):
        run = parse(*options)

        def counted(batches):
            def each():
                for b in batches:
                    parsed.add(len(b))
                    yield b

            return run(each())

        return counted

    monkeypatch.setattr(repeats, "_parsed", counting)
    monkeypatch.setattr(repeats, "LEAST_BLOCKS", 1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in repeats.without_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()}
    assert parsed.value <= 32 + 16  # each block, and a sample for the ranges; it was twice each block
    assert got == dict(enumerate(plain_removal([t.encode() for t in texts], 400)))


def test_ranges_part_a_frequent_key():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, n, 400) for n in (3, 2, 4, 50)]
    for some in (0, 1, 7, 60):
        bounds = sorted(zip(*[x[:some].tolist() for x in rows], strict=True))
        columns = [np.array([b[k] for b in bounds], np.int64) for k in range(4)]
        assert repeats._range_of(rows, columns).tolist() == [sum(b <= r for b in bounds) for r in zip(*[x.tolist() for x in rows], strict=True)]
