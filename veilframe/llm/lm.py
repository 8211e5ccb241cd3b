"""N-gram scores from Elias-Fano tries.

The model is an interpolated (Witten-Bell) trigram model over an add-one unigram model:

    P(w | v)   = (c(v w) + t(v) P(w)) / (c(v) + t(v))              t: distinct words seen after the context
    P(w | u v) = (c(u v w) + t(u v) P(w | v)) / (c(u v) + t(u v))

A context that was never seen passes the question on, so each level is a probability over the known words. The trie is cut
by its middle word v into shards of its own; a shard holds, for its words v,

    level 1   the words v                         pointers into both level 2 tables
    level 2   the successors w of each v          log P(w | v) in 8 bits
    level 2   the predecessors u of each v        weight of the context u v in 8 bits, pointers into level 3
    level 3   the successors w of each u v, not as words but as positions among the successors of v, which hold them all

as Elias-Fano sequences with monotone pointers, in a file that is mapped into memory. Words and the counts of their contexts
come from exchanges of word tables (see blocks.py), and every text's trigrams go to the shard of their middle word with the
words' own counts, so a shard answers alone and neither vocabulary nor trie is ever whole in one place. Both grow with the
corpus. Logarithms are rounded to 1/4096 (words) and 1/21 (trie levels) on fixed scales, so that scores don't depend on how the
data is cut.

A word v that is a context more than HOT times would make its shard large, so its trigrams are spread over shards of their own by w.
Such a shard has every c(v w) and c(u v w) whole. What it holds of c(u v), t(u v) and t(v) is a part of the sum over w: shards send
these parts, one row for each u v that they hold, to be added up, and get the sums back. The scores are those that one shard
would give. A pair v w stays in one shard.

Questions take more room than the tokens they are made of, so shards are asked in up to TURNS turns: a turn's questions are made from
the tokens, answered, and deleted before the next. A turn has its part of the buckets, so it has tasks of the same size.

Defined cases: null text counts as empty and has the end alone; repeated rows and ids are rows of their own; a null id has
the checksum of the empty text; an empty table gives no rows; words never seen have the add-one probability of a count of
zero; further columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import blocks
from veilframe.llm.common import Scratch, shuffle_partitions, stored_by, table
from veilframe.llm.eliasfano import EliasFano

HOT = 1_000_000
TURNS, TURN_PARTS, TURN_TOKENS = 4, 12, 1 << 22  # turns at most; partitions and training tokens of a turn at least
FINE, COARSE = 4096, 21  # steps of a unit of log10: words' counts, trie levels
END = b""
START = 0  # the number of the text's start as a context; words count from 1


def crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def training(doc_id: int | None) -> bool:
    return crc(doc_id) % 7 != 2


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


#: size, distinct, top: tokens, distinct words and the most frequent word's count in a partition's training rows; once, 0 in its other rows.
ANSWER = "bid long, part int, ids binary, counts binary, size long, distinct long, top long"


def _count_words(parts: int):
    def run(slices: pd.DataFrame) -> pd.DataFrame:
        """The number and the corpus count of every word of every slice."""
        total: dict[bytes, int] = {}
        held = []
        for body, n, own in zip(slices["body"], slices["n"], slices["docs"], strict=True):
            words, counts = blocks.split_words(body, n), blocks.unpack_ints(own)
            held.append(words)
            for w, c in zip(words, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        part = int(slices["part"].iloc[0])
        number = {w: 1 + part + parts * k for k, w in enumerate(sorted(total))}
        trained = [c for c in total.values() if c]
        rows, figures = [], (sum(trained), len(trained), max(trained, default=0))
        for bid, words in zip(slices["bid"], held, strict=True):
            ids = np.fromiter((number[w] for w in words), np.int64, len(words))
            counts = np.fromiter((total[w] for w in words), np.int64, len(words))
            rows.append((bid, part, blocks.pack_ints((ids - 1 - part) // parts), blocks.pack_ints(counts), *figures))
            figures = (0, 0, 0)
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")])

    return run


class Unigrams(NamedTuple):
    n: int
    v: int
    starts: int  # training rows: how often the start is a context

    def log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + 1 * (self.v + 1)))

    def log_of_code(self, codes: np.ndarray) -> np.ndarray:
        return codes / FINE - np.log10(self.n + self.v + 1)


def code(counts: np.ndarray) -> np.ndarray:
    return np.rint(np.log10(counts + 1.0) * FINE).astype(np.int64)


#: shard rows: distinct numbers of v, u, w; the count of v where it is hot; the code of w; for each question the places of v, u, w in
#: those and of its document, and whether it trains. Shards from n_shards on are those of hot words, twice that and more carry a
#: block's own figures.
QUESTION = "shard long, bid long, v binary, hot binary, u binary, w binary, code binary, at_v binary, at_u binary, at_w binary, doc binary, train binary, own binary"


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.lexsort((b, a)) of numbers from 0."""
    wide = [int(x).bit_length() for x in (a.max(initial=0), b.max(initial=0), len(a))]
    if sum(wide) > 63:
        return np.lexsort((b, a))
    return np.sort((((a << wide[1]) | b) << wide[2]) | np.arange(len(a))) & ((1 << wide[2]) - 1)


def _ask(uni: Unigrams, parts: int, shards: int, most: int, turn: int = 0, turns: int = 1):
    """The questions to the shards of a turn, which are those of its remainder; the first one has the blocks' own figures."""

    def run(block: pd.Series, back: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        # by local number; the last one is the text's start
        ids = np.concatenate([none, *[blocks.unpack_ints(b) * parts + 1 + p for b, p in zip(back["ids"], back["part"], strict=True)], [START]])
        counts = np.concatenate([none, *[blocks.unpack_ints(b) for b in back["counts"]], [uni.starts]])
        codes, start = code(counts), len(ids) - 1
        w = blocks.unpack_ints(block["body"])
        docs = blocks.documents(block)
        lengths = np.array([n for _, n in docs], np.int64)
        first = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(docs)), lengths)
        v, u = np.concatenate([[start], w[:-1]]), np.concatenate([[start, start], w[:-2]])[: len(w)]
        v[first] = u[first] = start
        u[first[lengths > 1] + 1] = start
        trains = np.array([training(i) for i, _ in docs], bool)
        bid, rows = int(block["bid"]), []
        if turn == 0:
            base = np.bincount(doc, uni.log(counts)[w], len(docs))
            known = np.bincount(doc, (counts > 0)[w], len(docs)).astype(np.int64)
            alone = (counts == 0)[v]  # never seen as a context: the word's own probability
            score = np.bincount(doc[alone], uni.log_of_code(codes)[w[alone]], len(docs))
            held = np.array([[i or 0 for i, _ in docs], [i is None for i, _ in docs], lengths, known], np.int64)
            figures = held.tobytes() + np.array([base, score]).tobytes()
            rows.append((2 * shards + bid, bid, *[None] * 10, blocks.pack(figures)))
        # all questions of a word v are of one turn, as sums over its shards are made in it
        ask = np.nonzero(((counts > 0) & (ids % shards % turns == turn))[v])[0]
        doc, v, u, w = doc[ask], v[ask], u[ask], w[ask]
        c_v, codes = np.where(counts > most, counts, 0)[v], codes[w]
        v, u, w = ids[v], ids[u], ids[w]
        to = np.where(c_v > 0, shards + (v * 1_000_003 + w) % (shards // turns) * turns + turn, v % shards)
        order = _in_order(to, v)  # documents stay in order within v
        to, doc, v, u, w, c_v, codes = (x[order] for x in (to, doc, v, u, w, c_v, codes))
        sent, edges = np.unique(to, return_index=True)
        for s, i, j in zip(sent.tolist(), edges, [*edges[1:], len(to)], strict=True):
            k = slice(i, j)
            dv, fv, iv = np.unique(v[k], return_index=True, return_inverse=True)
            du, iu = np.unique(u[k], return_inverse=True)
            dw, fw, iw = np.unique(w[k], return_index=True, return_inverse=True)
            steps = lambda x: blocks.pack_ints(np.diff(x, prepend=0))
            rows.append(
                (s, bid, steps(dv), blocks.pack_ints(c_v[k][fv]), steps(du), steps(dw), blocks.pack_ints(codes[k][fw]))
                + tuple(blocks.pack_ints(x) for x in (iv, iu, iw, doc[k], trains[doc[k]].astype(np.int64)))
                + (None,)
            )
        return pd.DataFrame(rows, columns=[x.split()[0] for x in QUESTION.split(", ")])

    return run


class Sums(NamedTuple):
    """Of contexts over all shards: the words v, sorted, with c(v) and t(v); the pairs u v, sorted by (v, u), as owner (place of v)
    and u, with c(u v) and t(u v)."""

    words: np.ndarray
    c_v: np.ndarray
    t_v: np.ndarray
    owner: np.ndarray
    u: np.ndarray
    c: np.ndarray
    t: np.ndarray


class Trie:
    """The shard of a trie, in one mapped file."""

    def __init__(self, sequences: dict[str, EliasFano], codes: dict[str, np.ndarray], span: int):
        handle, path = tempfile.mkstemp(suffix=".trie")
        arrays = [(f"{k}.{part}", a) for k, e in sequences.items() for part, a in e.arrays.items()] + list(codes.items())
        try:
            with os.fdopen(handle, "wb") as out:
                where = []
                for name, a in arrays:
                    out.write(b"\0" * (-out.tell() % 8))
                    where.append((name, out.tell(), a.dtype, len(a)))
                    out.write(a.tobytes())
                out.write(b"\0" * 8)
            whole = np.memmap(path, np.uint8, "r")
        finally:
            os.unlink(path)  # the mapping keeps it until the task is done with it
        views = {name: whole[at : at + n * t.itemsize].view(t) for name, at, t, n in where}
        for k in sequences:
            setattr(self, k, EliasFano({p: views[f"{k}.{p}"] for p in ("head", "low", "high")}))
        self.codes, self.span = {k: views[k] for k in codes}, span

    @classmethod
    def build(cls, v, u, w, n, uni_log, sums: Sums | None = None) -> Trie:
        """From distinct trigrams sorted by (v, u, w), their counts and log P(w); sums: of contexts, where the shard has not all w."""
        words, at = _runs(v) if sums is None else (sums.words, np.searchsorted(sums.words, v))
        span = 2 + int(max(w.max(initial=0), u.max(initial=0), 0 if sums is None else sums.u.max(initial=0)))
        pair, back = np.unique(at * span + w, return_inverse=True)  # successors of v
        c_pair = np.bincount(back, n, len(pair))
        owner = pair // span
        log_w = np.zeros(len(pair))
        log_w[back] = uni_log
        follow = np.bincount(owner, minlength=len(words))
        c_v, t_v = (np.bincount(owner, c_pair, len(words)), follow) if sums is None else (sums.c_v, sums.t_v)
        p_pair = (c_pair + t_v[owner] * 10**log_w) / (c_v + t_v)[owner]
        start = np.concatenate([[0], np.cumsum(follow)]).astype(np.int64)
        if sums is None:
            before, ctx = _runs(at * span + u)  # predecessors of v
            c_ctx, t_ctx = np.bincount(ctx, n, len(before)), np.bincount(ctx, minlength=len(before))
        else:
            before, c_ctx, t_ctx = sums.owner * span + sums.u, sums.c, sums.t
            ctx = np.searchsorted(before, at * span + u)
        p_tri = (n + t_ctx[ctx] * p_pair[back]) / (c_ctx + t_ctx)[ctx]
        widest = int(follow.max()) + 1 if len(follow) else 1
        place = back - start[at]  # among the successors of v
        return cls(
            {
                "words": EliasFano.build(words),
                "first": EliasFano.build(start),
                "after": EliasFano.build(pair),
                "before": EliasFano.build(before),
                "third": EliasFano.build(np.sort(ctx * widest + place)),
            },
            {
                "weight1": _coarse(np.log10(t_v / (c_v + t_v))),
                "level2": _coarse(np.log10(p_pair)),
                "weight2": _coarse(np.log10(t_ctx / (c_ctx + t_ctx))),
                "level3": _coarse(np.log10(p_tri[np.argsort(ctx * widest + place, kind="stable")])),
                "widest": np.array([widest], np.int64),
            },
            span,
        )

    def log(self, v, u, w, uni_log) -> np.ndarray:
        coarse, bare = self.steps(v, u, w)
        return np.where(bare, uni_log, 0.0) - coarse / COARSE

    def steps(self, v, u, w) -> tuple[np.ndarray, np.ndarray]:
        """(levels' steps, whether the word's own probability comes on top), of which the logarithm is made."""
        coarse, bare = np.zeros(len(v), np.int64), np.ones(len(v), bool)
        own, which = _runs(v)
        i = self.words.find(own)[which]
        k = np.nonzero(i >= 0)[0]
        i = i[k]
        inside = w[k] < self.span - 1
        j = self.after.find(np.where(inside, i * self.span + w[k], -1))
        found = j >= 0
        coarse[k], bare[k] = np.where(found, _step(self.codes["level2"], j), _step(self.codes["weight1"], i)), ~found
        own, which = _runs(np.where(u[k] < self.span, i * self.span + u[k], -1))
        ctx = self.before.find(own)[which]
        deep = np.nonzero(ctx >= 0)[0]
        widest = int(self.codes["widest"][0])
        own, which = _runs(i[deep])
        place = j[deep] - self.first.get(own)[which]
        third = self.third.find(np.where(found[deep], ctx[deep] * widest + place, -1))
        kept = _step(self.codes["weight2"], ctx[deep]) + coarse[k[deep]]
        coarse[k[deep]] = np.where(third >= 0, _step(self.codes["level3"], third), kept)
        bare[k[deep]] &= third < 0
        return coarse, bare


def _coarse(logs: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.rint(-logs * COARSE)).astype(np.uint8)


def _step(codes: np.ndarray, i: np.ndarray) -> np.ndarray:
    return codes[np.maximum(i, 0)].astype(np.int64) if len(codes) else np.zeros(len(i), np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct, which of them each is) of sorted keys."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], np.cumsum(new) - 1


def _by_three(v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order by v, u, w; numbers from 0 of at most 31 bits."""
    wide = [int(x.max(initial=0)).bit_length() for x in (u, w)]
    words, rank = np.unique(v, return_inverse=True)
    key = (u << wide[1]) | w
    if len(words).bit_length() + sum(wide) <= 63:
        return np.argsort((rank << sum(wide)) | key)
    order = np.argsort(key)
    return order[np.argsort(rank[order], kind="stable")]


#: A block's documents in a shard: steps from one to the next, and sums over their questions: of the levels' steps, of the codes of words
#: whose own probability counts, and the number of these. Whole numbers, so sums are exact in any order.
PARTIAL = "bid long, doc binary, coarse binary, fine binary, bare binary, own binary"
PARTIAL_NAMES = [x.split()[0] for x in PARTIAL.split(", ")]


class Questions:
    """The questions of a shard's rows, and their distinct trigrams sorted by (v, u, w) with counts n over the training rows."""

    def __init__(self, rows: pd.DataFrame):
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        for r in rows.itertuples(index=False):
            dv, du, dw = (np.cumsum(blocks.unpack_ints(x)) for x in (r.v, r.u, r.w))
            iv, iu, iw, doc, train = (blocks.unpack_ints(x) for x in (r.at_v, r.at_u, r.at_w, r.doc, r.train))
            hot, codes = blocks.unpack_ints(r.hot), blocks.unpack_ints(r.code)
            for held, a in zip(cols, (dv[iv], du[iu], dw[iw], hot[iv], codes[iw].astype(np.int32), doc.astype(np.int32), train.astype(bool)), strict=True):
                held.append(a)
        self.bids, self.sizes = rows["bid"].tolist(), [len(x) for x in cols[0]]
        v, u, w, c_v, codes, self.doc, train = (np.concatenate(x) for x in cols)
        del cols
        self.order = order = _by_three(v, u, w)
        new = np.ones(len(order), bool)
        sv, su, sw = v[order], u[order], w[order]
        new[1:] = (sv[1:] != sv[:-1]) | (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])
        self.which = np.cumsum(new) - 1
        self.n = np.bincount(self.which, train[order], int(self.which[-1]) + 1)
        head = np.nonzero(new)[0]
        self.v, self.u, self.w, self.c_v, self.codes = sv[head], su[head], sw[head], c_v[order][head], codes[order][head]

    def answers(self, uni: Unigrams, sums: Sums | None = None) -> pd.DataFrame:
        """Each block's documents with the sums of their questions' logarithms."""
        seen = self.n > 0
        coarse, bare = np.zeros(len(self.v), np.int64), np.ones(len(self.v), bool)
        if seen.any() or sums is not None:
            logs = uni.log_of_code(self.codes[seen].astype(float))
            coarse, bare = Trie.build(self.v[seen], self.u[seen], self.w[seen], self.n[seen], logs, sums).steps(self.v, self.u, self.w)
        each = [np.empty(len(self.order), np.int64) for _ in range(3)]
        for a, x in zip(each, (coarse, np.where(bare, self.codes, 0), bare), strict=True):
            a[self.order] = x[self.which]
        out, at = [], 0
        for bid, size in zip(self.bids, self.sizes, strict=True):
            own, place = np.unique(self.doc[at : at + size], return_inverse=True)
            totals = [np.bincount(place, a[at : at + size], len(own)).astype(np.int64) for a in each]
            at += size
            out.append((bid, blocks.pack_ints(np.diff(own.astype(np.int64), prepend=0)), *map(blocks.pack_ints, totals), None))
        return pd.DataFrame(out, columns=PARTIAL_NAMES)


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of a task's shards for each block added up, so that a document has one entry for each task and not for each shard."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        own = batch["own"].notna()
        if own.any():
            yield batch[own]
        for r in batch[~own].itertuples(index=False):
            new = np.stack([np.cumsum(blocks.unpack_ints(r.doc)), *(blocks.unpack_ints(x) for x in (r.coarse, r.fine, r.bare))])
            old = held.get(r.bid)
            held[r.bid] = new if old is None else _summed(np.concatenate([old, new], axis=1))
    for bid, (doc, *totals) in held.items():
        sums = [bid, blocks.pack_ints(np.diff(doc, prepend=0)), *map(blocks.pack_ints, totals), None]
        yield pd.DataFrame([sums], columns=PARTIAL_NAMES)


def _summed(sums: np.ndarray) -> np.ndarray:
    doc, which = np.unique(sums[0], return_inverse=True)
    return np.stack([doc, *(np.bincount(which, x, len(doc)).astype(np.int64) for x in sums[1:])])


def _answer(uni: Unigrams):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["own"].iloc[0] is not None:  # a block's own figures pass through
            return pd.DataFrame({c: rows[c] if c in ("bid", "own") else None for c in PARTIAL_NAMES})
        return Questions(rows).answers(uni)

    return run


#: What a shard holds of c and t of contexts u v, of v alone where u is -1; `to` is where the parts are added up.
PARTS = "to long, shard long, v binary, u binary, c binary, t binary"


def _contexts(q: Questions) -> tuple[np.ndarray, ...]:
    """(v, u, c, t): a row for each context that is asked for here, u + 1 in place of u and 0 for v alone."""
    v, u = np.concatenate([q.v, q.v]), np.concatenate([q.u + 1, np.zeros(len(q.u), np.int64)])
    order = np.argsort(v * (int(u.max(initial=0)) + 1) + u)
    sv, su = v[order], u[order]
    new = np.ones(len(order), bool)
    new[1:] = (sv[1:] != sv[:-1]) | (su[1:] != su[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    total, pairs = int(new.sum()), len(q.v)
    seen = q.n > 0
    c = np.bincount(which[:pairs], q.n, total)
    t = np.bincount(which[:pairs][seen], minlength=total)
    # of v alone: distinct w
    span = int(q.w.max(initial=0)) + 1
    first = np.unique(which[pairs:][seen] * span + q.w[seen]) // span
    t += np.bincount(first, minlength=total)
    c += np.bincount(which[pairs:], q.n, total)
    head = np.nonzero(new)[0]
    return sv[head], su[head], c.astype(np.int64), t


def _parts(parts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v, u, c, t = _contexts(Questions(rows))
        to, out = (v * 1_000_003 + u) % parts, []
        for k in np.unique(to):
            i = np.nonzero(to == k)[0]
            out.append((int(k), int(rows["shard"].iloc[0]), *[blocks.pack_ints(x[i]) for x in (v, u, c, t)]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in PARTS.split(", ")])

    return run


#: The sums alone come back, in the order in which a shard asked.
ADDED = "to long, shard long, c binary, t binary"


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """The parts of each row replaced by the sums over all rows."""
    cols = [[blocks.unpack_ints(x) for x in rows[k]] for k in ("v", "u", "c", "t")]
    sizes = [len(x) for x in cols[0]]
    v, u, c, t = (np.concatenate(x) for x in cols)
    _, which = np.unique(v * (int(u.max(initial=0)) + 1) + u, return_inverse=True)
    c, t = (np.bincount(which, x)[which].astype(np.int64) for x in (c, t))
    edges = np.cumsum(sizes)[:-1]
    for name, x in (("c", c), ("t", t)):
        rows[name] = [blocks.pack_ints(y) for y in np.split(x, edges)]
    return rows[["to", "shard", "c", "t"]]


def _answer_hot(uni: Unigrams, parts: int):
    def run(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        q = Questions(rows)
        v, u, *own = _contexts(q)
        to = (v * 1_000_003 + u) % parts
        c, t = (x.astype(float) for x in own)
        for k, some, more in zip(back["to"], back["c"], back["t"], strict=True):
            at = np.nonzero(to == k)[0]
            c[at], t[at] = blocks.unpack_ints(some), blocks.unpack_ints(more)
        words, first = np.unique(q.v, return_index=True)
        alone, some = u == 0, (u > 0) & (c > 0)
        return q.answers(uni, Sums(words, q.c_v[first].astype(float), t[alone], np.searchsorted(words, v[some]), u[some] - 1, c[some], t[some]))

    return run


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _sum(uni: Unigrams):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        raw = blocks.unpack(next(x for x in rows["own"] if x is not None))
        n = len(raw) // 48
        ids, null, lengths, known = np.frombuffer(raw[: 32 * n], np.int64).reshape(4, n)
        base, score = np.frombuffer(raw[32 * n :], np.float64).reshape(2, n)
        totals = np.zeros((3, n), np.int64)
        for r in rows.itertuples(index=False):
            if r.doc is not None:
                totals[:, np.cumsum(blocks.unpack_ints(r.doc))] += [blocks.unpack_ints(x) for x in (r.coarse, r.fine, r.bare)]
        coarse, fine, bare = totals
        score = score + fine / FINE - bare * np.log10(uni.n + uni.v + 1) - coarse / COARSE
        names = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        return pd.DataFrame(
            {
                "doc_id": pd.array(names, "Int64"),
                "held_out": [not training(i) for i in names],
                "n_tokens": lengths,
                "n_known": known,
                "base_score": base,
                "score": score.round(6),
            }
        )

    return run


def _partials(asked: DataFrame, uni: Unigrams, parts: int, shards: int, any_hot: bool) -> DataFrame:
    """The sums of the questions that are asked, by block and task."""
    plain = asked.where(f"shard < {shards} OR shard >= {2 * shards}") if any_hot else asked
    partial = plain.groupBy("shard").applyInPandas(_answer(uni), PARTIAL)
    if any_hot:
        some = asked.where(f"shard >= {shards} AND shard < {2 * shards}")
        added = some.groupBy("shard").applyInPandas(_parts(parts), PARTS).groupBy("to").applyInPandas(_added, ADDED)
        partial = some.groupBy("shard").cogroup(added.groupBy("shard")).applyInPandas(_answer_hot(uni, parts), PARTIAL).union(partial)
    return partial.mapInPandas(_together, PARTIAL)


def scores(docs: DataFrame, hot: int = HOT, turns: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; docs: doc_id, text. turns: in how many
    the shards are asked, one after another; None: by the input's size."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    shards = 4 * parts  # a task works on one shard at a time
    with Scratch(spark) as work:  # the tokens go once the last questions are written
        cut = blocks.cut(docs.select("doc_id", "text"), tokens, "lm", training)
        # written, so that the corpus's figures and the answers themselves come from one exchange of the words; in the blocks' buckets,
        # so that no turn moves them
        back = stored_by(blocks.answered(cut, _count_words(parts), ANSWER).repartition(parts, "bid"), "answers", "bid", parts)
        size = back.agg(F.sum("size").alias("n"), F.sum("distinct").alias("v"), F.max("top").alias("top")).first()
        held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
        starts = docs.where(~held).count()
        uni = Unigrams(size["n"] or 0, size["v"] or 0, starts)
        back = back.select("bid", "part", "ids", "counts")
        any_hot = max(size["top"] or 0, starts) > hot
        if turns is None:
            turns = max(1, min(TURNS, parts // TURN_PARTS, uni.n // TURN_TOKENS))
        sums = []
        for turn in range(turns):
            asked = blocks.finished(cut, back, _ask(uni, parts, shards, hot, turn, turns), QUESTION)
            # by shard: they are written once and read where they lie, in place of a table, one of hot shards, and their shuffles
            where = ("questions", "shard", -(-parts // turns))
            if turn == turns - 1:
                sums.append(_partials(work.keep_by(asked, *where), uni, parts, shards, any_hot))
                continue
            with Scratch(spark) as own:  # a turn's questions go once it is answered
                sums.append(own.keep(_partials(stored_by(asked, *where), uni, parts, shards, any_hot), "sums"))
            work.kept |= own.kept
    partial = reduce(DataFrame.union, sums)
    return partial.groupBy("bid").applyInPandas(_sum(uni), SCORE).withColumn("train_tokens", F.lit(uni.n).cast("long"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
