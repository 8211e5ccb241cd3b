"""Blocks of documents with a vocabulary of their own, and exchanges of word tables between blocks and word partitions.

A block is a run of one task's documents up to BLOCK_BYTES of text. Its tokens are numbers of words in its own vocabulary,
which is cut into slices by a hash of the word. Slices travel to word partitions, where all slices with the same words meet,
and answers travel back in the order of the slice, so that neither the corpus's vocabulary nor its tokens ever stand in one
place. A word is at most once in a block's slice, so the most frequent word weighs no more than any other.
"""

from __future__ import annotations

import ctypes
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import shuffle_partitions, stored_by

BLOCK_BYTES = 8 << 20
LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
SCHEMA = "bid long, part int, n long, body binary, docs binary"


def release() -> None:
    """Give memory that Arrow and the C library keep for later back: workers live on, and an executor's limit counts all of them."""
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def pack(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype=None):
    raw = zstandard.ZstdDecompressor().decompress(b)
    return raw if dtype is None else np.frombuffer(raw, dtype)


def pack_ints(a: np.ndarray) -> bytes:
    """Whole numbers from 0, in the narrowest type, one byte plane after another."""
    top = int(a.max()) if len(a) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").ravel().astype(np.int64)


def documents(block: pd.Series) -> list[tuple[int | None, int]]:
    """(doc_id, number of tokens) of a block's documents, in order."""
    ids, null, lengths = unpack(block["docs"], np.int64).reshape(3, -1).tolist()
    return [(None if x else i, n) for i, x, n in zip(ids, null, lengths, strict=True)]


def by_slice(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words by slice, slice of each word)."""
    at = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
    return np.argsort(at, kind="stable"), at


def split_words(packed: bytes, n: int) -> list[bytes]:
    return unpack(packed).split(b"\n") if n else []


def cut(docs: DataFrame, words_of: Callable[[str], list[bytes]], label: str, counts: Callable | None = None, size_limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (part -1: tokens) and the slices of their vocabularies, written once, bucketed so that tokens never move.

    docs: doc_id long, text string. words_of: the words of a text, none with a line feed. counts: whether a document with that
    id counts; a slice then holds, in `docs`, how often each word occurs in those.
    """
    parts = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count = TaskContext.get().partitionId(), 0
        vocab: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)  # a new word gets the next number
        ids, lengths, tokens, size = [], [], [], 0

        def flush() -> pd.DataFrame:
            words = list(vocab)  # in the order of their numbers
            order, at = by_slice(words, parts)
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            local = place[np.concatenate(tokens)].astype(np.int64) if words else np.zeros(0, np.int64)
            bid = (task << 24) + count
            held = np.array([[i or 0 for i in ids], [i is None for i in ids], lengths], np.int64)
            rows = [(bid, -1, len(words), pack_ints(local), pack(held))]
            number = np.zeros(len(words), np.int64)
            if counts:
                used = np.repeat([counts(i) for i in ids], lengths)
                number = np.bincount(local[used], minlength=len(words))
            edges = np.searchsorted(at[order], np.arange(parts + 1))
            for p in range(parts):
                if edges[p] < edges[p + 1]:
                    some = [words[k] for k in order[edges[p] : edges[p + 1]]]
                    own = pack_ints(number[edges[p] : edges[p + 1]]) if counts else None
                    rows.append((bid, p, len(some), pack(b"\n".join(some)), own))
            release()
            return pd.DataFrame(rows, columns=["bid", "part", "n", "body", "docs"])

        for batch in batches:
            known = batch["doc_id"].isna()
            for doc, null, text in zip(batch["doc_id"], known, batch["text"], strict=True):
                words = words_of(text or "")
                tokens.append(np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words)))
                ids.append(None if null else int(doc))
                lengths.append(len(words))
                size += len(text or "") + 64
                if size >= size_limit:
                    yield flush()
                    count += 1
                    vocab = defaultdict(itertools.count().__next__)
                    ids, lengths, tokens, size = [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored_by(rows.mapInPandas(run, SCHEMA), label, "bid", parts)


def answered(blocks: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """answer(all slices of one word partition, in any order) for each word partition."""
    return blocks.where("part >= 0").groupBy("part").applyInPandas(answer, schema)


def finished(blocks: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(block row, its answers by part) for each block."""

    def run(block: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        return finish(block.iloc[0], back.sort_values("part"))

    own = blocks.where("part = -1")
    return own.groupBy("bid").cogroup(answers.groupBy("bid")).applyInPandas(run, schema)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs start .. start + size, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
