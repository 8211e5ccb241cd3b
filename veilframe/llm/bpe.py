"""BPE encoding and decoding through a table of distinct words.

Texts are normalised and split into words as the tokenizer's own normaliser and pre-tokenizer do; each block of documents
keeps its words' positions (see blocks.py). The distinct words meet by hash and each is encoded once. Their ids are decoded by a
join with the vocabulary, a table of id and piece whose size the tokenizer file fixes, and ids and decoded words are joined back
by position.

Only tokenizers of this form are accepted: lower case, white space dropped, words split by a pattern, no decoder (pieces are
joined with a space). Special tokens inside a text become their own id, as the library does by default.

Defined cases: null text counts as empty; empty texts have no ids and decode to the empty text; repeated rows and ids are
rows of their own; a null id stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import blocks
from veilframe.llm.common import table

#: Fixed value: the split pattern of the tokenizer, with its white space written out.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+")
#: Below this code point every character is in NFC and lower-casing doesn't depend on neighbours.
BEYOND = re.compile("[^\x00-ɏ]")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if t.decoder is not None or t.normalizer is None or t.pre_tokenizer is None:
        raise ValueError("a tokenizer with a normaliser, a pre-tokenizer and no decoder is needed")
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    return t, re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None


def words(text: str, path: str) -> list[bytes]:
    t, special = _tokenizer(path)
    out: list[str] = []
    pieces = special.split(text) if special and special.search(text) else [text]
    for k, piece in enumerate(pieces):
        if k % 2:
            out.append(piece)
        elif not BEYOND.search(piece):
            out += WORD.findall(piece.lower())
        elif piece:
            plain = t.normalizer.normalize_str(piece)
            out += [plain[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(plain)]
    return [w.encode("utf-8", "surrogatepass") for w in out]


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the tokenizer file fixes how many."""
    t, _ = _tokenizer(path)
    return spark.createDataFrame([(i, x) for x, i in t.get_vocab(True).items()], "id int, piece string")


def _names(slices: pd.DataFrame) -> list[bytes]:
    """The distinct words of a word partition; a word's number is its place."""
    return sorted({w for b, n in zip(slices["body"], slices["n"], strict=True) for w in blocks.split_words(b, n)})


def _distinct(path: str):
    def run(slices: pd.DataFrame) -> pd.DataFrame:
        """The distinct words of a word partition, each encoded once."""
        t, _ = _tokenizer(path)
        names = _names(slices)
        ids: list[list[int]] = []
        for at in range(0, len(names), 20_000):
            ids += [e.ids for e in t.encode_batch([w.decode() for w in names[at : at + 20_000]], add_special_tokens=False)]
        return pd.DataFrame({"part": int(slices["part"].iloc[0]), "number": range(len(names)), "ids": ids})

    return run


def spelt(coded: DataFrame, pieces: DataFrame) -> DataFrame:
    """coded (columns, ids) with `text`: ids are joined to their pieces, which a space joins in the order of the ids."""
    own = [c for c in coded.columns if c != "ids"]
    each = coded.select(*own, F.posexplode_outer("ids").alias("_at", "id")).join(F.broadcast(pieces), "id", "left")
    held = each.groupBy(*own).agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("_at", "id", "piece")))).alias("_p"))
    return held.select(*own, F.col("_p.id").alias("ids"), F.array_join("_p.piece", " ").alias("text"))


def _answers(slices: pd.DataFrame, words_: pd.DataFrame) -> pd.DataFrame:
    """For each slice, in the order of its words: how many ids, the ids, how many bytes of text, the text."""
    number = {w: k for k, w in enumerate(_names(slices))}
    words_ = words_.sort_values("number")
    sizes = np.array([len(x) for x in words_["ids"]], np.int64)
    ids = np.concatenate([np.zeros(0, np.uint32), *[np.asarray(x, np.uint32) for x in words_["ids"]]])
    texts = [t.encode("utf-8", "surrogatepass") for t in words_["text"]]
    long = np.array([len(t) for t in texts], np.int64)
    starts, rows = np.cumsum(sizes) - sizes, []
    for bid, part, body, n in zip(slices["bid"], slices["part"], slices["body"], slices["n"], strict=True):
        k = np.fromiter((number[w] for w in blocks.split_words(body, n)), np.int64, n)
        own = blocks.pack(ids[blocks.gather(starts[k], sizes[k])])
        rows.append((bid, part, blocks.pack_ints(sizes[k]), own, blocks.pack_ints(long[k]), blocks.pack(b"".join([texts[j] for j in k.tolist()]))))
    return pd.DataFrame(rows, columns=["bid", "part", "lens", "ids", "long", "text"])


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
REAL = "doc_id long, n_tokens long, ids array<int>, decoded string"


def _finish(digest: bool):
    def run(block: pd.Series, back: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        sizes = np.concatenate([none, *[blocks.unpack_ints(x) for x in back["lens"]]])
        ids = np.concatenate([none.astype(np.uint32), *[blocks.unpack(x, np.uint32) for x in back["ids"]]])
        starts = np.cumsum(sizes) - sizes
        spelt: list[str] = []
        for long, text in zip(back["long"], back["text"], strict=True):
            raw, ends = blocks.unpack(text), np.cumsum(blocks.unpack_ints(long)).tolist()
            spelt += [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends, strict=False)]
        tokens = blocks.unpack_ints(block["body"])
        rows, at = [], 0
        for doc, n in blocks.documents(block):
            own = tokens[at : at + n]
            at += n
            got = ids[blocks.gather(starts[own], sizes[own])]
            text = " ".join([x for x in (spelt[k] for k in own.tolist()) if x])
            if digest:
                rows.append(
                    (doc, len(got), hashlib.sha256(got.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                )
            else:
                rows.append((doc, len(got), got.astype(np.int32), text))
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in (DIGEST if digest else REAL).split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return run


def encoded(docs: DataFrame, tokenizer_path: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row of docs; with digest, SHA-256 sums in place of ids and text."""
    size = blocks.BLOCK_BYTES if digest else blocks.BLOCK_BYTES // 4  # a block's ids and texts are returned together
    cut = blocks.cut(docs.select("doc_id", "text"), lambda text: words(text, tokenizer_path), "words", size_limit=size)
    coded = blocks.answered(cut, _distinct(tokenizer_path), "part int, number int, ids array<int>")
    held = spelt(coded.repartition("part"), vocabulary(docs.sparkSession, tokenizer_path))  # dealt once for all that follows
    slices = cut.where("part >= 0").groupBy("part")
    back = slices.cogroup(held.groupBy("part")).applyInPandas(_answers, "bid long, part int, lens binary, ids binary, long binary, text binary")
    return blocks.finished(cut, back, _finish(digest), DIGEST if digest else REAL)


def op6_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)
