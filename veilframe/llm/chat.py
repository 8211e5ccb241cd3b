"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: `<|turn|>role<|text|>text<|end|>` for each turn. A backslash and the second character of
every control string (ours, and those of common templates) inside a role or text get a backslash before them, so no text can
hold a control string and the rendering reads back exactly. The rendering is encoded once with offsets, and sorted spans of
assistant texts are intersected with the sorted token spans by binary search: the mask is a list of (token, start, end)
overlaps in code points, one or more tokens a text, nothing of the markers. The control strings are single tokens, so
tokens don't cross a marker.

Defined cases: null text or role counts as empty, null turn sorts first, ties of turn by role and text; a null conv_id
is a conversation of its own; empty texts have no mask; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What marks turns in common templates.
CONTROL = r"<\||</?s>|\[/?INST\]|<</?SYS>>|\|>"
ESCAPED = re.compile(rf"\\|{CONTROL}")
PAIR = re.compile(r"\\(.)", re.DOTALL)
FORMAT = "conv_id long, formatted string, token_ids array<int>, loss_tokens array<int>, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return PAIR.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering, and the spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, text = piece[len(TURN) :].split(TEXT, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def overlaps(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, from, to) of every overlap; starts and ends of tokens ascend. Characters that several tokens share (one code
    point in several byte tokens) count for the first of them."""
    tokens, lows, highs = [], [], []
    own = np.maximum(starts, np.concatenate([[0], np.maximum.accumulate(ends)[:-1]])) if len(ends) else starts
    for a, b in spans:
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        k = np.arange(first, last)
        low, high = np.maximum(own[k], a), np.minimum(ends[k], b)
        some = high > low
        tokens.append(k[some])
        lows.append(low[some])
        highs.append(high[some])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (tokens, lows, highs))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
    return t


def formatted(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each conversation: its rendering, token ids and loss mask. A conversation is one unit of work; its turns
    are gathered in the JVM, and a batch of conversations is encoded at a time."""
    gathered = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.struct(
                F.col("turn").alias("turn"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t"), _by_turn).alias("turns"))
        .select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some, rows = batch.iloc[at : at + 256], []
                made = [render(list(zip(r, t, strict=True))) for r, t in zip(some["roles"], some["texts"], strict=True)]
                for conv, (text, spans), e in zip(
                    some["conv_id"],
                    made,
                    tokenizer.encode_batch([m[0] for m in made], add_special_tokens=False),
                    strict=True,
                ):
                    where = np.array(e.offsets, np.int64).reshape(-1, 2)
                    k, low, high = overlaps(where[:, 0], where[:, 1], spans)
                    rows.append((conv, text, e.ids, k, low, high))
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in FORMAT.split(", ")])
                frame["conv_id"] = frame["conv_id"].astype("Int64")
                yield frame

    return gathered.mapInPandas(encode, FORMAT)


def _by_turn(a, b):
    """Nulls first, then turn, role and text."""

    def order(x, y):
        return F.when(x < y, -1).when(x > y, 1)

    null_turn = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(
        null_turn, order(a["turn"], b["turn"]), order(a["role"], b["role"]), order(a["text"], b["text"]), F.lit(0)
    )


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rows: DataFrame) -> DataFrame:
    """What the rendering and the mask alone give back."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, text, low, high in zip(b["conv_id"], b["formatted"], b["loss_starts"], b["loss_ends"], strict=True):
                turns = read_back(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                # a token may end between an escape and what it escapes, so the masked parts are joined first
                loss = unescape("".join(text[i:j] for i, j in zip(low, high, strict=True)))
                out.append(
                    (conv, len(turns), _sha(whole), len(loss), _sha(loss), len(text))
                )
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in DIGEST.split(", ")])
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    return rows.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInPandas(read, DIGEST)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op5_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(formatted(rows, public_tokenizers.path("byte_bpe_50k.json")))
