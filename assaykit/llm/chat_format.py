"""Chat formatting with loss masks (operator 13).

A conversation is rendered as one text, ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each
turn, encoded once with character offsets, and every token that lies within an assistant's text
gets a loss. Turn spans and token spans are both sorted, so binary search finds each span's
tokens. The three markers are added tokens, so no token crosses the edge of a text.

Control strings inside roles and texts are escaped: where ``<``, any number of backslashes and
``|`` follow each other, one backslash more is put in. The result holds no ``<|``, and taking
one backslash out again gives the text back.

Turns are partitioned by conversation, sorted by (turn, role, text), null turns first, and
streamed. A conversation is one row, or several where it exceeds ``BLOCK_CHARS``: cut between
turns, where a marker separates the tokens, so the ids and offsets are those of the whole and
memory holds one block and one text at most.

Null role or text counts as empty. A null conversation id is one conversation. Empty texts have
no tokens. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.words import kept

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"
BLOCK_CHARS = 1 << 20
BATCH_CHARS = 1 << 21                 # characters that are encoded together
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)

FORMATTED = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("block", T.LongType()),
    T.StructField("first_char", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("token_ids", T.ArrayType(T.IntegerType())),
    T.StructField("token_starts", T.ArrayType(T.LongType())),
    T.StructField("token_ends", T.ArrayType(T.LongType())),
    T.StructField("loss_mask", T.ArrayType(T.BooleanType()))])
_ARROW = pa.schema([("key", pa.string()), ("block", pa.int64()), ("first_char", pa.int64()),
                    ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())),
                    ("token_starts", pa.list_(pa.int64())), ("token_ends", pa.list_(pa.int64())),
                    ("loss_mask", pa.list_(pa.bool_()))])


def default_path() -> str:
    """The byte-level public vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    """One tokenizer per worker and file, with the markers as added tokens."""
    tokenizers = kept("chat")
    if path not in tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer
        own = Tokenizer.from_file(path)
        own.add_special_tokens([AddedToken(m, special=True, normalized=False)
                                for m in (START, SEP, END)])
        tokenizers[path] = own
    return tokenizers[path]


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that lie within one of the sorted, disjoint spans, by binary search."""
    at = np.asarray(spans, np.int64).reshape(-1, 2)
    lo = np.searchsorted(starts, at[:, 0], "left")
    hi = np.maximum(np.searchsorted(ends, at[:, 1], "right"), lo)
    change = np.zeros(starts.size + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    return np.cumsum(change[:-1]) > 0


class Block:
    """A conversation's rendered turns so far, with the spans of its learned texts."""

    def __init__(self, key: str | None, number: int = 0, first_char: int = 0):
        self.key, self.number, self.first_char = key, number, first_char
        self.parts: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.size = 0

    def add(self, role: str, text: str) -> None:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        start = self.size + len(head)
        if role == LEARNED:
            self.spans.append((start, start + len(body)))
        self.parts += [head, body, END]
        self.size = start + len(body) + len(END)


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Block]:
    own = None
    for batch in batches:
        for key, role, text in zip(*(batch.column(n).to_pylist() for n in ("key", "role", "text")),
                                   strict=True):
            if own is None or own.key != key:
                if own is not None:
                    yield own
                own = Block(key)
            elif own.size >= limit:
                yield own
                own = Block(key, own.number + 1, own.first_char + own.size)
            own.add(role, text)
    if own is not None:
        yield own


def encoded(some: list[Block], path: str) -> pa.RecordBatch:
    texts = ["".join(b.parts) for b in some]
    columns: list[list] = [[] for _ in _ARROW]
    for b, text, e in zip(some, texts, tokenizer(path).encode_batch(
            texts, add_special_tokens=False), strict=True):
        offsets = np.asarray(e.offsets, np.int64).reshape(-1, 2)
        starts, ends = offsets[:, 0].copy(), offsets[:, 1].copy()
        row = (b.key, b.number, b.first_char, text, np.asarray(e.ids, np.int32),
               starts + b.first_char, ends + b.first_char, loss_mask(starts, ends, b.spans))
        for c, v in zip(columns, row, strict=True):
            c.append(v)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)],
                           schema=_ARROW)


def chat_format(conversations: DataFrame, path: str | None = None, conv: str = "conv_id",
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Formatted text, token ids, token spans and loss mask of every conversation.

    Columns: ``conv``, ``block`` and ``first_char`` (of the block in the conversation),
    ``formatted``, ``token_ids``, ``token_starts``, ``token_ends`` (characters of the whole
    conversation), ``loss_mask``. A conversation's blocks lie in one partition, in order.
    ``path`` is a byte-level tokenizer file.
    """
    path = path or default_path()
    turns = (conversations.select(
        F.col(conv).cast("string").alias("key"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
        .repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
        .select("key", "role", "text"))

    def render(batches):
        some, size = [], 0
        for b in blocks(batches, block_chars):
            some.append(b)
            size += b.size
            if size >= BATCH_CHARS:
                yield encoded(some, path)
                some, size = [], 0
        if some:
            yield encoded(some, path)

    kind = conversations.schema[conv].dataType
    return (turns.mapInArrow(render, FORMATTED)
            .select(F.col("key").cast(kind).alias(conv), *FORMATTED.names[1:]))
