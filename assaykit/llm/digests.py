"""Digests of streamed conversations: what the registered queries return of long outputs.

Both read rows that lie in one partition per conversation, in order, and carry a running SHA-256
across Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assaykit.llm import chat_format
from assaykit.llm.conversation_repair import SUMMARY

REPAIR = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
          "illegal bigint, cost bigint, audit string, repaired_sha256 string")
CHAT = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint")


def repair_digests(edits: DataFrame) -> DataFrame:
    """Counts, edit letters and the digest of the repaired turns, from ``repair``."""
    names = ["conv_id", *SUMMARY.names, "audit", "repaired_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sha, first = [], hashlib.sha256(), True
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["edit"] is None:
                    out.append((r["conv_id"], *[r[n] for n in SUMMARY.names], "".join(letters),
                                sha.hexdigest()))
                    letters, sha, first = [], hashlib.sha256(), True
                    continue
                letters.append(r["edit"])
                if r["edit"] != "D":
                    sha.update(f"{'' if first else chr(10)}{r['role']}:{r['text']}".encode())
                    first = False
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], _arrow(REPAIR))

    return edits.mapInArrow(digest, REPAIR)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def chat_digests(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """What the formatted texts and the masked tokens say, from ``chat_format``.

    Turns are parsed from the text; texts under the mask are decoded from the masked ids.
    """
    path = path or chat_format.default_path()
    names = [f.split()[0] for f in CHAT.split(", ")]

    class Running:
        def __init__(self, key):
            self.key, self.turns, self.loss = key, hashlib.sha256(), hashlib.sha256()
            self.n = self.loss_chars = self.chars = 0

        def add(self, text: str, ids: np.ndarray, mask: np.ndarray) -> None:
            for role, said in chat_format.parse(text):
                self.n += 1
                self.turns.update(f"{role}\n{said}\n".encode())
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
            runs = [ids[a:b].tolist() for a, b in edges.reshape(-1, 2)]
            for said in map(chat_format.unescape, chat_format.tokenizer(path).decode_batch(
                    runs, skip_special_tokens=False)):
                self.loss_chars += len(said)
                self.loss.update(said.encode())
            self.chars += len(text)

        def row(self) -> dict:
            return dict(zip(names, (self.key, self.n, self.turns.hexdigest(), self.loss_chars,
                                    self.loss.hexdigest(), self.chars), strict=True))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            ids, masks = (batch.column(n) for n in ("token_ids", "loss_mask"))
            for at, (key, block, text) in enumerate(zip(
                    *(batch.column(n).to_pylist() for n in ("conv_id", "block", "formatted")),
                    strict=True)):
                if block == 0:
                    if own is not None:
                        out.append(own.row())
                    own = Running(key)
                own.add(text, ids[at].values.to_numpy(),
                        masks[at].values.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pylist(out, _arrow(CHAT))
        if own is not None:
            yield pa.RecordBatch.from_pylist([own.row()], _arrow(CHAT))

    return formatted.select("conv_id", "block", "formatted", "token_ids", "loss_mask").mapInArrow(
        digest, CHAT)
