"""Token ids of whole texts under a public tokenizer file, word by word.

The tokenizer splits at white space and never joins across it, so each distinct word is encoded
once and remembered. The memory holds at most ``KEPT`` words, until the worker turns to another
operator, and the distinct words of one slice of texts besides.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from assaykit.llm.words import SLICE_BYTES, kept

KEPT = 1 << 19
_MARK = "\x01"
_BREAKS = re.compile(r"[ \t\n\r\f\v]+")
_STEM = re.compile(r"([!-~\xa1-\xff]*[0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])([!-/:-@\[-`{-~]*)")
# How a vocabulary must treat words whose stems and closing punctuation are encoded apart.
_LOWER_CASED = 'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])'
_CUT_AT_KINDS = (
    r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|"""
    r"""[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, """
    r"""trim_offsets=True, use_regex=False)])""")


def default_path() -> str:
    """The word-level public vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "Encoder":
    """One encoder per worker and vocabulary file."""
    encoders = kept("tokens")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def _bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {"": b""}
        self.apart = (repr(self.tokenizer.normalizer) == _LOWER_CASED
                      and repr(self.tokenizer.pre_tokenizer) == _CUT_AT_KINDS)
        self.mark, = self.tokenizer.encode(_MARK, add_special_tokens=False).ids

    @staticmethod
    def split(text: str) -> list[str]:
        # str.split also breaks at 0x1C-0x1F, which the vocabulary's white space lacks
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in _BREAKS.split(text) if w]
        return text.split()

    def form(self, word: str) -> tuple[str, str]:
        """(stem, closing punctuation) with the ids of the word, one after the other.

        Where the vocabulary lower-cases and cuts between a letter or digit and punctuation. Only
        words of Latin-1 are taken apart: there, case and normal form go character by character.
        """
        parts = _STEM.fullmatch(word) if self.apart and "<|" not in word else None
        return (parts[1].lower(), parts[2]) if parts else (word, "")

    def _encode_words(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words: many at a time, joined by a mark that no word holds."""
        found, joined = {}, []
        for w in new:
            if _MARK in w or "<|" in w:
                found[w] = _bytes(self.tokenizer.encode(w, add_special_tokens=False).ids)
            else:
                joined.append(w)
        for at in range(0, len(joined), 1024):
            some = joined[at:at + 1024]
            # fast: without the places of the ids in the text
            encoded, = self.tokenizer.encode_batch_fast([f" {_MARK} ".join(some)],
                                                        add_special_tokens=False)
            ids = np.asarray(encoded.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), ids.size).tolist()
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                found[w] = raw[4 * start:4 * end]
                start = end + 1
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.split(t) for t in texts]
        own = dict.fromkeys(chain.from_iterable(parts))
        kept, new = self.kept, []
        for w in own:
            own[w] = ids = kept.get(w)
            if ids is None:
                new.append(w)
        forms = [self.form(w) for w in new]
        pieces = dict.fromkeys(chain.from_iterable(forms))
        found = self._encode_words([p for p in pieces if p not in kept])
        for p in pieces:
            pieces[p] = found[p] if p in found else kept[p]
        if len(kept) + len(found) <= KEPT:
            kept.update(found)
        for w, (stem, tail) in zip(new, forms, strict=True):
            own[w] = pieces[stem] + pieces[tail] if tail else pieces[stem]
        if len(kept) + len(new) <= KEPT:
            kept.update((w, own[w]) for w in new)
        get = own.__getitem__      # of this slice: small, so that looking up is cheap
        return [b"".join(map(get, p)) for p in parts]


def text_slices(texts: list[str], limit: int = SLICE_BYTES >> 2):
    """Runs of whole texts of about ``limit`` characters."""
    run, size, at = [], 0, 0
    for k, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield at, run
            run, size, at = [], 0, k
        run.append(t)
        size += len(t)
    if run:
        yield at, run
