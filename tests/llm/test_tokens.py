"""Ids of whole texts word by word, against the plain tokenizer."""

import itertools
import random

from tokenizers import Tokenizer, normalizers

from assaykit.llm.tokens import Encoder, default_path

PARTS = ["Foo", "foo", "FOO", "don't", "'s", "O'S", "É", "é", "ß", "ÿ", "µ", "ª", "İ", "ǅ", "Σ",
         "ΑΣ", "e\u0301", "\u0301", "a\u0338", "\u0338", "\u0958", "7", "x1", "½", "!", "!!", ".", ",",
         "'", "_", "&", "=", "<", "<|", "|>", "<|endoftext|>", "\x01", "\x7f", "\xad", "«", "×", "…", "🙂"]


def plain(path, texts):
    tok = Tokenizer.from_file(path)
    return [tok.encode(t, add_special_tokens=False).ids for t in texts]


def ids(codes):
    return [list(memoryview(c).cast("I")) for c in codes]


def test_odd_words():
    words = ["".join(p) for n in (1, 2) for p in itertools.product(PARTS, repeat=n)]
    rng = random.Random(3)
    words += ["".join(rng.choices(PARTS, k=rng.randint(3, 6))) for _ in range(3000)]
    encoder = Encoder(default_path())
    for _ in range(2):      # the second time from memory
        assert ids(encoder.encode(words)) == plain(default_path(), words)
    text = " ".join(words)
    assert ids(encoder.encode([text, "", text])) == plain(default_path(), [text, "", text])


def test_case_and_closing_punctuation_cost_no_encoding():
    encoder, asked = Encoder(default_path()), []
    encode = encoder._encode_words
    encoder._encode_words = lambda new: asked.extend(new) or encode(new)
    texts = ["Foo foo, FOO!! (foo", "foo. Éa éa, foo!!"]
    assert ids(encoder.encode(texts)) == plain(default_path(), texts)
    assert sorted(asked) == sorted(["foo", ",", "!!", "(foo", ".", "éa"])


def test_full_memory(monkeypatch):
    monkeypatch.setattr("assaykit.llm.tokens.KEPT", 3)
    encoder = Encoder(default_path())
    for text in ("One two", "one, TWO three four", "Five. one; two! six"):
        assert ids(encoder.encode([text])) == plain(default_path(), [text])
    assert len(encoder.kept) <= 3


def test_a_cased_vocabulary_keeps_words_whole(tmp_path):
    path = str(tmp_path / "cased.json")
    tok = Tokenizer.from_file(default_path())
    tok.normalizer = normalizers.NFC()
    tok.save(path)
    encoder = Encoder(path)
    assert not encoder.apart and encoder.form("Foo!") == ("Foo!", "")
    texts = ["Foo foo FOO! foo!"]
    assert ids(encoder.encode(texts)) == plain(path, texts)
