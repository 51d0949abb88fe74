"""Ids by chunks against whole texts given to the tokenizer."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import LONG, ODD
from weftgraph.llm import encoding

PATH = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n, a, b):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def same(encoder, plain, texts):
    ids, at = encoder.ids([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [encoding.END], t


def test_random_texts():
    r, encoder, plain = random.Random(4), encoding.Encoder(PATH), Tokenizer.from_file(PATH)
    abc = "aAbBsStTxXhH.,!?;:'<|> \n\t\x0b\x1c0éÉ̱́ßİÞÐ×÷ªº—«» \u0085　"
    texts = ["".join(r.choice(abc) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|StartOfText|>.", "<|ENDOFTEXT|>", "don't. WE'LL, 's.", LONG] + [t or "" for _, t, *_ in ODD]
    same(encoder, plain, texts)
    same(encoder, plain, texts[::-1])  # all chunks known by now


@pytest.mark.parametrize("letters", ["ab", ".,", ".!"])
def test_long_words_in_two_patterns_are_told_apart(letters):
    encoder, plain = encoding.Encoder(PATH), Tokenizer.from_file(PATH)
    a, b = letters
    same(encoder, plain, [w for n in (1024, 4096) for w in (thue_morse(n, a, b), thue_morse(n, b, a))])


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 5)
    encoder, plain = encoding.Encoder(PATH), Tokenizer.from_file(PATH)
    for part in (["one two three"], ["four five six.", "one"], ["seven one two"]):
        same(encoder, plain, part)


def test_other_tokenizer_files_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = encoding.Encoder(path)
    assert not encoder.by_chunk
    same(encoder, Tokenizer.from_file(path), ["", " a b", "a  b.", "x" * 50, "é\n\n"])


def test_nothing():
    ids, at = encoding.Encoder(PATH).ids([])
    assert len(ids) == 0 and at.tolist() == [0]


def test_words_in_two_patterns_have_different_hashes():
    from weftgraph.llm.words import hashed

    pairs = [thue_morse(n, a, b) for n in (1024, 4096, 1 << 16) for a, b in ("ab", "ba", ".,", ",.")]
    h, at = hashed([w.encode() for w in pairs])
    assert len(set(h.tolist())) == len(pairs) and at.tolist() == list(range(len(pairs) + 1))


def test_piece_counts_of_long_words_in_two_patterns():
    from weftgraph.llm import token_count

    entries = token_count.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for n in (1024, 4096):
        both = [thue_morse(n, "a", "r").encode(), thue_morse(n, "r", "a").encode()]
        _, pieces, score = token_count.Counter(entries).texts(both)
        alone = [token_count.Counter(entries).texts([t]) for t in both]
        assert (pieces.tolist(), score.tolist()) == ([a[1][0] for a in alone], [a[2][0] for a in alone])
