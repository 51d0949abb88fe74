"""Token ids of many texts, the same as the tokenizer gives for each whole text.

A tokenizer that drops white space never joins two white-space chunks, so a
text's ids are those of its chunks.  Arrow cuts the texts of a block and finds
its distinct chunks by their bytes; each is looked up in a dictionary and only
new ones are encoded.  To have fewer different ones, A-Z is lowered and a blank
put between a letter and a closing mark in texts without combining marks and
``<``: there neither changes the ids.  Chunks of plain letters go to the
tokenizer's merges as one joined string, without the normaliser and patterns
that would not change them; every id that ends a word ends a chunk.  All other
chunks take the whole tokenizer, and a tokenizer file with other rules than
``KNOWN`` is given whole texts only.

Defined cases: an empty text has the end id alone; a text of any length costs
memory in proportion to its own size.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 1
#: Bytes of text encoded together, and distinct chunks that a worker remembers before it starts anew.
TEXTS, REMEMBERED = 8 << 20, 1_200_000
#: The rules (normaliser, pre-tokenizer) under which chunks may be encoded apart.
KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Letters that are one code point in NFC with a lower case in Latin-1, then closing marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)").fullmatch


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_MARK[list(b".,!?;:")] = True
#: First bytes of U+0300 and beyond, where combining marks are, and the first byte of a special token's name.
_ODD = np.zeros(256, dtype=bool)
_ODD[0xCC:] = True
_ODD[ord("<")] = True


def _eased(texts: pa.Array) -> pa.Array:
    """The texts in a form with fewer different chunks and the same ids."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset)
    data = texts.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return texts
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    odd = np.concatenate(([0], np.flatnonzero(_ODD[buf]) + 1))  # places, after a first that no text has
    met = np.searchsorted(odd, offsets + 1)
    easy = np.diff(met) == 0
    low = _LOWER[buf]
    cut = np.flatnonzero(_MARK[low[1:]] & _LETTER[low[:-1]]) + 1
    if not easy.all():
        inside = np.repeat(easy, np.diff(offsets))
        low = np.where(inside, low, buf)
        cut = cut[inside[cut]]
    low = np.insert(low, cut, 32)
    offsets = offsets + np.searchsorted(cut, offsets)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(low))


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_chunk = (rules["normalizer"], rules["pre_tokenizer"]) == KNOWN and rules["model"].get("end_of_word_suffix") == "</w>"
        self.merges = Tokenizer.from_file(path)
        for t in (self.tokenizer, self.merges):
            t.no_truncation()
            t.no_padding()
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _add(self, chunks: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.size), len(self.size) + len(chunks))))
        self.first = np.concatenate((self.first, np.cumsum(size) - size + len(self.flat)))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(size.sum())), size

    def _learn(self, chunks: list[str]) -> None:
        """Ids of chunks that are all new and different."""
        plain = [_PLAIN(c) for c in chunks]
        words = [m.group(1).lower() if m else "" for m in plain]
        new = list({w for w in words if w and w not in self.known})
        if new:
            flat = np.array(self.merges.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            self._add(new, flat, np.diff(np.flatnonzero(self.closes[flat]), prepend=-1))
        marks = list({m.group(2) for m in plain if m and m.group(2) and m.group(2) not in self.known})
        odd = [c for c, m in zip(chunks, plain) if not m and c not in self.known]
        if marks or odd:
            self._add(marks + odd, *self._whole(marks + odd))
        # Capitals and closing marks: the word's ids, then those of the marks.
        rest = [(c, self.known[w], self.known[m.group(2)] if m.group(2) else -1) for c, m, w in zip(chunks, plain, words) if m and c not in self.known]
        if rest:
            at = np.array([(w, k) for _, w, k in rest], dtype=np.int64).ravel()
            some = at >= 0
            flat, size = self._gather(at[some])
            both = np.zeros(len(at), dtype=np.int64)
            both[some] = size
            self._add([c for c, *_ in rest], flat, both.reshape(-1, 2).sum(axis=1))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[at]
        return self.flat[np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n

    def ids(self, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, places where each text begins, and the end); every text closes with END."""
        texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        if not self.by_chunk:
            flat, n = self._whole(texts.to_pylist())
            return np.insert(flat, np.cumsum(n), END).astype(np.uint32), np.concatenate(([0], np.cumsum(n + 1)))
        lists = pc.ascii_split_whitespace(_eased(texts))
        per_text = np.diff(lists.offsets.to_numpy())
        found = lists.flatten().dictionary_encode()
        chunks = found.dictionary.to_pylist()
        if len(self.known) + len(chunks) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown = [chunks[i] for i in new.tolist()]
            self._learn(unknown)
            at[new] = np.fromiter(map(self.known.__getitem__, unknown), dtype=np.int64, count=len(unknown))
        size, first = np.append(self.size[at], 1), np.append(self.first[at], len(self.flat))
        # An END after the chunks of each text.
        ends = np.cumsum(per_text)
        which = np.insert(found.indices.to_numpy().astype(np.int64), ends, len(chunks))
        n = size[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = np.append(self.flat, np.uint32(END))[np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.concatenate(([0], upto[ends + np.arange(1, len(ends) + 1)]))


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The worker's encoder for a file of the public tokenizers, found on the executor, or for a path."""
    if tokenizer not in _encoders:
        found = tokenizer
        if os.sep not in tokenizer:
            import public_tokenizers

            found = public_tokenizers.path(tokenizer)
        _encoders[tokenizer] = Encoder(str(found))
    return _encoders[tokenizer]


def text_blocks(column: pa.Array, limit: int = TEXTS):
    """Ranges of rows whose texts have about ``limit`` bytes together; a longer text is a block of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
