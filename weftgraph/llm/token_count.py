"""Piece counts of a unigram tokenizer without making the pieces.

An Aho-Corasick automaton lists every vocabulary entry that ends at each
character; dynamic programming carries the best score and its piece count
forward.  The tokenizer's rules hold exactly: among equal scores the first
found wins, which is the longest piece that ends there; a character that no
entry of its own length covers may be unknown, at 10 below the least score, and
counts as its UTF-8 bytes; sums are 64-bit floats in order of the text.

A text gets a blank in front unless it has one, and is cut before every blank,
so chunks are independent: Arrow finds the distinct chunks of a block by their
bytes, and each is counted once per worker.  Rows are never shuffled.

Defined cases: null text counts as empty; an empty text has no pieces and score
0; repeated rows are counted row by row; an empty table has no rows; extra
columns are ignored; a text of any length costs memory in proportion to its own size.
"""

from __future__ import annotations

from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import binary_of

#: Bytes of text counted together, chunks that a worker remembers.
TEXTS, REMEMBERED = 8 << 20, 1_500_000
UNKNOWN = 10.0
MARK = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Entries and scores of a sentencepiece file."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(pieces.id_to_piece(i), pieces.get_score(i)) for i in range(pieces.get_piece_size())]


class Counter:
    def __init__(self, entries: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in entries:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in entries) - UNKNOWN
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.counts, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0)

    def chunk(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        at, single = 0, False
        # Entries come by their end, the longest first; an end is settled when the next one begins.
        for end, (size, s) in self.automaton.iter(text):
            while at <= end:  # settle what lies before this end
                if at and (not single):
                    self._unknown(text, at, score, count)
                at, single = at + 1, False
            before = score[end + 1 - size]
            now = before + s
            if score[end + 1] is None or now > score[end + 1]:
                score[end + 1], count[end + 1] = now, count[end + 1 - size] + 1
            single = single or size == 1
        while at <= n:
            if at and not single:
                self._unknown(text, at, score, count)
            at, single = at + 1, False
        return count[n], score[n]

    def _unknown(self, text: str, end: int, score: list, count: list) -> None:
        now = score[end - 1] + self.unknown
        if score[end] is None or now > score[end]:
            score[end], count[end] = now, count[end - 1] + len(text[end - 1].encode())

    def _learn(self, chunks: list[bytes]) -> None:
        got = [self.chunk(MARK + c[1:].decode()) for c in chunks]
        self.known.update(zip(chunks, range(len(self.counts), len(self.counts) + len(chunks))))
        self.counts = np.append(self.counts, [c for c, _ in got])
        self.scores = np.append(self.scores, [s for _, s in got])

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks, pieces and score of each text."""
        mark = MARK.encode()
        texts = [t.replace(mark, b" ") for t in texts]
        texts = [t if t[:1] == b" " or not t else b" " + t for t in texts]
        data = b"".join(texts)
        if not data:
            return np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        # A chunk is a blank and what follows it, so chunks lie next to each other.
        starts = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
        offsets = np.append(starts, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        chunks = found.dictionary.to_pylist()
        if len(self.known) + len(chunks) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.counts), len(self.counts) + len(new))
            self._learn([chunks[i] for i in new.tolist()])
        which = found.indices.to_numpy()
        n = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(t) for t in texts])))
        ends = np.cumsum(n)
        count = np.concatenate(([0], np.cumsum(self.counts[at][which])))
        # Scores of chunks are added text by text, in order.
        score, values = np.zeros(len(n)), self.scores[at][which]
        full = np.flatnonzero(n)
        if len(full):
            score[full] = np.add.reduceat(values, (ends - n)[full])
        return n, count[ends] - count[ends - n], score


_counters: dict[str, Counter] = {}
_SCHEMA = "doc_id bigint, n_chunks bigint, n_pieces bigint, score double"


def counted(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_chunks, n_pieces and score of every row.

    ``model`` names a file of the public tokenizers, found on the executor, or is a path.
    """

    def run(batches):
        import os

        if model not in _counters:
            if os.sep in model:
                found = model
            else:
                import public_tokenizers

                found = public_tokenizers.path(model)
            _counters[model] = Counter(vocabulary(str(found)))
        counter = _counters[model]
        for b in batches:
            ids, column, lo, size = b.column(0), b.column(1), 0, 0
            sizes = [len(t.as_buffer()) for t in column]
            for hi in range(1, len(column) + 1):
                size += sizes[hi - 1]
                if size >= TEXTS or hi == len(column):
                    chunks, pieces, score = counter.texts(column[lo:hi].to_pylist())
                    yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(chunks), pa.array(pieces), pa.array(score)], names=["doc_id", "n_chunks", "n_pieces", "score"])
                    lo, size = hi, 0

    return docs.select(F.col("doc_id").cast("bigint"), binary_of(F.col("text"))).mapInArrow(run, _SCHEMA)
