"""Token ids in directly addressable codes.

An id is split into chunks of bits, lowest first.  Level l holds the l-th chunk
of every id that has one, packed; a bitmap per level marks the ids that go on
to the next, and a directory counts the marks before every 512 bits.  So any
id is read without decoding others: read its chunk, and if its mark is set,
its place in the next level is the number of marks before it.

A file set is a table of segments.  A segment holds whole documents in
ascending order of id and about ``SEGMENT`` tokens.  Documents are dealt to
ranges of ids and written in order; a document's place among all tokens is the
sum of what lies before its segment, found from one narrow row per segment.
Spark's own commit protocol makes the files safe against retries.

Texts are encoded as ``encoding`` says: the same ids as for whole texts, each
distinct chunk encoded once per worker.

Defined cases: null text counts as empty; an empty text has the end id alone;
rows that repeat an id are written one after the other in the order of their
texts' hashes; null ids come first; an empty table gives no segments.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import binary_of
from weftgraph.llm.encoding import encoder, text_blocks
from weftgraph.session import materialize, scratch_path

#: Tokens of a segment.
SEGMENT = 1 << 20
_BLOCK = 512


# --- codes ----------------------------------------------------------------------------------


def _widths(ids: np.ndarray) -> list[int]:
    """Bits per level, in half bytes, for which levels, bitmaps and directories are smallest."""
    length = np.frexp(ids.astype(np.float64))[1]
    longer = len(ids) - np.cumsum(np.bincount(length, minlength=34))  # ids with more bits than b
    top = -(-max(1, int(length.max(initial=1))) // 4) * 4
    best: dict[int, tuple[float, list[int]]] = {top: (0.0, [])}
    for b in range(top - 4, -1, -4):
        n = len(ids) if b == 0 else int(longer[b])
        best[b] = min(((n * (to - b + (1 + 32 / _BLOCK) * (to < top)) + best[to][0], [to - b, *best[to][1]]) for to in range(b + 4, top + 1, 4)), key=lambda x: x[0])
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of a whole number of half bytes each, lowest first."""
    half = ((values[:, None] >> np.arange(0, width, 4, dtype=np.uint32)) & np.uint32(15)).astype(np.uint8).ravel()
    if len(half) % 2:
        half = np.append(half, np.uint8(0))
    return (half[0::2] | half[1::2] << 4).tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint32)
    packed = np.frombuffer(data, dtype=np.uint8)
    half = np.stack((packed & 15, packed >> 4), axis=1).ravel()[: n * width // 4].reshape(n, -1)
    out = np.zeros(n, dtype=np.uint32)
    for j in range(width // 4):
        out |= half[:, j].astype(np.uint32) << np.uint32(4 * j)
    return out


def encode(ids: np.ndarray) -> bytes:
    """A segment's tokens: header, then chunks, marks and directory of each level."""
    rest = ids.astype(np.uint32)
    widths = _widths(rest)
    head, body = [len(widths), len(ids)], []
    for i, w in enumerate(widths):
        last = i + 1 == len(widths)
        chunks = _pack(rest & np.uint32((1 << w) - 1), w)
        on = np.zeros(0, dtype=bool) if last else rest >= np.uint32(1 << w)
        marks = np.packbits(on, bitorder="little").tobytes()
        counts = np.add.reduceat(on, np.arange(0, len(on), _BLOCK)) if len(on) else np.zeros(0, dtype=np.int64)
        directory = np.concatenate(([0], np.cumsum(counts)))[:-1].astype("<u4").tobytes() if len(on) else b""
        head += [w, len(rest), len(chunks), len(marks), len(directory)]
        body += [chunks, marks, directory]
        rest = rest[on] >> np.uint32(w) if not last else rest
    return np.array(head, dtype="<u8").tobytes() + b"".join(body)


class Codes:
    """Reader of one segment."""

    def __init__(self, data: bytes):
        n_levels, self.n = (int(x) for x in np.frombuffer(data, dtype="<u8", count=2))
        head = np.frombuffer(data, dtype="<u8", count=5 * n_levels, offset=16).reshape(-1, 5).astype(np.int64)
        at, self.levels = 16 + 40 * n_levels, []
        for w, n, *sizes in head.tolist():
            parts = []
            for s in sizes:
                parts.append(data[at : at + s])
                at += s
            self.levels.append((w, n, *parts))

    def all(self) -> np.ndarray:
        out, where, shift = np.zeros(self.n, dtype=np.uint32), None, 0
        for w, n, chunks, marks, _ in self.levels:
            got = _unpack(chunks, n, w) << np.uint32(shift)
            if where is None:
                where = np.arange(n)
            out[where] |= got
            if marks:
                where = where[np.unpackbits(np.frombuffer(marks, dtype=np.uint8), count=n, bitorder="little").astype(bool)]
            shift += w
        return out

    def get(self, i: int) -> int:
        """The i-th token, from one chunk, mark and directory entry per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for w, _, chunks, marks, directory in self.levels:
            first, last = i * w // 8, ((i + 1) * w + 7) // 8
            value |= (int.from_bytes(chunks[first:last], "little") >> (i * w % 8) & ((1 << w) - 1)) << shift
            if not marks or not marks[i // 8] >> (i % 8) & 1:
                break
            block = i // _BLOCK
            before = int.from_bytes(marks[block * _BLOCK // 8 : i // 8 + 1], "little") & ((1 << (i - block * _BLOCK)) - 1)
            i = int.from_bytes(directory[4 * block : 4 * block + 4], "little") + before.bit_count()
            shift += w
        return value


# --- tokens ---------------------------------------------------------------------------------


_SEGMENTS = "part int, seq int, n_docs bigint, n_tokens bigint, doc_ids binary, no_ids binary, ends binary, codes binary"


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode ``doc_id`` and ``text`` of ``docs`` and write the segments to ``path``.

    ``tokenizer`` names a file of the public tokenizers, found on the executor, or is a path.
    """

    def run(batches):
        from pyspark import TaskContext

        codes_of, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, ends, docs_in, held = [], [], [], 0

        def segment():
            every = np.concatenate(ids)
            numbers = np.array([d or 0 for d in docs_in], dtype="<i8").tobytes()
            nulls = np.packbits(np.array([d is None for d in docs_in]), bitorder="little").tobytes()
            row = [part, seq, len(docs_in), len(every), numbers, nulls, np.cumsum(np.concatenate(ends)).astype("<u8").tobytes(), encode(every)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])

        for b in batches:
            numbers, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in text_blocks(texts):
                got, at = codes_of.ids(texts.slice(lo, hi - lo))
                n, first = np.diff(at), 0
                while first < len(n):  # whole documents up to the size of a segment
                    room = np.searchsorted(at[first + 1 :] - at[first], SEGMENT - held, side="right")
                    upto = first + max(int(room), 0 if held else 1)
                    if upto > first:
                        ids.append(got[at[first] : at[upto]])
                        ends.append(n[first:upto])
                        docs_in += numbers[lo + first : lo + upto]
                        held += int(at[upto] - at[first])
                    if upto < len(n):
                        yield segment()
                        seq, ids, ends, docs_in, held = seq + 1, [], [], [], 0
                    first = upto
        if docs_in:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), binary_of(F.col("text")).alias("t"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("t")]
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    rows.mapInArrow(run, _SEGMENTS).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the segments at ``path``."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    sizes = materialize(segments.select("part", "seq", "n_tokens"), "segments")
    # Ranges are few: one row for each task that wrote.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first"))

    def run(batches):
        for b in batches:
            for part, seq, n, _, numbers, nulls, ends, codes in zip(*(b.column(c).to_pylist() for c in range(8))):
                ids, ends = Codes(codes).all().astype("<u4"), np.frombuffer(ends, dtype="<u8").astype(np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:z].data) for a, z in zip(begins, ends)]
                none = np.unpackbits(np.frombuffer(nulls, dtype=np.uint8), count=n, bitorder="little").astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.full(n, seq, dtype=np.int32)), pa.array(np.frombuffer(numbers, dtype="<i8"), mask=none), pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    docs = segments.mapInArrow(run, "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Write ``docs`` to files under the scratch folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, tokenizer, path)
    return read(spark, path)
