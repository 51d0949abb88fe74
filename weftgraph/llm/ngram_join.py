"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles.  Its parity sketch is a very
wide bit vector in which every shingle flips one bit; flips of shared shingles
cancel, so the Hamming distance of two sketches is at most the size D of the
symmetric difference.  Similarity t bounds D by (|A| + |B|)(1 - t)/(1 + t).

**Size bands.**  Band edges grow by 1/t, so partners are in the same band or in
the next one.  A document is entered in its own band and, as the smaller
partner, in the next; a band fixes how many pieces a sketch is cut into.

**Pigeonhole.**  D flips touch at most D pieces.  A piece is represented by the
XOR of its flips' 64-bit hashes and by their number.  Of a document's filled
pieces only the first D + 1 in one global order are entered: any two partners
must share one of those.  The order puts pieces with many flips first, because
they are the rarest; passages that many documents share seldom fill such a
piece alone.  A document with too few filled pieces for this argument goes to
its band's list of short ones, which are held against each other.

**Verification.**  Pairs that share a piece are cut by size and by the Hamming
distance of a dense 256-bit parity sketch, then compared shingle by shingle.

**Groups.**  Equal sets are one class and enter once.  A piece shared by up to
``SMALL`` classes gives all its pairs; a larger group gives pairs with its least
member only.  When these are verified and joined into components, a large group
whose members are in one component is settled.  In the others, members of
different components are held against each other by sketch, and only pairs
within the Hamming bound are verified: first each member's nearest partners in
other components, then what still spans components.  Groups of more than
``LARGE`` are split before by a second, third, ... piece (partners share more
than one).  So no group is paired in full because it is large, members of one
component are not paired at all, and no link between components is lost.

Keys are shuffled as packed arrays, not rows: about nine bytes each.  Texts are
not stored again: each check moves those that its pairs name.  Sketches are
stored for the classes in pairs and groups only and move when they are compared.

Defined cases: null or blank text has an empty set and links with nothing; a
text with fewer words than a shingle is one shingle; rows with a null id belong
to the class of their text and are compared with others only if a row with an
id has the same set; rows that repeat an id are one document.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import binary_of
from weftgraph.llm.components import components
from weftgraph.llm.words import mixed, shingle_sets
from weftgraph.session import materialize

#: Groups of at most so many classes give all pairs.
SMALL = 3
#: Members per task when one document is verified against many.
CHUNK = 256
#: Keys packed together by one map task, and expected keys per bucket.
FLUSH, BUCKET = 1_000_000, 1_500_000
#: Ids (16 bytes each) up to which a list is broadcast.
LISTED = 250_000
#: Members above which a group is split by further pieces, members compared in one task, and bits of the widest dense sketch.
LARGE, BLOCK, WIDEST = 20_000, 4096, 16_384
#: Components that a member is first tried to join.
NEAREST = 4
_U = np.uint64
_M40 = _U((1 << 40) - 1)


class Bands:
    """Size bands and piece counts for a similarity of ``near`` percent."""

    def __init__(self, near: int):
        self.near = near
        edges, top, low = [1], 1, 1
        while edges[-1] < 1 << 40:
            top, low = top * 100, low * near
            edges.append(-(-top // low))
        self.edges = np.array(edges, dtype=np.int64)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def budget(self, n: int, level: int) -> int:
        """Largest symmetric difference with a partner whose larger side is in band ``level``; -1 without partners."""
        other = min(int(self.edges[level + 1]) - 1, n * 100 // self.near)
        if level > self.band(n) and other < int(self.edges[level]):
            return -1
        return (n + other) * (100 - self.near) // (100 + self.near)

    def pieces(self, level: int) -> int:
        d = 2 * (int(self.edges[level + 1]) - 1) * (100 - self.near) // (100 + self.near)
        return (d + 1) * (2 if d >= 40 else 4 if d >= 16 else 16)


def _pieces(h: np.ndarray, level: int, m: int) -> np.ndarray:
    """Sorted keys of the filled pieces: flips (many first) in the top byte, then a hash of level, place and flips."""
    place = h % _U(m)
    order = np.argsort(place.astype(np.uint16) if m < 65536 else place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    fold = np.bitwise_xor.reduceat(mixed(h[order] + _U(0x51ED)), starts)
    count = np.diff(np.append(starts, len(h)))
    key = mixed(fold ^ mixed(place[starts] + _U(level << 40)))
    return np.sort((_U(255) - np.minimum(count, 255).astype(_U)) << _U(56) | key >> _U(8))


def entries(h: np.ndarray, bands: Bands, whole: bool = False) -> list[tuple[int, np.ndarray]]:
    """(pieces that any partner shares, keys) for each band that a set is entered in.

    ``whole`` gives all filled pieces instead of the first ones.
    """
    n, out = len(h), []
    for level in (bands.band(n), bands.band(n) + 1) if n else ():
        d = bands.budget(n, level)
        if d < 0:
            continue
        keys = _pieces(h, level, bands.pieces(level))
        first = keys if whole else keys[: d + 1]
        if len(keys) <= d:
            first = np.append(first, mixed(np.array([level << 8 | 255], dtype=_U)) | _U(255 << 56))
        out.append((len(keys) - d, first))
    return out


def _sketch(h: np.ndarray) -> bytes:
    """Dense parity sketch of 256, 512, ... bits, at least four for a shingle up to ``WIDEST``.

    Half of a sketch folded onto the other is the sketch of half the width.
    """
    bits = 256
    while bits < min(4 * len(h), WIDEST):
        bits *= 2
    flips = np.bincount((h >> _U(20) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(sketch, dtype=np.uint64).reshape(-1, words), axis=0)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


_SETS = "doc_id bigint, text_hash bigint, n_shingles bigint, f1 bigint, f2 bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, sketch binary"


def sets(docs: DataFrame, k: int) -> DataFrame:
    """Per row: id, hash of the text, size and 128-bit fingerprint of the set, dense parity sketch and its 256-bit fold."""

    def run(batches):
        for b in batches:
            n, fp, sk = [], [], []
            for h in shingle_sets(_texts(b.column(2)), k):
                n.append(len(h))
                with np.errstate(over="ignore"):
                    fp.append((int(mixed(h).sum(dtype=_U)), int(mixed(h ^ _U(0xA5A5A5A5A5A5)).sum(dtype=_U)) ^ len(h)))
                sk.append(_sketch(h))
            f = np.array(fp, dtype=_U).reshape(-1, 2).view(np.int64)
            s = np.array([_folded(x, 4) for x in sk], dtype=_U).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *[pa.array(f[:, i]) for i in (0, 1)], *[pa.array(s[:, i]) for i in range(4)], pa.array(sk, pa.binary())], names=[x.split()[0] for x in _SETS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), binary_of(F.col("text")))
    return rows.mapInArrow(run, _SETS)


def _packed(keys: np.ndarray, member: np.ndarray, ids: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """Keys of many documents dealt into buckets: (bucket, five bytes per key, two per member, eight per id)."""
    bucket = (mixed(keys) >> _U(40)) % _U(n_buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, member = bucket[order], keys[order], member[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        there, at = np.unique(member[a:b], return_inverse=True)
        low = np.ascontiguousarray(keys[a:b] & _M40).view(np.uint8).reshape(-1, 8)[:, :5]
        yield int(bucket[a]), low.tobytes(), at.astype(np.uint16).tobytes(), ids[there].tobytes()


_KEYS = "bucket bigint, keys binary, member binary, ids binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "))], names=names)


def keyed(docs: DataFrame, k: int, near: int, n_buckets: int) -> DataFrame:
    """Entries of all documents; equal sets of one task enter once."""

    def run(batches):
        bands = Bands(near)
        seen: set[int] = set()
        keys, member, ids, held = [], [], [], 0

        def flush():
            rows = _packed(np.concatenate(keys), np.concatenate(member), np.array(ids, dtype=np.int64), n_buckets)
            part: list[tuple] = []
            for r in rows:
                part.append(r)
                if len(part) == 64:
                    yield _batch(part, _KEYS)
                    part = []
            if part:
                yield _batch(part, _KEYS)

        for b in batches:
            for h in shingle_sets(_texts(b.column(0)), k):
                if not len(h):
                    continue
                with np.errstate(over="ignore"):
                    own = int(mixed(h).sum(dtype=_U).view(np.int64))
                if own in seen:
                    continue
                seen.add(own)
                for _, e in entries(h, bands):
                    keys.append(e)
                    member.append(np.full(len(e), len(ids), dtype=np.int64))
                    held += len(e)
                ids.append(own)
                if held >= FLUSH or len(ids) >= 60_000:
                    yield from flush()
                    keys, member, ids, held = [], [], [], 0
        if held:
            yield from flush()

    return docs.select(binary_of(F.col("text"))).mapInArrow(run, _KEYS)


_MET = "a bigint, b bigint, gid bigint"


def _groups(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of the small groups and of the large ones' least members; for large groups their members too.

    A pair is a row (a, b, null), a member a row (member, number of pieces that the group shares, group).
    """
    names, at = np.unique(ids, return_inverse=True)
    if len(names) < 1 << 24:
        packed = np.unique(keys << _U(24) | at.astype(_U))
        key, at = packed >> _U(24), (packed & _U((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.lexsort((at, keys))
        key, at = keys[order], at[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])))
        key, at = key[new], at[new]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(cuts)
    many = np.flatnonzero(size > 1)
    if not len(many):
        return
    # The same members often share many pieces: one group is enough.
    with np.errstate(over="ignore"):
        mark = np.add.reduceat(mixed(names[at].view(_U)), cuts[:-1])
    _, one, times = np.unique(mark[many], return_index=True, return_counts=True)
    pairs: list[np.ndarray] = []
    for g, n in zip(many[one], times):
        m = at[cuts[g] : cuts[g + 1]]
        if len(m) <= SMALL:
            i, j = np.triu_indices(len(m), 1)
            pairs.append(np.stack((m[i], m[j])))
        else:
            pairs.append(np.stack((np.full(len(m) - 1, m[0]), m[1:])))
            gid = int(mark[g].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names[m]), pa.array(np.full(len(m), n, dtype=np.int64)), pa.array(np.full(len(m), gid, dtype=np.int64))], names=["a", "b", "gid"])
    both = np.concatenate(pairs, axis=1)
    both = np.unique(both[0] * len(names) + both[1])
    a, b = names[both // len(names)], names[both % len(names)]
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "gid"])


def met(packed: DataFrame) -> DataFrame:
    """Groups of documents that share a key, bucket by bucket."""

    def run(batches):
        now, keys, ids = None, [], []
        for batch in batches:
            for bucket, k, m, i in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if bucket != now and keys:
                    yield from _groups(np.concatenate(keys), np.concatenate(ids))
                    keys, ids = [], []
                now = bucket
                wide = np.zeros((len(k) // 5, 8), dtype=np.uint8)
                wide[:, :5] = np.frombuffer(k, dtype=np.uint8).reshape(-1, 5)
                keys.append(wide.view(_U).ravel())
                ids.append(np.frombuffer(i, dtype=np.int64)[np.frombuffer(m, dtype=np.uint16)])
        if keys:
            yield from _groups(np.concatenate(keys), np.concatenate(ids))

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _MET)


def _listed(ids: DataFrame) -> DataFrame:
    """A small list of ids is broadcast, which saves the shuffle of what it is joined to; a longer one is not."""
    return F.broadcast(ids) if ids.limit(LISTED + 1).count() <= LISTED else ids


_NAMED = ["a_doc_id", "a_text_hash", "b_doc_id", "b_text_hash"]


def _possible(pairs: DataFrame, classes: DataFrame, near: int) -> DataFrame:
    """Pairs of classes with their documents, without those that size or the 256-bit folds rule out."""
    side = lambda p: classes.select(F.col("f1").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("doc_id", "text_hash", "row", "n_shingles", "s0", "s1", "s2", "s3")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    small, large = F.least("a_n_shingles", "b_n_shingles"), F.greatest("a_n_shingles", "b_n_shingles")
    apart = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(4)), F.lit(0))
    most = (100 - near) * (F.col("a_n_shingles") + F.col("b_n_shingles"))
    fits = (100 * small >= near * large) & (apart * (100 + near) <= most)
    both = both.where(fits & F.col("a_doc_id").isNotNull() & F.col("b_doc_id").isNotNull())
    return both.select("a", "b", "a_row", "b_row", *_NAMED, most.alias("most"))


def _fine(both: DataFrame, sketches: DataFrame, near: int) -> DataFrame:
    """Those of the possible pairs that the whole sketches leave."""

    def run(batches):
        for batch in batches:
            fits = []
            for x, y, most in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6))):
                w = min(len(x), len(y)) // 8
                fits.append(int(np.bitwise_count(_folded(x, w) ^ _folded(y, w)).sum()) * (100 + near) <= most)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4]).filter(pa.array(fits, pa.bool_()))

    wide = lambda p: sketches.select(F.col("f1").alias(p), F.col("sketch").alias(f"{p}_sketch"))
    both = both.select("a", "b", *_NAMED, "most").join(wide("a"), "a").join(wide("b"), "b")
    return both.select(*_NAMED, "a_sketch", "b_sketch", "most").mapInArrow(run, ", ".join(f"{c} bigint" for c in _NAMED))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, h, t): the texts of the documents that ``wanted`` names by id and text hash, once each.

    Texts are dealt by (id, h) once; a join on these columns in the same plan does not move them again.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("t"))
    return texts.join(_listed(wanted), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])


def verified(pairs: DataFrame, docs: DataFrame, k: int, near: int) -> DataFrame:
    """The pairs (a, b) of document ids whose sets are similar enough.

    Only texts that the pairs name are moved; they are read from ``docs`` and not stored.
    Pairs are dealt by their first document, whose set is held while the others
    pass by; a document with many partners is dealt to several tasks.
    """

    def run(batches):
        held = None
        for batch in batches:
            a, b, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), _texts(batch.column(3))
            found = []
            for x, y, h in zip(a, b, shingle_sets(texts, k)):
                if y is None:
                    held = (x, h)
                elif held and held[0] == x:
                    union = len(np.union1d(held[1], h))
                    if 100 * (len(held[1]) + len(h) - union) >= near * union:
                        found.append((x, y))
            yield _batch(found, "a bigint, b bigint")

    counts = pairs.groupBy("a_doc_id").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    dealt = pairs.join(counts, "a_doc_id").withColumn("part", F.pmod(F.hash("b_doc_id"), F.col("parts")))
    wanted = dealt.select("a_doc_id", "part", F.col("b_doc_id").alias("b"), F.col("b_doc_id").alias("id"), F.col("b_text_hash").alias("h"))
    held = dealt.select("a_doc_id", "part", F.lit(None).cast("bigint").alias("b"), F.col("a_doc_id").alias("id"), F.col("a_text_hash").alias("h")).distinct()
    named = materialize(pairs.select("a_doc_id", "a_text_hash").union(pairs.select("b_doc_id", "b_text_hash")).toDF("id", "h").distinct(), "named")
    rows = wanted.union(held).join(_texts_of(docs, named), ["id", "h"]).select(F.col("a_doc_id").alias("a"), "part", "b", binary_of(F.col("t")).alias("t"))
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a bigint, b bigint")


_PARTS = _KEYS + ", gid bigint, need bigint"


def _split(open_groups: DataFrame, classes: DataFrame, docs: DataFrame, k: int, near: int, n_buckets: int) -> DataFrame:
    """Members of open groups, entered by (group, any piece); and how many pieces a member's partners share with it."""

    def packed(keys, member, ids, needs):
        rows = [(*r, None, None) for r in _packed(np.concatenate(keys), np.concatenate(member), np.array(ids, dtype=np.int64), n_buckets)]
        return _batch(rows + [(None, None, None, None, g, n) for g, n in needs.items()], _PARTS)

    def run(batches):
        bands = Bands(near)
        keys, member, ids, needs, held = [], [], [], {}, 0
        for batch in batches:
            gids, own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))
            for groups, o, h in zip(gids, own, shingle_sets(texts, k)):
                at = entries(h, bands, whole=True)
                for gid in groups:
                    salt = mixed(np.array([gid & ((1 << 64) - 1)], dtype=_U))
                    for need, e in at:
                        needs[gid] = min(need, needs.get(gid, need))
                        keys.append(mixed(e ^ salt))
                        member.append(np.full(len(e), len(ids), dtype=np.int64))
                        held += len(e)
                ids.append(o)
                if held >= FLUSH or len(ids) >= 60_000:
                    yield packed(keys, member, ids, needs)
                    keys, member, ids, needs, held = [], [], [], {}, 0
        if keys:
            yield packed(keys, member, ids, needs)

    by_class = open_groups.groupBy("f1").agg(F.collect_set("gid").alias("gids"))
    reps = by_class.join(classes, "f1").select("gids", "f1", F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    reps = materialize(reps.where(F.col("id").isNotNull()), "reps")
    return reps.join(_texts_of(docs, reps.select("id", "h").distinct()), ["id", "h"]).select("gids", "f1", binary_of(F.col("t"))).mapInArrow(run, _PARTS)


def _placed(groups: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """(f1, gid, c): members of the groups that span several components, with their component."""
    where = classes.join(joined, F.col("doc_id") == F.col("node"), "left").select("f1", F.coalesce("component", "doc_id").alias("c")).where(F.col("c").isNotNull())
    placed = materialize(groups.join(where, "f1").distinct(), "placed")
    several = placed.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("gid")
    return placed.join(several, "gid")


def _close(n: np.ndarray, part: np.ndarray, block: np.ndarray, sketches: list[bytes], near: int, best: bool) -> np.ndarray:
    """Places of pairs of members from different components that size and Hamming distance allow; shape (2, pairs).

    Members are held against those up to 1/t larger, first by the folds of
    their sketches, then by the sketches.  ``best`` keeps a member's nearest
    partner in each of the ``NEAREST`` nearest other components.
    """
    order = np.argsort(n, kind="stable")
    n, part, block = n[order], part[order], block[order]
    fold = np.array([_folded(sketches[i], 4) for i in order], dtype=_U).reshape(-1, 4)
    two, found = block.max() != block.min(), []
    for a in range(0, len(n), 256):
        z = min(a + 256, len(n))
        stop = int(np.searchsorted(n, n[z - 1] * 100 // near, side="right"))
        for c in range(a, stop, 2048):
            e = min(c + 2048, stop)
            apart = np.bitwise_count(fold[a:z, None] ^ fold[None, c:e]).sum(axis=2, dtype=np.int64)
            fits = (apart * (100 + near) <= (n[a:z, None] + n[None, c:e]) * (100 - near)) & (n[a:z, None] * 100 >= near * n[None, c:e])
            fits &= (part[a:z, None] != part[None, c:e]) & (np.arange(a, z)[:, None] < np.arange(c, e)[None])
            if two:
                fits &= block[a:z, None] != block[None, c:e]
            x, y = np.nonzero(fits)
            found.append(np.stack((x + a, y + c)))
    p, q = np.concatenate(found, axis=1)
    far = np.zeros(len(p), dtype=np.int64)
    words = np.array([len(sketches[i]) // 8 for i in order])
    width = np.minimum(words[p], words[q])
    for w in np.unique(width).tolist():
        here = np.flatnonzero(width == w)
        rows, at = np.unique(np.concatenate((p[here], q[here])), return_inverse=True)
        table = np.array([_folded(sketches[order[r]], w) for r in rows], dtype=_U).reshape(-1, w)
        for lo in range(0, len(here), 16_384):
            some = slice(lo, lo + 16_384)
            far[here[some]] = np.bitwise_count(table[at[: len(here)][some]] ^ table[at[len(here) :][some]]).sum(axis=1, dtype=np.int64)
    fits = far * (100 + near) <= (n[p] + n[q]) * (100 - near)
    p, q, far = p[fits], q[fits], far[fits]
    if best and len(p):
        x, y, d = np.concatenate((p, q)), np.concatenate((q, p)), np.concatenate((far, far))
        by = np.lexsort((y, d, part[y], x))
        x, y = x[by], y[by]
        first = np.concatenate(([True], (x[1:] != x[:-1]) | (part[y[1:]] != part[y[:-1]])))
        x, y, d = x[first], y[first], d[by][first]
        by = np.lexsort((d, x))
        x, y = x[by], y[by]
        begin = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        rank = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
        p, q = x[rank < NEAREST], y[rank < NEAREST]
    return np.stack((order[p], order[q]))


def _candidates(members: DataFrame, sketches: DataFrame, near: int, best: bool) -> DataFrame:
    """(a, b) classes of ``members`` (gid, f1, c) that are close by their sketches.

    A group of more than ``BLOCK`` members is dealt to a task for each two of its blocks.
    Members get their sketches when they are dealt, so a sketch moves to its member and to the task, no further.
    """

    def run(batches):
        now, rows = None, []

        def done():
            ids, n, part, block, sketches = zip(*rows)
            at = _close(np.array(n), np.unique(np.array(part), return_inverse=True)[1], np.array(block), list(sketches), near, best)
            got = np.array(ids)[at]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(got[0], got[1])), pa.array(np.maximum(got[0], got[1]))], names=["a", "b"])

        for batch in batches:
            for gid, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if (gid, lo, hi) != now and rows:
                    yield done()
                    rows = []
                now = (gid, lo, hi)
                rows.append(row)
        if rows:
            yield done()

    blocks = members.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "gid").withColumn("block", F.pmod(F.hash("f1"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("gid", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "f1", "c", "block")
    dealt = dealt.join(sketches, "f1").select("gid", "lo", "hi", "f1", "n_shingles", "c", "block", "sketch")
    return dealt.repartition("gid", "lo", "hi").sortWithinPartitions("gid", "lo", "hi").mapInArrow(run, "a bigint, b bigint").distinct()


def _written(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, then let Spark's cleaner drop the shuffle files behind it.

    The cleaner works when the driver collects garbage, which a small heap of a
    long job may put off until the disks hold every shuffle of the job.
    """
    out = materialize(df, label)
    del df
    gc.collect()
    jvm = getattr(out.sparkSession.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
    return out


def link(docs: DataFrame, k: int = 5, near: int = 75, large: int = LARGE) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) for every row of ``docs``.

    Groups of more than ``large`` members are split by further pieces before they are held against each other.
    """
    rows = materialize(sets(docs, k).withColumn("row", F.monotonically_increasing_id()), "sets")
    filled = rows.where(F.col("n_shingles") > 0)
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash", "row"))).alias("rep")
    classes = filled.groupBy("f1", "f2", "n_shingles").agg(least, *[F.max(f"s{i}").alias(f"s{i}") for i in range(4)])
    classes = materialize(classes.select("f1", "f2", "n_shingles", "rep.doc_id", "rep.text_hash", "rep.row", "s0", "s1", "s2", "s3"), "classes")
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = max(64, total * 2 // 3 // BUCKET)

    found = _written(met(keyed(docs, k, near, n_buckets)), "met")
    pairs = materialize(_possible(found.where(F.col("gid").isNull()).select("a", "b").distinct(), classes, near), "pairs")
    groups = materialize(found.where(F.col("gid").isNotNull()).select(F.col("a").alias("f1"), "gid").distinct(), "groups")
    # Sketches that any later step can ask for: a class has one row that stands for it.
    named = groups.select("f1").distinct().join(classes, "f1").select("row").where(F.col("row").isNotNull())
    named = materialize(named.union(pairs.select("a_row")).union(pairs.select("b_row")).distinct(), "named")
    sketches = materialize(filled.join(_listed(named), "row", "left_semi").select("f1", "n_shingles", "sketch"), "sketches")
    pairs = materialize(_fine(pairs, sketches, near), "pairs")
    done = [pairs.select("a_doc_id", "b_doc_id")]

    def merged(joined: DataFrame, pairs: DataFrame, close: bool) -> DataFrame:
        """Components after the links among further pairs; ``close`` ones were held against each other by whole sketches."""
        pairs = _possible(pairs, classes, near)
        for d in done:
            pairs = pairs.join(d, ["a_doc_id", "b_doc_id"], "left_anti")
        pairs = materialize(pairs.select(*_NAMED) if close else _fine(pairs, sketches, near), "pairs")
        done.append(pairs.select("a_doc_id", "b_doc_id"))
        links = _written(verified(pairs, docs, k, near), "links")
        return _written(components(joined.toDF("a", "b").union(links), "a", "b"), "joined")

    joined = _written(components(_written(verified(pairs, docs, k, near), "links"), "a", "b"), "joined")
    # Very large groups that span components are split by a further piece, until they are smaller or all alike.
    gone = None
    still = materialize(_placed(groups, classes, joined), "open")
    while True:
        sized = still.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("gid")
        big = still.join(sized, "gid").select("gid", "f1", "c")
        if gone is not None:
            big = big.join(gone, "gid", "left_anti")
        big = materialize(big, "large")
        if not big.take(1):
            break
        parts = materialize(_split(big.select("f1", "gid"), classes, docs, k, near, n_buckets), "parts")
        found = materialize(met(parts.where(F.col("bucket").isNotNull()).select("bucket", "keys", "member", "ids")), "met")
        # Where all members share as many pieces as partners need to, a further piece need not tell partners apart.
        needs = parts.where(F.col("gid").isNotNull()).groupBy("gid").agg(F.min("need").alias("need"))
        shared = found.where(F.col("gid").isNotNull()).groupBy("gid", "a").agg(F.sum("b").alias("n")).groupBy("gid").agg(F.max("n").alias("n"))
        alike = needs.join(shared, "gid", "left").where(F.coalesce("n", F.lit(0)) >= F.col("need")).select("gid")
        joined = merged(joined, found.where(F.col("gid").isNull()).select("a", "b").distinct(), close=False)
        seen = big.select("gid").distinct()
        gone = seen if gone is None else gone.union(seen)
        # Groups that stay: the smaller ones, those whose members are all alike, and the new ones.
        apart = seen.join(alike, "gid", "left_anti")
        fresh = found.where(F.col("gid").isNotNull()).select(F.col("a").alias("f1"), "gid").distinct().join(gone, "gid", "left_anti")
        groups = still.select("f1", "gid").join(apart, "gid", "left_anti").select("f1", "gid").union(fresh)
        still = materialize(_placed(groups, classes, joined), "open")

    # Groups with the same least member mostly hold the same others: they become one.
    least = still.groupBy("gid").agg(F.min("f1").alias("pivot"))
    still = materialize(still.join(least, "gid").select("f1", F.col("pivot").alias("gid"), "c").distinct(), "open")
    # The nearest partners first, in a member's largest group: they join most members, which leaves few pairs across components.
    for best in (True, False):
        if not still.take(1):
            break
        members = still
        if best:
            sized = still.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
            own = still.join(sized, "gid").groupBy("f1", "c").agg(F.max(F.struct("n", "gid"))["gid"].alias("gid"))
            members = own.select("gid", "f1", "c")
        joined = merged(joined, _candidates(members, sketches, near, best), close=True)
        if best:
            still = materialize(_placed(still.select("f1", "gid"), classes, joined), "open")

    where = classes.join(joined, F.col("doc_id") == F.col("node"), "left")
    where = where.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n_shingles").alias("gn"), F.coalesce("component", "doc_id").alias("component_id"))
    out = rows.join(where, (rows["f1"] == where["g1"]) & (rows["f2"] == where["g2"]) & (rows["n_shingles"] == where["gn"]), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, near: int = 75) -> DataFrame:
    """``docs`` with one document of each group of linked ones, that with the least id; all columns stay.

    Empty texts link with nothing and stay.  Of rows that repeat an id, or that
    have no id and the same text, the one with the least text hash stays.
    """
    found = link(docs, k, near)
    heads = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("h_id")).distinct()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("k_id"), F.xxhash64("text").alias("k_hash"))
    named = keyed.where(F.col("k_id").isNotNull()).join(heads, F.col("k_id") == F.col("h_id"), "left_semi")
    first = F.row_number().over(Window.partitionBy("k_id").orderBy("k_hash"))
    named = named.withColumn("place", first).where(F.col("place") == 1)
    # Rows without an id: dropped where a document with an id has their text.
    known = docs.where(F.col("doc_id").isNotNull()).select(F.xxhash64("text").alias("n_hash")).distinct()
    free = keyed.where(F.col("k_id").isNull()).join(known, F.col("k_hash") == F.col("n_hash"), "left_anti").dropDuplicates(["k_hash"])
    return named.select("row.*").union(free.select("row.*"))
