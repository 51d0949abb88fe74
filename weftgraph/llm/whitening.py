"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are staged once as blocks of small whole numbers with each block's
sums.  After that one pass over the blocks multiplies the covariance by a thin
matrix: every task adds up Y^T (Y Q) for its centred rows Y and sends on one
matrix, and matrices of many tasks are added in groups before they reach the
driver.  The covariance itself is never formed.

The iteration keeps an orthonormal block of columns.  Rayleigh-Ritz gives
estimates and, from the same product, their residuals.  Until the residuals of
the wanted components are certified to rounding, a polynomial recurrence
(Chebyshev's, on the interval from zero to the least estimate of the block, its
degree chosen from the spectrum) damps what is unwanted, QR makes the columns
orthonormal again, and the next pass measures them.

Vectors are taken as x = floor(1024 * c) + 100000 per entry c, their sums are
exact, and a row is centred as (x - floor(S / n)) - (S mod n) / n, so nothing
is lost to the size of the mean.

Defined cases: a row whose vector is null, or holds a null, a non-finite entry
or one beyond 2**30, is dropped; of vectors of several lengths the commonest
stay (of equally common ones the longest); null ids and repeated rows are kept
as they are; components whose variance is under 1e-10 of the first are not
given, so equal vectors and an empty table have no rows; equal eigenvalues get
any orthonormal vectors of their space; vectors of any length take memory of a
block of entries; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import materialize

SCALE, SHIFT = 1024, 100_000
#: Entries of a block, rows of a block at most, greatest entry.
ENTRIES, ROWS, GREATEST = 1 << 21, 8192, float(1 << 30)
#: Columns beyond the wanted ones, matrices that the driver adds up, least variance against the first.
GUARD, FAN, LEAST = 24, 256, 1e-10
#: Residuals, against the first eigenvalue, at which a component is certified, and that rounding may leave.
CERTIFIED, ROUNDING = 1e-14, 1e-10

_BLOCKS = "dim int, n bigint, bits int, entries binary, ids binary, no_ids binary, sums binary"


# --- staging -----------------------------------------------------------------------------------------


def staged(vectors: DataFrame) -> DataFrame:
    """Blocks of the usable rows: floor(1024 c) in 16, 32 or 64 bits, ids, and sums per dimension."""

    def run(batches):
        for batch in batches:
            there = pc.is_valid(batch.column(1))
            ids, lists = batch.column(0).filter(there), batch.column(1).filter(there)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
            offsets = offsets - offsets[0]
            bad = np.concatenate(([0], np.cumsum(~(np.abs(values) <= GREATEST))))  # a null is NaN here
            size = np.diff(offsets)
            good = bad[offsets[1:]] == bad[offsets[:-1]]
            numbers, none = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            for d in np.unique(size[good]).tolist():
                rows = np.flatnonzero(good & (size == d))
                step = max(1, min(ROWS, ENTRIES // max(d, 1)))
                for a in range(0, len(rows), step):
                    some = rows[a : a + step]
                    x = np.floor(SCALE * values[offsets[some][:, None] + np.arange(d)]).astype(np.int64)
                    top = int(np.abs(x).max(initial=0))
                    bits = 16 if top < 1 << 15 else 32 if top < 1 << 31 else 64
                    row = [d, len(some), bits, x.astype(f"<i{bits // 8}").tobytes(), numbers[some].astype("<i8").tobytes(), np.packbits(none[some], bitorder="little").tobytes(), x.sum(axis=0).astype("<i8").tobytes()]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    kind = vectors.schema["embedding"].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    column = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    return materialize(vectors.select(F.col("vec_id").cast("bigint"), column.alias("embedding")).mapInArrow(run, _BLOCKS), "vectors")


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """floor(1024 c) of every block of a batch with columns dim, n, bits, entries."""
    for d, n, bits, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "n", "bits", "entries"))):
        yield np.frombuffer(data, dtype=f"<i{bits // 8}").reshape(n, d)


def _added(blocks: DataFrame, columns: list[str], of: Callable[[pa.RecordBatch], np.ndarray], size: int, kind: str, tasks: int) -> np.ndarray:
    """The sum of ``of`` (a flat array) over all batches.  Order is fixed, so reruns agree to the last bit."""

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(size, dtype=kind)
        for batch in batches:
            total += of(batch)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part % FAN], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "part", "total"])

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.zeros(size, dtype=kind)
        for data in table.column("total"):
            total += np.frombuffer(data.as_buffer(), dtype=kind)
        return pa.table({"slot": table.column("slot")[:1], "part": table.column("part")[:1], "total": pa.array([total.tobytes()], pa.binary())})

    schema = "slot int, part int, total binary"
    sums = blocks.select(*columns).mapInArrow(run, schema)
    if tasks > FAN:
        sums = sums.groupBy("slot").applyInArrow(merged, schema)
    total = np.zeros(size, dtype=kind)
    for row in sorted(sums.collect(), key=lambda r: (r.slot, r.part)):  # at most FAN matrices
        total += np.frombuffer(row.total, dtype=kind)
    return total


# --- spectrum ------------------------------------------------------------------------------------------


@dataclass
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    residual: float  # the greatest of the wanted ones, against the first eigenvalue
    passes: int
    certified: bool


def _degree(values: np.ndarray, want: int, goal: float) -> int:
    """Degree that brings the last wanted component to ``goal``, but keeps the block well conditioned."""
    low = values[-1]
    grows = np.arccosh(max(1.0 + 1e-6, 2 * values[want - 1] / low - 1))
    spreads = np.arccosh(max(1.0 + 1e-6, 2 * values[0] / low - 1))
    return int(np.clip(np.log(2 / goal) / grows, 2, max(2, min(24, 20 / spreads))))


def spectrum(multiplied: Callable[[np.ndarray], np.ndarray], dim: int, want: int, guard: int = GUARD) -> Spectrum:
    """The ``want`` greatest eigenpairs of a positive matrix known by its products only."""
    want, block = min(want, dim), min(dim, want + guard)
    q = np.linalg.qr(np.random.default_rng(12).standard_normal((dim, block)))[0]
    passes, history = 0, []
    while True:
        w = multiplied(q)
        passes += 1
        small = q.T @ w
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, wx = q @ turn, w @ turn
        top = max(values[0], 0.0)
        if top == 0:
            return Spectrum(values[:want].clip(0), x[:, :want], 0.0, passes, True)
        residual = float(np.linalg.norm(wx[:, :want] - x[:, :want] * values[:want], axis=0).max() / top)
        history.append(residual)
        stalled = len(history) > 4 and min(history[-3:]) > 0.5 * min(history[:-3])
        if residual <= CERTIFIED or block == dim or (stalled and residual <= ROUNDING) or (len(history) > 40 and stalled):
            return Spectrum(values[:want], x[:, :want], residual, passes, residual <= ROUNDING)
        low = values[-1]
        if low <= 1e-14 * top:
            q = np.linalg.qr(wx)[0]
            continue
        # Chebyshev's recurrence on [0, low], scaled to be near one at the greatest eigenvalue.
        half = low / 2
        first = sigma = half / (top - half)
        before, now = x, (wx - half * x) * (first / half)
        for _ in range(_degree(values, want, max(CERTIFIED / residual, 1e-15)) - 1):
            following = 1 / (2 / first - sigma)
            before, now = now, 2 * (multiplied(now) - half * now) * (following / half) - sigma * following * before
            passes, sigma = passes + 1, following
        q = np.linalg.qr(now)[0]


# --- whitening -------------------------------------------------------------------------------------------

_WHITE = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Model:
    """What whitens rows of ``blocks``: mean of x, unit components in columns, their variances."""

    blocks: DataFrame
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    found: Spectrum | None


def fit(vectors: DataFrame, want: int = 8) -> Model:
    blocks = staged(vectors)
    common = blocks.groupBy("dim").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    if common is None or common.dim == 0:
        return Model(blocks, 0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, None)
    d, n = common.dim, common.rows
    blocks = blocks.where(F.col("dim") == d)
    tasks = blocks.rdd.getNumPartitions()

    def sums_of(batch):
        s = sum((np.frombuffer(x, dtype="<i8") for x in batch.column("sums").to_pylist()), np.zeros(d, dtype=np.int64))
        return np.concatenate((s >> 32, s & 0xFFFFFFFF))

    halves = _added(blocks, ["sums"], sums_of, 2 * d, "<i8", tasks)
    plain = [(int(hi) << 32) + int(lo) for hi, lo in zip(halves[:d], halves[d:])]  # of floor(1024 c)
    whole, part = _mean(plain, n)
    entries = ["dim", "n", "bits", "entries"]

    def squares(batch):
        return np.array([sum(float(np.square(_centred(x, whole, part)).sum()) for x in _rows(batch))])

    trace = float(_added(blocks, entries, squares, 1, "<f8", tasks)[0]) / n

    def multiplied(q: np.ndarray) -> np.ndarray:
        def product(batch):
            total = np.zeros(q.shape)
            for x in _rows(batch):
                y = _centred(x, whole, part)
                total += y.T @ (y @ q)
            return total.ravel()

        return _added(blocks, entries, product, q.size, "<f8", tasks).reshape(q.shape) / n

    found = spectrum(multiplied, d, want)
    kept = int((found.values > LEAST * max(trace, 0.0) / d).sum()) if trace else 0
    kept = min(kept, int((found.values > LEAST * found.values[0]).sum()))
    axes = found.vectors[:, :kept] / np.sqrt(found.values[:kept])

    def moments(batch):
        total = np.zeros((kept + 1, kept))
        for x in _rows(batch):
            z = _centred(x, whole, part) @ axes
            total[:kept] += z.T @ z
            total[kept] += z.sum(axis=0)
        return total.ravel()

    error = 0.0
    if kept:
        total = _added(blocks, entries, moments, (kept + 1) * kept, "<f8", tasks).reshape(kept + 1, kept) / n
        error = float(np.abs(total[:kept] - np.outer(total[kept], total[kept]) - np.eye(kept)).max())
    return Model(blocks, n, [s + SHIFT * n for s in plain], found.vectors[:, :kept], found.values[:kept], trace, error, found)


def _mean(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and fractional parts of sums / n."""
    return np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])


def _centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - part


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int]:
    """Sum over dimensions of (n x - S)**2 for each row, exactly."""
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    y, d = x - whole, len(sums)
    top = int(np.abs(y).max(initial=0))
    if (top * n + n) ** 2 * d < 1 << 62:
        return np.square(n * y - np.array(rest, dtype=np.int64)).sum(axis=1).tolist()
    if top * n * d < 1 << 62 and top * top * d < 1 << 62:
        squares, cross = np.square(y).sum(axis=1).tolist(), (y @ np.array(rest, dtype=np.int64)).tolist()
    else:
        wide = y.astype(object)
        squares, cross = (wide * wide).sum(axis=1).tolist(), wide.dot(np.array(rest, dtype=object)).tolist()
    last = sum(r * r for r in rest)
    return [n * n * a - 2 * n * b + last for a, b in zip(squares, cross)]


def transform(model: Model) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    spark, k = model.blocks.sparkSession, len(model.variances)
    if not k:
        return spark.createDataFrame([], _WHITE)
    n, sums = model.n, [s - SHIFT * model.n for s in model.sums]
    whole, part = _mean(sums, n)
    axes, explained, error = model.components / np.sqrt(model.variances), model.variances / model.trace, model.identity_error

    def run(batches):
        for batch in batches:
            for x, ids, none in zip(_rows(batch), batch.column("ids").to_pylist(), batch.column("no_ids").to_pylist()):
                rows = len(x)
                z = _centred(x, whole, part) @ axes
                numbers = pa.array(np.repeat(np.frombuffer(ids, dtype="<i8"), k), mask=np.repeat(np.unpackbits(np.frombuffer(none, dtype=np.uint8), count=rows, bitorder="little").astype(bool), k))
                exact = deviations(x, sums, n)
                high, low = pa.array(np.repeat([v >> 62 for v in exact], k)), pa.array(np.repeat([v & (1 << 62) - 1 for v in exact], k))
                columns = [numbers, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), high, low, pa.array(z.ravel()), pa.array(np.tile(explained, rows))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "high", "low", "whitened", "explained"])

    rows = model.blocks.select("dim", "n", "bits", "entries", "ids", "no_ids").mapInArrow(run, "vec_id bigint, component int, high bigint, low bigint, whitened double, explained double")
    exact = F.col("high").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.col("low")
    return rows.select("vec_id", "component", F.lit(n).cast("bigint").alias("n"), exact.cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))


def whitened(vectors: DataFrame, want: int = 8) -> DataFrame:
    """The rows of ``vectors`` (vec_id, embedding) on their first ``want`` components, each with variance one."""
    return transform(fit(vectors, want))
