"""Fourier transforms, not normalised, over rows of (r, c, re, im)."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

FORWARD, REVERSE = 1, 0
#: Rows in a batch of results.
BATCH = 10_000
#: Places of a line that a task holds; a longer line goes through files.
LINE = 1_000_000
#: Places of such files that a task holds at once.
BLOCK = 1 << 18


def _starts(line) -> np.ndarray:
    """Where another line begins in a sorted column; null is a line of its own."""
    keys, none = line.fill_null(0).to_numpy(), line.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero((keys[1:] != keys[:-1]) | (none[1:] != none[:-1])) + 1


def _numbers(batch) -> np.ndarray:
    z = np.empty(batch.num_rows, np.complex128)
    z.real, z.imag = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("re", "im"))
    return z


def _move(op, file, part: np.ndarray, at: int, step: int = 0) -> None:
    """Read or write a file of complex numbers: the rows of a block from place at on, each step after the last."""
    for i, row in enumerate(np.atleast_2d(part)):
        if op(file.fileno(), [row.view(np.uint8)], 16 * (at + i * step)) != row.nbytes:
            raise OSError("a file of a long line was cut short")


def _blocks(file, shape, height: int, width: int):
    """Blocks of a matrix in a file, with their first row and column."""
    for top in range(0, shape[0], height):
        for left in range(0, shape[1], width):
            part = np.empty((min(height, shape[0] - top), min(width, shape[1] - left)), np.complex128)
            _move(os.preadv, file, part, top * shape[1] + left, shape[1])
            yield part, top, left


def _tall(shape, block: int) -> tuple[int, int]:
    return shape[0], max(1, block // shape[0])


def _turned(shape, left: int, width: int) -> np.ndarray:
    return np.exp(-2j * np.pi / (shape[0] * shape[1]) * (np.arange(shape[0])[:, None] * np.arange(left, left + width)))


def _filed_fft(file, shape, block: int) -> None:
    """The transform of shape[0] * shape[1] numbers in a file: number k comes to row k % shape[0], column k // shape[0]."""
    for part, _, left in _blocks(file, shape, *_tall(shape, block)):
        _move(os.pwritev, file, np.fft.fft(part, axis=0) * _turned(shape, left, part.shape[1]), left, shape[1])
    for part, top, _ in _blocks(file, shape, max(1, block // shape[1]), shape[1]):
        _move(os.pwritev, file, np.fft.fft(part), top * shape[1], shape[1])


def _filed_inverse(file, shape, block: int) -> None:
    """The way back, from that order to the first."""
    for part, top, _ in _blocks(file, shape, max(1, block // shape[1]), shape[1]):
        _move(os.pwritev, file, np.fft.ifft(part), top * shape[1], shape[1])
    for part, _, left in _blocks(file, shape, *_tall(shape, block)):
        _move(os.pwritev, file, np.fft.ifft(part * _turned(shape, left, part.shape[1]).conj(), axis=0), left, shape[1])


class _Filed:
    """A line too long to hold, in files of the executor's local folder; they go with the task."""

    def __init__(self, batches, line: str, place: str, direction: int, limit: int, block: int):
        self.line, self.place, self.direction, self.limit, self.block = line, place, direction, limit, block
        self.key, self.n, self.known = batches[0].column(line)[0], 0, 0
        self.places, self.numbers = self._file(), self._file()
        for b in batches:
            self.append(b)

    @staticmethod
    def _file():
        return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)

    def append(self, batch) -> None:
        places = batch.column(self.place)
        self.places.write(np.ascontiguousarray(places.fill_null(0).to_numpy()))
        z = _numbers(batch)
        _move(os.pwritev, self.numbers, z if self.direction == FORWARD else z.conj(), self.n)
        self.n += len(z)
        self.known += len(z) - places.null_count  # null places come last

    def _transform(self):
        """Its forward transform in order, block by block."""
        n, block = self.n, self.block
        rows = next(x for x in range(int(n**0.5) + 1, 0, -1) if n % x == 0)
        if n // rows <= self.limit:
            shape = rows, n // rows
            _filed_fft(self.numbers, shape, block)
            for part, _, _ in _blocks(self.numbers, shape, *_tall(shape, block)):
                yield part.T.ravel()
            return
        # Without such divisors: as a convolution with a chirp, of a length that is a power of two.
        bits = (2 * n - 2).bit_length()
        shape = 1 << bits // 2, 1 << bits - bits // 2
        m = shape[0] * shape[1]
        chirp = lambda a, b: np.exp(-1j * np.pi / n * (np.arange(a, b, dtype=np.uint64) ** 2 % (2 * n)))
        with self._file() as other:
            self.numbers.truncate(16 * m)
            other.truncate(16 * m)
            for a in range(0, n, block):
                w = chirp(a, min(a + block, n))
                z = np.empty_like(w)
                _move(os.preadv, self.numbers, z, a)
                _move(os.pwritev, self.numbers, z * w, a)
                _move(os.pwritev, other, w.conj(), a)
                back = w.conj()[::-1] if a else w.conj()[:0:-1]
                _move(os.pwritev, other, np.ascontiguousarray(back), m - a - len(w) + 1)
            for x in (self.numbers, other):
                _filed_fft(x, shape, block)
            for a in range(0, m, block):
                z, w = np.empty((2, min(block, m - a)), np.complex128)
                _move(os.preadv, self.numbers, z, a)
                _move(os.preadv, other, w, a)
                _move(os.pwritev, self.numbers, z * w, a)
        _filed_inverse(self.numbers, shape, block)
        for a in range(0, n, block):
            z = np.empty(min(block, n - a), np.complex128)
            _move(os.preadv, self.numbers, z, a)
            yield z * chirp(a, a + len(z))

    def transformed(self):
        with self.places, self.numbers:
            self.places.seek(0)
            at = 0
            for z in self._transform():
                places = np.frombuffer(self.places.read(8 * len(z)), np.int64)
                none = np.arange(at, at + len(z)) >= self.known
                at += len(z)
                keys = pa.repeat(self.key, len(z))
                yield from _results(self.line, keys, self.place, pa.array(places, mask=none), z if self.direction == FORWARD else z.conj())


def _results(line: str, keys, place: str, places, z: np.ndarray):
    for a in range(0, len(z), BATCH):
        own = z[a : a + BATCH]
        columns = {line: keys.slice(a, BATCH), place: places.slice(a, BATCH)}
        columns |= {x: pa.array(np.ascontiguousarray(v), from_pandas=True) for x, v in (("re", own.real), ("im", own.imag))}
        yield pa.RecordBatch.from_pydict({x: columns[x] for x in ("r", "c", "re", "im")})


def _whole(batches, line: str, place: str, direction: int, limit: int, block: int):
    """Sorted batches cut between lines: lists of batches that hold whole lines, one line or the
    short ones of a batch, or a line in files. Only the line that is still open is kept."""
    held, key, n = [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(line)
        if held and keys[0].as_py() != key:
            yield held
            held = []
        starts = _starts(keys)
        if len(starts):
            first, last = int(starts[0]) if held else 0, int(starts[-1])
            if held:
                held.append(batch.slice(0, first))
                yield held
                held = []
            if first < last:
                yield [batch.slice(first, last - first)]
            batch = batch.slice(last)
        n = batch.num_rows + (n if held else 0)
        held.append(batch)
        key = keys[-1].as_py()
        if n > limit and isinstance(held, list):
            held = _Filed(held, line, place, direction, limit, block)
    if held:
        yield held


def _transformed(batches, line: str, place: str, direction: int, limit: int, block: int):
    """The transforms of lines that come one after another, each in the order of its places."""
    for found in _whole(batches, line, place, direction, limit, block):
        if isinstance(found, _Filed):
            yield from found.transformed()
            continue
        n = sum(b.num_rows for b in found)
        alone = found[0].column(line)[0].as_py() == found[-1].column(line)[-1].as_py()
        keys, places = (pa.concat_arrays([b.column(x) for b in found]) for x in (line, place))
        z = np.empty(n, np.complex128)
        at = 0
        for b in found:
            z[at : at + b.num_rows] = _numbers(b)
            at += b.num_rows
        found.clear()  # the batches go before the transform takes room
        del b
        ends = [0, n] if alone else [0, *_starts(keys).tolist(), n]
        lengths = np.diff(ends)
        # Neighbours of one length are transformed at once.
        turns = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
        for a, b in zip(turns, turns[1:]):
            part = z[ends[a] : ends[b]].reshape(b - a, -1)
            f = np.fft.fft(part) if direction == FORWARD else np.fft.ifft(part)
            if direction != FORWARD:
                f *= part.shape[1]
            part[:] = f
            del f
        yield from _results(line, keys, place, places, z)


def _lines(grid: DataFrame, line: str, place: str, direction: int) -> DataFrame:
    """Transforms along one index: a task gets whole lines, sorted, and holds one at a time, of LINE places at most."""
    ship(grid.sparkSession)
    rows = grid.select(F.col("r").cast("long"), F.col("c").cast("long"), F.col("re").cast("double"), F.col("im").cast("double"))
    met = rows.repartition(line).sortWithinPartitions(line, F.asc_nulls_last(place))
    limit, block = LINE, BLOCK
    return met.mapInArrow(lambda batches: _transformed(batches, line, place, direction, limit, block), "r long, c long, re double, im double")


def fft_rows(grid: DataFrame, direction: int = FORWARD) -> DataFrame:
    return _lines(grid, "r", "c", direction)


def fft_columns(grid: DataFrame, direction: int = FORWARD) -> DataFrame:
    return _lines(grid, "c", "r", direction)


def fft_2d(grid: DataFrame, direction: int = FORWARD) -> DataFrame:
    """Rows, then columns."""
    return fft_columns(fft_rows(grid, direction), direction)


def fft_2d_transposed(grid: DataFrame, direction: int = FORWARD) -> DataFrame:
    """The same by row transforms with a transpose after each."""
    turn = lambda g: g.select(F.col("c").alias("r"), F.col("r").alias("c"), "re", "im")
    return turn(fft_rows(turn(fft_rows(grid, direction)), direction))
