"""Packing token sequences with non-negative least squares.

Documents longer than a window fill whole windows; what is left of each is a piece of whole units of 64 tokens and a
tail of fewer. Shallow combinations of piece lengths that fill a window exactly are enumerated once; for each batch of
pieces, repeat counts of the combinations are solved against the histogram of lengths, rounded down, and filled. Pieces
left over, and the tails, are packed greedily one after another and cut where a window is full. Each task packs its own
rows, so nothing is shuffled; what is left at its end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import tokens

WINDOW, UNIT, DEPTH, END = 2048, 64, 4, 1
BATCH_TOKENS = 4_000_000


@functools.lru_cache(maxsize=8)
def combinations(units: int, depth: int = DEPTH) -> np.ndarray:
    """Columns: how often each length 1 .. units - 1 occurs in a combination of 2 to `depth` lengths that sum to `units`."""
    found: list[list[int]] = []

    def grow(parts: list[int], left: int) -> None:
        if not left:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(min(left, parts[-1] if parts else units - 1), 0, -1):
                if x * (depth - len(parts)) < left:
                    break
                grow([*parts, x], left - x)

    grow([], units)
    return np.stack([np.bincount(p, minlength=units)[1:units] for p in found], axis=1).astype(float)


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, max_rounds: int | None = None) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by the active set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(max_rounds or 3 * n):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[best] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (trial <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x += step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
        x = trial
    return x


class Packer:
    """Packs the documents of one task. A piece is (row, start, ids): the row of its document among those added."""

    def __init__(self, first_sequence: int, window: int = WINDOW, unit: int = UNIT, batch_tokens: int = BATCH_TOKENS):
        self.window, self.unit, self.batch_tokens, self.sequence = window, unit, batch_tokens, first_sequence
        self.docs: list[tuple[object, int]] = []
        self.pools: dict[int, list] = {}
        self.rest: deque = deque()
        self.out: list[tuple] = []
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.window * self.window
        doc = (doc_id, n)
        for at in range(0, whole, self.window):
            self._emit([(doc, at, ids[at : at + self.window])])
        units = (n - whole) // self.unit
        if units:
            self.pools.setdefault(units, []).append((doc, whole, ids[whole : whole + units * self.unit]))
        if whole + units * self.unit < n:
            self.rest.append((doc, whole + units * self.unit, ids[whole + units * self.unit :]))
        self.held += n - whole
        if self.held >= self.batch_tokens:
            self.solve()

    def solve(self) -> None:
        """Fill windows from the pieces held, all but the last window's worth."""
        per_window = self.window // self.unit
        if per_window > 1:
            plans = combinations(per_window)
            counts = np.array([len(self.pools.get(k, ())) for k in range(1, per_window)], dtype=float)
            repeats = np.floor(non_negative_least_squares(plans, counts) + 1e-6).astype(int)
            for k in np.flatnonzero(repeats):
                need = [(length + 1, int(c)) for length, c in enumerate(plans[:, k]) if c]
                for _ in range(min(repeats[k], *(len(self.pools.get(length, ())) // c for length, c in need))):
                    self._emit([self.pools[length].pop() for length, c in need for _ in range(c)])
        for length in sorted(self.pools, reverse=True):
            self.rest.extend(self.pools[length])
        self.pools.clear()
        while sum_at_least(self.rest, self.window):
            self._fill(self.window)
        self.held = sum(len(p[2]) for p in self.rest)

    def finish(self) -> None:
        self.solve()
        while left := sum(len(p[2]) for p in self.rest):
            self._fill(1 << (left.bit_length() - 1))

    def _fill(self, size: int) -> None:
        taken = []
        while size:
            doc, start, ids = self.rest.popleft()
            if len(ids) > size:
                self.rest.appendleft((doc, start + size, ids[size:]))
                ids = ids[:size]
            taken.append((doc, start, ids))
            size -= len(ids)
        self._emit(taken)

    def _emit(self, pieces: list) -> None:
        offset = 0
        for (doc_id, n), start, ids in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1


def sum_at_least(pieces, size: int) -> bool:
    """Whether the pieces' lengths sum to `size`; looks no further than it must."""
    for p in pieces:
        size -= len(p[2])
        if size <= 0:
            return True
    return False


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.VOCABULARY, window: int = WINDOW, unit: int = UNIT, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids and the end id, so that null and empty texts are one token. Pieces of a sequence lie one
    after another from offset 0 and sum to `window`, or at the end of a task to a power of two, so no sequence needs
    padding. Sequence ids are unique: a task's number times 2**33, counted up. Repeated rows and null ids are packed
    like any other row; other columns are not read; no rows give no pieces.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, id_type = tokens.encoder(vocabulary).ids, Packer(TaskContext.get().partitionId() << 33, window, unit), None

        def ready() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True))
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type=id_type), *(pa.array(c, type=pa.int64()) for c in columns[1:])], ["doc_id", *names])

        last = np.array([end], dtype="<u4")
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            id_type = ids.type
            for doc_id, text in zip(ids, texts, strict=True):
                packer.add(doc_id.as_py(), np.concatenate([encode(text.as_py()).astype("<u4", copy=False), last]))
            if packer.out:
                yield ready()
        packer.finish()
        if packer.out:
            yield ready()

    return own.mapInArrow(run, schema)
