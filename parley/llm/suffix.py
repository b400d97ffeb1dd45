"""Removal of long repeated passages with run-length suffix indexes.

A byte goes if a string of `length` bytes covers it that also starts in a document with a smaller id. Documents are dealt
to shards, which are written compressed. Every window of `length` bytes belongs to the least hash among its grams, so that equal windows, wherever they
are, meet under the same hash; windows in a row with one hash make a *run*, a string that holds them all. Where a sample
says that very many runs would meet under one hash, the next least hash deals them once more.

1. Each shard sends its distinct runs as hashes, in one message for each range of hashes that it has runs of.
2. The gathering tasks find each run's smallest document, however many documents have it: equal strings are one entry of an
   index, with their smallest owner. Where different runs share a hash, they may have windows in common, and the first
   document of each sends its text; a run that shares its hash with no other needs no search.
3. These texts are indexed in bounded pieces: their Burrows-Wheeler transform is kept as runs, each with a sample at its
   end. Texts are streamed backwards through the index, which gives the matching statistics up to `length`; a full match is
   answered from the samples of its rows. Texts of a group too large for one piece stream through the pieces before theirs.
4. The shards mark what steps 2 and 3 found and cut it out.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import scratch

LENGTH, GRAM = 50, 20
SHARD_BYTES = 2 << 20
#: Windows in a run at most; text in one index at most, but for a single text.
RUN_WINDOWS, INDEX_BYTES = 64, 1 << 19
#: Runs under one hash beyond which the next least hash deals them again; rows sampled to find such hashes (a ten-thousandth
#: of all, if that is more), sampled runs that it takes, and hashes known at most. They bear on speed only.
HOT_RUNS, SAMPLE_ROWS, SAMPLE_LEAST, HOT_KEYS = 8192, 2000, 8, 50_000
#: Hashes are asked about in so many parts, one after the other, so that a part of the messages is on disk at once.
ASKS = 2
_STRIDE = 1 << 18
_KEY_BITS = np.uint64(0xFFFF_FFFF_FFF0_0000)
_NO_ID = np.iinfo(np.int64).max


class Shard:
    """The runs of some documents (ids, raw texts): `start`, `windows` and `doc` for each, and `kind`, its number among the distinct ones."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int = LENGTH, hot: np.ndarray | None = None):
        self.ids, self.texts, self.length = ids, texts, length
        self.hot = np.zeros(0, dtype=np.uint64) if hot is None else hot
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.raw = b"".join(texts)
        self.start, self.windows, keys = self._runs()
        self.doc = np.searchsorted(self.begin, self.start, side="right") - 1
        ends = self.start + self.windows + length - 1
        digest, raw = xxhash.xxh3_64_digest, self.raw
        sums = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(self.start.tolist(), ends.tolist(), strict=True)]), dtype=np.uint64)
        # Low bits of the sums order runs of one hash; should that part two equal runs, both are sent, and answered alike.
        order = np.argsort(keys | (sums & ~_KEY_BITS))
        new = np.r_[True, (keys[order][1:] != keys[order][:-1]) | (sums[order][1:] != sums[order][:-1])][: len(order)]
        self.kind = np.empty(len(order), dtype=np.int64)
        self.kind[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.keys, self.sums = keys[order][at], sums[order][at]
        self.least = np.minimum.reduceat(ids[self.doc][order], at) if len(at) else np.zeros(0, dtype=np.int64)

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, length = len(self.raw), self.length
        if n < length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        # A window that crosses into the next document is none.
        whole = np.ones(n - length + 1, dtype=bool)
        for b in self.begin[1:-1].tolist():
            whole[max(0, b - length + 1) : b] = False
        edge = np.zeros(len(whole), dtype=bool)
        edge[0] = True
        edge[1:] = whole[1:] != whole[:-1]
        inner = self.begin[1:-1]
        edge[inner[inner < len(edge)]] = True
        found, before = [], np.uint64(0)
        for a in range(0, len(edge), _STRIDE):
            least = self._least(a, min(a + _STRIDE, len(edge)))
            own = np.flatnonzero(np.r_[least[0] != before, least[1:] != least[:-1]] | edge[a : a + _STRIDE])
            found.append((own + a, least[own]))
            before = least[-1]
        at, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        size = np.diff(np.r_[at, len(edge)])
        keep = whole[at]
        at, size, keys = at[keep], size[keep], keys[keep]
        # The least of many hashes is small; spread them evenly again, for tasks get equal ranges of them.
        at, size, keys = self._deal_again(at, size, _spread(keys))
        if (size > RUN_WINDOWS).any():
            parts = -(-size // RUN_WINDOWS)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, keys = np.repeat(at, parts) + nth * RUN_WINDOWS, np.repeat(keys, parts)
            size = np.minimum(RUN_WINDOWS, np.repeat(size, parts) - nth * RUN_WINDOWS)
        return at, size, keys

    def _deal_again(self, at: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs, those under a hot hash cut where the next least hash of their windows changes, and dealt by it as well."""
        is_hot = np.isin(keys, self.hot)
        if not is_hot.any():
            return at, size, keys
        found = [(at[~is_hot], size[~is_hot], keys[~is_hot])]
        for a, n, key in zip(at[is_hot].tolist(), size[is_hot].tolist(), keys[is_hot], strict=True):
            for first in range(a, a + n, _STRIDE):
                last = min(a + n, first + _STRIDE)
                grams = self._grams(first, last)
                grams[grams == grams[: self.length - GRAM + 1].min()] = ~np.uint64(0)
                second = _sliding_least(grams, self.length - GRAM + 1)
                begin = np.flatnonzero(np.r_[True, second[1:] != second[:-1]])
                found.append((begin + first, np.diff(np.r_[begin, last - first]), _spread(second[begin] ^ key)))
        at, size, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        if (still := np.isin(keys, self.hot)).any():
            # Each window by itself, under the hash of all its bytes.
            many = size[still]
            single = np.repeat(at[still] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            own = np.array([xxhash.xxh3_64_intdigest(self.raw[w : w + self.length]) for w in single.tolist()], dtype=np.uint64)
            at, size, keys = (np.concatenate(x) for x in ((at[~still], single), (size[~still], np.ones(len(single), dtype=np.int64)), (keys[~still], _spread(own))))
        order = np.argsort(at)
        return at[order], size[order], keys[order]

    def _grams(self, first: int, last: int) -> np.ndarray:
        """Hashes of all grams in the windows that start in [first, last)."""
        count = last - first + self.length - GRAM
        words = np.ndarray((count + GRAM - 8,), dtype="<u8", buffer=self.raw, offset=first, strides=(1,))
        gram = words[:count] * np.uint64(0x9E3779B97F4A7C15) ^ words[8 : 8 + count] * np.uint64(0xC2B2AE3D27D4EB4F) ^ words[12 : 12 + count] * np.uint64(0x165667B19E3779F9)
        gram ^= gram >> np.uint64(32)
        gram *= np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(29)
        return gram

    def _least(self, first: int, last: int) -> np.ndarray:
        """The least hash among the grams of each window that starts in [first, last)."""
        return _sliding_least(self._grams(first, last), self.length - GRAM + 1)


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    width, least = 1, values
    while width * 2 <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if more := size - width:
        least = np.minimum(least[:-more], least[more:])
    return least


def _spread(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    keys = (keys ^ (keys >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return keys & _KEY_BITS


def parts_of(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n equal ranges of hashes some sorted ones lie in, each once, and where each begins among them, and the end.

    As long as there are hashes: a shard never looks at ranges that it has none of.
    """
    part = (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    return part[begin].astype(np.int64), np.r_[begin, len(part)]


class RunIndex:
    """Run-length Burrows-Wheeler transform of some texts, each with an owner; texts hold no byte 0xFF."""

    def __init__(self, texts: list[bytes], owners: np.ndarray, length: int = LENGTH):
        self.length, sizes = length, np.array([len(t) + 1 for t in texts], dtype=np.int64)
        x = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
        n = len(x)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # bytes to the text's end, its 0xFF included
        # Prefix doubling that stops at each text's end.
        padded = np.concatenate([x, np.zeros(8, dtype=np.uint8)])
        key = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
        short = left < 8
        key[short] &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * left[short].astype(np.uint64))
        rank, ranks, width = _ranks(key), {}, 8
        while True:
            ranks[width] = rank
            if width >= length:  # the order of what has `length` bytes in common is of no use
                break
            beyond = np.zeros(n, dtype=np.int64)
            inside = np.flatnonzero(left > width)
            beyond[inside] = rank[inside + width] + 1
            rank, width = _ranks(rank * np.int64(n + 1) + beyond), width * 2
        order = np.argsort(rank * np.int64(n) + np.arange(n))
        before = x[order - 1]
        full, part = (_starts(order, ranks, left, k) for k in (length, length - 1))
        # A class holds the suffixes whose first `length` bytes are equal; shorter ones are in none.
        is_long = left[order[full]] > length
        self.full, self.full_end = full[is_long], np.r_[full[1:], n][is_long]
        # Runs of the transform also end where a class does, so that each lies in one class.
        new = np.r_[True, before[1:] != before[:-1]]
        new[self.full] = True
        new[self.full_end[self.full_end < n]] = True
        begin = np.flatnonzero(new)
        # The class of the last window of each text, where a text of the index itself can start.
        row = np.empty(n, dtype=np.int64)
        row[order] = np.arange(n)
        self.own = np.searchsorted(self.full, row[np.maximum(np.cumsum(sizes) - 1 - length, 0)], side="right") - 1
        in_part = np.searchsorted(part, self.full, side="right") - 1
        self.part, self.part_end = part[in_part], np.r_[part[1:], n][in_part]  # of each class the rows with all but its last byte
        del row, key, rank, ranks
        self.n, self.counts = n, np.concatenate([[0], np.cumsum(np.bincount(x, minlength=256))])
        # Each run's sample is the text position of that of its suffixes which has the smallest owner.
        by_row, run_size = owners[text_of[order]], np.diff(np.r_[begin, n])
        smallest = np.flatnonzero(by_row == np.repeat(np.minimum.reduceat(by_row, begin), run_size))
        self.sample, self.ends, self.owners = order[smallest[np.searchsorted(smallest, begin)]], np.cumsum(sizes), owners
        del by_row, smallest
        runs = np.searchsorted(begin, np.stack([self.full, self.full_end], axis=1).ravel())
        told = np.r_[self.owner(self.sample), _NO_ID]
        self.class_least = np.minimum.reduceat(told, runs)[::2] if len(runs) else told[:0]
        # Runs by byte, then by place, with how many of that byte lie in earlier runs.
        letter, size = before[begin].astype(np.int64), np.diff(np.r_[begin, n])
        by = np.argsort(letter * (n + 1) + begin)
        self.run_key, self.run_begin, self.run_size, self.run_letter = (letter * (n + 1) + begin)[by], begin[by], size[by], letter[by]
        total = np.cumsum(size[by]) - size[by]
        self.run_before = total - self.counts[self.run_letter]

    def owner(self, position: np.ndarray) -> np.ndarray:
        """The owners of the texts that hold some positions."""
        return self.owners[np.searchsorted(self.ends, position, side="right")]

    def _step(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row that `letter` before the suffixes above `row` leads to."""
        k = np.searchsorted(self.run_key, letter * (self.n + 1) + row) - 1
        k = np.maximum(k, 0)
        found = self.run_letter[k] == letter
        count = np.where(found & (self.run_begin[k] < row), self.run_before[k] + np.minimum(row - self.run_begin[k], self.run_size[k]), 0)
        return self.counts[letter] + count

    def stream(self, texts: list[bytes], own: bool = False) -> list[np.ndarray]:
        """For each text and each start: the smallest owner of a text with the same `length` bytes there, -1 for none.

        All texts go backwards in step. A match is as long as the matching statistics, up to `length`; one that grows to
        `length` is answered from its class and shortened by a byte at its end before it grows again, and one that fails
        starts anew. `own`: the texts are those of the index, in its order and none shorter than `length`, so that the match
        of the last window is known.
        """
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends, x = np.cumsum(sizes), np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
        out = np.full(len(x), -1, dtype=np.int64)
        low, high, size, of = (np.full(len(texts), v, dtype=np.int64) for v in (0, self.n, 0, 0))
        begin = 0
        if own:
            of, size[:], begin = self.own.copy(), self.length, self.length
            out[ends - self.length] = self.class_least[of]
        for k in range(begin, int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > k)
            full = live[size[live] == self.length]
            low[full], high[full] = self.part[of[full]], self.part_end[of[full]]
            size[full] -= 1
            at = ends[live] - 1 - k
            a, b = self._step(np.r_[x[at], x[at]], np.r_[low[live], high[live]]).reshape(2, -1)
            low[live], high[live] = a, b
            size[live] += 1
            lost = live[a >= b]
            if len(lost):  # matches shorter than `length` that go on are found again from here
                low[lost], high[lost], size[lost] = self._again(x, ends[lost] - 1 - k, ends[lost])
            done = live[size[live] == self.length]
            of[done] = np.searchsorted(self.full, low[done], side="right") - 1
            out[ends[done] - 1 - k] = self.class_least[of[done]]
        return np.split(out, ends[:-1])

    def _again(self, x: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Longest match of what begins at each place, short of `length`, by bisection: what a match begins with matches too."""
        low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.n)
        has, lacks = np.zeros(len(at), dtype=np.int64), np.minimum(self.length, ends - at + 1)
        while len(open_ := np.flatnonzero(lacks - has > 1)):
            size = (has[open_] + lacks[open_]) // 2
            a, b = np.zeros(len(open_), dtype=np.int64), np.full(len(open_), self.n)
            for k in range(int(size.max())):
                live = np.flatnonzero((size > k) & (a < b))
                letter = x[at[open_[live]] + size[live] - 1 - k]
                a[live], b[live] = self._step(np.r_[letter, letter], np.r_[a[live], b[live]]).reshape(2, -1)
            hit = a < b
            has[open_[hit]], low[open_[hit]], high[open_[hit]] = size[hit], a[hit], b[hit]
            lacks[open_[~hit]] = size[~hit]
        return low, high, has


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
    return out


def _starts(order: np.ndarray, ranks: dict[int, np.ndarray], left: np.ndarray, length: int) -> np.ndarray:
    """Rows at which the first `length` bytes change; a suffix that ends sooner stands alone."""
    width = max((w for w in ranks if w <= length), default=0)
    rank = ranks[width] if width else np.zeros(len(order), dtype=np.int64)
    here, there = rank[order], rank[np.minimum(order + length - width, len(order) - 1)]
    long = left[order] > length
    return np.flatnonzero(np.r_[True, (here[1:] != here[:-1]) | (there[1:] != there[:-1]) | ~long[1:] | ~long[:-1]])


def earlier_windows(groups: np.ndarray, texts: list[bytes], owners: np.ndarray, length: int = LENGTH, index_bytes: int = INDEX_BYTES) -> list[np.ndarray]:
    """For each text, whether the window at each start is also in a text of a smaller owner in its group.

    Texts come in the order of their groups and owners. Groups share an index as long as it stays below `index_bytes`. A
    larger group has several, for one stretch of its texts each; the texts after that stretch stream through it too.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    out: list[np.ndarray] = []
    begin, held = 0, 0
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]][: len(groups)])
    ends = np.r_[first[1:], len(groups)]

    def earlier(found: list[np.ndarray], a: int, b: int) -> list[np.ndarray]:
        return [(f[: len(t) - length + 1] < o) & (f[: len(t) - length + 1] >= 0) for f, t, o in zip(found, texts[a:b], owners[a:b], strict=True)]

    def cuts(a: int, b: int) -> list[int]:
        """Where stretches of about `index_bytes` begin, and the end."""
        number = (np.cumsum(sizes[a:b]) - sizes[a:b]) // index_bytes
        return [a + k for k in np.flatnonzero(np.r_[True, number[1:] != number[:-1]]).tolist()] + [b]

    def settle(a: int, b: int) -> None:
        at, mine = cuts(a, b), []
        for k, (c, d) in enumerate(zip(at[:-1], at[1:], strict=True)):
            index = RunIndex(texts[c:d], owners[c:d], length)
            mine[c - a : d - a] = [old | new for old, new in zip(mine[c - a : d - a] or [np.False_] * (d - c), earlier(index.stream(texts[c:d], own=True), c, d), strict=True)]
            for e, f in zip(at[k + 1 : -1], at[k + 2 :], strict=True):
                new = earlier(index.stream(texts[e:f]), e, f)
                mine[e - a : f - a] = [x | y for x, y in zip(mine[e - a : f - a] or [np.False_] * (f - e), new, strict=True)]
        out.extend(mine)

    for f, e in zip(first.tolist(), ends.tolist(), strict=True):
        weight = int(sizes[f:e].sum())
        if held and held + weight > index_bytes:
            settle(begin, f)
            begin, held = f, 0
        held += weight
    if begin < len(texts):
        settle(begin, len(texts))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """The arrays as bytes; all first bytes of an array's numbers come before all second ones, so that those which vary little shrink."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.array([len(b), a.dtype.num], dtype=np.int64).tobytes() + b for a, b in zip(arrays, planes, strict=True)))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    kinds = {np.dtype(k).num: np.dtype(k) for k in (np.uint8, np.uint32, np.int64, np.uint64)}
    while at < len(raw):
        size, kind = np.frombuffer(raw, dtype=np.int64, count=2, offset=at)
        width = kinds[int(kind)].itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=int(size), offset=at + 16).reshape(width, -1)
        out.append(np.ascontiguousarray(planes.T).view(kinds[int(kind)]).ravel())
        at += 16 + int(size)
    return out


_MESSAGE = "to long, sender long, what int, blob binary"
_ARROW = pa.schema([("to", pa.int64()), ("sender", pa.int64()), ("what", pa.int32()), ("blob", pa.binary())])


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return scratch.tidy(pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _ARROW, strict=True)], schema=_ARROW))


def _dealt(own: DataFrame, shard_bytes: int) -> DataFrame:
    """(to, blob): shards of rows (id, raw, row) with about `shard_bytes` of text, compressed, as a table.

    A shard is what a task reads in a row. It is written once, so that no later step shuffles texts as they are.
    """

    def shard(to: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(pa.Table.from_batches(rows).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["to", "blob"])

    def deal(batches):
        to, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("raw")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                end = min(batch.num_rows, int(np.searchsorted(ends, before + shard_bytes - size)) + 1)
                held.append(batch.slice(at, end - at))
                size += int(ends[end - 1]) - before
                at = end
                if size >= shard_bytes:
                    yield shard(to, held)
                    to, held, size = to + 1, [], 0
        if held:
            yield shard(to, held)
        scratch.tidy()

    return scratch.write_and_read(own.mapInArrow(deal, "to long, blob binary"), "shards")


def _rows(shard: pa.Table) -> pa.Table:
    """The rows of a shard of `_dealt`."""
    return pa.ipc.open_stream(shard.column("blob")[0].as_py()).read_all()


def _shard(table: pa.Table, length: int, hot: np.ndarray) -> Shard:
    ids = np.asarray(table.column("id").to_numpy(), dtype=np.int64)
    return Shard(ids, [t or b"" for t in table.column("raw").to_pylist()], length, hot)


def hot_keys(docs: DataFrame, text_col: str, length: int) -> np.ndarray:
    """Hashes under which a sample expects more than HOT_RUNS different runs, HOT_KEYS at most: those of the first dealing,
    and those that the second one leaves so."""
    rows = docs.count()
    of = max(1, min(rows // SAMPLE_ROWS, 10_000))
    raw = F.col(text_col).cast("binary")
    sample = docs.where(F.pmod(F.xxhash64(F.col(text_col), F.lit(1)), F.lit(of)) == 0).select(raw.alias("raw"))
    hot = np.zeros(0, dtype=np.uint64)
    for _ in range(2):
        found = _sampled(sample, length, of, hot)
        if not len(found):
            break
        hot = np.unique(np.concatenate((hot, found)))
    return hot


def _sampled(sample: DataFrame, length: int, of: int, hot: np.ndarray) -> np.ndarray:
    """Hashes of a sample's runs, dealt with those known as hot, that expect too many different ones."""

    def read(batches):
        for batch in batches:
            shard = Shard(np.zeros(batch.num_rows, dtype=np.int64), [t or b"" for t in batch.column("raw").to_pylist()], length, hot)
            yield pa.RecordBatch.from_arrays([pa.array(shard.keys.view(np.int64)), pa.array(shard.sums.view(np.int64))], ["key", "sum"])

    runs = sample.mapInArrow(read, "key long, sum long").distinct().groupBy("key").agg(F.count("*").alias("n"))
    found = runs.where((F.col("n") >= SAMPLE_LEAST) & (F.col("n") * of > HOT_RUNS)).orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()
    return np.array([r.key for r in found], dtype=np.int64).view(np.uint64)


def _found(shard: Shard, answers: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Of each distinct run its smallest document and whether it shares windows with others; then what indexes found."""
    least, mixed, marked = shard.least.copy(), np.zeros(len(shard.least), dtype=bool), []
    part, bounds = parts_of(shard.keys, parts)
    for sender, what, blob in zip(*(answers.column(c).to_pylist() for c in ("sender", "what", "blob")), strict=True):
        got = _unpack(blob)
        if what == 1:
            marked.append(got)
        else:
            at = got[0].astype(np.int64) + bounds[np.searchsorted(part, sender)]
            least[at], mixed[at] = got[1], got[2].astype(bool)
    return least, mixed, marked


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All rows and columns of `docs`, and `removed_spans` (array of start and end in bytes) and `kept_bytes` (binary).

    A null text has no bytes. Texts shorter than `length` lose nothing. A row without an id counts as later than all
    others. Rows that share an id don't match each other, nor do rows without one. The result of a row depends on the input's
    texts alone, not on what else is removed. No rows give no rows. Columns of `docs` may have any names, but for those two.
    """
    carried = [c for c in docs.columns if c not in ("removed_spans", "kept_bytes")]
    found = _cut(docs.select(*(F.col(f"`{c}`") for c in carried)), id_col, text_col, length, shard_bytes)
    columns = [F.col("text").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in carried]
    return found.select(*columns, F.col("spans").alias("removed_spans"), F.col("kept").alias("kept_bytes"))


def _cut(docs: DataFrame, id_col: str, text_col: str, length: int, shard_bytes: int) -> DataFrame:
    """(row, text, spans, kept, rest): all other columns as one, the text, what goes and stays of it, and that as whole characters (null: all)."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, -(-total // (3 * shard_bytes)))
    turns = min(ASKS, parts)
    hot = hot_keys(docs, text_col, length)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_ID)))
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.lit(True).alias("text" if text_col != "text" else "none"))
    own = docs.select(key.alias("id"), F.col(text_col).cast("binary").alias("raw"), others.alias("row"))

    def ask(batches, turn: int):
        for batch in batches:
            for k in range(batch.num_rows):
                mine = pa.Table.from_batches([batch.slice(k, 1)])
                shard, me = _shard(_rows(mine), length, hot), mine.column("to")[0].as_py()
                part, bounds = parts_of(shard.keys, parts)
                yield from _messages([(p, me, 0, _pack(np.diff(shard.keys[a:b], prepend=np.uint64(0)), shard.sums[a:b], shard.least[a:b])) for p, a, b in zip(part.tolist(), bounds[:-1], bounds[1:], strict=True) if p % turns == turn]).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        me, senders = table.column("to")[0].as_py(), table.column("sender").to_pylist()
        got = [_unpack(b) for b in table.column("blob").to_pylist()]
        keys, sums, ids = np.concatenate([np.cumsum(g[0]) for g in got]), *(np.concatenate([g[k] for g in got]) for k in (1, 2))
        sender, nth = np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), np.concatenate([np.arange(len(g[0])) for g in got])
        order = np.lexsort((sums, keys))
        k, s = keys[order], sums[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new = new_key | np.r_[True, s[1:] != s[:-1]]
        run, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[run]
        mixed = np.bincount(group[new])[group] > 1
        tell = mixed | (least < ids[order])
        by = order[tell][np.argsort(sender[order[tell]], kind="stable")]
        of = np.empty(len(order), dtype=np.int64)
        of[order] = np.arange(len(order))
        cuts = np.searchsorted(sender[by], np.arange(len(got) + 1))
        out = []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                at = of[by[a:b]]
                out.append((senders[i], me, 0, _pack(nth[by[a:b]].astype(np.uint32), least[at], mixed[at].astype(np.uint8))))
        return _messages(out)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        shard, me = _shard(_rows(table), length, hot), table.column("to")[0].as_py()
        least, mixed, _ = _found(shard, answers, parts)
        first = np.full(len(least), -1, dtype=np.int64)
        mine = np.flatnonzero(mixed[shard.kind] & (shard.ids[shard.doc] == least[shard.kind]))
        first[shard.kind[mine][::-1]] = mine[::-1]
        kinds = np.flatnonzero(first >= 0)
        runs, out = first[kinds], []
        part, bounds = parts_of(shard.keys[kinds], parts)
        for p, a, b in zip(part.tolist(), bounds[:-1], bounds[1:], strict=True):
            begin, size = shard.start[runs[a:b]], shard.windows[runs[a:b]] + length - 1
            text = b"".join([shard.raw[s : s + n] for s, n in zip(begin.tolist(), size.tolist(), strict=True)])
            out.append((p, me, 0, _pack(kinds[a:b], shard.keys[kinds[a:b]], least[kinds[a:b]], size, np.frombuffer(text, dtype=np.uint8))))
        return _messages(out)

    def index(table: pa.Table) -> pa.Table:
        me, senders, got = table.column("to")[0].as_py(), table.column("sender").to_pylist(), [_unpack(b) for b in table.column("blob").to_pylist()]
        kinds, keys, owners, sizes, raw = (np.concatenate([g[k] for g in got]) for k in range(5))
        raw, ends = raw.tobytes(), np.cumsum(sizes)
        sender = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        order = np.lexsort((owners, keys))
        texts = [raw[e - n : e] for e, n in zip(ends[order].tolist(), sizes[order].tolist(), strict=True)]
        hits: list[list[tuple[int, int, int]]] = [[] for _ in got]
        for i, seen in zip(order.tolist(), earlier_windows(keys[order], texts, owners[order], length), strict=True):
            if seen.any():
                edge = np.flatnonzero(np.diff(np.r_[False, seen, False].astype(np.int8)))
                hits[sender[i]] += [(kinds[i], a, b) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return _messages([(senders[i], me, 1, _pack(*np.array(h, dtype=np.int64).T.copy())) for i, h in enumerate(hits) if h])

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    result = T.StructType([own.schema["row"], T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()), T.StructField("rest", T.StringType())])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _rows(table)
        shard = _shard(table, length, hot)
        least, _, marked = _found(shard, answers, parts)
        later = np.flatnonzero(shard.ids[shard.doc] > least[shard.kind])
        begin, end = [shard.start[later]], [shard.start[later] + shard.windows[later] + length - 1]
        if marked:
            kinds, a, b = (np.concatenate([m[k] for m in marked]) for k in range(3))
            by_kind = np.argsort(shard.kind, kind="stable")
            low, high = np.searchsorted(shard.kind[by_kind], kinds), np.searchsorted(shard.kind[by_kind], kinds, side="right")
            many = high - low
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            run = by_kind[np.repeat(low, many) + nth]
            begin.append(shard.start[run] + np.repeat(a, many))
            end.append(shard.start[run] + np.repeat(b, many) + length - 1)
        change = np.zeros(len(shard.raw) + 1, dtype=np.int32)
        for where, by in ((begin, 1), (end, -1)):
            at, n = np.unique(np.concatenate(where), return_counts=True)
            change[at] += (by * n).astype(np.int32)
        gone, x = np.cumsum(change[:-1]) > 0, np.frombuffer(shard.raw, dtype=np.uint8)
        spans, kept = [], []
        for a, b in zip(shard.begin[:-1].tolist(), shard.begin[1:].tolist(), strict=True):
            mine = gone[a:b]
            if mine.any():
                edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))).tolist()
                spans.append([{"start": p, "end": q} for p, q in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(x[a:b][~mine].tobytes())
            else:
                spans.append([])
                kept.append(shard.raw[a:b])
        texts = table.column("raw").cast(pa.string())
        rest = [k.decode("utf-8", "ignore") if s else None for k, s in zip(kept, spans, strict=True)]  # null: as it was
        return scratch.tidy(pa.table({"row": table.column("row"), "text": texts, "spans": pa.array(spans, type=span_type), "kept": pa.array(kept, type=pa.binary()), "rest": pa.array(rest, type=pa.string())}))

    shards = _dealt(own, shard_bytes)
    found = []
    for turn in range(turns):
        asked = shards.mapInArrow(functools.partial(ask, turn=turn), _MESSAGE)
        found.append(scratch.write_and_read(asked.groupBy("to").applyInArrow(answer, _MESSAGE), "answers"))
        scratch.sweep(docs.sparkSession)
    answers = functools.reduce(DataFrame.unionByName, found)
    sent = shards.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(send, _MESSAGE)
    hits = scratch.write_and_read(sent.groupBy("to").applyInArrow(index, _MESSAGE), "hits")
    scratch.sweep(docs.sparkSession)
    return shards.groupBy("to").cogroup(answers.unionByName(hits).groupBy("to")).applyInArrow(cut, result)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with what `repeated_spans` keeps of each text; a character that loses some of its bytes goes whole.

    A null text stays null, and `n_chars`, if there is one, follows the text.
    """
    found = _cut(docs, id_col, text_col, length, SHARD_BYTES)
    text = F.coalesce("rest", "text")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != text_col} | {text_col: text}
    if "n_chars" in docs.columns and text_col != "n_chars":
        columns["n_chars"] = F.char_length(text).cast(dict(docs.dtypes)["n_chars"])
    return found.select(*(columns[c].alias(c) for c in docs.columns))
