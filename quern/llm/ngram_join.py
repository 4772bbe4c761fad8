"""N-gram Jaccard join by T-occurrence search.

A document's set holds the hashes of its distinct shingles (k words in a row; A-Z lower-cased; words are runs
of anything but ASCII white space; with fewer than k words the whole sequence is one shingle). Documents link
if the Jaccard similarity of their sets is at least num / den. The result is one row per document with the
smallest id reachable over links.

1. Equal sets form classes; one document stands for each.
2. The inverted index is too large for one task, so it is dealt into groups that no link crosses. For sets of a
   band of sizes, linked ones differ in at most d elements. Elements are hashed into more than d parts; so some
   part of two linked sets is equal, and they meet by its hash, in a bucket of parts that a task holds. (Parts without elements don't count; a set with
   so many of them that nothing is certain also shows those.) Sets that meet are compared by their sketches, the
   numbers of elements per bin: sets whose sketches differ by more than linked sets can are kept apart, so a
   passage that many share makes no group of all. Groups are the connected components over what is left.
3. Within a group, T-occurrence search: sets must share T elements with the query. DivideSkip's rule leaves the
   L = T / (MU log2 M + 1) longest inverted lists aside, M being the longest one's length; the short ones are
   heap-merged, and every set met there T - L times is probed for in the long ones by bisection, until it reaches
   the needed overlap or can't any more. Sets found join the query's component and leave the index, so a group of
   thousands of near copies is not compared pair by pair.

Groups of parts and of sets are dealt into cells of a bounded cost, in sketches and in elements, by
linked(): members meet those of their cell and some that are in all cells; then only those outside a group's
largest component meet all others. A group of near copies, however large, so costs in proportion to its size; no
link is lost.

Which documents' texts are dealt anew for step 3 is settled before their shuffle by a bitmap of fixed size
(8 MB), whatever the input; beyond some hundred million such documents it only lets more through.

Defined cases: rows are the documents, so rows of one id with unlike texts are told apart; null and empty texts
have no set, n_shingles 0 and link with nothing; a row without an id links, but no component is named after it
(a component of such rows alone is null); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, connected_components, drop_staged, frugal, lists, runs, staged, stars

#: Elements of sets, and sketches, that a cell's share of a group holds; bytes read at a time.
CELL, MEET, SLICE = 1 << 16, 1 << 12, 1 << 20
#: Parts that HOT of some SAMPLED classes have are hot: by the parts that a set has at most, there are few such (their
#: number has a bound that doesn't grow with the documents), so they are broadcast; what has them is dealt over SALTS buckets.
SAMPLED, HOT, SALTS = 20_000, 100, 256
#: Sets of at most so many elements have a bin or two an element in their sketch: with fewer, texts of some ten to two
#: hundred words that are merely made of the same words come together in one group, the larger the more texts there are.
FINE = 256
#: Parts to a bucket, about, and the least number of buckets.
BUCKET, BUCKETS = 1 << 20, 256
#: About how many members of a large group all its cells hold.
STAND = 16
#: DivideSkip's weight of a probe against a step of the merge.
MU = 0.0085
_HALF = (1 << 31) - 1
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240)
#: One random number per byte (upper case like lower case), and odd multipliers.
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2 ** 64."""
    back = pow(_BASE, -1, 1 << 64)
    ups, downs = np.full(n, _U(_BASE)), np.full(n, _U(back))
    ups[0] = downs[0] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a byte array. Read in slices that end at white space."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        stop = min(at + SLICE, len(data))
        if stop < len(data):
            room = np.flatnonzero(_SPACE[data[at:stop]])
            while not len(room):
                stop = min(stop + SLICE, len(data))
                room = np.flatnonzero(_SPACE[data[at:stop]])
                if stop == len(data):
                    break
            stop = at + int(room[-1]) + 1 if len(room) else stop
        part = data[at:stop]
        ups, downs = _powers(max(SLICE, 1 << (len(part) - 1).bit_length()))
        space = _SPACE[part]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate([[_U(0)], np.cumsum(_BYTE[part] * ups[: len(part)])])
        starts.append(a + at)
        hashes.append(_mix((total[b] - total[a]) * downs[a] + (b - a).astype(np.uint64)))
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode() for t in texts]
    starts, words = word_hashes(np.frombuffer(b" ".join(raw), "u1"))
    ends = np.cumsum([len(r) + 1 for r in raw])
    of = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
    n = max(0, len(words) - k + 1)
    joint = np.zeros(n, np.uint64)
    for j in range(k):
        joint += _mix(words[j : j + n] + _ODD[j]) * _ODD[k + j]
    joint = _mix(joint)
    out = []
    for a, b in zip(of, of[1:]):
        if b - a >= k:
            s = np.sort(joint[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            few = (_mix(words[a:b] + _ODD[: b - a]) * _ODD[40 : 40 + b - a]).sum(dtype=np.uint64)
            out.append(_mix(np.array([few + _U(b - a)])))
        else:
            out.append(words[:0])
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = _mix(s + _ODD[60]).sum(dtype=np.uint64), _mix(s ^ _ODD[61]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


@functools.lru_cache(maxsize=65536)
def level(k: int, num: int, den: int) -> tuple[int, int, int, int]:
    """lowest size, first size beyond, d and the number of parts of band k of sizes.

    Linked sets, the smaller of which is in the band, differ in at most d elements."""
    low = 1 if k == 0 else level(k - 1, num, den)[1]
    high = low * den // num + 1
    d = (high - 1) * (den - num) // num
    parts = d + 1
    while d and parts < 4 * d + 64:
        empty = np.exp(-low / parts)
        if parts - d - parts * empty >= 5 * np.sqrt(parts * empty * (1 - empty)) + 1:
            break
        parts += 1
    return low, high, d, parts


def band(n: int, num: int, den: int) -> int:
    k = 0
    while level(k, num, den)[1] <= n:
        k += 1
    return k


def part_hashes(sets: list[np.ndarray], num: int, den: int) -> list[np.ndarray]:
    """Of each set, the hashes of its parts, for its own band and the one below."""
    out: list[list[np.ndarray]] = [[] for _ in sets]
    sizes = np.array([len(s) for s in sets])
    bands = {n: band(n, num, den) for n in set(sizes.tolist()) if n}
    for below in (0, 1):
        at = [i for i, n in enumerate(sizes.tolist()) if n and bands[n] >= below and level(bands[n] - below, num, den)[2]]
        if not at:
            continue
        levels = [bands[int(sizes[i])] - below for i in at]
        parts = np.array([level(k, num, den)[3] for k in levels])
        elements = np.concatenate([sets[i] for i in at])
        base = np.concatenate([[0], np.cumsum(parts)])
        row = np.repeat(np.arange(len(at)), sizes[at])
        flat = base[row] + ((_mix(elements ^ _ODD[62]) >> _U(32)) * parts[row].astype(np.uint64) >> _U(32)).astype(np.int64)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, flat, _mix(elements + _ODD[63]))
        filled = np.bincount(flat, minlength=base[-1]) > 0
        which = np.arange(base[-1]) - np.repeat(base[:-1], parts)
        tag = which.astype(np.uint64) * _ODD[50] + np.repeat(np.array(levels, np.uint64), parts) * _ODD[51]
        hashes = _mix(sums + _mix(tag))
        for j, i in enumerate(at):
            a, b = base[j], base[j + 1]
            full = filled[a:b]
            sure = (b - a) - level(levels[j], num, den)[2] > (~full).sum()
            out[i].append(hashes[a:b][full] if sure else hashes[a:b])
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def n_parts(n: int, num: int, den: int) -> int:
    """Parts of a set of n elements, empty ones included."""
    k = band(n, num, den)
    return sum(parts for _, _, d, parts in (level(j, num, den) for j in (k, k - 1) if j >= 0) if d)


def sketch(s: np.ndarray) -> bytes:
    """Numbers of elements (255 at most) per bin, in some 4 to 8 elements a bin, or one or two bins an element up to
    FINE; bins follow the hash's first bits, so neighbours added up give the sketch with half as many bins."""
    bits = max(0, (2 * len(s) if len(s) <= FINE else len(s) // 4).bit_length() - 1)
    bins = (_mix(s ^ _ODD[53]) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64)
    return np.minimum(np.bincount(bins, minlength=1 << bits), 255).astype("u1").tobytes()


class Sketches:
    """Sets that share a part, by size and sketch: search gives those that may link."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes], num: int, den: int):
        lengths = [len(s) for s in sketches]
        bins = min(lengths)
        flat = np.frombuffer(b"".join(sketches), "u1")
        if max(lengths) == bins:
            self.counts = flat.reshape(len(sketches), bins).astype(np.int16)
        else:
            # a larger sketch's neighbouring bins are added up
            sums = np.add.reduceat(flat, np.concatenate([base + np.arange(0, n, n // bins) for base, n in zip(np.cumsum([0, *lengths[:-1]]), lengths)]), dtype=np.int64)
            self.counts = np.minimum(sums, 255).astype(np.int16).reshape(len(sketches), bins)
        self.sizes, self.num, self.den = sizes, num, den
        self.live = np.ones(len(sizes), bool)

    def remove(self, some: np.ndarray | int) -> None:
        self.live[some] = False

    def search(self, q: int) -> np.ndarray:
        on = np.flatnonzero(self.live)
        total = self.sizes[q] + self.sizes[on]
        most = total - 2 * -(-self.num * total // (self.num + self.den))
        return on[(np.abs(self.counts[on] - self.counts[q]).sum(axis=1) <= most) & (on != q)]


class Index:
    """T-occurrence search over sets (sorted arrays of small ints), with DivideSkip."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([0, *map(len, sets)])
        self.sets = [np.sort(flat[a:b]) for a, b in zip(ends, ends[1:])]
        self.sizes = np.diff(ends)
        self.num, self.den = num, den
        self.live = np.ones(len(sets), bool)
        self._build()

    def _build(self) -> None:
        on = np.flatnonzero(self.live)
        self.held = len(on)
        elements = np.concatenate([self.sets[i] for i in on]) if len(on) else np.zeros(0, np.int64)
        owner = np.repeat(on, self.sizes[on])
        order = np.argsort(elements, kind="stable")
        self.postings = owner[order]
        top = max((int(s[-1]) for s in self.sets), default=-1) + 2
        self.first = np.searchsorted(elements[order], np.arange(top))

    def remove(self, some: np.ndarray | int) -> None:
        self.live[some] = False
        if self.live.sum() * 2 < self.held:
            self._build()

    def needed(self, n: int, sizes: np.ndarray) -> np.ndarray:
        """Overlap at which sets of such sizes link with one of size n."""
        total = self.num * (n + sizes)
        return -(-total // (self.num + self.den))

    def search(self, q: int) -> np.ndarray:
        """Live sets that link with set q, other than itself."""
        query, n = self.sets[q], int(self.sizes[q])
        least = -(-self.num * n // self.den)
        length = self.first[query + 1] - self.first[query]
        order = np.argsort(length, kind="stable")
        aside = min(least - 1, int(least / (MU * np.log2(max(2, int(length.max()))) + 1)))
        short, long = query[order[: n - aside]], query[order[n - aside :]]
        found, seen = self._merge([self.postings[self.first[e] : self.first[e + 1]] for e in short])
        sizes = self.sizes[found]
        need = self.needed(n, sizes)
        fits = self.live[found] & (found != q) & (sizes * self.den >= self.num * n) & (n * self.den >= self.num * sizes) & (seen + aside >= need)
        found, seen, need = found[fits], seen[fits], need[fits]
        done = [found[seen >= need]]
        found, seen, need = (x[seen < need] for x in (found, seen, need))
        for k, e in enumerate(long):
            if not len(found):
                break
            row = self.postings[self.first[e] : self.first[e + 1]]
            if len(row):
                at = np.searchsorted(row, found)
                seen = seen + (row[np.minimum(at, len(row) - 1)] == found)
            if k % 16 == 15 or k == len(long) - 1:
                reached = seen >= need
                done.append(found[reached])
                keep = ~reached & (seen + (len(long) - 1 - k) >= need)
                found, seen, need = found[keep], seen[keep], need[keep]
        return np.concatenate(done)

    @staticmethod
    def _merge(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sets met in the sorted lists, rising, and in how many, by a heap of the lists' heads."""
        out: list[int] = []
        times: list[int] = []
        last = -1
        for i in heapq.merge(*[r.tolist() for r in rows if len(r)]):
            if i == last:
                times[-1] += 1
            else:
                out.append(i)
                times.append(1)
                last = i
        return np.array(out, np.int64), np.array(times, np.int64)


def spread(index: Index | Sketches, role: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Rows and what is linked with each, by searches from the rows of role QUERY. What a search finds among these
    joins its component and leaves the index; other rows stay, and of the rows of role SETTLED, which are known to
    be in one component, the first one found will do."""
    asks, seeds, found_of = role == QUERY, [], []
    waiting = asks.copy()
    for seed in np.flatnonzero(asks).tolist():
        if not waiting[seed]:
            continue
        index.remove(seed)
        open_rows, settled = [seed], False
        while open_rows:
            row = open_rows.pop()
            found = index.search(row)
            if not len(found):
                continue
            mine = found[asks[found]]
            if len(mine):
                index.remove(mine)
                waiting[mine] = False
                open_rows += mine.tolist()
            if len(mine) < len(found):
                known = found[role[found] == SETTLED][: 0 if settled else 1]
                settled |= len(known) > 0
                found = np.concatenate([mine, found[role[found] == TARGET], known])
            if len(found):
                seeds.append(seed)
                found_of.append(found)
    return seeds, found_of


QUERY, TARGET, SETTLED = 2, 1, 0


def _texts(column: pa.Array, step: int = 4 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a text column of about `step` characters."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(column):
        texts.append(t.as_py())
        size += len(texts[-1] or "")
        if size > step:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


PLAIN, WARM, NAMES = 0, 1, 2


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of `values` between the ends."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def bundles(parts: list[np.ndarray], names: list[tuple[int, int]], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The parts of some sets as a row for each bucket, which the first 32 bits of a part's hash choose: the other 32
    bits (`a`) and the sets' places as steps from one to the next (`b`). A set's number is `base`, a hash of all names,
    plus its place. Hot parts are apart, with all their bits; so are the names."""
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    h1, h2 = (np.array([n[i] for n in names], np.int64) for i in (0, 1))
    base = _mix(h1.view(np.uint64) + np.arange(len(h1), dtype=np.uint64) * _ODD[52]).sum(dtype=np.uint64).astype(np.int64)

    def made(bucket: np.ndarray, kind: int, a: pa.Array, b: pa.Array) -> pa.RecordBatch:
        n = len(bucket)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, base)), a, b], ["bucket", "kind", "base", "a", "b"])

    def steps(places: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Places rise from end to end."""
        by = np.diff(places, prepend=0)
        by[ends[:-1]] = places[ends[:-1]]
        return _bytes(by.astype(np.min_scalar_type(int(by.max()))), ends)

    if len(h1):
        own = np.array([int(base) % SALTS])
        yield made(buckets + own, NAMES, _bytes(h1, np.array([0, len(h1)])), _bytes((h2 & _HALF).astype(np.int32), np.array([0, len(h2)])))
    warm = np.isin(flat, hot) if len(hot) else np.zeros(len(flat), bool)
    if warm.any():
        yield made(buckets + own, WARM, _bytes(flat[warm], np.array([0, warm.sum()])), steps(owner[warm], np.array([0, warm.sum()])))
    flat, owner = flat[~warm], owner[~warm]
    if len(flat):
        bucket = ((flat >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        ends = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        yield made(bucket[ends[:-1]], PLAIN, _bytes(flat[order].astype(np.uint32), ends), steps(owner[order], ends))


def meetings(rows: pa.Table) -> pa.RecordBatch:
    """part and `at` (a set's number) where sets of a bucket have a part in common, or it is hot; at, h1 and half of
    names. Of a part here are the 32 bits besides its bucket's: parts seldom alike in these alone cost a comparison."""
    none = lambda n, kind: pa.nulls(n, kind)
    if rows["kind"][0].as_py() == NAMES:
        h1 = np.concatenate([np.frombuffer(x, np.int64) for x in rows["a"].to_pylist()])
        half = np.concatenate([np.frombuffer(x, np.int32) for x in rows["b"].to_pylist()])
        at = np.concatenate([np.arange(len(x) // 8) + b for x, b in zip(rows["a"].to_pylist(), rows["base"].to_numpy())])
        return pa.RecordBatch.from_arrays([none(len(at), pa.int64()), pa.array(at), pa.array(h1), pa.array(half)], MEETINGS)
    warm = rows["kind"][0].as_py() == WARM
    parts, at = [], []
    for base, a, b in zip(rows["base"].to_numpy(), rows["a"].to_pylist(), rows["b"].to_pylist()):
        parts.append(np.frombuffer(a, np.uint64 if warm else np.uint32))
        at.append(np.cumsum(np.frombuffer(b, f"u{len(b) // len(parts[-1])}"), dtype=np.int64) + base)
    part, at = np.concatenate(parts), np.concatenate(at)
    if not warm:
        sort = np.sort((part.astype(np.uint64) << _U(32)) | np.arange(len(part), dtype=np.uint64))
        alike = (sort[1:] >> _U(32)) == (sort[:-1] >> _U(32))
        sort = sort[np.concatenate([alike, [False]]) | np.concatenate([[False], alike])]
        at = at[(sort & _U((1 << 32) - 1)).astype(np.int64)]
        part = (sort >> _U(32)) | _U(rows["bucket"][0].as_py() << 32)
    return pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(at), none(len(at), pa.int64()), none(len(at), pa.int32())], MEETINGS)


MEETINGS = ["part", "at", "h1", "half"]


def _met(docs: DataFrame, k: int, num: int, den: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """part and `at` of sets that share it with others; at, h1 and half (95 bits of its name) of every set. What is
    shuffled is some 5 bytes a part, whatever the number of tasks; a bucket is what a task holds."""
    given = docs.sparkSession.sparkContext.broadcast(hot)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _texts(batch["text"]):
                sets = [s for s in shingle_sets(texts, k) if len(s)]
                yield from bundles(part_hashes(sets, num, den), [identity(s) for s in sets], given.value, buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, ("bucket", "kind", "own")):
            yield meetings(rows)

    packed = docs.select("text").mapInArrow(frugal(pack), "bucket int, kind int, base long, a binary, b binary")
    # hot parts and names need no others of their bucket, so each row is a run of its own
    packed = packed.withColumn("own", F.when(F.col("kind") != PLAIN, F.col("base")).otherwise(0))
    return packed.repartition("bucket").sortWithinPartitions("bucket", "kind", "own").mapInArrow(frugal(meet), "part long, at long, h1 long, half int")


CELLS = ("grp", "a", "j")


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], pa.Table]]:
    """Rows of whole cells, many at a time, and where the cells start and end. Rows are sorted, so a batch's last
    cell may go on in the next; it alone is held."""
    held: list[pa.RecordBatch] = []

    def borders(rows) -> np.ndarray:
        keys = [rows[c].to_numpy() for c in CELLS]
        return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1

    def made(parts: list[pa.RecordBatch]) -> tuple[list[int], pa.Table]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        return [0, *borders(rows).tolist(), len(rows)], rows

    for batch in batches:
        if not len(batch):
            continue
        if held and any(held[-1][c][0].as_py() != batch[c][0].as_py() for c in CELLS):
            yield made(held)
            held = []
        if len(found := borders(batch)):
            yield made([*held, batch.slice(0, int(found[-1]))])
            held = [batch.slice(int(found[-1]))]
        else:
            held.append(batch)
    if held:
        yield made(held)


def _searched(rows: DataFrame, read, index_of) -> DataFrame:
    """Edges (a, b) that join the members of each cell which searches link: rows with CELLS, role, cid and what
    read(table) takes; index_of(read, rows of a cell) is the index. A member that comes twice counts once, as a
    query if it is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, table in packed(batches):
            cid, role, held = table["cid"].to_numpy(), table["role"].to_numpy(), read(table)
            ends, out = [], []
            fresh = np.concatenate([[True], cid[1:] != cid[:-1]])
            for x, y in zip(at, at[1:]):
                if y - x < 2:
                    continue
                on = np.arange(x, y) if fresh[x + 1 : y].all() else x + np.flatnonzero(np.concatenate([[True], fresh[x + 1 : y]]))
                if len(on) < 2:
                    continue
                seeds, found = spread(index_of(held, on), role[on])
                ends += [(cid[on[s]], len(f)) for s, f in zip(seeds, found)]
                out += [cid[on[f]] for f in found]
            if out:
                a, b = stars(np.repeat(np.array([e for e, _ in ends]), [n for _, n in ends]), np.concatenate(out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    order = [*CELLS, "cid", F.desc("role")]
    return rows.repartition(*CELLS).sortWithinPartitions(*order).mapInArrow(frugal(run), "a long, b long")


def linked(rows: DataFrame, costs: DataFrame, most: int, read, index_of, name: str) -> DataFrame:
    """Edges (a, b), staged, that connect all members (cid) of a group (grp) that searches link, whatever its size.

    rows: grp, cid, cost and what `read` takes; costs: grp and cost of each member. A group whose costs exceed `most`
    is dealt into cells of about that much. Each of its members goes to one cell, and some STAND members, the same
    ones, to all: like members of different cells meet by them. Whatever is not in its group's largest component
    then goes to cells with every other member."""
    pieces = lambda total, n: F.greatest(F.lit(1), F.least(n, F.ceil(total / most))).cast("int")
    none, query = F.lit(0).cast("int"), F.lit(QUERY).cast("int")
    cell = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "cid"), n).cast("int")
    every = lambda n: F.sequence(none, n - 1)
    groups = costs.groupBy("grp").agg(F.sum("cost").alias("total"), F.count("*").alias("members")).where((F.col("total") > most) & (F.col("members") > 1))
    groups = staged(groups.select("grp", "members", pieces(F.col("total"), F.col("members")).alias("cells")), name)
    if groups.isEmpty():
        drop_staged(groups)
        return staged(_searched(rows.withColumns({"a": none, "j": none, "role": query}).drop("cost"), read, index_of), name)
    dealt = rows.join(groups, "grp", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    stands = (F.col("cells") > 1) & (F.pmod(F.xxhash64(F.lit(2), "cid"), F.col("members")) < STAND)
    placed = dealt.withColumn("j", F.explode(F.when(stands, every(F.col("cells"))).otherwise(F.array(cell(1, F.col("cells"))))))
    edges = staged(_searched(placed.withColumns({"a": none, "role": query}).drop("cells", "members", "cost"), read, index_of), name)
    large = staged(dealt.where("cells > 1").drop("members"), name)
    found = connected_components(edges.join(large.select(F.col("cid").alias("a")).distinct(), "a", "left_semi"), name)
    of = staged(large.select("grp", "cid", "cost").join(found, F.col("cid") == F.col("node"), "left").select("grp", "cid", "cost", F.coalesce("component", "cid").alias("component")), name)
    largest = of.groupBy("grp", "component").agg(F.sum("cost").alias("n")).groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    marked = staged(of.join(largest, "grp").select("grp", "cid", "cost", (F.col("component") != F.col("largest")).alias("apart")), name)
    parts = marked.where("apart").groupBy("grp").agg(F.sum("cost").alias("total"), F.count("*").alias("n")).select("grp", pieces(F.col("total"), F.col("n")).alias("parts"))
    given = large.drop("cost").join(marked.drop("cost"), ["grp", "cid"]).join(parts, "grp")
    queries = given.where("apart").select("*", F.explode(every(F.col("cells"))).alias("j")).withColumns({"a": cell(3, F.col("parts")), "role": query})
    targets = given.select("*", F.explode(every(F.col("parts"))).alias("a")).withColumns({"j": cell(1, F.col("cells")), "role": F.col("apart").cast("int")})
    out = staged(edges.unionByName(_searched(queries.unionByName(targets).drop("cells", "parts", "apart"), read, index_of)), name)
    drop_staged(groups, large, edges, found, of, marked)
    return out


def identified(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, h1, h2 and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _texts(batch["text"]):
                sets = shingle_sets(texts, k)
                names = [identity(s) for s in sets]
                given = [batch[c].slice(a, len(texts)) for c in ("doc_id", "th")]
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(given + made, ["doc_id", "th", "n_shingles", "h1", "h2", "sketch"])

    return _keyed(docs).mapInArrow(frugal(run), "doc_id long, th long, n_shingles long, h1 long, h2 long, sketch binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].alias("text"))


def _parts(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """h1, half (95 bits of a set's name) and the hashes of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _texts(batch["text"]):
                sets = [s for s in shingle_sets(texts, k) if len(s)]
                found, names = part_hashes(sets, num, den), [identity(s) for s in sets]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in names], pa.int64()), pa.array([y & _HALF for _, y in names], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["h1", "half", "parts"])

    return docs.select("text").mapInArrow(frugal(run), "h1 long, half int, parts array<long>").select("h1", "half", F.explode("parts").alias("part"))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """cid, grp, cost and elements of rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, some in _texts(batch["text"]):
                sets = shingle_sets(some, k)
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                flat = np.concatenate(sets).view(np.int64)
                kept = [batch[c].slice(a, len(some)) for c in ("cid", "grp")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cid", "grp", "cost", "elements"])

    return texts.select("cid", "grp", "text").mapInArrow(frugal(run), "cid long, grp long, cost long, elements array<long>")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    return joined(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def joined(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The same, th (the xxhash64 of the text) and `component`, a number that rows of one component share (null
    without words)."""
    rows = staged(identified(docs, k), "sets")
    name = ["h1", "h2", "n_shingles"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    classes = rows.where("n_shingles > 0").groupBy(*name).agg(first, F.first("sketch").alias("sketch")).select(*name, "first.doc_id", "first.th", "sketch")
    # a class's own number; it is settled once it is written
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # parts are made of (nearly) one document of each class and dealt into buckets, where the sets that share one are
    # found; parts that many classes share, as near copies do, are known to meet
    half = F.expr(f"cast(h2 & {_HALF} as int)").alias("half")
    of_class = F.struct("doc_id", "th").alias("key")
    shown = among(_keyed(docs).withColumn("key", of_class), classes.select(of_class))
    size = F.when(F.col("n_shingles") < 256, F.col("n_shingles")).otherwise(256 + F.ceil(4 * F.log("n_shingles")))
    sizes = classes.groupBy(size).agg(F.max("n_shingles").alias("most"), F.count("*").alias("n")).collect()
    share = min(1.0, SAMPLED / max(1, sum(r["n"] for r in sizes)))
    buckets = max(BUCKETS, sum(r["n"] * n_parts(r["most"], num, den) for r in sizes) // BUCKET)
    some = shown.where(F.pmod(F.xxhash64(F.lit(5), "doc_id", "th"), F.lit(1 << 30)) < int(share * (1 << 30)))
    hot = _parts(some, k, num, den).groupBy("part").agg(F.count("*").alias("n"), F.min("h1").alias("low"), F.max("h1").alias("high")).where(f"n >= {HOT} and low <> high")
    hot = staged(hot.select("part"), "hot")
    parts = np.sort(hot.toArrow()["part"].to_numpy().view(np.uint64))
    found = staged(_met(shown, k, num, den, parts, buckets), "met")
    drop_staged(hot)
    met, names = found.where("part is not null").select("part", "at"), found.where("part is null").select("at", "h1", "half")
    one = F.lit(1).cast("long").alias("cost")
    known = names.distinct().join(classes.select("h1", half, F.col("n_shingles").cast("int").alias("n"), "sketch", "cid"), ["h1", "half"])
    sketched = met.join(known, "at").select(F.col("part").alias("grp"), "cid", one, "n", "sketch")

    def sketches(table: pa.Table) -> tuple:
        return table["n"].to_numpy().astype(np.int64), table["sketch"].to_pylist()

    def by_sketch(held: tuple, on: np.ndarray) -> Sketches:
        return Sketches(held[0][on], [held[1][i] for i in on.tolist()], num, den)

    edges = linked(sketched, met.select(F.col("part").alias("grp"), one), MEET, sketches, by_sketch, "meeting")
    drop_staged(found)
    whole = connected_components(edges, "blocks")
    drop_staged(edges)
    blocks = staged(whole.select(F.col("node").alias("cid"), F.col("component").alias("grp")).union(whole.select("component", "component")).distinct(), "blocks")
    drop_staged(whole)
    key = F.struct("doc_id", "th").alias("key")
    active = staged(classes.join(blocks, "cid").select("cid", "grp", "doc_id", "th", key), "active")
    texts = among(_keyed(docs).withColumn("key", F.struct("doc_id", "th")), active).groupBy("doc_id", "th").agg(F.first("text").alias("text")).toDF("of_id", "of_th", "text")
    sets = staged(_sets(texts.join(active.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th"))), k), "elements")

    def of_sets(table: pa.Table) -> list[np.ndarray]:
        return lists(table["elements"])

    def by_element(held: list[np.ndarray], on: np.ndarray) -> Index:
        return Index([held[i].view(np.uint64) for i in on.tolist()], num, den)

    links = linked(sets, sets.select("grp", "cost"), CELL, of_sets, by_element, "links")
    drop_staged(blocks, active, sets)
    found = connected_components(links, "links")
    drop_staged(links)
    placed = classes.join(found, F.col("cid") == F.col("node"), "left").select(*name, "doc_id", F.coalesce("component", "cid").alias("component"))
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = staged(placed.drop("doc_id").join(names, "component"), "named")
    drop_staged(found, classes)
    return rows.drop("sketch").join(named, name, "left").select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")
