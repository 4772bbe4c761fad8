"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash runs over a text's bytes: h = (h << 2) + G[byte] modulo 2 ** 32, so it depends on the last 16 bytes
alone. A text is cut after every word whose hash is the lowest of some SPAN words in a row; the chunks between
cuts so follow the content, and an insertion shifts none of them but its neighbours. What is digested is each
run of whole chunks of at least WORDS words, from each cut to the first cut far enough. Two equal passages of
WORDS + 2 * SPAN words, and the few words that 16 bytes span, have such a run in common, wherever they stand.

(With single chunks as the unit, most of them short and common, the documents' lines with the first holders of
their chunks were 15 times as many, and check_l needed over 4 times its size on disk; so runs are the unit.) Digests
have 128 bits, so equal ones are taken for equal bytes.

A run found in more than one document is a repeat: the document with the smallest (doc_id, text hash) keeps
it, and the bytes that it covers in the others are duplicate spans. The keeper may itself lose a part of it to
a run that overlaps it and that an earlier document keeps; going back so from document to document, every
byte is kept in one. Repeats within one document alone are left as they are.

A run seldom ends where the repeat does, so adjoining hits are joined and each is then extended word by word as
far as its bytes equal those about the keeper's first such run. Compared are the WORDS + 2 * SPAN + 20 words on
either side: were more of them equal, they would hold a run that both have, which is a hit of its own.

Digests are counted by a partial aggregation; a bitmap of fixed size keeps back the runs that none shares, and the
others are joined back by an exchange that adaptive execution can split, so a passage that a third of all documents
share is no task's burden. What is gathered per document is at
most its own runs.

Defined cases: null, empty and short texts (under WORDS words) have no spans; a null doc_id is a document
before all others; rows alike in doc_id and text are one document; an empty table gives an empty result; other
columns are only carried by deduplicated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, drop_staged, frugal, staged

WORDS, SPAN = 24, 10
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
_GAP = b" " * 16
#: Bytes of texts, and items of lists, that a Python worker holds unpacked at a time.
SLICE, ITEMS = 1 << 20, 1 << 14


def gear(data: np.ndarray) -> np.ndarray:
    """The hash after each byte, over the 16 bytes up to it."""
    h = _GEAR[data]
    for n in (1, 2, 4, 8):  # sums over twice as many bytes each time
        h[n:] = h[n:] + (h[:-n] << np.uint32(2 * n))
    return h


def runs_of(texts: list[bytes], words: int = WORDS, span: int = SPAN) -> list[list[tuple[int, int, int]]]:
    """Of each text its runs of chunks: start, stop (in bytes) and a digest of 128 bits."""
    joined = _GAP + _GAP.join(texts) + _GAP
    data = np.frombuffer(joined, "u1")
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = gear(data)[end - 1]
    base = np.cumsum([len(_GAP)] + [len(t) + len(_GAP) for t in texts])
    first = np.searchsorted(begin, base)
    cut = np.zeros(len(begin), bool)
    if len(begin) >= span:
        low = np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(axis=1) + np.arange(len(begin) - span + 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        inside = owner[: len(low)] == owner[span - 1 :]
        cut[low[inside]] = True
    out, view, digest = [], memoryview(joined), xxhash.xxh3_128_intdigest
    for k in range(len(texts)):
        a, b = int(first[k]), int(first[k + 1])
        if b - a < words:
            out.append([])
            continue
        cuts = np.unique(np.concatenate([[a], np.flatnonzero(cut[a:b]) + a + 1, [b]]))
        last = np.searchsorted(cuts, cuts + words)
        on = np.flatnonzero(last < len(cuts))
        s, e = begin[cuts[on]], end[cuts[last[on]] - 1]
        at = int(base[k])
        out.append([(x - at, y - at, digest(view[x:y])) for x, y in zip(s.tolist(), e.tolist())])
    return out


_HALF = (1 << 64) - 1


def _runs(docs: DataFrame, words: int, span: int) -> DataFrame:
    """d1, d2 (a digest's halves), doc_id, h and place (start and stop in one number) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            first, held, size = 0, [], 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > SLICE:
                    if held:
                        yield made(batch, first, held)
                    first, held, size = i, [], 0
                if i < len(texts):
                    held.append((texts[i].as_py() or "").encode())
                    size += len(held[-1])

    def made(batch: pa.RecordBatch, first: int, texts: list[bytes]) -> pa.RecordBatch:
        found = runs_of(texts, words, span)
        take = pa.array(np.repeat(np.arange(first, first + len(texts)), [len(f) for f in found]))
        flat = [r for f in found for r in f]
        halves = [np.array([d >> by & _HALF for _, _, d in flat], np.uint64).view(np.int64) for by in (64, 0)]
        place = np.array([a << 32 | b for a, b, _ in flat], np.int64)
        return pa.RecordBatch.from_arrays([*map(pa.array, halves), batch["doc_id"].take(take), batch["h"].take(take), pa.array(place)], ["d1", "d2", "doc_id", "h", "place"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text")
    return rows.mapInArrow(frugal(run), "d1 long, d2 long, doc_id long, h long, place long")


def text_hash():
    return F.xxhash64("text")


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices whose lists in a column hold ITEMS items together, or of one row."""
    for batch in batches:
        ends = np.cumsum(batch[column].value_lengths().to_numpy(zero_copy_only=False))
        first = 0
        while first < len(batch):
            stop = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + ITEMS, "right"))
            stop = max(stop, first + 1)
            yield batch.slice(first, stop - first)
            first = stop


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def extended(left: bytes, other_left: bytes, right: bytes, other_right: bytes) -> tuple[int, int]:
    """Bytes of whole words by which a span can grow to the left and to the right, given what is about both."""
    n = _common(np.frombuffer(left, "u1")[::-1], np.frombuffer(other_left, "u1")[::-1])
    m = _common(np.frombuffer(right, "u1"), np.frombuffer(other_right, "u1"))
    return n, m


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common beginning that ends with a whole word of both."""
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    n = int(differ[0]) if len(differ) else m
    space = _SPACE[a[:n]]
    if n and not space[-1] and (n == len(a) or _SPACE[a[n]]) and (n == len(b) or _SPACE[b[n]]):
        return n
    ends = np.flatnonzero(~space[:-1] & space[1:])
    return int(ends[-1]) + 1 if len(ends) else 0


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's hits, those of one keeper joined where they adjoin in both documents."""
    for batch in slices(batches, "hits"):
        rows: list[tuple] = []
        for doc, h, hits in zip(batch["doc_id"].to_pylist(), batch["h"].to_pylist(), batch["hits"].to_pylist()):
            lines: dict[tuple, list] = {}
            for x in hits:
                start, stop = x["place"] >> 32, x["place"] & 0xFFFFFFFF
                lines.setdefault((x["first_id"], x["first_h"], (x["first_place"] >> 32) - start), []).append((start, stop))
            rows += [(doc, h, a, b, f, g, a + by, b + by) for (f, g, by), places in lines.items() for a, b in merged(places)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] * 2
        columns = zip(*rows) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "h", "start", "stop", "first_id", "first_h", "first_start", "first_stop"])


def _about(n: int):
    """The bytes of n words (or all) to the left and to the right of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "places"):
            rows: list[tuple] = []
            for doc, h, text, places in zip(batch["doc_id"], batch["h"], batch["text"], batch["places"]):
                raw = (text.as_py() or "").encode()
                edge = np.diff(np.concatenate([[True], _SPACE[np.frombuffer(raw, "u1")], [True]]).astype(np.int8))
                begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
                for x in places.as_py():
                    a, b = x["start"], x["stop"]
                    i, j = int(np.searchsorted(begin, a)), int(np.searchsorted(end, b, "right"))
                    rows.append((doc.as_py(), h.as_py(), a, b, raw[int(begin[i - n]) if i > n else 0 : a], raw[b : int(end[j + n - 1]) if j + n < len(end) else len(raw)]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "h", "start", "stop", "left", "right"])

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grown = [extended(*x) for x in zip(*(batch[c].to_pylist() for c in ("left", "first_left", "right", "first_right")))]
        start = pa.array([a - n for a, (n, _) in zip(batch["start"].to_pylist(), grown)], pa.int32())
        stop = pa.array([b + m for b, (_, m) in zip(batch["stop"].to_pylist(), grown)], pa.int32())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], start, stop, batch["first_id"]], ["doc_id", "h", "start", "stop", "first_id"])


def spans(docs: DataFrame, words: int = WORDS, span: int = SPAN) -> DataFrame:
    """doc_id, h (hash of the text), spans of each document with duplicate spans: an array of start, stop
    (bytes of the UTF-8 text) and kept_in, the ids of documents that keep what the span repeats."""
    found = staged(_runs(docs, words, span), "runs")
    whose = F.xxhash64("doc_id", "h")
    shared = found.groupBy("d1", "d2").agg(F.min(whose).alias("low"), F.max(whose).alias("high")).where("low <> high")
    shared = staged(shared.select("d1", "d2", F.struct("d1", "d2").alias("key")), "shared")
    # few runs are shared, so most leave before their shuffle
    held = staged(among(found.withColumn("key", F.struct("d1", "d2")), shared).drop("key").join(shared.drop("key").hint("merge"), ["d1", "d2"]), "held")
    drop_staged(found, shared)
    repeats = held.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "h", "place")).alias("first"))
    repeats = staged(repeats.select("d1", "d2", F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"), F.col("first.place").alias("first_place")), "repeats")
    hits = held.join(repeats, ["d1", "d2"]).where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))))
    each = hits.groupBy("doc_id", "h").agg(F.collect_set(F.struct("place", "first_id", "first_h", "first_place")).alias("hits"))
    place = "doc_id long, h long, start int, stop int"
    segments = staged(each.mapInArrow(frugal(_segments), place + ", first_id long, first_h long, first_start int, first_stop int"), "segments")
    drop_staged(held, repeats)

    firsts = ["first_id", "first_h", "first_start", "first_stop"]
    places = segments.select("doc_id", "h", "start", "stop").union(segments.select(*firsts)).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "stop")).alias("places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_h"), "text")
    about = texts.join(places.hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h"))).select("doc_id", "h", "text", "places")
    about = about.mapInArrow(frugal(_about(words + 2 * span + 20)), place + ", left binary, right binary")
    about = staged(about.dropDuplicates(["doc_id", "h", "start", "stop"]), "about")
    keeper = about.toDF(*(f"k_{c}" for c in firsts), "first_left", "first_right")
    own = about.toDF("d_id", "d_h", "d_start", "d_stop", "left", "right")
    both = segments.join(own, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("h") == F.col("d_h")) & (F.col("start") == F.col("d_start")) & (F.col("stop") == F.col("d_stop")))
    both = both.join(keeper, F.col("first_id").eqNullSafe(F.col("k_first_id")) & (F.col("first_h") == F.col("k_first_h")) & (F.col("first_start") == F.col("k_first_start")) & (F.col("first_stop") == F.col("k_first_stop")))
    both = both.select("doc_id", "h", "start", "stop", "first_id", "left", "right", "first_left", "first_right")
    each = both.mapInArrow(frugal(_extend), place + ", first_id long").groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "stop", "first_id")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hits"):
            out = []
            for hits in batch["hits"].to_pylist():
                got = merged([(x["start"], x["stop"]) for x in hits])
                out.append([{"start": a, "stop": b, "kept_in": sorted({x["first_id"] for x in hits if a <= x["start"] < b}, key=lambda f: (f is not None, f))} for a, b in got])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kept_in", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], pa.array(out, kind)], ["doc_id", "h", "spans"])

    out = staged(each.mapInArrow(frugal(run), "doc_id long, h long, spans array<struct<start: int, stop: int, kept_in: array<long>>>"), "spans")
    drop_staged(segments, about)
    return out


def duplicates(docs: DataFrame, words: int = WORDS, span: int = SPAN) -> DataFrame:
    """A row per duplicate span: doc_id, start, stop (bytes), n_bytes, kept_in (ids)."""
    rows = spans(docs, words, span).select("doc_id", F.inline("spans"))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), (F.col("stop") - F.col("start")).cast("long").alias("n_bytes"), "kept_in")


def deduplicated(docs: DataFrame, words: int = WORDS, span: int = SPAN) -> DataFrame:
    """The documents, all columns, without their duplicate spans; n_chars, where there is one, is counted anew.
    A row is carried as one column, so no column of docs meets a name of this function."""
    found = spans(docs, words, span).select(F.col("doc_id").alias("id"), "h", "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("of_id"), text_hash().alias("of_text"))
    joined = rows.join(found.hint("merge"), F.col("of_id").eqNullSafe(F.col("id")) & (F.col("of_text") == F.col("h")), "left")
    whole = F.col("row")["text"]
    raw = whole.cast("binary")
    stops = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["stop"].cast("int")))
    starts = F.concat(F.transform("spans", lambda s: s["start"].cast("int")), F.array(F.octet_length(whole).cast("int")))
    left = F.zip_with(stops, starts, lambda a, b: F.substring(raw, a + 1, b - a))
    text = F.when(F.col("spans").isNull(), whole).otherwise(F.aggregate(left, F.lit(b""), lambda acc, x: F.concat(acc, x)).cast("string"))
    out = joined.select("row", text.alias("text"), F.col("spans").isNotNull().alias("cut"))
    kinds = dict(docs.dtypes)
    counted = F.when(F.col("cut"), F.length("text").cast(kinds["n_chars"])).otherwise(F.col("row")["n_chars"]) if "n_chars" in kinds else None
    return out.select(*[F.col("text") if c == "text" else counted.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])
