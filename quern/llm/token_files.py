"""Token-ID files of directly addressable codes.

An id is cut into chunks of `WIDTH` bits, lowest first. Level k holds chunk k of every id that has one; a
bitmap beside it says which of them go on to level k + 1, and a rank directory holds the number of set bits
before each block of BLOCK_BITS bits. Any token is read by one chunk, one bit and one rank per level; nothing
is decoded in blocks. A document index gives the first token of each document.

Corpus order is ascending doc_id (null first; equal ids by a hash of the text). Rows are range-partitioned
once; a task encodes its partition into files of about FILE_TOKENS tokens (more only where one document has
more), so what it holds doesn't grow with the partition. A file is written under a name of its attempt and then
renamed, so a task that runs twice leaves the same files. The driver gathers one row per file, for the files'
offsets.

Defined cases: null is encoded as the empty text; every document ends with `end_id`, so even an empty one has
a token; special-token strings in a text get what the tokenizer gives them; repeated rows are written as
often as they come; an empty table writes no file and reads as no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, remote, write_once

MAGIC = b"QDAC0001"
WIDTH, BLOCK_BITS = 8, 512
FILE_TOKENS = 8_000_000
_HEAD = struct.Struct("<8sQQQ")


class DacWriter:
    """Bytes of a file with the ids of some documents."""

    @staticmethod
    def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> list[bytes]:
        rest, levels = ids.astype("<u4"), []
        while True:
            more = rest >= 1 << WIDTH
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), "u1")])
            ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK_BITS // 8), dtype="<u8") if len(bits) else np.zeros(0, "<u8")
            ranks = np.concatenate([[0], np.cumsum(ones, dtype="<u8")]).astype("<u8")
            levels.append(((rest & ((1 << WIDTH) - 1)).astype("u1"), bits, ranks))
            rest = rest[more] >> WIDTH
            if not len(rest):
                break
        out = [_HEAD.pack(MAGIC, len(ids), len(doc_ids), len(levels))]
        out += [np.array([len(part) for level in levels for part in level], "<u8").tobytes()]
        out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.asarray(ends, "<u8").tobytes()]
        return out + [part.tobytes() for level in levels for part in level]


class DacFile:
    """Reads a file's bytes; token(i) and tokens(a, b) address tokens directly."""

    def __init__(self, data: bytes | memoryview):
        magic, self.n, self.docs, levels = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        sizes = take("<u8", 3 * levels).tolist()
        self.doc_ids, self.null, self.ends = take("<i8", self.docs), take("u1", self.docs), take("<u8", self.docs)
        self.levels = [(take("u1", sizes[3 * k]), take("u1", sizes[3 * k + 1]), take("<u8", sizes[3 * k + 2])) for k in range(levels)]

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block, step = i // BLOCK_BITS, BLOCK_BITS // 8
        whole = bits[block * step : i // 8]
        return int(ranks[block]) + int(np.bitwise_count(whole).sum()) + (int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + WIDTH
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        return self._range(0, a, b)

    def _range(self, k: int, a: int, b: int) -> np.ndarray:
        chunks, bits, ranks = self.levels[k]
        out = chunks[a:b].astype("<u4")
        on = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].view(bool)
        if on.any():
            first = self._rank(bits, ranks, a)
            out[on] |= self._range(k + 1, first, first + int(on.sum())) << WIDTH
        return out

    def doc(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    Such a tokenizer never merges over the start of a run of non-space characters and the one space before
    it, so a text is cut there and what the library gives for a piece is kept. Words not seen yet are encoded
    together. A text with a character outside the plain set, whose white space the library's pattern and ours
    might see differently, or with a special token's string, goes to the library whole. A new encoder compares
    both ways on a sample and takes only the library's if they differ."""

    PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞€、-ヿ一-鿿Ͱ-ԯ]")
    KEPT = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.line = self.tokenizer.token_to_id("Ċ")  # the byte-level spelling of a line end
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")  # the byte-level spelling of a space
        probe = "It's a probe,  with\n\nruns \t of space (and 12'345 figures) -- d'été.\n x"
        plain = "It's a probe, with\nlines (and 12'345 figures) -- d'été.\nx"
        self.cut = self.line is not None and self._pieces(probe) == self._whole(probe) and self._by_words(plain) == self._whole(plain)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, new: list[str]) -> None:
        """Keeps the ids of words after a space or, where marked so, after a line end. Each kind is encoded as
        one text: a token that starts with a space, or is a line end, then starts a word."""
        for mark, some in ((" ", [w for w in new if w[0] != "\0"]), ("\n", [w for w in new if w[0] == "\0"])):
            if not some:
                continue
            texts = [mark + w.removeprefix("\0") for w in some]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.opens[ids] if mark == " " else ids == self.line)
            if len(at) != len(some):
                self.words.update((w, self._whole(t)) for w, t in zip(some, texts))
                continue
            raw, at = ids.tobytes(), [*(at * 4).tolist(), 4 * len(ids)]
            for k, w in enumerate(some):
                self.words[w] = raw[at[k] : at[k + 1]]

    def _by_words(self, text: str) -> bytes:
        """For texts whose white space is single spaces and line ends between words."""
        pieces = ("\n" + text).replace("\n", " \0").split(" ")[1:]
        got = list(map(self.words.get, pieces))
        if None in got:
            at = [i for i, g in enumerate(got) if g is None]
            if len(self.words) > self.KEPT:
                self.words.clear()
            self._learn_words(list({pieces[i] for i in at}))
            for i in at:
                got[i] = self.words[pieces[i]]
        return b"".join(got)[4:]

    def _pieces(self, text: str) -> bytes:
        """For texts with other white space."""
        pieces, kept = self.PIECE.findall(text), self.kept
        for p in set(pieces):
            if p not in kept:
                if len(kept) > self.KEPT // 4:
                    kept.clear()
                    return self._whole(text)
                kept[p] = self._whole(p)
        return b"".join(map(kept.__getitem__, pieces))

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.cut or self.PLAIN.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        spaced = "\n" + text + "\n"
        if any(x in spaced for x in ("  ", " \n", "\n ", "\n\n", "\t", "\r")):
            return self._pieces(text)
        return self._by_words(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, out: str | None = None, file_tokens: int = FILE_TOKENS) -> tuple[str, list[tuple[str, int, int]]]:
    """Writes the files; their folder, and (name, documents, tokens) of each in corpus order."""
    out = out or new_dir(docs.sparkSession, "tokens")
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, n = encoder(tokenizer), TaskContext.get().partitionId(), 0
        fs, folder = remote(out)

        def put(ids: bytearray, doc_ids: list[int | None], lengths: list[int]) -> pa.RecordBatch:
            fs.create_dir(folder, recursive=True)
            name = f"{part:07d}-{n:05d}.dac"
            write_once(fs, f"{folder}/{name}", lambda f: [f.write(x) for x in DacWriter.pack(np.frombuffer(ids, "<u4"), doc_ids, np.cumsum(lengths))])
            return pa.RecordBatch.from_pydict({"name": [name], "docs": [len(doc_ids)], "tokens": [len(ids) // 4]})

        ids, doc_ids, lengths = bytearray(), [], []
        for batch in batches:
            for d, text in zip(batch["doc_id"], batch["text"]):
                got = enc(text.as_py() or "")
                if doc_ids and (len(ids) + len(got)) // 4 >= file_tokens:
                    yield put(ids, doc_ids, lengths)
                    ids, doc_ids, lengths, n = bytearray(), [], [], n + 1
                ids += got
                ids += end
                doc_ids.append(d.as_py())
                lengths.append(len(got) // 4 + 1)
        if doc_ids:
            yield put(ids, doc_ids, lengths)
        pa.default_memory_pool().release_unused()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = ordered.mapInArrow(encode, "name string, docs long, tokens long").collect()
    return out, sorted((f["name"], f["docs"], f["tokens"]) for f in files)


def read(spark: SparkSession, out: str, files: list[tuple[str, int, int]], digest: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (or, without digest, ids) of each document in the files."""
    base, rows = 0, []
    for name, _, tokens in files:
        rows.append((name, base))
        base += tokens

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = remote(out)
        for batch in batches:
            for name, first in zip(batch["name"].to_pylist(), batch["base"].to_pylist()):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    dac = DacFile(f.read())
                for a in range(0, dac.docs, 2000):
                    ks = range(a, min(a + 2000, dac.docs))
                    starts = [int(dac.ends[k - 1]) if k else 0 for k in ks]
                    ids, first_id = dac.tokens(starts[0], int(dac.ends[ks[-1]])), starts[0]
                    found = [ids[s - first_id : int(dac.ends[k]) - first_id] for k, s in zip(ks, starts)]
                    last = pa.array([zlib.crc32(x) for x in found], pa.int64()) if digest else pa.array([x.tolist() for x in found], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(dac.doc_ids[a : a + 2000], mask=dac.null[a : a + 2000].astype(bool)), pa.array([first + s for s in starts]), pa.array([len(x) for x in found], pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    plan = spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)))
    return plan.mapInArrow(decode, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))
