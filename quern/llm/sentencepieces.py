"""Exact SentencePiece encoding of merge-type models by backtracking, and decoding.

Merging pairs of pieces by score gives the one cover of a text whose adjacent tokens are all compatible: two
tokens are compatible if merging their joined text gives the two again. So a cover is found from the left: an
Aho-Corasick automaton gives the longest token at each place; a token that doesn't fit its left neighbour
gives way to its next shorter prefix; where none fits, the last token is taken back and a bitfield marks the
place as failed, so that no place fails twice. Tokens that merging can't reach are never tried. Pieces of
equal score have no strict order of merging, on which all this rests; a word that holds one is merged directly.

No piece goes on from another character into a space mark, so texts are encoded word by word and words are
kept, up to KEPT of them.

Defined cases: null is encoded as the empty text, which has only the begin and end ids; characters without a
piece become bytes; an empty table gives an empty result; repeated rows each give their own; other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


class MergeEncoder:
    KEPT, PAIRS = 500_000, 600_000

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, pieces = model.normalizer_spec, model.pieces
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that don't normalise are encoded here")
        if model.trainer_spec.model_type != 2 or any(p.type == USER_DEFINED for p in pieces):
            raise ValueError("only merge-type models without symbols of their own are encoded here")
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.score = {p.piece: p.score for p in pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.byte = [0] * 256
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece goes on over a space")
        alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.id))
        self.words = re.compile(rf"{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+|[{re.escape(alone)}]" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        count: dict[float, int] = {}
        for p, s in self.score.items():
            if len(p) > 1:
                count[s] = count.get(s, 0) + 1
        tied = [p for p, s in self.score.items() if len(p) > 1 and count[s] > 1]
        self.tied = re.compile("|".join(map(re.escape, tied))) if tied else None
        self.reached = {p for p in self.id if len(p) == 1 or self.merged(p) == [p]}
        self.shorter: dict[str, str | None] = {}
        self.auto = ahocorasick.Automaton()
        for p in self.reached:
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.reached), None)
            self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of text by merging: highest score first, leftmost among equals."""
        parts, score = list(text), self.score
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = [(-s, i, 2) for i in range(len(parts) - 1) if (s := score.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (s := score.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p]

    def fits(self, a: str, b: str) -> bool:
        i, j = self.id.get(a), self.id.get(b)
        if i is None or j is None:  # a character without a piece
            return self.merged(a + b) == [a, b]
        got = self.pairs.get(i << 32 | j)
        if got is None:
            if len(self.pairs) > self.PAIRS:
                self.pairs.clear()
            got = self.pairs[i << 32 | j] = self.merged(a + b) == [a, b]
        return got

    def backtracked(self, text: str) -> list[str]:
        longest = [1] * len(text)
        for stop, n in self.auto.iter(text):
            if n > longest[stop + 1 - n]:
                longest[stop + 1 - n] = n
        tokens: list[str] = []
        failed, at, size = bytearray(len(text) // 8 + 1), 0, len(text)
        token: str | None = text[: longest[0]]
        while True:
            while token is not None:
                stop = at + len(token)
                if not failed[stop >> 3] >> (stop & 7) & 1 and (not tokens or self.fits(tokens[-1], token)):
                    break
                token = self.shorter.get(token)
            if token is None:
                if not tokens:
                    raise ValueError("no cover")
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= len(token)
                continue
            tokens.append(token)
            at += len(token)
            if at == size:
                return tokens
            token = text[at : at + longest[at]]

    def _word(self, word: str) -> bytes:
        parts = self.merged(word) if self.tied is not None and self.tied.search(word) else self.backtracked(word)
        ids: list[int] = []
        for p in parts:
            i = self.id.get(p)
            if i is None:
                ids += [self.byte[b] for b in p.encode()]
            else:
                ids.append(i)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids, begin and end included, as little-endian unsigned 32-bit integers."""
        edge = [self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")]
        if not text:
            return b"".join(edge)
        words, kept = self.words.findall(SPACE + text.replace(" ", SPACE)), self.kept
        got = list(map(kept.get, words))
        if None in got:
            if len(kept) > self.KEPT:
                kept.clear()
            for k, w in enumerate(words):
                if got[k] is None:
                    if (found := kept.get(w)) is None:
                        found = self._word(w)
                        if len(w) <= 64:
                            kept[w] = found
                    got[k] = found
        return edge[0] + b"".join(got) + edge[1]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch["text"]:
                ids = enc.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array<int>, begin and end included) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            ids = [enc.encode(text.as_py() or "") for text in batch["text"]]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(frugal(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array([enc.library.decode(x.as_py()) for x in batch["ids"]], pa.string())})

    return rows.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(frugal(run), "doc_id long, text string")
