"""Token counts of merge-type SentencePiece models by rank-synchronous merging of arrays.

The pre-tokens of many texts are held together as ragged numpy arrays of symbols. In each round every pre-token
applies its pair of lowest rank (that of the best piece that two neighbours make) at all its places at once, left
to right without overlap; pre-tokens without a pair leave the arrays, and what is counted are the symbols that are
left, a character without a piece as its bytes. Counts of pre-tokens are kept, up to KEPT of them.

All places at once give what the library gives, which takes the leftmost place alone each time, unless a piece
just made could make a pair of a rank not above its own: out of order in the vocabulary, or tied, as runs of space
marks are. Such pieces are known beforehand, and where a round really meets such a pair, only the leftmost place
of that pre-token is applied. A run of space marks beyond four times the longest piece of them goes without its
first such pieces, each of which is one token (checked against the library when the model is read).

Defined cases: null counts as the empty text, which has no tokens and no bytes; an empty table gives an empty
result; repeated rows each give their own; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal
from .sentencepieces import NORMAL, SPACE, USER_DEFINED

#: Rank of a pair that makes no piece.
NONE = np.int32(2**31 - 1)


class MergeCounter:
    KEPT, LONG, AT_ONCE = 500_000, 64, 1_000_000

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, pieces = model.normalizer_spec, model.pieces
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that don't normalise are counted here")
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or any(p.type == USER_DEFINED for p in pieces):
            raise ValueError("only merge-type models with byte fallback and without symbols of their own are counted here")
        score = {p.piece: p.score for p in pieces if p.type == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in score):
            raise ValueError("a piece goes on over a space")
        place = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        number = {p: i for i, p in enumerate(score)}
        for c in sorted({c for p in score for c in p}):
            number.setdefault(c, len(number))
        self.size = len(number)
        made = {}
        self.risky = np.zeros(self.size, bool)
        for p, s in score.items():
            for i in range(1, len(p)):
                left, right = number.get(p[:i]), number.get(p[i:])
                if left is not None and right is not None:
                    made[left * self.size + right] = (place[s], number[p])
                    for part in (p[:i], p[i:]):
                        self.risky[number[part]] |= score.get(part, np.inf) <= s
        self.pairs = np.array(sorted(made), np.int64)
        self.rank = np.array([made[k][0] for k in self.pairs.tolist()], np.int32)
        self.piece = np.array([made[k][1] for k in self.pairs.tolist()], np.int32)
        codes = np.arange(0x110000)
        self.symbol = np.full(0x110000, -1, np.int32)
        self.weight = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
                if c in score:
                    self.weight[ord(c)] = 1
        alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in score))
        self.words = re.compile(rf"{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+|[{re.escape(alone)}]" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.run = max((len(p) for p in score if not p.strip(SPACE)), default=1)
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = [len(library.encode(" " * (k - 1))) for k in range(1, 6 * self.run + 2)]
        self.cuts = all(n[k + self.run] == n[k] + 1 for k in range(2 * self.run, 5 * self.run))
        self.kept: dict[str, int] = {}

    def found(self, left, right):
        """(rank, piece) of pairs of symbols."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.piece[at], -1)

    def merged(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        sym, weight, counts = self.symbol[codes], self.weight[codes], np.zeros(len(words), np.int64)
        rank, piece = np.full(len(sym), NONE), np.full(len(sym), -1, np.int32)
        fresh = np.arange(len(sym))
        while len(sym):
            # pairs that begin at fresh places
            fresh = fresh[(fresh >= 0) & (fresh < len(sym))]
            rank[fresh], piece[fresh] = NONE, -1
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh], piece[fresh] = self.found(sym[fresh], sym[fresh + 1])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            if (low[first] == NONE).any():
                counts[owner[first]] = np.where(low[first] == NONE, np.add.reduceat(weight, first), 0)
                on = low != NONE
                sym, weight, owner, rank, piece, low = (x[on] for x in (sym, weight, owner, rank, piece, low))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            begins = np.r_[True, at[1:] != at[:-1] + 1]  # of runs of places that overlap: every second one
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))) % 2 == 0]
            at = at[~self._later(at, sym, owner, piece, low)]
            sym[at], weight[at] = piece[at], 1
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            new = np.cumsum(stays)[at] - 1
            sym, weight, owner, rank, piece = (x[stays] for x in (sym, weight, owner, rank, piece))
            fresh = np.union1d(new, new - 1)
        return counts

    def _later(self, at, sym, owner, piece, low) -> np.ndarray:
        """Places that must wait, as another of their word comes before and may make a pair that goes first."""
        waits = np.zeros(len(at), bool)
        more = np.r_[False, owner[at[1:]] == owner[at[:-1]]]
        several = more | np.r_[more[1:], False]
        asked = np.flatnonzero(several & self.risky[piece[at]])
        if len(asked):
            p, made, last = at[asked], piece[at[asked]], len(sym) - 1
            ends = [np.maximum(p - 1, 0), np.minimum(p + 2, last)]
            near = [np.where((owner[e] == owner[p]) & (e != p) & (e != p + 1), sym[e], -1) for e in ends]
            best = np.minimum.reduce([self.found(near[0], made)[0], self.found(made, near[1])[0], self.found(made, made)[0]])
            careful = np.isin(owner[at], owner[p[best <= low[p]]])
            waits = careful & more
        return waits

    def parts(self, text: str) -> Iterator[str]:
        """text cut before spaces, each part some AT_ONCE characters where it can be cut."""
        text, at = SPACE + text.replace(" ", SPACE), 0
        while at < len(text):
            cut = text.find(SPACE, at + self.AT_ONCE)
            while cut > 0 and text[cut - 1] == SPACE:
                cut = text.find(SPACE, cut + 1)
            yield text[at:] if cut < 0 else text[at:cut]
            at = len(text) if cut < 0 else cut

    def counts(self, texts) -> list[int]:
        """Tokens of each text."""
        total, held, chars = [], [], 0

        def flush():
            missing = list(dict.fromkeys(w for _, ws in held for w in ws if w not in self.kept))
            extra, asked = [0] * len(missing), missing
            if self.cuts:
                asked = []
                for k, w in enumerate(missing):
                    n = len(w) - len(w.lstrip(SPACE)) - 4 * self.run if w.startswith(SPACE * 4 * self.run) else 0
                    extra[k] = max(0, n) // self.run
                    asked.append(w[extra[k] * self.run :])
            now = {w: int(n) + x for w, n, x in zip(missing, self.merged(asked), extra)}
            for i, ws in held:
                total[i] += sum(now[w] if w in now else self.kept[w] for w in ws)
            if len(self.kept) + len(now) > self.KEPT:
                self.kept.clear()
            self.kept.update((w, n) for w, n in now.items() if len(w) <= self.LONG)
            held.clear()

        for i, text in enumerate(texts):
            total.append(0)
            for part in self.parts(text) if text else ():
                held.append((i, self.words.findall(part)))
                chars += len(part)
                if chars >= self.AT_ONCE:
                    flush()
                    chars = 0
        flush()
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def counted(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than the limit) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            n = count.counts(t.as_py() for t in batch["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text", "cast(coalesce(octet_length(text), 0) as long) as n_bytes")
    return rows.mapInArrow(frugal(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
