"""Language identification: averaged hashed subword embeddings and a linear softmax.

The subwords of a text are its byte n-grams (orders NGRAMS) after lower-casing, with every run of other
characters than letters seen as one space; each is hashed to one of BUCKETS rows of an embedding table. A text is the mean of its
rows; a linear layer and a softmax give the languages' probabilities. Both layers are trained together by
stochastic gradient descent in numpy, over excerpts of a bounded sample of labelled rows: some PER_LANG rows of
a language (twice as many at most) and some SAMPLE in all, drawn within each language by a hash of doc_id and text,
so neither repeated nor missing ids keep a language out; rows alike in both teach once. Of each, one excerpt of at
most EXCERPT characters from a hashed place. The MAX_LANGS most frequent values of lang are learned, which bounds
what a worker holds (2^16 x languages x 4 bytes: 131 MB at 500); rows of others teach nothing and get the learned
language that they are most like, or are rejected. A tenth of the sample is kept out of training and sets the
temperature of the softmax and the score below which a prediction is rejected: the score that LOST of the right
predictions fall short of, at most MOST.

Prediction reads whole texts. As both layers are linear, a text's logits are the mean of its n-grams' own
logits, so a table of BUCKETS x languages is all that workers need (a fixed size).

Defined cases: a null text and one without letters give `und` with score 0 and are rejected; rows with a null
lang are not learned from; without any labelled row every text is `und`; repeated rows each get their own
prediction; ties go to the language first by code point; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import frugal

NGRAMS, BUCKETS, DIM = (2, 3, 4), 1 << 16, 16
PER_LANG, SAMPLE, EXCERPT, MAX_LANGS = 1500, 60_000, 1200, 500
EPOCHS, BATCH, RATE = 8, 32, 0.5
LOST, MOST = 0.0005, 0.4
#: Characters of short texts that are scored at once, and logits of n-grams held at once (of 8 languages at least):
#: neither changes a score.
PACKED, HELD = 1 << 16, 1 << 21
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
#: Odd multipliers, one per place in an n-gram.
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of all texts, and the number of n-grams of each text."""
    raw = [(" " + _OTHER.sub(" ", t.lower()) + " ").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), "u1").astype(np.uint32)
    lengths = np.array([len(r) for r in raw])
    ends = np.cumsum(lengths)
    hashes, owners = [], np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
    keys, whose = [], []
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: len(data) - n + 1] + data[n - 1 :] * _MIX[n - 1] * np.uint32(2 * n + 1) if len(data) >= n else h[:0]
        h ^= h >> np.uint32(13)
        if n in NGRAMS:
            last = ends[owners[: len(h)]]
            inside = np.arange(len(h)) + n <= last
            keys.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))[inside])
            whose.append(owners[: len(h)][inside])
    del hashes
    order = np.argsort(np.concatenate(whose), kind="stable")
    return np.concatenate(keys)[order].astype(np.int64), np.bincount(np.concatenate(whose), minlength=len(raw))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: each n-gram's logits, temperature applied
    bias: np.ndarray
    reject_below: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities, one row per text."""
        keys, n = grams(texts)
        starts = np.cumsum(n) - n
        sums = self._summed(keys, lambda rows: np.add.reduceat(rows, starts, axis=0)) if len(keys) else np.zeros((0, len(self.langs)))
        return softmax(sums / np.maximum(n, 1)[:, None] + self.bias)

    def _summed(self, keys: np.ndarray, of) -> np.ndarray:
        """Sums of the n-grams' logits, for some languages at a time."""
        some = max(8, HELD // max(1, len(keys)))
        return np.concatenate([of(self.table[:, a : a + some][keys]).astype(np.float64) for a in range(0, len(self.langs), some)], axis=-1)

    def predict(self, texts: list[str | None], batch_chars: int = 250_000) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text; at most about batch_chars characters are held as n-grams, of
        several texts about PACKED, a longer text is cut into parts whose logits are added up."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.langs:
            return out
        batch: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if not t or not _LETTER.search(t):
                continue
            if len(t) > batch_chars:
                self._settle(out, [i], self._long(t, batch_chars))
                continue
            batch.append(i)
            size += len(t)
            if size > min(PACKED, batch_chars):
                self._settle(out, batch, self.scores([texts[k] for k in batch]))
                batch, size = [], 0
        if batch:
            self._settle(out, batch, self.scores([texts[k] for k in batch]))
        return out

    def _long(self, text: str, part: int) -> np.ndarray:
        sums, n = np.zeros(len(self.langs)), 0
        for a in range(0, len(text), part):
            keys, counts = grams([text[a : a + part]])
            sums += self._summed(keys, lambda rows: rows.sum(axis=0, dtype=np.float64))
            n += int(counts[0])
        return softmax((sums / max(n, 1) + self.bias)[None, :])

    def _settle(self, out: list, at: list[int], p: np.ndarray) -> None:
        best = p.argmax(axis=1)
        for k, i in enumerate(at):
            score = float(p[k, best[k]])
            out[i] = (self.langs[best[k]], score, score < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    kinds = sorted(set(langs))
    if not kinds:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    parts = [grams(texts[a : a + 200]) for a in range(0, len(texts), 200)]
    keys, n = np.concatenate([k.astype(np.int32) for k, _ in parts]), np.concatenate([c for _, c in parts])
    del parts
    starts = np.cumsum(n) - n
    y = np.array([kinds.index(x) for x in langs])
    turn = rng.permutation(len(texts))
    held, used = turn[: len(turn) // 10], turn[len(turn) // 10 :]
    emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    out, bias = np.zeros((DIM, len(kinds)), np.float32), np.zeros(len(kinds), np.float32)
    # a language's examples weigh alike in sum
    weight = (1 / np.bincount(y, minlength=len(kinds)).clip(1))[y] * len(y) / len(kinds)
    steps, total = 0, EPOCHS * max(1, -(-len(used) // BATCH))
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for a in range(0, len(used), BATCH):
            rate = RATE * (1 - steps / total)
            steps += 1
            rows = used[a : a + BATCH]
            at = np.concatenate([keys[starts[r] : starts[r] + n[r]] for r in rows])
            sizes = n[rows]
            mean = np.add.reduceat(emb[at], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            p = softmax(mean @ out + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p = (p * weight[rows, None] / len(rows)).astype(np.float32)
            back = (p @ out.T) / sizes[:, None]
            out -= rate * 10 * (mean.T @ p).astype(np.float32)
            bias -= rate * p.sum(axis=0)
            # every n-gram of a text gets the same step: one weighted count per bucket and text
            owner = np.repeat(np.arange(len(rows)), sizes)
            pairs, times = np.unique(owner.astype(np.int64) * BUCKETS + at, return_counts=True)
            np.subtract.at(emb, pairs % BUCKETS, (rate * 10 * len(rows) * back[pairs // BUCKETS] * times[:, None]).astype(np.float32))
    table = emb @ out
    model = Model(kinds, table, bias.astype(np.float64), 0.0)
    if len(held):
        logits = np.array([table[keys[starts[r] : starts[r] + n[r]]].mean(axis=0) + bias if n[r] else bias for r in held], np.float64)
        best = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]].clip(1e-12)).mean())
        p = softmax(logits / best)
        right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
        cut = min(MOST, float(np.quantile(right, LOST))) if len(right) else 0.0
        model = Model(kinds, (table / best).astype(np.float32), bias / best, cut)
    return model


def learnable(doc_id: Column) -> Column:
    """Not in the fold that is held out: crc32 of doc_id as text, modulo 4, is not 2."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Excerpts and languages of the bounded sample."""
    rows = docs.where(learnable(docs["doc_id"]) & docs["lang"].isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return [], []
    each = min(PER_LANG, SAMPLE // len(counts))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))]), F.col("lang"))
    rows = rows.where(F.col("lang").isin(*counts) & F.col("text").isNotNull()).withColumn("th", F.xxhash64("text"))
    draw = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), n)
    pick = draw(11, F.lit(1 << 30))
    length = F.lit(EXCERPT) * (draw(13, F.lit(4)) + 1) / 4
    start = 1 + draw(12, F.greatest(F.length("text") - length.cast("int") + 1, F.lit(1)))
    chosen = rows.where(pick / (1 << 30) < share).select("lang", pick.alias("pick"), "th", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.substring("text", start.cast("int"), length.cast("int")).alias("text"))
    # some `each` rows of a language are left here, so its rank is a small window
    first = Window.partitionBy("lang").orderBy("pick", "th", "id")
    chosen = chosen.groupBy("lang", "pick", "th", "id").agg(F.min("text").alias("text")).withColumn("rank", F.row_number().over(first))
    found = chosen.where(F.col("rank") <= 2 * each).orderBy("lang", "rank").select("lang", "text").collect()
    found = [r for r in found if _LETTER.search(r["text"])]
    return [r["text"] for r in found], [r["lang"] for r in found]


def fit(docs: DataFrame) -> Model:
    return train(*sample(docs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row."""
    return predicted(docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text"), model, ["doc_id", "held_out"])


def predicted(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep`, then lang_pred, score and rejected, of rows with a text."""
    given = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            got = [g for a in range(0, len(texts), 256) for g in given.value.predict(texts.slice(a, 256).to_pylist())]
            made = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + made, [*keep, "lang_pred", "score", "rejected"])

    schema = rows.select(*[f"`{c}`" for c in keep]).schema
    return rows.mapInArrow(frugal(run), StructType([*schema.fields, *StructType.fromDDL("lang_pred string, score double, rejected boolean").fields]))
