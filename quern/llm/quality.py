"""Quality by compression: zstandard dictionaries of good and of bad labelled texts.

A text is cut into chunks of CHUNK bytes; each is compressed with either dictionary. The sums of the sizes,
c_good and c_bad, give the difference normalised by the text's own size, (c_bad - c_good) / (bytes + SHORT),
which a logistic regression, fitted on labelled texts that the dictionaries haven't seen, turns into a score:
the probability of label 1. The regression also sees how short a text is, since the shortest say nothing by
their difference. (Normalised by c_good + c_bad, texts that only repeat themselves,
which either dictionary compresses to little, would be judged by their first words.) Chunks keep the dictionaries' pull on long texts; whole texts are read.

Learning reads at most about PER_LABEL labelled rows of either label, chosen by a hash of doc_id, one excerpt
of at most EXCERPT characters from a hashed place of each: odd hashes for the dictionaries, even ones for
the calibration.

Defined cases: a null or empty text has difference 0 and gets the score of that; without rows of both labels
the score is the share of label 1, or 0.5 without any; a row labelled twice counts twice; repeated rows each
get their own score; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out, learnable

PER_LABEL, EXCERPT = 3000, 4000
CHUNK, DICTIONARY, LEVEL, SHORT, BRIEF = 512, 64 * 1024, 3, 16, 64
LIMIT = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    brief: float
    offset: float

    def difference(self, text: str | None) -> float:
        data = memoryview((text or "").encode())
        if not data or not self.good:
            return 0.0
        good, bad = _compressors(self)
        c_good = c_bad = 0
        for a in range(0, len(data), CHUNK):
            c_good += len(good(data[a : a + CHUNK]))
            c_bad += len(bad(data[a : a + CHUNK]))
        return (c_bad - c_good) / (len(data) + SHORT)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.brief * shortness(text) + self.offset, -50, 50))))


@functools.lru_cache(maxsize=4)
def _compressors(model: Model):
    import zstandard

    made = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
    return made


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or, of too little text to train one, its raw content."""
    import zstandard

    chunks = [raw[a : a + CHUNK] for t in texts for raw in [t.encode()] for a in range(0, len(raw), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, chunks, k=512, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" " + b"".join(chunks)[-DICTIONARY:]


def shortness(text: str | None) -> float:
    return BRIEF / (BRIEF + len((text or "").encode()))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of the columns of x, then the offset, by Newton's method, held by a small ridge."""
    scale = np.append(np.abs(x).max(axis=0).clip(1e-9), 1.0)
    m, w = np.column_stack([x, np.ones(len(x))]) / scale, np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -50, 50)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(len(w)), m.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def train(rows: list[tuple[str, int, bool]]) -> Model:
    """rows: text, label and whether the row is for the dictionaries."""
    labels = [y for _, y, _ in rows]
    fit = {y: [t for t, label, first in rows if label == y and first and t] for y in (0, 1)}
    rest = [(t, y) for t, y, first in rows if not first]
    if not fit[0] or not fit[1] or len({y for _, y in rest}) < 2:
        share = min(0.99, max(0.01, sum(labels) / len(labels))) if labels else 0.5
        return Model(b"", b"", 0.0, 0.0, float(np.log(share / (1 - share))))
    raw = Model(dictionary(fit[1]), dictionary(fit[0]), 1.0, 0.0, 0.0)
    seen = np.array([(raw.difference(t), shortness(t)) for t, _ in rest])
    return Model(raw.good, raw.bad, *logistic(seen, np.array([float(y) for _, y in rest])).tolist())


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int, bool]]:
    known = labels.where(learnable(labels["doc_id"]) & labels["quality"].isin(0, 1)).select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, PER_LABEL / n))]), F.col("y"))
    pick = F.pmod(F.xxhash64(F.lit(21), "id"), F.lit(1 << 30)) / (1 << 30)
    chosen = known.where(pick < share).orderBy("id", "y").limit(4 * PER_LABEL)  # about 2 x PER_LABEL rows, that many at most
    start = 1 + F.pmod(F.xxhash64(F.lit(22), "id"), F.greatest(F.length("text") - EXCERPT + 1, F.lit(1)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), docs["doc_id"] == F.col("id"))
    rows = rows.select("id", "y", F.coalesce(F.substring("text", start.cast("int"), F.lit(EXCERPT)), F.lit("")).alias("text"))
    return [(r["text"], r["y"], bool(r["first"])) for r in rows.withColumn("first", F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(2)) == 1).orderBy("id", "y", "text").limit(8 * PER_LABEL).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(sample(docs, labels))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from LIMIT on) of each row."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [given.value.score(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(got, pa.float64()), pa.array([int(s >= LIMIT) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
