import math
import re
import zlib

from quern.llm import language_id as L
from tests.llm.conftest import made

EN = "the cat and the dog went over there with this thing that they had when she was young and then some more"
FR = "le chat et les chiens sont dans une maison avec que nous avions quand elle était jeune et puis encore autre"


def corpus(spark, n=240):
    rows = []
    for i in range(n):
        words = (EN if i % 2 else FR).split()
        rows.append((i, " ".join(words[(i * 7 + k * 5) % len(words)] for k in range(3 + i % 40)), "en" if i % 2 else "fr", None))
    return made(spark, rows)


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = L.identify(docs, L.fit(docs)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "fr") for r in held)
    assert len(held) > 30 and right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_teach_nothing(spark):
    docs = corpus(spark)
    swapped = docs.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).when(L.held_out(docs["doc_id"]), "xx").otherwise(docs["lang"]))
    assert sorted(set(L.sample(swapped)[1])) == ["en", "fr"]
    assert L.sample(swapped) == L.sample(docs)


def test_awkward_rows(spark, awkward, empty):
    model = L.fit(corpus(spark))
    got = L.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    by = {(r["doc_id"]): r for r in got if r["doc_id"] in (100, 101, 102, 106, 103, 109)}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 and by[d]["rejected"] for d in (100, 101, 102, 106))
    assert by[103]["lang_pred"] in ("en", "fr") and by[109]["lang_pred"] in ("en", "fr")
    assert L.identify(empty, model).collect() == []
    none = L.fit(empty)
    assert {r["lang_pred"] for r in L.identify(awkward, none).collect()} == {"und"}


def test_long_texts_are_read_whole():
    model = L.train([EN, FR] * 40, ["en", "fr"] * 40)
    text = (EN + " ") * 30 + (FR + " ") * 300
    whole, parts = model.predict([text])[0], model.predict([text], batch_chars=5000)[0]
    assert whole[0] == parts[0] == "fr" and abs(whole[1] - parts[1]) < 0.05


def plain_scores(model, text):
    """The probabilities of a text, n-gram by n-gram."""
    raw = (" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode()
    sums, count = [0.0] * len(model.langs), 0
    for a in range(len(raw)):
        h = 0
        for n in range(1, 5):
            if a + n > len(raw):
                break
            h = (h + raw[a + n - 1] * (int(L._MIX[n - 1]) * (2 * n + 1) % 2**32)) % 2**32
            h ^= h >> 13
            if n >= 2:
                bucket = (h * 0x9E3779B1 % 2**32) >> 16
                sums = [x + float(t) for x, t in zip(sums, model.table[bucket])]
                count += 1
    z = [x / count + float(b) for x, b in zip(sums, model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_scores_against_a_plain_loop(spark):
    docs = corpus(spark)
    model = L.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in L.identify(docs, model).collect():
        p = plain_scores(model, texts[r["doc_id"]])
        assert abs(max(p) - r["score"]) < 1e-4 and model.langs[p.index(max(p))] == r["lang_pred"]


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 2)
    monkeypatch.setattr(L, "SAMPLE", 60)
    docs = corpus(spark).union(made(spark, [(1000 + i, EN, f"x{i}", None) for i in range(20)]))
    texts, langs = L.sample(docs)
    assert set(langs) == {"en", "fr"} and len(texts) <= 120
    assert {r["lang_pred"] for r in L.identify(docs, L.fit(docs)).collect()} <= {"en", "fr"}


def test_rows_without_ids_keep_no_language_out(spark):
    """Rows without an id, and rows that share one, each have a draw of their own."""
    rows = [(None, f"{EN} {i}", "en", None) for i in range(3000)] + [(i, f"{EN} {i} so", "en", None) for i in range(130)]
    rows += [(5000 + i, f"{FR} {i}", "fr", None) for i in range(1000)] + [(8, f"und der {i} die das mit nicht", "de", None) for i in range(900)] + [(8, "la casa", "it", None)] * 500
    L.PER_LANG, kept = 500, L.PER_LANG
    try:
        texts, langs = L.sample(made(spark, rows))
    finally:
        L.PER_LANG = kept
    of = {x: langs.count(x) for x in set(langs)}
    assert set(of) == {"en", "fr", "de", "it"} and of["it"] == 1
    assert all(350 <= of[x] <= 1000 for x in ("en", "fr", "de")), of
