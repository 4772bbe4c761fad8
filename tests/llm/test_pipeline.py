import corpus_pipeline as C
from quern.llm import substring_dedup as S
from tests.conftest import SF
from tests.llm.conftest import made, sentences
from tests.llm.test_ngram_join import brute
from tests.llm.test_substring_dedup import against_brute_force


def test_stages_keep_the_columns_and_take_effect(spark):
    base = sentences(11, 60, 60, 900)
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(200, base[3], "en", "s0"), (201, base[3] + " more", "en", "s0"), (202, "1 2 3", "en", "s1"), (203, None, None, None), (204, "", "fr", "s2")]
    passage = sentences(12, 1, 900, 900)[0]
    rows += [(300, "start here " + passage, "en", "s1"), (301, sentences(13, 1, 400)[0] + " " + passage + " end", "en", "s2")]
    docs = made(spark, rows)
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        ids = {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            assert not ids & {202, 203, 204} and ids >= set(range(50))
        if name == "ngram_jaccard_join":
            assert 200 not in ids and len(ids & {3, 201}) >= 1 and ids >= {300, 301}
        if name == "substring_dedup":
            assert passage not in {r["doc_id"]: r["text"] for r in out.collect()}[301]
        docs = C.common.staged(out, "test")
    assert docs.columns == ["doc_id", "ids"] and docs.count() > 0


def test_empty_table(spark, empty):
    docs = empty
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_awkward_rows(spark, awkward):
    docs = awkward
    for name, stage in C.STAGES:
        docs = C.common.staged(stage(spark, docs, SF), "test")
    assert docs.count() > 0


def test_near_duplicates_row_by_row(spark):
    """Which rows stay, of reused ids, repeated rows, rows without an id and a column that has no order."""
    t, near, other = sentences(5, 1, 200)[0], sentences(5, 1, 200)[0] + " more", "a wholly different text " + " ".join(f"v{i}" for i in range(30))
    rows = [(1, t, "x", {"k": 2}), (1, t, "x", {"k": 1}), (5, t, "x", None), (5, other, "x", None), (6, near, "x", None), (None, t, "x", None), (7, "", "x", None), (7, "", "y", None), (8, None, "x", None), (None, "no id here " + other[::-1], "x", None), (None, "no id here " + other[::-1], "y", None)]
    kinds = "doc_id long, text string, source string, m map<string,int>"
    clash = ["row", "of_id", "of_text", "id", "th", "stays", "_dropped", "component", "times"]
    docs = spark.createDataFrame([(*r, *["v"] * len(clash)) for r in rows], kinds + "".join(f", `{c}` string" for c in clash))
    out = C.drop_near_duplicates(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:12], r["source"], str(r["m"])) for r in out.collect())
    want = [("1", t[:12], "x", "{'k': 1}"), ("5", other[:12], "x", "None"), ("7", "", "x", "None"), ("7", "", "y", "None"), ("8", "", "x", "None"), ("None", "no id here " + other[::-1][:1], "x", "None")]
    assert got == sorted(want)


def test_stages_against_brute_force(spark):
    """Each stage's decisions on a table, against plain versions of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    component = {int(d): c for d, _, c in brute(rows, 5, 80, 100) if c is not None}
    kept = C.common.staged(C.drop_near_duplicates(spark, docs, SF), "test")
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows if component.get(d, d) == d}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert against_brute_force([(d, t or "") for d, t in rows], S.duplicates(kept).collect()) >= 0
    spans, left = {}, {r["doc_id"]: r["text"] for r in C.drop_repeated_passages(spark, kept, SF).collect()}
    for r in S.duplicates(kept).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    for d, t in rows:
        raw = (t or "").encode()
        for a, b in sorted(spans.get(d, []), reverse=True):
            raw = raw[:a] + raw[b:]
        assert (left[d] or "").encode() == raw


def test_run_over_a_table(spark):
    assert C.run(spark, SF).count() > 100 and [n for n, _ in C.STAGES][0] == "language_id"


def test_workers_are_sent_bounded_batches(spark, tmp_path, monkeypatch):
    """The stages that end in Python hold few texts at once, and each once, whatever writes their result."""

    def watching(run):
        def wrapped(batches):
            import uuid

            def seen():
                for batch in batches:
                    (tmp_path / uuid.uuid4().hex).write_text(f"{batch.num_rows} {batch.nbytes}")
                    yield batch

            yield from run(seen())

        return wrapped

    text = sentences(21, 1, 400)[0]
    docs = made(spark, [(i, f"{text} w{i}", "en" if i % 2 else "fr", "s0") for i in range(6000)]).coalesce(1)
    for module, stage in ((C.language_id, C.identify_language), (C.sentencepieces, C.encode)):
        monkeypatch.setattr(module, "frugal", watching)
        stage(spark, docs, SF).write.format("noop").mode("overwrite").save()
        sizes = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
        assert sum(n for n, _ in sizes) == 6000
        assert max(n for n, _ in sizes) <= 4000 and sum(b for _, b in sizes) < 1.5 * 6000 * (len(text) + 40)
        for p in tmp_path.iterdir():
            p.unlink()


def test_language_id_leaves_no_copy_of_the_documents(spark, tmp_path, monkeypatch):
    """The stage's own files hold which texts go; rows with equal texts, nulls and clashing names go or stay alike."""
    text = sentences(31, 400, 60, 900)
    docs = made(spark, [(i, t, "en" if i % 2 else "fr", "s0") for i, t in enumerate(text)] + [(1000 + i, x, "en", "s1") for i, x in enumerate(["12 34", "12 34", None, "", text[0], text[0]])])
    docs = docs.selectExpr("*", "1 as key", "2 as may", "3 as piece")
    monkeypatch.setattr(C.common, "shared_dir", lambda _: f"file://{tmp_path}")
    out = C.identify_language(spark, docs, SF)
    held = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert out.dtypes == docs.dtypes and held < sum(map(len, text)) / 10
    wanted = {r["doc_id"] for r in C.language_id.identify(docs, C.language_id.fit(docs)).where("not rejected").collect()}
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == wanted and not wanted & set(range(1000, 1004)) and {1004, 1005} & wanted in (set(), {1004, 1005})
