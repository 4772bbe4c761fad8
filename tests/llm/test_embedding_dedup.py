import numpy as np
from quern.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, f int, rep string, h1 long"


def brute(rows, least):
    n, links, root = len(rows), [], {}
    for v, e, label, *_ in rows:
        ok = e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e) and label is not None
        links.append(np.asarray(e, np.float64) / np.linalg.norm(np.asarray(e, np.float64)) if ok else None)
    count, parent = [0] * n, list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = links[i], links[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= least:
                count[i] += 1
                count[j] += 1
                parent[top(i)] = top(j)
    for i in range(n):
        if rows[i][0] is not None:
            root[top(i)] = min(root.get(top(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], count[i], root[top(i)]) for i in range(n) if rows[i][0] is not None))


def vectors(seed=1, n=500, dim=64):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.standard_normal((25, dim))
    for i in range(n):
        c = centres[rng.integers(25)]
        noise = rng.choice([0.0, 0.15, 0.3, 0.45]) if i % 3 else 3.0
        e = (c + noise * rng.standard_normal(dim)).astype(np.float32) if i % 11 else c.astype(np.float32)
        rows.append((i, [float(x) for x in e], int(rng.integers(3)) if i % 17 else None, 1, "a", 2))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = vectors()
    rows += [(900, None, 1, 1, "a", 2), (901, [], 1, 1, "a", 2), (902, [0.0] * 64, 1, 1, "a", 2), (903, [float("nan")] * 64, 1, 1, "a", 2), (904, [None] + [1.0] * 63, 1, 1, "a", 2), (905, [1.0, 2.0], 1, 1, "a", 2), (906, [2.0, 4.0], 1, 1, "a", 2), (907, [1.0], 1, 1, "a", 2), (908, [5.0], 1, 1, "a", 2), (909, [float("inf")] * 64, 1, 1, "a", 2)]
    rows += [rows[11], (910, rows[11][1], rows[11][2], 1, "a", 2)]
    for cell in (1024, 4):
        monkeypatch.setattr(E, "CELL", cell)
        got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93).collect()
        want = brute(rows, 0.93)
        assert len(got) == len(rows)
        assert sum(r["n_links"] for r in got) >= 0.99 * sum(w[1] for w in want)
        assert all(a["n_links"] <= b[1] for a, b in zip(sorted(got, key=lambda r: r["vec_id"]), want))
        if sum(r["n_links"] for r in got) == sum(w[1] for w in want):
            assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_without_an_id_link_and_join(spark):
    a, b = np.linalg.qr(np.random.default_rng(7).standard_normal((64, 2)))[0].T
    at = lambda degrees: [float(x) for x in (np.cos(np.radians(degrees)) * a + np.sin(np.radians(degrees)) * b).astype(np.float32)]
    rows = [(i, at(d), 1, 1, "a", 2) for i, d in [(3, 0), (None, 20), (8, 40), (None, 180), (None, 195), (5, 100), (5, 250)]]
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93).collect() if r["component_id"] is not None)
    assert got == [(False, 3, 1, 3, True), (False, 5, 0, 5, True), (False, 5, 0, 5, True), (False, 8, 1, 3, False), (True, 0, 2, 3, False)]
    assert sorted((v, n, c) for null, v, n, c, _ in got if not null) == brute(rows, 0.93)
    lone = [r for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93).collect() if r["component_id"] is None]
    assert [(r["vec_id"], r["n_links"]) for r in lone] == [(None, 1), (None, 1)]


def test_recall_just_above_the_limit():
    rng = np.random.default_rng(3)
    x = E.unit(list(rng.standard_normal((600, 64))))
    r = rng.standard_normal((600, 64))
    r = E.unit(list(r - (r * x).sum(axis=1)[:, None] * x))
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * r
    hit = [len(np.intersect1d(a, b)) > 0 for a, b in zip(E.filters(x), E.filters(y))]
    assert np.mean(hit) >= 0.97


def test_listed_filters_are_all_that_exceed():
    x = E.unit(list(np.random.default_rng(4).standard_normal((20, 64))))
    for v, found in zip(x, E.filters(x)):
        for base, (turn, parts, codes) in enumerate(E.product_codes(64)):
            t = v @ turn
            sums = np.zeros(1)
            for p, c in zip(parts, codes):
                sums = (sums[:, None] + (t[p] @ c.T / np.sqrt(len(parts)))[None, :]).ravel()
            height = min(E.HEIGHT / 8, np.sort(sums)[-E.LEAST])
            mine = found[(found >= base * len(sums)) & (found < (base + 1) * len(sums))] - base * len(sums)
            assert mine.tolist() == np.flatnonzero(sums >= height - 1e-12).tolist()


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA), 0.93).collect() == []
