import numpy as np

import quern.llm.vector_dedup as V


def fixture(n=40):
    r = np.random.default_rng(1)
    base = r.normal(size=(n, 16))
    rows = []
    for i, b in enumerate(base):
        for _ in range(int(r.integers(1, 9)) if i else 120):
            v = b + r.normal(size=16) * 0.05 * np.linalg.norm(b) / 4 * float(r.choice([0.0, 1.0, 2.0]))
            rows.append([len(rows), [float(x) for x in np.float32(v)], int(i % 3)])
    rows[5][2] = None
    nan = float("nan")
    rows += [[1000, None, 1], [1001, [0.0] * 16, 1], [1002, [nan] + [1.0] * 15, 1], [1003, [None] + [1.0] * 15, 1], [1004, [], 1], [1005, [1.0] * 8, 1], [1006, [2.0] * 8, 1], [7, rows[7][1], rows[7][2]], [None, rows[8][1], rows[8][2]], [1007, [1e300] * 16, 2], [1008, [1e-300] * 16, 2]]
    return rows


def brute(rows):
    ok = [v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    u = [V.unit(np.array([v], float))[0] if k else None for (_, v, _), k in zip(rows, ok, strict=True)]
    n, up = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= 0.98:
                n[i] += 1
                n[j] += 1
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[up[i]] = min(d, least.get(up[i], d))
    return sorted(((d, n[i], least.get(up[i]), d is not None and d == least.get(up[i])) for i, (d, _, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(a, b, c, 3) for a, b, c in rows], "vec_id long, embedding array<double>, label int, weight int").repartition(3)
    return sorted((tuple(x) for x in V.links(df).collect()), key=str)


def test_as_brute_force(spark, monkeypatch):
    rows = fixture()
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(V, "CHUNK", 7)
    assert run(spark, rows) == brute(rows)


def test_many_lengths(spark):
    r = np.random.default_rng(2)
    rows = []
    for d in range(2, 82):
        v = r.normal(size=d)
        rows += [[len(rows) + i, [float(x) for x in v * (1 + 0.01 * i)], 1] for i in range(3)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_pivots_grow_with_the_rows(spark, monkeypatch):
    assert [V.pivot_count(n) for n in (0, 51_000, 10**6, 10**9, 10**12)] == [64, 66, 289, 8192, 8192]
    assert [V.listed(p) for p in (1, 5, 64, 256, 1024, 4096)] == [1, 5, 6, 7, 8, 9]
    monkeypatch.setattr(V, "PER_LIST", 0.05)
    assert V.pivot_count(300) > 64
    rows = fixture()
    assert run(spark, rows) == brute(rows)
