import numpy as np

import quern.llm.neighbours as N
from quern.llm.vector_dedup import unit


def brute(rows, k, every):
    ok = [(d, unit(np.array([v], float))[0]) for d, v in rows if d is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n in {len(u) for _, u in ok}:
        ids, u = np.array([d for d, x in ok if len(x) == n]), np.array([x for _, x in ok if len(x) == n])
        for i in np.flatnonzero(ids % every == 0):
            s = np.round((u * u[i]).sum(axis=1), 12)
            others = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i)[:k]
            out[int(ids[i])] = [(int(d), -x) for x, d in others]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, v, "x") for d, v in rows], "vec_id long, embedding array<double>, id string").repartition(3)


def test_recall_and_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 60)
    r = np.random.default_rng(3)
    x = np.float32(r.normal(size=(1500, 24)))
    x[700:760] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0, 2.0]), (5151, [1.0, 2.5]), (None, rows[3][1])]
    want = brute(rows, 5, 50)
    got = {}
    for q, rank, d, s in sorted(tuple(t) for t in N.nearest(frame(spark, rows)).collect()):
        got.setdefault(q, []).append((d, s))
        assert rank == len(got[q])
    assert set(got) == set(want) and all(len(v) == len(want[q]) for q, v in got.items()) and got[5150][0][0] == 5151
    hits = sum(len({d for d, _ in got[q]} & {d for d, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [d for d, _ in got[0]] == [700, 701, 702, 703, 704] and [d for d, _ in got[700]] == [0, 701, 702, 703, 704]
    assert all(abs(s - dict(want[q]).get(d, s)) < 1e-9 for q, v in got.items() for d, s in v)


def test_tight_and_rescaled_copies(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(3600, 24))
    x[:3000] = x[0] + r.normal(size=(3000, 24)) * 0.003 * np.linalg.norm(x[0]) / 24**0.5
    x[3300:3500] = x[3300] * np.arange(1, 201)[::-1, None]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    cosine = (unit(x[:1]) @ unit(x[1:3000]).T)[0]
    assert 1 - cosine.mean() < 1e-5
    want = brute(rows, 5, 50)
    got = {}
    for q, _, d, s in sorted(tuple(t) for t in N.nearest(frame(spark, rows)).collect()):
        got.setdefault(q, []).append((d, s))
    tight = [q for q in want if q < 3000]
    hits = sum(len({d for d, _ in got[q]} & {d for d, _ in want[q]}) for q in tight)
    assert hits >= 0.9 * 5 * len(tight), hits / (5 * len(tight))
    assert [d for d, _ in got[3450]] == [3300, 3301, 3302, 3303, 3304]


def test_few_rows(spark):
    rows = [(0, [1.0] * 24), (1, [1.0] * 24), (50, [2.0] + [1.0] * 23)]
    got = sorted(tuple(t)[:3] for t in N.nearest(frame(spark, rows)).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert N.nearest(frame(spark, [])).collect() == []
    assert N.nearest(frame(spark, rows[:1])).collect() == []


def test_mixed_lengths_and_lonely_nodes(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 30)
    r = np.random.default_rng(8)
    rows = [(i, [float(c) for c in r.normal(size=(3, 8, 24)[i % 3])]) for i in range(900)]
    rows += [(5000, [1.0] * 40), (5050, [1.0] * 41), (5051, [-1.0] * 41)]
    rows += [(6000, [-50.0] + [0.0] * 7), (6050, [1e300] * 8), (6100, [1e-300] * 24)]  # far from all others
    want = brute(rows, 5, 50)
    got = {}
    for q, _, d, _ in sorted(tuple(t) for t in N.nearest(frame(spark, rows)).collect()):
        got.setdefault(q, []).append(d)
    assert 5000 not in got and got[5050] == [5051] and all(len(got[q]) == len(v) for q, v in want.items() if v)
    hits = sum(len(set(got.get(q, [])) & {d for d, _ in v}) for q, v in want.items())
    assert hits >= 0.9 * sum(len(v) for v in want.values())
