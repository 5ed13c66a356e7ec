import random
from itertools import permutations

import duckdb
import pandas as pd
import pytest

import quern.llm.filter_audit as A

DDL = "doc_id long, source string, text string, mask int, part string"


def table(n=220):
    r = random.Random(3)
    words = "the of and tion here Er est $ & IN ON".split()
    text = lambda: " ".join(f"{r.choice(words)}{r.randint(0, r.choice([2, 60]))}" for _ in range(r.choice([3, 49, 50, 51, 90])))
    pool = [text() for _ in range(40)]
    rows = [(i, r.choice(["a", "b", "hot", "hot", "hot", None, ""]), r.choice(pool) if r.random() < 0.5 else text()) for i in range(n)]
    rows += [(1000, "a", None), (1001, "b", ""), (1002, "a", None), (1003, "é", "é" * 40 + "ABC"), (1004, "é", "é" * 60 + "ABC"), (None, "a", pool[0]), (None, "hot", pool[0]), (None, "a", "only here")]
    rows += [rows[0], rows[0], (rows[0][0], "other", rows[0][2]), (1005, "a", "a\x0bb\x1cc\x85d " * 60), (1006, "a", "x " * 50)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, n, 2)] + [(0, 1, 1), (None, 1, 1), (5, 1, None), (5, 0, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*x, 1, "p") for x in rows], DDL).repartition(5)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def sql(rows, labels):
    db = duckdb.connect()
    db.register("documents", pd.DataFrame({"doc_id": pd.array([x[0] for x in rows], "Int64"), "source": [x[1] for x in rows], "text": [x[2] for x in rows]}))
    db.register("labels", pd.DataFrame({c: pd.array([x[i] for x in labels], "Int64") for i, c in enumerate(("doc_id", "quality", "toxic"))}))
    return sorted(db.execute(A.ORACLE).fetchall())


def test_as_sql_and_as_applied_one_by_one(spark):
    rows, labels = table()
    got = A.audit(*frames(spark, rows, labels))
    names = got.columns
    got = sorted(tuple(x) for x in got.collect())
    assert got == sql(rows, labels)
    # Filter by filter over the rows of one part.
    least = {}
    for d, _, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = {
        "A": lambda x: len(x[2].split()) < 50,
        "B": lambda x: 100 * len(set(x[2].split())) < 65 * len(x[2].split()),
        "C": lambda x: 100 * sum("A" <= c <= "Z" for c in x[2]) > 5 * len(x[2]),
        "D": lambda x: any(c in "#$%&*|" for c in x[2]),
        "E": lambda x: x[2] in least and (x[0] is None or x[0] > least[x[2]]),
    }
    hot = [(d, s, t or "") for d, s, t in rows if s == "hot"]
    of = {r[1:3]: dict(zip(names, r, strict=True)) for r in got if r[0] == "hot"}
    assert len(of) == 600
    for order in permutations("ABCDE"):
        left = hot
        for step, f in enumerate(order, 1):
            kept = [x for x in left if not fails[f](x)]
            r = of["".join(order), step]
            assert (r["removed"], r["kept"], r["redundant"]) == (len(left) - len(kept), len(kept), sum(fails[f](x) for x in hot) - (len(left) - len(kept)))
            assert r["unique_fails"] == sum(fails[f](x) and not any(fails[g](x) for g in "ABCDE" if g != f) for x in hot)
            left = kept


def test_collisions_keep_their_texts_apart(spark, monkeypatch):
    rows, labels = table(80)
    want = sql(rows, labels)
    calls = A._route, A._settle

    class Same:
        @staticmethod
        def xxh64_intdigest(_):
            return 7

    monkeypatch.setattr(A, "HELD", 300)  # sends on early, so that a text meets itself again
    monkeypatch.setattr(A, "xxhash", Same)
    assert calls == (A._route, A._settle)
    vectors = {}
    marks = {}
    for d, q, t in labels:
        if d is not None:
            m = marks.setdefault(d, [0, 0])
            m[0] |= q == 1
            m[1] |= t == 1
    split = [[(d, s or "", (t or "").encode()) for d, s, t in rows[i::3]] for i in range(3)]
    for d, part, mask, n in A._settle(x for s in split for x in A._route(s)):
        v = vectors.setdefault(part, A.np.zeros((A.MASKS, 3), A.np.int64))
        good, toxic = marks.get(d, (0, 0))
        v[mask] += (n, n * good, n * toxic)
    assert sorted(x for p, v in vectors.items() for x in A.orders(p, v)) == want


def test_copies(spark):
    rows, labels = table()
    docs, _ = frames(spark, rows, labels)
    least = {}
    for d, _, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    assert {r.doc_id for r in A.copies(docs).collect()} == {d for d, _, t in rows if t or t == "" or t is None if (t or "") in least and (d is None or d > least[t or ""])}


@pytest.mark.parametrize("docs_there", [True, False])
def test_empty_tables(spark, docs_there):
    rows, _ = table(20)
    docs, labels = frames(spark, rows, [(1, 1, 1)])
    got = A.audit(docs if docs_there else docs.limit(0), labels.limit(0)).collect()
    assert all(r.good_lost == 0 == r.toxic_lost for r in got) and bool(got) == docs_there


def test_a_hot_text_travels_once_a_task():
    rows = [(i, "s", b"same text") for i in range(10_000)]
    routed = list(A._route(rows))
    assert sum(x[0] is not None for _, x in routed) == 1 and sum(x[0] is None for _, x in routed) == 9999
    assert A.mask_of(b"many words " * 500_000) == 2
