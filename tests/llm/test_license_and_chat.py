import random

import duckdb
import pandas as pd

import quern.llm.chat_format as C
import quern.llm.license_scan as S


def test_licenses_as_sql(spark):
    r = random.Random(8)
    filler = lambda n: " ".join(r.choice("lorem ipsum dolor the license under work".split()) for _ in range(n))
    rows = [(i, filler(r.randint(0, 80))) for i in range(60)]
    for i, t in enumerate(S.TEMPLATES.values()):
        words = t.split()
        rows += [(100 + i, filler(9) + "\n" + t.upper() + " " + filler(30) + t), (200 + i, t), (300 + i, filler(5) + " " + " ".join(words[: max(3, len(words) * 8 // 10)]) + " " + filler(5)), (400 + i, " ".join(words[len(words) // 2 :]))]
    rows += [(504, " ".join(f"{filler(r.randint(0, 4))} {S.TEMPLATES['mit-line']}" for _ in range(400)))]
    rows += [(500, None), (501, ""), (502, S.TEMPLATES["mit-line"]), (502, S.TEMPLATES["mit-line"]), (503, filler(20_000) + " " + S.TEMPLATES["gpl-3.0-notice"])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, band int").repartition(3)
    got = sorted(tuple(x) for x in S.scan(df).select("doc_id", "template_id", "containment", "n_windows", "first_word").collect())
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(db.execute(S.oracle()).fetchall())
    assert len(want) > 20 and [(a, b, round(c, 9), d, e) for a, b, c, d, e in got] == [(a, b, round(c, 9), d, e) for a, b, c, d, e in want]
    assert S.scan(df.limit(0)).collect() == []
    assert {x.template_id for x in S.scan(spark.createDataFrame([(None, S.TEMPLATES["mit-line"])], "doc_id long, text string")).collect()} == {"mit-line"}


def chats():
    r = random.Random(9)
    turns = ["hi", "", "how", "so", None]
    rows = []
    for c in range(80):
        base = [(t, r.choice(["user", "assistant", None]), r.choice(turns)) for t in range(r.randint(1, 6))]
        rows += [(c, *x) for x in base]
        rows += [(1000 + c, *x) for x in base[: r.randint(1, len(base))]]
    rows += [(None, 0, "user", "x"), (3000, 0, None, None), (3001, None, "user", "q"), (3001, 0, "user", "q"), (5, *next(x[1:] for x in rows if x[0] == 5)), (3002, 1, "user", "b"), (3002, 1, "user", "a")]
    return rows


def test_chats_as_sql(spark):
    df = spark.createDataFrame([(*x, "k") for x in chats()], "conv_id long, turn long, role string, text string, h string").repartition(3)
    got = sorted(tuple(x) for x in C.render(df).collect())
    db = duckdb.connect()
    db.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", chats())
    want = sorted(db.execute(C.ORACLE).fetchall())
    assert got == want and len({c for c, _, _ in got}) == len(got)
    assert C.render(df.limit(0)).collect() == []


def test_turns_do_not_run_together(spark):
    rows = [(1, 0, "a", "b\x1f5\x1fX"), (2, 0, "a\x1f1\x1fb", "X"), (3, 0, "ab", "c"), (4, 0, "a", "bc"), (5, 0, "1:a", "x"), (6, 0, "1", ":ax")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in C.render(df).collect()} == {1, 2, 3, 4, 5, 6}


def test_a_long_conversation(spark):
    rows = [(c, t, "user", f"t{t % 50}") for c, n in ((1, 4000), (2, 3999), (3, 4000), (4, 1)) for t in range(n)] + [(5, t, "user", f"t{(t + 1) % 50}") for t in range(4000)]
    got = C.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(1, 4000), (5, 4000)}
