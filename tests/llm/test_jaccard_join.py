import random
import re

import quern.llm.jaccard_join as J


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return out


def brute(rows, k, threshold):
    sets = sets_of(rows, k)
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[up[i]] = min(d, least.get(up[i], d))
    return sorted(((d, len(sets[i]), least.get(up[i]) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def fixture(seed=3, copies=60):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(60)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows = [(i, " ".join(text(r.randint(0, 60)))) for i in range(80)]
    for g in range(6):
        base = text(r.randint(20, 120))
        for c in range(copies if g == 0 else 8):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((100 + 100 * g + c, " ".join(t)))
    rows += [(900, ""), (901, None), (902, " \n\t "), (903, "One two"), (904, "one TWO"), (905, "one"), (906, "É é x"), (907, "é é x"), (None, rows[100][1]), (None, "sole words of a null"), (100, rows[3][1])]
    return rows


def check(spark, rows, k, threshold):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long").repartition(3)
    got = sorted((tuple(x) for x in J.components(df, k, threshold).collect()), key=str)
    assert got == brute(rows, k, threshold)


def test_as_brute_force(spark):
    check(spark, fixture(), 3, 90)


def test_long_lists_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(J, "MOST", 4)
    monkeypatch.setattr(J, "CHUNK", 12)
    check(spark, fixture(5, 90), 3, 90)
    monkeypatch.setattr(J, "SHINGLES", 300)
    monkeypatch.setattr(J, "SHARE", 3)
    check(spark, fixture(6, 40), 5, 80)


def test_texts_made_of_common_passages(spark, monkeypatch):
    """All lists long, and hidden links among them: templates with few words changed, chains, and unlike texts."""
    monkeypatch.setattr(J, "MOST", 3)
    monkeypatch.setattr(J, "EXTRA", 6)
    r = random.Random(12)
    common = [" ".join(f"c{p}x{i}" for i in range(60)) for p in range(3)]
    rows = []
    for i in range(150):
        own = " ".join(f"o{r.randrange(4)}" for _ in range(r.randint(0, 8)))
        rows.append((i, " ".join([*r.sample(common, r.randint(1, 3)), own])))
    words = [f"z{i}" for i in range(100)]
    for i in range(40):  # each next to the one before only
        words[i * 2] = f"y{i}"
        rows.append((1000 + i, " ".join(words)))
    check(spark, rows, 3, 90)
    check(spark, rows, 5, 80)


def test_merge_skip():
    r = random.Random(1)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randint(0, 12))) for _ in range(r.randint(1, 9))]
        least = r.randint(1, 5)
        count = {x: sum(x in y for y in lists) for x in range(30)}
        assert list(J.merge_skip(lists, least)) == [(x, c) for x, c in sorted(count.items()) if c >= least]


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "SHINGLES", 20_000)
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(30_000)]
    rows = [(i, " ".join(base[:j] + ["new"] * 5 + base[j:])) for i, j in enumerate(range(0, 30_000, 3_000))] + [(50, " ".join(base[:20_000])), (51, " ".join(reversed(base)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in J.components(df).collect()} == {d: 0 if d < 50 else d for d, _ in rows}


def test_keep_one_with_shared_ids(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, words("a"), "x"), (1, words("b"), "x"), (2, words("a") + " end", "x"), (3, words("c"), "x"), (3, words("c"), "x"), (3, words("c"), "a"), (None, words("b"), "x"), (None, words("d"), "x"), (4, "", "x"), (4, "", "x"), (5, None, "x"), (None, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((tuple(r) for r in J.keep_one(df).collect()), key=str)
    want = [(1, words("a"), "x"), (1, words("b"), "x"), (3, words("c"), "a"), (None, words("d"), "x"), (4, "", "x"), (4, "", "x"), (5, None, "x"), (None, "", "y")]
    assert got == sorted(want, key=str)
    assert J.keep_one(df.limit(0)).collect() == []


def test_empty(spark):
    assert J.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_candidates_are_settled_pair_by_pair(spark, monkeypatch):
    """Texts of two passages each: many candidates, one component of them, no link. The work follows the pairs."""
    r = random.Random(8)
    passages = [" ".join(f"p{p}x{i}" for i in range(40)) for p in range(30)]
    rows = [(i, " ".join(r.sample(passages, 2))) for i in range(300)]
    seen = []

    def spied(found, nodes, stars=J._stars):
        tasks = stars(found, nodes)
        seen.append((found.count(), nodes.count(), tasks.count(), tasks.groupBy("grp", "i", "j").count().agg({"count": "max"}).first()[0]))
        return tasks

    monkeypatch.setattr(J, "_stars", spied)
    check(spark, rows, 3, 90)
    (pairs, classes, tasks, largest), = seen
    assert pairs > classes and tasks <= 2 * pairs and largest < classes / 2


def test_longest_lists_are_told_without_rows(spark, monkeypatch):
    """Unlike texts around one passage: its lists are the longest, and telling each text which it has makes no row for them."""
    monkeypatch.setattr(J, "MOST", 30)
    r = random.Random(9)
    own = lambda i, n: [f"o{i}x{r.randrange(10**6)}" for _ in range(n)]
    passage, rare = ([f"{p}{i}" for i in range(40)] for p in "cd")
    rows = [(i, " ".join([*own(i, 30), *passage, *(rare if i % 5 == 0 else [])])) for i in range(200)]
    rows += [(1000 + i, " ".join([*passage, f"e{i}"])) for i in range(40)]  # of long lists nearly throughout
    made = {}

    def spied(self, df, name, by=None, keep=J.Scratch.keep):
        out = keep(self, df, name, by)
        if name.startswith("hits-"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(J.Scratch, "keep", spied)
    check(spark, rows, 3, 90)
    assert made and not any(made.values())
    monkeypatch.setattr(J, "HEAVY", 20)  # all others by the join
    made.clear()
    check(spark, rows, 3, 90)
    assert made["hits-1"] > 0


def test_t_occurrence_asks_only_what_is_indexed():
    r = random.Random(5)
    sets = [J.np.unique(J.np.array(r.sample(range(60), r.randint(20, 40)), J.np.uint64)) for _ in range(60)]
    for i in range(0, 60, 4):  # near copies
        sets[i + 1] = J.np.unique(J.np.concatenate([sets[i][1:], J.np.array([99], J.np.uint64)]))
    linked = lambda a, b: 100 * len(J.np.intersect1d(sets[a], sets[b])) >= 90 * len(J.np.union1d(sets[a], sets[b]))
    nodes = list(range(60))
    indexed, asks = [i % 2 == 0 for i in nodes], [i % 3 != 0 for i in nodes]
    got = J.t_occurrence(sets, nodes, indexed, asks, 90)
    assert all(linked(a, b) and indexed[a] and asks[b] for a, b in got)
    want, have = J._Union(60), J._Union(60)
    for a, b in got:
        have.join(a, b)
    for a in nodes:
        for b in nodes:
            if a != b and indexed[a] and asks[b] and linked(a, b):
                want.join(a, b)
    assert [have.find(i) for i in nodes] == [want.find(i) for i in nodes] and len(got) > 3
    assert J.t_occurrence(sets, nodes, [False] * 60, asks, 90) == [] == J.t_occurrence(sets, [1] * 60, indexed, asks, 90)
