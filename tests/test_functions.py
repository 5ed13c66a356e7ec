"""Column functions and operators against plain Python rules and hand-made edge cases."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import answers, schedules, text, tokens
from quern.operators import chat, chunks, mixing, ordering, packing, questions, sharding
from quern.plans import catalogue
from quern.sources import tables


def one(spark, column, ddl="x int", row=(1,)):
    return spark.createDataFrame([row], ddl).select(column.alias("v")).first().v


@pytest.mark.parametrize("s", ["", "  ", "　 a　", "\x1c b\x1f", " c ", "d", "\n e f \t"])
def test_strip(spark, s):
    assert one(spark, text.strip(F.col("x")), "x string", (s,)) == s.strip()


def test_records(spark):
    known = {"instruction": F.lit("Explain grammar."), "output": F.lit("The answer."), "ignored": F.lit(123)}
    assert one(spark, text.render_record(known)) == "The answer.\n\nExplain grammar."
    assert one(spark, text.render_record({"_a": F.lit("x")})) is None
    assert one(spark, text.render_record({"b": F.lit(True), "c": F.lit("true")})) == "true"
    m = F.array(chat.message("user", F.lit("Hi")), chat.message("assistant", F.lit("Hello")), chat.message("", F.lit("x")), chat.message("user", F.lit(" ")))
    assert one(spark, text.render_messages(m)) == "user: Hi\nassistant: Hello\nx"


@pytest.mark.parametrize(("raw", "want"), [(b"", "<empty>"), (b"\xfeab\xe3\x81", "<0xFE>ab<0xE3><0x81>"), ("é日".encode() + b"\xff", "é日<0xFF>")])
def test_render_chunk(spark, raw, want):
    assert one(spark, text.render_chunk(F.col("x")), "x binary", (raw,)) == want


def test_json_and_decode(spark):
    assert one(spark, text.spaced_json(F.lit('{"b":1,"a":[2,"é"]}'))) == '{"a": [2, "é"], "b": 1}'
    assert one(spark, text.json_object(F.lit('```json\nx {"a": {"b": 1}} y```'))) == '{"a": {"b": 1}}'
    assert one(spark, tokens.decode(F.unhex(F.lit("41FF")), replace=True)) == "A�"


@pytest.mark.parametrize(
    ("s", "want"),
    [("答え：１，２３４", "1234"), ("x\n#### 3/4", "3/4"), ("1/0", None), (r"so \boxed{5} and 6", "5"), ("none", None), ("答え: 1 then 答え: -2.5", "-2.5"), ("first 7 last 8", "8"), ("Answer: \\boxed{ 9", "9"), ("2 then 1/0", "2")],
)
def test_answers(spark, s, want):
    assert one(spark, answers.extract(text.nfkc(F.col("x"))), "x string", (s,)) == want


def test_answer_equality(spark):
    eq = lambda a, b: one(spark, answers.equal(answers.readable(F.lit(a)), answers.readable(F.lit(b))))
    assert eq("1/3", "2/6") and eq("1,000", "1000.0") and not eq("1/3", "0.3333") and not eq("x", "x")
    assert not eq("0.0000001", "0.0000002") and not eq("0.00000000001", "0")
    assert not eq("12345678901234567890/3", "12345678901234567890/99999999999999999999")
    assert eq("1/3", "0." + "3" * 28) and eq("9" * 60 + ".0", "9" * 60) and not eq("1/0", "1/0") and eq("-0", "0")


@pytest.mark.parametrize("x", [0.0, -0.0, 1.0, 1e-05, 0.00012, -1.5e-7, 0.001, 123456789.25, 1e15, 1.5e16, 1e22, -3.25e100, float("nan"), float("inf"), float("-inf"), 12345678.0, 0.1, 1e7])
def test_floats_as_python_writes_them(spark, x):
    assert one(spark, text.python_float(F.col("x")), "x double", (x,)) == str(x)


def test_nested_records(spark):
    def show(value, kind):
        df = spark.createDataFrame([(value,)], f"x {kind}")
        return df.select(text.render_value(F.col("x"), df.schema["x"].dataType).alias("v")).first().v

    assert show([["a", " "], ["b"]], "array<array<string>>") == "a\nb"
    assert show((None, "c"), "struct<messages:array<struct<role:string,content:string>>,content:string>") == "c"
    assert show(([("user", "hi"), (None, "x")], "c"), "struct<messages:array<struct<role:string,content:string>>,content:string>") == "user: hi\nx"
    assert show((1.5e-7, None, "é"), "struct<b:double,a:int,c:string>") == '{"a": null, "b": 1.5e-07, "c": "é"}'
    assert show({"text": "t", "b": "c"}, "map<string,string>") == "t" and show({"b": "c", "a": "d"}, "map<string,string>") == '{"a": "d", "b": "c"}'
    assert show([(("deep",), "user")], "array<struct<content:struct<text:string>,role:string>>") == "user: deep"
    assert show(None, "array<int>") == "" and show([1, None, 2], "array<int>") == "1\n2" and show([True, False], "array<boolean>") == "true\nfalse"


def test_few_shot_draws_until_it_has_enough(spark):
    # A third of the pool and more cannot serve the hot targets, so few draws fit.
    pool = spark.createDataFrame([(f"k{i}", "q" if i % 10 else f"q{i}", f"a{i}") for i in range(400)], "key string, question string, answer string")
    got = questions.few_shot(pool, pool, 2, seed=1).collect()
    assert len(got) == 400 and all(len(r.examples) == 2 and r.question not in {e.question for e in r.examples} for r in got)
    small = pool.where("key in ('k1', 'k2')")
    assert {len(r.examples) for r in questions.few_shot(small, small, 2, strict=False).collect()} == {0}
    with pytest.raises(Exception, match="too few examples"):
        questions.few_shot(small, small, 2).collect()


def test_greedy_shards_of_a_hot_source(spark):
    r = random.Random(4)
    rows = [(i, "hot" if i % 10 else None, r.choice([1, 2, 3, 50, 120])) for i in range(3000)]
    df = spark.createDataFrame(rows, "o long, s string, n long").repartition(5)
    want, state = {}, {}
    for o, s, n in rows:
        shard, used = state.get(s, (0, 0))
        if used > 0 and used + n > 100:
            shard, used = shard + 1, 0
        want[o], state[s] = shard, (shard, used + n)
    assert {x.o: x.shard for x in sharding.greedy_shards(df, "o", "s", 100).collect()} == want


def test_numpy_permutation(spark):
    import numpy as np

    want = np.arange(50)
    np.random.default_rng(42).shuffle(want)
    assert [r.sample_id for r in ordering.numpy_permutation(spark, 50, 42).orderBy("pos").collect()] == want.tolist()


def test_dialogues(spark):
    m = lambda *x: F.array(*[chat.message(r, F.lit(c)) for r, c in x])
    assert one(spark, chat.valid(m(("user", "a"), ("assistant", "b"))))
    assert not one(spark, chat.valid(m(("assistant", "b")))) and not one(spark, chat.valid(m(("system", "a"), ("assistant", "b"))))
    assert one(spark, F.size(chat.normalise(m(("Human", "a"), ("gpt", " "), ("tool", "x")), strict=False))) == 1
    with pytest.raises(Exception, match="unsupported role"):
        one(spark, chat.normalise(m(("tool", "x"))))
    assert one(spark, chat.think_format(F.lit("why\nFinal answer: 4"))) == "<think>\nwhy\n</think>\n\n4"
    assert one(spark, chat.think_format(F.lit("\n#### 4"))) == "#### 4"
    assert one(spark, chat.with_system(m(("system", " s "), ("user", "u")), True))[0].content == "s\n/think"


def test_distractors(spark):
    check = lambda raw, a="abc": one(spark, questions.wrong_answers(F.lit(raw), F.lit(a)))
    assert check('{"wrong_answers": ["x", " X", "y", "abcd", "z", "", null]}') == ["x", "y", "z"]
    assert check('{"wrong_answers": ["x", "y"]}') is None and check('{"wrong_answers": ["w", "x", "y", "z"]}') is None and check("no json") is None


def test_scorer_retries(spark):
    def model(batch):
        import random

        if random.random() < 0.3:
            raise RuntimeError
        return [x.upper() for x in batch]

    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "i int, prompt string")
    assert all(r.output in (None, r.prompt.upper()) for r in questions.scored(df, model, batch=4, retries=8).collect())


def test_packing_conserves_bytes_whatever_the_partitions(spark):
    r = random.Random(0)
    rows = [(i, f"s{i % 3}", "é" * r.randint(0, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    results = []
    for n in (1, 8):
        got = sorted((x.source, x.window, bytes(x.bytes)) for x in packing.windows(df.repartition(n), "doc_id", "source", 17).collect())
        results.append(got)
    assert results[0] == results[1]
    for s in ("s0", "s1", "s2"):
        stream = b"".join(b"\xfe" + t.encode() + b"\xff" for _, x, t in rows if x == s and t)
        assert b"".join(b for x, _, b in results[0] if x == s) == stream[: len(stream) // 17 * 17]


def test_greedy_shards(spark):
    sizes = [5, 5, 10, 11, 1, 30, 2]
    df = spark.createDataFrame([(i, "s", n) for i, n in enumerate(sizes)], "o long, s string, n long").repartition(4)
    got = [r.shard for r in sorted(sharding.greedy_shards(df, "o", "s", 10).collect(), key=lambda r: r.o)]
    assert got == [0, 0, 1, 2, 3, 4, 5]


def test_splits_and_estimates(spark):
    assert [one(spark, schedules.half_even_count(F.lit(n), r)) for n, r in ((2, 0.1), (5, 0.1), (5, 0.5), (25, 0.1), (4, 0.99))] == [1, 1, 2, 2, 3]
    assert one(spark, schedules.parameter_count(F.lit(1_234_567))) == "1.23M"
    assert [tuple(x) for x in one(spark, schedules.layout_parts(F.lit("M1T22m4")))] == [("M", 1), ("T", 22), ("m", 4)]
    assert [round(x, 6) for x in schedules.stage_multipliers([1, 3, 3], [2, 4, 8])] == [round(math.sqrt(4.6 * a * b), 6) for a, b in ((1, 4), (1, 2), (1 / 1 * 3 / 9, 1))]
    assert mixing.override({"a_take": 1, "seed": 2}, {"a_take": -5, "b": 3}) == {"a_take": 0, "seed": 2}
    with pytest.raises(ValueError, match="positive"):
        packing.probabilities([0, -1])


def test_permutation_is_a_bijection(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert sorted(r.pos for r in ordering.permutation(df.repartition(7), "k", 1).collect()) == list(range(1000))
    assert [r.sample_id for r in ordering.numpy_permutation(spark, 5, 42).orderBy("pos").collect()] != [0, 1, 2, 3, 4]


def test_interleave_edge_cases(spark):
    f = [spark.createDataFrame([(i,) for i in range(n)], "o long") for n in (5, 0, 3)]
    assert mixing.interleave(f, [0, 0, 0], "o").count() == 0
    assert [r.o for r in mixing.interleave(f, [2, 0, 0], "o").orderBy("slot").collect()] == [0, 1, 2, 3, 4]
    mixed = mixing.interleave(f, [1, 0, 1], "o").orderBy("slot").collect()
    for s in (0, 1):
        assert [r.o for r in mixed if r.source == s] == list(range(sum(r.source == s for r in mixed)))


def test_chunk_edges(spark):
    rows = spark.createDataFrame([(0, i, p) for i, p in enumerate([0.2, 0.5, 0.6, 0.1, 0.9])], "s int, i long, p double")
    b = chunks.boundaries(rows)
    assert [tuple(r)[1:] for r in chunks.chunks(b, "s", "i", F.lit(5)).orderBy("chunk").collect()] == [(0, 2, 4), (1, 4, 5)]
    empty = chunks.batch_metrics(rows.select("s", F.lit(0).alias("g"), "p", F.lit(True).alias("is_boundary"), F.lit(True).alias("valid"), F.lit(False).alias("continuation")), "s", "g").first()
    assert empty.mid_character == 0
    s = chunks.summary(chunks.stage_metrics(chunks.batch_metrics(b.select("s", F.lit(0).alias("g"), "p", "is_boundary", F.lit(True).alias("valid"), F.lit(False).alias("continuation")), "s", "g"), "g", [3.0]), "g").first()
    assert math.isnan(s.f1) and math.isnan(s.compression_l2_l0) and math.isclose(s.compression_l1_l0, 2.5)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, 1.0, 2.0, 3.0, 4.0)], tables.TRAINING_METRICS)
    tables.write_metrics(df, f"{tmp_path}/m")
    assert tables.read_metrics(spark, f"{tmp_path}/m").collect() == df.collect()
    (tmp_path / "v.csv").write_text("step,validation_batches,validation_ce_loss\n1,2,\n")
    assert math.isnan(tables.read_metrics(spark, f"{tmp_path}/v.csv", "step long, validation_batches long, validation_ce_loss double", strict=False).first()[2])
    assert tables.read_done(spark, f"{tmp_path}/none", "id long").count() == 0
    tables.write_records(spark.range(3), f"{tmp_path}/r")
    assert tables.read_done(spark, f"{tmp_path}/r", "id long").count() == 3
    s = tables.known_fields(tables.Source, {"name": "a/b c", "take_examples": 10, "unknown": 1})
    assert s == tables.Source("a/b c", take_examples=10)
    c = tables.alias(tables.catalogue(spark, {"t": [s, tables.Source("!!", "test", "x")]})).orderBy("ordinal")
    assert [r.alias for r in c.collect()] == ["00_a_b_c__train", "01_dataset__x__test"]
    assert tables.resolve([], "t", {"t": [s]}, []) == [s]


def test_items_of_whole_pages(spark):
    """nfkc_items against plain Python, on pages of every length."""
    sf = "/root/testdata/sf0.001"
    clean = lambda s: " ".join(unicodedata.normalize("NFKC", s or "").split())
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert max(len(p.html) for p in pages if p.html) > 200
    want = []
    for p in pages:
        question = "t" + questions.TITLE_JOIN + clean(p.html)
        want.append((f"{clean(str(p.page_id))}::{clean(p.url)}::{question}::a", question, "a"))
    got = [tuple(r) for r in catalogue.QUERIES["nfkc_items"](spark, sf).select("key", "question", "answer").collect()]
    assert sorted(got) == sorted(want)


def test_reasoning_strips_its_text_once(spark):
    """Common parts are bound, as Spark shares none within lambdas; strip takes all that Python's and Unicode's white space names."""
    plan = spark.range(1).select(chat.think_format(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("cast(id") == 1
    edge = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert one(spark, text.strip(F.col("x")), "x string", (edge + "a" + edge + "b\n" + edge,)) == "a" + edge + "b"


def test_pieces_are_joined_where_they_lie(spark):
    """What is shuffled is a row for each run of pieces, not for each piece; order, gaps, nulls and cut characters are kept."""
    raw = "aé日".encode() * 100
    rows = [(s, i, raw[i : i + 1]) for s in ("x", None, "y") for i in range(len(raw))]
    df = spark.createDataFrame(rows, "s string, i int, d binary").coalesce(1)
    assert df.mapInArrow(tokens._joined, df.schema).count() == 3
    random.Random(2).shuffle(rows)
    mixed = spark.createDataFrame([*rows, ("z", 5, b"b"), ("z", 6, None), ("z", 3, b"a")], "s string, i int, d binary").repartition(3)
    for frame, more in ((df, {}), (mixed, {"z": "ab"})):
        got = {r.s: r.text for r in tokens.assembled_text(frame, "s", "i", "d").collect()}
        assert got == dict.fromkeys(("x", None, "y"), "aé日" * 100) | more


def test_cleaning_holds_few_texts_at_once():
    """Long texts go by rows, not in batches for Arrow, which hold up to 10,000 of them."""
    from pyspark.util import PythonEvalType

    assert text.nfkc_long.evalType == PythonEvalType.SQL_BATCHED_UDF
    assert [text.nfkc_long.func(x) for x in (None, "", "abc", "ｔ①")] == [None, "", "abc", "t1"]


def test_draws_move_no_texts(spark):
    """A target draws many times; what is shuffled is a few times the texts, not the texts for each draw."""

    def written():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    r = random.Random(4)
    rows = [(f"k{i}", f"q{i}", "".join(r.choices("0123456789abcdef", k=20_000))) for i in range(100)]
    pool, before = spark.createDataFrame(rows, "key string, question string, answer string"), written()
    assert all(len(x.examples) == 2 for x in questions.few_shot(pool, pool, 2, seed=5).collect())
    assert written() - before < 10 * 100 * 20_000
