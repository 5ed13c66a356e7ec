"""Question-answer sets: cleaning, validity, pairs from dialogues, few-shot sampling, distractors, resume, accuracy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import answers
from quern.functions.text import clean, json_object, nfkc, normal_compare, plain, strip
from quern.operators.ordering import row_ids, uniform
from quern.sources.shared import fresh_dir, kept

#: Phrases that disqualify a question.
BANNED = ("出典が必要", "要出典", "曖昧さ回避", "この記事", "脚注")
TITLE_JOIN = "について、"


def items(df: DataFrame, title_prefix: bool = False) -> DataFrame:
    """(key, question, answer) from query, answer, title, passage_id, url, all cleaned."""
    c = {k: clean(F.col(k)) for k in ("query", "answer", "title", "passage_id", "url")}
    rows = df.select(*[v.alias(k) for k, v in c.items()])
    question = F.when((F.col("title") != "") & F.lit(title_prefix), F.concat("title", F.lit(TITLE_JOIN), "query")).otherwise(F.col("query"))
    rows = rows.withColumn("question", question)
    return rows.select(F.concat_ws("::", "passage_id", "url", "question", "answer").alias("key"), "question", "answer")


def valid_item(q: Column, a: Column, q_min: int = 4, q_max: int = 180, a_min: int = 1, a_max: int = 300) -> Column:
    banned = F.lit(False)
    for b in BANNED:
        banned = banned | F.contains(q, F.lit(b))
    markup = F.lit(False)
    for b in ("http://", "https://", "<", ">"):
        markup = markup | F.contains(a, F.lit(b))
    return (q != "") & (a != "") & (q != a) & F.length(q).between(q_min, q_max) & F.length(a).between(a_min, a_max) & ~banned & ~markup


def short_answer(a: Column, most: int = 30) -> Column:
    return F.coalesce(F.length(strip(a)).between(1, most), F.lit(False))


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return nxt.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def few_shot(targets: DataFrame, pool: DataFrame, k: int, seed: int = 0, draws: int | None = None, strict: bool = True) -> DataFrame:
    """(key, question, answer, examples): k examples per target, with another key, question and answer each.

    Draws are pool positions hashed from target and draw number, so the match is an equi-join, not a product of both
    sides. All targets draw k + 2 times, then 8 k times; those still short of examples draw on, up to ``draws`` (100 k) times. A target that
    is short even then fails the job if ``strict``, as it should be looked at; otherwise it keeps the examples it has.
    """
    draws = draws or 100 * k
    names, hashes = ("key", "question", "answer"), ("_hkey", "_hquestion", "_hanswer")
    # Null stays null, and is then like nothing else.
    hashed = [F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(h) for c, h in zip(names, hashes, strict=True)]
    folder = fresh_dir(targets.sparkSession)
    numbered = row_ids(pool.select(*names).dropDuplicates(["key"]).withColumn("_u", uniform("key", seed=seed)), "_u", "at")
    numbered = kept(numbered.select("at", *[F.col(c).alias(c[0]) for c in names]), f"{folder}/pool")
    slim = numbered.select("at", *[F.when(F.col(c[0]).isNotNull(), F.xxhash64(c[0])).alias(f"_{c[0]}") for c in names])
    n = numbered.agg(F.count("*").alias("_n"))
    asked = targets.select(*names)
    left = kept(asked.select("key", *hashed).distinct(), f"{folder}/asked")
    other = lambda df: df.select(*[F.col(h).alias(f"{h}_") for h in hashes], *[c for c in df.columns if c not in hashes])
    same = [F.col(h).eqNullSafe(F.col(f"{h}_")) for h in hashes]

    def drawn(rows: DataFrame, many: int) -> DataFrame:
        """rows' hashes with l, the fit ones of their first so many draws by draw: without texts, a row a draw, and a place drawn again only once."""
        at = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda d: F.floor(uniform("key", d, seed=seed) * F.col("_n")))
        want = rows.join(F.broadcast(n)).select(*hashes, F.posexplode(F.array_distinct(at)).alias("draw", "at"))
        hit = want.join(slim, "at").where("_k <> _hkey and _q <> _hquestion and _a <> _hanswer")
        return hit.groupBy(*hashes).agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "at"))), 1, k).alias("l"))

    found = []
    stages = sorted({min(x, draws) for x in (k + 2, 8 * k, draws)})
    for i, many in enumerate(stages):
        got = drawn(left, many)
        if many < draws:
            got = kept(got.where(F.size("l") >= k), f"{folder}/found-{i}")
            found.append(got)
            left = kept(left.join(other(got), same, "left_anti"), f"{folder}/left-{i}")
        else:
            none = F.array().cast("array<struct<draw:int,at:bigint>>")
            all_ = left.join(other(got), same, "left").select("key", *hashes, F.coalesce("l", none).alias("l"))
            if strict:
                all_ = all_.withColumn("l", F.when(F.size("l") >= k, F.col("l")).otherwise(F.raise_error(F.concat(F.lit("too few examples for "), F.col("key").cast("string")))))
            found.append(all_.select(*hashes, "l"))
    every = reduce(DataFrame.unionByName, found)
    # Texts move for the examples that are taken.
    texts = every.select(*hashes, F.explode("l").alias("x")).select(*hashes, "x.draw", "x.at").join(numbered, "at")
    listed = texts.groupBy(*hashes).agg(F.array_sort(F.collect_list(F.struct("draw", F.struct(F.col("q").alias("question"), F.col("a").alias("answer")).alias("e"))))["e"].alias("examples"))
    rows = asked.distinct().select("*", *hashed)
    none = F.array().cast(listed.schema["examples"].dataType)
    # All are there but those without any example, and a strict run fails for those.
    checked = every.where(F.size("l") == 0).select(*hashes, none.alias("examples"))
    listed = listed.unionByName(checked)
    return rows.join(other(listed), same).select(*names, "examples")


def widen(rows: DataFrame, k: int) -> DataFrame:
    """question, answer, example{i}_question, example{i}_answer."""
    cols = [F.try_element_at("examples", F.lit(i))[f].alias(f"example{i}_{f}") for i in range(1, k + 1) for f in ("question", "answer")]
    return rows.select("question", "answer", *cols)


def wrong_answers(raw: Column, correct: Column, most: int = 30) -> Column:
    """Exactly three usable distractors of a model's JSON output, else null."""
    given = F.from_json(json_object(raw), "wrong_answers array<string>")["wrong_answers"]
    own = normal_compare(correct)
    tidy = F.transform(F.filter(given, lambda w: w.isNotNull()), strip)
    fit = F.filter(tidy, lambda w: (w != "") & (F.length(w) <= most) & (normal_compare(w) != own) & ~((own != "") & (F.contains(normal_compare(w), own) | F.contains(own, normal_compare(w)))))
    distinct = F.aggregate(fit, F.array().cast("array<string>"), lambda acc, w: F.when(F.exists(acc, lambda x: normal_compare(x) == normal_compare(w)), acc).otherwise(F.concat(acc, F.array(w))))
    return F.when(F.size(distinct) == 3, distinct)


def distractor_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of row_id, query, answer, raw_output."""
    rows = df.withColumn("w", wrong_answers(F.col("raw_output"), F.col("answer")))
    good = rows.where("w is not null").select("row_id", "query", "answer", *[F.element_at("w", i).alias(f"wrong_answer_{i}") for i in (1, 2, 3)])
    return good, rows.where("w is null").select("row_id", "query", "answer", F.lit("unusable distractors").alias("error"), "raw_output")


def scored(df: DataFrame, scorer: Callable[[list[str]], list[str]], prompt: str = "prompt", output: str = "output", batch: int = 32, retries: int = 3) -> DataFrame:
    """df with a model's output per prompt; the model is any function of a list of texts, tried again when it fails."""
    import time

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out: list[str | None] = []
            for i in range(0, len(pdf), batch):
                part = pdf[prompt].iloc[i : i + batch].tolist()
                for attempt in range(retries + 1):
                    try:
                        out += scorer(part)
                        break
                    except Exception:
                        if attempt == retries:
                            out += [None] * len(part)
                        else:
                            time.sleep(min(2**attempt, 10) * 0.01)
            yield pdf.assign(**{output: pd.Series(out, dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{output}` string"
    return df.mapInPandas(run, schema)


def graded(df: DataFrame, output: str = "output", gold: str = "answer_number") -> DataFrame:
    """Adds prediction, gold_number (number texts) and correct."""
    rows = df.withColumn("prediction", answers.extract(nfkc(plain(F.col(output))))).withColumn("gold_number", answers.readable(nfkc(plain(F.col(gold)))))
    return rows.withColumn("correct", answers.equal(F.col("prediction"), F.col("gold_number")))


def accuracy(df: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(total, correct, accuracy) over graded rows and those an earlier run has graded; zero of none."""
    rows = df.select("correct") if done is None else df.select("correct").unionByName(done.select("correct"))
    right = F.coalesce(F.col("correct"), F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.coalesce(F.avg(right.cast("int")), F.lit(0.0)).alias("accuracy"))


def prepared(df: DataFrame, query: str, answer: str, order: str) -> DataFrame:
    """(row_id, query, answer) of the rows with a short answer: numbered by order, both texts stripped, nothing else kept."""
    kept = df.where(short_answer(F.col(answer))).select(F.col(order).alias("_o"), strip(F.col(query)).alias("query"), strip(F.col(answer)).alias("answer"))
    return row_ids(kept, "_o").select("row_id", "query", "answer")
