"""Dialogues: one ``messages`` schema from many source shapes, validity, system prompts, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import bound, plain, stays, strip
from quern.operators.ordering import uniform

MESSAGES = "array<struct<role:string,content:string>>"
#: Role names of the sources.
ROLES = {"human": "user", "user": "user", "assistant": "assistant", "gpt": "assistant", "system": "system"}
TOOL_ROLES = {"user": ("user", "{}"), "assistant": ("assistant", "{}"), "tool": ("user", "<tool_response>\n{}\n</tool_response>")}
CALL_ROLES = {"human": ("user", "{}"), "gpt": ("assistant", "{}"), "function_call": ("assistant", "<tool_call>\n{}\n</tool_call>"), "observation": ("user", "<tool_response>\n{}\n</tool_response>")}
#: What separates reasoning from the answer, by priority.
ANSWER_MARKS = (r"(?s)\n(?:最終)?(?:回答|答え)\s*[:：]\s*(.+)$", r"(?s)\n####\s*(.+)$", r"(?is)\nFinal\s+Answer\s*[:：]\s*(.+)$")
#: Prompt formats of the sources.
INSTRUCTION_TEXT = "### 指示\n質問に対して、回答を出力してください。\n\n### 入力:\n質問: {}\n### 応答:\n"
INSTRUCTION_INPUT = "### 指示\n{}\n\n### 入力: {}\n### 応答:\n"
FEW_SHOT_HEAD, FEW_SHOT_ITEM, FEW_SHOT_TAIL = "### 指示\n質問に対して、回答を出力してください。\n\n<examples>\n", "<example{}>\n### 入力:\n質問: {}\n### 応答:\n{}\n</example{}>\n", "</examples>\n\n### 入力:\n質問: {}\n### 応答:\n"
CHOICE = "与えられた選択問題に答えてください。回答の最後の行に「答え：A/B/C/D」のように出力してください（例：「答え：A」）。\n\n質問：{}\n選択肢: A:{}, B:{}, C:{}, D:{}\n"
CHOICE_ANSWER = "答え: "


def fill(template: str, *values: Column | str) -> Column:
    """The template with its {} replaced by columns in turn."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:], strict=True):
        out += [plain(v) if isinstance(v, Column) else F.lit(str(v)), F.lit(p)]
    return F.concat(*out)


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _mapped(role: Column, names: dict[str, str], strict: bool) -> Column:
    low = F.lower(strip(plain(role)))
    out = F.when(F.lit(False), F.lit(""))
    for k, v in names.items():
        out = out.when(low == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported role: "), low)).cast("string") if strict else F.lit(None))


def normalise(raw: Column, role: str = "role", content: str = "content", strict: bool = True, empty: bool = False) -> Column:
    """Known roles, stripped contents, blank messages dropped; an unknown role fails, or is dropped if not strict.

    With ``empty``, here and in the mappers below, a message without any content keeps its turn; one of mere white space is dropped still.
    """
    all_ = F.transform(raw, lambda m: message(_mapped(m[role], ROLES, strict), plain(m[content])))
    kept = F.filter(all_, lambda m: stays(m["content"], empty) & m["role"].isNotNull())
    return F.transform(kept, lambda m: message(m["role"], strip(m["content"])))


def valid(messages: Column) -> Column:
    """At least two messages, the last by the assistant, some by the user."""
    return F.coalesce((F.size(messages) >= 2) & (F.try_element_at(messages, F.lit(-1))["role"] == "assistant") & F.exists(messages, lambda m: m["role"] == "user"), F.lit(False))


def with_system(messages: Column, think: bool = False, prompt: str = "") -> Column:
    """The thinking switch goes to the end of the first system message, or into a new one."""
    switch = "/think" if think else "/no_think"
    new = f"{prompt}\n{switch}".strip() if prompt else switch

    def led(m: Column) -> Column:
        merged = bound(strip(F.try_element_at(m, F.lit(1))["content"]), lambda own: F.when(own == "", F.lit(switch)).otherwise(F.concat(own, F.lit("\n" + switch))))
        has = F.coalesce(F.try_element_at(m, F.lit(1))["role"] == "system", F.lit(False))
        return F.when(has, F.concat(F.array(message("system", merged)), F.slice(m, 2, F.greatest(F.size(m), F.lit(1))))).otherwise(F.concat(F.array(message("system", F.lit(new))), m))

    return bound(messages, led)


def think_format(text: Column, empty: bool = False) -> Column:
    """<think> block and answer, where an answer mark splits the text into two non-empty parts; with ``empty``, also where the text begins with a mark."""
    both = lambda p: F.concat(F.lit("<think>\n"), p["thought"], F.lit("\n</think>\n\n"), p["answer"])

    def marked(t: Column, mark: str, led: bool = True) -> Column:
        parts = F.struct(strip(F.regexp_extract(t, mark, 1)).alias("answer"), strip(F.regexp_replace(t, mark, "")).alias("thought"))
        return F.when(t.rlike(mark), bound(parts, lambda p: F.when((p["answer"] != "") & ((p["thought"] != "") if led else (p["thought"] == "")), both(p))))

    whole = lambda t: F.when(F.contains(t, F.lit("<think>")) & F.contains(t, F.lit("</think>")), t)
    bare = lambda t: [marked(F.concat(F.lit("\n"), t), mark, False) for mark in ANSWER_MARKS] if empty else []
    return bound(strip(text), lambda t: F.coalesce(whole(t), *[marked(t, mark) for mark in ANSWER_MARKS], *bare(t), t))


def _dialogue(user: Column, assistant: Column, prompt: str) -> Column:
    return with_system(F.array(message("user", user), message("assistant", assistant)), False, prompt)


def _tagged(raw: Column, names: dict[str, tuple[str, str]], empty: bool) -> Column:
    def one(m: Column) -> Column:
        low, value = F.lower(strip(plain(m["from"]))), strip(plain(m["value"]))
        text = F.when(F.lit(False), F.lit(""))
        for k, (_, form) in names.items():
            text = text.when(low == k, fill(form, value))
        return message(_mapped(m["from"], {k: r for k, (r, _) in names.items()}, True), text)

    return F.transform(F.filter(raw, lambda m: stays(plain(m["value"]), empty)), one)


def _system(prompt: str, *parts: Column) -> Column:
    """Non-empty parts after the prompt, one a line."""
    all_ = F.array(F.lit(prompt.strip()), *parts)
    return message("system", strip(F.array_join(F.filter(all_, lambda x: x != ""), "\n")))


def _tools(c: Column) -> Column:
    """Tools JSON in its tags; empty without tools. The JSON text passes through as it is stored."""
    t = plain(c)
    return F.when(t.isin("", "[]", "null"), F.lit("")).otherwise(F.concat(F.lit("<tools>\n"), t, F.lit("\n</tools>")))


def _first(df: DataFrame, *names: str) -> Column:
    return next((F.col(n) for n in names if n in df.columns), F.lit(""))


def from_conversations(df: DataFrame, prompt: str = "", empty: bool = False) -> DataFrame:
    """conversations of (from, value) or (role, content); a frame without that column fails."""
    inner = df.schema["conversations"].dataType.elementType.names
    role, content = ("role", "content") if {"role", "content"} <= set(inner) else ("from", "value")
    return df.select(with_system(normalise(F.col("conversations"), role, content, empty=empty), False, prompt).alias("messages"))


def from_reasoning(df: DataFrame, prompt: str = "", empty: bool = False) -> DataFrame:
    out = F.transform(normalise(F.col("messages"), empty=empty), lambda m: message(m["role"], F.when(m["role"] == "assistant", think_format(m["content"], empty)).otherwise(m["content"])))
    return df.select(with_system(out, True, prompt).alias("messages"))


def from_messages(df: DataFrame, prompt: str = "", empty: bool = False) -> DataFrame:
    return df.select(with_system(normalise(F.col("messages"), empty=empty), False, prompt).alias("messages"))


def from_text_output(df: DataFrame, prompt: str = "") -> DataFrame:
    return df.select(_dialogue(fill(INSTRUCTION_TEXT, F.col("text")), F.col("output"), prompt).alias("messages"))


def from_instruction(df: DataFrame, prompt: str = "") -> DataFrame:
    return df.select(_dialogue(fill(INSTRUCTION_INPUT, F.col("instruction"), F.col("input")), plain(F.col("output")), prompt).alias("messages"))


def from_few_shot(df: DataFrame, prompt: str = "", shots: int = 4) -> DataFrame:
    items = [fill(FEW_SHOT_ITEM, str(i), F.col(f"example{i}_question"), F.col(f"example{i}_answer"), str(i)) for i in range(1, shots + 1)]
    user = F.concat(F.lit(FEW_SHOT_HEAD), *items, fill(FEW_SHOT_TAIL, F.col("question")))
    return df.select(_dialogue(user, F.col("answer"), prompt).alias("messages"))


def shuffled_choices(key: Column, seed: int = 0) -> Column:
    """The four choices of a question in an order drawn from seed, key and choice."""
    all_ = F.array(*[F.struct(uniform(key, F.lit(i), seed=seed).alias("u"), F.col(c).alias("choice")) for i, c in enumerate(("answer", "wrong_answer_1", "wrong_answer_2", "wrong_answer_3"))])
    return F.transform(F.array_sort(all_), lambda x: x["choice"])


def from_choices(df: DataFrame, key: Column, prompt: str = "", seed: int = 0) -> DataFrame:
    rows = df.withColumn("_c", shuffled_choices(key, seed))
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), F.array_position("_c", F.col("answer")).cast("int"))
    user = fill(CHOICE, F.col("query"), *[F.element_at("_c", i) for i in (1, 2, 3, 4)])
    return rows.select(_dialogue(user, F.concat(F.lit(CHOICE_ANSWER), letter), prompt).alias("messages"))


def from_inputs_targets(df: DataFrame, prompt: str = "") -> DataFrame:
    return df.select(_dialogue(strip(plain(F.col("inputs"))), strip(plain(F.col("targets"))), prompt).alias("messages"))


def english_only(df: DataFrame) -> DataFrame:
    return df.where(F.lower("language_code").isin("eng", "en"))


def from_single_call(df: DataFrame, prompt: str = "") -> DataFrame:
    tools = _tools(_first(df, "tools", "functions"))
    system = F.concat(F.lit(prompt.strip() + "\n/no_think"), F.when(tools == "", F.lit("")).otherwise(F.concat(F.lit("\n"), tools)))
    turns = [message("system", system), message("user", strip(plain(_first(df, "query", "question")))), message("assistant", strip(plain(_first(df, "answers", "answer", "response"))))]
    return df.select(F.array(*turns).alias("messages"))


def from_tool_turns(df: DataFrame, prompt: str = "", empty: bool = False) -> DataFrame:
    head = _system(prompt, strip(plain(_first(df, "system"))), F.lit("/no_think"))
    return df.select(F.concat(F.array(head), _tagged(F.col("conversations"), TOOL_ROLES, empty)).alias("messages"))


def from_function_calls(df: DataFrame, prompt: str = "", empty: bool = False) -> DataFrame:
    head = _system(prompt, strip(plain(_first(df, "system"))), F.lit("/no_think"), _tools(_first(df, "tools")))
    return df.select(F.concat(F.array(head), _tagged(F.col("conversations"), CALL_ROLES, empty)).alias("messages"))


def dialogues(turns: DataFrame, strict: bool = True) -> DataFrame:
    """(conv_id, messages) from one row per turn."""
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    return listed.select("conv_id", normalise(F.col("l"), "role", "text", strict).alias("messages"))


def render(messages: Column) -> Column:
    """One text with marked turns."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def mapped(df: DataFrame, mapper: Callable[[DataFrame], DataFrame], keep: Column | None = None) -> DataFrame:
    """(messages) of the valid dialogues a mapper makes of a source's rows; any function from frame to frame is a mapper."""
    out = mapper(df if keep is None else df.where(keep)).select("messages")
    return out.where(valid(F.col("messages")))
