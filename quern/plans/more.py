"""Registered queries on files, rendering of nested records, estimates, reports and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quern.functions import answers, schedules, text, tokens
from quern.operators import chat, chunks, mixing, ordering, packing, questions
from quern.plans import catalogue as base
from quern.plans.registry import query
from quern.sources import configs, manifests, tables
from quern.sources.shared import fresh_dir
from quern.sources.tables import Source, stream_table, table
from quern.streaming import packer

U, STRIDE = base.U, base.STRIDE


# Catalogues, configurations, prompts

_SOURCES = "s as (select source, lang, count(*) n, row_number() over (partition by lang order by source) - 1 i from documents where source is not null and lang is not null group by source, lang)"


def _lists(spark, sf) -> dict[str, list[Source]]:
    """A list of sources for each language: a catalogue, so as many rows as it has entries."""
    rows = base._docs(spark, sf).where("source is not null and lang is not null").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy("lang", "source").collect()
    out: dict[str, list[Source]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(Source(f"{r.source}/all of it!", config_name=f"_{r.lang}_", take_examples=r.n))
    return out


@query(f"with {_SOURCES} select lang as template, i::int ordinal, source || '/all of it!' as name, n take_examples, lpad(i::varchar, 2, '0') || '_' || source || '_all_of_it__' || lang || '__train' as alias from s")
def source_catalogue(spark, sf):
    """Named lists in a JSON file, resolved and given their aliases."""
    path = f"{fresh_dir(spark)}/lists.json"
    configs.write_text(spark, path, json.dumps({k: [vars(s) | {"newer": 1} for s in v] for k, v in _lists(spark, sf).items()}))
    lists = tables.read_templates(configs.read_text(spark, path))
    chosen = {k: tables.resolve([], k, lists, []) for k in lists}
    return tables.alias(tables.catalogue(spark, chosen)).select("template", "ordinal", "name", "take_examples", "alias")


@query(f"with {_SOURCES} select lang, source || '/all of it!' as name, n take_examples, 0::bigint skip_examples, 64 seq_len, 'kept' newer from s")
def saved_config_sources(spark, sf):
    """A configuration for each language, saved, changed, saved again and loaded: sources, known and unknown fields are there."""
    rows = []
    for lang, sources in _lists(spark, sf).items():
        path = f"{fresh_dir(spark)}/config.json"
        configs.save(spark, configs.Config({"model_config_path": "m.json", "seq_len": 7, "newer": "kept"}).changed(datasets=sources), path)
        configs.save(spark, configs.load(spark, path).changed(seq_len=64), path)
        config = configs.load(spark, path)
        rows += [(lang, s.name, s.take_examples, s.skip_examples, config.number("seq_len", 512), config.get("newer")) for s in config.sources()]
    return spark.createDataFrame(rows, "lang string, name string, take_examples long, skip_examples long, seq_len int, newer string")


@query("select key, value from (select source || '_take' as key, case when source < 'src15' then greatest(0, count(*) - 40) else 7 end as value from documents where source is not null group by source) union all select 'seed', 3")
def mix_overrides(spark, sf):
    """Takes by source over their defaults; a negative one is none, an unknown key is ignored."""
    counts = base._docs(spark, sf).where("source is not null").groupBy("source").agg(F.count("*").alias("n")).collect()  # a catalogue
    path = f"{fresh_dir(spark)}/mix.json"
    configs.write_text(spark, path, json.dumps({f"{r.source}_take": r.n - 40 for r in counts if r.source < "src15"} | {"seed": 3, "unknown": 9}))
    got = configs.load_mix(spark, path, {f"{r.source}_take": 7 for r in counts} | {"seed": 42})
    return spark.createDataFrame(sorted(got.items()), "key string, value long")


@query(r"with p as (select item_id, case when item_id % 5 = 0 then '' else regexp_replace(text, '^\s+|\s+$', '', 'g') end x from benchmark) select row_number() over (order by item_id) - 1 place, x prompt from p where x <> ''")
def given_prompts(spark, sf):
    """Benchmark texts as prompts, every fifth one blank."""
    rows = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, " \n").otherwise(F.concat(F.lit("\t"), "text", F.lit(" "))).alias("text"))
    return tables.prompts_of(rows, "item_id", "text")


# Files

_M = base._SHARDS + ", t as (select source, sum(token_count) total from m group by 1)"


def _written_mix(spark, sf) -> str:
    folder = fresh_dir(spark)
    shards = packing.manifest(base._shards(spark, sf), "source")
    seen = base._docs(spark, sf).groupBy("source").agg(F.count("*").alias("total_records_seen"))
    totals = shards.groupBy("source").agg(F.sum("token_count").alias("total"), F.lit(-1).alias("take"))
    manifests.write_manifests(packing.source_manifest(shards, seen, "source").withColumnRenamed("source", "name"), packing.mix_manifest(totals, "source", "take", "total", 42), folder)
    return folder


@query(_M + " select source as name, 'sources/name=' || source manifest, printf('data-%05d.bin', shard) bin_file, token_count, doc_count from m")
def mix_manifest_shards(spark, sf):
    """Manifests written, reread, and joined: entry, its manifest, its shards."""
    return manifests.mix_shards(spark, _written_mix(spark, sf))


@query(_M + " select sum(token_count)::bigint total_tokens from m")
def mix_total_tokens(spark, sf):
    return manifests.total_tokens(spark, _written_mix(spark, sf))


@query(_M + " select source, printf('data-%05d.idx', shard) idx_file, token_count from m")
def source_manifest_shards(spark, sf):
    return tables.manifest_shards(spark, f"{_written_mix(spark, sf)}/sources").select("source", "idx_file", "token_count")


@query(_M + f", k as (select source, shard, chunk, source || '/' || shard || '/' || chunk key from c) select source, shard, chunk, row_number() over (order by {U.format(chr(39) + '7:' + chr(39) + ' || key')}) - 1 pos from k")
def sample_index_rebuilt(spark, sf):
    """Another seed than the written one: the order is made anew."""
    shards, folder = packing.manifest(base._shards(spark, sf), "source"), fresh_dir(spark)
    manifests.write_index(manifests.sample_order(shards, STRIDE - 1, 42, ["source", "shard"]), folder, STRIDE - 1, 42)
    return manifests.read_index(spark, folder, STRIDE - 1, 7, shards, ["source", "shard"]).select("source", "shard", "chunk", "pos")


@query("select order_id step, (1.0 / (1 + order_id))::double ce_loss, total from (select o_orderkey order_id, o_totalprice total from orders)")
def training_log(spark, sf):
    """A metric log, written in two appends and read strictly."""
    path = f"{fresh_dir(spark)}/log"
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.lit(0.1).alias("learning_rate"), (1.0 / (1 + F.col("o_orderkey"))).alias("ce_loss"), F.lit(0.0).alias("ratio_loss"), F.lit(0.0).alias("byte_boundary_loss"), F.col("o_totalprice").alias("total_loss"))
    tables.write_metrics(rows.where("step % 2 = 0"), path, append=False)
    tables.write_metrics(rows.where("step % 2 = 1"), path)
    return tables.read_metrics(spark, path).select("step", "ce_loss", F.col("total_loss").alias("total"))


@query("select o_orderkey step, case when o_orderkey % 3 = 0 then 'NaN'::double else o_totalprice end validation_bpb from orders")
def validation_log(spark, sf):
    """Blank cells read as NaN."""
    path = f"{fresh_dir(spark)}/log"
    names = [f.split()[0] for f in tables.VALIDATION_METRICS.split(", ")]
    blank = {n: F.lit(None).cast("string").alias(n) for n in names}
    have = {"step": F.col("o_orderkey").alias("step"), "validation_batches": F.lit(1).alias("validation_batches"), "validation_bpb": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("validation_bpb")}
    tables.write_metrics(table(spark, sf, "orders").select(*(blank | have).values()), path)
    return tables.read_metrics(spark, path, tables.VALIDATION_METRICS, strict=False).select("step", "validation_bpb")


@query("select event_id, event_type from events")
def appended_records(spark, sf):
    """At-least-once appends with a skip by id: parts that overlap and repeat leave each record once."""
    rows, path = table(spark, sf, "events").select("event_id", "event_type"), f"{fresh_dir(spark)}/records"
    tables.append_new(rows.where("event_id % 3 <> 1"), path, "event_id")
    tables.append_new(rows.where("event_id % 3 <> 1"), path, "event_id")
    tables.append_new(rows.unionAll(rows), path, "event_id")
    to = f"{fresh_dir(spark)}/parquet"
    tables.records_to_parquet(spark, path, to, "event_id long, event_type string")
    return spark.read.parquet(to)


@query("select count(*) total, count(*) filter (event_type = 'view') as correct, round(avg((event_type = 'view')::int), 9) accuracy from events")
def results_summary(spark, sf):
    """Results and their summary, written and reread."""
    path = f"{fresh_dir(spark)}/results"
    rows = table(spark, sf, "events").select("event_id", (F.col("event_type") == "view").alias("correct"))
    tables.write_results(rows, questions.accuracy(rows), path)
    return tables.read_done(spark, f"{path}.summary", "total long, correct long, accuracy double").withColumn("accuracy", F.round("accuracy", 9))


@query("select count(*) seen, count(*) filter (text <> '') used, count(*) n from documents")
def observed_progress(spark, sf):
    df, counts = tables.progress(base._docs(spark, sf), "progress", seen=F.count("*"), used=F.count_if(F.col("text") != ""))
    df.write.format("noop").mode("overwrite").save()
    got = counts.get
    return spark.createDataFrame([(got["seen"], got["used"], got["seen"])], "seen long, used long, n long")


# Records and bytes


@query("""select doc_id, 'user: ' || source || chr(10) || lang || chr(10) || chr(10) || '{"a": 1, "b": "' || lang || '", "z": null}' || chr(10) || chr(10) || source || chr(10) || 'x' || chr(10) || chr(10) || 'c:' || doc_id record from documents""")
def nested_record_render(spark, sf):
    """Dialogues, structs, lists and lists of lists in one record; the keys by priority."""
    s = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    chat_ = s(messages=F.array(s(role=F.lit("user"), content=F.col("source")), s(role=F.lit(""), content=F.concat(F.col("lang"), F.lit(" "))), s(role=F.lit("user"), content=F.lit("  "))), content=F.lit("not this"))
    rows = base._docs(spark, sf).select(
        "doc_id",
        chat_.alias("text"),
        s(z=F.lit(None).cast("string"), b=F.col("lang"), a=F.lit(1)).alias("content"),
        F.array(F.array(F.col("source"), F.lit(" ")), F.array(F.lit("x"))).alias("output"),
        s(content=s(text=F.concat(F.lit("c:"), F.col("doc_id").cast("string")), other=F.lit(2))).alias("input"),
        F.lit("unused").alias("extra"),
    )
    return rows.select("doc_id", text.record_text(rows, exclude=("doc_id",)).alias("record"))


@query("select doc_id, 'true' || chr(10) || chr(10) || (doc_id * 0.5)::double::varchar || chr(10) || chr(10) || doc_id record from documents")
def scalar_record_render(spark, sf):
    """No known key: all public columns in order, rendered as scalars."""
    rows = base._docs(spark, sf).select(F.lit(True).alias("flag"), F.lit("no").alias("_hidden"), (F.col("doc_id") * 0.5).alias("half"), F.lit(None).cast("string").alias("none"), F.col("doc_id").alias("id"))
    return rows.select("id", text.record_text(rows).alias("record")).withColumnRenamed("id", "doc_id")


@query("select doc_id, md5(text) digest from documents")
def incremental_decode(spark, sf):
    """Seven-byte pieces, cut within characters, as whole text again."""
    hexed = base._docs(spark, sf).select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("h"))
    cut = hexed.select("doc_id", F.posexplode(F.regexp_extract_all("h", F.lit("(.{1,14})"), 1)).alias("at", "piece"))
    whole = tokens.assembled_text(cut.select("doc_id", "at", F.unhex("piece").alias("piece")), "doc_id", "at", "piece")
    # A text without bytes has no pieces.
    return hexed.where("h = ''").select("doc_id", F.lit("").alias("text")).unionByName(whole).select("doc_id", F.md5("text").alias("digest"))


@query("select doc_id, md5(text) strict, md5(text || '�') replaced from documents")
def decoded_bytes(spark, sf):
    raw = tokens.encode(F.col("text"), False, False)
    return base._docs(spark, sf).select("doc_id", F.md5(tokens.decode(raw)).alias("strict"), F.md5(tokens.decode(F.concat(raw, F.unhex(F.lit("FF"))), replace=True)).alias("replaced"))


# Order


@query(f"select doc_id, row_number() over (order by {U.format(chr(39) + '11:' + chr(39) + ' || doc_id')}, doc_id) - 1 place from documents")
def seeded_shuffle(spark, sf):
    docs = base._docs(spark, sf).select("doc_id")
    return ordering.running(docs, ordering.uniform("doc_id", seed=11), F.lit(1), "place")


@query("select doc_id, (row_number() over (order by doc_id) - 1) % 3 worker from documents")
def worker_shares(spark, sf):
    return ordering.shares(base._docs(spark, sf).select("doc_id"), "doc_id", 3)


@query(f"with p as (select doc_id, row_number() over (order by {U.format(chr(39) + '3:' + chr(39) + ' || doc_id')}) - 1 pos from documents) select doc_id, pos from p where pos >= 5 * 16")
def resumed_batches(spark, sf):
    return ordering.resume(ordering.permutation(base._docs(spark, sf).select("doc_id"), "doc_id", 3), "pos", 5, 16)


@query("select doc_id from documents order by doc_id limit 4 * 8")
def validation_batches(spark, sf):
    return ordering.first_batches(base._docs(spark, sf).select("doc_id"), "doc_id", 4, 8)


@query("select event_id, event_type || ':' || props \"output\" from events")
def zipped_outputs(spark, sf):
    """A model's outputs, met with their items by place; the model is any function of texts."""
    items = table(spark, sf, "events").select("event_id", "event_type", F.col("props").alias("prompt"))
    said = questions.scored(items.select("event_id", "prompt"), lambda batch: [":" + p for p in batch]).select("event_id", "output")
    out = mixing.zip_outputs(items, said, "event_id")
    return out.select("event_id", F.concat("event_type", "output").alias("output"))


@query("select event_id, case when event_id % 3 = 0 then event_id else 0 end step from events")
def typed_step(spark, sf):
    """An optional field of a record: its number if it is one, else zero."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, "x")
    return table(spark, sf, "events").select("event_id", F.coalesce(raw.try_cast("long"), F.lit(0)).alias("step"))


# Answers


@query("select event_id, case when event_id % 5 = 4 then '' else substr('ABCD', (event_id % 5 + 1)::int, 1) end letter from events")
def external_answers(spark, sf):
    said = F.concat(F.lit("why\n答え："), F.when(F.col("event_id") % 5 == 4, F.lit("?")).otherwise(F.substring(F.lit("ABCD"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1))), F.lit("\nend"))
    return table(spark, sf, "events").select("event_id", answers.external(said, r"(?s)答え[:：]\s*([A-D])").alias("letter"))


@query("select doc_id, '{\"a\": {\"b\": ' || doc_id || '}}' object from documents")
def json_objects(spark, sf):
    raw = F.concat(F.lit('```json\nsure: {"a": {"b": '), F.col("doc_id").cast("string"), F.lit("}} done\n```"))
    return base._docs(spark, sf).select("doc_id", text.json_object(raw).alias("object"))


@query("select doc_id, case when source < 'src2' then null else source end kept, case when source < 'src2' then 'unusable distractors' end error from documents")
def distractor_records(spark, sf):
    raw = F.when(F.col("source") < "src2", F.lit("none")).otherwise(F.lit('{"wrong_answers": ["x", "y", "z"]}'))
    good, bad = questions.distractor_rows(base._docs(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("lang").alias("query"), F.col("source").alias("answer"), raw.alias("raw_output")))
    return good.select(F.col("row_id").alias("doc_id"), F.col("answer").alias("kept"), F.lit(None).cast("string").alias("error")).unionByName(bad.select(F.col("row_id").alias("doc_id"), F.lit(None).cast("string").alias("kept"), "error"))


@query("select n n_messages from (select conv_id, count(*) n, arg_max(role, turn) last_role, bool_or(role = 'user') u from conversations where trim(text) <> '' group by 1) where n >= 2 and last_role = 'assistant' and u")
def mapped_dialogues(spark, sf):
    """A source's own mapper, then validity."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("l"))
    return chat.mapped(rows, lambda d: d.select(chat.normalise(F.col("l")).alias("messages"))).select(F.size("messages").cast("long").alias("n_messages"))


# Boundaries, losses, schedules


@query(base._ROUTE + ", e as (select label, vec_id, p, vec_id % 3 = 0 w from b) select label, round(coalesce(sum(p) filter (w), 0) / greatest(count(*) filter (w), 1), 6) penalty from e group by 1")
def byte_boundary_penalty(spark, sf):
    weight = F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(0.0)
    return base._routed(spark, sf).groupBy("label").agg(F.round(chunks.continuation_penalty(F.col("p"), weight), 6).alias("penalty"))


@query(base._ROUTE + ", a as (select label stage, avg(is_boundary::int) f, avg(p) g, case when label = 0 then 4.0 else 3.0 end n from b where label is not null group by 1) select round(avg(((1 - f) * (1 - g) + f * g * (n - 1)) * n / (n - 1)), 6) loss from a")
def clamped_ratio_loss(spark, sf):
    """Later stages use the last target."""
    a = base._routed(spark, sf).where("label is not null").groupBy("label").agg(F.avg(F.col("is_boundary").cast("int")).alias("f"), F.avg("p").alias("g"))
    return chunks.ratio_loss(a, "label", "f", "g", [4.0, 3.0]).select(F.round("loss", 6).alias("loss"))


@query("select l_orderkey step, round(avg(l_quantity), 6) ce_loss, round(avg(l_discount), 6) ratio_loss, round(avg(l_tax), 6) byte_boundary_loss, round(avg(l_quantity) + 0.02 * avg(l_discount) + 0.05 * avg(l_tax), 6) total_loss from lineitem group by 1")
def micro_batch_losses(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_quantity").alias("ce_loss"), F.col("l_discount").alias("ratio_loss"), F.col("l_tax").alias("byte_boundary_loss"))
    out = chunks.step_losses(rows, "step", 0.02, 0.05)
    return out.select("step", *[F.round(c, 6).alias(c) for c in ("ce_loss", "ratio_loss", "byte_boundary_loss", "total_loss")])


@query("select 'bounded' which, sum(n)::bigint examples, (sum(n) // 24)::bigint steps from (select count(*) n from documents group by source) union all select 'unbounded', null, null")
def document_steps(spark, sf):
    takes = base._docs(spark, sf).groupBy("source").agg(F.count("*").alias("take"))
    open_end = takes.withColumn("take", F.when(F.col("source") == F.lit("src0"), -1).otherwise(F.col("take")))
    parts = [packing.document_estimate(t, "take", 8, 3).select(F.lit(w).alias("which"), "examples", "steps") for w, t in (("bounded", takes), ("unbounded", open_end))]
    return parts[0].unionByName(parts[1])


@query(base._ROUTE + " select label, vec_id, sum((vec_id % 7 = 0)::int) over (partition by label order by vec_id rows unbounded preceding)::bigint segment from b")
def segment_ids(spark, sf):
    return chunks.segments(base._routed(spark, sf), "label", "vec_id", F.col("vec_id") % 7 == 0).select("label", "vec_id", "segment")


@query("select vec_id, (vec_id % 10) / 10.0 p, vec_id % 10 > 5 is_boundary from embeddings")
def injected_boundaries(spark, sf):
    """A boundary model that is any function of a batch of rows."""
    rows = table(spark, sf, "embeddings").select("vec_id")
    return chunks.boundaries(chunks.predicted(rows, lambda pdf: pdf["vec_id"] % 10 / 10))


@query("select item_id, '[' || array_to_string(string_split(text, ' '), '], [') || ']' line from benchmark")
def bracketed_chunks(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("chunk", "w"))
    return chunks.chunk_report(rows, "item_id", "chunk", F.col("w"))


@query("""with k as (select item_id, text, row_number() over (order by item_id) i, count(*) over () n from benchmark where trim(text) <> ''),
l as (select '[' || i || '/' || n || ']' || chr(10) || 'Input prompt: ' || text || chr(10) || 'stage0: [' || replace(text, ' ', '], [') || ']' || chr(10) || 'stage1: [' || text || ']' || case when i < n then chr(10) else '' end line from k)
select line, count(*) n from (select unnest(string_split(line, chr(10))) line from l) group by 1""")
def chunk_report_file(spark, sf):
    """The report of a validation step, written as one text file and reread by line."""
    rows = table(spark, sf, "benchmark").select("item_id", "text", F.concat(F.lit("["), F.replace("text", F.lit(" "), F.lit("], [")), F.lit("]")).alias("stage0"), F.concat(F.lit("["), "text", F.lit("]")).alias("stage1"))
    path = chunks.write_report(chunks.report_lines(rows, "item_id", "text", ["stage0", "stage1"]), "item_id", fresh_dir(spark), 500)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("select p_partkey, stage, round(sqrt(4.6 / (case stage when 0 then 1.0 when 1 then r else r * 3.0 end) * (8.0 * w / (case stage when 0 then w when 1 then 2.0 * w else 8.0 * w end))), 9) factor from (select p_partkey, (p_size % 4 + 1)::double r, (p_size + 1)::double w from part), range(3) s(stage)")
def stage_rates(spark, sf):
    """Rates of three levels, for each row's ratios and widths."""
    w = (F.col("p_size") + 1).cast("double")
    ratios, widths = [(F.col("p_size") % 4 + 1).cast("double"), F.lit(3.0), F.lit(2.0)], [w, w * 2, w * 8]
    rates = F.posexplode(F.array(*[schedules.stage_multiplier(ratios, widths, i) for i in range(3)])).alias("stage", "factor")
    return table(spark, sf, "part").select("p_partkey", rates).select("p_partkey", F.col("stage").cast("long").alias("stage"), F.round("factor", 9).alias("factor"))


@query("select o_orderkey, case when n >= 1e9 then printf('%.2fB', n / 1e9) when n >= 1e6 then printf('%.2fM', n / 1e6) else format('{:,}', n::bigint) end shown from (select o_orderkey, floor(o_totalprice * power(10, o_orderkey % 5)) * 10 + 3 n from orders)")
def parameter_counts(spark, sf):
    n = F.floor(F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 5)) * 10 + 3
    return table(spark, sf, "orders").select("o_orderkey", schedules.parameter_count(n).alias("shown"))


@query("select p_partkey, 'M' || p_size || ' T2 m1' shown from part")
def layout_letters(spark, sf):
    found = schedules.layout_parts(F.concat(F.lit("M"), F.col("p_size").cast("string"), F.lit("T2m1")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: F.concat(x["letter"], x["count"].cast("string"))), " ").alias("shown"))


# Streams


@query("select conv_id::varchar conv_id, md5(string_agg(text, '' order by turn)) digest from conversations group by 1")
def stream_decode(spark, sf):
    """Turns as a byte stream per conversation, each cut within its last character's bytes where it has several."""
    stream = stream_table(spark, sf, "conversations")
    parts = F.array(F.struct((F.col("turn") * 2).alias("pos"), F.expr("substring(encode(text, 'UTF-8'), 1, octet_length(text) - 1)").alias("data")), F.struct((F.col("turn") * 2 + 1).alias("pos"), F.expr("substring(encode(text, 'UTF-8'), greatest(1, octet_length(text)), 1)").alias("data")))
    pieces = stream.select("conv_id", F.explode(parts).alias("x")).select("conv_id", "x.*")
    out = packer.run_to_end(packer.decode_stream(pieces, "conv_id", "pos", "data"), fresh_dir(spark), "text")
    whole = out.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    return whole.select("conv_id", F.md5(F.array_join(F.transform("l", lambda x: x["text"]), "")).alias("digest"))


@query(base._ROUTE + ", f as (select label, vec_id, r, least(1 - 1e-4, greatest(1e-4, p)) * x z from p where r = 1 union all select p.label, p.vec_id, p.r, least(1 - 1e-4, greatest(1e-4, p.p)) * p.x + (1 - least(1 - 1e-4, greatest(1e-4, p.p))) * f.z from f join p on p.label = f.label and p.r = f.r + 1) select label::varchar label, vec_id, round(z, 6) z from f")
def stream_smooth(spark, sf):
    folder = fresh_dir(spark)
    rows = base._routed(spark, sf).select("label", "vec_id", F.element_at("embedding", 1).cast("double").alias("x"), "p").where("label is not null")
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    out = packer.run_to_end(packer.smooth_stream(stream, "label", "vec_id", "x", "p"), folder, "z")
    return out.select("label", F.col("pos").alias("vec_id"), F.round("z", 6).alias("z"))
