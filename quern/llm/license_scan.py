"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

A template of T five-word shingles is looked for in windows of 2T - 1 shingles, one every T shingles, so each
occurrence lies whole within a window. A window that holds at least 0.8 of a template has a Jaccard similarity
of at least 0.8 T / (2T - 1 + 0.2 T) > 0.36 with it; with BANDS = 32 bands of one MinHash each, it shares no band
with a chance below 1e-6. A band is shared exactly if the template's least shingle of that band is in the window
and is the window's least, too. So windows are built only around those shingles (a bounded set), and
their minima compared: the windows retrieved are those that building every window would retrieve. Exact shingle containment
then verifies.

Words are the lower-cased runs of letters and digits. Defined cases: null or short texts match nothing; templates
below five words are refused; repeated rows count once per doc_id; null doc_ids are a group of their own; an empty
table gives an empty result; further columns are ignored. Templates are a parameter of at most
MOST_TEMPLATES texts of at most MOST_WORDS words, so what is broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, BANDS, CONTAINED, MOST_TEMPLATES, MOST_WORDS = 5, 32, 0.8, 2_000, 2_000

#: Well-known license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def shingles(tokens: Column) -> Column:
    """Hashes of the five-word shingles in order; none for fewer words."""
    return F.when(F.size(tokens) >= WORDS, F.transform(F.sequence(F.lit(1), F.size(tokens) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(tokens, i, WORDS)))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(tokens: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(tokens) - (WORDS - 1)), lambda i: F.array_join(F.slice(tokens, i, WORDS), " "))


def template_bands(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template_id, band, least, n, texts): each template's least shingle by band; n shingles and their texts."""
    if len(templates) > MOST_TEMPLATES or any(len(t.split()) > MOST_WORDS for t in templates.values()):
        raise ValueError("more or longer templates than the bound allows")
    rows = F.array(*[F.struct(F.lit(k).alias("template_id"), F.lit(t).alias("text")) for k, t in sorted(templates.items())])
    one = spark.range(1).select(F.explode(rows).alias("r")).select("r.template_id", words(F.col("r.text")).alias("w"))
    one = one.withColumn("h", F.array_distinct(shingles(F.col("w")))).withColumn("n", F.when(F.size("h") > 0, F.size("h")).otherwise(F.raise_error("a template has fewer than five words")))
    least = lambda j: F.array_min(F.transform("h", lambda x: F.struct(F.xxhash64(x, j).alias("b"), x.alias("x"))))["x"]
    bands = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.struct(j.alias("band"), least(j).alias("least")))
    return one.select("template_id", "n", F.array_distinct(shingle_texts(F.col("w"))).alias("texts"), F.explode(bands).alias("b")).select("template_id", "b.band", "b.least", "n", "texts")


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, template_id, containment, n_windows, first_word), a row per pair found.

    containment: the best window's share of the template's shingles; first_word: the first such window's first word, from 0.
    """
    spark = docs.sparkSession
    rows = template_bands(spark, templates or TEMPLATES).collect()  # at most MOST_TEMPLATES * BANDS
    # As plain rows: the plan that made them need not be compiled into the scan again.
    bands = spark.createDataFrame([(r.least, r.template_id, r.band, r.n) for r in rows], "least long, template_id string, band int, n int")
    texts = spark.createDataFrame([(r.template_id, r.n, r.texts) for r in rows if r.band == 1], "template_id string, n int, texts array<string>")
    least = F.array(*[F.lit(v) for v in sorted({r.least for r in rows})])
    most = 2 * max(r.n for r in rows)
    # Generators hold words and shingles apart from what follows: else the optimizer would copy the splitting into each use.
    found = docs.select("doc_id", F.explode(F.array(words(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("w"))
    found = found.select("doc_id", "w", F.explode(F.array(shingles(F.col("w")))).alias("h"))
    # Texts without any of the templates' least shingles share no band with them.
    found = found.where(F.arrays_overlap("h", least))
    # Long texts go on in stretches, so that what is sliced for all hits of one row is bounded by the templates' size.
    stretch, low = 2 * most, lambda at: F.greatest(F.lit(0), at - most)
    part = lambda at: F.struct(at.alias("at"), low(at).alias("low"), F.slice("h", low(at) + 1, stretch + 2 * most).alias("h"), F.slice("w", low(at) + 1, stretch + 2 * most + WORDS - 1).alias("w"))
    found = found.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - 1, F.lit(stretch)), part)).alias("p")).select("doc_id", "p.*")
    found = found.withColumn("own", F.array_intersect(F.slice("h", F.col("at") - F.col("low") + 1, stretch), least)).where(F.size("own") > 0)
    hits = F.filter(F.transform(F.slice("h", F.col("at") - F.col("low") + 1, stretch), lambda x, i: F.struct(x.alias("least"), (i + F.col("at")).alias("pos"))), lambda s: F.array_contains("own", s["least"]))
    near = F.transform(hits, lambda s: F.struct(s["least"].alias("least"), s["pos"].alias("pos"), low(s["pos"]).alias("low"), F.slice("h", low(s["pos"]) - F.col("low") + 1, 2 * most + 1).alias("h"), F.slice("w", low(s["pos"]) - F.col("low") + 1, 2 * most + WORDS).alias("w")))
    found = found.select("doc_id", F.explode(near).alias("s")).select("doc_id", "s.*")
    found = found.join(F.broadcast(bands), "least")
    width = 2 * F.col("n") - 1
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - width + 1) / F.col("n")).cast("int"))
    found = found.withColumn("win", F.explode(F.sequence(first, F.expr("int(pos div n)"))))
    start = F.col("win") * F.col("n")
    window = F.slice("h", start - F.col("low") + 1, width)
    shared = F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.col("band")))) == F.xxhash64("least", "band")
    found = found.where(shared).select("doc_id", "template_id", start.cast("long").alias("start"), F.array_join(F.slice("w", start - F.col("low") + 1, width + (WORDS - 1)), " ").alias("passage")).distinct()
    # Exact verification on the shingles themselves.
    found = found.join(F.broadcast(texts), "template_id")
    share = F.size(F.array_intersect("texts", shingle_texts(F.split("passage", " ")))) / F.col("n")
    found = found.withColumn("share", share).where(F.col("share") >= CONTAINED)
    return found.groupBy("doc_id", "template_id").agg(F.max("share").alias("containment"), F.countDistinct("start").alias("n_windows"), F.min("start").alias("first_word"))


def oracle() -> str:
    """The same over every window of every text, without MinHash."""
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in sorted(TEMPLATES.items()))
    tokens = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"""
with tpl(template_id, text) as (values {values}),
tw as (select template_id, {tokens} w from tpl),
ts as (select distinct template_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) sh from tw),
tn as (select template_id, count(*) n from ts group by 1),
d as (select doc_id, {tokens} w from documents where text is not null),
p as (select doc_id, w, unnest(range(0, len(w) - 4)) pos from d where len(w) >= 5),
m as (select p.doc_id, ts.template_id, p.pos, ts.sh, tn.n from p join ts on ts.sh = array_to_string(p.w[p.pos+1:p.pos+5], ' ') join tn using (template_id)),
k as (select doc_id, template_id, sh, n, unnest(range(greatest(0, ceil((pos - (2 * n - 1) + 1) / n)::bigint), pos // n + 1)) win from m),
c as (select doc_id, template_id, win * n start, count(distinct sh) / n share from k group by doc_id, template_id, win, n)
select doc_id, template_id, max(share) containment, count(*) n_windows, min(start)::bigint first_word
from c where share >= {CONTAINED} group by 1, 2"""
