"""Suffix-array dedup by bucket-pointer refinement.

Removes each byte that lies in a ``width``-byte string that also starts elsewhere in the corpus
(the same document included; overlaps count), judged on the input.

How the refinement runs. Every position has a bucket at depth 8 (its exact eight bytes). Its bucket
at twice a depth is named from its own bucket and the bucket at the later offset, so each update is
reused by the next one: 8, 16, 25, 50, 100, 200. Names are fingerprints, hence comparable between
tasks without a global rank. Buckets of one member leave as early as possible:

1. Of the ``width``-byte strings, each is owned by its leftmost least 50-byte bucket (its anchor), a
   choice that depends on the string alone. Strings of one anchor are a run; about eight successive runs, cut where an
   anchor's name says so, are a stretch. Stretches that agree as a whole repeat as a whole; one of each kind goes on
   to stand for them.
2. Runs whose anchor bucket has one member in the corpus leave: no string of theirs can repeat. Runs that
   agree as a whole (bucket names at their first and last string) repeat as a whole.
3. The rest is refined in pieces of 16 starts: a piece that agrees as a whole repeats; a piece whose
   common core occurs once leaves.
4. What remains is refined to single strings: those that agree in bucket identifier (depth 100) and in the identifier at the later
   offset (100 on) are one bucket of depth 200.

Refinement is by identifiers throughout, never by bytes: each is the name of a pair of identifiers, of a bucket and of the
one at a later offset. Where a suffix array sorts such pairs and ranks them, equal pairs meet here by aggregation on the pair (by its hash), as only equality
matters: pre-aggregated counts travel, and no rank has to be known to all. Two different strings are taken for equal
only if two independent 64-bit identifiers agree by chance, 1 in 2^128 for a pair: below 1 in 10^10 for a corpus of 10^14 bytes.

Only grouped counts travel, pre-aggregated per task, so copies by the thousand cost one row a task.

Defined cases: null text is empty; texts shorter than ``width`` bytes keep all bytes; repeated rows are
separate documents, so their long texts go whole; rows with one doc_id and different texts are separate; null
doc_ids are allowed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, batches
from .fingerprint import mix

WIDTH, GRAM, PIECE, STRETCH, MOST_RUNS, BATCH, SEGMENT = 200, 50, 16, 8, 64, 192_000, 1_000_000
_LOW = np.uint64(0xFFFFFF)


def bucket_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of every position's bucket at depths 50, 100 and 200 (zero bytes follow the end)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    name = np.ndarray((n,), "<u8", padded.data, 0, (1,)).copy()
    out = []
    for depth, offset in ((16, 8), (25, 9), (50, 25), (100, 50), (200, 100)):
        later = np.zeros_like(name)
        later[: max(0, n - offset)] = name[offset:]
        name = mix(name, later)
        if depth >= GRAM:
            out.append(name)
    return out[0], out[1], out[2]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w successive ones."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: document number, anchor, first and last start, anchor's bucket, run's bucket."""
    empty = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    if len(data) < WIDTH:
        return empty
    gram, _, whole = bucket_names(data)
    order = (gram & ~_LOW) | np.arange(len(data), dtype=np.uint64)
    owner = (_least(order[: len(data) - GRAM + 1], WIDTH - GRAM + 1) & _LOW).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(len(owner)), side="right")
    owner[np.arange(len(owner)) + WIDTH > ends[doc]] = -1
    cut = np.flatnonzero(np.diff(owner)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(owner)]]) - 1
    real = owner[lo] >= 0
    lo, hi = lo[real], hi[real]
    at = owner[lo]
    run = mix(mix(whole[lo], whole[hi]), ((at - lo) * 1024 + (hi - lo)).astype(np.uint64))
    return doc[lo], at, lo, hi, gram[at], run


def _documents(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """((id, hash, segment start), bytes); long texts as segments that overlap by width - 1 bytes."""
    for batch in it:
        ids, hashes, texts = (batch.column(i).to_pylist() for i in range(3))
        for key, th, raw in zip(ids, hashes, texts, strict=True):
            for at in range(0, max(1, len(raw) - WIDTH + 1), SEGMENT):
                yield (key, th, at), raw[at : at + SEGMENT + WIDTH - 1]


def _concat(group: list[tuple[tuple, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for _, x in group])
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(x for _, x in group), np.uint8), ends, ends - lengths


_STRETCHES = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.list_(pa.int16())), ("off", pa.list_(pa.int16())), ("back", pa.list_(pa.int16())), ("gram", pa.list_(pa.int64())), ("run", pa.list_(pa.int64()))])
_STRETCHES_DDL = "id long, th long, lo long, k1 long, k2 long, n array<short>, off array<short>, back array<short>, gram array<long>, run array<long>"


def _emit_stretches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in batches(_documents(it), BATCH):
        data, ends, starts = _concat(group)
        doc, at, lo, hi, gram, run = runs(data, ends)
        if not len(doc):
            continue
        ids, hashes, offset = (np.array([k[i] for k, _ in group], np.int64) for i in range(3))
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] & np.uint64(STRETCH - 1) == 0)]))
        size = np.diff(np.append(first, len(doc)))
        long = size > MOST_RUNS  # of text that repeats itself: cut by count, which only makes fewer stretches agree
        if long.any():
            first = np.concatenate([np.arange(a, a + m, MOST_RUNS) for a, m in zip(first.tolist(), size.tolist(), strict=True)])
            size = np.diff(np.append(first, len(doc)))
        nth = (np.arange(len(doc)) - np.repeat(first, size)).astype(np.uint64)
        k1, k2 = np.add.reduceat(mix(run, nth), first), np.add.reduceat(mix(gram, run + nth), first)
        cuts = pa.array(np.append(first, len(doc)), pa.int32())
        listed = (pa.ListArray.from_arrays(cuts, pa.array(v, t)) for v, t in (((hi - lo + 1).astype(np.int16), pa.int16()), ((at - np.repeat(lo[first], size)).astype(np.int16), pa.int16()), ((at - lo).astype(np.int16), pa.int16()), (gram.view(np.int64), pa.int64()), (run.view(np.int64), pa.int64())))
        d = doc[first]
        yield arrow(_STRETCHES, ids[d], hashes[d], lo[first] - starts[d] + offset[d], k1.view(np.int64), k2.view(np.int64), *listed)


_PIECES = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("n", pa.int16()), ("gram", pa.int64()), ("piece", pa.int16()), ("core", pa.int64()), ("all", pa.int64())])
_STRINGS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])


def _names_at(raw: bytes, need: np.ndarray) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """Bucket names of a whole text, segment by segment, for the segments that hold a start in ``need``."""
    for at in range(0, max(1, len(raw) - WIDTH + 1), SEGMENT):
        if np.any((need >= at) & (need < at + SEGMENT)):
            # A segment's pieces may reach back to their anchor, so the text on both sides belongs to it.
            a = max(0, at - WIDTH)
            yield at, a, bucket_names(np.frombuffer(raw[a : at + SEGMENT + 2 * WIDTH], np.uint8))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, list[np.ndarray]]]:
    names = batch.schema.names
    ids, hashes, texts = (batch.column(names.index(c)).to_pylist() for c in ("id", "th", "text"))
    lists = [batch.column(i) for i, c in enumerate(names) if c not in ("id", "th", "text")]
    for i in range(batch.num_rows):
        yield ids[i], hashes[i], texts[i], [x[i].values.to_numpy(zero_copy_only=False) for x in lists]


def _emit_pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: id, th, text, lists of anchors, backs, counts. Out: the runs' pieces."""
    u = lambda x: x.astype(np.uint64)
    for batch in it:
        parts: list[tuple] = []
        for key, th, raw, (anchors, backs, counts) in _rows(batch):
            firsts = anchors - backs
            for seg, base, (gram, half, whole) in _names_at(raw, firsts):
                pick = (firsts >= seg) & (firsts < seg + SEGMENT)
                at, back, n = (x[pick].astype(np.int64) for x in (anchors, backs, counts))
                top, low = back // PIECE, np.maximum(0, back - n + 1) // PIECE
                many = top - low + 1
                r = np.repeat(np.arange(len(at)), many)
                piece = low[r] + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
                near, far = np.maximum(piece * PIECE, back[r] - n[r] + 1), np.minimum(piece * PIECE + PIECE - 1, back[r])
                a = at[r] - base
                core = mix(half[a - piece * PIECE], half[a - piece * PIECE - PIECE + 1 + WIDTH // 2])
                every = mix(mix(whole[a - far], whole[a - near]), u(near * 1024 + far))
                parts.append((np.full(len(r), key), np.full(len(r), th), at[r] - far, far - near + 1, gram[a].view(np.int64), piece, core.view(np.int64), every.view(np.int64)))
            if sum(len(p[0]) for p in parts) > 50_000:
                yield arrow(_PIECES, *(np.concatenate(c) for c in zip(*parts, strict=True)))
                parts = []
        if parts:
            yield arrow(_PIECES, *(np.concatenate(c) for c in zip(*parts, strict=True)))


def _emit_strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: id, th, text, lists of first starts and counts. Out: each string with its bucket at half its depth and the one at the later offset."""
    for batch in it:
        parts: list[tuple] = []
        for key, th, raw, (firsts, counts) in _rows(batch):
            for seg, base, (_, half, _) in _names_at(raw, firsts):
                pick = (firsts >= seg) & (firsts < seg + SEGMENT)
                lo, n = firsts[pick].astype(np.int64), counts[pick].astype(np.int64)
                s = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p = s - base
                parts.append((np.full(len(s), key), np.full(len(s), th), s, half[p].view(np.int64), half[p + WIDTH // 2].view(np.int64)))
            if sum(len(p[0]) for p in parts) > 100_000:
                yield arrow(_STRINGS, *(np.concatenate(c) for c in zip(*parts, strict=True)))
                parts = []
        if parts:
            yield arrow(_STRINGS, *(np.concatenate(c) for c in zip(*parts, strict=True)))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {({'int64': 'long', 'int16': 'short'})[str(f.type)]}" for f in schema)


def merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as (starts, ends), touching ones joined."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(id, th, text) -> (id, th, starts, lengths): intervals of repeated bytes of each text that has any."""
    stretches = scratch.keep(docs.mapInArrow(_emit_stretches, _STRETCHES_DDL), "stretches")
    same = stretches.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "lo")).alias("one"))
    told = stretches.join(same, ["k1", "k2"])
    # A stretch that agrees with another is a span; its runs go on if it stands alone, or (with weight 2) stands for its kind.
    weight = F.when(F.col("c") == 1, 1).when(F.col("one") == F.struct("id", "th", "lo"), 2)
    run = lambda x: F.struct(F.lit("run").alias("kind"), (F.col("lo") + x["off"]).alias("at"), x["back"].alias("back"), x["n"].cast("long").alias("n"), x["gram"].alias("gram"), x["run"].alias("run"), weight.cast("long").alias("w"))
    alone = F.transform(F.arrays_zip("off", "back", "n", "gram", "run"), run)
    nothing = F.lit(None)
    span = F.struct(F.lit("span").alias("kind"), F.col("lo").alias("at"), nothing.cast("short").alias("back"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), nothing.cast("long").alias("gram"), nothing.cast("long").alias("run"), nothing.cast("long").alias("w"))
    parts = F.concat(F.when(F.col("c") > 1, F.array(span)).otherwise(F.array()), F.when(weight.isNotNull(), alone).otherwise(F.array()))
    split = scratch.keep(told.select("id", "th", F.explode(parts).alias("p")).select("id", "th", "p.*"), "split", by="kind")
    scratch.drop("stretches")
    found = split.where("kind = 'run'").select("id", "th", "at", "back", F.col("n").cast("short").alias("n"), "gram", "run", "w")
    agreed = split.where("kind = 'span'").select("id", "th", F.col("at").alias("s"), (F.col("n") + F.lit(WIDTH - 1)).cast("int").alias("len"))
    # Written, so that the join has an exchange of its own on both sides, whose hot buckets can be split.
    grams = scratch.keep(found.groupBy("gram").agg(F.sum("w").alias("c")).where("c > 1").select("gram"), "grams")
    alive = scratch.keep(found.join(grams, "gram", "left_semi"), "alive")
    scratch.drop("split/kind=run", "grams")
    classes = scratch.keep(alive.groupBy("gram", "run").agg(F.sum("w").alias("c"), F.min(F.struct("id", "th", "at", "back", "n")).alias("one")), "classes")
    # Refine where some run of the anchor's bucket stands alone: such runs, and one of each class that agrees.
    mixed = classes.groupBy("gram").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1").select("gram")
    rest = classes.join(mixed, "gram", "left_semi").select("one.*")
    pieces = scratch.keep(_with_text(rest, docs, ["at", "back", "n"]).mapInArrow(_emit_pieces, _ddl(_PIECES)), "pieces")
    key = ["gram", "piece", "core"]
    kinds = scratch.keep(pieces.groupBy(*key, "all").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "lo", "n")).alias("one")), "kinds")
    mixed = kinds.groupBy(*key).agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1").select(*key)
    rest = kinds.join(mixed, key, "left_semi").select("one.*")
    strings = scratch.keep(_with_text(rest, docs, ["lo", "n"]).mapInArrow(_emit_strings, _ddl(_STRINGS)), "strings")
    twice = strings.groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1").select("k1", "k2")
    whole_runs = alive.where("w = 1").join(classes.where("c > 1").select("gram", "run"), ["gram", "run"], "left_semi").select("id", "th", (F.col("at") - F.col("back")).alias("s"), (F.col("n") + F.lit(WIDTH - 1)).cast("int").alias("len"))
    whole_pieces = pieces.join(kinds.where("c > 1").select(*key, "all"), [*key, "all"], "left_semi").select("id", "th", F.col("lo").alias("s"), (F.col("n") + F.lit(WIDTH - 1)).cast("int").alias("len"))
    single = strings.join(twice, ["k1", "k2"], "left_semi").select("id", "th", F.col("lo").alias("s"), F.lit(WIDTH).alias("len"))
    spans = agreed.unionByName(whole_runs).unionByName(whole_pieces).unionByName(single)
    spans = spans.groupBy("id", "th").agg(F.collect_set(F.struct("s", "len")).alias("spans"))
    out = scratch.keep(spans.select("id", "th", F.col("spans.s").alias("starts"), F.col("spans.len").alias("lengths")), "spans")
    scratch.drop("alive", "classes", "pieces", "kinds", "strings", "split")
    return out


def _with_text(rows: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per text: (id, th, text, a list per column); rows of one text are no more than its bytes."""
    lists = rows.groupBy("id", "th").agg(F.collect_list(F.struct(*columns)).alias("l"))
    lists = lists.select("id", "th", *[F.col(f"l.{c}").alias(c) for c in columns])
    # Repeated rows of one id and text come out repeated, and rightly count as repeats of each other.
    return docs.join(lists, ["id", "th"]).select("id", "th", "text", *columns)


def mark_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds _starts and _lengths, the intervals of repeated bytes (null: none), to every row of docs."""
    scratch = Scratch(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key, th = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), F.xxhash64(body)
    spans = repeated_spans(docs.select(key.alias("id"), th.alias("th"), body.cast("binary").alias("text")), scratch)
    spans = spans.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("starts").alias("_starts"), F.col("lengths").alias("_lengths"))
    return docs.withColumn("_id", key).withColumn("_th", th).join(spans, ["_id", "_th"], "left").drop("_id", "_th")


def keep_bytes(raw: bytes, starts, lengths) -> tuple[bytes, int]:
    """The bytes outside the intervals, and the number of maximal removed runs."""
    if starts is None or not len(starts):
        return raw, 0
    s, e = merged(np.asarray(starts, np.int64), np.asarray(lengths, np.int64))
    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(s)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _emit_digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = []
        for key, raw, starts, lengths in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            kept, n = keep_bytes(raw or b"", starts, lengths)
            rows.append((key, len(raw or b""), len(raw or b"") - len(kept), n, hashlib.sha256(kept).hexdigest()))
        if rows:
            yield arrow(_DIGEST, *zip(*rows, strict=True))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    marked = mark_repeats(docs.select("doc_id", "text"))
    return marked.select("doc_id", F.col("text").cast("binary"), "_starts", "_lengths").mapInArrow(_emit_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut from text; pieces of a cut character go too.

    Null texts stay null. n_chars, where there is such a column, is counted anew. Other columns stay.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else keep_bytes(bytes(t), s, n)[0].decode("utf-8", "ignore") for t, s, n in zip(text, starts, lengths, strict=True)], dtype=object)

    out = mark_repeats(docs).withColumn("text", F.when(F.col("_starts").isNull(), F.col("text")).otherwise(cut(F.col("text").cast("binary"), "_starts", "_lengths")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
