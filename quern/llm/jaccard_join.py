"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct k-word shingles; two link when
``100 * |intersection| >= threshold * |union|``. Result: component labels; links between equal
sets are implied by their shared class, so copies are never expanded into pairs.

1. Equal sets collapse to a class (told by 128 bits, pre-aggregated per task).
2. Leaders. Classes with the same least shingle are verified against the first of them only: linear work, which joins
   most of a large group of near-copies. Linked classes are one node from here on, so what follows looks for links
   between different nodes.
3. Inverted lists of nodes. With T the least overlap a class needs, a linked pair shares at least ``SHARE`` of the first
   ``n - T + SHARE`` shingles of either set in a common order (or all that must be shared, if fewer). As in DivideSkip, lists
   of more than ``MOST`` nodes are long and set aside: they come last in the order. They are counted exactly over the shingles at
   hand, then over all shingles of those classes that need others instead, until no list is newly long. A class learns which of its
   lists are long by a lookup of the ``HEAVY`` longest ones in its own array and by a join for all the others. Short lists are joined and occurrences counted per pair of nodes; a pair is a candidate if its count
   reaches what it must share. Few classes have too few short lists and keep long ones: a linked pair that lacks occurrences in
   short lists shares a long one that both keep, and each long list ties those that keep it to the first of them.
4. Each candidate pair is settled around its larger node (a star): the classes of the centre are indexed, those of its partners ask, and no partner is
   compared with another. What long lists tie forms groups, whose classes are all indexed and all ask but those of the largest node. Either is DivideSkip: of
   a query's inverted lists, the longest are set aside, the others merged with a heap that skips what cannot reach T - L, and each candidate is looked up in the long
   ones by binary search until it has what it needs or cannot get it. Centres, partners and groups are dealt out in chunks of at most
   ``CHUNK`` classes and ``SHINGLES`` shingles.
5. Components over the links found.

The order, MOST, HEAVY, CHUNK and SHARE move cost, never the result.

Defined cases: null or wordless text has the empty set, n_shingles 0, and is its own component; fewer than k
words are one shingle; repeated rows share a class; a null doc_id gets the smallest non-null doc_id of its
component (null if it has none, or if its own set is empty); further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, with_defaults
from .components import connected_components
from .fingerprint import WordHashes, shingle_hashes

SHARE, EXTRA, MOST, HEAVY, CHUNK, SHINGLES = 5, 20, 300, 1000, 800, 1_000_000
_MEMO = WordHashes()


def shingle_set(raw: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes. Words: ASCII white space splits, A-Z is lower-cased."""
    return np.unique(shingle_hashes((raw or b"").lower().split(), k, _MEMO))


def least_overlap(n: int, threshold: int) -> int:
    """Least overlap with any partner, for a set of n at this threshold in percent."""
    return -(-n * threshold // 100)


_SETS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.list_(pa.int64()))])


def _emit_sets(k: int, threshold: int, share: int, extra: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for key, th, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingle_set(raw, k)
                n = len(s)
                name = xxhash.xxh3_128_digest(s.tobytes()) if n else b"\0" * 16
                h1, h2 = (int.from_bytes(x, "little", signed=True) for x in (name[:8], name[8:]))
                rows.append((key, th, n, h1, h2, s[: n - least_overlap(n, threshold) + share + extra].view(np.int64)))
            if rows:
                yield arrow(_SETS, *zip(*rows, strict=True))

    return run


def _emit_all(k: int):
    """id, text -> id, all shingles."""
    schema = pa.schema([("id", pa.int64()), ("t", pa.list_(pa.int64()))])

    def run(it):
        for batch in it:
            if batch.num_rows:
                yield arrow(schema, batch.column(0), [shingle_set(x, k).view(np.int64) for x in batch.column(1).to_pylist()])

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(member, count) of the members of at least ``least`` of the ascending lists, by a heap of their heads."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= least:
        now, popped = heap[0][0], []
        while heap and heap[0][0] == now:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield now, len(popped)
            target = now + 1
        else:  # so many heads more can be passed over that no member before the next one has enough
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = heap[0][0]
        for _, i, at in popped:
            x = lists[i]
            at = bisect_left(x, target, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))


def t_occurrence(sets: list[np.ndarray], nodes: list[int], indexed: list[bool], asks: list[bool], threshold: int) -> list[tuple[int, int]]:
    """Pairs of indices, one indexed and one that asks, that link sets of different nodes; enough of them to connect what is linked."""
    ask, lists = [q for q, x in enumerate(asks) if x], [i for i, x in enumerate(indexed) if x]
    if not ask or not lists:
        return []
    n = [len(s) for s in sets]
    union, first = _Union(len(sets)), {}
    for i, x in enumerate(nodes):
        union.join(first.setdefault(x, i), i)
    tokens, owner = np.concatenate([sets[i] for i in lists]), np.repeat(lists, [n[i] for i in lists])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    names, starts, lengths = np.unique(tokens, return_index=True, return_counts=True)
    out = []
    for q in ask:
        s = sets[q]
        at = np.searchsorted(names, s)
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == s)]
        need = least_overlap(len(s), threshold)
        if len(at) < need:
            continue
        at = at[np.argsort(lengths[at], kind="stable")]
        # L, by DivideSkip's rule: the longer the longest list, the more merging costs against probing.
        aside = min(need - 1, int(need / (0.01 * math.log2(max(2, int(lengths[at[-1]]))) + 1)))
        cut = len(at) - aside
        short, long = ([owner[starts[i] : starts[i] + lengths[i]].tolist() for i in part.tolist()] for part in (at[:cut], at[cut:]))
        for c, count in merge_skip(short, need - aside):
            if c == q or 100 * min(n[c], n[q]) < threshold * max(n[c], n[q]) or union.find(c) == union.find(q):
                continue
            # The long lists are probed for the candidate, as long as they can still make up what it lacks.
            both, least = count, -(-threshold * (n[c] + n[q]) // (100 + threshold))
            for left, members in zip(range(len(long), 0, -1), long, strict=True):
                if both + left < least or both >= least:
                    break
                place = bisect_left(members, c)
                both += place < len(members) and members[place] == c
            if both >= least:
                union.join(c, q)
                out.append((c, q))
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search_groups(k: int, threshold: int):
    """In, sorted by group: grp, i, j, id, node, indexed, asks, text. Out: links that connect what the group links."""

    def solve(rows: dict[int, tuple]) -> list[tuple[int, int]]:
        if len({x[0] for x in rows.values()}) < 2:
            return []
        ids = sorted(rows)
        nodes, indexed, asks, raw = zip(*(rows[x] for x in ids), strict=True)
        found = t_occurrence([shingle_set(x, k) for x in raw], nodes, indexed, asks, threshold)
        return [(ids[a], ids[b]) for a, b in found]

    def run(it):
        now, rows, out = None, {}, []
        for batch in it:
            for grp, i, j, ident, node, indexed, asks, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, i, j) != now:
                    out += solve(rows)
                    now, rows = (grp, i, j), {}
                rows[ident] = (node, indexed, asks, raw)
            if out:
                yield arrow(_LINKS, *zip(*out, strict=True))
                out = []
        out += solve(rows)
        if out:
            yield arrow(_LINKS, *zip(*out, strict=True))

    return run


_TASK = ("grp", "i", "j", "id", "node", "indexed", "asks")


def _search(tasks: DataFrame, keyed: DataFrame, k: int, threshold: int, parts: int) -> DataFrame:
    """tasks(grp, i, j, id, node, indexed, asks, one) -> links(a, b). Texts of each class's first document join their tasks."""
    t = tasks.select(*_TASK, F.col("one.doc_id").alias("_doc"), F.col("one.th").alias("_th"))
    texts = keyed.join(t, keyed["doc_id"].eqNullSafe(t["_doc"]) & (keyed["th"] == t["_th"])).select(*_TASK, "text")
    texts = texts.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return texts.mapInArrow(_search_groups(k, threshold), "a long, b long")


def _chunks(classes, shingles):
    """How many tasks so many classes with so many shingles are dealt out over."""
    return F.ceil(F.greatest(classes / CHUNK, shingles / SHINGLES)).cast("int")


def _stars(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Tasks for pairs of nodes: around the larger node of each, whose classes are indexed, those of its partners ask.

    A class of a partner is compared with its centre only, so the work is in proportion to the pairs.
    """
    sizes = rows.groupBy("node").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    of = lambda side: sizes.select(F.col("node").alias(side), F.struct("c", "s", "node").alias(f"_{side}"))
    pairs = found.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.greatest("_a", "_b").alias("centre"), F.least("_a", "_b").alias("other"))
    stars = pairs.groupBy(F.col("centre.node").alias("grp")).agg(F.first("centre.c").alias("c"), F.first("centre.s").alias("s"), F.sum("other.c").alias("oc"), F.sum("other.s").alias("os"))
    stars = stars.select("grp", _chunks(F.col("c"), F.col("s")).alias("big"), _chunks(F.col("oc"), F.col("os")).alias("rest"))
    listed = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), F.col(n)).cast("int")
    centres = rows.join(stars, rows["node"] == stars["grp"]).select("grp", own("big").alias("i"), listed("rest").alias("j"), "id", "node", F.lit(True).alias("indexed"), F.lit(False).alias("asks"), "one")
    partners = pairs.select(F.col("centre.node").alias("grp"), F.col("other.node").alias("_node")).join(stars, "grp")
    partners = rows.join(partners, rows["node"] == partners["_node"]).select("grp", listed("big").alias("i"), own("rest").alias("j"), "id", "node", F.lit(False).alias("indexed"), F.lit(True).alias("asks"), "one")
    return centres.unionByName(partners)


def _ties(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Tasks for groups of nodes that long lists tie: the classes of the largest node in chunks against those of the others, and the others among
    themselves. The largest node asks nothing, for its members are linked already."""
    members = rows.select("id", "one", "n", "node").join(groups, "node").withColumnRenamed("comp", "grp")
    sizes = members.groupBy("grp", "node").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = sizes.groupBy("grp").agg(F.max(F.struct("c", "s", "node")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    whole = whole.select("grp", F.col("top.node").alias("top"), _chunks(F.col("top.c"), F.col("top.s")).alias("big"), _chunks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("rest")).where("rest > 0")
    dealt = members.join(whole, "grp").withColumn("main", F.col("node") == F.col("top"))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.when(F.col("main"), F.col("big")).otherwise(F.col("rest"))).cast("int")
    last = F.when(F.col("main"), F.col("rest")).otherwise(F.col("big") + F.col("rest")) - 1
    dealt = dealt.withColumn("own", own).withColumn("c", F.explode(F.sequence(F.lit(0), last)))
    other = F.col("big") + F.col("own")
    i = F.when(F.col("main"), F.col("own")).when(F.col("c") < F.col("big"), F.col("c")).otherwise(F.least("c", other))
    j = F.when(F.col("main"), F.col("big") + F.col("c")).when(F.col("c") < F.col("big"), other).otherwise(F.greatest("c", other))
    return dealt.select("grp", i.alias("i"), j.alias("j"), "id", "node", F.lit(True).alias("indexed"), (~F.col("main")).alias("asks"), "one")


def _candidates(post: DataFrame, threshold: int) -> DataFrame:
    """post(t, node, lo, hi) -> (a, b): pairs of nodes that share as many lists as linked ones must."""
    x, y = (post.select("t", *[F.col(c).alias(f"{c}{s}") for c in ("node", "lo", "hi")]) for s in "xy")
    fits = (F.col("nodex") < F.col("nodey")) & (F.col("hix") * 100 >= F.col("loy") * threshold) & (F.col("hiy") * 100 >= F.col("lox") * threshold)
    pairs = x.join(y, "t").where(fits).groupBy("nodex", "nodey").agg(F.count("*").alias("c"), F.min(F.greatest("lox", "loy")).alias("n"))
    need = F.least(F.lit(SHARE), F.ceil(F.col("n") * threshold / 100))
    return pairs.where(F.col("c") >= need).select(F.col("nodex").alias("a"), F.col("nodey").alias("b"))


def _postings(rows: DataFrame, lists: str) -> DataFrame:
    """rows(node, n, alone, lists) -> (t, node, lo, hi): a node is once in each list, with its least and greatest n."""
    flat = lambda keep: rows.where(keep).select(F.explode(lists).alias("t"), "node", "n")
    single = flat(F.col("alone")).select("t", "node", F.col("n").alias("lo"), F.col("n").alias("hi"))
    return single.unionByName(flat(~F.col("alone")).groupBy("t", "node").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))


def _among(x, heavy: list[int]):
    return x.isin(heavy) if heavy else F.lit(False)


def _hits(rows: DataFrame, lists: str, light: DataFrame, heavy: list[int]) -> DataFrame:
    """rows(id, lists) -> (id, t): which of a row's lists are in ``light``. Those in ``heavy`` take no part."""
    return rows.select("id", F.explode(F.filter(lists, lambda x: ~_among(x, heavy))).alias("t")).join(light, "t", "left_semi")


def _split(rows: DataFrame, lists: str, hits: DataFrame, heavy: list[int], want) -> DataFrame:
    """rows with rest, their lists that are not long, short, the first ``want`` of them, and kept, long ones for what lacks."""
    hits = hits.groupBy("id").agg(F.collect_set("t").alias("lt"))
    lt = F.concat(F.filter(lists, lambda x: _among(x, heavy)), F.coalesce("lt", F.array().cast("array<long>")))
    rows = rows.join(hits, "id", "left").withColumn("lt", lt).withColumn("rest", F.array_except(lists, "lt"))
    kept = F.slice(F.array_sort("lt"), F.lit(1), F.greatest(F.lit(0), want - F.size("rest")))
    return rows.withColumn("short", F.slice("rest", F.lit(1), want)).withColumn("kept", kept)


def components(docs: DataFrame, k: int = 3, threshold: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> (doc_id, n_shingles, component_id), one row per row of docs."""
    return _labelled(docs, k, threshold, doc_id, text).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, k: int, threshold: int, doc_id: str, text: str) -> DataFrame:
    """components() with th, the text's hash, and comp, the number of the component (null: an empty set)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = with_defaults(docs, spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.cast("binary").alias("text"))
    sets = scratch.keep(keyed.mapInArrow(_emit_sets(k, threshold, SHARE, EXTRA), "doc_id long, th long, n long, h1 long, h2 long, first array<long>"), "sets")
    classes = sets.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("one"), F.first("n").alias("n"), F.first("first").alias("first"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # What a later step needs of a table is written apart, so that its shingles can go.
    ids = scratch.keep(sets.select("doc_id", "th", "n", "h1", "h2"), "ids")
    scratch.drop("sets")

    # Leaders: each class against the first one with its least shingle.
    led = classes.select("id", "one", F.col("first")[0].alias("grp"))
    heads = led.groupBy("grp").agg(F.min("id").alias("head"), F.min_by("one", "id").alias("first_one"), F.count("*").alias("size")).where("size > 1")
    led = led.join(heads, "grp").withColumn("i", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CHUNK)).cast("int"))
    spread = heads.select("grp", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / CHUNK).cast("int") - 1)).alias("i"), F.lit(0).alias("j"), F.col("head").alias("id"), F.lit(0).cast("long").alias("node"), F.lit(True).alias("indexed"), F.lit(False).alias("asks"), F.col("first_one").alias("one"))
    # The leader is indexed, each class asks for itself.
    tasks = led.where("id <> head").select("grp", "i", F.lit(0).alias("j"), "id", (F.col("id") + 1).alias("node"), F.lit(False).alias("indexed"), F.lit(True).alias("asks"), "one").unionByName(spread)
    near = scratch.keep(_search(tasks, keyed, k, threshold, parts), "near")
    comps = connected_components(near, scratch, "leaders")

    rows = classes.join(comps, classes["id"] == comps["node"], "left").select("id", "one", "n", "first", F.coalesce("comp", "id").alias("node"), F.col("comp").isNull().alias("alone"))
    rows = scratch.keep(rows, "nodes")
    names = scratch.keep(classes.select("id", "h1", "h2", "least"), "names")
    scratch.drop("classes")
    want = (F.col("n") - F.ceil(F.col("n") * threshold / 100) + SHARE).cast("int")
    tally = lambda r, lists: _postings(r, lists).groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") > MOST)
    long = scratch.keep(tally(rows, "first"), "long-0")
    new, told, heavy = long, None, []
    for turn in itertools.count(1):
        # The order is by hash, long lists last: the first shingles in it, from what is at hand where that is enough.
        # A later turn looks for its newly long lists only. The longest, HEAVY in all, are looked up where they are: a group of any
        # size that shares them makes no rows.
        heavy += [r.t for r in new.orderBy(F.desc("c"), "t").limit(HEAVY - len(heavy)).collect()]
        fresh = scratch.keep(_hits(rows.select("id", "first"), "first", new, heavy), f"hits-{turn}")
        told = fresh if told is None else told.unionByName(fresh)
        listed = _split(rows, "first", told, heavy, want)
        at_hand = (F.size("rest") >= want) | (F.size("first") == F.col("n"))
        listed = listed.select("id", "one", "node", "n", "alone", "short", "kept", at_hand.alias("done"))
        listed = scratch.keep(listed, "listed")
        # Else from all shingles of the text, whose lists are counted in turn: with those at hand, none ends up above 2 * MOST.
        again = listed.where("not done").select("id", "node", "n", "alone", F.col("one.doc_id").alias("_doc"), F.col("one.th").alias("_th"))
        texts = keyed.join(again, keyed["doc_id"].eqNullSafe(again["_doc"]) & (keyed["th"] == again["_th"])).groupBy("id").agg(F.first("text").alias("text"))
        spelled = texts.mapInArrow(_emit_all(k), "id long, t array<long>").withColumnRenamed("t", "every")
        spelled = scratch.keep(again.select("id", "node", "n", "alone").join(spelled, "id"), "spelled")
        more = scratch.keep(tally(spelled, "every").join(long, "t", "left_anti"), f"more-{turn}")
        if not more.limit(1).count():
            break
        new, long = more, scratch.keep(long.unionByName(more), f"long-{turn}")
        scratch.drop(f"long-{turn - 1}")
    sorted_ = _split(spelled, "every", _hits(spelled, "every", long, heavy), heavy, want)
    sorted_ = scratch.keep(sorted_.select("id", "node", "n", "alone", "short", "kept"), "again")
    listed = listed.where("done").select(*sorted_.columns).unionByName(sorted_)
    members = scratch.keep(rows.select("id", "one", "n", "node"), "members")
    scratch.drop("nodes", "spelled", f"long-{turn - 1}", *[f"{x}-{i}" for x in ("hits", "more") for i in range(1, turn + 1)])
    found = scratch.keep(_candidates(_postings(listed, "short"), threshold), "found")
    # A linked pair that shares less in short lists shares a long list that both keep, and is tied by it.
    kept = _postings(listed.where(F.size("kept") > 0), "kept")
    tied = kept.join(kept.groupBy("t").agg(F.min("node").alias("b")), "t").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    groups = connected_components(tied, scratch, "groups")
    scratch.drop("listed", "again")
    tasks = _stars(found, members).unionByName(_ties(groups, members))
    links = _search(tasks, keyed, k, threshold, parts).unionByName(near)
    comps = connected_components(links, scratch, "links")

    labels = names.join(comps, names["id"] == comps["node"], "left").select("h1", "h2", "least", F.coalesce("comp", "id").alias("comp"))
    lowest = labels.groupBy("comp").agg(F.min("least").alias("component_id"))
    labels = labels.join(lowest, "comp").select("h1", "h2", "comp", "component_id")
    out = ids.join(labels, ["h1", "h2"], "left")
    scratch.drop("members", "near", "found")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "comp")


def keep_one(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id (nulls last) and text hash, and of rows that agree in both
    the least one. Rows of empty sets all stay. doc_ids need not be unique; columns must be of types that can be ordered."""
    rows = _labelled(docs.select("doc_id", "text"), k, threshold, "doc_id", "text")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    grouped = rows.where("comp is not null")
    chosen = grouped.groupBy("comp").agg(F.min(place).alias("p")).select("p.doc_id", "p.th").withColumn("kept", F.lit(True))
    many = grouped.groupBy("doc_id", "th").agg(F.count("*").alias("many"))
    marks = many.join(chosen, many["doc_id"].eqNullSafe(chosen["doc_id"]) & (many["th"] == chosen["th"])).select(many["doc_id"].alias("_doc"), many["th"].alias("_th"), "many")
    empty = rows.where("comp is null").select("doc_id", "th").distinct().select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.lit(1).cast("long").alias("many"))
    marks = marks.unionByName(empty)
    here = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = here.join(marks, here["_id"].eqNullSafe(marks["_doc"]) & (here["_hash"] == marks["_th"]))
    alone = kept.where("many = 1").select(*docs.columns)
    repeated = kept.where("many > 1").groupBy("_id", "_hash").agg(F.min(F.struct(*docs.columns)).alias("r"))
    return alone.unionByName(repeated.select("r.*"))
