"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Vectors of one length and equal direction (to 12 decimals of the unit vector) are one node, with its smallest vec_ids, so
copies, rescaled or not, cannot crowd each other's neighbours out.

* Start: in each of ``TREES`` rounds, nodes are dealt into blocks by the signs of random projections, once by a hash, and
  each takes its best neighbours within its block. The hash alone gives every node neighbours, if there are other nodes.
* NN-descent: nodes bring their vectors to their neighbours (and to a bounded, hashed choice of those that
  name them); every two that meet at a node become candidates of each other. Candidates better than a node's
  worst neighbour are merged into its list, first within each task, so a node that everybody meets is a row a task.
  ``ROUNDS`` joins of neighbours of neighbours, however few nodes there are.
* Search: each query keeps a list of the best nodes seen and opens the nearest unopened ones: their neighbours, along
  edges in both directions, are fetched by a join with the graph, and the vectors of those not in the list by a join with
  the nodes. It ends when no query has a node left to open, or after ``HOPS``. The whole list is measured again in double
  precision on the original vectors.

The graph works on unit vectors in single precision, which it compares in double precision, so near-copies as tight as single
precision can hold are told apart. Recall against brute force is tested, also within a group of thousands of near-copies.

Defined cases: null, zero or non-finite vectors take no part; vectors of different lengths have no cosine and are not
candidates of each other; with fewer candidates than asked for, all are returned; equal cosines are ordered by vec_id;
repeated rows are candidates of each other; rows with a null vec_id are ignored; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow, with_defaults
from .vector_dedup import unit, usable

DEGREE, BACK, BLOCK, TREES, ROUNDS, MEET, HOPS, OPEN, LIST = 32, 24, 1_500, 8, 2, 16, 7, 16, 256


def _cosines(u: np.ndarray) -> np.ndarray:
    """Single-precision unit rows as double-precision ones, of length one again."""
    x = u.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length in a column without nulls."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Column indices of each row's k largest, in no order."""
    return np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]


_NODES = pa.schema([("id", pa.int64()), ("code", pa.binary())])
_LISTS = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("sims", pa.binary())])
_LISTS_DDL = "id long, ids binary, sims binary"


def _emit_codes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at, x in _by_length(batch.column(1)):
            yield arrow(_NODES, batch.column(0).take(pa.array(at)), [u.tobytes() for u in unit(x).astype(np.float32)])


def _emit_blocks(trees: int):
    """id, code, bits (of its vector length's blocks) -> the block of each round; round ``trees`` is by hash."""
    schema = pa.schema([("block", pa.int64()), ("d", pa.int32()), ("id", pa.int64()), ("code", pa.binary())])

    def run(it):
        for batch in it:
            ids, codes, all_bits = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            sizes = np.array([len(c) // 4 for c in codes])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x, bits = _cosines(np.stack([np.frombuffer(codes[i], np.float32) for i in at])), int(all_bits[at[0]])
                for t in range(trees + 1):
                    if t < trees:
                        sign = ((x @ np.random.default_rng(t).normal(size=(d, bits)) > 0) << np.arange(bits)).sum(axis=1)
                    else:
                        sign = np.array([xxhash.xxh3_64_intdigest(codes[i]) % 2 ** max(0, bits - 1) for i in at])
                    yield arrow(schema, sign.astype(np.int64) * (trees + 1) + t, np.full(len(at), d), ids.take(pa.array(at)), [codes[i] for i in at])

    return run


def _groups(it: Iterator[pa.RecordBatch], keys: int):
    """Rows sorted by their first ``keys`` columns, as (key, rows)."""
    now, rows = None, []
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _chunks(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000):
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield arrow(schema, *zip(*out, strict=True))
            out = []
    if out:
        yield arrow(schema, *zip(*out, strict=True))


def _block_lists(it):
    """block, d, part, id, code -> each node's best within its block."""

    def rows():
        for _, group in _groups(it, 3):
            if len(group) > 1:
                ids = np.array([g[0] for g in group])
                x = _cosines(np.stack([np.frombuffer(g[1], np.float32) for g in group]))
                s = x @ x.T
                np.fill_diagonal(s, -2)
                best = _best(s, min(DEGREE, len(ids) - 1))
                sims = np.take_along_axis(s, best, 1)
                for i in range(len(ids)):
                    yield int(ids[i]), ids[best[i]].tobytes(), sims[i].tobytes()

    return _chunks(rows(), _LISTS)


def _best_of(keys: np.ndarray, ids: list[bytes], sims: list[bytes]) -> tuple[list, list, list]:
    """Sorted keys with lists -> per key its DEGREE best distinct nodes, all keys at once."""
    own = np.repeat(np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])), [len(x) // 8 for x in ids])
    to, sim = np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(sims), np.float64)
    order = np.lexsort((-sim, to, own))
    own, to, sim = own[order], to[order], sim[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (to[1:] != to[:-1])]) if len(own) else np.empty(0, bool)
    own, to, sim = own[new], to[new], sim[new]
    order = np.lexsort((-sim, own))
    own, to, sim = own[order], to[order], sim[order]
    starts = np.searchsorted(own, np.arange(int(own[-1]) + 1 if len(own) else 0))
    ends = np.minimum(np.append(starts[1:], len(own)), starts + DEGREE)
    cuts = list(zip(starts.tolist(), ends.tolist(), strict=True))
    return np.unique(keys).tolist(), [to[a:b].tobytes() for a, b in cuts], [sim[a:b].tobytes() for a, b in cuts]


def _merge_lists(it):
    """id-sorted lists -> one list per id: its DEGREE best distinct nodes."""
    keys, ids, sims = np.empty(0, np.int64), [], []
    for batch in it:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        ids, sims = ids + batch.column(1).to_pylist(), sims + batch.column(2).to_pylist()
        if not len(keys):
            continue
        # The last id may go on in the next batch; what it has so far is merged, so it stays one list.
        k, i, s = _best_of(keys, ids, sims)
        if len(k) > 1:
            yield arrow(_LISTS, k[:-1], i[:-1], s[:-1])
        keys, ids, sims = np.array(k[-1:]), i[-1:], s[-1:]
    if len(keys):
        yield arrow(_LISTS, keys, ids, sims)


def _spread(it):
    """A node's list -> edges (at, to), in both directions."""
    schema = pa.schema([("at", pa.int64()), ("to", pa.int64()), ("back", pa.bool_())])
    for batch in it:
        keys = batch.column(0).to_numpy()
        lists = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        if lists:
            own, named = np.repeat(keys, [len(x) for x in lists]), np.concatenate(lists)
            yield arrow(schema, np.concatenate([own, named]), np.concatenate([named, own]), np.repeat([False, True], len(own)))


def _meet(it):
    """at, id, floor, code of all that meet at a node -> for each, the best it met and did not have."""

    def rows():
        for _, group in _groups(it, 1):
            seen = {g[0]: g for g in group}
            if len(seen) < 2:
                continue
            ids = np.array(list(seen))
            floor = np.array([g[1] for g in seen.values()])
            x = _cosines(np.stack([np.frombuffer(g[2], np.float32) for g in seen.values()]))
            s = x @ x.T
            np.fill_diagonal(s, -2)
            best = _best(s, min(MEET, len(ids) - 1))
            sims = np.take_along_axis(s, best, 1)
            better = sims > floor[:, None]
            for i in np.flatnonzero(better.any(axis=1)).tolist():
                yield int(ids[i]), ids[best[i]][better[i]].tobytes(), sims[i][better[i]].tobytes()

    return _chunks(rows(), _LISTS)


def _gather(lists: DataFrame, parts: int) -> DataFrame:
    """One list per id; merged within each task before they travel."""
    merged = lists.sortWithinPartitions("id").mapInArrow(_merge_lists, _LISTS_DDL)
    return merged.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(_merge_lists, _LISTS_DDL)


def build_graph(nodes: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """nodes(id, code) -> (id, ids, sims): DEGREE near nodes of each, as packed long and double arrays."""
    size = F.octet_length("code")
    lengths = nodes.groupBy(size.alias("n")).agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BLOCK))).cast("int").alias("bits"))
    blocks = nodes.join(lengths, size == F.col("n")).select("id", "code", "bits").mapInArrow(_emit_blocks(TREES), "block long, d int, id long, code binary")
    # A block that came out large is cut by hash: this is only a start.
    sizes = blocks.groupBy("block", "d").agg(F.count("*").alias("size"))
    blocks = blocks.join(sizes, ["block", "d"]).select("block", "d", F.pmod(F.xxhash64("id", "block"), F.ceil(F.col("size") / (2 * BLOCK))).alias("part"), "id", "code")
    start = blocks.repartition(parts, "block", "d", "part").sortWithinPartitions("block", "d", "part").mapInArrow(_block_lists, _LISTS_DDL)
    graph = scratch.keep(_gather(start, parts), "graph-0")
    for i in range(1, ROUNDS + 1):
        ahead, behind = _edges(graph, i)
        floors = graph.select("id", F.expr(f"length(ids) >= {8 * DEGREE}").alias("full"), "sims").mapInArrow(_floors, "id long, floor double")
        carried = floors.join(nodes, "id")
        met = ahead.unionByName(behind).withColumnRenamed("to", "id").join(carried, "id").select("at", "id", "floor", "code")
        found = met.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(_meet, _LISTS_DDL)
        graph = scratch.keep(_gather(graph.unionByName(found), parts), f"graph-{i}")
        scratch.drop(f"graph-{i - 1}")
    return graph


def _edges(graph: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(at, to) ahead: a node's neighbours; behind: a hashed choice of BACK of those that name it."""
    edges = graph.mapInArrow(_spread, "at long, to long, back boolean")
    turn = Window.partitionBy("at").orderBy(F.xxhash64("at", "to", F.lit(seed)), "to")
    behind = edges.where("back").withColumn("r", F.row_number().over(turn)).where(F.col("r") <= BACK)
    return edges.where("not back").select("at", "to"), behind.select("at", "to")


def _floors(it):
    schema = pa.schema([("id", pa.int64()), ("floor", pa.float64())])
    for batch in it:
        out = [float(np.frombuffer(s, np.float64).min()) if full else -2.0 for full, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield arrow(schema, batch.column(0), out)


_STATE = "q long, code binary, ids binary, sims binary, opened binary, want array<long>"
_STATE_SCHEMA = pa.schema([("q", pa.int64()), ("code", pa.binary()), ("ids", pa.binary()), ("sims", pa.binary()), ("opened", pa.binary()), ("want", pa.list_(pa.int64()))])


def _open_nearest(it):
    """State -> (node, q): the nearest unopened nodes of each query's list."""
    schema = pa.schema([("node", pa.int64()), ("q", pa.int64())])

    def rows():
        for batch in it:
            for q, ids, opened in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh = np.frombuffer(ids, np.int64)[~np.frombuffer(opened, np.bool_)]
                for node in fresh[:OPEN].tolist():
                    yield node, q

    return _chunks(rows(), schema)


def _pack_neighbours(it):
    """at-sorted edges -> (node, ids)."""
    schema = pa.schema([("node", pa.int64()), ("ids", pa.binary())])
    return _chunks(((key, np.unique(np.array([g[0] for g in group], np.int64)).tobytes()) for (key,), group in _groups(it, 1)), schema)


def _ask(it):
    """q-sorted: state rows and opened nodes' neighbours (null code) -> the state, with the ids it does not list yet."""

    def rows():
        for (q,), group in _groups(it, 1):
            code, ids, sims, opened = next(g for g in group if g[0] is not None)[:4]
            marks = np.frombuffer(opened, np.bool_).copy()
            marks[np.flatnonzero(~marks)[:OPEN]] = True
            more = [np.frombuffer(g[1], np.int64) for g in group if g[0] is None]
            want = np.setdiff1d(np.concatenate(more), np.append(np.frombuffer(ids, np.int64), q)) if more else np.empty(0, np.int64)
            yield q, code, ids, sims, marks.tobytes(), want.tolist()

    return _chunks(rows(), _STATE_SCHEMA, 500)


def _advance(it):
    """q-sorted: state rows (null id) and wanted nodes with their vectors -> the new state."""

    def rows():
        for (q,), group in _groups(it, 1):
            code, ids, sims, opened = next(g for g in group if g[4] is None)[:4]
            more = [g for g in group if g[4] is not None]
            ids, sims, opened = np.frombuffer(ids, np.int64), np.frombuffer(sims, np.float64), np.frombuffer(opened, np.bool_)
            if more:
                x = _cosines(np.stack([np.frombuffer(g[0], np.float32) for g in more]))
                ids = np.concatenate([ids, [g[4] for g in more]])
                sims = np.concatenate([sims, x @ _cosines(np.frombuffer(code, np.float32)[None])[0]])
                opened = np.concatenate([opened, np.zeros(len(more), np.bool_)])
            top = np.argsort(-sims, kind="stable")[:LIST]
            yield q, code, ids[top].tobytes(), sims[top].tobytes(), opened[top].tobytes(), []

    return _chunks(rows(), _STATE_SCHEMA, 500)


def _first_state(it):
    def rows():
        for batch in it:
            for q, code, ids, sims in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                order = np.argsort(-np.frombuffer(sims, np.float64), kind="stable")
                yield q, code, np.frombuffer(ids, np.int64)[order].tobytes(), np.frombuffer(sims, np.float64)[order].tobytes(), np.zeros(len(order), np.bool_).tobytes(), []

    return _chunks(rows(), _STATE_SCHEMA)


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """queries(id): nodes to search for -> (q, id): all nodes of each list."""
    ahead, behind = _edges(graph, 0)
    paths = ahead.unionByName(behind).repartition(parts, "at").sortWithinPartitions("at")
    paths = scratch.keep(paths.mapInArrow(_pack_neighbours, "node long, ids binary"), "paths")
    state = queries.join(nodes, "id").join(graph, "id").select(F.col("id").alias("q"), "code", "ids", "sims").mapInArrow(_first_state, _STATE)
    state = scratch.keep(state, "state-0")
    null = lambda kind: F.lit(None).cast(kind)
    for i in range(1, HOPS + 1):
        frontier = state.select("q", "ids", "opened").mapInArrow(_open_nearest, "node long, q long")
        found = frontier.join(paths, "node").select("q", null("binary").alias("code"), "ids", null("binary").alias("sims"), null("binary").alias("opened"))
        both = state.select("q", "code", "ids", "sims", "opened").unionByName(found).repartition(parts, "q").sortWithinPartitions("q")
        asked = scratch.keep(both.mapInArrow(_ask, _STATE), f"asked-{i}")
        fetched = asked.select("q", F.explode("want").alias("id")).join(nodes, "id").select("q", "code", null("binary").alias("ids"), null("binary").alias("sims"), null("binary").alias("opened"), "id")
        both = asked.select("q", "code", "ids", "sims", "opened", null("long").alias("id")).unionByName(fetched).repartition(parts, "q").sortWithinPartitions("q")
        state = scratch.keep(both.mapInArrow(_advance, _STATE), f"state-{i}")
        done = not asked.where(F.size("want") > 0).limit(1).count()
        scratch.drop(f"state-{i - 1}", f"asked-{i}")
        if done:
            break
    return state.select("q", "ids").mapInArrow(_listed, "q long, id long")


def _listed(it):
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64())])
    for batch in it:
        for q, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(ids, np.int64)
            yield arrow(schema, np.full(len(n), q), n)


def _exact(it):
    """q vector, candidate vector -> cosine in double precision."""
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    for batch in it:
        for (at, x), (_, y) in zip(_by_length(batch.column(2)), _by_length(batch.column(3)), strict=True):
            yield arrow(schema, *(batch.column(i).take(pa.array(at)) for i in (0, 1)), np.clip((unit(x) * unit(y)).sum(axis=1), -1.0, 1.0))


def _direction(vector: str):
    """The unit vector to 12 decimals, as whole numbers: equal for rescaled copies."""

    def once(value, body):  # the value is bound to a variable, not computed again for every element
        return F.element_at(F.transform(F.array(value), body), 1)

    def whole(x):
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
        return once(norm, lambda n: F.transform(x, lambda v: F.round(v / n * 1e12).cast("long")))

    top = F.array_max(F.transform(vector, lambda v: F.abs(v)))
    return once(once(top, lambda t: F.transform(vector, lambda v: v / t)), whole)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score) for rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch, parts = Scratch(spark), with_defaults(vectors, spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable() & F.col("vec_id").isNotNull())
    rows = scratch.keep(rows.withColumn("way", _direction("embedding")), "given")
    # A class is told by its whole direction, not by a hash of it; its id is a number once it is written.
    classes = rows.groupBy("way").agg(F.min("embedding").alias("embedding")).withColumn("id", F.monotonically_increasing_id())
    classes = scratch.keep(classes, "classes")
    known = classes.select("id", F.col("way").alias("_way"))
    rows = rows.join(known, (F.xxhash64("way") == F.xxhash64("_way")) & (F.col("way") == F.col("_way"))).select("vec_id", "id")
    rows = scratch.keep(rows, "rows")
    scratch.drop("given")
    # Of a class, its k + 1 smallest vec_ids can be results; the window limit is applied before the shuffle, too.
    order = Window.partitionBy("id").orderBy("vec_id")
    members = scratch.keep(rows.select("id", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("id", "vec_id"), "members")
    nodes = scratch.keep(classes.select("id", "embedding").mapInArrow(_emit_codes, "id long, code binary"), "nodes")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "id")
    graph = build_graph(nodes, scratch, parts)
    lists = scratch.keep(search(nodes, graph, asked.select("id").distinct(), scratch, parts), "lists")
    alone = asked.select(F.col("id").alias("q"), "id").distinct()  # a node without neighbours still has its copies
    pairs = lists.unionByName(alone).distinct()
    vector = lambda c, d: classes.select(F.col("id").alias(c), F.col("embedding").alias(d))
    scores = pairs.join(vector("q", "a"), "q").join(vector("id", "b"), "id").select("q", "id", "a", "b").mapInArrow(_exact, "q long, id long, score double")
    results = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).join(scores, "q").join(members, "id")
    # A repeated row of the query is another row with its vec_id: one of them is left out.
    results = results.withColumn("own", F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy("id")))
    results = results.where((F.col("query_id") != F.col("vec_id")) | (F.col("own") > 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return results.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
