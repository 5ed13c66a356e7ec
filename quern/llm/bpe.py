"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Each task cuts its texts into pre-tokens and explodes them into (word, positions) of blocks: a block is a few
megabytes of whole documents, its words numbered by frequency. Words travel to the task of their bucket (a hash of the word), where every
distinct word is encoded once; the ids travel back to the blocks and the texts are put together by
position. A word occurs once per block and bucket however frequent it is, so no key is hot. Decoding
joins the distinct ids of each block and bucket with the token-byte table (a broadcast bounded by the vocabulary,
MOST_VOCABULARY); the bytes found go to the blocks, where words and texts are put together from them.

Defined cases: null text is empty and gives no ids; repeated rows are encoded each; null doc_ids stay; an
empty table gives an empty result; further columns are ignored. Decoding null ids gives null; an id outside the
vocabulary fails.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, file_bytes, with_defaults

BLOCK, CHUNK, MOST_VOCABULARY = 16_000_000, 150_000, 2_000_000
#: White space before a space: only there can a cut before a single space differ from the pattern's cuts.
UNSAFE = re.compile(r"\s ")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id, of a vocabulary file's content."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def space_cuts(text: str) -> list[str] | None:
    """The text cut before each space, spaces left out, if pre-tokens never cross such cuts; else None.

    Between two characters that are not white space, the pattern always starts a match at the space.
    """
    return None if UNSAFE.search(text) else text.split(" ")


class _Words(dict):
    """Part of a text -> the numbers of its pre-tokens in this block, as 4-byte integers."""

    def __init__(self, find, numbers: dict[str, int]):
        super().__init__()
        self.find, self.numbers = find, numbers

    def cut(self, text: str) -> bytes:
        n = self.numbers
        return np.array([n.setdefault(w, len(n)) for w in self.find(text)], "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        out = self[part] = self.cut(" " + part)
        return out


def _planes(numbers: bytes) -> bytes:
    """4-byte integers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.frombuffer(numbers, np.uint8).reshape(-1, 4).T.tobytes())


def _unplane(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def pack_list(items: list[bytes]) -> bytes:
    lengths = np.array([len(x) for x in items], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(items).to_bytes(4, "little") + lengths + b"".join(items))


def unpack_list(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


_ROWS = pa.schema([("kind", pa.string()), ("block", pa.string()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("data", pa.binary())])
_DDL = "kind string, block string, bucket int, numbers binary, data binary"


def pack_keys(keys: list[int | None], counts: list[int]) -> bytes:
    """Document ids (null allowed) and their numbers of pre-tokens."""
    ids = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    return len(keys).to_bytes(4, "little") + ids + np.array(counts, "<u4").tobytes() + bytes(k is None for k in keys)


def unpack_keys(data: bytes) -> list[tuple[int | None, int]]:
    n = int.from_bytes(data[:4], "little")
    ids, counts, null = np.frombuffer(data, "<i8", n, 4).tolist(), np.frombuffer(data, "<u4", n, 4 + 8 * n).tolist(), data[4 + 12 * n :]
    return [(None if z else k, c) for k, c, z in zip(ids, counts, null, strict=True)]


class _Block:
    """The documents of one block: their keys and word numbers, frequent words first once it is closed."""

    def __init__(self, find):
        self.words, self.keys, self.numbers, self.size = _Words(find, {}), [], [], 0

    def add(self, key: int | None, text: str) -> None:
        parts = space_cuts(text)
        self.keys.append(key)
        self.numbers.append(self.words.cut(text) if parts is None else self.words.cut(parts[0]) + b"".join(map(self.words.__getitem__, parts[1:])))
        self.size += len(text)

    def rows(self, buckets: int) -> Iterator[tuple]:
        name, counts = uuid.uuid4().hex, [len(x) // 4 for x in self.numbers]
        flat = np.frombuffer(b"".join(self.numbers), "<u4")
        order = np.argsort(-np.bincount(flat, minlength=len(self.words.numbers)), kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        flat, first, start, held = rank[flat], 0, 0, 0
        for i, n in enumerate(counts, 1):
            held += n
            if held >= CHUNK or i == len(counts):
                yield "docs", name, None, _planes(flat[start : start + held].tobytes()), pack_keys(self.keys[first:i], counts[first:i])
                first, start, held = i, start + held, 0
        texts = list(self.words.numbers)
        spread: dict[int, list] = {}
        for no, i in enumerate(order.tolist()):
            raw = texts[i].encode()
            spread.setdefault(xxhash.xxh3_64_intdigest(raw) % buckets, []).append((no, raw))
        for b, x in spread.items():
            yield "words", name, b, _planes(np.array([no for no, _ in x], "<u4").tobytes()), pack_list([raw for _, raw in x])


def _explode(pattern: str, buckets: int):
    """doc_id, text -> rows of two kinds: word numbers of some documents of a block; a bucket's words of a block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, block = regex.compile(pattern).findall, None
        for batch in it:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = block or _Block(find)
                block.add(key, text)
                if block.size >= BLOCK:
                    yield from (arrow(_ROWS, *([x] for x in row)) for row in block.rows(buckets))
                    block = None
        if block:
            yield from (arrow(_ROWS, *([x] for x in row)) for row in block.rows(buckets))

    return run


_IDS = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("data", pa.binary()), ("used", pa.list_(pa.int32()))])
_IDS_DDL = "block string, bucket int, numbers binary, data binary, used array<int>"


def _encode(file):
    """Rows of words, sorted by bucket -> the same rows with ids for words; each distinct word is encoded once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        core, ids, now = None, {}, None
        for batch in it:
            for block, bucket, numbers, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if core is None:  # its pattern takes a word as it is
                    core = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=read_ranks(file.value), special_tokens={})
                if bucket != now:
                    ids, now = {}, bucket
                out = []
                for w in unpack_list(data):
                    x = ids.get(w)
                    if x is None:
                        x = ids[w] = np.array(core.encode_ordinary(w.decode()), "<u4").tobytes()
                    out.append(x)
                used = np.unique(np.frombuffer(b"".join(out), "<i4"))
                yield arrow(_IDS, [block], [bucket], [numbers], [pack_list(out)], [used])

    return run


_FOUND = pa.schema([("block", pa.string()), ("numbers", pa.binary()), ("data", pa.binary())])


def _fold_tokens(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, bucket, id, token, as they come -> rows of many ids and their bytes; each id of a block is in one of its rows."""
    now, ids, tokens = None, [], []

    def row():
        return arrow(_FOUND, [now[0]], [_planes(np.array(ids, "<u4").tobytes())], [pack_list(tokens)])

    for batch in it:
        for block, bucket, i, token in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (block, bucket) != now:
                if ids:
                    yield row()
                now, ids, tokens = (block, bucket), [], []
            if token is None:
                raise ValueError(f"id {i} is not in the vocabulary")
            ids.append(i)
            tokens.append(token)
    if ids:
        yield row()


def _with_token_bytes(rows: DataFrame, file: bytes) -> DataFrame:
    """(block, bucket, used) -> (block, numbers, data): the ids used, joined with the token-byte table."""
    ranks = read_ranks(file)
    if len(ranks) > MOST_VOCABULARY:
        raise ValueError("a larger vocabulary than the bound allows")
    table = rows.sparkSession.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks.keys(), pa.binary())}))
    used = rows.select("block", "bucket", F.explode("used").alias("id")).join(F.broadcast(table), "id", "left")
    return used.select("block", "bucket", "id", "token").mapInArrow(_fold_tokens, "block string, numbers binary, data binary")


def _numbered(table: pa.Table, kind: str) -> dict[int, bytes]:
    """number -> bytes, of the rows of a kind."""
    out: dict[int, bytes] = {}
    for k, numbers, data in zip(*(table.column(c).to_pylist() for c in ("kind", "numbers", "data")), strict=True):
        if k == kind:
            out.update(zip(_unplane(numbers).tolist(), unpack_list(data), strict=True))
    return out


def _assemble(emit, decoded: bool):
    """A block's documents, its words' ids and its ids' bytes -> what ``emit`` makes of (doc_id, ids, decoded) rows."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        ids = _numbered(words, "ids")
        table = [ids[i] for i in range(len(ids))]
        if decoded:
            token = _numbered(words, "tokens")
            texts = [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in table]
        rows = []
        for numbers, data in zip(docs.column("numbers").to_pylist(), docs.column("data").to_pylist(), strict=True):
            at, flat = 0, _unplane(numbers).tolist()
            for key, n in unpack_keys(data):
                own = flat[at : at + n]
                rows.append((key, b"".join(map(table.__getitem__, own)), b"".join(map(texts.__getitem__, own)) if decoded else None))
                at += n
        return pa.Table.from_batches([emit(rows)])

    return run


def encode_with(docs: DataFrame, path: str, pattern: str, emit, ddl: str, decoded: bool = False) -> DataFrame:
    """docs(doc_id, text) -> rows made by ``emit`` from lists of (doc_id, little-endian 4-byte ids, their bytes if ``decoded``)."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), with_defaults(docs, spark)
    file = spark.sparkContext.broadcast(file_bytes(path))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # In buckets by block, the positions are stored once and stay where they are while the words travel.
    with scratch.bucketed(keyed.mapInArrow(_explode(pattern, 2 * parts), _DDL), "rows", "kind", "block", parts) as rows:
        words = rows.where("kind = 'words'").select("block", "bucket", "numbers", "data").repartition(parts, "bucket").sortWithinPartitions("bucket")
        ids = scratch.keep(words.mapInArrow(_encode(file), _IDS_DDL), "ids")
        scratch.drop("rows/kind=words")
        back = ids.select(F.lit("ids").alias("kind"), "block", "numbers", "data")
        if decoded:
            back = back.unionByName(_with_token_bytes(ids, file.value).select(F.lit("tokens").alias("kind"), "block", "numbers", "data"))
        texts = rows.where("kind = 'docs'").select("block", "numbers", "data")
        out = scratch.keep(texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_assemble(emit, decoded), ddl), "out")
    scratch.drop("ids")
    return out


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    emit = lambda rows: arrow(schema, [k for k, _, _ in rows], [np.frombuffer(x, "<i4") for _, x, _ in rows])
    return encode_with(docs, path, pattern, emit, "doc_id long, ids array<int>")


def _list_ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, ids -> a row per batch: all ids, the documents' keys and lengths, the distinct ids."""
    for batch in it:
        if batch.num_rows:
            lists = [np.array(x, "<i8") for x in batch.column(1).to_pylist()]
            flat = np.concatenate(lists)
            if len(flat) and (flat.min() < 0 or flat.max() >= 2**31):
                raise ValueError("an id is not in the vocabulary")
            yield arrow(_IDS, [uuid.uuid4().hex], [0], [_planes(flat.astype("<u4").tobytes())], [pack_keys(batch.column(0).to_pylist(), [len(x) for x in lists])], [np.unique(flat).astype(np.int32)])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, data binary), by a join of each block's distinct ids with the token-byte table."""
    scratch, file = Scratch(encoded.sparkSession), file_bytes(path)
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids"))
    listed = scratch.keep(rows.where("ids is not null").mapInArrow(_list_ids, _IDS_DDL), "listed")
    tokens = _with_token_bytes(listed, file).select(F.lit("tokens").alias("kind"), "block", "numbers", "data")
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def put_together(docs: pa.Table, found: pa.Table) -> pa.Table:
        token, out = _numbered(found, "tokens"), []
        for numbers, data in zip(docs.column("numbers").to_pylist(), docs.column("data").to_pylist(), strict=True):
            at, flat = 0, _unplane(numbers).tolist()
            for key, n in unpack_keys(data):
                out.append((key, b"".join(map(token.__getitem__, flat[at : at + n]))))
                at += n
        return pa.Table.from_batches([arrow(schema, [k for k, _ in out], [x for _, x in out])])

    known = listed.select("block", "numbers", "data").groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(put_together, "doc_id long, data binary")
    return known.unionByName(rows.where("ids is null").select("doc_id", F.lit(None).cast("binary").alias("data")))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids and what they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def emit(rows):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return arrow(schema, [k for k, _, _ in rows], [len(x) // 4 for _, x, _ in rows], [sha(x) for _, x, _ in rows], [sha(x) for _, _, x in rows])

    return encode_with(docs, path, pattern, emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", decoded=True)
