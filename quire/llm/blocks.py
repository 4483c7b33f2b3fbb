"""Exchange of hashes and fragments of text between blocks of documents.

Documents are dealt into blocks of a few MB by ranges of doc_id, so that the order of blocks is the order of
ids. A block asks about distinct hashes: it sends them, sorted and as byte-wide differences, to
parts that each own a range of hash values. A part compares what all blocks sent and answers with two bits for each hash:
does another block have it, and does an earlier one. Hot hashes cost a part one entry for each block at most.
Fragments of text whose hashes recur go to parts the same way, once for each block. Ids, links or hashes of all documents are never gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
ASKED = "block int, pass int, part int, asked binary, more binary"
BLOCK_BYTES = 8 << 20
#: Cuts by quantiles in each of two levels; bytes that count as one row; bytes of rows that a task compresses together.
_CUTS, _STEP, _HELD = 64, 4096, 32 << 20


def blocked(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict]:
    """The rows as compressed tables (block int, rows binary), block numbers rising with doc_id, and what holds for all: blocks, parts, bytes, rows.

    Cuts follow up to _CUTS * _CUTS approximate quantiles of the ids, in which a row counts once for each _STEP bytes of its text, evenly within them; so neither clustered ids nor
    runs of long texts overfill a block. Equal ids share a block, and a null id counts as the least.
    """
    weighed = df.select("doc_id", F.octet_length("text").alias("n")).select("doc_id", "n", F.explode(F.expr(f"sequence(0, coalesce(n, 0) div {_STEP})")).alias("k"))
    row = weighed.agg(
        F.sum(F.expr("if(k = 0, 1, 0)")).alias("rows"), F.coalesce(F.sum(F.expr("if(k = 0, n, 0)")), F.lit(0)).alias("bytes"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        F.percentile_approx("doc_id", [k / _CUTS**2 for k in range(1, _CUTS**2)], 20000).alias("cuts"),
    ).first()
    n = max(1, math.ceil((row["bytes"] + 64 * (row["rows"] or 0)) / block_bytes))
    all_ = {"blocks": n, "parts": max(1, n // 2), "bytes": row["bytes"], "rows": row["rows"] or 0}
    if n == 1 or row["lo"] is None:
        return _zipped(df.withColumn("block", F.lit(0))), {**all_, "blocks": 1, "parts": 1}
    step = max(1, math.ceil(_CUTS**2 / n))
    cuts = sorted({row["lo"], *row["cuts"][step - 1 :: step], row["hi"] + 1})
    cells, top = len(cuts) - 1, cuts[:-1:_CUTS]
    first = [k * n // cells for k in range(cells + 1)]
    longs = lambda x: "array(" + ",".join(f"{v}L" for v in x) + ")"
    below = "array(" + ",".join(longs(cuts[k : min(k + _CUTS, cells)]) for k in range(0, cells, _CUTS)) + ")"
    df = df.withColumn("block", F.expr(f"size(filter({longs(top)}, x -> x <= doc_id)) - 1"))
    df = df.withColumn("block", F.expr(f"block * {_CUTS} + size(filter(get({below}, block), x -> x <= doc_id)) - 1"))
    share = f"least((doc_id - get({longs(cuts)}, block)) / double(get({longs(cuts)}, block + 1) - get({longs(cuts)}, block)), 0.999999999D)"
    df = df.withColumn("block", F.expr(f"int(if(doc_id is null, 0, get({longs(first)}, block) + floor({share} * greatest(1, get({longs(first)}, block + 1) - get({longs(first)}, block)))))"))
    return _zipped(df), all_


def _zipped(df: DataFrame) -> DataFrame:
    """(block, rows): the rows of a block that a task reads one after another, as one compressed table."""
    names = [c for c in df.columns if c != "block"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > _HELD:
                yield _cut(held)
                held, size = [], 0
        if held:
            yield _cut(held)

    def _cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by("block")
        k = t["block"].to_numpy()
        edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else [0]
        t = t.select(names).combine_chunks()
        blobs = [_sent(t.slice(a, b - a)) for a, b in zip(edge, edge[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(k[edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["block", "rows"])

    return df.select("block", *names).mapInArrow(f, "block int, rows binary")


def _sent(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return zipped(out.getvalue().to_pybytes())


def _got(t: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(unzipped(x.as_buffer().to_pybytes())).read_all() for x in t["rows"]])


def zipped(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def unzipped(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def part_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part that owns each key."""
    edges = np.array([((p << bits) + parts - 1) // parts for p in range(1, parts)], dtype=object).astype(U64) if parts > 1 else np.zeros(0, U64)
    return np.searchsorted(edges, keys, "right")


def rows_for(block: int, step: int, parts: list[int], asked: list[bytes], more: list[bytes] | None = None) -> pa.Table:
    n = len(parts)
    return pa.table({
        "block": pa.array([block] * n, pa.int32()), "pass": pa.array([step] * n, pa.int32()), "part": pa.array(parts, pa.int32()),
        "asked": pa.array(asked, pa.binary()), "more": pa.array(more if more is not None else [b""] * n, pa.binary()),
    })


def pack(keys: np.ndarray) -> bytes:
    """Sorted integers as the first and differences of a common byte width; the highest byte of all, mostly small, is compressed."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    raw = steps.view(np.uint8).reshape(-1, 8)
    high = zipped(raw[:, width - 1].tobytes())
    return bytes([width]) + keys[:1].tobytes() + len(high).to_bytes(4, "little") + high + np.ascontiguousarray(raw[:, : width - 1]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    width, first, n = blob[0], np.frombuffer(blob, U64, 1, 1), int.from_bytes(blob[9:13], "little")
    high = np.frombuffer(unzipped(blob[13 : 13 + n]), np.uint8)
    steps = np.zeros((len(high) + 1, 8), np.uint8)
    steps[1:, width - 1] = high
    steps[1:, : width - 1] = np.frombuffer(blob, np.uint8, offset=13 + n).reshape(len(high), width - 1)
    steps = steps.view(U64).ravel()
    steps[0] = first[0]
    return np.cumsum(steps, dtype=U64)


def bits_for(n: int, spare: int = 12) -> int:
    """So many bits that a hash of one of n windows meets another by chance once in 2**spare."""
    return int(min(64, max(16, math.ceil(math.log2(max(2, n))) + spare)))


def split(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part's share of the sorted keys (of so many bits) begins; one more than parts."""
    edges = np.array([((p << bits) + parts - 1) // parts for p in range(1, parts)], dtype=object)
    return np.concatenate([[0], np.searchsorted(keys, edges.astype(U64) if len(edges) else np.zeros(0, U64)), [len(keys)]]).astype(np.int64)


def ask(block: int, step: int, keys: np.ndarray, bits: int, parts: int, more: np.ndarray | None = None) -> pa.Table:
    """Rows that ask about sorted distinct keys; more: a count with each key (then every part is asked, for its totals)."""
    cut = split(keys, bits, parts)
    full = [p for p in range(parts) if cut[p + 1] > cut[p] or more is not None]
    blob = lambda p: b"" if more is None else more[cut[p] : cut[p + 1]].tobytes()
    return pa.table({
        "block": pa.array([block] * len(full), pa.int32()), "pass": pa.array([step] * len(full), pa.int32()), "part": pa.array(full, pa.int32()),
        "asked": pa.array([pack(keys[cut[p] : cut[p + 1]]) for p in full], pa.binary()), "more": pa.array([blob(p) for p in full], pa.binary()),
    })


def _seen(asked: pa.Table) -> pa.Table:
    """The answers of one part: for each block's keys, does another block have it; does an earlier one."""
    asked = asked.sort_by("block")
    got = [unpack(x.as_buffer().to_pybytes()) for x in asked["asked"]]
    sizes = [len(x) for x in got]
    keys = np.concatenate(got) if got else np.zeros(0, U64)
    del got
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    s = keys[order]
    same[1:] = s[1:] == s[:-1]
    shared = same.copy()
    shared[:-1] |= same[1:]
    earlier, other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order], other[order] = same, shared
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    out = [(np.packbits(other[a:b]).tobytes(), np.packbits(earlier[a:b]).tobytes()) for a, b in zip(at, at[1:], strict=False)]
    return asked.set_column(3, "asked", pa.array([x for x, _ in out], pa.binary())).set_column(4, "more", pa.array([x for _, x in out], pa.binary()))


def answers(asked: DataFrame, answer: Callable[[pa.Table], pa.Table] = _seen) -> DataFrame:
    return asked.groupBy("part").applyInArrow(lambda t: answer(t).select(ASKED_NAMES).cast(_schema()), ASKED)


ASKED_NAMES = [x.split()[0] for x in ASKED.split(", ")]


def _schema() -> pa.Schema:
    return pa.schema([("block", pa.int32()), ("pass", pa.int32()), ("part", pa.int32()), ("asked", pa.binary()), ("more", pa.binary())])


def told(replies: pa.Table, step: int, keys: np.ndarray, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sorted keys that a block asked about in a pass: does another block have it; does an earlier one."""
    cut = split(keys, bits, parts)
    other, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for p, a, b in rows_of(replies, step):
        n = int(cut[p + 1] - cut[p])
        other[cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(a, np.uint8), count=n)
        earlier[cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=n)
    return other, earlier


def rows_of(replies: pa.Table, step: int) -> Iterable[tuple[int, bytes, bytes]]:
    for k, p, a, b in zip(replies["pass"].to_pylist(), replies["part"].to_pylist(), replies["asked"], replies["more"], strict=True):
        if k == step:
            yield p, a.as_buffer().to_pybytes(), b.as_buffer().to_pybytes()


def in_order(t: pa.Table) -> pa.Table:
    """Rows by doc_id, a null first; rows of one id by their text."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if t["doc_id"].null_count == 0 else pa.concat_tables([
        t.filter(pc.is_null(t["doc_id"])).sort_by("text"), t.filter(pc.is_valid(t["doc_id"])).sort_by([("doc_id", "ascending"), ("text", "ascending")])])


def ranks(t: pa.Table) -> np.ndarray:
    """For each of the ordered rows a number that is equal for equal ids and rises with the id."""
    ids = np.array(pc.fill_null(t["doc_id"], 0).to_numpy())
    new = np.ones(len(ids), bool)
    valid = pc.is_valid(t["doc_id"]).to_numpy()
    new[1:] = (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])
    return np.cumsum(new)


def first_ask(texts: DataFrame, f: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    return texts.groupBy("block").applyInArrow(lambda key, t: f(key[0].as_py(), _got(t)), ASKED)


def with_answers(texts: DataFrame, replies: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str = ASKED) -> DataFrame:
    def g(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        return f(key[0].as_py(), _got(t), r)

    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(g, schema)
