"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are dealt to buckets by pairs of bit blocks: two that differ in r bits agree in at
least blocks - r blocks, so every link meets in a bucket. In a bucket the bits are stored as
planes (plane p holds bit p of every fingerprint); one query updates the distances of all lanes of
a block with a carry-save counter of two or three bit words and leaves the block once all its
lanes are over the radius. Each bucket yields a spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_as_bytes, deal_groups, keep_one_each, materialize, runs, signed
from .components import connected_components

RADIUS, BLOCKS, SHINGLE, SEED = 3, 5, 3, 42
#: Lanes that one query compares at a time, and fingerprints of a bucket that one task takes whole.
LANES, CHUNK = 1024, 4096


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of whole text: words between ASCII white space, A-Z lower-cased, repeats counted."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in columns_as_bytes(batch, "text")], np.uint64).view(np.int64)
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.int64())], [*rest, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(_fingerprints, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def bit_planes(fps: np.ndarray) -> list[int]:
    """Plane p as an integer whose bit i is bit p of fps[i]."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]


def lanes_within(planes: list[int], full: int, value: int, radius: int) -> int:
    """Lanes at a distance of at most radius from value. The counter starts so that it runs over at radius + 1."""
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    count = [full if start >> k & 1 else 0 for k in range(width)]
    over = 0
    for p, plane in enumerate(planes):
        carry = plane ^ full if value >> p & 1 else plane
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
            if not carry:
                break
        over |= carry
        if over == full:
            return 0
    return full & ~over


def forest(fps: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (i, j) that connect whatever the links of distance <= radius connect, each lane reached once.

    With side, only links between rows of different sides count.
    """
    n = len(fps)
    blocks = []
    for at in range(0, n, LANES):
        part = fps[at : at + LANES]
        full = (1 << len(part)) - 1
        allowed = [full, full]
        if side is not None:
            ones = int.from_bytes(np.packbits(side[at : at + LANES].astype(bool), bitorder="little").tobytes(), "little")
            allowed = [ones, full & ~ones]
        blocks.append((at, bit_planes(part), full, allowed))
    waiting = [b[2] for b in blocks]
    values = [int(x) for x in fps.view(np.uint64)]
    links = []
    for first in range(n):
        if not waiting[first // LANES] >> (first % LANES) & 1:
            continue
        waiting[first // LANES] &= ~(1 << first % LANES)
        stack = [first]
        while stack:
            i = stack.pop()
            other = 0 if side is None else int(bool(side[i]))
            for b, (at, planes, full, allowed) in enumerate(blocks):
                if not waiting[b] & allowed[other]:
                    continue
                near = lanes_within(planes, full, values[i], radius) & waiting[b] & allowed[other]
                waiting[b] &= ~near
                while near:
                    low = near & -near
                    j = at + low.bit_length() - 1
                    near ^= low
                    links.append((i, j))
                    stack.append(j)
    return links


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for group in runs(batches, ["key", "a", "b"]):
            fps = group["fp"].to_numpy()
            a, b = group["a"][0].as_py(), group["b"][0].as_py()
            side = None if a == b else group["chunk"].to_numpy() == a
            for i, j in forest(fps, side, radius):
                src.append(int(fps[i]))
                dst.append(int(fps[j]))
            if len(src) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def block_keys(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks, one a table: every set of blocks - radius blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def smaller_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """mask with each of radius + 1 parts of the bits that it leaves out."""
    left = [i for i in range(64) if not mask >> i & 1]
    edges = [round(len(left) * k / (radius + 1)) for k in range(radius + 2)]
    return [mask | sum(1 << i for i in left[a:b]) for a, b in zip(edges, edges[1:])]


def bucket_groups(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(key, fp, chunk, a, b): the groups in which any two fingerprints (column fp) within radius meet.

    Fingerprints of a bucket that differ in radius bits at most agree in one of radius + 1 parts of
    the bits that name no bucket. So one of more than chunk fingerprints is split by each part, at
    radius + 1 rows for a fingerprint; only what then still exceeds chunk, with some 36 bits alike,
    gets m chunks by hash, and each pair of chunks is a group of its own. No task takes a whole hot
    bucket.
    """
    masks = block_keys(radius, blocks)
    tables = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(map(signed, masks))])
    dealt = distinct.select("fp", F.posexplode(tables).alias("k", "key"))

    def split(rows: DataFrame) -> DataFrame:
        finer = zip(*[map(signed, smaller_masks(m, radius)) for m in masks])
        of_table = [F.get(F.array(*map(F.lit, part)), F.col("k")) for part in finer]
        keys = F.array(*[F.xxhash64("k", F.lit(j), F.col("fp").bitwiseAND(m)) for j, m in enumerate(of_table)])
        return rows.select("fp", F.explode(keys).alias("key"))

    return deal_groups(dealt, "fp", chunk, split)


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) links between distinct fingerprints (column fp) that connect the same as all links within radius."""
    return bucket_groups(distinct, radius, blocks, chunk).mapInArrow(_bucket_links(radius), "src long, dst long")


def near_classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, first, root) of rows(id, fp): each fingerprint's least id, and the fingerprint that names its component."""
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    linked = connected_components(near_links(classes.select("fp"), radius))
    named = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    return materialize(named, "named")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id reachable over links of distance <= radius.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat are
    returned as often as they come; a null id never names a component unless all its rows have
    one. An empty table gives no rows. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    named = near_classes(rows, radius)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of docs for each group of near copies, columns unchanged.

    The row with the least id stays, any id before a null one; of rows that share that id the one
    whose text has the least SHA-256, and of rows that share both, one, with a text before without.
    So groups are told apart by their fingerprints, not by ids, which may repeat. Null and empty
    texts are one group with all else of fingerprint zero. An empty table stays empty.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    given = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.col(text_col).alias("text"))
    rows = given.mapInArrow(_fingerprints, f"id {docs.schema[id_col].dataType.simpleString()}, digest binary, fp long")
    rows = materialize(rows, "fingerprints")
    of_class = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best"))
    best = of_class.join(near_classes(rows, radius).select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    return keep_one_each(docs, best.select("best.id", "best.digest"), id_col, text_col, digest)
