"""Removes bytes covered by any 400-byte string that starts elsewhere too, by sorting suffixes.

Suffixes are sorted where it matters. Every window of 400 bytes has an anchor, the leftmost least
hash of its 32-byte grams, and equal windows have it at the same offset. So two windows are equal
only if their anchors share the gram, and the anchors' contexts (what the windows of that anchor
span) hold all of them. Anchors with the same gram form a group; identical contexts are one. A
group's right contexts (suffixes at the anchor) and left contexts (reversed) are put in order by
deep-shallow sorting: multikey quicksort to a shallow depth, then a blind trie for each group that
still ties. The LCP intervals of the right order, with the left order inside, give exactly the
offsets at which a window of the context stands somewhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_as_bytes, materialize, mix, runs
from .decontam import merged

LENGTH, GRAM, SHALLOW, STEP = 400, 32, 64, 8
#: Contexts of one gram that one task takes; more are dealt out by the quarter of a window they share,
#: and of those that share it, more than this many by their windows themselves.
CHUNK = 4096
_PIECE = 1 << 20
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


def window_anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window start, anchor, last window start) for each run of windows with one anchor.

    gram must be a power of two. Texts of over 2 ** 20 bytes are taken in pieces that overlap.
    """
    found: list[tuple[np.ndarray, ...]] = []
    stride = _PIECE - length
    for base in range(0, max(1, len(data) - length + 1), stride):
        part = np.frombuffer(data, np.uint8, count=min(_PIECE - 1, len(data) - base), offset=base)
        if len(part) < length:
            continue
        h = _BYTE[part]
        size = 1
        while size < gram:
            h = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
            size *= 2
        least = (h & np.uint64(~(_PIECE - 1) & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        least = least[:stride]
        at = (least & np.uint64(_PIECE - 1)).astype(np.int64)
        edge = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge - 1, [len(at) - 1]])
        p = at[first]
        found.append((h[p].view(np.int64), first + base, p + base, last + base))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Orders strings that share a prefix: a node keeps the depth of its branching and the branching bytes only."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [None, None, [i]]
            return
        node = self.root
        while node[0] is not None:  # blindly down, then to any leaf
            byte = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        t = self.strings[node[2][0]]
        depth = lcp(s, t)
        if depth == len(s) == len(t):
            node[2].append(i)
            return
        parent, node = None, self.root
        while node[0] is not None and node[0] < depth:
            byte = s[node[0]] if node[0] < len(s) else -1
            parent, node = (node, byte), node[1][byte]
        new = s[depth] if depth < len(s) else -1
        if node[0] == depth:
            node[1][new] = [None, None, [i]]
            return
        old = t[depth] if depth < len(t) else -1
        branch = [depth, {old: node, new: [None, None, [i]]}, None]
        if parent is None:
            self.root = branch
        else:
            parent[0][1][parent[1]] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[2]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of strings in order; equal strings keep theirs."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
            continue
        if depth >= shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            out += trie.order()
            continue
        keys = [strings[i][depth : depth + STEP] for i in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, k in zip(group, keys) if k < pivot]
        same = [i for i, k in zip(group, keys) if k == pivot]
        more = [i for i, k in zip(group, keys) if k > pivot]
        if more:
            stack.append((more, depth))
        if len(pivot) < STEP:
            stack += [([i], depth) for i in reversed(same)]  # they end here, so they are equal
        else:
            stack.append((same, depth + STEP))
        if less:
            stack.append((less, depth))
    return out


def repeated_offsets(contexts: list[tuple[bytes, bytes]], length: int = LENGTH, low: int = 0, high: int | None = None) -> list[list[tuple[int, int]]]:
    """For each (left, right) around an anchor, the offsets d, as [from, to], whose window stands in another context too.

    Window d takes the last d bytes of left and the first length - d of right. Only low <= d <= high counts.
    """
    high = length if high is None else high
    rights = [r for _, r in contexts]
    lefts = [x[::-1] for x, _ in contexts]
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]

    def take(members: list[int], depth: int) -> None:
        start = max(length - depth, low)
        if start > high or depth + max(len(lefts[i]) for i in members) < length:
            return
        members = sorted(members, key=place.__getitem__)
        near = [lcp(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for k, i in enumerate(members):
            reach = min(high, max(near[k - 1] if k else 0, near[k] if k < len(near) else 0))
            if reach >= start:
                found[i].append((start, reach))

    if len(contexts) == 2:
        place = [0, 1]
        take([0, 1], lcp(rights[0], rights[1]))
        return found
    place = [0] * len(contexts)
    for rank, i in enumerate(deep_shallow_order(lefts)):
        place[i] = rank
    order = deep_shallow_order(rights)
    heights = [lcp(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    stack: list[tuple[int, int]] = []  # (height, first place in order)
    for k, height in enumerate([*heights, -1]):
        first = k
        while stack and stack[-1][0] > height:
            deep, first = stack.pop()
            take(order[first : k + 1], deep)
        if height >= 0 and (not stack or stack[-1][0] < height):
            stack.append((height, first))
    return found


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entry = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("a", pa.int64()), ("p", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        ids, texts = batch.column("id"), columns_as_bytes(batch, "text")
        at = 0
        while at < len(texts):
            begin, flat, sizes, marks = at, [], [0], []
            while at < len(texts) and sizes[-1] < 400_000:
                data = texts[at]
                h, a, p, b = window_anchors(data)
                c = np.array([xxhash.xxh3_64_intdigest(data[i : j + LENGTH], k) for i, j, k in zip(a.tolist(), b.tolist(), (p - a).tolist())], np.uint64).view(np.int64)
                flat.append((h, c, a, p, b))
                sizes.append(sizes[-1] + len(h))
                marks.append(hashlib.sha256(data).digest())
                at += 1
            cols = [pa.array(np.concatenate(x)) for x in zip(*flat)]
            places = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(entry.value_type)))
            yield pa.RecordBatch.from_arrays([ids.slice(begin, at - begin), pa.array(marks, pa.binary()), places], ["id", "mark", "anchors"])


def _contexts(chunk: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    names = ("h", "key", "c", "quarter", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for data, places in zip(columns_as_bytes(batch, "text"), batch.column("places").to_pylist()):
                for x in places:
                    a, p, b = x["a"], x["p"], x["b"]
                    left, right = data[a:p], data[p : b + LENGTH]
                    if x["n"] <= chunk:
                        rows.append((x["h"], x["h"], x["c"], -1, left, right))
                    else:
                        quarter = LENGTH // 4
                        for j in range(max(0, p - b) // quarter, min(3, (p - a) // quarter) + 1):
                            core = data[max(a, p - j * quarter) : p - j * quarter + LENGTH - quarter]
                            key = np.uint64(xxhash.xxh3_64_intdigest(core, j + 1)).view(np.int64)
                            rows.append((x["h"], int(key), x["c"], j, left, right))
                    held += len(left) + len(right)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def offsets_of(quarter: int) -> tuple[int, int]:
    """The least and the largest offset of windows that a group answers for; -1 is a gram's whole group."""
    part = LENGTH // 4
    return (0, LENGTH) if quarter < 0 else (quarter * part, LENGTH if quarter == 3 else (quarter + 1) * part - 1)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, low, w) for each window of contexts in a vast group: w is the window's 128-bit hash."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = []
            for r in batch.slice(at, 2000).to_pylist():
                low, high = offsets_of(r["quarter"])
                whole, left, right = r["left"] + r["right"], len(r["left"]), len(r["right"])
                for d in range(max(low, LENGTH - right), min(high, left) + 1):
                    rows.append((r["h"], r["c"], d, xxhash.xxh3_128_digest(whole[left - d : left - d + LENGTH])))
            if rows:
                h, c, d, w = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(w, pa.binary())], ["h", "c", "low", "w"])


def vast_matches(drawn: DataFrame, vast: DataFrame) -> DataFrame:
    """(h, c, low, high) for groups (h, quarter, key) too large to sort in one task: equal windows meet by hash.

    A window's contexts are only reduced to the least and the largest, so one in a third of all
    texts costs a task no more than any other.
    """
    windows = drawn.join(vast, ["h", "quarter", "key"], "left_semi").select("h", "c", "quarter", "left", "right").mapInArrow(_windows, "h long, c long, low long, w binary")
    shared = windows.groupBy("h", "w").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first != last").select("h", "w")
    return windows.join(shared, ["h", "w"], "left_semi").select("h", "c", "low", F.col("low").alias("high")).distinct()


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["h", "quarter", "key"]):
        if group.num_rows < 2:
            continue
        h, j, cs = group["h"][0].as_py(), group["quarter"][0].as_py(), group["c"].to_pylist()
        low, high = offsets_of(j)
        found = repeated_offsets(list(zip(group["left"].to_pylist(), group["right"].to_pylist())), LENGTH, low, high)
        rows = [(c, lo, hi) for c, spans in zip(cs, found) for lo, hi in spans]
        if rows:
            c, lo, hi = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([h] * len(c), pa.int64()), pa.array(c, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["h", "c", "low", "high"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        removed, spans, shas = [], [], []
        for data, found in zip(columns_as_bytes(batch, "text"), batch.column("found").to_pylist()):
            cut = merged([(x["start"], x["stop"]) for x in found])
            rest, at = hashlib.sha256(), 0
            for a, b in cut:
                rest.update(data[at:a])
                at = b
            rest.update(data[at:])
            removed.append(sum(b - a for a, b in cut))
            spans.append([{"start": a, "stop": b} for a, b in cut])
            shas.append(rest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(shas, pa.string())], ["mark", "n_removed", "spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) for every row.

    A byte goes if a 400-byte string that covers it also starts anywhere else, in the same text or
    another; overlaps count, and what stands in the input decides. spans are the merged removed
    runs of bytes [start, stop); kept_sha256 is the digest of the bytes that remain, joined. Null
    texts are empty; texts of under 400 bytes stay. Rows that repeat, with the same id or not, are
    exact copies: all their bytes go if they have 400. An empty table gives no rows. Other columns
    are not read. Texts are moved twice, and only to join what one document of each kind needs. No
    task sorts more than chunk contexts at a time; what is left over matches by windows' hashes.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = texts.where(F.octet_length("text") >= LENGTH)
    kind = docs.schema[id_col].dataType.simpleString()
    entry = "array<struct<h:long,c:long,a:long,p:long,b:long>>"
    sketch = long.mapInArrow(_sketch, f"id {kind}, mark binary, anchors {entry}")
    classes = sketch.groupBy("mark").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("anchors").alias("anchors"))
    classes = materialize(classes, "classes")
    places = classes.select("mark", "first", F.inline("anchors"))
    same = materialize(places.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("mark", "first", "a", "p", "b")).alias("at")), "contexts")
    crowded = same.groupBy("h").agg(F.count("*").alias("of_gram")).where("of_gram > 1")
    wanted = same.join(crowded, "h").select(F.col("at.mark").alias("mark"), F.col("at.first").alias("own"), F.struct("h", "c", F.col("at.a").alias("a"), F.col("at.p").alias("p"), F.col("at.b").alias("b"), F.col("of_gram").alias("n")).alias("place"))
    wanted = wanted.groupBy("mark", "own").agg(F.collect_list("place").alias("places"))
    owned = long.join(wanted, F.col("id").eqNullSafe(F.col("own"))).where(F.unhex(F.sha2("text", 256)) == F.col("mark"))
    drawn = owned.select("text", "places").mapInArrow(_contexts(chunk), "h long, key long, c long, quarter int, left binary, right binary")
    apart = None
    if not crowded.where(F.col("of_gram") > chunk).isEmpty():
        drawn = materialize(drawn, "drawn")
        group = ["h", "quarter", "key"]
        vast = materialize(drawn.where("quarter >= 0").groupBy(*group).count().where(F.col("count") > chunk).select(*group), "vast")
        if not vast.isEmpty():
            apart = vast_matches(drawn, vast)
            drawn = drawn.join(vast, group, "left_anti")
    drawn = drawn.repartition("h", "key").dropDuplicates(["h", "key", "quarter", "c"]).sortWithinPartitions("h", "quarter", "key", "c")
    partly = drawn.mapInArrow(_matches, "h long, c long, low long, high long")
    partly = partly if apart is None else partly.unionByName(apart)
    partly = partly.groupBy("h", "c").agg(F.collect_set(F.struct("low", "high")).alias("offsets"))
    wholly = same.where("n > 1").select("h", "c", F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(1 << 40).alias("high"))).alias("offsets"))
    known = materialize(partly.join(wholly.select("h", "c"), ["h", "c"], "left_anti").unionByName(wholly), "offsets")
    alone = classes.where("n = 1").select("mark", "first", F.inline("anchors"))
    runs_ = alone.join(known, ["h", "c"]).select("mark", "first", "a", "p", "b", F.explode("offsets").alias("o"))
    start = F.greatest(F.col("a"), F.col("p") - F.col("o.high"))
    stop = F.least(F.col("b"), F.col("p") - F.col("o.low")) + LENGTH
    spans = runs_.select("mark", "first", F.struct(start.alias("start"), stop.alias("stop")).alias("span"))
    spans = spans.groupBy("mark", F.col("first").alias("own")).agg(F.collect_list("span").alias("found"))
    cut = long.join(spans, F.col("id").eqNullSafe(F.col("own"))).where(F.unhex(F.sha2("text", 256)) == F.col("mark"))
    cut = cut.select("mark", "text", "found").mapInArrow(_cut, "mark binary, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string")
    size = F.octet_length("text").cast("long")
    rows = texts.select("id", size.alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("mark"))
    copies = classes.where("n > 1").select("mark", F.lit(True).alias("gone"))
    told = rows.join(copies.join(cut, "mark", "full_outer"), "mark", "left")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    return told.select(
        "id",
        "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("gone"), all_).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("gone"), F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("mark")))).alias("kept_sha256"),
    )
