"""Removes repeated passages: paragraph MinHash banding, and content-anchored windows.

Paragraphs (lines) of at least SHINGLE words are banded by MinHash of their five-word shingles;
colliding paragraphs are joined, their Jaccard similarity is verified on the shingle sets
themselves and the links are clustered. Shorter lines have no shingle: they are matched by exact
content and reported, and stay in the text. A passage that stands inside longer, different paragraphs
has no similar paragraph; so the text is also covered by windows of MIN_WORDS words that start at
local minima of the shingle hash (winnowing): any shared run of MIN_WORDS + SPREAD words holds a
common window, which is matched by content. Neighbouring minima are at most SPREAD words apart, so
a run goes on for less than SPREAD words beyond its outer common windows: all windows that start
there are matched by content too, which removes the run to where the words stop agreeing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_as_bytes, deal_groups, discard, gram_hashes, materialize, mix, runs, signed
from .components import connected_components

SHINGLE, SIMILARITY, RECALL, MAX_BANDS = 5, 0.8, 0.995, 8
MIN_WORDS, SPREAD = 25, 25
CHUNK = 2048
#: Words of consecutive texts that are hashed together; a longer text is hashed alone.
BLOCK_WORDS = 200_000
DOCUMENT, PARAGRAPH, WINDOW, EXTENSION, SHORT = 0, 1, 2, 3, 4


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest idle candidates, whose recall at the similarity holds within max_bands."""
    best = None
    for rows in range(1, 33):
        need = np.log(1 - recall) / np.log(1 - similarity**rows)
        if int(np.ceil(need)) <= max_bands:
            best = int(np.ceil(need)), rows
    return best or (max_bands, 1)


def band_keys(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash band keys [segment, band] of the segments of grams that begin at starts.

    The grams are mixed hashes already, so an odd factor for each row orders them anew.
    """
    keys = np.zeros((len(starts), bands), np.uint64)
    own = grams.view(np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(starts), band + 1, np.uint64)
            for row in range(rows):
                salt = np.uint64(xxhash.xxh64_intdigest(b"%d:%d" % (band, row)) | 1)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(own * salt, starts))
            keys[:, band] = key
    return keys.view(np.int64)


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions that are the leftmost least of some run of span grams; of shorter texts, of the whole."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    span = min(span, n)
    seen = np.lib.stride_tricks.sliding_window_view(grams, span)
    return np.unique(np.argmin(seen, axis=1) + np.arange(len(seen)))


def window_hashes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows of MIN_WORDS words at the given places, of the grams that lie in them end to end."""
    h = np.full(len(at), MIN_WORDS, np.uint64)
    for i in range(0, MIN_WORDS, SHINGLE):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grams[at + i].view(np.uint64))
    return h.view(np.int64)


def extension_starts(start: np.ndarray, keeper: np.ndarray, place: np.ndarray, own: np.ndarray, last: int) -> np.ndarray:
    """Starts of the windows to be matched around a document's common windows, none beyond last.

    For each common window: where it stands (start), which document keeps it, where it stands there
    (place), and whether that is this very place (own). Two neighbours that another document keeps
    at the same distance cover their words as they do there, and that document has
    the windows between them; a copy so gives only what lies beyond its outer common windows.
    """
    order = np.argsort(start)
    start, keeper, place, own = start[order], keeper[order], place[order], own[order]
    depth = np.zeros(last + 2, np.int32)
    np.add.at(depth, np.maximum(0, start - SPREAD + 1), 1)
    np.add.at(depth, np.minimum(last + 1, start + SPREAD), -1)
    wanted = np.cumsum(depth) > 0
    wanted[start] = own
    gap = np.diff(start)
    alike = ~own[:-1] & ~own[1:] & (keeper[:-1] == keeper[1:]) & (gap == np.diff(place)) & (gap <= MIN_WORDS)
    depth[:] = 0
    np.add.at(depth, start[:-1][alike], 1)
    np.add.at(depth, start[1:][alike] + 1, -1)
    return np.flatnonzero((wanted & (np.cumsum(depth) == 0))[: last + 1])


def listed(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(bounds, values): the lists of a column stand in values from bound to bound; null is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), column.flatten()


def as_lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def _units(bands: int, rows: int):
    names = ["id", "mark", "kind", "start", "size", "content", "bands"]

    def told(ids: pa.Array, words: list[bytes], texts: list[tuple[int, int, list]]) -> Iterator[pa.RecordBatch]:
        grams = gram_hashes(words, SHINGLE)  # those that go on into the next text are not used
        marks = np.array([t[0] for t in texts], np.int64)
        begin = np.array([t[1] for t in texts], np.int64)
        n_words = np.diff(np.append(begin, len(words)))
        n_lines = np.array([len(t[2]) for t in texts], np.int64)
        start, size = np.array([x for t in texts for x in t[2]], np.int64).reshape(-1, 2).T
        owner = np.repeat(np.arange(len(texts)), n_lines)
        at = begin[owner] + start

        def batch(kind: np.ndarray, owner: np.ndarray, start: np.ndarray, size: np.ndarray, content: np.ndarray, bands: pa.Array) -> pa.RecordBatch:
            narrow = (pa.array(x, pa.int32()) for x in (kind, start, size))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(marks[owner]), *narrow, pa.array(content, pa.int64()), bands], names)

        long = size >= SHINGLE
        if long.any():
            n = size[long] - SHINGLE + 1
            first = np.cumsum(n) - n
            inside = grams[np.repeat(at[long] - first, n) + np.arange(n.sum())]
            content = np.array([xxhash.xxh3_64_intdigest(inside[a : a + m].tobytes()) for a, m in zip(first.tolist(), n.tolist())], np.uint64).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(band_keys(inside, first, bands, rows).ravel()))
            yield batch(np.full(len(n), PARAGRAPH), owner[long], start[long], size[long], content, keys)
        short = ~long
        lines = [xxhash.xxh3_64_intdigest(b" ".join(words[a : a + m])) for a, m in zip(at[short].tolist(), size[short].tolist())]
        wide = np.flatnonzero(n_words >= MIN_WORDS)
        found = [anchors(grams[b : b + n - MIN_WORDS + 1], SPREAD) for b, n in zip(begin[wide].tolist(), n_words[wide].tolist())]
        window = np.concatenate([np.zeros(0, np.int64), *found])
        of = np.repeat(wide, [len(x) for x in found])
        parts = (
            (DOCUMENT, np.arange(len(texts)), n_lines, n_words, np.zeros(len(texts), np.int64)),
            (SHORT, owner[short], start[short], size[short], np.array(lines, np.uint64).view(np.int64)),
            (WINDOW, of, window, np.full(len(window), MIN_WORDS), window_hashes(grams, begin[of] + window)),
        )
        kind = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        yield batch(kind, *(np.concatenate([p[i] for p in parts]) for i in range(1, 5)), pa.nulls(len(kind), pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done, words, texts = batch.column("id"), 0, [], []
            for data in columns_as_bytes(batch, "text"):
                begin, lines = len(words), []
                for line in data.lower().split(b"\n"):
                    if own := line.split():
                        lines.append((len(words) - begin, len(own)))
                        words += own
                texts.append((signed(xxhash.xxh64_intdigest(data, 42)), begin, lines))  # as Spark's xxhash64
                if len(words) >= BLOCK_WORDS:
                    yield from told(ids.slice(done, len(texts)), words, texts)
                    done, words, texts = done + len(texts), [], []
            if texts:
                yield from told(ids.slice(done), words, texts)

    return run


def text_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, kind, start, size, content, bands): each document's header, paragraphs, short lines and windows.

    The start of a header is the number of lines that hold words.
    """
    bands, rows = tune_bands()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(_units(bands, rows), f"id {docs.schema[id_col].dataType.simpleString()}, mark long, kind int, start int, size int, content long, bands array<long>")


def _read_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text one row (start, window) with the windows around its common ones, and one (content, shingles) for each paragraph."""
    names = ["id", "mark", "start", "window", "content", "shingles"]
    longs = pa.list_(pa.int64())
    for batch in batches:
        hit_bounds, hits = listed(batch.column("hits"))
        place_bounds, places = listed(batch.column("places"))
        start, keeper, place, own = (hits.field(k).to_numpy(zero_copy_only=False) for k in ("start", "keeper", "place", "own"))
        begin, size, content = (places.field(k).to_numpy(zero_copy_only=False) for k in ("start", "size", "content"))
        row, starts, windows, sets = [], [], [], []
        for k, data in enumerate(columns_as_bytes(batch, "text")):
            grams = gram_hashes(data.lower().split(), SHINGLE)
            a, b = hit_bounds[k : k + 2]
            if a < b:
                at = extension_starts(start[a:b], keeper[a:b], place[a:b], own[a:b], len(grams) - (MIN_WORDS - SHINGLE + 1))
                row.append(k)
                starts.append(at)
                windows.append(window_hashes(grams, at))
            a, b = place_bounds[k : k + 2]
            sets += [np.unique(grams[x : x + n - SHINGLE + 1]) for x, n in zip(begin[a:b].tolist(), size[a:b].tolist())]
        for of, columns in (
            (np.array(row, np.int64), [as_lists(starts, pa.int32()), as_lists(windows, pa.int64()), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), longs)]),
            (np.repeat(np.arange(batch.num_rows), np.diff(place_bounds)), [pa.nulls(len(sets), pa.list_(pa.int32())), pa.nulls(len(sets), longs), pa.array(content, pa.int64()), as_lists(sets, pa.int64())]),
        ):
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("mark").take(at), *columns], names)


def jaccard_forest(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the same as all pairs of the given similarity (of different sides, where given)."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    waiting = np.ones(n, bool)
    links = []
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first] = False
        stack = [first]
        while stack:
            i = stack.pop()
            low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            shared = np.bincount(np.concatenate([owner[a:b] for a, b in zip(low, high)]), minlength=n)
            near = waiting & (shared >= similarity * (size + size[i] - shared) - 1e-9)
            if side is not None:
                near &= side != side[i]
            found = np.flatnonzero(near)
            waiting[found] = False
            for j in found.tolist():
                links.append((i, j))
                stack.append(j)
    return links


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "a", "b"]):
            names = group["content"].to_numpy()
            bounds, shingles = listed(group["shingles"].combine_chunks())
            sets = np.split(shingles.to_numpy(), bounds[1:-1])
            side = None if group["a"][0].as_py() == group["b"][0].as_py() else group["chunk"].to_numpy() == group["a"][0].as_py()
            links = jaccard_forest(sets, side, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([int(names[i]) for i, _ in links], pa.int64()), pa.array([int(names[j]) for _, j in links], pa.int64())], ["src", "dst"])

    return run


def merged_runs(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the runs that the given ones make together, row by row; runs that touch are one."""
    if not len(row):
        return row, start, stop
    apart = row * (int(stop.max()) + 1)
    order = np.argsort(start + apart, kind="stable")
    row, start, apart = row[order], start[order], apart[order]
    reach = np.maximum.accumulate(stop[order] + apart)
    new = np.append(True, start[1:] + apart[1:] > reach[:-1])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], start[new], (reach - apart)[ends]


def _outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        bounds, found = listed(batch.column("found"))
        start, size, gone = (found.field(k).to_numpy(zero_copy_only=False) for k in ("start", "size", "removed"))
        row = np.repeat(np.arange(n), np.diff(bounds))[gone]
        row, begin, end = merged_runs(row, start[gone].astype(np.int64), (start + size)[gone].astype(np.int64))
        removed = np.zeros(n, np.int64)
        np.add.at(removed, row, end - begin)
        runs_of = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        spans = pa.ListArray.from_arrays(pa.array(runs_of, pa.int32()), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["start", "stop"]))
        names = [k for k in batch.schema.names if k != "found"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(removed), spans], [*names, "n_removed", "spans"])


def paragraph_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, n_words, n_paragraphs, n_repeated, component_ids, n_short_repeated, short_component_ids, n_removed, spans) for every row.

    n_paragraphs counts the lines that hold words; n_repeated counts the row's passages (paragraphs and windows) that stand elsewhere too;
    component_ids are the smallest ids of the clusters of those passages. In each cluster the
    passage of the smallest (id, start) stays, all others are removed, windows with what agrees
    beyond them; spans are the merged removed runs of words [start, stop) and n_removed their words. Lines of
    under SHINGLE words that stand elsewhere too, alike in every word, are n_short_repeated, with
    the smallest ids of their clusters in short_component_ids; they are not removed. Texts that
    are null or hold no word have no passages. Rows that repeat both id and text count as one document
    and are returned as often as they come; null ids come first. An empty table gives no rows.
    Other columns are not read.
    """
    units = materialize(text_units(docs, id_col, text_col), "units")
    own = units.where(F.col("kind") != DOCUMENT)
    place = F.struct("id", "mark", "start", "size")
    classes = own.groupBy("kind", "content").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("bands").alias("bands"))
    classes = classes.withColumn("n", F.when(F.col("first").eqNullSafe(F.col("last")), 1).otherwise(2)).drop("last")  # rows that repeat are one place
    classes = materialize(classes, "passages")
    paragraphs = classes.where(F.col("kind") == PARAGRAPH)
    keyed = paragraphs.select("content", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = materialize(keyed.join(crowded, "key"), "met")
    wanted = paragraphs.select("content", "first").join(met.select("content").distinct(), "content")
    common = classes.where((F.col("kind") == WINDOW) & (F.col("n") > 1)).select("content", F.col("first").alias("stays"))
    own_place = F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("mark") == F.col("stays.mark")) & (F.col("start") == F.col("stays.start"))
    seen = own.where(F.col("kind") == WINDOW).select("id", "mark", "start", "content").join(common, "content")
    hit = F.struct("start", F.xxhash64("stays.id", "stays.mark").alias("keeper"), F.col("stays.start").alias("place"), own_place.alias("own"))
    places = wanted.select(F.col("first.id").alias("own"), "first.mark", F.struct("content", F.col("first.start").alias("start"), F.col("first.size").alias("size")).alias("place"))
    asked = places.unionByName(seen.select(F.col("id").alias("own"), "mark", hit.alias("hit")), allowMissingColumns=True)
    asked = asked.groupBy("own", "mark").agg(F.collect_set("place").alias("places"), F.collect_set("hit").alias("hits"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fetched = texts.join(asked, F.col("id").eqNullSafe(F.col("own"))).select("id", "text", "places", "hits", "mark")
    kind = docs.schema[id_col].dataType.simpleString()
    again = fetched.where(F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("mark")).mapInArrow(_read_again, f"id {kind}, mark long, start array<int>, window array<long>, content long, shingles array<long>")
    again = materialize(again, "shingles")
    sets = again.where("content is not null").select("content", "shingles").dropDuplicates(["content"])
    beyond = again.where("content is null").select("id", "mark", F.inline(F.arrays_zip("start", F.col("window").alias("content"))))
    spot = F.struct("id", "mark", "start")
    kept = beyond.groupBy("content").agg(F.min(spot).alias("stays"), F.max(spot).alias("last")).where("not stays <=> last").drop("last")
    kept = materialize(kept, "kept")  # a table: so a hot content can be split at the join
    beyond = beyond.join(kept, "content").where(~own_place)
    beyond = beyond.select("id", "mark", F.struct("start", F.lit(MIN_WORDS).alias("size"), F.lit(EXTENSION).alias("kind"), F.lit(True).alias("removed"), F.col("stays.id").alias("component")).alias("hit"))
    beyond = materialize(beyond, "extensions")
    discard(kept)
    dealt = deal_groups(met.select("key", "content").join(sets, "content"), "content", CHUNK)
    linked = connected_components(dealt.mapInArrow(_verified(similarity), "src long, dst long"))
    rooted = paragraphs.join(linked, F.col("content") == F.col("node")).select("kind", "content", "n", "first", F.col("component").alias("root"))
    rooted = materialize(rooted, "rooted")
    discard(again, met)
    whole = rooted.groupBy("root").agg(F.sum("n").alias("total"), F.min("first").alias("stays")).where("total > 1").drop("total")
    known = rooted.join(whole, "root").select("kind", "content", "stays")
    alone = classes.where("n > 1").join(rooted.select("kind", "content"), ["kind", "content"], "left_anti")
    known = materialize(known.unionByName(alone.select("kind", "content", F.col("first").alias("stays"))), "repeated")
    discard(classes, rooted)
    hits = own.select("id", "mark", "kind", "start", "size", "content").join(known, ["kind", "content"])
    hits = hits.select("id", "mark", F.struct("start", "size", "kind", ((F.col("kind") != SHORT) & ~own_place).alias("removed"), F.col("stays.id").alias("component")).alias("hit"))
    found = hits.unionByName(beyond).groupBy("id", "mark").agg(F.collect_set("hit").alias("found"))
    heads = units.where(F.col("kind") == DOCUMENT).groupBy("id", "mark").agg(
        F.max("size").cast("long").alias("n_words"), F.max("start").cast("long").alias("n_paragraphs"), F.count("*").cast("int").alias("copies")
    )
    right = found.select(F.col("id").alias("own"), F.col("mark").alias("own_mark"), "found")
    told = heads.join(right, F.col("id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark")), "left")
    told = told.withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))

    def count(kinds: tuple[int, ...]):
        return F.size(F.filter("found", lambda x: x["kind"].isin(*kinds))).cast("long")

    def components(kinds: tuple[int, ...]):
        return F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda x: x["kind"].isin(*kinds)), lambda x: x["component"])))

    long = (PARAGRAPH, WINDOW, EXTENSION)
    told = told.select(
        "id", "n_words", "n_paragraphs", "copies", count((PARAGRAPH, WINDOW)).alias("n_repeated"), components(long).alias("component_ids"),
        count((SHORT,)).alias("n_short_repeated"), components((SHORT,)).alias("short_component_ids"), "found",
    )
    schema = f"id {kind}, n_words long, n_paragraphs long, copies int, n_repeated long, component_ids array<{kind}>, n_short_repeated long, short_component_ids array<{kind}>, n_removed long, spans array<struct<start:long,stop:long>>"
    done = told.mapInArrow(_outcome, schema)
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")
