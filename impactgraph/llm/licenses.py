"""License scan by diagonal voting.

Every word k-gram of every document is hashed (a rolling combination of word hashes) and joined in
Spark to the positions of the same k-gram in the templates. A hit votes for the diagonal
(word position - template position). Votes are counted by diagonal, and neighbouring diagonals
(words put in or left out) are merged; around each the document's own words are then aligned with
the template's, in order, and a span counts when few enough words differ. The join to broadcast
templates leaves a document's votes in one task, behind a row that carries its text once, so
neither text nor votes are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_as_bytes, gram_hashes
from .decontam import words_of

# Exact phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Wordings of common license notices, matched in part.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Neighbouring diagonals no further apart than this are one place; the least part of a template that must agree.
BAND, COVERAGE = 4, 0.8
#: Words of templates that one pass over the documents holds; more make more passes.
MAX_WORDS = 100_000
HEADER, GRAM = -1, 3
#: Grams that are handed on at a time, or those of one longer text.
CHUNK = 300_000

Template = tuple[str, list[bytes], bool]
Span = tuple[int, int, int]


def _gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text: its header, which alone carries the text, its 2-grams and its 3-grams."""
    for batch in batches:
        text = columns_as_bytes(batch, "text")
        at = 0
        while at < len(text):
            parts, sizes, counts, lengths, start = [], [0], [], [], at
            while at < len(text) and (not parts or sizes[-1] < CHUNK):
                words = words_of(text[at])
                own = np.concatenate([np.array([HEADER], np.int64), gram_hashes(words, 2), gram_hashes(words, GRAM)])
                parts.append(own)
                length = np.zeros(len(own), np.int64)
                length[0] = len(text[at])
                lengths.append(length)
                sizes.append(sizes[-1] + len(own))
                counts.append(len(words))
                at += 1
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            carried = pa.LargeBinaryArray.from_buffers(pa.large_binary(), sizes[-1], [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"".join(text[start:at]))])
            entry = pa.StructArray.from_arrays([pa.array(np.concatenate(parts)), carried.cast(pa.binary())], ["gram", "text"])
            grams = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entry)
            rest = batch.slice(start, at - start)
            yield pa.RecordBatch.from_arrays([rest.column("id"), rest.column("found"), pa.array(counts, pa.int64()), grams], ["id", "found", "n_words", "grams"])


def edit_rows(template: np.ndarray, region: np.ndarray, anywhere: bool = True) -> np.ndarray:
    """For each place in region, the least edits (words put in, left out or changed) of template against a run that ends there.

    The run may start anywhere, or only where the region does.
    """
    n = len(region)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64) if anywhere else ramp.copy()
    for i, w in enumerate(template.tolist()):
        step = np.empty(n + 1, np.int64)
        step[0] = i + 1
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != w))
        row = np.minimum.accumulate(step - ramp) + ramp
    return row


def aligned(template: list[bytes], words: list[bytes], low: int, high: int, allowed: int, votes: np.ndarray) -> tuple[list[Span], int]:
    """Spans (start, stop, edits) of words[low:high] that the template aligns with, and the least edits met anywhere there.

    The best span comes first (fewest edits, then the earliest end, then the shortest); what is left
    of it and right of it is searched again. A span must hold a vote, and no more than allowed edits.
    """
    code: dict[bytes, int] = {}
    whole = np.array([code.setdefault(w, len(code)) for w in words[low:high]], np.int64)
    wanted = np.array([code.get(w, -1) for w in template], np.int64)
    found: list[Span] = []
    least = len(template)
    stack = [(0, len(whole))]
    while stack:
        a, b = stack.pop()
        if not ((votes >= low + a) & (votes < low + b)).any():
            continue
        edits = edit_rows(wanted, whole[a:b])
        least = min(least, int(edits.min()))
        for end in sorted(np.flatnonzero(edits <= allowed).tolist(), key=lambda j: (edits[j], j)):
            back = edit_rows(wanted[::-1], whole[max(a, a + end - len(template) - allowed) : a + end][::-1], False)
            stop = a + end
            start = stop - int(np.flatnonzero(back == edits[end])[0])
            if ((votes >= low + start) & (votes + GRAM <= low + stop)).any():
                found.append((low + start, low + stop, int(edits[end])))
                stack += [(a, start), (stop, b)]
                break
    return found, least


def places(diagonals: np.ndarray, length: int, slack: int, n_words: int, band: int) -> list[tuple[int, int]]:
    """Runs of words to align: neighbouring diagonals merged, widened by what a span may have more, overlaps joined."""
    runs: list[tuple[int, int]] = []
    for cluster in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > band) + 1):
        low, high = max(0, int(cluster[0]) - slack), min(n_words, int(cluster[-1]) + length + slack)
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
        else:
            runs.append((low, high))
    return runs


def verified(words: list[bytes], template: list[bytes], at: np.ndarray, tpos: np.ndarray, band: int, coverage: float) -> tuple[list[Span], int]:
    """Spans of one notice in one text, from its votes (word position, template position), and the least edits."""
    allowed = int((1 - coverage) * len(template) + 1e-9)
    diagonals = np.unique(at - tpos)
    found, least = [], len(template)
    for low, high in places(diagonals, len(template), allowed + len(template), len(words), band):
        spans, edits = aligned(template, words, low, high, allowed, np.unique(at))
        found += spans
        least = min(least, edits)
    return sorted(found), least


def _verify(templates: list[Template], band: int, coverage: float):
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64()), ("exact", pa.bool_())]))

    def told(text: bytes, n_words: int, t: np.ndarray, at: np.ndarray, tpos: np.ndarray) -> list[dict]:
        words = words_of(text) if len(t) else []
        out = []
        for number in np.unique(t).tolist():
            label, wanted, exact = templates[number]
            mine = t == number
            if exact:
                for p in np.unique(at[mine] - tpos[mine]).tolist():
                    if p >= 0 and words[p : p + len(wanted)] == wanted:
                        out.append({"label": label, "start": p, "stop": p + len(wanted), "coverage": 1.0, "exact": True})
            else:
                spans, least = verified(words, wanted, at[mine], tpos[mine], band, coverage)
                out += [{"label": label, "start": a, "stop": b, "coverage": 1 - e / len(wanted), "exact": False} for a, b, e in spans]
                out.append({"label": None, "start": None, "stop": None, "coverage": max(0.0, 1 - least / len(wanted)), "exact": False})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the text whose votes come: (its header's slice, n_words, text, parts of its votes)

        def done() -> tuple:
            head, n_words, text, parts = held
            t, at, tpos = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            found = [*(head.column("found")[0].as_py() or ()), *told(text, n_words, t, at, tpos)]
            return head, n_words, text, found

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            ids = pa.concat_arrays([r[0].column("id") for r in rows])
            return pa.RecordBatch.from_arrays([ids, pa.array([r[2] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], kind)], ["id", "text", "n_words", "found"])

        for batch in batches:
            number = batch.column("template").to_numpy()
            place, tpos = batch.column("place").to_numpy().astype(np.int64), batch.column("tpos").to_numpy().astype(np.int64)
            heads = np.flatnonzero(number == HEADER).tolist()
            rows: list[tuple] = []
            for a, b in zip([0, *heads], [*heads, batch.num_rows]):
                if a < b and number[a] == HEADER:
                    if held:
                        rows.append(done())
                    held[:] = [batch.slice(a, 1), batch.column("n_words")[a].as_py(), batch.column("text")[a].as_py() or b"", []]
                    a += 1
                if a < b:
                    pairs = max(held[1] - 1, 0)
                    three = batch.column("k").to_numpy()[a:b] == GRAM
                    held[3].append((number[a:b].astype(np.int64), place[a:b] - 1 - np.where(three, pairs, 0), tpos[a:b]))
                if len(rows) >= 1000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)
        if held:
            yield packed([done()])

    return run


def default_templates(spark: SparkSession) -> DataFrame:
    """(label, text, exact) of the phrases and notices above."""
    rows = [(x, p, True) for p, x in BASE.items()] + [(x, p, False) for p, x in NOTICES.items()]
    return spark.createDataFrame(rows, "label string, text string, exact boolean")


def template_blocks(templates: DataFrame, max_words: int) -> Iterator[list[Template]]:
    """Templates of two words and more in blocks of at most max_words words (or one longer template), read partition by partition."""
    block: list[Template] = []
    size = 0
    for r in templates.select("label", "text", "exact").toLocalIterator():
        words = words_of((r.text or "").encode())
        if len(words) < 2 or r.label is None:
            continue
        if block and size + len(words) > max_words:
            yield block
            block, size = [], 0
        block.append((r.label, words, bool(r.exact)))
        size += len(words)
    yield block


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: int = BAND, coverage: float = COVERAGE, templates: DataFrame | None = None, max_words: int = MAX_WORDS
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row.

    templates(label, text, exact) may hold whole license texts; those marked exact must stand word
    for word, the others may differ in (1 - coverage) of their words. A notice is found where it
    shares three words in a row with the text. n_base counts the places of exact phrases,
    first_word and last_word are their smallest and largest start (null without one). spans are
    (label, start, stop, coverage) of verified notices and exact phrases; labels their distinct
    sorted names. score is the largest agreement with a template at any place that was voted for,
    0 without votes. A null text has no words; rows that repeat, null ids included, are returned as
    often as they come; an empty table gives no rows. Templates of under two words or without a
    label are left out. Other columns are not read. More templates than max_words words make more
    passes; nothing is shuffled.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    entry = "array<struct<label:string,start:long,stop:long,coverage:double,exact:boolean>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.lit(None).cast(entry).alias("found"))
    for block in template_blocks(default_templates(spark) if templates is None else templates, max_words):
        grams = [(HEADER, HEADER, 0, 0)]
        for number, (_, words, _) in enumerate(block):
            k = min(GRAM, len(words))
            grams += [(int(g), number, k, i) for i, g in enumerate(gram_hashes(words, k).tolist())]
        table = F.broadcast(spark.createDataFrame(grams, "gram long, template int, k int, tpos int"))
        lists = rows.mapInArrow(_gram_lists, f"id {kind}, found {entry}, n_words long, grams array<struct<gram:long,text:binary>>")
        each = lists.select("id", "found", "n_words", F.posexplode("grams").alias("place", "g")).select("id", "found", "n_words", "place", F.col("g.gram").alias("gram"), F.col("g.text").alias("text"))
        votes = each.join(table, "gram").select("id", "found", "n_words", "place", "text", "template", "k", "tpos")
        rows = votes.mapInArrow(_verify(block, band, coverage), f"id {kind}, text binary, n_words long, found {entry}")
    exact, real = F.filter("found", lambda x: x.exact), F.filter("found", lambda x: x.label.isNotNull())
    starts = F.transform(exact, lambda x: x.start)
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x.label))), ",")
    spans = F.array_sort(F.transform(real, lambda x: F.struct(x.label.alias("label"), x.start.alias("start"), x.stop.alias("stop"), x.coverage.alias("coverage"))))
    return rows.select(
        "id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(real).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.coverage)), F.lit(0.0)).alias("score"),
        spans.alias("spans"),
    )
