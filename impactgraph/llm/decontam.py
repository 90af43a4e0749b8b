"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over normalised words on the driver and held in flat arrays, about 145 bytes
a word of test items. A benchmark of more than max_words words is cut into blocks of whole items;
the documents pass through one automaton after the other and are written in between, so that a
task never holds two. Documents are streamed; nothing of them is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_as_bytes, free_names, materialize

WINDOW = 10
#: Words of test items that one automaton may hold; it has at most twice as many states and three times as many steps.
MAX_WORDS = 500_000
#: Kept byte for byte: a-z, 0-9 and all bytes from 0x80; A-Z is lower-cased; the rest separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


class SuffixAutomaton:
    """Of several word sequences, in flat arrays.

    A state's first step is in two arrays, as most states have no other; further ones are in one
    table by (state, word). out_at names the windows that end where a state ends: a place in outs,
    whose entries (length, items) are shared by all states that have the same.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.out_at = array("i")
        self.outs: list[tuple[tuple[int, frozenset], ...]] = []

    def step(self, state: int, c: int) -> int:
        """The state after word c, or -1."""
        return self.to[state] if self.word[state] == c else self.more.get(state << 32 | c, -1)

    def _put(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, to
        else:
            self.more[state << 32 | c] = to
            self.fan.setdefault(state, set()).add(c)

    def _new(self, length: int, link: int) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.word, -1), (self.to, 0)):
            column.append(value)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        for x in self.fan.get(q, ()):
            self._put(clone, x, self.more[q << 32 | x])
        self.link[q] = clone
        while p >= 0 and self.step(p, c) == q:
            self._put(p, c, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and self.step(p, c) < 0:
            self._put(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> SuffixAutomaton:
        """Items without words match nothing; of fewer words than the window, they match as a whole."""
        own = cls(window)
        own.fan: dict[int, set[int]] = {}  # the words of a state's further steps, while it is built
        coded = [(name, array("i", [own.ids.setdefault(w, len(own.ids)) for w in words])) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = own._extend(last, c)
        del own.fan
        ends: dict[int, dict[int, set]] = {}
        for name, codes in coded:
            state, have = 0, 0
            size = min(window, len(codes))
            for c in codes:
                state, have = own.step(state, c), have + 1
                if have >= size:
                    at = state
                    while own.length[own.link[at]] >= size:
                        at = own.link[at]
                    ends.setdefault(at, {}).setdefault(size, set()).add(name)
        own.out_at = array("i", [-1]) * len(own.length)
        known: dict[tuple, int] = {}
        for at in sorted(range(1, len(own.length)), key=own.length.__getitem__):
            above = own.out_at[own.link[at]]
            if at not in ends:
                own.out_at[at] = above
                continue
            found = {n: frozenset(names) for n, names in ends[at].items()}
            for n, names in own.outs[above] if above >= 0 else ():
                found[n] = found.get(n, frozenset()) | names
            entry = tuple(sorted(found.items(), key=lambda x: x[0]))
            own.out_at[at] = known.setdefault(entry, len(own.outs))
            if own.out_at[at] == len(own.outs):
                own.outs.append(entry)
        return own

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit runs [start, end) in words, and the items of which a window occurs."""
        code, word, to, more, link, length, out_at, outs = self.ids.get, self.word, self.to, self.more.get, self.link, self.length, self.out_at, self.outs
        state = have = 0
        spans: list[tuple[int, int]] = []
        hit: set = set()
        for i, w in enumerate(words):
            c = code(w)
            if c is None:
                state = have = 0
                continue
            after = to[state] if word[state] == c else more(state << 32 | c, -1)
            while after < 0 and state:
                state = link[state]
                have = length[state]
                after = to[state] if word[state] == c else more(state << 32 | c, -1)
            if after < 0:
                continue
            state, have = after, have + 1
            if out_at[state] >= 0:
                for n, names in outs[out_at[state]]:
                    if n <= have:
                        hit |= names
                        start = i + 1 - n
                        while spans and start <= spans[-1][1] and start < spans[-1][0]:
                            start = min(start, spans.pop()[0])
                        if spans and start <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], i + 1)
                        else:
                            spans.append((start, i + 1))
        return spans, hit


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    done: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if done and a <= done[-1][1]:
            done[-1] = (done[-1][0], max(b, done[-1][1]))
        else:
            done.append((a, b))
    return done


def cut_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its words [start, end) and what stands between them."""
    if not spans:
        return data
    places = [m.span() for m in _WORD.finditer(data)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, data[at:]])


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, max_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Whole items in blocks of at most max_words words (or one longer item), read partition by partition."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        words = words_of((row.text or "").encode())
        if block and size + len(words) > max_words:
            yield block
            block, size = [], 0
        block.append((row.id or "", words))
        size += len(words)
    yield block


def _scan_block(sent, last: bool, clean: bool, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "items", "spans", "over", "cleaned")}
            before_spans, before_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            known = batch.column("text").is_valid().to_pylist()
            for data, given, spans, items in zip(columns_as_bytes(batch, "text"), known, before_spans, before_items):
                words = words_of(data)
                new, names = automaton.scan(words)
                spans = merged([*((x["start"], x["stop"]) for x in spans or ()), *new])
                hit = sum(b - a for a, b in spans)
                over = hit > max_coverage * len(words)
                cols["n_words"].append(len(words))
                cols["n_hit"].append(hit)
                cols["items"].append(sorted({*(items or ()), *names}))
                cols["spans"].append([{"start": a, "stop": b} for a, b in spans])
                cols["over"].append(over)
                cols["cleaned"].append(cut_words(data, spans) if clean and last and given and not over else None)
            text = batch.column("text") if not last else pa.nulls(batch.num_rows, batch.column("text").type)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    text,
                    pa.array(cols["n_words"], pa.int64()),
                    pa.array(cols["n_hit"], pa.int64()),
                    pa.array(cols["items"], pa.list_(pa.string())),
                    pa.array(cols["spans"], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array(cols["over"], pa.bool_()),
                    pa.array(cols["cleaned"], pa.binary()).cast(pa.string()),
                ],
                ["id", "text", "n_words", "n_hit", "items", "spans", "over", "cleaned"],
            )

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
    max_words: int = MAX_WORDS,
    clean: bool = True,
) -> DataFrame:
    """(id, n_words, n_hit, items, spans, over, cleaned) for every row of docs.

    spans are the runs of words [start, stop) inside any occurrence of a window; items the sorted
    ids (as strings) of items with occurring windows; over tells whether the spans cover more than
    max_coverage of the words; cleaned is the text without the spans, null where over, where the
    text is null or where clean is false. A null text has no words. A null item id counts as the
    empty string; items that repeat count once. An empty benchmark hits nothing; an empty table
    gives no rows. Rows that repeat are returned as often as they come.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text string, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>, over boolean, cleaned string"
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).selectExpr(
        "id", "text", "cast(null as array<string>) items", "cast(null as array<struct<start:long,stop:long>>) spans"
    )
    blocks = item_blocks(benchmark, item_col, item_text_col, max_words)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        sent = spark.sparkContext.broadcast(SuffixAutomaton.build(block, window))
        found = found.mapInArrow(_scan_block(sent, after is None, clean, max_coverage), schema)
        if after is not None:
            found = materialize(found, "scanned")
            sent.unpersist()
        block = after
    return found.drop("text")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with contaminated spans cut out of text; documents over the coverage limit go.

    Clean rows keep their text to the byte, null included; columns and their names are unchanged.
    Every row is judged by itself: repeated rows and null ids stay as often as they come, and an
    empty table or an empty benchmark changes nothing.
    """
    rest = [c for c in docs.columns if c != text_col]
    whole = docs.select(F.struct(*rest, F.lit(True).alias(free_names(docs, "present")[0])).alias("row"), F.col(text_col).alias("text"))
    found = decontaminate(whole, benchmark, id_col="row", text_col="text", **options).where("not over")
    return found.select(*[(F.col("cleaned") if c == text_col else F.col("id").getField(c)).alias(c) for c in docs.columns])
