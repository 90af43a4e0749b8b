"""SentencePiece encoding, decoding and sampling of distinct segmentations.

Sampling is Gumbel top-k without replacement by a perturbed A* search. The lattice of a text has
its characters as nodes and pieces as edges; an edge weighs log p of its piece. For pieces of a
merge-ranked model, p falls with the rank r as 1 / (r + SHIFT). A search state is a path prefix
with, at its end, the edges not to be taken again; the mass of all its completions is known from
the backward sums, so its perturbed value (the largest Gumbel-perturbed score below it) is drawn
directly: for the whole lattice from a Gumbel, for the parts of a popped state from Gumbels
truncated at the popped value. States are popped by that value; each pop is one more segmentation,
its path drawn by the edges' conditional probabilities.

The lattice falls into units (no piece crosses one's end), equal units share their nodes, and all
texts of a chunk are walked together, one edge a step.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

MODEL = "piece_bpe_32k.model"
SAMPLES, SHIFT = 2, 2.7
#: Bytes of text that are walked together, and path edges of a popped state that become states one by one.
CHUNK_BYTES, AHEAD = 1 << 20, 32
_SPACE = "▁"
_UNIT = re.compile(f"{_SPACE}*[^{_SPACE}\n0-9]+|{_SPACE}+|[\n0-9]")


def model_path(name: str = MODEL) -> str:
    """Where the environment keeps a public vocabulary; its module public_tokenizers only tells the path. Give path= to do without it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Pieces:
    """A vocabulary as hash tables of its pieces' prefixes."""

    texts: list[str]
    byte_ids: np.ndarray
    logs: np.ndarray
    longest: int
    tables: list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]]
    bytes_of: list[bytes] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | None = None) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        byte_ids = np.zeros(256, np.int32)
        plain = {}
        rank = np.zeros(n)
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(texts[i][1:-1], 16)] = i
                rank[i] = n
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[texts[i]] = i
                rank[i] = -model.get_score(i) if model.get_score(i) < 0 else 0.0
        weight = 1 / (rank + SHIFT)
        used = np.zeros(n, bool)
        used[[*plain.values(), *byte_ids.tolist()]] = True
        logs = np.where(used, np.log(weight / weight[used].sum()), -np.inf)
        keys: dict[int, int] = {}
        for text, i in plain.items():
            for stop in range(1, len(text) + 1):
                key = _hash_text(text[:stop])
                keys[key] = i if stop == len(text) else keys.get(key, -1)
        tables = []
        rest = list(keys.items())
        for turn in range(8):
            if not rest:
                break
            bits = 20
            by = np.uint64(xxhash.xxh64_intdigest(b"%d" % turn) | 1)
            hashed = np.array([k for k, _ in rest], np.uint64)
            slot = ((hashed * by) >> np.uint64(64 - bits)).astype(np.int64)
            full, value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
            taken, left = set(), []
            for (k, i), s in zip(rest, slot.tolist()):
                if s in taken:
                    left.append((k, i))
                else:
                    taken.add(s)
                    full[s], value[s] = k, i
            tables.append((by, full, value, np.uint64(64 - bits)))
            rest = left
        assert not rest
        return cls(texts, byte_ids, logs, max(map(len, plain)), tables)

    def spelled(self, ids: np.ndarray) -> bytes:
        """What pieces spell, with the leading blank."""
        if not self.bytes_of:
            self.bytes_of += [t.replace(_SPACE, " ").encode() for t in self.texts]
            for value, i in enumerate(self.byte_ids.tolist()):
                self.bytes_of[i] = bytes([value])
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The id of each prefix hash, -1 for a prefix that is no piece, -2 for none."""
        out = np.full(len(keys), -2, np.int32)
        for by, full, value, shift in self.tables:
            slot = ((keys * by) >> shift).astype(np.int64)
            out = np.where((full[slot] == keys) & (out == -2), value[slot], out)
        return out


_STEP = np.uint64(0x100000001B3)


def _hash_text(text: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in text:
        h = mix(h * _STEP + np.uint64(ord(c) + 1))
    return int(h[0])


def units_of(text: str) -> list[str]:
    """The text with a leading blank and blanks as the piece mark, cut where no piece can cross."""
    return _UNIT.findall(_SPACE + text.replace(" ", _SPACE)) if text else []


def spoken(text: str) -> bytes:
    """The bytes that pieces of a text must spell: a blank comes first."""
    return b" " + text.encode("utf-8", "surrogatepass") if text else b""


class Lattice:
    """Nodes of distinct units: each character is one, plus an end for each unit."""

    def __init__(self, units: list[str], pieces: Pieces):
        size = np.fromiter(map(len, units), np.int64, len(units))
        self.first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        total = int((size + 1).sum())
        self.end = np.zeros(total, bool)
        self.end[self.first + size] = True
        codes = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        nodes = np.flatnonzero(~self.end).astype(np.int32)
        starts, stops, ids = [], [], []
        key, live = np.zeros(len(nodes), np.uint64), nodes
        covered = np.zeros(total, bool)
        for length in range(1, pieces.longest + 1):
            key = mix(key * _STEP + codes[live + length - 1] + np.uint64(1))
            found = pieces.find(key)
            hit = found >= 0
            starts.append(live[hit])
            stops.append(live[hit] + length)
            ids.append(found[hit])
            if length == 1:
                covered[live[hit]] = True
            on = (found > -2) & ~self.end[live + length]
            live, key = live[on], key[on]
        bare = nodes[~covered[nodes]]  # characters without a piece fall to their bytes: id -1 - code point if there are several
        code = codes[bare].astype(np.int64)
        starts.append(bare)
        stops.append(bare + 1)
        ids.append(np.where(code < 128, pieces.byte_ids[code & 127], -1 - code))
        start, stop, name = (np.concatenate(x).astype(np.int32) for x in (starts, stops, ids))
        order = np.argsort(start, kind="stable")
        self.start, self.stop, self.name = start[order], stop[order], name[order]
        log = pieces.logs[np.maximum(self.name, 0)]
        for e in np.flatnonzero(self.name < 0).tolist():
            log[e] = sum(pieces.logs[pieces.byte_ids[b]] for b in _utf8(-1 - int(self.name[e])))
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.start, minlength=total))])
        left = np.repeat((self.first + size).astype(np.int32), size + 1) - np.arange(total, dtype=np.int32)  # characters to the unit's end
        beta = np.zeros(total)
        from_end = left[self.start]
        if len(size) and size.max() < 1 << 16:
            from_end = from_end.astype(np.uint16)  # sorted by radix
        by_left = np.argsort(from_end, kind="stable")
        from_end = from_end[by_left]
        cuts = np.searchsorted(from_end, np.arange(1, int(from_end[-1]) + 2 if len(from_end) else 1))
        for a, b in zip(cuts, cuts[1:]):
            e = by_left[a:b]
            s = self.start[e]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            v = log[e] + beta[self.stop[e]]
            top = np.maximum.reduceat(v, head)
            count = np.diff(np.append(head, len(e)))
            beta[s[head]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count)), head))
        log_p = log + beta[self.stop] - beta[self.start]
        head = self.begin[:-1][~self.end]  # the likeliest edge of a node first, so that a choice looks at few
        if len(head):
            top = np.repeat(np.maximum.reduceat(log_p, head), np.diff(np.append(head, len(log_p))))
            best = np.flatnonzero(log_p == top)
            best = best[np.searchsorted(best, head)]
            for column in (self.stop, self.name, log_p):
                column[head], column[best] = column[best], column[head]
        self.log_p = log_p
        share = np.exp(self.log_p)
        run = np.concatenate([[0.0], np.cumsum(share)])
        self.upto = run[1:] - np.repeat(run[self.begin[:-1]], np.diff(self.begin))
        self.sole = np.diff(self.begin)[self.start] == 1

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that the uniform u picks."""
        edge, last = self.begin[node], self.begin[node + 1] - 1
        live = np.flatnonzero((u >= self.upto[edge]) & (edge < last))
        while len(live):
            e = edge[live] + 1
            edge[live] = e
            live = live[(u[live] >= self.upto[e]) & (e < last[live])]
        return edge


def _utf8(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass")


def uniforms(seed: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """Uniforms in (0, 1) that depend on nothing but the arguments."""
    h = np.array(seed, np.uint64, ndmin=1)
    with np.errstate(over="ignore"):
        for part in parts:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.asarray(part).astype(np.uint64) + np.uint64(1))
    return ((mix(h) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


@dataclass
class Paths:
    """Walked paths, one text after the other: edges, and the ordinal of the unit that each lies in."""

    edge: np.ndarray
    unit: np.ndarray
    bound: np.ndarray


def walk(lattice: Lattice, node: np.ndarray, text: np.ndarray, ordinal: np.ndarray, seed: np.ndarray, draw: int, texts: int, step0: int = 0) -> Paths:
    """Walks every given unit from node to its end; text and ordinal say where each unit stands. Rows come sorted by (text, ordinal)."""
    edges, rows = [], []
    live = np.flatnonzero(~lattice.end[node])
    at = node[live]
    step = step0
    while len(live):
        e = lattice.choose(at, uniforms(seed[text[live]], ordinal[live], step, draw))
        edges.append(e)
        rows.append(live)
        at = lattice.stop[e]
        on = ~lattice.end[at]
        live, at = live[on], at[on]
        step += 1
    edge = np.concatenate([np.zeros(0, np.int64), *edges])
    row = np.concatenate([np.zeros(0, np.int64), *rows])
    order = np.argsort(row, kind="stable")
    edge, row = edge[order], row[order]
    return Paths(edge, ordinal[row], np.searchsorted(text[row], np.arange(texts + 1)))


def _truncated(mass: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels at mass, given that the largest over all parts is below: -log(exp(-below) + exp(-g)), g ~ Gumbel(mass)."""
    g = mass - np.log(-np.log(u))
    with np.errstate(over="ignore", invalid="ignore"):
        high = np.maximum(-below, -g)
        return -(high + np.log(np.exp(-below - high) + np.exp(-g - high)))


@dataclass
class Leaf:
    edge: np.ndarray
    unit: np.ndarray
    fixed: int  # edges before this one belong to the state's prefix
    banned: tuple[int, ...]  # edges not to be taken at that place
    value: float
    log_p: np.ndarray  # of each edge, given what is before it


def _parts(leaves: list[Leaf], lattice: Lattice, first: list[int], seed: np.ndarray, draw: int, value: np.ndarray) -> list[tuple[np.ndarray, list]]:
    """For each leaf of a popped state, perturbed values and states (place, banned edges) of what is left under it.

    Path edges [first, first + AHEAD) give a state each, with the mass of the edges not taken
    there; the rest of the path gives one state together, its banned edges being None.
    """
    n = len(leaves)
    size = np.array([min(AHEAD, len(leaf.edge) - f) for leaf, f in zip(leaves, first)])
    wide = int(size.max(initial=0))
    edge = np.zeros((n, wide), np.int64)
    for i, (leaf, f, w) in enumerate(zip(leaves, first, size.tolist())):
        edge[i, :w] = leaf.edge[f : f + w]
    inside = np.arange(wide) < size[:, None]
    own = np.where(inside, lattice.log_p[edge], 0.0)
    before = np.array([leaf.log_p[:f].sum() for leaf, f in zip(leaves, first)])
    rest = np.array([leaf.log_p[f + w :].sum() for leaf, f, w in zip(leaves, first, size.tolist())])
    through = before[:, None] + np.concatenate([np.zeros((n, 1)), np.cumsum(own, axis=1)], axis=1)
    free = np.concatenate([np.where(inside & ~lattice.sole[edge], -np.expm1(own), 0.0), -np.expm1(rest)[:, None]], axis=1)
    banned: dict[int, tuple[int, ...]] = {}
    for i, (leaf, f, w) in enumerate(zip(leaves, first, size.tolist())):
        if w and leaf.banned and f == leaf.fixed:
            banned[i] = (*leaf.banned, int(edge[i, 0]))
            free[i, 0] = np.exp(lattice.log_p[_open_edges(lattice, edge[i, 0], banned[i])]).sum()
    place = np.array(first)[:, None] + np.arange(wide + 1)
    place[:, wide] = np.array(first) + size
    with np.errstate(divide="ignore"):
        mass = through + np.log(free)
    g = _truncated(mass, value[:, None], uniforms(seed[:, None], place, draw, 7))
    out = []
    for i in range(n):
        at = np.flatnonzero(free[i] > 0)
        states: list = [(int(place[i, t]), (int(edge[i, t]),) if t < wide else None) for t in at.tolist()]
        if i in banned and states and states[0][0] == first[i] and states[0][1] is not None:
            states[0] = (first[i], banned[i])
        out.append((g[i, at], states))
    return out


def _open_edges(lattice: Lattice, taken: int, banned: tuple[int, ...]) -> list[int]:
    node = int(lattice.start[taken])
    return [e for e in range(int(lattice.begin[node]), int(lattice.begin[node + 1])) if e not in banned]


def _push(heap: list, leaf_no: int, values: np.ndarray, states: list) -> None:
    for v, (t, banned) in zip(values.tolist(), states):
        heapq.heappush(heap, (-v, leaf_no, t, banned))


def sample_texts(texts: list[str], seeds: list[int], pieces: Pieces, k: int = SAMPLES) -> list[list[dict]]:
    """For each text up to k distinct segmentations, by falling perturbed value.

    Each is {ids, log_p, value, log_inclusion}: its log-probability, its Gumbel-perturbed value and
    the logarithm of the probability that it beats the first value left out (0 where none is),
    which no long text can take below what a double holds. A text without characters has one
    segmentation, of no piece.
    """
    known: dict[str, int] = {}
    flat: list[int] = []
    bound = [0]
    for text in texts:
        flat += [known.setdefault(u, len(known)) for u in units_of(text)]
        bound.append(len(flat))
    lattice = Lattice(list(known), pieces) if known else None
    unit = np.array(flat, np.int64)
    bound = np.array(bound)
    n = len(texts)
    seed = np.array([s % (1 << 64) for s in seeds], np.uint64)
    out: list[list[dict]] = [[] for _ in texts]
    if lattice is None:
        return [[{"ids": np.zeros(0, np.int32), "log_p": 0.0, "value": 0.0, "log_inclusion": 0.0}] for _ in texts]
    text_of = np.repeat(np.arange(n), np.diff(bound))
    ordinal = np.arange(len(unit)) - bound[:-1][text_of]
    paths = walk(lattice, lattice.first[unit], text_of, ordinal, seed, 0, n)
    top = -np.log(-np.log(uniforms(seed, 0, 0, 5)))
    log_p = lattice.log_p[paths.edge]
    leaves: list[list[Leaf]] = []
    for i in range(n):
        a, b = paths.bound[i], paths.bound[i + 1]
        edge = paths.edge[a:b]
        leaf = Leaf(edge, paths.unit[a:b], 0, (), float(top[i]), log_p[a:b])
        leaves.append([leaf])
    heaps: list[list] = [[] for _ in texts]
    for heap, part in zip(heaps, _parts([x[0] for x in leaves], lattice, [0] * n, seed, 1, top)):
        _push(heap, 0, *part)
    for draw in range(1, k):
        again = []  # (text, parent leaf, place, edge there, banned, value)
        for i in range(n):
            heap = heaps[i]
            while heap:
                v, leaf_no, t, banned = heapq.heappop(heap)
                if banned is None:  # the lumped rest of a path: its parts are drawn below its own value, which one of them keeps
                    _split_rest(heap, leaf_no, leaves[i][leaf_no], lattice, t, int(seed[i]), draw, -v)
                    continue
                parent = leaves[i][leaf_no]
                options = np.array(_open_edges(lattice, parent.edge[t], banned))
                p = np.exp(lattice.log_p[options])
                u = float(uniforms(np.array([seed[i]]), t, leaf_no, draw, 3)[0])
                e = int(options[min(len(options) - 1, int(np.searchsorted(np.cumsum(p), u * p.sum())))])
                again.append((i, leaf_no, t, e, banned, -v))
                break
        if not again:
            break
        head = [int(lattice.stop[e]) for _, _, _, e, _, _ in again]
        from_unit = [int(leaves[i][no].unit[t]) for i, no, t, *_ in again]
        chosen = [np.arange(bound[i] + o, bound[i + 1]) for (i, *_), o in zip(again, from_unit)]
        sizes = np.array([len(c) for c in chosen])
        rows = np.concatenate(chosen)
        nodes = lattice.first[unit[rows]]
        nodes[np.concatenate([[0], np.cumsum(sizes)])[:-1]] = head  # the first unit goes on from the new edge
        who = np.repeat(np.arange(len(again)), sizes)
        index = np.array([a[0] for a in again])
        more = walk(lattice, nodes, who, ordinal[rows], seed[index], draw, len(again), 1000)
        fresh = []
        for j, (i, no, t, e, banned, value) in enumerate(again):
            a, b = more.bound[j], more.bound[j + 1]
            parent = leaves[i][no]
            edge = np.concatenate([parent.edge[:t], [e], more.edge[a:b]])
            where = np.concatenate([parent.unit[:t], [parent.unit[t]], more.unit[a:b]])
            leaf = Leaf(edge, where, t, banned, value, lattice.log_p[edge])
            leaves[i].append(leaf)
            fresh.append(leaf)
        left = _parts(fresh, lattice, [a[2] for a in again], seed[index], draw + 1, np.array([a[5] for a in again]))
        for i, part in zip(index.tolist(), left):
            _push(heaps[i], len(leaves[i]) - 1, *part)
    for i in range(n):
        beyond = -heaps[i][0][0] if heaps[i] else -np.inf
        for leaf in leaves[i]:
            log_p = float(leaf.log_p.sum())
            over = 50.0 if beyond == -np.inf else min(50.0, log_p - beyond)
            inclusion = over if over < -30 else float(np.log(-np.expm1(-np.exp(over))))
            out[i].append({"ids": _ids(lattice, leaf.edge, pieces), "log_p": log_p, "value": leaf.value, "log_inclusion": inclusion})
    return out


def _split_rest(heap: list, leaf_no: int, leaf: Leaf, lattice: Lattice, first: int, seed: int, draw: int, value: float) -> None:
    """Replaces the state of a path's rest by its parts: the largest value is the rest's own, the others fall below it."""
    g, states = _parts([leaf], lattice, [first], np.array([seed], np.uint64), 100 + draw, np.array([np.inf]))[0]
    best = g.max()
    with np.errstate(divide="ignore"):
        x = value - g + np.log1p(-np.exp(g - best))
    moved = np.where(g < best, value - np.maximum(0.0, x) - np.log1p(np.exp(-np.abs(x))), value)
    _push(heap, leaf_no, moved, states)


def _ids(lattice: Lattice, edge: np.ndarray, pieces: Pieces) -> np.ndarray:
    name = lattice.name[edge]
    if (name >= 0).all():
        return name.astype(np.int32)
    out: list[int] = []
    for x in name.tolist():
        out += [x] if x >= 0 else [int(pieces.byte_ids[b]) for b in _utf8(-1 - x)]
    return np.array(out, np.int32)


_loaded: dict[str, Pieces] = {}


def _pieces(path: str | None) -> Pieces:
    key = path or ""
    if key not in _loaded:
        _loaded[key] = Pieces.load(path)
    return _loaded[key]


def row_seed(key: object, data: bytes) -> int:
    """The seed of a row: its key, or its text where the key is null."""
    return xxhash.xxh64_intdigest(str(key).encode() if key is not None else b"\0" + data, 11)


def _sampled(path: str | None, k: int):
    names = ("id", "rank", "ids", "log_p", "value", "log_inclusion", "round_trip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            at = 0
            while at < len(sizes):
                begin, held = at, 0
                while at < len(sizes) and (held == 0 or held + sizes[at] <= CHUNK_BYTES):
                    held += sizes[at]
                    at += 1
                keys = ids.slice(begin, at - begin).to_pylist()
                part = [x or "" for x in texts.slice(begin, at - begin).to_pylist()]
                found = sample_texts(part, [row_seed(x, t.encode()) for x, t in zip(keys, part)], pieces, k)
                for lo in range(0, len(found), 500):
                    rows = [(begin + lo + i, rank, s) for i, samples in enumerate(found[lo : lo + 500]) for rank, s in enumerate(samples, 1)]
                    bounds = np.cumsum([0, *(len(s["ids"]) for _, _, s in rows)])
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([s["ids"] for _, _, s in rows]), pa.int32()))
                    numbers = [pa.array([s[c] for _, _, s in rows], pa.float64()) for c in ("log_p", "value", "log_inclusion")]
                    same = [pieces.spelled(s["ids"]) == spoken(part[at_ - begin]) for at_, _, s in rows]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), lists, *numbers, pa.array(same, pa.bool_())], names)

    return run


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, rank, ids, log_p, value, log_inclusion, round_trip): up to k distinct segmentations of every row's whole text.

    round_trip tells whether the ids decode to the text, byte for byte.

    Texts that are null or empty have one, of no piece. The draw depends on the id alone, so rows
    that repeat an id and text get the same; a null id is seeded by its text. A text with fewer than
    k segmentations gives all of them. An empty table gives no rows. Other columns are not read;
    nothing is shuffled.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, rank int, ids array<int>, log_p double, value double, log_inclusion double, round_trip boolean"
    return given.mapInArrow(_sampled(path, k), schema)


def _processor(path: str | None):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or model_path())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the model's own encoding; null texts give no pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _processor(path)
        for batch in batches:
            ids = model.encode([x or "" for x in batch.column("text").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """coded with a column text (any of that name is replaced): the ids decoded; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _processor(path)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [None if x is None else model.decode(x) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    rest = coded.drop("text")
    whole = rest.select(F.struct("*").alias("row"), F.col(ids_col).alias("ids"))
    done = whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, text string")
    return done.select("row.*", "text")
