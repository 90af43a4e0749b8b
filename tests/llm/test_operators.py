"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import heapq
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from impactgraph.llm import chat, components, decontam, exact_dedup, licenses, paragraph_dedup, quality, queries, segment, simhash, suffix_dedup, warc

SF = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "été", "Straße"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_documents():
    base = prose(1, 300)
    rows = [(1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, None), (7, " \n\t "), (8, base + " tail"), (None, "solo text here"), (None, None)]
    rows += [(9, "x"), (10, prose(2, 6000)), (11, "Same Row"), (11, "Same Row"), (12, "ab " * 700), (13, prose(3, 80) + "\n" + base[:900]), (14, "ÀÉ same"), (15, "àé same")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use inside."""
    rows = [(i, t, "en", "src", 0, b"d", 1, True, "row") for i, t in odd_documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest binary, id long, kept boolean, row string").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def contract_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def as_multiset(rows):
    return Counter(map(repr, rows))


# -- exact dedup


def test_exact_dedup_matches_brute_force(spark, odd, none):
    got = rows_of(exact_dedup.exact_dedup(odd, queries.new_index(spark)))
    groups = defaultdict(list)
    for i, t in odd_documents():
        groups[hashlib.sha256(fold(t).encode()).digest()].append(i)
    assert len(got) == len(odd_documents())
    for r in got:
        ids = groups[bytes(r["digest"])]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = Counter(bytes(r["digest"]) for r in got if r["kept"])
    assert kept == Counter(list(groups))
    assert rows_of(exact_dedup.exact_dedup(none, queries.new_index(spark))) == []


def test_exact_dedup_against_an_earlier_batch(spark):
    index = queries.new_index(spark)
    a = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "ONE"), (4, "three"), (5, "three")], "doc_id long, text string")
    exact_dedup.exact_dedup(a, index).collect()
    got = {r["id"]: r for r in rows_of(exact_dedup.exact_dedup(b, index))}
    assert (got[3]["kept"], got[3]["keep_id"]) == (False, 1)
    assert (got[4]["kept"], got[5]["kept"]) == (False, True)
    assert index.rows().count() == 3


def test_a_batch_given_again_gets_the_same_answer(spark):
    index = queries.new_index(spark)
    a = spark.createDataFrame([(1, "x"), (2, "X"), (3, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(4, "x"), (5, "z")], "doc_id long, text string")
    answer = lambda df, name: as_multiset(tuple(r) for r in exact_dedup.exact_dedup(df, index, batch=name).collect())
    first, second = answer(a, "a"), answer(b, "b")
    assert answer(a, "a") == first and answer(b, "b") == second and index.rows().count() == 3
    index.rebuild(5)
    assert index.rows().count() == 3 and answer(b, "b") == second
    again = exact_dedup.DigestIndex(spark, index.table)
    again.ensure("bigint")
    assert again.buckets == 5
    spark.sql(f"ALTER TABLE {index.table} RENAME TO {index.table}_rebuilt")
    again.ensure("bigint")
    assert again.rows().count() == 3
    again.drop()
    assert exact_dedup.buckets_for(10) == 32 and exact_dedup.buckets_for(10**10) == 2500


def test_drop_exact_copies_keeps_columns_and_one_of_repeated_rows(spark, odd):
    left = exact_dedup.drop_exact_copies(odd, queries.new_index(spark))
    assert left.columns == odd.columns
    assert left.count() == len({fold(t) for _, t in odd_documents()})
    assert left.where("doc_id = 11").count() == 1


# -- SimHash


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", fold(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_components(names, linked):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_simhash_matches_brute_force(spark, odd, docs, none):
    for table in (odd, docs):
        given = [(r.doc_id, r.text) for r in table.collect()]
        fps = [slow_fingerprint(t) for _, t in given]
        pairs = [(a, b) for a, b in itertools.combinations(sorted(set(fps)), 2) if bin(a ^ b).count("1") <= 3]
        comp = slow_components(set(fps), pairs)
        least = {}
        for (i, _), f in zip(given, fps):
            if i is not None:
                least[comp[f]] = min(i, least.get(comp[f], i))
        want = [(i, f, least.get(comp[f])) for (i, _), f in zip(given, fps)]
        got = [(r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows_of(simhash.simhash_groups(table))]
        assert as_multiset(got) == as_multiset(want)
    assert rows_of(simhash.simhash_groups(none)) == []


def test_bit_sliced_links_connect_as_all_pairs_do(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(12):
            x ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 5)))
            fps.add(x)
    fps = sorted(fps)
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if bin(a ^ b).count("1") <= 3]
    want = slow_components(fps, near)
    table = spark.createDataFrame([(np.uint64(x).view(np.int64).item(),) for x in fps], "fp long")
    for chunk in (4096, 3):
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(table, chunk=chunk).collect()]
        assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
        assert slow_components(fps, links) == want
    assert near


def test_lanes_within_any_radius():
    fps = np.array([random.Random(i).getrandbits(64) for i in range(200)], np.uint64)
    planes = simhash.bit_planes(fps)
    for radius in (0, 1, 3, 5, 28, 31):
        lanes = simhash.lanes_within(planes, (1 << 200) - 1, int(fps[7]), radius)
        assert lanes == sum(1 << i for i, x in enumerate(fps) if bin(int(x) ^ int(fps[7])).count("1") <= radius)


@pytest.mark.parametrize("radius,blocks", [(3, 5), (3, 4), (1, 3)])
def test_hot_buckets_are_split_without_losing_links(spark, radius, blocks):
    r = random.Random(9)
    common = r.getrandbits(64)
    fixed = simhash.block_keys(radius, blocks)[0]
    fps = {common & fixed | r.getrandbits(64) & ~fixed for _ in range(500)}
    for x in sorted(fps)[:60]:
        fps |= {x ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, radius + 2))) for _ in range(3)}
    fps |= {r.getrandbits(64) for _ in range(100)}
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in sorted(fps)], "fp long")
    want = slow_components(fps, [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if bin(a ^ b).count("1") <= radius])
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(table, radius, blocks, chunk=16).collect()]
    assert slow_components(fps, links) == want
    assert all(bin(a ^ b).count("1") <= radius for a, b in links)
    if radius == 3 and blocks == 5:
        dealt = simhash.bucket_groups(table, radius, blocks, chunk=16).groupBy("key", "a", "b").count().collect()
        assert sum(x["count"] for x in dealt) < 12 * len(fps) and max(x["count"] for x in dealt) <= 64
    for mask in simhash.block_keys(radius, blocks):
        finer = simhash.smaller_masks(mask, radius)
        assert all(m & mask == mask for m in finer) and sum(bin(m ^ mask).count("1") for m in finer) == 64 - bin(mask).count("1")


def test_near_copies_leave_one_of_each_group(spark, odd, none):
    near, far = prose(5, 400), prose(6, 400)
    given = [(3, near), (7, near), (7, far), (None, near), (None, "lonely words stay here"), (9, near), (9, near), (2, None), (2, ""), (None, None), (8, near.upper()), (8, far + " x")]
    given += [(i, t) for i, t in odd_documents()]
    table = spark.createDataFrame(given, "doc_id long, text string").withColumn("own", F.lit(1)).withColumn("kept_id", F.lit("x")).repartition(3)
    fps = [slow_fingerprint(t) for _, t in given]
    comp = slow_components(list(range(len(given))), [(a, b) for a in range(len(given)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    groups = defaultdict(list)
    for at, (i, t) in enumerate(given):
        groups[comp[at]].append((i is None, i, hashlib.sha256((t or "").encode()).hexdigest(), t is None, t))
    least = lambda rows: min(rows, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    want = as_multiset((g[1], g[4]) for g in map(least, groups.values()))
    left = simhash.drop_near_copies(table)
    assert left.columns == table.columns
    assert as_multiset((r["doc_id"], r["text"]) for r in rows_of(left)) == want
    assert rows_of(simhash.drop_near_copies(none)) == []


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6)]
    got = {r["node"]: r["component"] for r in rows_of(components.connected_components(spark.createDataFrame(edges, "src long, dst long")))}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(300)}}


# -- quality


def test_quality_on_labelled_rows_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality_scores(docs).join(labels, F.col("id") == F.col("doc_id")).select("quality", "keep").collect()
    good = [r.keep for r in got if r.quality == 1]
    junk = [r.keep for r in got if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(junk) <= 0.25 * len(junk)


def test_posteriors_and_scores_match_a_slow_version(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    ballots = {}
    for i, data in texts.items():
        found, words = quality.measures(data)
        ballots[i] = quality.votes(data, found, len(words))
    n = len(quality.LABELLERS)
    good = {i: 0.1 if 1 in v else 0.9 for i, v in ballots.items()}
    for _ in range(50):
        prior = min(0.99, max(0.01, sum(good.values()) / len(good)))
        rate = {}
        for k in range(n):
            for y in (0, 1):
                seen = {1: 1.0, 2: 1.0}
                for i, v in ballots.items():
                    if v[k]:
                        seen[v[k]] += good[i] if y else 1 - good[i]
                for vote in (1, 2):
                    rate[k, y, vote] = seen[vote] / sum(seen.values())
        for i, v in ballots.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[k, 1, x] / rate[k, 0, x]) for k, x in enumerate(v) if x)
            good[i] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    model = quality.fit(docs)
    for r in rows_of(quality.quality_scores(docs, model)):
        assert r["votes"] == ballots[r["id"]] and r["posterior"] == pytest.approx(good[r["id"]], abs=1e-6)
        found, words = quality.measures(texts[r["id"]])
        if words:
            at, value = quality.features(found, words, {})
            z = model.bias + sum(float(model.weights[a]) * float(v) for a, v in zip(at, value))
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
            assert r["keep"] == (r["score"] >= 0.5)


def test_every_kind_of_labelled_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet")).join(labels, F.col("id") == F.col("doc_id")).collect()
    good, junk = ([r for r in got if r.quality == q] for q in (1, 0))
    print("kept of good", sum(r.keep for r in good), len(good), "of junk", sum(r.keep for r in junk), len(junk), "posterior", sum(r.posterior >= 0.5 for r in junk))
    assert not any(r.keep or r.posterior >= 0.5 for r in junk)
    assert sum(r.keep for r in good) >= 0.99 * len(good)


def test_quality_on_odd_rows(odd, none):
    got = rows_of(quality.quality_scores(odd))
    assert len(got) == len(odd_documents())
    assert all(r["score"] == 0 and not r["keep"] for r in got if r["id"] in (4, 5, 6, 7))
    assert rows_of(quality.quality_scores(none)) == []
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in got)


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.75]
    table = np.stack([np.where(r.random(20000) < p, truth, ~truth) + 1 for p in right], axis=1)
    counts = Counter(quality.pattern(row) for row in table.tolist())
    prior, rates = quality.estimate(list(counts), list(counts.values()))
    assert abs(prior - 0.8) < 0.05
    assert all(abs(rates[k, 1, quality.GOOD] - p) < 0.05 for k, p in enumerate(right))


# -- paragraphs


def test_paragraph_dedup_finds_copies_near_copies_and_passages(spark, none):
    para, passage = prose(20, 60), prose(21, 60)
    near = para.split()
    near[30] = "changed"
    rows = [(1, prose(30, 40) + "\n" + para), (2, para + "\n" + prose(31, 40)), (3, prose(32, 50) + "\n" + " ".join(near))]
    rows += [(4, prose(33, 100) + " " + passage + " " + prose(34, 100)), (5, prose(35, 90) + " " + passage + " " + prose(36, 110))]
    rows += [(6, prose(37, 300)), (7, None), (8, ""), (9, "short line\nshort line"), (10, prose(38, 50)), (10, prose(38, 50)), (None, prose(39, 60))]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, kind int, content string")
    got = rows_of(paragraph_dedup.paragraph_dedup(table))
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert by[1]["n_removed"] == 0 and by[1]["n_repeated"] > 0
    assert by[2]["n_removed"] >= 60 and by[3]["n_removed"] >= 60
    assert by[4]["n_removed"] == 0 and by[5]["n_removed"] >= 25 and by[5]["component_ids"] == [4]
    assert all(by[i]["n_removed"] == 0 and by[i]["component_ids"] == [] for i in (6, 7, 8, 9, 10, None))
    assert rows_of(paragraph_dedup.paragraph_dedup(none)) == []


def test_shared_passages_go_from_end_to_end(spark):
    rows, passages = [], []
    for k in range(24):
        passage = prose(4000 + k, 50 + 5 * (k % 8)).split()
        passages.append(len(passage))
        left, right = (prose(1000 + 2 * k + i, 40 + 11 * i).split() for i in (0, 1))
        rows += [(2 * k, left + passage + prose(2000 + k, 30).split()), (2 * k + 1, prose(3000 + k, 60).split() + passage + right)]
    # A third document has the middle of a passage only: what the others share beyond it goes too.
    rows += [(-1, prose(5000, 40).split() + rows[0][1][44:76] + prose(5001, 40).split())]
    text = [(i, " ".join(w)) for i, w in rows]
    got = {r["id"]: r for r in rows_of(paragraph_dedup.paragraph_dedup(spark.createDataFrame(text, "doc_id long, text string").repartition(3)))}
    for k, n in enumerate(passages):
        spans = [(s["start"], s["stop"]) for s in got[2 * k + 1]["spans"]]
        assert spans == [(60, 60 + n)]
        assert got[2 * k]["n_removed"] == 0 or k == 0
    assert got[-1]["n_removed"] == 0


def test_paragraphs_below_a_window_are_found(spark):
    short, wrapped = prose(6000, 5), prose(6001, 150).split()
    near = [*wrapped[:70], "changed", *wrapped[71:]]
    lines = lambda w: "\n".join(" ".join(w[i : i + 15]) for i in range(0, len(w), 15))
    like = prose(6002, 24).split()
    rows = [(1, prose(6003, 9) + "\n" + short), (2, short.replace(" ", "  ") + "\n" + prose(6004, 30)), (3, lines(wrapped)), (4, "Two words\n" + lines(near))]
    rows += [(5, " ".join(like)), (6, prose(6005, 12) + "\n" + " ".join([*like[:-1], "changed"])), (7, "two  Words\n" + prose(6006, 8)), (8, None), (9, " \n")]
    got = {r["id"]: r for r in rows_of(paragraph_dedup.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))}
    spans = {i: [(s["start"], s["stop"]) for s in r["spans"]] for i, r in got.items()}
    assert spans[2] == [(0, 5)] and got[2]["component_ids"] == [1] and got[1]["n_repeated"] == 1
    assert got[4]["n_removed"] >= 135 and 3 in got[4]["component_ids"]
    assert spans[6] == [(12, 36)] and got[6]["component_ids"] == [5]
    assert all(got[i]["n_removed"] == 0 for i in (1, 3, 5, 7, 8, 9))
    assert [got[i]["n_short_repeated"] for i in (4, 7, 8, 9)] == [1, 1, 0, 0]
    assert got[7]["short_component_ids"] == [4] and got[7]["component_ids"] == []
    assert [got[i]["n_paragraphs"] for i in (1, 4, 9)] == [2, 11, 0]


def test_paragraph_clusters_match_brute_force(spark):
    """Paragraphs too short for a common window, so that clusters alone decide: links by the words themselves, the first place of each cluster stays."""
    r = random.Random(12)
    pool = [prose(7000 + k, r.randrange(6, 22)) for k in range(12)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(pool).split()
            if len(p) > 16 and r.random() < 0.4:
                p[-1] = f"end{r.randrange(3)}"
            parts += [" ".join(p), prose(8000 + 10 * i + len(parts), 14)]
        rows.append((i, "\n".join(parts)))
    places = []
    for i, t in rows:
        at = 0
        for line in t.split("\n"):
            words = line.split()
            places.append((i, at, len(words), frozenset(tuple(words[j : j + 5]) for j in range(len(words) - 4))))
            at += len(words)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(places)), 2) if len(places[a][3] & places[b][3]) >= 0.8 * len(places[a][3] | places[b][3])]
    comp = slow_components(range(len(places)), pairs)
    size = Counter(comp.values())
    want = {i: ([], set(), 0) for i, _ in rows}
    for k, (i, at, n, _) in enumerate(places):
        if size[comp[k]] > 1:
            want[i][1].add(places[comp[k]][0])
            want[i] = (want[i][0] + ([(at, at + n)] if comp[k] != k else []), want[i][1], want[i][2] + 1)
    got = rows_of(paragraph_dedup.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    for g in got:
        spans, ids, n = want[g["id"]]
        assert [(s["start"], s["stop"]) for s in g["spans"]] == decontam.merged(spans)
        assert set(g["component_ids"]) == ids and g["n_repeated"] == n


def test_jaccard_forest_connects_as_all_pairs_do():
    r = random.Random(3)
    sets = []
    for _ in range(15):
        s = set(r.sample(range(400), 20))
        for _ in range(6):
            s = (s - {next(iter(s))}) | {r.randrange(400)}
            sets.append(np.array(sorted(s)))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    want = slow_components(range(len(sets)), pairs)
    assert slow_components(range(len(sets)), paragraph_dedup.jaccard_forest(sets, None, 0.8)) == want
    side = np.arange(len(sets)) % 2 == 0
    crossing = [(i, j) for i, j in pairs if side[i] != side[j]]
    assert slow_components(range(len(sets)), paragraph_dedup.jaccard_forest(sets, side, 0.8)) == slow_components(range(len(sets)), crossing)
    bands, per = paragraph_dedup.tune_bands()
    assert bands <= paragraph_dedup.MAX_BANDS and 1 - (1 - 0.8**per) ** bands >= 0.995


def test_runs_and_extensions_match_plain_versions():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 30):
        row = rng.integers(0, 4, n)
        start = rng.integers(0, 40, n)
        stop = start + rng.integers(1, 9, n)
        got = paragraph_dedup.merged_runs(row, start, stop)
        want = [(r, a, b) for r in range(4) for a, b in decontam.merged([(int(x), int(y)) for x, y, k in zip(start, stop, row) if k == r])]
        assert list(zip(*(x.tolist() for x in got))) == want
    spread, width = paragraph_dedup.SPREAD, paragraph_dedup.MIN_WORDS
    for n in (1, 2, 6, 12):
        last = int(rng.integers(60, 200))
        start = rng.permutation(last + 1)[:n]
        keeper, own = rng.integers(0, 2, n), rng.random(n) < 0.3
        place = start + 7 * rng.integers(0, 2, n)
        rows = sorted(zip(start.tolist(), keeper.tolist(), place.tolist(), own.tolist()))
        want = {p for a, *_ in rows for p in range(max(0, a - spread + 1), min(last + 1, a + spread))}
        want -= {a for a, *_, mine in rows if not mine}
        for (a, k, p, mine), (b, l, q, other) in zip(rows, rows[1:]):
            if not mine and not other and k == l and b - a == q - p <= width:
                want -= set(range(a, b + 1))
        assert paragraph_dedup.extension_starts(start, keeper, place, own, last).tolist() == sorted(want)
    grams = rng.integers(-(2**62), 2**62, 90)
    grams[50:80] = grams[10:40]
    hashes = paragraph_dedup.window_hashes(grams, np.arange(70))
    assert hashes[10:20].tolist() == hashes[50:60].tolist() and len(set(hashes.tolist())) == 60


def test_bands_find_paragraphs_at_the_threshold():
    r = random.Random(8)
    bands, per = paragraph_dedup.tune_bands()
    met = 0
    for _ in range(3000):
        a = [b"%d" % r.randrange(3000) for _ in range(49)]
        b = [*a[:20], b"changed", *a[21:]]  # 40 of 50 shingles alike
        grams = [paragraph_dedup.gram_hashes(x, 5) for x in (a, b)]
        keys = paragraph_dedup.band_keys(np.concatenate(grams), np.array([0, len(grams[0])]), bands, per)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 0.99 * 3000


def test_any_shared_run_holds_a_common_anchor():
    words = prose(50, 55).encode().split()
    a = prose(51, 40).encode().split() + words + prose(52, 30).encode().split()
    b = prose(53, 77).encode().split() + words + prose(54, 12).encode().split()

    def windows(w):
        first = paragraph_dedup.gram_hashes(w, 5)[: len(w) - 24]
        return {tuple(w[i : i + 25]) for i in paragraph_dedup.anchors(first, paragraph_dedup.SPREAD).tolist()}

    assert windows(a) & windows(b)


# -- suffixes


def slow_suffix_dedup(given, length=400):
    places = Counter()
    for _, t in given:
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            places[data[i : i + length]] += 1
    out = []
    for i, t in given:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if places[data[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_suffix_dedup_matches_brute_force(request, which, monkeypatch, none):
    table = request.getfixturevalue(which)
    given = [(r.doc_id, r.text) for r in table.collect()]
    got = [(r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows_of(suffix_dedup.suffix_dedup(table))]
    assert as_multiset(got) == as_multiset(slow_suffix_dedup(given))
    assert rows_of(suffix_dedup.suffix_dedup(none)) == []


def test_repeated_offsets_match_brute_force():
    r = random.Random(8)
    length = 12
    for _ in range(300):
        contexts = list({("".join(r.choice("ab") for _ in range(r.randrange(1, 13))).encode(), "".join(r.choice("ab") for _ in range(r.randrange(5, 14))).encode()) for _ in range(r.randrange(2, 9))})
        if len(contexts) < 2:
            continue
        seen = Counter((d, left[len(left) - d :] + right[: length - d]) for left, right in contexts for d in range(min(len(left), length) + 1) if len(right) >= length - d)
        got = suffix_dedup.repeated_offsets(contexts, length)
        for (left, right), spans in zip(contexts, got):
            have = {d for a, b in spans for d in range(a, b + 1)}
            want = {d for d in range(min(len(left), length) + 1) if len(right) >= length - d and seen[d, left[len(left) - d :] + right[: length - d]] > 1}
            assert have == want


def test_deep_shallow_order_sorts():
    r = random.Random(2)
    base = bytes(r.choice(b"ab") for _ in range(150))
    strings = [base[: r.randrange(1, 150)] + bytes(r.choice(b"abc") for _ in range(r.randrange(20))) for _ in range(400)] + [b"", b"", base]
    for shallow in (8, 64):
        assert [strings[i] for i in suffix_dedup.deep_shallow_order(strings, shallow)] == sorted(strings)


@pytest.mark.parametrize("chunk", [1, 3])
def test_hot_grams_are_dealt_out_exactly(spark, odd, chunk):
    shared, r = prose(70, 120), random.Random(71)
    given = [(i, prose(100 + i, 90) + shared[r.randrange(60) : len(shared) - r.randrange(60)] + prose(200 + i, 90)) for i in range(12)]
    given += [(20 + i, prose(300, 70) + " " + shared + prose(400 + i, 60)) for i in range(4)] + [(40, shared), (41, shared[5:]), (42, shared * 2)]
    given += [(r.doc_id, r.text) for r in odd.collect()]
    table = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = [(r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows_of(suffix_dedup.suffix_dedup(table, chunk=chunk))]
    assert as_multiset(got) == as_multiset(slow_suffix_dedup(given))


@pytest.mark.parametrize("size, gone", [(399, 0), (400, 400)])
def test_planted_passages_of_over_50_words_go_from_400_bytes_on(spark, size, gone):
    passage = "".join(c for c in prose(80, 90) if c.isascii())[:size]
    assert len(passage.split()) > 50
    given = [(i, f"{prose(90 + i, 60)}{i}{passage}{i}{prose(95 + i, 60)}") for i in range(5)] + [(5, prose(100, 150))]
    got = [(r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows_of(suffix_dedup.suffix_dedup(spark.createDataFrame(given, "doc_id long, text string")))]
    assert as_multiset(got) == as_multiset(slow_suffix_dedup(given))
    assert {r[0]: r[2] for r in got} == {**dict.fromkeys(range(5), gone), 5: 0}


# -- WARC


def test_warc_round_trip(spark):
    big = "<p>" + "ä" * 1500
    pages = [(1, "http://a/1\r\nX: y", big), (2, "http://a/2", big), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "z" * 999), (8, "u", "z" * 999), (9, "u", big), (9, "u", big), (None, "u", "y" * 1000), (None, "u", big)]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = rows_of(warc.warc_round_trip(table))
    assert len(got) == len(pages)
    for r in got:
        assert r["record_type"] == "response" and r["refers_to"] is None if r["page_id"] not in (1, 2, None) else True
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert [by[i]["record_type"] for i in (1, 2, 9)] == ["revisit", "revisit", "response"]
    assert by[1]["refers_to"] == 9 and by[1]["payload_bytes"] == len(big.encode())
    assert by[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and by[1]["payload"] is None
    assert bytes(by[9]["payload"]).decode() == big and bytes(by[5]["payload"]) == b""
    assert rows_of(warc.warc_round_trip(table.limit(0))) == []


def test_revisits_of_repeated_and_null_ids(spark):
    a, b, c, d = (x * 1200 for x in "abcd")
    pages = [(5, a), (9, a), (5, c), (None, b), (7, b), (None, d), (5, b), (5, "short"), (None, "short")]
    table = spark.createDataFrame([(i, "u", t) for i, t in pages], "page_id long, url string, html string").repartition(3)
    got = [(r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows_of(warc.warc_round_trip(table))]
    target = {(5, a): 9, (None, b): 7, (5, b): 7}
    want = [(i, hashlib.sha1(t.encode()).hexdigest(), "revisit" if (i, t) in target else "response", target.get((i, t))) for i, t in pages]
    assert as_multiset(got) == as_multiset(want)


def test_warc_reader_rejects_damage():
    import io

    one = warc.record_bytes(1, "u", b"payload", None, False, warc._sha1(b"payload"))
    two = warc.record_bytes(2, "u", b"x" * 200_000, None, False, warc._sha1(b"x" * 200_000))
    assert [r.payload for r in warc.read_records(io.BytesIO(one + two))] == [b"payload", b"x" * 200_000]
    bad = warc.record_bytes(1, "u", b"payload", None, False, warc._sha1(b"other"))
    for broken in (one[:-5], bad):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(broken)))


# -- chats


# What may follow a message of each role, and what each role name stands for; written out here, apart from the operator.
AFTER = {None: ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
MEANS = {"system": "system", "developer": "system", "user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant"}


def slow_chat_cost(roles):
    """Dijkstra over (turns taken, last message's role): an empty message costs 2, a merge 1, another name 3, a name for an unknown one 1."""
    heap, seen = [(0, 0, "")], set()
    while heap:
        cost, taken, last = heapq.heappop(heap)
        if (taken, last) in seen:
            continue
        seen.add((taken, last))
        if taken == len(roles) and last == "assistant":
            return cost
        for to in AFTER[last or None]:
            heapq.heappush(heap, (cost + 2, taken, to))
        if taken < len(roles):
            known = MEANS.get((roles[taken] or "").strip().lower())
            for to in ("system", "user", "assistant"):
                name = 0 if known == to else 1 if known is None else 3
                if to in AFTER[last or None]:
                    heapq.heappush(heap, (cost + name, taken + 1, to))
                if to == last:
                    heapq.heappush(heap, (cost + name + 1, taken + 1, to))


def test_chats_are_legal_and_cheapest(spark):
    r = random.Random(4)
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(1, 9)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "Human", None, "tool"]), r.choice(["hi", "", None])))
    rows += [(999, i, r.choice(["user", "assistant"]), f"t{i}") for i in range(500)] + [(None, 1, "user", "n"), (None, 1, "user", "n"), (5, None, "user", "first")]
    table = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, segment int")
    got = chat.format_chats(table).collect()
    assert len(got) == len(rows)
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
    by = defaultdict(list)
    for x in rows:
        by[x[0]].append(x)
    made = defaultdict(list)
    for g in got:
        made[g.conv_id].append(g)
    for conv, turns in by.items():
        turns = sorted(turns, key=key)
        assert sum(g.cost for g in made[conv]) == slow_chat_cost([x[2] for x in turns])
    legal = re.compile(r"^(<\|system\|>\n[^<]*<\|end\|>\n)?(<\|user\|>\n[^<]*<\|end\|>\n<\|assistant\|>\n[^<]*<\|end\|>\n)+$")
    for conv in (0, 1, 2, 999):
        own = sorted(made[conv], key=lambda g: (g.turn is not None, g.turn or 0, g.role is not None, g.role or ""))
        assert legal.match("".join(g.piece for g in own))
    assert chat.format_chats(table.limit(0)).collect() == []
    assert {"keep", "merge", "relabel", "relabel+merge"} <= {g.action for g in got}


def test_chats_with_very_long_and_very_many_turns(spark):
    long = "y" * 3_000_000
    rows = [(1, 0, "user", long), (1, 1, "user", long[:10]), (1, 2, "bot", long)] + [(2, i, "human" if i % 2 else None, "t") for i in range(20_000)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    first = sorted((g for g in got.where("conv_id = 1").collect()), key=lambda g: g.turn)
    assert "".join(g.piece for g in first) == f"<|user|>\n{long}\n\n{long[:10]}<|end|>\n<|assistant|>\n{long}<|end|>\n"
    assert got.where("conv_id = 2").agg(F.sum("cost")).first()[0] == slow_chat_cost([r[2] for r in rows[3:]])


def test_chat_segments_chain_like_one():
    r = random.Random(6)
    for _ in range(200):
        given = [r.randrange(4) for _ in range(r.randrange(1, 12))]
        cut = r.randrange(len(given) + 1)
        parts = [p for p in (given[:cut], given[cut:]) if p]
        flat = [[x for row in chat.transfer(p) for x in row] for p in parts]
        states = chat.chain(flat)
        cost = sum(m[0] for p, (a, b) in zip(parts, states) for m in chat.repair(p, a, b)) + chat.INSERT * len(chat.ENDING[states[-1][1]])
        names = ["", "system", "user", "assistant"]
        assert cost == slow_chat_cost([names[g] or None for g in given])


# -- licenses


def slow_license(text):
    words = contract_words(text)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def slow_edits(template, words):
    """Plain dynamic programming: least edits of template against any run that ends at each place, and that run's latest start."""
    best = {}
    for stop in range(len(words) + 1):
        for start in range(stop, max(-1, stop - 2 * len(template) - 1), -1):
            run = words[start:stop]
            row = list(range(len(run) + 1))
            for i, t in enumerate(template, 1):
                new = [i]
                for j, w in enumerate(run, 1):
                    new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (t != w)))
                row = new
            if stop not in best or row[-1] < best[stop][0]:
                best[stop] = (row[-1], start)
    return best


def slow_notices(text, coverage=0.8):
    """(label, start, stop, edits): the best run of each notice that shares three words in a row with it, then what is left and right of it."""
    words = contract_words(text)
    out = []
    for phrase, label in licenses.NOTICES.items():
        template = phrase.split()
        grams = {tuple(template[i : i + 3]) for i in range(len(template) - 2)}
        todo = [(0, len(words))]
        while todo:
            a, b = todo.pop()
            if not any(tuple(words[i : i + 3]) in grams for i in range(a, b)):
                continue
            ends = slow_edits(template, words[a:b])
            allowed = int((1 - coverage) * len(template) + 1e-9)
            for edits, stop, start in sorted((e, j, i) for j, (e, i) in ends.items() if e <= allowed):
                if any(tuple(words[i : i + 3]) in grams for i in range(a + start, a + stop - 2)):
                    out.append((label, a + start, a + stop, edits))
                    todo += [(a, a + start), (a + stop, b)]
                    break
    return out


def test_notices_are_verified_word_by_word(spark):
    r = random.Random(4)
    fill = ["the", "of", "license", "zz", "under", "software", "public", "a", "version"]
    texts = ["", None, "released under the mit license", "zz " * 30 + "Released under the very MIT license. " * 2]
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software".split()
    texts.append(" zz ".join(" ".join(mit[i : i + 3]) for i in range(len(mit) - 2)))
    for n in range(60):
        words = []
        for _ in range(r.randrange(1, 4)):
            words += [r.choice(fill) for _ in range(r.randrange(12))]
            notice = r.choice(list(licenses.NOTICES)).split()
            for _ in range(r.randrange(4)):
                at = r.randrange(len(notice))
                notice[at : at + r.randrange(2)] = [r.choice(fill)][: r.randrange(2)]
            words += notice
        texts.append(" ".join(words))
    got = rows_of(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert len(got) == len(texts)
    for r_ in got:
        want = slow_notices(texts[r_["id"]] or "")
        size = {label: {} for label in licenses.NOTICES.values()}
        exact = set(licenses.BASE.values())
        mine = sorted((s["label"], s["start"], s["stop"]) for s in r_["spans"] if not (s["coverage"] == 1 and s["label"] in exact and s["stop"] - s["start"] <= 3))
        assert mine == sorted((label, a, b) for label, a, b, _ in want), texts[r_["id"]]
        assert {label for label, *_ in want} <= set(r_["labels"].split(","))
        if want:
            assert r_["score"] >= 0.8
    shredded = next(x for x in got if x["id"] == 4)
    assert shredded["labels"] == "" and shredded["score"] < 0.8


def test_whole_license_texts_from_a_table(spark):
    whole = prose(70, 400)
    words = whole.split()
    changed = " ".join(w if i % 12 else "other" for i, w in enumerate(words))
    torn = " ".join(w if i % 3 else "other" for i, w in enumerate(words))
    table = spark.createDataFrame([("long", whole, False), ("phrase", "two words", True), (None, "no label here", False), ("one", "single", True), ("none", None, False)], "label string, text string, exact boolean")
    given = [(1, prose(71, 200) + " " + whole + " " + prose(72, 90)), (2, changed), (3, torn), (4, "two  WORDS two words"), (None, whole), (5, whole + " " + whole), (6, prose(73, 30000) + " " + changed)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    for block in (100_000, 10):
        got = {r["id"]: r for r in rows_of(licenses.license_scan(docs, templates=table, max_words=block))}
        assert [(s["start"], s["stop"]) for s in got[1]["spans"]] == [(200, 600)] and got[1]["score"] == 1.0
        assert got[2]["labels"] == "long" and 0.9 < got[2]["score"] < 1 and got[3]["labels"] == "" and got[None]["labels"] == "long"
        assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"], got[4]["labels"]) == (2, 0, 2, "phrase")
        assert [(s["start"], s["stop"]) for s in got[5]["spans"]] == [(0, 400), (400, 800)] and got[6]["labels"] == "long"


def test_licenses_match_brute_force(spark, odd, docs, none):
    extra = [(10000, "CC BY-SA and cc by 4.0; cc\nby"), (10001, "All rights reserved. GNU General Public License"), (10002, "Licensed under the Apache License, Version 2.0"), (10003, "licensed under the own apache license version 2.0"), (10007, "licensed under the very own apache license version 2.0"), (10004, "cc"), (10005, None), (10005, None), (10006, "all rights reserved"), (10006, "all rights reserved"), (None, "cc by")]
    table = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    given = [(r.doc_id, r.text) for r in table.collect()]
    got = rows_of(licenses.license_scan(table))
    want = [(i, *slow_license(t)) for i, t in given]
    assert as_multiset((r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == as_multiset(want)
    by = {r["id"]: r for r in got}
    assert by[10002]["labels"] == "apache-2.0" and by[10002]["score"] == 1.0
    assert by[10003]["labels"] == "apache-2.0" and by[10003]["score"] == 0.875 and by[10007]["labels"] == "" and by[10007]["score"] == 0.75
    assert all(0 <= r["score"] <= 1 for r in got)
    assert rows_of(licenses.license_scan(none)) == []


# -- decontamination


def slow_hits(words, items):
    hit, names = set(), set()
    for name, text in items:
        w = contract_words(text)
        size = min(10, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                names.add(name)
    return len(hit), names


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_decontamination_matches_brute_force(spark, odd, docs, none, block):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "iota3 kappa"), (901, None), (902, "?!"), (903, "Same Row"), (903, "same row"), (None, prose(1, 14))], "item_id long, text string"))
    items = [("" if r.item_id is None else str(r.item_id), r.text) for r in bench.collect()]
    table = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    got = rows_of(decontam.decontaminate(table, bench, max_words=block))
    given = [(r.doc_id, r.text) for r in table.collect()]
    want = []
    for i, t in given:
        words = contract_words(t)
        n, names = slow_hits(words, items)
        want.append((i, len(words), n, sorted(names)))
    assert as_multiset((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == as_multiset(want)
    assert rows_of(decontam.decontaminate(none, bench)) == []
    assert sum(r["n_hit"] for r in rows_of(decontam.decontaminate(docs, bench.limit(0)))) == 0


def test_contamination_is_cut_and_clean_rows_stay(spark, odd):
    item = prose(60, 12).replace("é", "e").replace("ß", "s")
    table = spark.createDataFrame([(1, f"Start, {item.upper()}; end of it. " + prose(61, 30)), (2, item), (3, None), (4, "Clean  TEXT\n")], "doc_id long, text string")
    table = table.withColumn("row", F.lit(1)).withColumn("id", F.lit("x"))
    left = decontam.remove_contamination(table, spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: r for r in left.collect()}
    assert left.columns == table.columns and set(got) == {1, 3, 4}
    assert got[1].text == "Start, ; end of it. " + prose(61, 30) and got[3].text is None and got[4].text == "Clean  TEXT\n"


# -- segmentations


def all_segmentations(pieces, unit):
    ids = {t: i for i, t in enumerate(pieces.texts) if np.isfinite(pieces.logs[i]) and not t.startswith("<0x")}
    if not unit:
        return [((), 0.0)]
    out = []
    for n in range(1, len(unit) + 1):
        if unit[:n] in ids:
            i = ids[unit[:n]]
            out += [((i, *rest), pieces.logs[i] + w) for rest, w in all_segmentations(pieces, unit[n:])]
    return out


@pytest.mark.parametrize("ahead", [32, 1])
def test_samples_follow_the_distribution_without_replacement(monkeypatch, ahead):
    monkeypatch.setattr(segment, "AHEAD", ahead)
    pieces = segment._pieces(None)
    whole = all_segmentations(pieces, "▁then")
    z = math.log(sum(math.exp(w) for _, w in whole))
    p = {s: math.exp(w - z) for s, w in whole}
    n = 6000
    got = segment.sample_texts(["then"] * n, list(range(n)), pieces, 3)
    for samples in got:
        keys = [tuple(s["ids"].tolist()) for s in samples]
        assert len(set(keys)) == 3
        assert all(a["value"] >= b["value"] for a, b in zip(samples, samples[1:]))
        assert all(abs(math.exp(s["log_p"]) - p[k]) < 1e-9 for s, k in zip(samples, keys))
    pairs = Counter(tuple(tuple(s["ids"].tolist()) for s in samples[:2]) for samples in got)
    for (a, b), seen in pairs.most_common(4):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(seen / n - want) < 4 * math.sqrt(want / n)
    estimate = np.mean([sum(math.exp(s["log_p"] - s["log_inclusion"]) for s in samples) for samples in got])
    assert abs(estimate - 1) < 0.05


def test_few_segmentations_are_all_given_and_bytes_round_trip():
    import sentencepiece

    pieces = segment._pieces(None)
    model = sentencepiece.SentencePieceProcessor(model_file=segment.model_path())
    texts = ["", "a", "\n", " ", "  a\nb  ", "日本語 тест 🜚🜛", "x" * 3000, prose(9, 2000), "tab\tÀ́ e​", "5 7"]
    for text, samples in zip(texts, segment.sample_texts(texts, list(range(len(texts))), pieces, 5)):
        assert len({tuple(s["ids"].tolist()) for s in samples}) == len(samples) >= 1
        assert all(model.decode(s["ids"].tolist()) == text for s in samples)
    assert sum(math.exp(s["log_p"]) for s in segment.sample_texts(["a"], [3], pieces, 5)[0]) == pytest.approx(1)


def test_segmentation_queries_on_odd_rows(odd, none, docs):
    got = rows_of(segment.sample_segmentations(odd))
    again = rows_of(segment.sample_segmentations(odd.coalesce(1)))
    assert as_multiset(sorted(r.items()) for r in got) == as_multiset(sorted(r.items()) for r in again)
    assert {r["id"] for r in got} == {i for i, _ in odd_documents()}
    assert rows_of(segment.sample_segmentations(none)) == []
    decoded = {(r["doc_id"], r["rank"]): r["text"] for r in rows_of(segment.decode(segment.sample_segmentations(docs).withColumnRenamed("id", "doc_id")))}
    assert all(decoded[r.doc_id, 1] == (r.text or "") == decoded[r.doc_id, 2] for r in docs.collect())
    assert {r["text"] for r in rows_of(segment.decode(segment.encode(odd)))} == {t or "" for _, t in odd_documents()}
