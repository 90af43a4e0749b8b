"""The pipeline against a slow version of its stages."""

import corpus_pipeline
from test_operators import contract_words, fold, odd_documents, prose, slow_components, slow_fingerprint, slow_hits

from impactgraph.llm import quality

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "simhash", "decontaminate", "segment"]
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    model = quality.quality_scores(docs).where("keep").select("id").collect()
    left = {r.doc_id: r.text for r in good.collect()}
    assert set(left) == {r.id for r in model}
    exact = stages["exact_dedup"](spark, good, SF)
    largest = {}
    for i, t in left.items():
        largest[fold(t)] = max(i, largest.get(fold(t), i))
    left = {i: left[i] for i in largest.values()}
    assert {r.doc_id for r in exact.collect()} == set(left)
    near = stages["simhash"](spark, exact, SF)
    fps = {i: slow_fingerprint(t) for i, t in left.items()}
    comp = slow_components(list(fps), [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3])
    left = {i: t for i, t in left.items() if comp[i] == i}
    assert {r.doc_id for r in near.collect()} == set(left)
    clean = stages["decontaminate"](spark, near, SF)
    assert clean.columns == docs.columns
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r.text for r in clean.collect()}
    for i, t in left.items():
        words = contract_words(t)
        hits, _ = slow_hits(words, items)
        if not hits:
            assert got[i] == t
        elif hits > 0.5 * len(words):
            assert i not in got
        else:
            assert len(contract_words(got[i])) == len(words) - hits
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == set(got)
    assert len({(r.doc_id, r["rank"]) for r in final}) == len(final)


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null, empty and long texts, clashing columns, and an empty table, through every stage."""
    stages = dict(corpus_pipeline.STAGES)
    rows = [(i, t, "en", "src", 0, b"d", 1, True, "row", "x") for i, t in [*odd_documents(), (7, prose(90, 200)), (None, prose(91, 50)), (20, prose(92, 100_000))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest binary, id long, kept boolean, row string, own string").repartition(3)
    exact = stages["exact_dedup"](spark, docs, SF)
    by = {}
    for i, t, *_ in rows:
        by[fold(t)] = max(by.get(fold(t), -1), -1 if i is None else i)
    assert sorted((fold(r.text), -1 if r.doc_id is None else r.doc_id) for r in exact.collect()) == sorted(by.items())
    near = stages["simhash"](spark, exact, SF)
    left = {}
    for r in exact.collect():
        left.setdefault(slow_fingerprint(r.text), []).append(r)
    links = [(a, b) for a in left for b in left if a < b and bin(a ^ b).count("1") <= 3]
    assert near.count() == len(set(slow_components(list(left), links).values()))
    clean = stages["decontaminate"](spark, near, SF)
    assert exact.columns == near.columns == clean.columns == docs.columns
    assert clean.count() == near.count()
    final = stages["segment"](spark, clean, SF)
    assert final.where("not round_trip").isEmpty() and final.select("doc_id").distinct().count() == clean.select("doc_id").distinct().count()
    none = docs.limit(0)
    for name in ("quality", "exact_dedup", "simhash", "decontaminate"):
        none = stages[name](spark, none, SF)
        assert none.columns == docs.columns and none.isEmpty()
    assert stages["segment"](spark, none, SF).isEmpty()
