"""The pipeline's stages, one after the other."""

import corpus_pipeline
from relmine.llm import exactdup, neardup, pii, toxicity
from tests.llm.helpers import as_rows, clusters, normalised, shingles
from tests.llm.test_llm_packing import check


def test_stages_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in as_rows(docs)}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "near dedup", "personal data", "packing"]

    toxic = {r["doc_id"] for r in as_rows(toxicity.op6_toxic_neighbours(spark, sf_dir)) if r["predicted"]}
    left = stages["toxicity"](spark, docs, sf_dir)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in as_rows(left)}
    assert kept == set(rows) - toxic

    left = stages["exact dedup"](spark, left, sf_dir)
    assert left.columns == docs.columns
    first = {}
    for i in sorted(kept):
        first.setdefault(normalised(rows[i]["text"]), i)
    assert {r["doc_id"] for r in as_rows(left)} == (kept := set(first.values()))

    left = stages["near dedup"](spark, left, sf_dir)
    found = clusters({i: shingles(rows[i]["text"]) for i in kept})
    assert {r["doc_id"] for r in as_rows(left)} == (kept := {i for i, c in found.items() if i == c})

    left = stages["personal data"](spark, left, sf_dir)
    assert left.columns == docs.columns
    masked = {r["doc_id"]: r["text"] for r in as_rows(left)}
    assert masked == {i: pii.masked(rows[i]["text"], pii.find_spans(rows[i]["text"])) for i in kept}

    check(as_rows(corpus_pipeline.run(spark, sf_dir)), list(masked.items()))


def test_dedup_operators_are_those_of_the_queries():
    assert corpus_pipeline.drop_copies is exactdup.drop_copies and corpus_pipeline.drop_near_copies is neardup.drop_near_copies
