"""Registered queries of the corpus operators, with SQL where it can say them."""

from __future__ import annotations

from relmine.llm import audit, exactdup, preference
from relmine.llm.audit import op12_wide_counters
from relmine.llm.bpe import op1_bpe_round_trip
from relmine.llm.exactdup import op8_exact_dedup
from relmine.llm.neardup import op7_odd_sketch_near_dedup
from relmine.llm.omh import op2_order_minhash
from relmine.llm.packing import op3_pack_sequences
from relmine.llm.passages import op4_repeated_runs
from relmine.llm.periodic import op11_lyndon_runs
from relmine.llm.piecebpe import op13_merge_rounds
from relmine.llm.pii import op5_personal_data
from relmine.llm.preference import op10_preference_pairs
from relmine.llm.repeats import op4_repeated_passages
from relmine.llm.sharding import op9_histogram_shards
from relmine.llm.toxicity import op6_toxic_neighbours

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_order_minhash,
        op3_pack_sequences,
        op4_repeated_passages,
        op4_repeated_runs,
        op5_personal_data,
        op6_toxic_neighbours,
        op7_odd_sketch_near_dedup,
        op8_exact_dedup,
        op9_histogram_shards,
        op10_preference_pairs,
        op11_lyndon_runs,
        op12_wide_counters,
        op13_merge_rounds,
    )
}

ORACLE: dict[str, str] = {"op8_exact_dedup": exactdup.ORACLE, "op10_preference_pairs": preference.ORACLE, "op12_wide_counters": audit.ORACLE}
