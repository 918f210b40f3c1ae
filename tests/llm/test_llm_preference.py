"""Preference pairs by plain comparison, and the registered SQL."""

import pytest

from relmine.llm import preference, queries
from tests.llm.helpers import as_rows
from tests.oracle_harness import compare, duck_connect

TURNS = "pair_id long, is_chosen boolean, turn long, role string, text string"


def plain(rows):
    sides = {}
    for pair, chosen, turn, role, text in rows:
        if pair is not None:
            sides.setdefault(pair, ({}, {}))[not chosen].setdefault(-1 if turn is None else turn, set()).add((role or "", text or ""))
    out = set()
    for pair, (c, r) in sides.items():
        if not c or not r:
            continue
        first = min((t for t in {*c, *r} if c.get(t) != r.get(t)), default=None)
        for name, side in (("chosen", c), ("rejected", r)):
            for turn, said in side.items():
                for role, text in said:
                    section = "prompt" if first is None or turn < first else name
                    head = f"<|{role}|>\n"
                    counted = section != "prompt" and role == "assistant"
                    span = (len(head), len(head) + len(text) + 8) if counted else (0, 0)
                    out.add((pair, section, turn, role, f"{head}{text}<|end|>\n", *span))
    return out


def test_common_prefix(spark):
    rows = [
        (1, True, 0, "user", "hi"), (1, False, 0, "user", "hi"),
        (1, True, 1, "assistant", "good é😀"), (1, False, 1, "assistant", "bad"),
        (1, True, 2, "user", "same"), (1, False, 2, "user", "same"),
        (2, True, 0, "user", None), (2, False, 0, "user", ""), (2, False, 1, "assistant", "more"),
        (3, True, 0, "user", "alone"),
        (4, True, 0, "user", "x"), (4, False, 0, "user", "x"), (4, True, 0, "user", "x"),
        (5, True, 0, "user", "p"), (5, True, 0, "user", "q"), (5, False, 0, "user", "q"),
        (6, True, None, None, "s"), (6, False, None, None, "s"), (6, True, 1, "assistant", "t"),
        (None, True, 0, "user", "n"),
    ]
    rows += [(7, side, t, "user", f"t{t}") for side in (True, False) for t in range(400)] + [(7, True, 400, "assistant", "end")]
    got = [tuple(r.values()) for r in as_rows(preference.format_pairs(spark.createDataFrame(rows, TURNS)))]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert preference.format_pairs(spark.createDataFrame([], TURNS)).count() == 0


def test_pairs_by_last_answer(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"), (0, 3, "assistant", "best"), (0, 4, "user", "bye"),
        (1, 0, "user", "yo"), (1, 1, "assistant", "worst"),
        (2, 0, "user", "no answer"), (3, 0, "assistant", "x"),  # a partner without an answer
        (4, 0, "assistant", "alone"),
        (6, 0, "user", "q"), (6, 1, "assistant", "same"), (7, 0, "user", "r"), (7, 1, "assistant", "same"),
        (8, None, None, None), (8, 1, "assistant", "b"), (8, 1, "assistant", "c"), (8, 1, "tool", "t"), (9, 0, "assistant", None),
        (0, 0, "user", "hi"), (None, 0, "assistant", "n"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r.values())[:4] + (r["rendered"].split("\n")[1].removesuffix("<|end|>"),) for r in as_rows(preference.format_pairs(preference.last_answer_pairs(turns)))}
    assert got == {
        (0, "prompt", 0, "user", "hi"), (0, "prompt", 1, "assistant", "a0"), (0, "prompt", 2, "user", "more"),
        (0, "chosen", 3, "assistant", "best"), (0, "rejected", 3, "assistant", "worst"),
        (1, "prompt", 0, "user", "yo"), (1, "chosen", 1, "assistant", "worst"), (1, "rejected", 1, "assistant", "best"),
        (6, "prompt", 0, "user", "q"), (6, "prompt", 1, "assistant", "same"), (7, "prompt", 0, "user", "r"), (7, "prompt", 1, "assistant", "same"),
        (8, "prompt", -1, "", ""), (8, "chosen", 1, "assistant", "c"), (8, "chosen", 1, "tool", "t"), (8, "rejected", 1, "tool", "t"), (8, "rejected", 1, "assistant", ""),
        (9, "chosen", 0, "assistant", ""), (9, "rejected", 0, "assistant", "c"),
    }
    assert preference.last_answer_pairs(turns.limit(0)).count() == 0


def test_prompts_are_found(spark, sf_dir):
    got = {r["section"]: r["count"] for r in as_rows(preference.op10_preference_pairs(spark, sf_dir).groupBy("section").count())}
    assert got["prompt"] > got["chosen"] > 0 and got["rejected"] > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    r = compare(spark, duck_connect(sf_dir), name, queries.QUERIES[name], queries.ORACLE[name], sf_dir)
    assert r["ok"] and not r["type_diff"], r
