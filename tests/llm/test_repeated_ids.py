from __future__ import annotations

from quire.llm import simhash


def test_rows_of_one_id_are_judged_in_their_own_groups(spark):
    rows = [(1, "a b c d e f g h"), (1, "quite another text stands here alone"), (2, "a b c d e f g h"), (3, "quite another text stands here alone"), (1, "a b c d e f g h")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(rows[:2])
