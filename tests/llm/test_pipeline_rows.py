"""The near-copy stage looks at rows, not at ids."""

from collections import Counter

import corpus_pipeline
from callsight.llm import shingle_join

B = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
A = " ".join(f"w{k}" for k in range(30))


def test_rows_that_repeat_an_id_are_judged_each(spark, sf):
    rows = [
        (3, B, "x", 1),
        (5, A, "x", 1),  # linked with nothing
        (5, f"{B} z", "x", 1),  # near copy of 3, beside another text of its id
        (7, f"{A} y", "x", 1),  # near copy of the first 5
        (9, "", "x", 1),
        (9, None, "x", 1),
        (9, "", "x", 1),
        (11, B, "b", 2),  # copy of 3
        (2, "quite alone here", "x", 1),
        (2, "quite alone here", "a", 3),  # the same row but for other columns
        (None, B, "x", 1),
        (None, B, "x", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, mark int").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.without_near_copies(spark, docs, sf).collect()))
    stay = [rows[0], rows[1], (9, "", "x", 1), (9, None, "x", 1), (2, "quite alone here", "a", 3), rows[10], rows[11]]
    assert got == Counter(stay)
    assert corpus_pipeline.without_near_copies(spark, docs.where("false"), sf).count() == 0


def test_texts_of_one_id_that_are_linked_leave_one(spark, sf):
    docs = spark.createDataFrame([(5, B), (5, f"{B} z"), (5, f"{B} z"), (6, f"{B} z")], "doc_id long, text string")
    got = corpus_pipeline.without_near_copies(spark, docs, sf).collect()
    assert len(got) == 1 and got[0].doc_id == 5


def test_groups_name_the_component_of_every_row_with_words(spark):
    docs = spark.createDataFrame([(1, B), (2, B), (3, f"{B} z"), (3, A), (4, ""), (None, A)], "doc_id long, text string")
    got = shingle_join.groups(docs).collect()
    by = Counter(bytes(r.group) for r in got)
    assert len(got) == 5 and sorted(by.values()) == [2, 3]
