from centsible.llm import ngramjoin


def test_one_id_on_a_near_copy_and_on_a_unique_text(spark):
    rows = [(1, "one two"), (2, "One  two"), (2, "a text of its own"), (3, "same words"), (3, "same  words"), (3, "alone too")]
    stay = {(r.doc_id, r.text) for r in ngramjoin.one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "one two"), (2, "a text of its own"), (3, "alone too")} < stay
    assert len(stay) == 4 and len({t for _, t in stay} & {"same words", "same  words"}) == 1
