"""Every sentence that offends, not the worst alone."""

from kilnflow.llm import toxicity


def test_all_offending_sentences_are_located(spark):
    plain = ["the river runs past the old mill", "she wrote letters all winter", "bread and salt on the table"]
    bad = "you are a zorgblat"
    rows = [(i, ". ".join([plain[i % 3], bad, plain[(i + 1) % 3]] if i % 3 == 0 else [plain[i % 3], plain[(i + 1) % 3]]), int(i % 3 == 0)) for i in range(400)]
    test = [(1000, f"{plain[0]}. {bad}. {plain[1]}! {bad}. {plain[2]}\n{bad}"), (1001, ". ".join(plain)), (1002, None)]
    docs = spark.createDataFrame([*[(i, t) for i, t, _ in rows], *test], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).filter("doc_id >= 1000").collect()}
    many = got[1000]
    assert [x.sentence for x in many.offending] == [1, 3, 5] and all(bad in toxicity.sentences(test[0][1])[x.sentence] for x in many.offending)
    assert max(x.score for x in many.offending) == many.worst_score
    assert got[1001].worst_sentence is not None and got[1001].offending == [] and got[1002].offending == []
