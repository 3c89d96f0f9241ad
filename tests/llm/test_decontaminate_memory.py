import re

from tracklake.llm import decontaminate


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_aggregation_of_hits_gets_no_words(spark):
    """An aggregation with sets keeps its input rows, so a task would hold the words of all its documents."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "short item")], "item_id long, text string")
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().optimizedPlan()
    hits = [p for p in nodes(plan) if p.nodeName() == "Aggregate" and "text_hash" in p.toString().split("\n")[0]]
    assert hits
    for p in hits:
        assert not re.search(r"\b(words|hashes|text)#", p.child().output().mkString(" "))
