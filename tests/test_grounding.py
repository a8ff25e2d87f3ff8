import random

from quillmark.functions.text import grounded
from quillmark.operators.grounding import grounded_in


def test_quotes_of_any_length_against_all_texts(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma", "d", "ee", "Étude", "don't", "x_y", "日本", "zeta-zeta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "short"]
    quotes = []
    for t in texts[:50]:
        if t:
            a = rng.randrange(len(t))
            quotes.append(t[a : a + rng.randint(1, 60)])
    quotes += ["alpha", "“alpha Beta”", "*gamma*", "lpha Bet", "d", "don’t  x_y", None, "", " ", "nowhere to be found", "_ee_", "日"]
    quotes = [q for q in quotes if q is None or not q.strip() or any(c.isalnum() for c in q)]
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, raw string").repartition(2)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(i, k): grounded(r, t) for i, t in enumerate(texts) for k, r in enumerate(quotes)}
    got = {(r.doc_id, r.item_id): r.excerpt for r in grounded_in(q, d).collect()}
    assert got == {k: v for k, v in want.items() if v is not None} and len(got) > 300


def test_nothing_to_look_up(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "!!"), (2, None)], "item_id long, raw string")
    assert grounded_in(q, d).count() == 0 and grounded_in(q.limit(0), d).count() == 0


def test_texts_are_read_once_for_their_parts(spark):
    """What is left to do after the parts were found normalises no text again."""
    d = spark.createDataFrame([(1, "one two three four five six seven eight")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "two three four five six seven eight")], "item_id long, raw string")
    found = grounded_in(q, d)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "normal_title(text" not in plan and [tuple(r) for r in found.collect()] == [(1, 1, "two three four five six seven eight")]
