"""Toxicity of whole rows: the text travels once, inside its row."""

from jobsight.llm import toxicity_rnn as T


def test_rows_are_scored_like_their_texts(spark):
    texts = ["you are bad bad", "a fine day", None, "", "bad", "fine fine words " * 40]
    net = T.train(["bad words %d" % i for i in range(8)] + ["fine day %d" % i for i in range(8)], [1] * 8 + [0] * 8, steps=20)
    docs = spark.createDataFrame([(i, "xx", t) for i, t in enumerate(texts * 50)], "doc_id long, lang string, text string").repartition(3)
    got = T.score_rows(docs, net)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    inputs = plan.split("MapInArrow")[1].split("\n")[1]
    assert " AS text" not in inputs and "AS row" in inputs
    want = {r["doc_id"]: r["score"] for r in T.score(docs, net).collect()}
    rows = got.collect()
    assert len(rows) == 300 and all(abs(r["score"] - want[r["row"]["doc_id"]]) < 1e-6 for r in rows)
    assert all(r["row"]["text"] == texts[r["row"]["doc_id"] % 6] for r in rows)
