"""Tags are paired inside the page's row."""

from jobsight.operators import elements as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_elements_are_paired_inside_the_page(spark):
    pages = spark.createDataFrame([(1, "u", "<p><b>x</p></b><i>"), (2, "u", None)], "page_id long, url string, html string")
    t = E.element_table(pages)
    assert "Exchange" not in _plan(t) and "Window" not in _plan(t)
    assert [[tuple(e)[:6] for e in r["elements"]] for r in t.orderBy("page_id").collect()] == [
        [(0, 2, 0, 1, 3, "p"), (1, 2, 1, 2, 4, "b"), (2, 3, 0, 5, 6, "i")], []]
