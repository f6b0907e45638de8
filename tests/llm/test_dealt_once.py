"""What the near-copy stage deals out: no whole tables, and each posting once."""

from collections import Counter

from jobsight.llm import ngram_join as N
from jobsight.llm.common import materialise, without


def subtree(lines, at):
    """The lines of a plan below line ``at``."""
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    end = next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))
    return lines[at + 1:end]


def test_only_near_rows_meet_the_keys(spark):
    rows = materialise(spark.range(2000).selectExpr("id AS doc_id", "concat('t', id) AS text"), "rows")
    keys = materialise(spark.range(0, 2000, 9).selectExpr("id AS doc_id").unionByName(spark.createDataFrame([(9,), (None,)], "doc_id long")), "keys")
    out = without(rows, keys, "doc_id")
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i in range(2000) if i % 9]
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(lines) if " Join " in f" {x.lstrip(' :+-')}" and "strategy=broadcast" not in x]
    assert len(joins) == 1 and any("getbit" in x for x in subtree(lines, joins[0]))


def test_postings_are_dealt_once(spark):
    """(grp, n, prefix): pairs and a list of members without a common group, of other bands, of one group."""
    rows = [(1, 100, [1, 2, 3]), (1, 100, [1, 2, 3]), (2, 101, [2, 3, 4]), (3, 100, [9, 3]), (4, 1000, [4, 2]), (5, 7, [50]), (6, 7, [60]), (6, 8, [60])]
    nodes = materialise(spark.createDataFrame(rows, "grp long, n long, prefix array<long>"), "nodes")
    lists = N.posting_lists(nodes, 90)
    got = Counter((r["token"], r["band"], r["old"], r["grp"], r["n"], r["pos"], r["m"]) for r in lists.collect())
    width, held = N.math.log(100 / 90) * 1.001, {}
    for (grp, n, prefix), members in Counter((g, n, tuple(p)) for g, n, p in rows).items():
        for pos, token in enumerate(prefix):
            for old in (False, True):
                band = int(N.math.log(n) / width) + old
                held.setdefault((token, band), []).append((old, grp, n, pos, members))
    want = Counter()
    for key, own in held.items():
        m = sum(x[-1] for x in own)
        if m > 1 and not all(x[0] for x in own):
            want.update((*key, *x[:-1], m) for x in own)
    assert got == want and want
    plan = lists._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(token") == 1
