"""Word stems, the inverted index against the scanning search, appends."""

import random

import pytest
from pyspark.sql import functions as F

from jobsight.functions.stemming import stems_sql
from jobsight.operators import filters as W
from jobsight.operators.search_index import SearchIndex
from testkit import rows

# --- fixed values: words and their stems by the published English rules -----------------
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die ties tie cries cri hopping hop hoping hope caresses caress gas gas this this gaps gap kiwis kiwi
agreed agre feed feed luxuriated luxuri sized size generate generat generic generic communism communism happy happi
by by say say cry cri relational relat conditional condit rational ration valenci valenc digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative format formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homologou activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll exceed exceed succeeding succeed
youth youth boyish boyish flying fli engineers engin engineering engin developers develop analysts analyst""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    got = spark.createDataFrame([([w for w, _ in pairs],)], "w array<string>").select(F.expr(stems_sql("w"))).first()[0]
    assert [(w, s) for (w, _), s in zip(pairs, got)] == pairs


WORDS = ["engineer", "Engineers", "engineering", "data", "Data-lead", "Résumé", "writers", "testing", "tester", "QA", "the", "of", "metadata"]


def postings_table(spark, seed, n, start=0):
    r = random.Random(seed)
    text = lambda: r.choice([None, " ".join(r.choices(WORDS, k=r.randrange(6)))])
    data = [(start + i, text(), text(), text(), r.choice(["Glints", "Indeed"])) for i in range(n)]
    return spark.createDataFrame(data, "job_id long, job_title string, company_name string, skills string, platform string")


QUERIES = ["engineer", "engineers tests", "-data engineer", '"data engineer"', '"resume writers"', '"engineer data testing"', "the", "-qa",
           'lead "data lead" -testing', '"qa" "data"', "", None, "full-stack data-leads", '"of data the qa"', "zebra"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    first, more = postings_table(spark, 1, 400), postings_table(spark, 2, 150, 400)
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("index")), "job_id").build(first).append(more)
    return index, first.unionByName(more).cache()


@pytest.mark.parametrize("query", QUERIES)
def test_index_finds_what_the_scan_finds(indexed, query):
    index, table = indexed
    assert sorted(index.search(table, query).collect(), key=repr) == sorted(W.text_search(table, query).collect(), key=repr)


def test_search_opens_the_folders_of_its_terms(spark, indexed):
    index, table = indexed
    plan = index.search(table, "engineer -qa")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket").replace("[[", "[") or "bucket" in plan.split("PartitionFilters:")[1][:80]
    assert index.keys_of(["engin"]).select(F.input_file_name()).distinct().count() <= 2       # one folder, two writes
    filtered = W.search_jobs(table, query="engineers", platforms=["Glints"], all_platforms=["Glints", "Indeed"], index=index)
    assert sorted(rows(filtered, "job_id")) == sorted(rows(W.text_search(table.where("platform = 'Glints'"), "engineers"), "job_id"))


def test_rows_without_key_and_empty_tables(spark, tmp_path):
    table = postings_table(spark, 3, 5)
    empty = SearchIndex(spark, str(tmp_path / "empty"), "job_id").build(table.limit(0))
    assert empty.append(table).search(table, "data engineer qa").count() == W.text_search(table, "data engineer qa").count()
    with pytest.raises(Exception, match="cannot be indexed"):
        SearchIndex(spark, str(tmp_path / "x"), "job_id").build(table.withColumn("job_id", F.lit(None).cast("long")))
