"""Pages of a written order equal OFFSET and open the files that hold them."""

import random

import pytest

from jobsight.operators import ordering as T
from jobsight.operators.page_index import PageIndex
from testkit import rows


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(4)
    data = [(r.choice([None, r.randrange(40)]), i % 97, r.choice(["x", None, "ü"])) for i in range(5000)]
    return spark.createDataFrame(data, "k int, v long, t string").repartition(7).cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    return PageIndex(spark, str(tmp_path_factory.mktemp("pages")), "k").build(table, file_rows=300)


@pytest.mark.parametrize("page,size", [(1, 500), (2, 7), (10, 500), (11, 500), (17, 299), (3, 1700), (0, 20)])
def test_pages_equal_offset(table, index, page, size):
    assert rows(index.page(page, size)) == rows(T.paginate(table, "k", page, size))
    assert rows(index.info(page, size)) == rows(T.page_info(table, page, size))


def test_a_page_opens_few_files(index):
    assert index.files().count() >= 17
    assert len(index.page(20, 100).inputFiles()) <= 2
    assert len(index.page(1, 10).inputFiles()) == 1


def test_empty_table(spark, table, tmp_path):
    index = PageIndex(spark, str(tmp_path / "x"), "k").build(table.limit(0))
    assert index.page(1).count() == 0 and rows(index.info(3)) == rows(T.page_info(table.limit(0), 3))
