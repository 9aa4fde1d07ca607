"""What a query leaves on the disk."""

import os

import pytest

from tallyspan import registry
from tallyspan.operators import nearest
from tallyspan.shared import interim, keep, shared_folder

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def kept(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_interim_tables_go_and_results_stay(spark):
    before = kept(spark)
    with interim() as result:
        one = keep(spark.range(10), "one")
        with interim() as inner:
            two = inner(keep(one, "gone"), "two")
        assert two.count() == 10
        three = result(two, "three")
    assert three.count() == 10 and [n.split("-")[0] for n in kept(spark) - before] == ["three"]


def test_a_kept_table_leaves_no_shuffle_files(spark):
    files = lambda: {f for top in [spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()] for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    keep(spark.range(1000).repartition(5).groupBy("id").count(), "counted")
    assert files() <= before


@tables
@pytest.mark.parametrize("name, most", [("anomaly_rows", 7), ("classify_unmatched", 11), ("headline", 15), ("cell_boxes", 2), ("semantic_match", 5)])
def test_a_query_keeps_only_what_it_reads(spark, name, most):
    before = kept(spark)
    registry.QUERIES[name](spark, SF)
    left = kept(spark) - before
    assert len(left) <= most, sorted(left)
