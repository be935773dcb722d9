import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.sources import scratch

CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join(spark, how):
    big = common.materialize(spark.range(9_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(8)).when(F.col("id") % 50 != 0, F.col("id")).alias("k"), F.col("id").alias("v")))
    small = spark.createDataFrame([(7, "a"), (20, "b"), (None, "c"), (9_999_999, "d")], "k long, w string")
    plain = lambda df: sorted(map(tuple, df.select("k", "v", "w").collect()), key=repr)
    true = plain(big.join(small, ["k"], how))
    assert plain(common.spread_join(big, small, ["k"], how)) == true
    known = spark.createDataFrame([(7,)], "k long")
    assert plain(common.spread_join(big, small, ["k"], how, hot=known)) == true
    assert plain(common.spread_join(big, small, ["k"], how, hot=known.limit(0))) == true


def test_settings_come_back(spark):
    before = spark.conf.get(CONF)

    def fail(batches):
        for _ in batches:
            raise RuntimeError("no")
        yield from ()

    with pytest.raises(Exception, match="no"):
        common.materialize(spark.range(10).mapInArrow(fail, "id long"), 3)
    assert spark.conf.get(CONF) == before
    sizes = common.materialize(spark.range(10).coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long"), 3)
    assert sorted(r.n for r in sizes.collect()) == [1, 3, 3, 3]


def test_pieces_and_scratch(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(7))], ["x"])
    assert [p.num_rows for p in common.pieces(iter([batch, batch.slice(0, 0)]), 3)] == [3, 3, 1]
    made = common.materialize(spark.range(3))
    folder = made.scratch_path.removeprefix("file:")
    assert spark.sparkContext.applicationId in folder and os.path.exists(folder)
    common.discard(made)
    assert not os.path.exists(folder)
    own = os.path.dirname(folder)
    os.makedirs(f"{own}/more")
    scratch._remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), f"{own}/more")
    assert not os.path.exists(f"{own}/more")
