"""Cluster-safety of the session helpers and the scan spreading."""

from larder.session import ensure_checkpoint_dir
from larder.sources.tables import SPREAD, read_driver


def test_checkpoint_dir_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    got = ensure_checkpoint_dir(spark)
    if configured:   # a configured shared folder is used as is, never replaced
        assert got == configured
    else:
        assert got and spark.sparkContext.getCheckpointDir()


def test_scans_are_spread_only_where_the_session_asks(spark):
    def rebalanced():
        df = read_driver(spark, "/root/testdata/sf0.001", "lineitem")
        return "Rebalance" in df._jdf.queryExecution().optimizedPlan().toString()

    assert not rebalanced()
    spark.conf.set(SPREAD, "true")
    try:
        assert rebalanced()
    finally:
        spark.conf.unset(SPREAD)
