"""Physical-plan shapes we rely on for scale (checked with explain)."""

import contextlib
import io

import __spark_entry__ as E
from dropledger.sources import zipcsv
from tests.conftest import SF_SMALL


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def q(spark, key):
    return E.queries()[key](spark, SF_SMALL)


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(q(spark, "recent_checks"))
    assert "TakeOrderedAndProject" in plan(q(spark, "log_filter"))


def test_folds_aggregate_partially_before_the_shuffle(spark):
    p = plan(q(spark, "upsert_last"), "simple")
    exchange = p.index("Exchange hashpartitioning(publish_ym")
    assert p.index("partial_max_by") > exchange  # the partial aggregate sits below (after) the exchange line


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(q(spark, "fk_violations"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,P))" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in p


def test_bounded_dimension_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan(q(spark, "region_lookup"))


def test_containment_fallback_is_an_equi_join(spark):
    p = plan(q(spark, "fuzzy_key_match"))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_content_is_hashed_before_it_is_joined(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("hash_reconcile", "stats_memo"):
            exchanges = plan(q(spark, key)).split("Exchange\n")[1:]
            assert exchanges and not any("text#" in x.split("\n\n")[0] for x in exchanges)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_listing_never_reads_content(spark, tmp_dir):
    p = plan(zipcsv.list_files(spark, tmp_dir))
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in p


def test_hot_key_sequence_has_no_window_over_a_key(spark):
    """Sequences are written by range; what follows is a partial aggregate by session, and windows over a row for each range."""
    p = plan(q(spark, "debounce_last"), "simple")
    assert "partial_max_by" in p and "BroadcastHashJoin" in p
    assert "windowspecdefinition(user_id" not in p and "windowspecdefinition(_part" in p


def test_delete_aware_latest_fold_has_no_join(spark):
    from pyspark.sql import functions as F

    from dropledger.operators.changelog import fold_state
    log = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "d").otherwise("u").alias("op"),
        "o_orderpriority")
    p = plan(fold_state(log, ["o_custkey"], "o_orderkey", last=["o_orderpriority"], op="op"), "simple")
    assert "Join" not in p and "partial_max_by" in p


def test_mutations_read_their_log_once(spark):
    """The change log of files is three tables joined, that of tags two; one aggregate pass over it needs no further scan."""
    for key, scans in (("cascade_delete", 3), ("cascade_survivors", 3), ("file_detail", 3), ("delete_tombstone", 2), ("unassign", 2)):
        p = plan(q(spark, key), "simple")
        assert p.count("FileScan") <= scans, key
