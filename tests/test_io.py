"""Sources and sinks: path resolution, checked scan, CSV metadata, sinks, append log, model store."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidepanel.sources import panel as PN
from tidepanel.sources.fixtures import load_tags, panel_path


def test_resolve_and_scan(spark):
    p = panel_path(spark, SF_SMALL)
    path, recursive = PN.resolve_scan_path(p)
    assert path == p and recursive is False
    df = PN.read_panel(spark, p, ["time_id", "symbol_id", "responder_6"], 10, 20)
    assert "date_id" not in df.columns  # bounds work without projecting the date column
    assert df.count() == spark.read.parquet(p).where("date_id BETWEEN 10 AND 20").count()
    with pytest.raises(ValueError):
        PN.read_panel(spark, p, ["nope"])
    with pytest.raises(FileNotFoundError):
        PN.resolve_scan_path("/nonexistent/panel")


def test_nested_partition_dir_drops_hive_column(spark, small_panel):
    d = tempfile.mkdtemp(prefix="tp-nested-")
    small_panel.withColumn("partition_id", F.col("date_id") % 2).write.partitionBy("partition_id").parquet(
        os.path.join(d, "train.parquet"))
    path, recursive = PN.resolve_scan_path(os.path.join(d, "train.parquet"))
    assert recursive
    df = PN.read_panel(spark, path, ["date_id", "symbol_id"])
    assert df.columns == ["date_id", "symbol_id"] and df.count() == small_panel.count()


def test_metadata_csv_and_csv_sink(spark):
    d = tempfile.mkdtemp(prefix="tp-csv-")
    out = os.path.join(d, "tags_csv")
    PN.write_table(load_tags(spark, SF_SMALL).withColumnRenamed("p_partkey", "feature"), out, fmt="csv",
                   single_file=True)
    csv = [f for f in os.listdir(out) if f.endswith(".csv")][0]
    tags = PN.read_metadata_csv(spark, os.path.join(out, csv), "feature")
    assert dict(tags.dtypes)["tag_0"] == "boolean"
    assert tags.count() == load_tags(spark, SF_SMALL).count()


def test_append_log_is_idempotent(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="tp-log-"), "runs")
    rows = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2)], "cell string, seed int, score double")
    PN.append_run_rows(rows, d, ["cell", "seed"])
    again = spark.createDataFrame([("a", 2, 0.2), ("b", 1, 0.3)], "cell string, seed int, score double")
    log = PN.append_run_rows(again, d, ["cell", "seed"])
    assert log.count() == 3


def test_extract_slice_guard(spark, small_panel):
    out = os.path.join(tempfile.mkdtemp(prefix="tp-slice-"), "s")
    st = PN.extract_slice(small_panel, out, 5, 9).first()
    assert (st["date_min"], st["date_max"]) == (5, 9)
    with pytest.raises(Exception):
        PN.extract_slice(small_panel, out, 5, 9)
    assert PN.extract_slice(small_panel, out, 5, 6, overwrite=True).first()["date_max"] == 6


def test_model_store_round_trip(spark, small_panel):
    from tidepanel.plans import gbt as G
    feats = ["feature_00", "feature_02", "feature_03"]
    m = G.fit(small_panel.where("date_id < 40"), feats, G.GBTParams(max_iter=3, max_depth=2, max_bins=8))
    m = G.refit(m, small_panel.where("date_id BETWEEN 40 AND 50"), 0.5)
    d = os.path.join(tempfile.mkdtemp(prefix="tp-model-"), "m")
    G.save(m, d)
    m2 = G.load(d)
    test = small_panel.where("date_id > 60")
    a = G.predict(m, test).agg(F.sum("prediction")).first()[0]
    b = G.predict(m2, test).agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(b, rel=1e-12)


def test_size_shuffles(spark):
    from tidepanel.session import size_shuffles
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 100 * (1 << 40)) == 100 * (1 << 40) // (256 << 20)
        assert size_shuffles(spark, 1000) == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))


def test_footer_probe_reads_no_column(spark, small_panel):
    path = os.path.join(tempfile.mkdtemp(prefix="tp-probe-"), "t")
    small_panel.select("date_id", "time_id", "symbol_id", "feature_00").repartition(5).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    for column in ("date_id", "time_id", "feature_00"):
        got = PN.footer_probe(spark, path, column).first()
        want = small_panel.agg(F.min(column), F.max(column), F.count("*")).first()
        assert tuple(got) == tuple(want)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    with pytest.raises(Exception):
        PN.footer_probe(spark, path, "no_such_column")
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    small_panel.limit(0).select("date_id").write.parquet(path + "0")
    assert tuple(PN.footer_probe(spark, path + "0").first()) == (None, None, 0)
