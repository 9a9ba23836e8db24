from inkwell.session import apply_cluster_defaults, checkpoint_dir, written_table


def test_cluster_defaults_keep_user_settings(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    apply_cluster_defaults(spark)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") in (str(64 * 1024 * 1024), "67108864b")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_written_table_round_trip(spark):
    df = spark.range(0, 1000).selectExpr("id", "id % 7 as k")
    out = written_table(df, "test")
    assert out.count() == 1000 and sorted(out.columns) == ["id", "k"]
    root = checkpoint_dir(spark)
    tail = root.split(":", 1)[-1].lstrip("/")          # file:/x and file:///x name the same folder
    assert root and all(tail in f for f in out.inputFiles())
