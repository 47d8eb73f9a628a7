from histlake.llm import common


def test_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A_ int")
    assert common.unused(df, "a", "b", "b") == ["a__", "b", "b_"]


def test_staged_tables_and_their_end(spark):
    found = common.staged(spark.range(10), "t")
    assert found.count() == 10
    path = found.inputFiles()[0]
    assert path.startswith("file:") and "/histlake/t-" in path
    common.drop_scratch(spark)
    from pathlib import Path

    assert not Path(path.removeprefix("file://").removeprefix("file:")).exists()


def test_held_out_is_the_fixed_fold(spark):
    import zlib

    rows = spark.range(200).select("id", common.held_out(common.F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_scratch_of_other_applications_stays(spark):
    common.staged(spark.range(3), "mine")
    other = f"{common.shared_dir(spark)}/another/histlake/t"
    spark.range(3).write.mode("overwrite").parquet(other)
    common.drop_scratch(spark)
    assert spark.read.parquet(other).count() == 3


def test_rows_with_maps_are_hashed(spark):
    df = spark.sql("select 1 as a, map('k', 1) as m, array(map('x', 2)) as n union all select 1, map('k', 2), array(map('x', 2)) union all select 1, map('k', 1), array(map('x', 2))")
    assert df.select(common.row_hash(df).alias("h")).distinct().count() == 2
