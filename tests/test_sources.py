import pytest
from pyspark.sql import functions as F

from tessera.sources import files


def test_scan_lists_one_level_by_name(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("b.JPG", "a.png", "c.txt", "sub/z.jpg"):
        (tmp_path / n).write_bytes(b"x")
    names = [r.name for r in files.scan_files(spark, [str(tmp_path)]).collect()]
    assert names == ["a.png", "b.JPG"]


def test_own_outputs_are_left_out(spark):
    cat = spark.createDataFrame([("p1", None), ("p2", "tessera"), ("p3", "camera"), ("p4", None)], "path string, producer string")
    manifest = spark.createDataFrame([("p4",)], "path string")
    assert {r.path for r in files.exclude_own(cat).collect()} == {"p1", "p3", "p4"}
    assert {r.path for r in files.exclude_own(cat, outputs=manifest).collect()} == {"p1", "p3"}


def test_groups_are_written_named_and_skipped_on_the_next_scan(spark, tmp_path):
    df = spark.createDataFrame([(7, 1.0), (9, 2.0), (9, 3.0)], "group_id long, v double")
    base = str(tmp_path / "out")
    manifest = files.write_groups(df, base, "pano.parquet")
    assert {r.group_id: r.output_name for r in manifest.collect()} == {7: "pano", 9: "pano.2"}
    back = spark.read.parquet(base)
    assert {(r.output_name, r.producer, r.v) for r in back.collect()} == {
        ("pano", "tessera", 1.0), ("pano.2", "tessera", 2.0), ("pano.2", "tessera", 3.0)}
    assert files.exclude_own(back).count() == 0


def test_rows_without_a_group_are_written_and_others_files_stay(spark, tmp_path):
    df = spark.createDataFrame([(None, 1.0), (3, 2.0)], "group_id long, v double")
    base = tmp_path / "out"
    (base / "output_name=older").mkdir(parents=True)
    (base / "output_name=older" / "note.txt").write_text("stays")
    manifest = files.write_groups(df, str(base), "pano")
    assert {r.group_id: r.output_name for r in manifest.collect()} == {None: "pano", 3: "pano.2"}
    back = spark.read.option("pathGlobFilter", "*.parquet").parquet(str(base))
    assert {(r.output_name, r.v) for r in back.collect()} == {("pano", 1.0), ("pano.2", 2.0)}
    assert (base / "output_name=older" / "note.txt").read_text() == "stays"


def test_catalog_is_normalised(spark):
    meta = spark.createDataFrame([(4000, 3000, 28.0, 32.1, 80.8, "N", "W"), (1000, 1500, None, 1.0, 2.0, "S", None)],
                                 "full_width int, full_height int, f35 double, lat double, lon double, lat_ref string, lon_ref string")
    a, b = files.normalize_catalog(meta, 2000).collect()
    assert (a.width, a.height, a.lat, a.lon) == (2000, 1500, 32.1, -80.8)
    assert a.focal == pytest.approx(28 / 36 * 2000)
    assert (b.width, b.height, b.lat, b.lon, b.focal) == (1000, 1500, -1.0, 2.0, pytest.approx(1350))


def test_intermediate_tables_go_to_the_configured_folder(spark):
    from tessera.session import checkpoint_dir, cut
    df = cut(spark.range(5).withColumn("v", F.col("id") * 2))
    assert all(checkpoint_dir(spark) in f for f in df.inputFiles()) and df.count() == 5
