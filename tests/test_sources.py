"""LAS round trips, drawings, and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import blocks, tiling
from strataspark.params import Params
from strataspark.sources import dxf, las, tables
from strataspark.streaming.ingest import classify_stream, remaining


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    rows = [(i + 1, float(x), float(y), float(z), i % 65536, 1 + i % 3, 2, i % 300, 5, 6, 7) for i, (x, y, z) in enumerate((rng.random((500, 3)) * 40).round(3))]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, intensity int, return_number int, classification int, red int, green int, blue int, nir int")


@pytest.mark.parametrize(("fmt", "version"), [(8, "1.4"), (7, "1.4"), (3, "1.2"), (0, "1.2")])
def test_las_round_trip(spark, cloud, tmp_path, fmt, version):
    las.register(spark)
    out = str(tmp_path / "las")
    cloud.coalesce(2).write.format("las").options(point_format=fmt, version=version).mode("append").save(out)
    back = spark.read.format("las").option("chunk", 100).load(out)
    key = lambda r: (round(r.x, 3), round(r.y, 3), round(r.z, 3), r.intensity, r.return_number, r.classification)
    assert sorted(map(key, back.collect())) == sorted(map(key, cloud.collect()))
    bands = [c for c in ("red", "nir") if back.where(F.col(c).isNotNull()).count()]
    assert bands == {8: ["red", "nir"], 7: ["red"], 3: ["red"], 0: []}[fmt]
    heads = spark.read.format("las_headers").load(out).agg(F.sum("n_points").alias("n"), F.min("xmin").alias("x")).first()
    assert heads.n == 500 and abs(heads.x - cloud.agg(F.min("x")).first()[0]) < 1e-9
    assert back.select(F.countDistinct("point_id")).first()[0] == 500


def test_bad_files(tmp_path):
    raw = bytearray(las.header_bytes(2, 0, 0, [1] * 3, [0] * 3, [0] * 6, [0] * 15))
    raw[104] = 0x80
    with pytest.raises(ValueError, match="compressed"):
        las.parse_header(bytes(raw), "x.laz")
    with pytest.raises(ValueError, match="not a LAS"):
        las.parse_header(b"nope" * 100, "x.las")
    with pytest.raises(FileNotFoundError):
        las.find(str(tmp_path / "none"))


def test_written_counts_must_agree(cloud, tmp_path):
    own = tiling.with_tile(cloud, 20.0)
    with pytest.raises(ValueError):
        tables.write_classified(own.limit(3), str(tmp_path / "p"), cloud)
    tables.write_classified(own, str(tmp_path / "p"), cloud)
    assert own.sparkSession.read.parquet(str(tmp_path / "p")).count() == 500


def test_drawings(spark, cloud):
    index = tiling.tile_index(tiling.with_tile(cloud, 20.0))
    text = dxf.tile_outlines(index.collect())
    assert text.count("LWPOLYLINE") == index.count() and text.endswith("0\nEOF\n")
    block = lambda name, w: f"0\nBLOCK\n2\n{name}\n0\nLINE\n10\n0.0\n20\n0.0\n11\n{w}\n21\n1.0\n0\nENDBLK\n"
    drawing = block("Tree", 2.0) + block("Tree_3", 6.0) + "0\nINSERT\n2\nTree_3\n41\n2.0\n10\n5.0\n0\nEOF\n"
    own, inserts = dxf.tables(spark, drawing)
    folds = {r.name: (r.base, r.ratio) for r in blocks.fold_blocks(own).collect()}
    assert folds == {"Tree_3": ("Tree", 3.0)} and inserts.first().xs == 2.0
    _, again = dxf.tables(spark, dxf.rewrite(drawing, folds))
    assert again.first().asDict() == {"container": "", "name": "Tree", "xs": 6.0, "ys": 3.0, "zs": 3.0}


def test_stream_and_resume(spark, cloud, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cloud.write.parquet(source)
    p = Params(tile_size=20.0, ground_method="grid", smooth_passes=1)
    classify_stream(spark, source, cloud.schema, out, str(tmp_path / "check"), p).awaitTermination()
    assert spark.read.parquet(f"{out}/points").count() == 500
    classify_stream(spark, source, cloud.schema, out, str(tmp_path / "check"), p).awaitTermination()
    assert spark.read.parquet(f"{out}/points").count() == 500
    tiles = tiling.tile_index(tiling.with_tile(cloud, 20.0))
    assert remaining(tiles, spark.read.parquet(f"{out}/tiles")).count() == 0


def test_writers_share_settings(spark):
    from strataspark import storage

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with storage.writing(spark), storage.writing(spark):
        assert spark.conf.get(key) == "2000"
    assert spark.conf.get(key) == before and not storage._WRITERS


def test_template_keeps_dimensions_and_records(spark, tmp_path):
    """A file with times, extra bytes and a variable-length record comes back byte for byte but for the classes."""
    rng = np.random.default_rng(4)
    kind = las.point_type(7, 40)
    raw_points = bytearray(rng.integers(0, 256, 300 * 40, dtype=np.uint8).tobytes())
    p = np.frombuffer(raw_points, kind)
    p["returns"], p["classification"] = 1, 1
    vlr = bytes(range(54)) + b"wkt!" * 5
    head = bytearray(las.header_bytes(4, 7, 300, [0.01] * 3, [100.0, 200.0, 0.0], [0] * 6, [300] + [0] * 14))
    head[96:100], head[100:104], head[105:107] = (len(head) + len(vlr)).to_bytes(4, "little"), (1).to_bytes(4, "little"), (40).to_bytes(2, "little")
    path = tmp_path / "in.las"
    path.write_bytes(bytes(head) + vlr + raw_points)
    points = tables.read_points(spark, str(path), record="true")
    out = str(tmp_path / "out")
    points.coalesce(1).withColumn("class", F.when(F.col("point_id") % 2 == 0, 20)).write.format("las").option("template", str(path)).mode("append").save(out)
    raw = open(las.find(out)[0], "rb").read()
    h = las.parse_header(raw, "x")
    assert (h.record, h.scales, h.offsets, h.count) == (40, (0.01,) * 3, (100.0, 200.0, 0.0), 300) and raw[h.size : h.offset] == vlr
    p["classification"][1::2] = 20
    assert raw[h.offset :] == bytes(raw_points) and abs(h.bounds[0] - (p["X"].max() * 0.01 + 100)) < 1e-6
    with pytest.raises(ValueError, match="record"):
        las._Writer({"path": out, "template": str(path)}, points.drop("record").schema)


def test_several_inputs(spark, cloud, tmp_path, capsys):
    """Ids don't meet, other point formats are skipped, files have a status each, and folders are known by their files."""
    from strataspark.__main__ import main

    las.register(spark)
    for name, fmt in (("a", 8), ("b", 8), ("c", 7)):
        cloud.coalesce(1).write.format("las").option("point_format", fmt).mode("append").save(str(tmp_path / name))
    paths = [str(tmp_path / n) for n in "abc"]
    clouds, formats = tables.read_all(spark, paths)
    assert formats == [8, 8, 7]
    merged, skipped = tiling.merge(clouds, formats)
    assert skipped == [2] and merged.select("point_id").distinct().count() == 1000
    common = ["--tile-size", "20", "--ground-method", "grid", "--smooth-passes", "1"]
    main(["classify", *paths, "--out", str(tmp_path / "one"), *common])
    assert "skipped" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "one" / "points")).groupBy("point_id").count().where("count > 1").isEmpty()
    (tmp_path / "bad").mkdir()
    spark.createDataFrame([(1, "x")], "point_id long, x string").write.parquet(str(tmp_path / "bad" / "p"))
    main(["batch", paths[0], str(tmp_path / "bad" / "p"), paths[2], "--out", str(tmp_path / "each"), *common])
    rows = spark.read.csv(str(tmp_path / "each" / "status"), header=True, inferSchema=True).orderBy("src_file").collect()
    assert [(r.status == "FAILED", r.n_points) for r in rows] == [(False, 500), (True, 0), (False, 500)]
