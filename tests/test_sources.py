import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.sources import images as I
from pixelweave.sources import localizations as LF
from pixelweave.sources import tables as TB
from pixelweave.streaming import frames as S


def test_thunderstorm_and_native(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('"id","frame","x [nm]","y [nm]","intensity [photon]"\n1,1,1080.0,2160.0,500.0\n2,2,2160.0,3240.0,600.0\n')
    rows = LF.read_localizations(spark, str(p)).orderBy("frame").collect()
    assert [(r.frame, r.x, r.y) for r in rows] == [(0, 10.0, 20.0), (1, 20.0, 30.0)]
    assert LF.read_spt_csv(spark, str(p)).orderBy("id").first().track_id == -1
    n = tmp_path / "b.csv"
    n.write_text("frame,x,y,intensity\n0,10.5,20.3,500\n")
    assert LF.read_localizations(spark, str(n)).first().x == 10.5
    with pytest.raises(ValueError):
        LF.read_localizations(spark, str(n), pixel_size=0)
    bad = tmp_path / "c.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        LF.read_localizations(spark, str(bad))


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, float(i), float(i * 2), 1.5) for i in range(9)], "track_id long, frame long, x double, y double, intensity double")
    key = lambda d: sorted((r.frame, round(r.x, 9), round(r.y, 9), r.intensity) for r in d.collect())
    for fmt in ("native", "thunderstorm", "json"):
        path = str(tmp_path / fmt)
        LF.write_localizations(df, path, fmt)
        assert key(LF.read_localizations(spark, path, fmt)) == key(df)
    with pytest.raises(ValueError):
        LF.write_localizations(df.drop("x"), str(tmp_path / "z"))
    LF.write_points(df.select(F.col("frame").alias("t"), "x", "y"), str(tmp_path / "pts"))
    assert LF.read_points(spark, str(tmp_path / "pts")).count() == 9


def test_indexed_json_and_text(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"txy_pts": [[0, 1, 2], [1, 2, 3], [2, 3, 4]], "tracks": [[0, 1], [2], [9, 9]]}))
    assert [r.track_id for r in LF.read_spt_json(spark, str(p)).orderBy("id").collect()] == [0, 0, -1]
    t = tmp_path / "a.txt"
    t.write_text("0 1.0 2.0 5 3\n1\t2.0\t3.0\n")
    assert [(r.frame, r.intensity, r.track_id) for r in LF.read_spt_txt(spark, str(t)).orderBy("frame").collect()] == [(0, 5.0, 3), (1, 0.0, -1)]


def test_arrays_images_and_metadata(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", a)
    rows = I.read_npy(spark, str(tmp_path)).collect()
    assert {(r.frame, r.y, r.x): r.value for r in rows} == {(t, y, x): a[t, y, x] for t in range(2) for y in range(3) for x in range(4)}
    full, colour = I.axis_canonicalise(np.zeros((4, 5, 3)), "YXC")
    assert full.shape == (1, 1, 3, 4, 5) and colour
    text = spark.createDataFrame([('{"a": "1", "b": 2}',), ("x = 5\nname: cell\nflag",)], "t string")
    got = [r[0] for r in text.select(I.parse_metadata(F.col("t"))).collect()]
    assert got == [{"a": "1", "b": "2"}, {"x": "5", "name": "cell", "flag": ""}]
    # a 2 x 2 colour bitmap, bottom row first, B G R and two bytes of padding
    head = b"BM" + (70).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2
    head += (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    pix = bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    folder = tmp_path / "img"
    folder.mkdir()
    for name in ("0.bmp", "1.bmp"):
        (folder / name).write_bytes(head + pix)
    seq = I.read_image_sequence(spark, str(folder), "bmp").collect()
    assert {r.frame for r in seq} == {0, 1}
    assert {(r.c, r.y, r.x): r.value for r in seq if r.frame == 0}[(0, 0, 0)] == 9.0


def test_rois_counts_and_summary(spark, tmp_path):
    (tmp_path / "r.txt").write_text("rectangle\n1 2\n3.7 4\n\nline\n0 0\n5 5\n\n")
    rows = TB.read_rois(spark, str(tmp_path / "r.txt")).orderBy("roi", "pos").collect()
    assert [(r.kind, r.x, r.y) for r in rows] == [("rectangle", 1, 2), ("rectangle", 3, 4), ("line", 0, 0), ("line", 5, 5)]
    locs = spark.createDataFrame([("a", 0), ("a", 0), ("a", -1)], "file string, track_id long")
    err = spark.createDataFrame([("b", "broken")], "file string, error string")
    out = {r.file: r for r in TB.batch_summary(locs, err).collect()}
    assert out["a"].mean_track_length == 2.0 and abs(out["a"].linking_efficiency - 2 / 3) < 1e-12 and out["b"].error == "broken"


LINK = "source string, id long, frame long, x double, y double"


def linked(spark, tmp_path, batches, **options):
    for part, chunk in enumerate(batches):
        spark.createDataFrame(chunk, LINK).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(LINK).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.run_link(stream, str(tmp_path / "out"), 3.0, 1, **options)
    return {(r.source, r.id): r.track_id for r in spark.read.parquet(str(tmp_path / "out" / "out")).collect()}


def two_beads(frames):
    return [("s", i * 2 + k, i, 10.0 * k + i, 5.0) for i in frames for k in range(2)]


def batch_link(spark, rows):
    return {(r.source, r.id): r.track_id for r in S.link_batch(spark.createDataFrame(rows, LINK), 3.0, 1).collect()}


def test_stream_link_equals_the_batch_twin(spark, tmp_path):
    rows = [*two_beads([0, 1, 2, 4, 7, 8]), ("t", 1, 0, 0.0, 0.0), ("t", 2, 1, 0.5, 0.0)]
    want = batch_link(spark, rows)
    assert len(set(want.values())) == 4 and want["s", 0] == want["s", 8] != want["s", 14]  # a gap of one is bridged, of two not
    got = linked(spark, tmp_path, [rows[:6], rows[6:]], whole_frames=True)
    assert got == want


def test_stream_link_waits_for_the_rest_of_a_frame(spark, tmp_path):
    """Frame 3 comes in two batches: its two beads must not share a track, and frame 5 is still open at the end."""
    rows = two_beads(range(6))
    got = linked(spark, tmp_path, [rows[:7], rows[7:]])
    want = batch_link(spark, rows)
    assert got == {k: v for k, v in want.items() if k[1] < 10}
    assert got["s", 6] != got["s", 7]


def test_stream_link_marks_late_points(spark, tmp_path):
    rows = two_beads(range(6))
    got = linked(spark, tmp_path, [rows[:4], rows[4:8], [("s", 99, 1, 1.0, 5.0)], rows[8:]])
    assert got.pop(("s", 99)) == -1
    assert got == {k: v for k, v in batch_link(spark, rows).items() if k[1] < 10}


def test_stream_link_of_crowded_batches_equals_the_batch_twin(spark, tmp_path):
    """Tracks cross batches where points compete; gaps lie on the cut; rows without source or coordinates."""
    rng = np.random.default_rng(21)
    rows = [(s, 1000 * k + i, int(i // 12), float(x), float(y)) for k, s in enumerate("ab") for i, (x, y) in enumerate(rng.uniform(0, 14, size=(180, 2))) if i // 12 != 7]
    batches = [[r for r in rows if low <= r[2] < high] for low, high in ((0, 4), (4, 7), (7, 11), (11, 15))]
    want = batch_link(spark, rows)
    assert max(want.values()) < 120  # points are shared out among tracks
    batches[1] += [(None, 1, 5, 0.0, 0.0), ("a", 999, 5, None, 0.0)]
    got = linked(spark, tmp_path, batches, whole_frames=True)
    alone = got.pop(("a", 999))
    assert all(v != alone for k, v in got.items() if k[0] == "a")
    pairs = {(k[0], v, want[k]) for k, v in got.items()}  # the lone point takes a number, so numbers may differ by it
    assert set(got) == set(want) and len(pairs) == len({p[:2] for p in pairs}) == len({(k[0], w) for k, w in want.items()})


def test_late_rows_count_without_a_watermark(spark, tmp_path):
    rows = [("2024-01-01 00:00:30", "a", 1), ("2024-01-01 00:00:00", "a", 2)]
    for part, row in enumerate(rows):
        spark.createDataFrame([row], "ts string, source string, frame int").selectExpr("timestamp(ts) AS ts", "source", "frame").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema("ts timestamp, source string, frame int").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.run_available(S.fps(stream, None), str(tmp_path / "out"))
    assert S.newest(spark.read.parquet(str(tmp_path / "out" / "out")), ["source", "second"]).count() == 2


def test_json_of_both_forms_in_one_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"localizations": [{"frame": 0, "x": 1, "y": 2, "intensity": 3}]}\n{"localizations": [{"frame": 1, "x": 1, "y": 2, "intensity": 3}]}\n')
    (tmp_path / "b.json").write_text(json.dumps({"localizations": [{"frame": f, "x": 0, "y": 0, "intensity": 1} for f in (5, 6)]}, indent=1))
    assert sorted(r.frame for r in LF.read_locs_json(spark, str(tmp_path)).collect()) == [0, 1, 5, 6]


def test_a_long_track_is_one_document(spark, tmp_path):
    df = spark.range(25_000).selectExpr("1L AS track_id", "id AS frame", "0.0D AS x", "0.0D AS y", "1.0D AS intensity")
    assert LF.track_documents(df).count() == 1


def test_rois_of_an_image_are_one_file(spark, tmp_path):
    rows = [(i % 5, f"rectangle\n{i} 0\n{i + 1} 2\n") for i in range(60)]
    TB.write_rois(spark.createDataFrame(rows, "image_id int, text string").repartition(6), str(tmp_path / "rois"))
    assert len(list((tmp_path / "rois").rglob("*.txt"))) == 5
    got = TB.read_rois(spark, str(tmp_path / "rois")).where("pos = 0").collect()
    assert sorted((int(r.file.split("image_id=")[1].split("/")[0]), r.x) for r in got) == sorted((i % 5, i) for i in range(60))
