import base64
import json
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmill.operators import images as im
from maskmill.sources import tables as t


def test_manifest_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('sample_id,class_id,aspect_ratio,previous_names,extra\na,1,0.5,"x; ""y""",q\nb,not a number,,,\n')
    rows = t.read_manifest_csv(spark, path).orderBy("sample_id").collect()
    assert (rows[0].class_id, rows[0].aspect_ratio, rows[0].previous_names) == (1, 0.5, 'x; "y"') and rows[1].class_id is None and rows[0].fold is None
    assert "extra" not in rows[0].asDict() and len(rows[0]) == 41
    out = str(tmp_path / "out")
    t.write_csv(t.read_manifest_csv(spark, path), out, t.MANIFEST_COLUMNS)
    again = t.read_manifest_csv(spark, out).orderBy("sample_id").collect()
    assert again[0].previous_names == 'x; "y"' and again[0].asDict().keys() == rows[0].asDict().keys()
    with pytest.raises(Exception, match="already exists"):
        t.write_csv(t.read_manifest_csv(spark, path), out, t.MANIFEST_COLUMNS)


def test_rows_of_every_suffix(spark, tmp_path):
    rows = [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]
    for name, text in {"a.json": json.dumps(rows), "b.json": json.dumps({"samples": rows, "n": 2}), "c.json": json.dumps({"rows": rows}), "d.jsonl": "\n".join(map(json.dumps, rows)), "e.csv": "id,v\n1,a\n2,b\n"}.items():
        (tmp_path / name).write_text(text)
        got = t.read_rows(spark, str(tmp_path / name))
        assert sorted((int(r.id), r.v) for r in got.select("id", "v").collect()) == [(1, "a"), (2, "b")], name
    with pytest.raises(ValueError):
        t.read_rows(spark, "x.txt")


def test_reports_and_logs(spark, tmp_path):
    path = str(tmp_path / "r.json")
    t.write_json_report({"b": 1, "a": [1, None]}, path)
    assert open(path).read().index('"a"') < open(path).read().index('"b"')
    with pytest.raises(ValueError):
        t.write_json_report({"a": float("nan")}, path)
    assert json.load(open(path))["b"] == 1 and not os.path.exists(path + ".part")
    log = str(tmp_path / "log")
    for i in range(2):
        t.append_jsonl(spark.createDataFrame([(i,)], "epoch int"), log)
    assert sorted(r.epoch for r in spark.read.json(log).collect()) == [0, 1]
    t.write_probabilities(spark.createDataFrame([(0.5,)], "p double"), str(tmp_path / "p"), model="m1")
    assert spark.read.parquet(str(tmp_path / "p")).first().model == "m1"
    assert t.free_name(path).endswith("r.json_2") and t.finite(float("inf")) is None


def test_image_scan(spark, tmp_path):
    for folder in ("benign", "normal"):
        (tmp_path / folder).mkdir()
    image = np.arange(24, dtype=np.uint8).reshape(4, 6)
    for name in ("benign/benign (1).png", "benign/benign (1)_mask.png", "benign/benign (1)_mask_1.png", "normal/normal (2).png"):
        (tmp_path / name).write_bytes(im.encode_png(image))
    (tmp_path / "normal/readme.txt").write_text("x")
    files = t.scan_images(spark, str(tmp_path))
    got = {r.file_name: r for r in t.with_masks(files).collect()}
    assert set(got) == {"benign (1).png", "normal (2).png"} and len(got["benign (1).png"].mask_paths) == 2 and got["normal (2).png"].mask_paths == []
    assert np.array_equal(im.decode_png(bytes(got["benign (1).png"].content)), image)
    pairs, alone = t.paired(files.filter("NOT is_mask"), files.filter("file_name = 'normal (2).png'"))
    assert pairs.count() == 1 and alone.count() == 1


def test_png_filters():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    lines, above = b"", np.zeros(7, int)
    for kind, row in enumerate(image.astype(int)):
        left, corner = np.r_[0, row[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        near = np.array([min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2] for q, a, b, c in zip(p, left, above, corner)])
        guess = [np.zeros(7, int), left, above, (left + above) >> 1, near][kind]
        lines += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    png = im.encode_png(image)
    at = png.index(b"IDAT")
    body = zlib.compress(lines)
    made = png[: at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + b"\0\0\0\0" + png[-12:]
    assert np.array_equal(im.decode_png(made), image)
    for bad in (b"", b"GIF89a", png[:40]):
        with pytest.raises(ValueError):
            im.decode_png(bad)


def test_components_against_flood_fill():
    rng = random.Random(5)
    for _ in range(30):
        mask = np.array([[rng.random() < 0.45 for _ in range(12)] for _ in range(9)], np.uint8)
        seen, n = np.zeros(mask.shape, int), 0
        for y in range(9):
            for x in range(12):
                if mask[y, x] and not seen[y, x]:
                    n += 1
                    stack = [(y, x)]
                    while stack:
                        a, b = stack.pop()
                        if 0 <= a < 9 and 0 <= b < 12 and mask[a, b] and not seen[a, b]:
                            seen[a, b] = n
                            stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert np.array_equal(im.components(mask), seen)
    assert im.geometry(np.zeros((3, 3))) == {"lesion_pixels": 0, "connected_components": 0, "box": None}


def test_resize_and_shapes():
    image = np.arange(16.0).reshape(4, 4)
    assert np.allclose(im.resize_area(image, 2, 2), [[2.5, 4.5], [10.5, 12.5]]) and np.allclose(im.resize_area(image, 3, 3).mean(), image.mean())
    assert np.array_equal(im.resize_nearest(image, 2, 2), image[::2, ::2]) and np.allclose(im.resize_linear(image, 4, 4), image)
    out, mask, box = im.fit_square(np.ones((4, 8)), np.ones((4, 8), np.uint8), 8)
    assert box == {"height": 4, "width": 8, "top": 2, "left": 0} and mask.sum() == 32 and out[0].sum() == 0
    assert im.fit_square(image, image > 3, 6, False)[0].shape == (6, 6)
    assert abs(np.linalg.norm(im.thumbnail(image, 4)) - 1) < 1e-6 and not im.thumbnail(np.ones((4, 4)), 4).any()
    dark = np.full((30, 30), 10, np.uint8)
    dark[5:15, 8:20] = 200
    assert 10 <= im.otsu(dark) < 200 and im.largest_part_box(dark, 2) == (6, 3, 16, 14)


def test_annotation_objects(spark):
    canvas = np.zeros((10, 10), bool)
    bitmap = np.ones((3, 4), np.uint8) * 255
    data = base64.b64encode(zlib.compress(im.encode_png(bitmap))).decode()
    im.draw_object(canvas, {"geometryType": "bitmap", "bitmap": {"data": data, "origin": [8, 8]}})
    assert canvas.sum() == 4
    im.draw_object(canvas, {"geometryType": "rectangle", "points": {"exterior": [[0, 0], [2, 1]], "interior": []}})
    assert canvas[:2, :3].all() and canvas.sum() == 10
    ring = np.zeros((10, 10), bool)
    im.fill_polygon(ring, [[1, 1], [8, 1], [8, 8], [1, 8]], [[[3, 3], [6, 3], [6, 6], [3, 6]]])
    assert ring.sum() == 64 - 9 and not ring[4, 4]
    with pytest.raises(ValueError):
        im.decode_bitmap("!!")
    doc = json.dumps({"tags": [{"name": "Malignant", "value": None}], "objects": [{"geometryType": "bitmap", "bitmap": {"data": "x", "origin": [1, 2]}}, {"geometryType": "polygon"}]})
    df = spark.createDataFrame([("a", doc), ("b", '{"objects": ['), ("c", None)], "id string, text string")
    rows = t.annotations(df, "text").collect()
    assert [(r.id, r.object_no) for r in rows if r.object_no is not None] == [("a", 0), ("a", 1)]
    assert "Malignant" in t.annotations(df, "text").filter("id = 'a'").select(t.tag_text(F.col("tags"))).first()[0]


def test_surface_distances_against_brute_force(spark):
    rng = np.random.default_rng(2)
    for _ in range(10):
        a, b = rng.random((7, 8)) < 0.4, rng.random((7, 8)) < 0.4

        def edge(m):
            return [(y, x) for y, x in np.argwhere(m) if any(not (0 <= y + i < 7 and 0 <= x + j < 8 and m[y + i, x + j]) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))]

        ea, eb = edge(a), edge(b)
        d = [min(np.hypot(y - v, x - u) for v, u in eb) for y, x in ea] + [min(np.hypot(y - v, x - u) for v, u in ea) for y, x in eb]
        assert im.surface_distances(a, b) == (pytest.approx(np.percentile(d, 95)), pytest.approx(np.mean(d)))
    assert im.surface_distances(a, a & False) == (None, None)
    m = np.eye(3, dtype=np.uint8).tobytes()
    df = spark.createDataFrame([("a", 3, 3, m, m), ("b", 3, 3, m, None)], "id string, h int, w int, x binary, y binary")
    assert {r.id: r.hd95 for r in im.surface_table(df, "id", "h", "w", "x", "y").collect()} == {"a": 0.0, "b": None}
    masks = spark.createDataFrame([("a", 0, 0, 0), ("a", 0, 0, 255), ("a", 0, 1, 0)], "id string, y int, x int, value int")
    assert sorted(tuple(r)[1:] for r in im.union_masks(masks, "id").collect()) == [(0, 0, 1), (0, 1, 0)]


def test_parts_by_runs_against_flood_fill():
    rng = np.random.default_rng(1)
    for h, w, p in ((1, 1, 0.5), (7, 9, 0.4), (30, 40, 0.3), (40, 30, 0.55), (5, 200, 0.5), (3, 3, 0.0), (4, 4, 1.0)):
        mask = rng.random((h, w)) < p
        want, n = np.zeros((h, w), int), 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if not want[y, x]:
                n += 1
                stack = [(y, x)]
                want[y, x] = n
                while stack:
                    cy, cx = stack.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            ny, nx = cy + dy, cx + dx
                            if 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and not want[ny, nx]:
                                want[ny, nx] = n
                                stack.append((ny, nx))
        assert np.array_equal(im.components(mask), want)


def test_fitted_masks_and_merged_masks():
    mask = np.zeros((30, 60), np.uint8)
    mask[10:20, 20:40] = 1
    _, seen, place = im.fit_square(mask * 9, mask, 20)
    assert np.array_equal(im.fit_mask(mask, 20), seen) and (place["height"], place["width"]) == (10, 20)
    assert im.fit_mask(mask, 15, keep_aspect=False).shape == (15, 15)
    good, other = im.encode_png(mask), im.encode_png(mask[:, 1:])
    union, notes = im.merge_masks([good, other, b"no picture", None, im.encode_png(np.roll(mask, 5, axis=1))], (30, 60))
    assert union.sum() == 10 * 25 and notes == ["mask_1_shape_mismatch", "mask_2_unreadable", "mask_3_unreadable"]


def test_samples_are_read_through_the_manifest(spark, tmp_path):
    """Files written by ``materialize`` and read back with every kind of fault."""
    mask = np.zeros((6, 8), np.uint8)
    mask[1:4, 2:6] = 1
    image = im.encode_png(np.full((6, 8), 5, np.uint8))
    files = [("images/ok.png", image), ("masks/ok.png", im.encode_png(mask * 2)), ("images/foreign.png", image), ("masks/foreign.png", im.encode_png(mask)), ("images/narrow.png", image), ("masks/narrow.png", im.encode_png(mask[:, 1:])), ("images/broken.png", b"x"), ("masks/broken.png", im.encode_png(mask)), ("images/alone.png", image), ("images/empty.png", image), ("masks/empty.png", im.encode_png(mask * 0))]
    root = str(tmp_path / "set")
    t.materialize(spark.createDataFrame(files, "path string, content binary").repartition(3), root)
    with pytest.raises(FileExistsError):
        t.materialize(spark.createDataFrame(files, "path string, content binary"), root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring(F.substring_index("path", "/set/", -1), 1, 100).alias("path"), "content")
    rows = [(k, 2, f"images/{k}.png", f"masks/{k}.png") for k in ("ok", "foreign", "narrow", "broken", "alone", "empty", "gone")] + [(None, None, None, None)]
    manifest = spark.createDataFrame(rows, "sample_id string, class_id int, image_path string, mask_path string")
    got = {r.sample_id: (r.height, r.lesion_pixels, r.problem) for r in im.checked_samples(manifest, read).collect()}
    assert got == {"ok": (6, 12, None), "foreign": (6, 12, "foreign_label"), "narrow": (6, None, "shape_mismatch"), "broken": (None, None, "unreadable_image"), "alone": (6, None, "missing_mask"), "empty": (6, 0, "empty_lesion"), "gone": (None, None, "missing_image"), None: (None, None, "missing_image")}


def test_earlier_trees_and_provenance(spark, tmp_path):
    picture = im.encode_png(np.arange(12, dtype=np.uint8).reshape(3, 4))
    files = spark.createDataFrame([("/d/train/images/a.png", picture), ("/d/test/images/b.png", picture), ("/d/test/masks/b.png", picture), ("/d/val/images/c.png", b"no")], "path string, content binary")
    got = sorted((r.split, r["name"]) for r in im.prior_members(files).collect())
    assert got == [("test", "b.png"), ("train", "a.png")] and im.prior_members(files).select("digest").distinct().count() == 1
    path = str(tmp_path / "p")
    t.write_probabilities(spark.createDataFrame([(0.5,)], "p double"), path, model="m1", fold="2")
    assert t.read_probabilities(spark, path, model="m1").count() == 1
    for bad in ({"model": "m2"}, {"seed": "1"}):
        with pytest.raises(ValueError):
            t.read_probabilities(spark, path, **bad)
