"""Raster primitives with known answers, and the pass over images drawn by the test."""

import struct
import zlib

import numpy as np
import pytest

from mintlens.pixels import filters as f
from mintlens.pixels import measure


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def card(h=420, w=320, box=(60, 60, 360, 274), angle=0.0):
    """A light card with a frame on a dark background; box is (top, left, bottom, right)."""
    y, x = np.mgrid[:h, :w].astype(float)
    cy, cx = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    a = np.deg2rad(angle)
    u, v = (x - cx) * np.cos(a) + (y - cy) * np.sin(a), -(x - cx) * np.sin(a) + (y - cy) * np.cos(a)
    inside = (np.abs(u) <= (box[3] - box[1]) / 2) & (np.abs(v) <= (box[2] - box[0]) / 2)
    inner = (np.abs(u) <= (box[3] - box[1]) / 2 - 15) & (np.abs(v) <= (box[2] - box[0]) / 2 - 15)
    image = np.full((h, w, 3), 30, np.uint8)
    image[inside] = (220, 220, 210)
    image[inner] = (150, 160, 190)
    return image


def test_solid_gradient_and_checkerboard(spark):
    from mintlens.operators import parts

    solid = np.full((40, 50, 3), 90, np.uint8)
    ramp = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 20, 0).repeat(3, 2)
    noise = np.random.default_rng(4).integers(0, 256, (90, 70, 3)).astype(np.uint8)
    pictures = {"solid": solid, "ramp": ramp, "noise": noise}
    df = spark.createDataFrame([(n, [tuple(r.values()) for r in measure.parts(a)]) for n, a in pictures.items()] + [("none", None)], f"name string, parts array<{parts.PART}>")
    rows = {(r.name, r.family, r.part): r for r in parts.long_table(df).collect()}
    assert len(rows) == 27 and [k[1:] for k in rows if k[0] == "solid"] == list(parts.PARTS)
    whole = rows["solid", "visual", "whole"]
    assert whole.roughness == 0 and whole.std_intensity == 0 and whole.mean_intensity == 90 and rows["ramp", "visual", "whole"].mean_intensity == 127.5
    g = f.grey(noise)
    for side, band in measure.side_bands(g).items():
        a, r = f.blur(band, 3).astype(float), rows["noise", "edge", side]
        profile = a.mean(axis=0 if side in ("top", "bottom") else 1)
        off = np.abs(profile - np.convolve(profile, np.full(11, 1 / 11), "same"))
        want = (a.mean(), a.std(), (a > a.mean() + max(10, 1.2 * a.std())).mean(), np.diff(profile).std(), (off > max(6.0, 1.5 * off.std())).mean(), len(profile))
        assert (r.mean_intensity, r.std_intensity, r.highlight_ratio, r.roughness, r.anomaly_ratio, r.profile_length) == pytest.approx(want)
    for name, patch in measure.corner_patches(g).items():
        a, r = f.blur(patch, 3), rows["noise", "corner", name]
        assert (r.mean_intensity, r.std_intensity, r.roughness) == pytest.approx((a.mean(), a.std(), f.laplacian(a).var())) and r.anomaly_ratio is None
    board = (np.indices((64, 64)).sum(axis=0) // 8 % 2 * 255).astype(np.uint8)
    assert f.laplacian(board).var() > 1000


def test_filters():
    a = np.random.default_rng(1).integers(0, 256, (30, 40)).astype(np.uint8)
    assert np.allclose(f.gaussian_kernel(5).sum(), 1) and abs(float(f.blur(a, 5).mean()) - a.mean()) < 3
    ramp = np.repeat(np.arange(40.0)[None], 30, 0)
    assert (f.sobel(ramp, 1)[:, 1:-1] == 8).all() and (f.sobel(ramp, 0) == 0).all()
    m = np.zeros((20, 20), bool)
    m[5:15, 5:15] = True
    m[2, 2] = True
    assert f.opened(m).sum() == 100 and f.closed(m, 3)[5:15, 5:15].all() and f.erode(m).sum() == 64
    labels = f.components(m)
    assert labels.max() == 2 and (labels > 0).sum() == 101
    u = np.zeros((9, 9), bool)
    u[1:8, 1] = u[1:8, 7] = u[7, 1:8] = True
    assert f.components(u).max() == 1
    assert f.otsu(np.array([[10] * 50 + [200] * 50], np.uint8)) in range(10, 200)


def test_geometry():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert f.polygon_area(square) == 100
    inside = np.concatenate([square, [[5, 5], [1, 2]]])
    assert len(f.hull(inside)) == 4
    turned = square @ np.array([[0.8, 0.6], [-0.6, 0.8]])
    assert f.polygon_area(f.least_rectangle(turned)) == pytest.approx(100)
    assert (f.ordered(square[[2, 0, 3, 1]]) == square).all()
    m = f.perspective(square, square * 2)
    assert m @ [5, 5, 1] == pytest.approx([10, 10, 1])
    image = np.random.default_rng(2).integers(0, 256, (12, 12, 3)).astype(np.uint8)
    assert (f.warped(image, np.eye(3), 12, 12) == image).all()


RASTERS = "path string, height int, width int, nChannels int, data binary"


def frame(spark, images):
    return spark.createDataFrame([(name, *a.shape, a.tobytes()) for name, a in images.items()], RASTERS)


def corners(angle):
    a, c, s = np.deg2rad(angle), (167, 210), (107, 150)
    return np.array([[c[0] + x * s[0] * np.cos(a) - y * s[1] * np.sin(a), c[1] + x * s[0] * np.sin(a) + y * s[1] * np.cos(a)] for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def busy(angle, seed):
    """A card before stripes and noise."""
    y, x = np.mgrid[:420, :320]
    back = np.clip(60 + 25 * np.sin(x / 9.0) + 20 * np.sin(y / 7.0 + x / 23.0) + np.random.default_rng(seed).normal(0, 8, (420, 320)), 0, 255).astype(np.uint8)
    image, front = np.repeat(back[:, :, None], 3, 2), card(angle=angle)
    inside = (front != 30).any(axis=2)
    image[inside] = front[inside]
    return image


def test_detector_finds_the_corners(spark, monkeypatch):
    from mintlens.operators import images

    drawn = {f"{kind}{angle}": (kind, angle) for kind in ("plain", "busy") for angle in (0, 4, 10)}
    pictures = {name: card(angle=angle) if kind == "plain" else busy(angle, angle + 1) for name, (kind, angle) in drawn.items()}
    pictures["flat"] = np.full((420, 320, 3), 90, np.uint8)
    for trust, again in ((images.LOOK_AGAIN, 0), (1.01, 6)):  # the second time no first look is trusted
        monkeypatch.setattr(images, "LOOK_AGAIN", trust)
        got = {r.path: r for r in images.detected(frame(spark, pictures)).select("path", "stage", "quad", "detection").collect()}
        for name, (_, angle) in drawn.items():
            assert np.abs(np.array(got[name].quad).reshape(4, 2) - corners(angle)).max() <= 3 and not got[name].detection.used_fallback and got[name].detection.candidates >= 3
        assert sum(r.detection.second_look for r in got.values()) == again
        assert got["flat"].detection.used_fallback == 1 and got["flat"].detection.candidates == 0
    none = {r.path: r for r in images.detected(frame(spark, pictures), fallback=False).select("path", "stage", "quad").collect()}
    assert none["flat"].stage == "detection_failed" and none["flat"].quad is None and none["plain0"].stage is None


def test_every_stage_has_its_name(spark):
    from mintlens.operators.images import _measure
    from mintlens.operators.rules import stage_status
    from pyspark.sql import functions as F

    import pyarrow as pa

    a = card()
    row = {"path": "x", "height": 420, "width": 320, "nChannels": 3, "data": pa.scalar(a.tobytes(), pa.binary()), "stage": None, "error": None}
    quad = lambda q: row | {"quad": np.asarray(q, float).ravel().tolist()}
    assert _measure(quad(corners(0)))["stage"] == "done"
    assert _measure(quad([[5, 5]] * 4))["stage"] == "warp_failed"
    assert _measure(row | {"stage": "read_error"})["height"] is None
    names = ["read_error", "detection_failed", "warp_failed", "features_failed", "exception", "done"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "stage string").select(stage_status("stage")).collect()]
    assert got == ["not_evaluated", "invalid_detection", "warp_failed", "features_not_available", "exception", None]


def test_measuring_that_fails_is_told_apart(monkeypatch):
    monkeypatch.setattr(measure, "centering", lambda card: (_ for _ in ()).throw(ValueError("no rows")))
    stage, error, found = measure.analyse(card(), corners(0))
    assert stage == "features_failed" and "no rows" in error and set(found) == {"geometry"}


def test_second_look_is_judged_on_the_whole_raster():
    image = busy(4, 2)
    rows = measure.seen_again(image, [20, 20, 310, 400])
    assert rows and all(r["source"].startswith("second_") for r in rows)
    best = min(rows, key=lambda r: abs(r["tl_x"] - corners(4)[0][0]) + abs(r["tl_y"] - corners(4)[0][1]))
    assert abs(best["br_x"] - corners(4)[2][0]) < 4 and len(best["near_left"]) == len(best["deep_left"]) >= 28
    assert measure.seen_again(image, [0, 0, 20, 20]) == []


def test_candidates_as_rows_and_as_arrays_rank_alike(spark):
    from mintlens.operators import detection
    from pyspark.sql import functions as F

    seen = measure.seen(busy(10, 5))
    rows = [(k, n, *(c.get(f.split(" ")[0]) for f in detection.CANDIDATE.split(", "))) for k in range(3) for n, c in enumerate(seen["pool"][k:] + seen["pool"][k : k + 1] if k < 2 else [])]
    df = spark.createDataFrame(rows, f"image int, n int, {detection.CANDIDATE}")
    size = (F.lit(seen["small_width"]), F.lit(seen["small_height"]))
    box = F.array(*(F.lit(v) for v in (30.0, 40.0, 305.0, 380.0)))
    for outer in (None, box):
        won = {r.image: r for r in detection.winners(detection.ranked(df, *size, outer), "image", "n").collect()}
        pool = df.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("n", *(f.split(" ")[0] for f in detection.CANDIDATE.split(", "))))).alias("p"))
        fields = ["n", *(f.split(" ")[0] for f in detection.CANDIDATE.split(", "))]
        within = pool.withColumn("r", detection.ranked_pool(F.col("p"), fields, *size, outer))
        for r in within.select("image", *(c.alias(n) for n, c in detection.winner(F.col("r")).items())).collect():
            w = won[r.image]
            assert (r.winner.n, r.offered, r.competing) == (w.winner.n, w.pool, w.competing) and r.winner.score == pytest.approx(w.winner.score) and w.winner.score > 0.5
        assert won[0].pool == len({tuple(round(c[p], 1) for p in detection.POINTS) for c in seen["pool"]})


def test_rasters_opened_by_boxes():
    rng = np.random.default_rng(3)
    m = rng.random((60, 70)) < 0.8
    for h, w in ((3, 3), (1, 15), (15, 3)):
        pad = np.pad(m, ((h // 2, h // 2), (w // 2, w // 2)), constant_values=True)
        eroded = np.lib.stride_tricks.sliding_window_view(pad, (h, w)).all(axis=(2, 3))
        back = np.pad(eroded, ((h // 2, h // 2), (w // 2, w // 2)))
        assert (f.opened_box(m, h, w) == np.lib.stride_tricks.sliding_window_view(back, (h, w)).any(axis=(2, 3))).all()
    assert np.allclose(f.lab(np.array([[255, 255, 255], [0, 0, 0], [0, 0, 255]])), [[255, 128, 128], [0, 128, 128], [136, 208, 195]], atol=1.5)


def test_images_become_rows(spark, tmp_path):
    from mintlens.operators.images import dataset
    from mintlens.schema import MODEL_FEATURES
    from mintlens.sources.images import index, scan

    root = tmp_path / "raw"
    for folder in ("damaged", "Clean"):
        (root / folder).mkdir(parents=True)
    png(root / "damaged" / "a.PNG", card())
    png(root / "Clean" / "b.png", card(angle=5))
    png(root / "Clean" / "flat.png", np.full((90, 70, 3), 128, np.uint8))
    png(root / "free.png", card())
    (root / "Clean" / "broken.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (root / "Clean" / "notes.txt").write_text("no image")
    assert index(spark, str(root)).count() == 5
    rows = {r.image_filename: r for r in dataset(scan(spark, str(root))).collect()}
    assert set(rows) == {"a.PNG", "b.png", "flat.png", "free.png", "broken.jpg"}
    a = rows["a.PNG"]
    assert a.label_condition == "damaged" and a.target_damaged == 1 and rows["b.png"].target_damaged == 0 and rows["free.png"].label_condition == "unknown"
    assert a.pipeline_stage == "done" and a.procesado_exito and 1 <= a.score_condition_v4 <= 10 and a.geometry_coverage_ratio == pytest.approx(214 * 300 / 320 / 420, abs=0.03)
    assert rows["broken.jpg"].analysis_status == "not_evaluated" and rows["broken.jpg"].image_height is None
    flat = rows["flat.png"]  # nothing stands out: a centred box is measured, which can't make a valid capture
    assert flat.pipeline_stage == "done" and flat.analysis_status == "invalid_capture" and "fallback_detection" in flat.invalid_reasons and flat.detection_used_fallback == 1
    assert flat.geometry_coverage_ratio == pytest.approx(0.42, abs=0.05) and flat.capture_assessment == "deficiente" and flat.capture_message.startswith("La detección")
    assert a.borde_edge_label in ("good", "acceptable", "weak", "poor") and a.esquina_corner_label in ("good", "acceptable", "weak", "poor")
    strict = dataset(scan(spark, str(root)), fallback=False)
    plan = strict._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("BatchScan") == 1  # one decode
    rows = {r.image_filename: r for r in strict.collect()}
    assert rows["flat.png"].analysis_status == "invalid_detection" and rows["flat.png"].score_condition_v4 is None
    missing = [c for c in MODEL_FEATURES if c not in a.asDict()]
    assert len(MODEL_FEATURES) == 133 and not missing and all(a[c] is not None for c in MODEL_FEATURES)
    mix = 0.50 * a.score_capture_blur_component + 0.25 * a.score_capture_brightness_component + 0.25 * a.score_capture_contrast_component
    assert a.score_capture == pytest.approx(1 + 9 * mix, abs=0.02) and a.score_ws == pytest.approx(1 + 9 * a.score_ws_adjusted_component, abs=0.02)
    assert rows["flat.png"].score_edge_edge_component is None


def test_one_failing_image_leaves_the_others(spark):
    from mintlens.operators.images import measured

    good = card()
    rows = [("x", 420, 320, 3, good.tobytes()), ("y", 5, 5, 2, b"12"), ("z", 3, 3, 3, good[:1, :3].tobytes())]
    got = {r.origin: r for r in measured(spark.createDataFrame(rows, "path string, height int, width int, nChannels int, data binary")).collect()}
    assert got["x"].stage == "done" and got["y"].stage == "exception" and "ValueError" in got["y"].error and got["z"].stage == "exception"


def test_card_payloads(spark):
    from mintlens.sources.images import cards

    texts = ['{"id": "1", "name": "A", "set": {"id": "s", "name": "Set"}, "localId": "7", "types": ["Fire"], "hp": 60, "image": {"high": "u"}, "pricing": {"x": 1}}', '[{"id": "2", "setName": "T", "cardNumber": 9, "type": "Water", "image": "v"}, 5]', '{"data": [{"id": "3"}]}', "no json", None]
    got = {r.id: r for r in cards(spark.createDataFrame([(t,) for t in texts], "payload string")).collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"].set_name, got["1"].number, got["1"].type, got["1"].hp, got["1"].image, got["1"].prices) == ("Set", "7", "Fire", 60, "u", '{"x":1}')
    assert (got["2"].set_name, got["2"].number, got["2"].type, got["2"].image) == ("T", "9", "Water", "v")


def test_repeated_paths_keep_their_rows_and_batches_stay_small(spark):
    from mintlens.operators.images import measured

    data = card().tobytes()
    rows = spark.createDataFrame([("p", 420, 320, 3, data, k, None) for k in range(5)] + [(None, None, None, None, None, 9, "x")], "path string, height int, width int, nChannels int, data binary, origin int, note string").coalesce(1)
    got = measured(rows.withColumnRenamed("origin", "k"), rows_a_batch=2, keep=("k", "note")).select("k", "note", "origin", "stage", "detection.best_score").collect()
    assert sorted((r.k, r.note, r.origin, r.stage) for r in got) == [(k, None, "p", "done") for k in range(5)] + [(9, "x", None, "read_error")]
    assert measured(rows.where("false").withColumnRenamed("origin", "k")).count() == 0


def test_sizes():
    ramp = np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], 80, 0).repeat(3, 2)
    big = f.at_least(ramp, 160)
    assert big.shape == (160, 200, 3) and np.abs(np.diff(big[:, 8:-8, 0].astype(int), axis=1) - 1).max() <= 1 and f.at_least(ramp, 80) is ramp
    assert f.enlarged(np.full((5, 7), 90, np.uint8), 20, 30).tolist() == [[90] * 30] * 20
    assert f.at_most(ramp, 50).shape == (40, 50, 3) and f.at_most(ramp, 100) is ramp and f.at_most(np.full((10, 20, 3), 7, np.uint8), 10).max() == 7


def test_cards_as_shown(spark):
    from mintlens.sources.images import cards, shown

    text = '{"id": "1", "name": "A", "types": ["Fire"], "attacks": [{"n": 1}], "pricing": {"cardmarket": {"normal": {"trend": 2}}, "tcgplayer": {"marketPrice": "3.5"}}}'
    r = shown(cards(spark.createDataFrame([(text,), ('{"id": "2"}',)], "payload string")), {"Fire": "#F08030"}).orderBy("id").collect()
    assert len(r[0].asDict()) == 14 and r[0].tipo_color == "#F08030" and r[1].tipo_color == "#999999" and r[0].ataques == '[{"n":1}]'
    assert (r[0].mercado.cardmarket.currency, r[0].mercado.cardmarket.trend, r[0].mercado.tcgplayer.marketPrice) == ("EUR", 2.0, 3.5) and r[1].mercado.cardmarket is None
