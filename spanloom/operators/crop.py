"""Vertical crop that follows faces and persons."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import exprs, fixed


def _choose(boxes: list[tuple], last: tuple | None) -> tuple | None:
    """The largest box at first, later the nearest, large ones having a small advantage."""
    if not boxes:
        return None
    if last is None:
        return max(boxes, key=lambda b: b[2] * b[3])
    return min(boxes, key=lambda b: ((b[0] + b[2] / 2 - last[0]) ** 2 + (b[1] + b[3] / 2 - last[1]) ** 2) ** 0.5 - 0.2 * (b[2] * b[3]) ** 0.5)


def _step(last: float, target: float, visible: float) -> float:
    move = target - last
    if abs(move) <= visible * fixed.DEAD_ZONE:
        return last
    limit = visible * fixed.MAX_MOVE
    return last + max(-limit, min(limit, move)) * fixed.SMOOTHING


def track(samples: list[tuple[float, list[tuple], list[tuple]]], width: int, height: int, crop_w: int, crop_h: int, duration: float) -> list[tuple[float, float, float, str]]:
    """W15 and W14 of one clip: (time, center_x, center_y, source) from samples (time, faces, persons)."""

    def inside(x: float, y: float) -> tuple[float, float]:
        return max(crop_w / 2, min(x, width - crop_w / 2)), max(crop_h / 2, min(y, height - crop_h / 2))

    points, last = [], None
    for t, faces, persons in samples:
        box, source, low = _choose(faces, last), "face", 0.72
        if box is None:
            box, source, low = _choose(persons, last), "person", 0.42
        if box is not None:
            at = (box[0] + box[2] / 2, box[1] + box[3] * low)
        else:
            at, source = (last, "previous") if last else ((width / 2, height / 2), "center")
        last = inside(*at)
        points.append((t, *last, source))
    points = points or [(0.0, width / 2, height / 2, "center")]
    if points[-1][0] < duration:
        points.append((duration, *points[-1][1:]))
    out = points[:1]
    for t, x, y, source in points[1:]:
        _, px, py, _ = out[-1]
        out.append((t, *inside(_step(px, x, crop_w), _step(py, y, crop_h)), source))
    return out


def crop_track(detections: DataFrame, clips: DataFrame, key: list[str]) -> DataFrame:
    """H2: crop_points (key, n, time, center_x, center_y, source).

    detections: key, t, kind (face, person or null for a sample without boxes), box_pos, x, y, w, h. clips: key,
    width, height, duration. Each point depends on the one before, so a clip's samples are folded together;
    they are bounded by its length. The join is by shuffle: Spark takes samples derived from clips to be as few
    bytes as the clips' files, and would send them whole to every executor.
    """
    cw, ch = exprs.crop_size(F.col("width"), F.col("height"))
    sized = clips.select(*key, "width", "height", "duration", cw.alias("crop_w"), ch.alias("crop_h"))
    rows = sized.join(detections.hint("merge"), key, "left")
    kinds = {f.name: f.dataType.simpleString() for f in clips.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("box_pos", "ascending")])
        d = table.to_pydict()
        samples: dict[float, tuple[list, list]] = {}
        for t, kind, *box in zip(d["t"], d["kind"], d["x"], d["y"], d["w"], d["h"], strict=True):
            if t is not None:
                own = samples.setdefault(t, ([], []))
                if kind in ("face", "person"):
                    own[kind == "person"].append(tuple(box))
        points = track([(t, *s) for t, s in samples.items()], d["width"][0], d["height"][0], d["crop_w"][0], d["crop_h"][0], d["duration"][0])
        cols = {k: pa.array([d[k][0]] * len(points), table.schema.field(k).type) for k in key}
        return pa.table(cols | {"n": pa.array(range(len(points)), pa.int32())} | {c: [p[i] for p in points] for i, c in enumerate(("time", "center_x", "center_y", "source"))})

    return rows.groupBy(*key).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", n int, time double, center_x double, center_y double, source string")


def crop_origins(points: DataFrame, clips: DataFrame, key: list[str]) -> DataFrame:
    """adds the crop's upper left corner x, y of each point."""
    cw, ch = exprs.crop_size(F.col("width"), F.col("height"))
    rows = points.join(clips.select(*key, "width", "height", cw.alias("cw"), ch.alias("ch")).hint("merge"), key)
    x = exprs.bounded(F.col("center_x") - F.col("cw") / 2, F.lit(0.0), (F.col("width") - F.col("cw")).cast("double"))
    y = exprs.bounded(F.col("center_y") - F.col("ch") / 2, F.lit(0.0), (F.col("height") - F.col("ch")).cast("double"))
    return rows.withColumns({"x": x, "y": y}).drop("width", "height", "cw", "ch")


def crop_commands(points: DataFrame, clips: DataFrame, key: list[str], name: str = "smart") -> DataFrame:
    """The commands of each clip as one document: an interpolated x and y for every two points in a row."""
    w = Window.partitionBy(*key).orderBy("n")
    rows = crop_origins(points, clips, key)
    rows = rows.withColumns({"_t": F.lead("time").over(w), "_x": F.lead("x").over(w), "_y": F.lead("y").over(w), "_all": F.count("*").over(Window.partitionBy(*key))})
    f = lambda c: F.format_string("%.3f", F.bround(c, 3))
    span = F.concat(f(F.col("time")), F.lit("-"), f(F.greatest(F.col("_t"), F.col("time") + 0.001)))
    pair = lambda a: F.concat(span, F.lit(f" [expr] crop@{name} {a} 'lerp("), f(F.col(a)), F.lit(","), f(F.col(f"_{a}")), F.lit(",TI)';"))
    single = lambda a: F.concat(F.lit(f"0.000 crop@{name} {a} "), f(F.col(a)), F.lit(";"))
    line = F.when(F.col("_all") == 1, F.concat_ws("\n", single("x"), single("y"))).when(F.col("_t").isNotNull(), F.concat_ws("\n", pair("x"), pair("y")))
    rows = rows.withColumn("line", line).where(F.col("line").isNotNull())
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda r: r["line"])
    return rows.groupBy(*key).agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("document"))
