"""Photo quality, page geometry and the grouping of pages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.shipping import ship


@dataclass(frozen=True)
class Quality:
    """Least demands on a photo."""

    width: int = 1200
    height: int = 900
    blur: float = 85.0
    brightness: tuple[float, float] = (45.0, 220.0)
    contrast: float = 28.0
    dark: float = 0.35
    bright: float = 0.25


def pixel_measures(images: DataFrame) -> DataFrame:
    """``images`` (origin, height, width, nChannels, data; BGR bytes, as Spark's image source gives them) with
    blur (variance of the Laplacian), brightness, contrast, dark_ratio and bright_ratio."""
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                x = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., :3].astype(np.float64)
                g = x[..., 0] if x.shape[2] == 1 else x @ np.array([0.114, 0.587, 0.299])
                p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
                lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
                rows.append((r.origin, r.width, r.height, float(lap.var()), float(g.mean()), float(g.std()), float((g < 35).mean()), float((g > 245).mean())))
            yield pd.DataFrame(rows, columns=["origin", "width", "height", "blur", "brightness", "contrast", "dark_ratio", "bright_ratio"])

    schema = "origin string, width int, height int, blur double, brightness double, contrast double, dark_ratio double, bright_ratio double"
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, schema)


def quality_score(q: Quality = Quality()) -> Column:
    """0 to 100, out of columns width, height, blur, brightness, contrast, dark_ratio and bright_ratio."""
    big = (F.col("width") >= q.width) & (F.col("height") >= q.height)
    top = lambda c: F.least(F.lit(100.0), c)
    low = lambda c: F.greatest(F.lit(0.0), c)
    return F.round(
        F.when(big, 100.0).otherwise(45.0) * 0.15 + top(F.col("blur") / q.blur * 80) * 0.30 + low(F.lit(100.0) - F.abs(F.col("brightness") - 135) * 0.85) * 0.20
        + top(F.col("contrast") / q.contrast * 75) * 0.15 + low(F.lit(100.0) - F.col("dark_ratio") / q.dark * 50) * 0.10 + low(F.lit(100.0) - F.col("bright_ratio") / q.bright * 50) * 0.10, 1,
    )


def faults(q: Quality = Quality()) -> tuple[Column, Column]:
    """How many critical and secondary demands fail."""
    critical = [(F.col("width") < q.width) | (F.col("height") < q.height), F.col("blur") < q.blur, ~F.col("brightness").between(*q.brightness)]
    secondary = [F.col("contrast") < q.contrast, F.col("dark_ratio") > q.dark, F.col("bright_ratio") > q.bright]
    return sum(c.cast("int") for c in critical), sum(c.cast("int") for c in secondary)


def acceptable(q: Quality = Quality()) -> Column:
    critical, secondary = faults(q)
    return (critical == 0) & (secondary <= 1)


def light(score: Column) -> Column:
    """Traffic light of a score of 0 to 1, or of 0 to 100."""
    s = F.when(score > 1, score / 100.0).otherwise(score)
    return F.when(s >= 0.78, "green").when(s >= 0.48, "yellow").otherwise("red")


def _overlap(a: str, b: str) -> Column:
    wide = F.least(F.col(f"{a}.x") + F.col(f"{a}.w"), F.col(f"{b}.x") + F.col(f"{b}.w")) - F.greatest(f"{a}.x", f"{b}.x")
    tall = F.least(F.col(f"{a}.y") + F.col(f"{a}.h"), F.col(f"{b}.y") + F.col(f"{b}.h")) - F.greatest(f"{a}.y", f"{b}.y")
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), tall)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes (x, y, w, h)."""
    both = _overlap(a, b)
    union = F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def contained(inner: str, outer: str) -> Column:
    """The share of the inner box that lies in the outer one."""
    area = F.col(f"{inner}.w") * F.col(f"{inner}.h")
    return F.when(area > 0, _overlap(inner, outer) / area).otherwise(0.0)


def corners(points: Column) -> Column:
    """Corners in the order top left, top right, bottom right, bottom left, by x + y and y - x."""
    pick = lambda f, key: f(F.transform(points, lambda p: F.struct(key(p).alias("k"), p.alias("p"))))["p"]
    total, lean = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(pick(F.array_min, total), pick(F.array_min, lean), pick(F.array_max, total), pick(F.array_max, lean))


def detection_confidence(rectangularity: Column, area_share: Column, at_border: Column) -> Column:
    return F.lit(0.5) * rectangularity + F.lit(0.3) * F.least(F.lit(1.0), area_share / 0.5) + F.lit(0.2) * F.when(at_border, 0.75).otherwise(1.0)


def drop_enclosing(boxes: DataFrame, photo: str = "photo_id", box: str = "box_id") -> DataFrame:
    """Without boxes that hold two or more smaller ones; all comparisons see the original list."""
    o, i = boxes.alias("o"), boxes.alias("i")
    area = lambda a: F.col(f"{a}.w") * F.col(f"{a}.h")
    inside = o.join(i, (F.col(f"o.{photo}") == F.col(f"i.{photo}")) & (F.col(f"o.{box}") != F.col(f"i.{box}")) & (area("i") < area("o") * 0.78) & (contained("i", "o") >= 0.88))
    holds = inside.groupBy(F.col(f"o.{photo}").alias(photo), F.col(f"o.{box}").alias(box)).agg(F.count("*").alias("n"), (F.sum(area("i")) / F.first(area("o"))).alias("share"))
    return boxes.join(holds.filter("n >= 2 and share >= 0.38"), [photo, box], "left_anti")


def suppress(boxes: DataFrame, photo: str = "photo_id", limit: float = 0.72, most: int = 20) -> DataFrame:
    """Greedy duplicate suppression within each photo, by descending confidence; the pages left in reading
    order, ``most`` at most.  The order of the choices matters, so a photo is handled as a whole; a photo
    has tens of boxes."""
    ship(boxes.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "box_id"], ascending=[False, True]).reset_index(drop=True)
        x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
        kept: list[int] = []
        for k in range(len(pdf)):
            wide = np.minimum(x[k] + w[k], x[kept] + w[kept]) - np.maximum(x[k], x[kept])
            tall = np.minimum(y[k] + h[k], y[kept] + h[kept]) - np.maximum(y[k], y[kept])
            both = np.clip(wide, 0, None) * np.clip(tall, 0, None)
            if not (both >= limit * (w[k] * h[k] + w[kept] * h[kept] - both)).any():
                kept.append(k)
        out = pdf.iloc[kept]
        order = np.lexsort((out["x"] + out["w"] / 2, out["y"] + out["h"] / 2))
        return out.iloc[order[:most]]

    return boxes.groupBy(photo).applyInPandas(run, boxes.schema)


def visual_rows(pages: DataFrame, photo: str = "photo_id") -> DataFrame:
    """Pages with visual_row and place: rows take in a page whose centre is within 0.45 of the median height
    from their running mean, and are read from left to right."""
    ship(pages.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema) + ", visual_row int, place int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cy, cx = pdf["y"] + pdf["h"] / 2, pdf["x"] + pdf["w"] / 2
        reach, rows = 0.45 * float(pdf["h"].median()), []
        for k in np.lexsort((cx, cy)).tolist():
            row = next((r for r in rows if abs(r[0] / len(r[1]) - cy.iloc[k]) <= reach), None)
            if row is None:
                rows.append(row := [0.0, []])
            row[0] += float(cy.iloc[k])
            row[1].append(k)
        rows.sort(key=lambda r: r[0] / len(r[1]))
        order = [(k, i) for i, r in enumerate(rows) for k in sorted(r[1], key=lambda k: cx.iloc[k])]
        out = pdf.iloc[[k for k, _ in order]].copy()
        out["visual_row"], out["place"] = [i for _, i in order], range(1, len(order) + 1)
        return out

    return pages.groupBy(photo).applyInPandas(run, schema)


def chunk_pages(pages: DataFrame, per_student: int, photo: str, order: str) -> DataFrame:
    """Pages with student_number, page_number and complete: consecutive pages of a photo, ``per_student`` for
    each student."""
    w = Window.partitionBy(photo).orderBy(order)
    p = pages.withColumn("n", F.row_number().over(w) - 1)
    p = p.withColumn("student_number", (F.floor(F.col("n") / per_student) + 1).cast("int")).withColumn("page_number", (F.col("n") % per_student + 1).cast("int"))
    return p.withColumn("complete", F.count("*").over(Window.partitionBy(photo, "student_number")) == per_student).drop("n")


def group_summary(chunks: DataFrame, photo: str) -> DataFrame:
    groups = chunks.groupBy(photo, "student_number").agg(F.first("complete").alias("complete"), F.count("*").alias("pages"))
    return groups.groupBy(photo).agg(F.count("*").alias("groups"), F.sum(F.col("complete").cast("int")).alias("complete_groups"), F.sum("pages").alias("pages"))
