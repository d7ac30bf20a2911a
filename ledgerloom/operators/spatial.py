"""Positions on pages: order-dependent grouping, bounded by one page each, in vectorised batches; shifts between pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(cys, heights, worded, share: float) -> list[int]:
    """The row, from the top, of each word of a page in the order of centres."""
    lines: list[list] = []  # centre, greatest height, members, whether one has a letter or digit
    labels = []
    for cy, height, text in zip(cys, heights, worded, strict=True):
        best, far = -1, float("inf")
        for i, (c, h, _, line_worded) in enumerate(lines):
            small, large = min(h, height), max(h, height)
            # a logo or drop cap must not bridge two baselines; a small sign may
            reach = small if large > 2 * small and text and line_worded else large
            if (d := abs(cy - c)) <= share * reach and d < far:
                best, far = i, d
        if best < 0:
            lines.append([cy, height, 1, text])
            best = len(lines) - 1
        else:
            c, h, n, line_worded = lines[best]
            lines[best] = [(c * n + cy) / (n + 1), max(h, height), n + 1, line_worded or text]
        labels.append(best)
    place = {old: new for new, old in enumerate(sorted(range(len(lines)), key=lambda i: lines[i][0]))}
    return [place[x] for x in labels]


def rows_of_words(words: DataFrame, share: float = 0.65) -> DataFrame:
    """Adds ``row``, from the top: words in the order of their centres join the nearest row within a share of the greater height; of the smaller, if one is twice the other and both hold text.

    Pages are dealt by their key and sorted by Spark; a task walks through its pages in batches and holds one page more than a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            whole = pd.concat([*held, b], ignore_index=True) if held else b.reset_index(drop=True)
            new = (whole["doc_id"] != whole["doc_id"].shift()) | (whole["page"] != whole["page"].shift())
            last = int(new[::-1].idxmax()) if len(whole) else 0
            held = [whole.iloc[last:]]
            if last:
                yield labelled(whole.iloc[:last], new.iloc[:last].to_numpy())
        if held and len(held[0]):
            first = [True] + [False] * (len(held[0]) - 1)
            yield labelled(held[0], np.array(first))

    def labelled(part: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        cys, heights = ((part.y0 + part.y1) / 2).tolist(), (part.y1 - part.y0).clip(lower=1.0).tolist()
        worded = [any(c.isalnum() for c in t) for t in part.text.fillna("")]
        edges = [*np.flatnonzero(new).tolist(), len(part)]
        labels: list[int] = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            labels += _rows(cys[a:z], heights[a:z], worded[a:z], share)
        return part.assign(row=np.array(labels, np.int64))

    schema = words.withColumn("row", F.lit(0).cast("long")).schema
    centre = (F.col("y0") + F.col("y1")) / 2
    return words.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", centre, "x0", "ix").mapInPandas(run, schema)


def translation(pairs: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """The median shift of anchors (doc_id, dx, dy), accepted if two and three quarters of them agree with it."""
    centre = pairs.groupBy("doc_id").agg(F.median("dx").alias("mx"), F.median("dy").alias("my"), F.count("*").alias("n"))
    near = (F.abs(F.col("dx") - F.col("mx")) <= tolerance) & (F.abs(F.col("dy") - F.col("my")) <= tolerance)
    out = pairs.join(centre, "doc_id").groupBy("doc_id", "mx", "my", "n").agg(F.count_if(near).alias("inliers"), F.max(F.when(near, F.greatest(F.abs(F.col("dx") - F.col("mx")), F.abs(F.col("dy") - F.col("my"))))).alias("spread"))
    good = (F.col("inliers") >= 2) & (F.col("inliers") >= 0.75 * F.col("n"))
    return out.withColumn("confidence", F.when(good & (F.col("inliers") >= 3) & (F.col("spread") <= 4), "HIGH").when(good, "MEDIUM").otherwise("REJECTED"))
