"""Enhancement of images ahead of recognition, as one map over rows: grey, local contrast, sharpening, contrast. Pixels are never shuffled.

Images are (height, width, channels, data) with rows of blue, green and red bytes. Equalisation is contrast-limited and adaptive (Zuiderveld 1994) on an 8 x 8 grid of tiles;
byte parity with other libraries isn't checked. Images that can't be read keep their row, with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILES, CLIP = 8, 2.0


def to_gray(image: np.ndarray) -> np.ndarray:
    """Luma of blue, green and red, to the nearest whole number."""
    return ((image.astype(np.int64) @ np.array([114, 587, 299]) + 500) // 1000).astype(np.uint8)


def clahe(gray: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Each tile's histogram, cut at a limit whose excess is spread evenly, gives a table; pixels blend those of the four nearest tiles."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    if min(h, w) > tiles:
        counts = tile_counts(gray, 0, h, tiles)
    else:  # too small to be mirrored: the edge is repeated
        padded = np.pad(gray, ((0, -h % tiles), (0, -w % tiles)), mode="edge")
        blocks = padded.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1).astype(np.int64)
        counts = np.bincount((np.arange(len(blocks))[:, None] * 256 + blocks).ravel(), minlength=256 * len(blocks)).reshape(tiles, tiles, 256)
    return blended(gray, 0, h, tables_of(counts, th * tw, clip))


def sharpen(gray: np.ndarray) -> np.ndarray:
    """Nine times the pixel less its eight neighbours, the border mirrored without the edge."""
    g = np.pad(gray.astype(np.int32), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    h, w = gray.shape
    around = sum(g[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3))
    return (10 * g[1:-1, 1:-1] - around).clip(0, 255).astype(np.uint8)


def scale_contrast(gray: np.ndarray, alpha: float = 1.2, beta: float = 30) -> np.ndarray:
    return np.rint(np.abs(gray.astype(np.float64) * alpha + beta)).clip(0, 255).astype(np.uint8)


def _padding(h: int, tiles: int) -> np.ndarray:
    """Source rows (or columns) of the mirrored ones that fill the last tile."""
    return h - 2 - np.arange(-h % tiles)


def tile_counts(gray: np.ndarray, first: int, h: int, tiles: int = TILES) -> np.ndarray:
    """Histograms (tiles x tiles x 256) of the rows from `first` on of a grey image of h rows, with those that they fill the last tiles with. Counts of the parts of an image add up."""
    w = gray.shape[1]
    th, tw = -(-h // tiles), -(-w // tiles)
    source = np.concatenate([np.arange(h), _padding(h, tiles)])
    at = np.flatnonzero((source >= first) & (source < first + len(gray)))
    rows = gray[source[at] - first][:, np.concatenate([np.arange(w), _padding(w, tiles)])]
    tile = (at // th)[:, None] * tiles + (np.arange(rows.shape[1]) // tw)[None, :]
    return np.bincount((tile * 256 + rows).ravel(), minlength=tiles * tiles * 256).reshape(tiles, tiles, 256)


def tables_of(counts: np.ndarray, pixels: int, clip: float = CLIP) -> np.ndarray:
    """Each tile's table from its histogram, cut at a limit whose excess is spread evenly; pixels: of a tile."""
    tiles = counts.shape[0]
    counts = counts.reshape(-1, 256)
    limit = max(int(clip * pixels / 256), 1)
    excess = np.maximum(counts - limit, 0).sum(1)
    counts = np.minimum(counts, limit) + (excess // 256)[:, None]
    for row, rest in zip(counts, excess % 256, strict=True):
        if rest:
            row[:: max(256 // int(rest), 1)][: int(rest)] += 1
    return np.rint(counts.cumsum(1) * (255.0 / pixels)).clip(0, 255).reshape(tiles, tiles, 256)


def blended(gray: np.ndarray, first: int, h: int, tables: np.ndarray) -> np.ndarray:
    """Pixels of the rows from `first` on of an image of h rows, by the tables of the four nearest tiles."""
    w, tiles = gray.shape[1], tables.shape[0]

    def near(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (at + 0.5) / size - 0.5
        low = np.floor(x).astype(int)
        return low.clip(0, tiles - 1), (low + 1).clip(0, tiles - 1), x - low

    y0, y1, fy = near(np.arange(first, first + len(gray)), -(-h // tiles))
    x0, x1, fx = near(np.arange(w), -(-w // tiles))
    at = lambda y, x: tables[y[:, None], x[None, :], gray]
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return np.rint(top * (1 - fy[:, None]) + low * fy[:, None]).clip(0, 255).astype(np.uint8)


def enhance(image: np.ndarray) -> np.ndarray:
    return scale_contrast(sharpen(clahe(to_gray(image))))


def mapped(images: DataFrame, step: Callable[[np.ndarray], np.ndarray], carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, height, width, data (one grey byte a pixel), error, and a struct of the carried columns if there are any: step is applied to each image's array.

    An image that the reader has found unreadable, or whose bytes aren't those of its size, has no data, and an error. Spark hands the images to a task in batches bounded in bytes
    (spark.sql.execution.arrow.maxBytesPerBatch), and each result leaves before the next image is looked at, so a task holds one batch and one image more.
    """

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, (h, w, c, data) in enumerate(zip(b["height"], b["width"], b["channels"], b["data"], strict=True)):
                size = 0 if data is None else len(data)
                fine = bool(h and w and c == 3 and h > 0 and w > 0 and size == h * w * c)
                done = step(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)).tobytes() if fine else None
                one = b.iloc[i : i + 1]
                yield one[["doc_id", "height", "width"]].astype({"height": "Int32", "width": "Int32"}).assign(data=[done], error=[None if fine else "unreadable image"], **{f"__{k}": one[f"__{k}"] for k in range(len(carried))})

    more = [images[f"`{c}`"].alias(f"__{k}") for k, c in enumerate(carried)]
    schema = ", ".join(["doc_id string, height int, width int, data binary, error string", *(f"__{k} {images.schema[c].dataType.simpleString()}" for k, c in enumerate(carried))])
    out = images.select("doc_id", "height", "width", "channels", "data", *more).mapInPandas(rows, schema)
    if not carried:
        return out
    return out.select("doc_id", "height", "width", "data", "error", F.struct(*[F.col(f"__{k}").alias(c) for k, c in enumerate(carried)]).alias("carried"))


def enhance_images(images: DataFrame) -> DataFrame:
    return mapped(images, enhance)


def enhance_in_strips(images: DataFrame, rows: int = 256) -> DataFrame:
    """doc_id, strip (from 0), first (its first row), height, width and data of the strips of enhanced images, equal to those of the whole images; for images too large for one task. Images must be readable, and larger than the grid of tiles.

    An image is cut into strips of `rows` rows with one more on either side, and each strip goes to a task of its own. Tasks count the tiles of their strips; the counts of an image, some 64 KB a strip, are added where its tables
    are made; the tables go back to the strips, which equalise, sharpen (with the rows of their neighbours at hand) and stretch themselves.
    """
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / rows).cast("int")), lambda k: F.struct(
        k.alias("strip"), (k * rows).alias("first"), F.greatest(k * rows - 1, F.lit(0)).alias("from"),
        F.substring("data", F.greatest(k * rows - 1, F.lit(0)) * F.col("width") * 3 + 1, (F.least(k * rows + rows + 1, F.col("height")) - F.greatest(k * rows - 1, F.lit(0))) * F.col("width") * 3).alias("data"),
    ))
    strips = images.select("doc_id", "height", "width", F.explode(cut).alias("s")).select("doc_id", "height", "width", "s.*")
    strips = strips.repartition(F.xxhash64("doc_id", "strip"))

    def own_rows(r, gray: np.ndarray) -> np.ndarray:
        return gray[r.first - r.start : r.first - r.start + min(rows, r.height - r.first)]

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.rename(columns={"from": "start"}).itertuples():
                gray = to_gray(np.frombuffer(r.data, np.uint8).reshape(-1, r.width, 3))
                yield pd.DataFrame({"doc_id": [r.doc_id], "height": [r.height], "width": [r.width], "counts": [tile_counts(own_rows(r, gray), r.first, r.height).astype("<i4").tobytes()]})

    def tables(b: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i4").astype(np.int64) for c in b["counts"]).reshape(TILES, TILES, 256)
        of = b.iloc[0]
        made = tables_of(total, -(-int(of["height"]) // TILES) * -(-int(of["width"]) // TILES)).astype(np.uint8).tobytes()
        return pd.DataFrame({"doc_id": of["doc_id"], "strip": range(len(b)), "tables": made})

    def finish(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.rename(columns={"from": "start"}).itertuples():
                gray = to_gray(np.frombuffer(r.data, np.uint8).reshape(-1, r.width, 3))
                made = np.frombuffer(r.tables, np.uint8).reshape(TILES, TILES, 256).astype(np.float64)
                # at the image's own edges sharpen mirrors; at a strip's the neighbour's row is there
                out = own_rows(r, scale_contrast(sharpen(blended(gray, r.start, r.height, made))))
                yield pd.DataFrame({"doc_id": [r.doc_id], "strip": [r.strip], "first": [r.first], "height": [len(out)], "width": [r.width], "data": [out.tobytes()]})

    counted = strips.mapInPandas(count, "doc_id string, height int, width int, counts binary")
    made = counted.groupBy("doc_id").applyInPandas(tables, "doc_id string, strip int, tables binary")
    return strips.join(made, ["doc_id", "strip"]).mapInPandas(finish, "doc_id string, strip int, first int, height int, width int, data binary")

