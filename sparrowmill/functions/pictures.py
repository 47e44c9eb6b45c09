"""Pictures as struct(width, height, pixels), where a pixel packs red, green and blue into an int (bits 16, 8 and 0) and rows follow each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: weights of red, green and blue in the brightness, in parts of 256
RED, GREEN, BLUE = 77, 150, 29


def channels(pixel: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(pixel, bits).bitwiseAND(F.lit(255)) for bits in (16, 8, 0))


def brightness(pixel: Column) -> Column:
    red, green, blue = channels(pixel)
    return F.shiftright(red * RED + green * GREEN + blue * BLUE, 8)


def changed_share(a: Column, b: Column, step: int) -> Column:
    """The share of pixels whose brightness differs by more than ``step``; 1 for pictures of unequal sizes and empty ones, null if either is null."""
    sized = lambda p: F.struct(p["width"], p["height"])
    apart = F.zip_with(a["pixels"], b["pixels"], lambda x, y: F.abs(brightness(x) - brightness(y)) > step)
    n = F.size(a["pixels"])
    share = F.when((sized(a) != sized(b)) | (n == 0), F.lit(1.0)).otherwise(F.size(F.filter(apart, lambda x: x)) / n)
    return F.when(a.isNotNull() & b.isNotNull(), share)


def frame_hash(picture: Column, grid: int = 8) -> Column:
    """Two hex digits for the mean of each of ``grid`` x ``grid`` cells, by rows; a cell without a pixel is 00.

    Cells are as many whole pixels wide and high as go into the picture (one at least), so pixels at the right and lower edges can be
    left out. A pixel counts by the mean of its channels, rounded down like the cell's.
    """
    width, height = picture["width"], picture["height"]
    wide, high = (F.greatest(F.floor(side / grid).cast("int"), F.lit(1)) for side in (width, height))

    def mean(cell):
        left, top = (cell % grid) * wide, F.floor(cell / grid).cast("int") * high
        across = F.greatest(F.least(left + wide, width) - left, F.lit(0))
        rows = F.filter(F.sequence(top, top + high - 1), lambda y: y < height)
        within = F.flatten(F.transform(rows, lambda y: F.slice(picture["pixels"], y * width + left + 1, across)))
        total = F.aggregate(within, F.lit(0).cast("bigint"), lambda s, p: s + F.floor(sum(channels(p)) / 3))
        return F.when(F.size(within) > 0, F.floor(total / F.size(within))).otherwise(F.lit(0).cast("bigint"))

    cells = F.sequence(F.lit(0), F.lit(grid * grid - 1))
    return F.lower(F.array_join(F.transform(cells, lambda c: F.lpad(F.hex(mean(c)), 2, "0")), ""))
