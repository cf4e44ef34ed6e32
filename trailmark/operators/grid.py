"""Heat-map counts over a grid laid on a corner."""

from pyspark.sql import Column, DataFrame, functions as F

# Rows of the flat cell number, and how many cells are kept.
GRID_ROWS = 30
GRID_CELLS = 1024


def _steps(axis: str, start: int, width: int) -> Column:
    return F.expr(f"({axis} - {int(start)}) div {int(width)}")


def grid_cells(points: DataFrame, lon0: int, lat0: int, width: int, height: int) -> DataFrame:
    """Counts by (x, y) steps, without folding; division truncates toward zero."""
    x, y = _steps("lon", lon0, width), _steps("lat", lat0, height)
    return points.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))


def grid_count(points: DataFrame, lon0: int, lat0: int, width: int, height: int) -> DataFrame:
    """Counts by the flat cell number x*30+y, which folds steps outside a column as the flat array does."""
    cell = _steps("lon", lon0, width) * GRID_ROWS + _steps("lat", lat0, height)
    return points.select(cell.alias("cell")).where(F.col("cell").between(0, GRID_CELLS - 1)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def grid_total(points: DataFrame, lon0: int, lat0: int, width: int, height: int) -> DataFrame:
    return grid_count(points, lon0, lat0, width, height).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
