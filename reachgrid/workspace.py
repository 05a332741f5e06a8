"""A tenant's tables, wherever they live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reachgrid.operators.contain import contains, polygon_edges
from reachgrid.schemas import LAYERS, SCHEMAS
from reachgrid.sources.tables import exists, read_table
from reachgrid.sources.versions import publish, replace_partitions

# Fixed value: the tenant of the demo data.
DEMO_TENANT = "00000000-0000-0000-0000-000000000001"


class Workspace:
    """Reads serving tables for one tenant, from files under *root* or from *frames*.

    A frame may be given as a function that makes it when it is needed.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        tenant: str = DEMO_TENANT,
        frames: dict[str, DataFrame | Callable[[], DataFrame]] | None = None,
    ) -> None:
        self.spark, self.root, self.tenant = spark, root, tenant
        self.frames = dict(frames or {})

    def has(self, name: str) -> bool:
        return name in self.frames or (self.root is not None and exists(self.spark, self.root, name))

    def table(self, name: str, required: bool = True) -> DataFrame:
        """Rows of this tenant; an optional table that is missing is empty."""
        if name in self.frames:
            df = self._frame(name)
        elif self.root is not None and self.has(name):
            df = read_table(self.spark, self.root, name)
        elif required:
            raise FileNotFoundError(f"table {name!r} is missing; run the job that writes it first")
        else:
            df = self.spark.createDataFrame([], SCHEMAS[name])
        return df.where(F.col("tenant_id") == self.tenant) if "tenant_id" in df.columns else df

    def _frame(self, name: str) -> DataFrame:
        frame = self.frames[name]
        return frame if isinstance(frame, DataFrame) else frame()

    def at(self, name: str, slot: str, required: bool = True) -> DataFrame:
        """A slot table at one departure time (a partition filter)."""
        return self.table(name, required).where(F.col("departure_time") == slot)

    def edges(self, layer: str) -> DataFrame:
        """Directed edges of a layer in metres, keyed by ``code``."""
        if f"{layer}_edges" in self.frames:
            return self._frame(f"{layer}_edges")
        key = LAYERS.get(layer, "id")
        table = self.table(layer).select(F.col(key).cast("string").alias("code"), "rings_m")
        return polygon_edges(table, "code", "rings_m")

    def centroids(self) -> DataFrame:
        half = F.col("size") / 2
        return self.table("grid_cells").select("id", (F.col("x0") + half).alias("x"), (F.col("y0") + half).alias("y"))

    def area_cells(self, layer: str, code: str | None = None) -> DataFrame:
        """(id, code) of cells whose centroid lies in or on an area."""
        stored = f"{layer}_cells"
        if stored in self.frames:
            pairs = self._frame(stored)
            return pairs if code is None else pairs.where(F.col("code") == code)
        edges = self.edges(layer)
        if code is not None:
            edges = edges.where(F.col("code") == code)
        return contains(self.centroids(), edges, "code")

    def publish(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a new version of a table and make it current."""
        if self.root is None:
            raise ValueError("this workspace has no root to publish to")
        publish(df, self.root, name, partition_by)
        self.frames.pop(name, None)
        return read_table(self.spark, self.root, name)

    def replace_slots(self, name: str, df: DataFrame, slots: list[str] | None = None) -> DataFrame:
        """Replace the named departure slots, or those that occur in *df*; a named one without rows becomes empty."""
        if self.root is None:
            raise ValueError("this workspace has no root to publish to")
        replace_partitions(df, self.root, name, "departure_time", slots)
        self.frames.pop(name, None)
        return read_table(self.spark, self.root, name)
