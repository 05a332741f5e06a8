"""Jobs that write the serving tables: grid, population, travel times, scores."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from reachgrid.functions.geo import CELL_SIZE
from reachgrid.operators.contain import polygon_edges
from reachgrid.operators.distance import SLOTS, slot_od
from reachgrid.operators.grid import covering_cells, grid_rows
from reachgrid.operators.overlay import areal_weight, masked_weight
from reachgrid.operators.scoring import (
    STRATUM,
    combine,
    extremes,
    gravity_and_nearest,
    normalised,
    reached,
    rescaled_weights,
    weights_json,
)
from reachgrid.params import ScoreParams, check_slot
from reachgrid.plans.listings import settled
from reachgrid.schemas import columns
from reachgrid.session import scratch, written
from reachgrid.sources.od import import_od, listing, watched_od
from reachgrid.sources.versions import filesystem, manifest, place
from reachgrid.workspace import Workspace


def score_frames(
    ws: Workspace,
    params: ScoreParams | None = None,
    slots: list[str] | None = None,
    cells: DataFrame | None = None,
    store: bool = False,
) -> dict[str, DataFrame]:
    """Scores, combined scores and nearest destinations of all slots in one plan.

    With *store* the grouped rows are written once, so the three results do not
    read the travel times again.
    """
    params = params or ScoreParams()
    for slot in slots or []:
        check_slot(slot)
    for name in ("travel_times", "destinations", "destination_types", "grid_cells"):
        if not ws.has(name):
            raise FileNotFoundError(f"table {name!r} is missing; import it before scoring")
    rows = reached(ws.table("travel_times"), ws.table("destinations"), ws.table("destination_types"), params, slots, cells)
    grouped = gravity_and_nearest(rows, params)
    if store:
        grouped = written(grouped, "grouped")
    strata = rescaled_weights(extremes(grouped, "score", STRATUM), params)
    if store:
        strata = written(strata, "strata")
    scored = normalised(grouped, strata).withColumn("tenant_id", F.lit(ws.tenant))
    combined = combine(scored).withColumns({"tenant_id": F.lit(ws.tenant), "weights": weights_json(params)})
    return {
        "connectivity_scores": scored.select(*columns("connectivity_scores")),
        "combined_scores": combined.select(*columns("combined_scores")),
        "min_travel_times": grouped.withColumn("tenant_id", F.lit(ws.tenant)).select(*columns("min_travel_times")),
    }


def score(ws: Workspace, params: ScoreParams | None = None, slots: list[str] | None = None) -> dict[str, DataFrame]:
    """Score and publish; a run over some slots leaves the other slots in place."""
    if slots is None and ws.table("travel_times").isEmpty():
        raise ValueError("no departure slots: import travel times before scoring")
    with scratch(ws.spark):
        frames = score_frames(ws, params, slots, store=True)
        if slots is None:
            return {name: ws.publish(name, df, ["departure_time"]) for name, df in frames.items()}
        return {name: ws.replace_slots(name, df, slots) for name, df in frames.items()}


def build_grid(ws: Workspace, size: int = CELL_SIZE) -> DataFrame:
    """Cells that touch the tenant's boundary."""
    boundary = ws.table("boundaries").select(F.col("id").cast("string").alias("code"), "rings_m")
    if boundary.isEmpty():
        raise ValueError(f"no boundary for tenant {ws.tenant}")
    return grid_rows(covering_cells(polygon_edges(boundary, "code", "rings_m"), "code", size), ws.tenant, size)


def cell_boxes(ws: Workspace) -> DataFrame:
    size = F.col("size")
    return ws.table("grid_cells").select("id", "x0", "y0", (F.col("x0") + size).alias("x1"), (F.col("y0") + size).alias("y1"))


def spread_population(ws: Workspace, use_mask: bool = True) -> tuple[DataFrame, DataFrame]:
    """(grid cells with population, one-row report).

    Settlements mask the sources when there are any that are not dispersed.
    Cells that no source reaches get 0.
    """
    cells, sources = ws.table("grid_cells"), ws.table("population_sources")
    if cells.isEmpty() or sources.isEmpty():
        raise ValueError("population needs a grid and population sources")
    keyed = sources.withColumn("source_id", F.col("source_code"))
    edges = polygon_edges(keyed, "source_id", "rings_m")
    masks = ws.table("nucleos", required=False).where(settled()) if use_mask else None
    masked = masks is not None and not masks.isEmpty()
    if masked:
        mask_edges = polygon_edges(masks.withColumn("mask_id", F.col("id")), "mask_id", "rings_m")
        people = masked_weight(keyed.select("source_id", "population"), edges, cell_boxes(ws), mask_edges)
    else:
        people = areal_weight(keyed.select("source_id", "population"), edges, cell_boxes(ws))
    people = written(people, "population")
    filled = cells.drop("population").join(people, "id").select(*columns("grid_cells"))
    return filled, conservation(sources, people, masked)


def conservation(sources: DataFrame, people: DataFrame, masked: bool = False) -> DataFrame:
    """Source and allocated population, populated cells and the loss in percent."""
    one = F.lit(1).alias("_one")
    given = sources.agg(F.coalesce(F.sum("population"), F.lit(0.0)).alias("source_population"), one)
    placed = people.agg(
        F.coalesce(F.sum("population"), F.lit(0.0)).alias("allocated_population"),
        F.count_if(F.col("population") > 0).alias("cells_with_population"),
        F.count("*").alias("total_cells"),
        one,
    )
    lost = F.abs(F.col("source_population") - F.col("allocated_population")) / F.col("source_population") * 100
    return (
        given.join(F.broadcast(placed), "_one")
        .drop("_one")
        .withColumns({"masked": F.lit(masked), "loss_pct": F.when(F.col("source_population") > 0, lost)})
    )


def import_travel_times(ws: Workspace, path: str, origins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Publish OD matrices from files, partitioned by slot; returns (table, report).

    The files are read once: the report is counted while the rows are written.
    A task that ran twice may have been counted twice, so the rows kept are held
    against the published table; if they differ, the files are counted again.
    """
    od, watched = watched_od(ws, path, origins=origins)
    table = ws.publish("travel_times", od, ["departure_time"])
    report = watched.report()
    if origins is None and report.agg(F.coalesce(F.sum("rows_kept"), F.lit(0))).first()[0] != table.count():
        report = import_od(ws, path)[1]
    return table, report


class RunRecord:
    """What a run has done, so that one that was killed goes on where it was.

    Every stage leaves a mark when its tables are published, named after its
    inputs: parameters, versions of the tables it reads, and the stages before
    it. A stage whose mark is there is skipped; when an input has changed, it and
    all later ones run again. A finished run puts its marks aside. One run at a
    time works on a workspace.
    """

    def __init__(self, ws: Workspace, kind: str, **given: Any) -> None:
        if ws.root is None:
            raise ValueError("a run needs a workspace with a root")
        self.ws, self.folder, self.token = ws, f"{ws.root}/runs/{kind}", digest(kind, ws.tenant, given)
        self.skipped: list[str] = []

    def stage(self, name: str, reads: list[str], work: Callable[[], DataFrame | None], **given: Any) -> DataFrame | None:
        """Do *work*, which publishes tables and may return a small report, or give the report of when it was done."""
        versions = {t: v.number if (v := manifest(self.ws.spark, self.ws.root, t)) else None for t in reads}
        self.token = digest(self.token, name, versions, given)
        path = f"{self.folder}/{name}-{self.token}.json"
        fs, mark = filesystem(self.ws.spark, path)
        if fs.exists(mark):
            self.skipped.append(name)
            stream = fs.open(mark)
            try:
                said = json.loads(self.ws.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        else:
            report = work()
            # Reports have a row for each mode and slot at most.
            said = None if report is None else {"schema": report.schema.json(), "rows": [list(r) for r in report.collect()]}
            place(self.ws.spark, path, json.dumps(said))
        if said is None:
            return None
        return self.ws.spark.createDataFrame([tuple(r) for r in said["rows"]], StructType.fromJson(json.loads(said["schema"])))

    def finish(self) -> None:
        fs, folder = filesystem(self.ws.spark, self.folder)
        done = self.ws.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}-done-{uuid.uuid4().hex}")
        fs.rename(folder, done)


def digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


SCORED = ("connectivity_scores", "combined_scores", "min_travel_times")


def _grid_and_population(ws: Workspace, record: RunRecord, size: int, use_mask: bool) -> DataFrame | None:
    record.stage("grid", ["boundaries"], lambda: ws.publish("grid_cells", build_grid(ws, size)) and None, size=size)

    def people() -> DataFrame:
        cells, report = spread_population(ws, use_mask)
        ws.publish("grid_cells", cells)
        return report

    return record.stage("population", ["population_sources", "nucleos"], people, use_mask=use_mask)


def _scores(ws: Workspace, record: RunRecord, params: ScoreParams | None) -> dict[str, DataFrame]:
    record.stage("scores", ["destinations", "destination_types", "travel_times"], lambda: score(ws, params) and None, params=params or ScoreParams())
    record.finish()
    return {name: ws.table(name) for name in SCORED}


def run(
    ws: Workspace,
    od_path: str,
    params: ScoreParams | None = None,
    size: int = CELL_SIZE,
    use_mask: bool = True,
    origins: DataFrame | None = None,
) -> dict[str, Any]:
    """Grid, population, travel times and scores from imported layers and OD files; goes on where a killed run was (:class:`RunRecord`).

    *origins* (id, x, y) are the cells that the OD files were routed for, if the
    grid has changed since.
    """
    record = RunRecord(ws, "full")
    people = _grid_and_population(ws, record, size, use_mask)
    files = sorted((r.path, r.length, str(r.modificationTime)) for r in listing(ws, od_path, "path", "length", "modificationTime").collect())
    imported = record.stage("import", [], lambda: import_travel_times(ws, od_path, origins)[1], files=files)
    return {"population": people, "import": imported, **_scores(ws, record, params), "skipped": record.skipped}


def run_demo(
    ws: Workspace,
    destinations: DataFrame,
    params: ScoreParams | None = None,
    size: int = CELL_SIZE,
    fraction: float = 1.0,
    slots: tuple[str, ...] = SLOTS,
) -> dict[str, Any]:
    """As :func:`run`, with distance-based travel times in place of OD files."""
    record = RunRecord(ws, "demo")
    people = _grid_and_population(ws, record, size, True)

    def travel() -> None:
        ws.publish("destinations", destinations)
        od = slot_od(
            ws.table("grid_cells").select("id", "lon", "lat"),
            ws.table("destinations").select("id", "lon", "lat"),
            slots,
            fraction=fraction,
        ).withColumn("tenant_id", F.lit(ws.tenant))
        ws.publish("travel_times", od.select(*columns("travel_times")), ["departure_time"])

    record.stage("travel_times", [], travel, fraction=fraction, slots=slots)
    return {"population": people, **_scores(ws, record, params), "skipped": record.skipped}
