"""Travel-time matrices from routing files."""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import StringType

from reachgrid.functions.geo import cell_code
from reachgrid.operators.keys import remap
from reachgrid.params import DEFAULT_SLOT, MAX_MINUTES, MODES
from reachgrid.schemas import columns
from reachgrid.sources.versions import filesystem

# Fixed value: how a matrix file is named (mode, then an optional HHMM).
FILE_NAME = r"(?i)^ttm_([a-z]+)(?:_([0-9]{4}))?\.parquet$"


def mode_of(name: Column) -> Column:
    """Mode in a file name; null when the name or the mode is not accepted."""
    mode = F.upper(F.regexp_extract(name, FILE_NAME, 1))
    return F.when(mode.isin(*MODES), mode)


def slot_of(name: Column) -> Column:
    """Departure slot in a file name; files without one are from 08:00."""
    digits = F.regexp_extract(name, FILE_NAME, 2)
    return F.when(digits == "", F.lit(DEFAULT_SLOT)).otherwise(
        F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2))
    )


def value_column(names: list[str]) -> str | None:
    """First percentile column by name, else the plain travel time."""
    return next((c for c in sorted(names) if c.startswith("travel_time_p")), "travel_time" if "travel_time" in names else None)


#: What a task learns from the end of a file.
FOOTER = "path string, file string, from_type string, to_type string, value string, value_type string, fault string"


def listing(ws, path: str, *names_of: str) -> DataFrame:
    """(path, file), or the named columns, of the matrix files of a folder, listed by Spark; no content is read."""
    fs, folder = filesystem(ws.spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    if not any(n.startswith("ttm_") and n.endswith(".parquet") for n in names):
        raise FileNotFoundError(f"no ttm_*.parquet files in {path}")
    found = ws.spark.read.format("binaryFile").option("pathGlobFilter", "ttm_*.parquet").load(path)
    return found.select(*names_of) if names_of else found.select("path", F.element_at(F.split("path", "/"), -1).alias("file"))


def footers(files: DataFrame) -> DataFrame:
    """FOOTER rows of files, read side by side: Spark types of the id columns, and the value column with its type."""

    def read(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_type

        from reachgrid.sources.feed_source import opened

        def look(path):
            try:
                system, inside = opened(unquote(path))
                with system.open_input_file(inside) as file:
                    schema = pq.read_schema(file)
            except Exception as error:  # noqa: BLE001 - one damaged file does not stop the others
                return None, None, None, None, f"{type(error).__name__}: {error}"
            value = value_column(schema.names)
            kinds = [from_arrow_type(schema.field(c).type).simpleString() if c in schema.names else None for c in ("from_id", "to_id", value)]
            return kinds[0], kinds[1], value, kinds[2], None

        for batch in batches:
            found = list(zip(*[look(p) for p in batch.column(0).to_pylist()])) or [[]] * 5
            columns = [pa.array(c, pa.string()) for c in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["path", "file", "from_type", "to_type", "value", "value_type", "fault"])

    return files.select("path", "file").mapInArrow(read, FOOTER)


def layouts(ws, path: str) -> DataFrame:
    """FOOTER rows with mode, departure_time and the reason why a file is not accepted, or null.

    A reason is ``name``, ``mode``, ``unreadable`` or ``columns``, whichever comes first.
    """
    name = F.col("file")
    known = mode_of(name)
    reason = (
        F.when(~name.rlike(FILE_NAME), "name").when(known.isNull(), "mode").when(F.col("fault").isNotNull(), "unreadable")
        .when(F.col("value").isNull() | F.col("from_type").isNull() | F.col("to_type").isNull(), "columns")
    )
    return footers(listing(ws, path)).withColumns({"mode": known, "departure_time": slot_of(name), "reason": reason})


def skipped_files(ws, path: str) -> DataFrame:
    """(file, reason) of the matrix files whose name, mode, end or columns are not accepted."""
    return layouts(ws, path).where("reason is not null").select("file", "reason")


def branches(ws, path: str) -> list[tuple[str, str, DataFrame]]:
    """(mode, departure_time, typed rows): one scan for the files that share these and their layout.

    Mode and slot are constants of a scan, not parsed for each row, and a filter
    on them leaves whole scans out.
    """
    same = ["mode", "departure_time", "from_type", "to_type", "value", "value_type"]
    accepted = layouts(ws, path).where("reason is null").groupBy(*same).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    out = []
    # One row for each mode, slot and layout.
    for g in sorted(accepted.collect(), key=lambda r: tuple(r[c] for c in same)):
        ddl = f"from_id {g.from_type}, to_id {g.to_type}, `{g.value}` {g.value_type}"
        found = ws.spark.read.schema(ddl).parquet(*[unquote(p) for p in g.paths])
        rows = typed(found, "from_id", "to_id", g.value, F.lit(g.mode).alias("mode"), F.lit(g.departure_time).alias("departure_time"))
        out.append((g.mode, g.departure_time, rows))
    return out


MATRIX = "mode string, departure_time string, origin_cell_id bigint, destination_id bigint, travel_time_minutes double"


def joined(ws, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else ws.spark.createDataFrame([], MATRIX)


def read_matrices(ws, path: str) -> DataFrame:
    """All accepted files as one frame of typed columns; unreadable values are null."""
    return joined(ws, [rows for _, _, rows in branches(ws, path)])


def typed(df: DataFrame, origin: str, destination: str, minutes: str, *others: Column) -> DataFrame:
    """Ids and minutes as numbers. Columns that are numbers already are not parsed."""
    return df.select(
        *others,
        _as_id(df, origin).alias("origin_cell_id"),
        _as_id(df, destination).alias("destination_id"),
        F.col(minutes).try_cast("double").alias("travel_time_minutes"),
    )


def _as_id(df: DataFrame, name: str) -> Column:
    whole = F.col(name).try_cast("bigint")
    if isinstance(df.schema[name].dataType, StringType):
        return F.coalesce(whole, F.col(name).try_cast("double").try_cast("bigint"))
    return whole


def judged(matrices: DataFrame, max_minutes: float = MAX_MINUTES) -> DataFrame:
    """Add a ``fate``: kept, not_numeric (null or NaN) or out_of_range."""
    minutes = F.col("travel_time_minutes")
    matrices = matrices.withColumn("travel_time_minutes", F.when(~F.isnan(minutes), minutes))
    missing = F.col("origin_cell_id").isNull() | F.col("destination_id").isNull() | F.col("travel_time_minutes").isNull()
    inside = F.col("travel_time_minutes").between(0.0, max_minutes)
    return matrices.withColumn("fate", F.when(missing, "not_numeric").when(inside, "kept").otherwise("out_of_range"))


def counts() -> list[Column]:
    """Rows kept and dropped, and values that were not numbers."""
    bad = [F.col(c).isNull().cast("int") for c in ("origin_cell_id", "destination_id", "travel_time_minutes")]
    return [
        F.count_if(F.col("fate") == "kept").alias("rows_kept"),
        F.count_if(F.col("fate") == "not_numeric").alias("rows_not_numeric"),
        F.count_if(F.col("fate") == "out_of_range").alias("rows_out_of_range"),
        F.sum(bad[0] + bad[1] + bad[2]).alias("values_not_numeric"),
    ]


def report(cleaned: DataFrame) -> DataFrame:
    """The counts of each mode and slot, by a pass over the rows."""
    return cleaned.groupBy("mode", "departure_time").agg(*counts())


REPORT = "mode string, departure_time string, rows_kept bigint, rows_not_numeric bigint, rows_out_of_range bigint, values_not_numeric bigint"


class Watched:
    """The counts of each mode and slot, taken while the rows are written."""

    def __init__(self, ws) -> None:
        self.ws = ws
        self.seen: list[tuple[str, str, Observation]] = []

    def watch(self, mode: str, slot: str, cleaned: DataFrame) -> DataFrame:
        seen = Observation(f"matrices-{uuid.uuid4().hex}")
        self.seen.append((mode, slot, seen))
        return cleaned.observe(seen, *counts())

    def report(self) -> DataFrame:
        """Known once all rows have been written; before that it would wait."""
        total: dict[tuple[str, str], list[int]] = {}
        for mode, slot, seen in self.seen:
            found = seen.get
            own = total.setdefault((mode, slot), [0] * 4)
            for i, name in enumerate(("rows_kept", "rows_not_numeric", "rows_out_of_range", "values_not_numeric")):
                own[i] += found[name] or 0
        # A slot without rows has no line, as in a report by rows.
        return self.ws.spark.createDataFrame([(*k, *v) for k, v in sorted(total.items()) if any(v)], REPORT)


def origin_mapping(origins: DataFrame, cells: DataFrame) -> DataFrame:
    """(old_id, new_id) from exported origins (id, x, y) to current cells by cell code."""
    old = origins.select(F.col("id").alias("old_id"), cell_code(F.col("x"), F.col("y")).alias("cell_code"))
    return old.join(cells.select("cell_code", F.col("id").alias("new_id")), "cell_code").select("old_id", "new_id")


def remap_origins(od: DataFrame, origins: DataFrame, cells: DataFrame) -> DataFrame:
    """Current cell ids for matrices routed on an older grid; unchanged if all ids are known."""
    unknown = origins.join(cells.select("id"), "id", "left_anti")
    if unknown.isEmpty():
        return od
    mapping = origin_mapping(origins, cells)
    return od if mapping.isEmpty() else remap(od, "origin_cell_id", mapping)


def import_od(
    ws, path: str, max_minutes: float = MAX_MINUTES, origins: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(travel_times, report) from a folder of matrix files; each is a pass over them."""
    cleaned = judged(read_matrices(ws, path), max_minutes)
    return kept(ws, cleaned, origins), report(cleaned)


def watched_od(ws, path: str, max_minutes: float = MAX_MINUTES, origins: DataFrame | None = None) -> tuple[DataFrame, Watched]:
    """travel_times from a folder of matrix files, and what their writing will have counted."""
    watched = Watched(ws)
    parts = [watched.watch(mode, slot, judged(rows, max_minutes)) for mode, slot, rows in branches(ws, path)]
    return kept(ws, joined(ws, parts) if parts else judged(joined(ws, [])), origins), watched


def kept(ws, cleaned: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    od = cleaned.where("fate = 'kept'").withColumn("tenant_id", F.lit(ws.tenant)).select(*columns("travel_times"))
    if origins is not None and ws.has("grid_cells"):
        od = remap_origins(od, origins, ws.table("grid_cells"))
    return od
