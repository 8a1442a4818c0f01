"""Row-local steps over unbounded tables.

The pipeline language has no windows or state. Steps that look at one row at a time
compile to stateless expressions, so they run on a streaming DataFrame as they are;
steps that need row order, other rows or other tables are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.package import ROW_ID, Package, StepError, from_frame
from tablewright.plans.expressions import parse_boolean
from tablewright.plans.pipeline import step
from tablewright.schema import cast_resource

STATELESS = (
    "boolean_filter_rows boolean_add_computed_field add_computed_field find_replace string_format split_column extract_nonnumeric round_fields convert_units convert_date "
    "convert_to_decimal_degrees rename_fields rename_fields_regex reorder_fields delete_fields update_fields add_schema_metadata set_types unpivot"
).split()


def _needs_rows(parameters: dict) -> bool:
    statements = [parameters.get("boolean_statement")]
    statements += [fn.get("boolean") for f in parameters.get("fields", []) if isinstance(f, dict) for fn in f.get("functions", [])]
    return any(node is not None and node.rows_needed() for node in map(parse_boolean, statements))


def apply_steps(stream: DataFrame, steps: list[dict]) -> DataFrame:
    """The stream after the given steps ({run, parameters}), without buffering or state."""
    package = Package((from_frame("stream", stream.withColumn(ROW_ID, F.lit(0).cast("long"))),))
    for s in steps:
        name, parameters = s["run"].rsplit(".", 1)[-1], s.get("parameters", {})
        if name not in STATELESS:
            raise StepError(f"{name} isn't row-local; on a stream only these are: {', '.join(STATELESS)}")
        if _needs_rows(parameters):
            raise StepError("Row numbers have no meaning on a stream")
        package = step(name, parameters)(package)
    return cast_resource(package.resources[0]).frame()


def run_stream(stream: DataFrame, steps: list[dict], path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Write the treated stream to files; restarts go on from the checkpoint."""
    writer = apply_steps(stream, steps).writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", path).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
