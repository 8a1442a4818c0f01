"""Declarative pipelines: steps by name, run in order over one package."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from tablewright.operators import combine, dates, fields, joins, numbers, rows, text
from tablewright.package import Package, Resource, StepError
from tablewright.schema import cast_resource
from tablewright.sinks import dump
from tablewright.sources import load

Step = Callable[[Package], Package]

STEPS: dict[str, Callable[..., Package]] = {
    f.__name__: f
    for f in (
        load.load, load.standard_load_multiple, load.inline, dump.dump_to_path, dump.dump_to_s3,
        fields.rename_fields, fields.rename_fields_regex, fields.reorder_fields, fields.delete_fields, fields.update_fields, fields.add_schema_metadata, fields.set_types,
        fields.update_package, fields.update_resource, fields.remove_resources, fields.rename_resource,
        rows.boolean_filter_rows, rows.boolean_add_computed_field, rows.add_computed_field, rows.edit_cells, rows.sort,
        text.find_replace, text.string_format, text.split_column, text.extract_nonnumeric,
        numbers.round_fields, numbers.convert_units, numbers.convert_to_decimal_degrees, dates.convert_date,
        joins.join, combine.concatenate, combine.duplicate, combine.unpivot,
    )
}

#: Parameters that only told a runner where to report progress.
IGNORED = {"cache_id", "loader_cache_id", "infer_strategy", "cast_strategy", "force-format", "recursion_limit", "submission_id", "submission_ids", "preserve_formatting", "scheme"}


def step(name: str, parameters: dict | None = None) -> Step:
    """One step with its parameters. Names may carry a library's prefix before a dot."""
    short = name.rsplit(".", 1)[-1]
    if short not in STEPS:
        raise StepError(f"Unknown step {name!r}; known: {', '.join(sorted(STEPS))}")
    fn = STEPS[short]
    given = {k: v for k, v in (parameters or {}).items() if k not in IGNORED}
    known = inspect.signature(fn).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in known.values()):
        unknown = sorted(set(given) - set(known))
        if unknown:
            raise StepError(f"{short}: unknown parameters {unknown}")
    missing = [k for k, p in list(known.items())[1:] if p.default is p.empty and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL) and k not in given]
    if missing:
        raise StepError(f"{short}: missing parameters {missing}")

    def run(package: Package) -> Package:
        return fn(package, **given)

    run.__name__ = short
    return run


@dataclass(frozen=True)
class Results:
    package: Package

    @property
    def stats(self) -> dict:
        return self.package.stats

    def rows(self, name: str | None = None) -> list[dict]:
        return (self.package.resources[0] if name is None else self.package[name]).rows()


class Flow:
    """Steps, lists of rows, resources, and functions from package to package, in order.

    ``progress(number, of, name, package)`` is called after each part: plans stay lazy, so
    it tells what is planned, and for steps that write, what is done.
    """

    def __init__(self, *parts, progress: Callable[[int, int, str, Package], None] | None = None):
        self.parts, self.progress = parts, progress

    def run(self, package: Package | None = None) -> Package:
        package = package or Package()
        for k, part in enumerate(self.parts, 1):
            package = self._one(part, package)
            if self.progress:
                name = part["run"] if isinstance(part, dict) else getattr(part, "__name__", type(part).__name__)
                self.progress(k, len(self.parts), name, package)
        return package

    @staticmethod
    def _one(part, package: Package) -> Package:
        if isinstance(part, Flow):
            return part.run(package)
        if isinstance(part, Resource):
            return package.with_resources([*package.resources, part])
        if isinstance(part, (list, tuple)):
            return load.inline(package, list(part))
        if isinstance(part, dict):
            return step(part["run"], part.get("parameters"))(package)
        return part(package)

    def results(self) -> Results:
        """The package with every cell cast to its field's type. Plans stay lazy until rows are asked for."""
        package = self.run()
        return Results(package.with_resources(cast_resource(r) for r in package.resources))


def from_spec(spec: str | dict, pipeline: str | None = None) -> Flow:
    """A pipeline from YAML text, a file of it, or its parsed form: {pipeline: [{run, parameters}]} or one such list by name."""
    if isinstance(spec, str):
        import yaml

        if "\n" not in spec and spec.rstrip().endswith((".yaml", ".yml")):
            from tablewright.sources import files

            spec = files.whole(load.session(), spec).decode()
        spec = yaml.safe_load(spec)
    if isinstance(spec, dict) and "pipeline" not in spec:
        names = [k for k, v in spec.items() if isinstance(v, dict) and "pipeline" in v]
        if pipeline is None and len(names) != 1:
            raise StepError(f"Which pipeline? {names}")
        spec = spec[pipeline or names[0]]
    listed = spec["pipeline"] if isinstance(spec, dict) else spec
    return Flow(*[step(s["run"], s.get("parameters")) for s in listed])


def run_spec(spec: str | dict, pipeline: str | None = None) -> Package:
    return from_spec(spec, pipeline).run()
