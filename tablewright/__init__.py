"""Declarative table cleaning on Spark: packages of tables, steps that compile to DataFrame expressions."""

from tablewright.package import Package, Resource, StepError, from_frame
from tablewright.plans.pipeline import Flow, Results, from_spec, run_spec, step

__all__ = ["Flow", "Package", "Resource", "Results", "StepError", "from_frame", "from_spec", "run_spec", "step"]
