"""Pipelines, in code or from a plain description."""

from tributary.plans.pipeline import Pipeline
from tributary.plans.spec import PipelineFactory, build_pipeline

__all__ = ["Pipeline", "PipelineFactory", "build_pipeline"]
