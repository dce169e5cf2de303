"""Pipelines from plain descriptions.

``{"extractor": {"name", "params"}, "transformers": [{"name", "params"}, ...], "loader": {"name", "params"}}``.
Names are looked up in a registry, to which own components are added with ``register``. In a mapper's lines a
transformation is a name of the function registry, or ``{"function": name, ...options}``.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from tributary.errors import SpecificationError
from tributary.functions import REGISTRY as FUNCTIONS
from tributary.operators.annotate import Annotator, AnnotatorMode
from tributary.operators.cleaning import EnumCleaner, NullCleaner, ThresholdCleaner
from tributary.operators.explode import Exploder
from tributary.operators.filters import NoIdDropper, Sieve
from tributary.operators.latest import NewestByGroup
from tributary.operators.project import Mapper, MapperMode, MissingColumnHandling
from tributary.plans.pipeline import Pipeline
from tributary.sources import CSVExtractor, HiveLoader, JDBCExtractorFullLoad, JDBCExtractorIncremental, JDBCLoader, JSONExtractor, ParquetLoader

BYPASS = "ByPass"
COMPONENTS: dict[str, Callable] = {c.__name__: c for c in (
    Annotator, CSVExtractor, EnumCleaner, Exploder, HiveLoader, JDBCExtractorFullLoad, JDBCExtractorIncremental, JDBCLoader, JSONExtractor, Mapper,
    NewestByGroup, NoIdDropper, NullCleaner, ParquetLoader, Sieve, ThresholdCleaner,
)}


def register(component: Callable, name: str | None = None) -> Callable:
    """Make ``component`` known to descriptions; usable as a class decorator."""
    COMPONENTS[name or component.__name__] = component
    return component


def _mapping_line(line):
    name, source, target, *comment = line
    if isinstance(target, dict):
        options = dict(target)
        function = options.pop("function", None)
        if function not in FUNCTIONS:
            raise SpecificationError(f"no such transformation: {function!r}")
        target = FUNCTIONS[function](**options)
    elif isinstance(target, str) and target in FUNCTIONS:
        target = FUNCTIONS[target]()
    return (name, source, target, *comment)


def _component(spec: dict):
    if not isinstance(spec, dict) or spec.get("name") not in COMPONENTS:
        raise SpecificationError(f"no such component: {spec!r}; there are {', '.join(sorted(COMPONENTS))}")
    params = dict(spec.get("params") or {})
    if "mapping" in params:
        params["mapping"] = [_mapping_line(line) for line in params["mapping"]]
    enums = {"missing_column_handling": MissingColumnHandling, "mode": MapperMode if spec["name"] == "Mapper" else AnnotatorMode}
    for option, kind in enums.items():
        if isinstance(params.get(option), str):
            params[option] = kind(params[option])
    return COMPONENTS[spec["name"]](**params)


def build_pipeline(spec: dict, input_df=None) -> Pipeline:
    """A pipeline from its description; the loader ``ByPass`` returns the result."""
    loader = spec.get("loader") or {"name": BYPASS}
    pipeline = Pipeline(input_df, bypass_loader=loader["name"] == BYPASS)
    if input_df is None:
        pipeline.set_extractor(_component(spec["extractor"]))
    pipeline.add_transformers([_component(t) for t in spec.get("transformers") or []])
    return pipeline if pipeline.bypass_loader else pipeline.set_loader(_component(loader))


def post_json(url: str, context: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(context).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request) as answer:
        return json.load(answer)


class PipelineFactory:
    """Pipelines described by a service; ``fetch(url, context)`` may be anything that gives a description."""

    def __init__(self, url: str = "http://localhost:5000/pipeline/get", fetch: Callable[[str, dict], dict] = post_json):
        self.url, self.fetch = url, fetch

    def get_metadata(self, context_variables: dict) -> dict:
        return self.fetch(self.url, context_variables)

    def get_pipeline(self, context_variables: dict) -> Pipeline:
        return build_pipeline(self.get_metadata(context_variables))

    def execute(self, context_variables: dict):
        return self.get_pipeline(context_variables).execute()
