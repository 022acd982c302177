"""All registered queries."""
from . import catalog_eval, catalog_models, catalog_series, catalog_sources  # noqa: F401
from .bindings import REGISTRY  # noqa: F401
