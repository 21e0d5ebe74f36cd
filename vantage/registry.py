"""All queries of the library by name, and their SQL twins."""

from .queries import components, datasets, evaluation, files, geometry, learning, reconciliation, streams

FLAGSHIP = "pr_auc_per_category"
_MODULES = (evaluation, datasets, reconciliation, geometry, learning, streams, files, components)

QUERIES: dict = {name: f for m in _MODULES for name, (f, _) in m.ALL.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, (_, sql) in m.ALL.items() if sql}
