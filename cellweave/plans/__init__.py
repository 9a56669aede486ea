"""plans of the engine: importing any of them registers all queries."""

from . import registry  # noqa: F401  isort: skip
from . import corpus, evaluation, files, genes, linear, metadata, naming, ranked, records, reports, representation, studies  # noqa: F401
