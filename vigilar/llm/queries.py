"""All queries of this subpackage; importing it fills the registry."""

from . import queries_corpus, queries_native, queries_text  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
