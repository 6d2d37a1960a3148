"""All registered queries of the library's own operators, and the SQL that each must equal."""

from . import queries_enroute, queries_excerpts, queries_layout, queries_pages, queries_records, queries_scopes, queries_search, queries_store, queries_text  # noqa: F401
from .catalog import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "heading_facts"
