"""All queries over the test tables."""

from . import action_queries, edit_queries, more_queries, queries, selection_queries  # noqa: F401
