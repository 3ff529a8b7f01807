"""Registered queries; importing the modules below fills the registry."""

from weftline.plans import label_queries, more_queries, table_queries, text_queries, vector_queries  # noqa: F401
