"""Registered queries and the SQL that says the same."""

from weftline.plans import camera, checks, entities, passages, records, sections, texts, timeline  # noqa: F401
from weftline.plans.registry import QUERIES, SQL  # noqa: F401
