"""Queries over the driver's tables, by name, and the same in SQL where SQL has it."""

from foliant.plans import box_queries, flow_queries, function_queries, page_queries, rule_queries, seam_queries, structure_queries, text_queries

_MODULES = (text_queries, box_queries, structure_queries, flow_queries, function_queries, seam_queries, rule_queries, page_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
