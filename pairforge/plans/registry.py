"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pairforge.plans import candidate_queries, cluster_queries, entity_queries, eval_queries, form_queries, graph_queries, report_queries, rule_queries, text_queries

QUERIES = {**candidate_queries.QUERIES, **cluster_queries.QUERIES, **text_queries.QUERIES, **entity_queries.QUERIES, **graph_queries.QUERIES, **eval_queries.QUERIES, **rule_queries.QUERIES, **report_queries.QUERIES, **form_queries.QUERIES}
ORACLE = {**candidate_queries.ORACLE, **cluster_queries.ORACLE, **text_queries.ORACLE, **entity_queries.ORACLE, **graph_queries.ORACLE, **eval_queries.ORACLE, **rule_queries.ORACLE, **report_queries.ORACLE, **form_queries.ORACLE}
