"""The queries of the engine, by name, and their SQL."""

from vellumspark.plans import capture_queries, corpus_queries, file_queries, graph_queries, inventory_queries, record_queries, scalar_queries, search_queries

FLAGSHIP = "search_bm25"
ALL = inventory_queries.QUERIES | capture_queries.QUERIES | scalar_queries.QUERIES | search_queries.QUERIES | graph_queries.QUERIES | corpus_queries.QUERIES | file_queries.QUERIES | record_queries.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
