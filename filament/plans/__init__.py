"""Queries by topic; every module has QUERIES (name -> function) and SQL (name -> DuckDB SQL)."""


def registry():
    """(QUERIES, SQL, decorator): the decorator registers a query, with its SQL if there is one."""
    queries: dict = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query
