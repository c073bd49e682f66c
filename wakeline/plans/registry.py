"""A list of queries with their oracle SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str = ""):
        """Register a function of (spark, folder) under its name, with SQL for the same rows if there is any."""

        def add(f):
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add
