"""Tuning of the engine; none of it changes an answer."""

from __future__ import annotations

from dataclasses import dataclass

#: Relative costs of a literal's kind, of a negated one and of the clause that matches all.
COSTS = {"term": 10, "h3": 900, "prefix": 1000, "geo": 1000, "lt": 1000, "le": 1000, "eq": 1000, "ge": 1000, "gt": 1000, "all": 10_000}
NEGATED = 100_000
#: Cost of an atom that every document satisfies, for atoms whose share of documents is known or estimated.
WHOLE = 10_000


def literal_cost(kind: str, negated: bool = False, share: float | None = None) -> float:
    """The cost of a literal by its kind, at least that of the share of documents it lets through."""
    return NEGATED if negated else COSTS[kind] if share is None else max(COSTS["term"], share * WHOLE)


@dataclass(frozen=True)
class EngineConfig:
    #: Most clauses of a query that one anchor combines.
    n_clause_matchers: int = 3
    prefix_sizes: tuple[int, ...] = (2, 10, 100, 1000, 2000)
    #: Estimated bytes of keys, and of queries, that may be broadcast; beyond it the joins shuffle.
    broadcast_bytes: int = 128 << 20
    #: Most clauses and literals of one query, and the longest prefix.
    max_clauses: int = 100_000
    max_literals: int = 1_000_000
    max_prefix: int = 2**32 - 1
    max_queries: int = 2**32 - 1

    def __post_init__(self):
        if self.n_clause_matchers < 1 or not self.prefix_sizes or min(self.prefix_sizes) < 1:
            raise ValueError("n_clause_matchers and prefix_sizes must be positive")
