"""Statistics of a query corpus: counts, histograms with their moments, costs and recommended settings.

``Stats`` is computed on the driver with the corpus; the functions over a
corpus table (qid, active, clauses, as a saved one has) give the same numbers
as DataFrames, without bringing the corpus to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import COSTS, NEGATED, EngineConfig, literal_cost
from ..query import Clause, Query

#: The ranges and bins of the histograms, and the share of queries that the recommended number of clauses covers.
CLAUSE_BINS, PREFIX_FROM, PREFIX_TO, PREFIX_BINS, COVERED = 50, 1, 100, 4, 0.9
_WIDTH = (PREFIX_TO - PREFIX_FROM) / PREFIX_BINS


@dataclass
class Histogram:
    """Counts of values."""

    counts: Counter = field(default_factory=Counter)

    def add(self, x: float, n: int = 1) -> None:
        self.counts[x] += n

    def n(self) -> int:
        return sum(self.counts.values())

    def mean(self) -> float:
        return sum(x * k for x, k in self.counts.items()) / self.n() if self.counts else math.nan

    def stddev(self) -> float:
        """Of the population."""
        m = self.mean()
        return math.sqrt(sum((x - m) ** 2 * k for x, k in self.counts.items()) / self.n()) if self.counts else math.nan

    def min(self) -> float:
        return min(self.counts, default=math.nan)

    def max(self) -> float:
        return max(self.counts, default=math.nan)

    def quantile_bin(self, share: float) -> int:
        """The whole-number bin that holds the value at this share of the count."""
        upto, want = 0, share * self.n()
        for x, k in sorted(self.counts.items()):
            upto += k
            if upto >= want:
                return int(min(x, CLAUSE_BINS))
        return 0

    def __str__(self) -> str:
        return f"n={self.n()} mean={self.mean():.2f} stddev={self.stddev():.2f} min={self.min()} max={self.max()}"


def clause_cost(c: Clause) -> float:
    """The sum of the costs of its literals, by kind."""
    return sum(literal_cost(x.kind, x.neg) for x in c.literals)


def prefix_bin(n: int) -> int:
    """The bin of a prefix length in bytes; -1 below the range, PREFIX_BINS above it."""
    return -1 if n < PREFIX_FROM else PREFIX_BINS if n >= PREFIX_TO else int((n - PREFIX_FROM) / _WIDTH)


def expands(kind: str, negated: bool) -> bool:
    """Whether documents must yield further keys for such a literal; a clause with a negated one is no anchor at all."""
    return kind not in ("term", "all") and not negated


@dataclass
class Stats:
    """``n_preheaters`` counts the different classes of further keys, ``preheaters_per_query`` those of each query's
    ``slots`` cheapest clauses, repeated ones too."""

    n_queries: int = 0
    n_queries_removed: int = 0
    n_preheaters: int = 0
    clauses_per_query: Histogram = field(default_factory=Histogram)
    preheaters_per_query: Histogram = field(default_factory=Histogram)
    prefix_lengths: Histogram = field(default_factory=Histogram)

    @staticmethod
    def of(queries: Iterable[tuple[Query, bool]], slots: int = EngineConfig.n_clause_matchers) -> Stats:
        out, classes = Stats(), set()
        for q, active in queries:
            out.n_queries += 1
            out.n_queries_removed += not active
            out.clauses_per_query.add(len(q.clauses))
            cheapest = [c for c in sorted(q.clauses, key=clause_cost)[:slots] if not any(x.neg for x in c.literals)]
            expanding = [(x.kind, x.field) for c in cheapest for x in c.literals if expands(x.kind, x.neg)]
            classes.update(expanding)
            out.preheaters_per_query.add(len(expanding))
            for p in q.prefix_queries():
                out.prefix_lengths.add(len(p.val.encode()))
        out.n_preheaters = len(classes)
        return out

    def recommended_cmcount(self) -> int:
        """Clauses that cover 90 % of the queries, one at least."""
        return max(1, self.clauses_per_query.quantile_bin(COVERED))

    def recommended_prefix_sizes(self) -> list[int]:
        """The lower edges of the up to four fullest bins of prefix lengths."""
        if not self.prefix_lengths.counts:
            return list(EngineConfig().prefix_sizes)
        bins: Counter = Counter()
        for n, k in self.prefix_lengths.counts.items():
            bins[prefix_bin(n)] += k
        edge = lambda b: 0 if b < 0 else math.ceil(PREFIX_FROM + b * _WIDTH)
        return sorted({edge(b) for b, _ in sorted(bins.items(), key=lambda x: (-x[1], -x[0]))[:4]})

    def __str__(self) -> str:
        return "\n".join((f"queries: {self.n_queries} added, {self.n_queries_removed} removed", f"classes of further keys: {self.n_preheaters}", f"clauses per query: {self.clauses_per_query}", f"further keys per query: {self.preheaters_per_query}", f"prefix bytes: {self.prefix_lengths}", f"recommended: {self.recommended_cmcount()} clauses, prefixes of {self.recommended_prefix_sizes()}"))


def clause_histogram(corpus: DataFrame) -> DataFrame:
    """n_clauses, n_queries of a corpus with a clauses column."""
    return corpus.groupBy(F.size("clauses").cast("bigint").alias("n_clauses")).agg(F.count("*").alias("n_queries"))


def prefix_bytes(corpus: DataFrame) -> DataFrame:
    """n for each prefix in bytes, negated ones too."""
    return corpus.select(F.explode(F.flatten("clauses")).alias("l")).where("l.kind = 'prefix'").select(F.octet_length(F.col("l.val")).cast("bigint").alias("n"))


def _prefix_bin(n: Column) -> Column:
    return F.when(n < PREFIX_FROM, -1).when(n >= PREFIX_TO, PREFIX_BINS).otherwise(F.floor((n - PREFIX_FROM) / F.lit(_WIDTH))).cast("bigint")


def prefix_histogram(corpus: DataFrame) -> DataFrame:
    """bin, n of the prefix lengths in bytes, negated ones too."""
    return prefix_bytes(corpus).groupBy(_prefix_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("n"))


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """n_queries, n_queries_removed, n_live of a corpus with an active column."""
    return corpus.agg(F.count("*").alias("n_queries"), F.count_if(~F.col("active")).alias("n_queries_removed"), F.count_if("active").alias("n_live"))


def _literal_cost(l: Column) -> Column:  # noqa: E741
    kinds = F.create_map(*(F.lit(x) for kv in COSTS.items() for x in kv))
    return F.when(l["neg"], NEGATED).otherwise(F.element_at(kinds, l["kind"])).cast("bigint")


def clause_costs(corpus: DataFrame) -> DataFrame:
    """qid, at (the clause's place), cost of every clause."""
    each = corpus.select("qid", F.posexplode("clauses").alias("at", "c"))
    return each.select("qid", F.col("at").cast("bigint").alias("at"), F.aggregate("c", F.lit(0).cast("bigint"), lambda n, l: n + _literal_cost(l)).alias("cost"))  # noqa: E741


def _expanding(corpus: DataFrame, slots: int) -> DataFrame:
    """qid, found: kind and field of the expanding literals in each query's ``slots`` cheapest clauses."""
    cost = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, l: n + _literal_cost(l))  # noqa: E731, E741
    ranked = F.array_sort(F.transform("clauses", lambda c, i: F.struct(cost(c).alias("cost"), i.alias("i"))))
    cheapest = F.filter(F.transform(F.slice(ranked, 1, slots), lambda r: F.get("clauses", r["i"])), lambda c: ~F.exists(c, lambda l: l["neg"]))  # noqa: E741
    found = F.filter(F.flatten(cheapest), lambda l: ~l["kind"].isin("term", "all"))  # noqa: E741
    return corpus.select("qid", F.transform(found, lambda l: F.struct(l["kind"].alias("kind"), l["field"].alias("field"))).alias("found"))  # noqa: E741


def preheater_histogram(corpus: DataFrame, slots: int = EngineConfig.n_clause_matchers) -> DataFrame:
    """n_preheaters, n_queries."""
    return _expanding(corpus, slots).groupBy(F.size("found").cast("bigint").alias("n_preheaters")).agg(F.count("*").alias("n_queries"))


def preheater_count(corpus: DataFrame, slots: int = EngineConfig.n_clause_matchers) -> DataFrame:
    """n_preheaters: the different classes."""
    return _expanding(corpus, slots).select(F.explode("found").alias("e")).distinct().agg(F.count("*").alias("n_preheaters"))


def report(corpus: DataFrame, slots: int = EngineConfig.n_clause_matchers) -> DataFrame:
    """what, n, mean, stddev (of the population), min, max of the three histograms."""
    rows = corpus.select(F.lit("clauses per query").alias("what"), F.size("clauses").cast("bigint").alias("n"))
    rows = rows.unionByName(_expanding(corpus, slots).select(F.lit("further keys per query").alias("what"), F.size("found").cast("bigint").alias("n")))
    rows = rows.unionByName(prefix_bytes(corpus).select(F.lit("prefix bytes").alias("what"), "n"))
    return rows.groupBy("what").agg(F.count("*").alias("count"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("stddev"), F.min("n").alias("min"), F.max("n").alias("max"))


def recommended_cmcount(corpus: DataFrame) -> DataFrame:
    """n_clause_matchers, as ``Stats`` recommends it, by a running sum over the histogram's few rows."""
    upto = F.expr("sum(n_queries) OVER (ORDER BY n_clauses)")
    rows = clause_histogram(corpus).select(F.least("n_clauses", F.lit(CLAUSE_BINS)).alias("n_clauses"), upto.alias("upto"), F.expr("sum(n_queries) OVER ()").alias("total"))
    return rows.where(F.col("upto") >= COVERED * F.col("total")).agg(F.greatest(F.min("n_clauses"), F.lit(1)).cast("bigint").alias("n_clause_matchers"))


def recommended_prefix_sizes(corpus: DataFrame) -> DataFrame:
    """prefix_size: the lower edges of the up to four fullest bins."""
    top = prefix_histogram(corpus).orderBy(F.desc("n"), F.desc("bin")).limit(4)
    return top.select(F.when(F.col("bin") < 0, 0).otherwise(F.ceil(F.lit(PREFIX_FROM) + F.col("bin") * F.lit(_WIDTH))).cast("bigint").alias("prefix_size")).distinct()
