"""The stored queries: add, upsert, remove, look up, compact, tune, save and load.

The corpus lives on the driver as a log of (qid, uid, query, active); what is
saved is a Parquet table of it and the configuration.  Anchors are derived
again on use.  Internal ids grow monotonically and are never used twice, also
after compaction.
"""

from __future__ import annotations

import json
import math
from collections.abc import Hashable, Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import from_rows
from ..plans.config import EngineConfig
from ..query import Query
from . import stats
from .percolate import Prepared, frequent_values, percolate, percolate_table, prepare, query_frame


class PercolatorError(ValueError):
    """kind is too_many_queries, prefix_too_long, too_many_clauses or too_many_literals."""

    def __init__(self, kind: str, n: int):
        super().__init__(f"{kind}: {n}")
        self.kind, self.n = kind, n


@dataclass(frozen=True)
class Stored:
    uid: Hashable
    query: Query
    active: bool = True


class Percolator:
    """A corpus of queries.  Without uids of one's own, a query's uid is its qid."""

    def __init__(self, config: EngineConfig | None = None):
        self.config = config or EngineConfig()
        self._log: dict[int, Stored] = {}
        self._qids: dict[Hashable, int] = {}
        self._next = 0
        self.seen: dict[tuple[str, str], float] | None = None  # shares of documents of frequent values
        self._prepared: Prepared | None = None  # until a query is added or removed

    @staticmethod
    def builder(**settings) -> Percolator:
        """``Percolator.builder(n_clause_matchers=2, prefix_sizes=(3, 5))``."""
        return Percolator(EngineConfig(**settings))

    def _check(self, q: Query) -> None:
        c = self.config
        if self._next >= c.max_queries:
            raise PercolatorError("too_many_queries", self._next)
        if len(q.clauses) > c.max_clauses:
            raise PercolatorError("too_many_clauses", len(q.clauses))
        if (n := sum(len(x.literals) for x in q.clauses)) > c.max_literals:
            raise PercolatorError("too_many_literals", n)
        for p in q.prefix_queries():
            if len(p.val) > c.max_prefix:
                raise PercolatorError("prefix_too_long", len(p.val))

    def _append(self, uid: Hashable | None, q: Query) -> Hashable:
        self._check(q)  # before anything changes
        self._prepared = None
        qid, self._next = self._next, self._next + 1
        uid = qid if uid is None else uid
        if uid in self._qids:
            self._retire(self._qids[uid])
        self._log[qid] = Stored(uid, q)
        self._qids[uid] = qid
        return uid

    def _retire(self, qid: int) -> None:
        self._prepared = None
        s = self._log[qid]
        self._log[qid] = Stored(s.uid, s.query, False)

    def add_query(self, q: Query) -> int:
        """Store a query under a new id, which is returned."""
        while self._next in self._qids:
            self._next += 1
        return self._append(None, q)

    def safe_add_query(self, q: Query) -> int | PercolatorError:
        """As ``add_query``, but an error is returned and nothing is stored."""
        try:
            return self.add_query(q)
        except PercolatorError as e:
            return e

    def index_query_uid(self, q: Query, uid: Hashable) -> Hashable:
        """Store under an id of one's own; a query that has it is replaced."""
        return self._append(uid, q)

    def remove_uid(self, uid: Hashable) -> bool:
        """True if there was such a query."""
        qid = self._qids.pop(uid, None)
        if qid is None:
            return False
        self._retire(qid)
        return True

    remove_qid = remove_uid

    def get_query(self, uid: Hashable) -> Query:
        return self._log[self._qids[uid]].query

    def safe_get_query(self, uid: Hashable) -> Query | None:
        return self.get_query(uid) if uid in self._qids else None

    def live(self) -> Iterator[tuple[int, Stored]]:
        return ((i, s) for i, s in self._log.items() if s.active)

    def __len__(self) -> int:
        return len(self._qids)

    def compacted(self, config: EngineConfig | None = None) -> Percolator:
        """Live queries only, with their ids; new ids go on from where they were."""
        out = Percolator(config or self.config)
        out._log = dict(self.live())
        out._qids, out._next, out.seen = dict(self._qids), self._next, self.seen
        return out

    def optimized(self, docs: DataFrame | None = None, fraction: float | None = None) -> Percolator:
        """Compacted, with the configuration that the statistics recommend; with some documents (or a share
        of them), their frequent values choose the anchors from then on."""
        s = self.stats()
        out = self.compacted(EngineConfig(**asdict(self.config) | {"n_clause_matchers": s.recommended_cmcount(), "prefix_sizes": tuple(max(1, x) for x in s.recommended_prefix_sizes())}))
        out.seen = self.seen if docs is None else frequent_values(docs, fraction=fraction)
        return out

    def holes_ratio(self) -> float:
        """Removed queries over all in the log; not a number when it is empty."""
        return sum(not s.active for s in self._log.values()) / len(self._log) if self._log else math.nan

    def stats(self) -> stats.Stats:
        return stats.Stats.of(((s.query, s.active) for s in self._log.values()), self.config.n_clause_matchers)

    def queries(self) -> list[tuple[int, Query]]:
        return [(i, s.query) for i, s in self.live()]

    def frame(self, spark: SparkSession) -> DataFrame:
        """qid, uid (JSON), active, clauses of the log."""
        logged = spark.createDataFrame([(i, json.dumps(s.uid), s.active) for i, s in self._log.items()], "qid bigint, uid string, active boolean")
        return logged.join(query_frame(spark, ((i, s.query) for i, s in self._log.items())), "qid")

    def percolate(self, docs: DataFrame, strategy: str = "anchor", seen=None) -> DataFrame:
        """doc_id, uid of all matching pairs.  Ids of one's own come back in their type, if all have one."""
        if strategy != "anchor":
            got = percolate(docs, self.queries(), strategy, self.config)
        elif seen is not None:
            got = percolate(docs, self.queries(), strategy, self.config, seen)
        else:
            self._prepared = self._prepared or prepare(self.queries(), self.config, self.seen)
            got = percolate(docs, self._prepared)
        uids = {i: s.uid for i, s in self.live()}
        if all(i == u for i, u in uids.items()):
            return got.select("doc_id", F.col("qid").alias("uid"))
        same = {type(u) for u in uids.values()}
        kind = "bigint" if same == {int} else "string"
        ids = docs.sparkSession.createDataFrame([(i, u if kind == "bigint" else str(u)) for i, u in uids.items()], f"qid bigint, uid {kind}")
        return got.join(F.broadcast(ids) if 128 * len(uids) <= self.config.broadcast_bytes else ids, "qid").select("doc_id", "uid")

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).write.mode("overwrite").parquet(f"{path}/queries")
        meta = json.dumps({"config": asdict(self.config), "next": self._next, "seen": self.seen and [[*k, v] for k, v in self.seen.items()]})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Percolator:
        meta = json.loads(spark.read.text(f"{path}/config").first()[0])
        out = Percolator(EngineConfig(**meta["config"] | {"prefix_sizes": tuple(meta["config"]["prefix_sizes"])}))
        for r in spark.read.parquet(f"{path}/queries").orderBy("qid").toLocalIterator():
            uid = json.loads(r["uid"])
            uid = tuple(uid) if isinstance(uid, list) else uid
            out._log[r["qid"]] = Stored(uid, from_rows(r["clauses"]), r["active"])
            if r["active"]:
                out._qids[uid] = r["qid"]
        out._next = meta["next"]
        out.seen = meta["seen"] and {(k, v): share for k, v, share in meta["seen"]}
        return out

    @staticmethod
    def percolate_saved(docs: DataFrame, path: str) -> DataFrame:
        """doc_id, uid (JSON) of all matching pairs with a saved corpus, which stays a table."""
        spark = docs.sparkSession
        meta = json.loads(spark.read.text(f"{path}/config").first()[0])
        config = EngineConfig(**meta["config"] | {"prefix_sizes": tuple(meta["config"]["prefix_sizes"])})
        corpus = spark.read.parquet(f"{path}/queries").where("active")
        got = percolate_table(docs, corpus, config, meta["seen"] and {(k, v): share for k, v, share in meta["seen"]})
        return got.join(corpus.select("qid", "uid"), "qid").select("doc_id", "uid")

    def __str__(self) -> str:
        return f"Percolator-{len(self)}Qs/{self.config.n_clause_matchers}CMs"
