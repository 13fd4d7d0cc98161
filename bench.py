"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``percolate_N`` matches all events with N stored queries and counts all
matches.  ``offers_N`` does so with N queries of four clauses (place, flavour,
one more attribute, a limit of cost) and as many offers as there are events.
docs_per_s and pairs_per_s (documents x queries) are for these; index_s, the
seconds to choose the queries' anchors once, is apart; residual_ratio is the
candidates of the anchor join over its true matches.
"""

from __future__ import annotations

import json
import os
import random
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from backmatch import parse_query, queries
from backmatch.operators.percolate import candidates, frequent_values, percolate, prepare
from backmatch.testing import offers, random_offer_query, random_query_string

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SIZES, OFFERS = (1_000, 10_000), (10_000, 50_000, 100_000)
NAMED = ("term", "prefix", "int_lt", "int_bad_text", "nested_not", "h3in", "latlng_within", "parsed", "percolate_anchor", "term_multi_value", "search_dual", "merge_docs")


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, more = {}, {}
    for name in NAMED:
        run = lambda n=name: queries.QUERIES[n](spark, SF).write.format("noop").mode("overwrite").save()
        found[name] = min(timed(run) for _ in range(2))

    def measure(name: str, docs: DataFrame, stored: list, seen: dict, ratio: bool) -> None:
        n, n_docs, held = len(stored), docs.count(), []
        more[f"index_s_{name}_{n}"] = round(timed(lambda: held.append(prepare(stored, seen=seen))), 2)
        took = min(timed(lambda: more.update({f"matches_{name}_{n}": percolate(docs, held[0]).count()})) for _ in range(2))
        found[f"{name}_{n}"] = took
        more.update({f"docs_per_s_{name}_{n}": round(n_docs / took), f"pairs_per_s_{name}_{n}": round(n_docs * n / took)})
        if ratio:
            anchored = percolate(docs, [(i, q) for i, q in stored if any(not x.neg for c in q.clauses for x in c.literals)], seen=seen).count()
            more[f"residual_ratio_{name}_{n}"] = round(candidates(docs, held[0]).count() / max(1, anchored), 2)

    for name, docs in (("percolate", queries.docs_of(spark, SF, "events")), ("offers", offers(queries.table(spark, SF, "events"), "event_id"))):
        docs = docs.repartition(4 * int(CPUS)).cache()
        seen = frequent_values(docs)
        rng = random.Random(42)
        own = queries.generated(max(SIZES)) if name == "percolate" else [(i, random_offer_query(rng)) for i in range(max(OFFERS))]
        for n in SIZES if name == "percolate" else OFFERS:
            measure(name, docs, own[:n] if name == "offers" else queries.generated(n), seen, ratio=n == 10_000)
        docs.unpersist()
    rng = random.Random(0)
    texts = [random_query_string(rng) for _ in range(1000)]
    more["parsed_per_s"] = round(1000 / timed(lambda: [parse_query(t) for t in texts]))
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in found.items()}, "sf": os.path.basename(SF.rstrip("/")), **more}))


if __name__ == "__main__":
    main()
