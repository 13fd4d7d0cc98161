"""Operator 5, SimHash near-duplicates by a binary trie self-join.

Fingerprints that differ in at most ``budget`` bits agree on one of
``budget + 1`` blocks, so rows are dealt by (block, its value).  Within a
bucket the sorted fingerprints are a binary trie whose nodes are intervals;
pairs of nodes are traversed together, differing bits are added up, and a
pair is dropped beyond the budget.  A pair is also dropped once all below
both nodes is known to be connected, so a dense group of near copies costs
about its size and not its square.  Each bucket hands out a star for each
class it finds, never pairs.

Equal fingerprints are one row before they are dealt.  ``component_id`` is
then found by :mod:`components`.

For similarity (``keep_representatives``) a link is a Jaccard similarity of
the sets of five-word shingles of at least ``SIMILAR``, compared exactly.
Fingerprints only find the candidates: 256 bits over the set, whose 8 words
of 32 bits are the tries, with a budget of 3 bits each and at most
``SIMILAR_BITS`` differing bits of all 256.  A Jaccard similarity J is a
cosine of 2J/(1+J) and a share acos(2J/(1+J))/pi of differing bits, 39 of 256
at J = 0.8 with a deviation of 6.  A trie misses pairs whose differences are
spread over all its words (9 % at J = 0.8), so ``BANDS`` bands of ``BAND_ROWS``
MinHash values are candidates as well; they miss one pair in 190,000 at 0.8.
Sets of under ``SHORT_SET`` shingles meet by their least hashes, of which two
sets of that similarity always share one.  Candidates are joined to classes,
and within each class the sets themselves decide.

A bucket of a trie and a class of candidates is one task only up to a number
of bytes; :mod:`buckets` deals larger ones in blocks without losing a link.

Defined results: a null text has no words, like an empty one; fingerprint zero
is linked like any other, and so are texts without words; repeated rows are in
one class; rows of one doc_id with different texts are rows of their own; a
row with a null doc_id gets the class of its fingerprint, null if no other
row of the class has an id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import BUCKET_BYTES, dealt, join_unique
from .common import arrow_batches, bounded, checkpointed, drop_rows, lean, table, text_hash
from .components import components

SEED, BITS, BUDGET = 42, 64, 3
#: Of the wide fingerprint: 64-bit words, bits of a trie's word, its budget, differing bits of a link.
WIDE, TRIE_BITS, TRIE_BUDGET, SIMILAR_BITS = 4, 32, 3, 64
SIMILAR_SHINGLE = 5
#: Jaccard similarity of a link, as a fraction; sets below this size meet by their least hashes.
SIMILAR, SHORT_SET = (4, 5), 20
BANDS, BAND_ROWS = 40, 6
#: Rows of complete buckets that are traversed at once; node pairs in a step; pairs of rows compared directly.
ROWS_AT_ONCE, PAIRS_AT_ONCE, LEAF_PAIRS = 30_000, 1 << 16, 36

_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, A-Z folded; of all words if there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    starts = [0, *(e + 1 for e in ends)]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are 1 in over half of the hashes."""
    n = len(hashes)
    if not n:
        return np.uint64(0)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 300:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS_OF for i in range(8)])
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]


def wide_fingerprint(text: str, width: int = SIMILAR_SHINGLE) -> bytes:
    """``WIDE`` words, each the majority over another mixing of the set of shingle hashes."""
    return wide_print(np.unique(shingle_hashes(text, width)))


def wide_print(h: np.ndarray) -> bytes:
    out = [majority(h)]
    for k in range(1, WIDE):
        x = h * np.uint64((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 * 2 * k) % 2**64 | 1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        out.append(majority(x))
    return np.array(out, np.uint64).tobytes()


_rng = np.random.default_rng(SEED)
_BAND_FACTORS = _rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SHIFTS = _rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def candidate_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a sorted set of shingle hashes; similar sets share one."""
    (a, b), n = SIMILAR, len(h)
    keys = [np.zeros(0, np.uint64)]
    if n * a <= (SHORT_SET - 1) * b:  # also the sets that are similar to a short one
        keys.append(h[: n - -(-n * a // b) + 1])
    if n >= SHORT_SET:
        least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
        for i in range(0, n, 256):
            x = h[i : i + 256] ^ _BAND_SHIFTS[:, None]
            x *= _BAND_FACTORS[:, None]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(least, x.min(1), out=least)
        raw = least.reshape(BANDS, BAND_ROWS)
        keys.append(np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(raw)], np.uint64))
    return np.concatenate(keys)


def _connect(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Classes after the links (a, b); each class is named by its smallest row."""
    while True:
        x, y = comp[a], comp[b]
        if not (x != y).any():
            return comp
        np.minimum.at(comp, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(comp, up := comp[comp]):
            comp = up


def trie_classes(key: np.ndarray, word: np.ndarray, prints: np.ndarray, bits: int, budget: int, limit: int) -> np.ndarray:
    """For rows sorted by key and word, the first row of each row's class: rows of one key whose
    words differ in at most ``budget`` bits and whose prints differ in at most ``limit``."""
    n = len(key)
    comp = np.arange(n)
    change = np.arange(n)
    ones: dict[int, np.ndarray] = {}
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    top = np.concatenate([edge[1:], [n]])
    stack = [(0, edge, top, edge, top, np.zeros(len(edge), np.int64))]
    while stack:
        level, al, ah, bl, bh, d = stack.pop()
        if len(al) > PAIRS_AT_ONCE:
            h = len(al) // 2
            stack += [(level, al[:h], ah[:h], bl[:h], bh[:h], d[:h]), (level, al[h:], ah[h:], bl[h:], bh[h:], d[h:])]
            continue
        open_ = ~((change[al] == change[ah - 1]) & (change[bl] == change[bh - 1]) & (comp[al] == comp[bl]))
        size = (ah - al) * (bh - bl)
        leaf = open_ & (size <= LEAF_PAIRS)
        if leaf.any():
            l0, l1, r0, w, s = al[leaf], bl[leaf], bh[leaf] - bl[leaf], size[leaf], np.cumsum(size[leaf])
            i = np.arange(s[-1]) - np.repeat(s - w, w)
            a, b = np.repeat(l0, w) + i // np.repeat(r0, w), np.repeat(l1, w) + i % np.repeat(r0, w)
            a, b = a[a < b], b[a < b]
            near = np.bitwise_count(prints[a] ^ prints[b]).sum(1, dtype=np.int64) <= limit
            if near.any():
                comp = _connect(comp, a[near], b[near])
                change = np.concatenate([[0], np.cumsum(comp[1:] != comp[:-1])])
        go = open_ & ~leaf
        if not go.any():
            continue
        al, ah, bl, bh, d = al[go], ah[go], bl[go], bh[go], d[go]
        if level < bits:
            if level not in ones:
                ones[level] = np.concatenate([[0], np.cumsum((word >> np.uint64(bits - 1 - level)) & np.uint64(1), dtype=np.int64)])
            z, more = ones[level], 1
            am, bm = ah - (z[ah] - z[al]), bh - (z[bh] - z[bl])
        else:
            am, bm, more = (al + ah) // 2, (bl + bh) // 2, 0
        other = al != bl
        parts = [(al, am, bl, bm, d, True), (am, ah, bm, bh, d, True), (al, am, bm, bh, d + more, True), (am, ah, bl, bm, d + more, other)]
        parts = [np.array([x[keep] for x in p[:5]]) for p in parts if (keep := (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget) & p[5] & ~((p[0] == p[2]) & (p[1] - p[0] == 1))).any()]
        if parts:
            stack.append((level + 1, *np.concatenate(parts, axis=1)))
    return comp


def _bucket_stars(batches: Iterator[pa.RecordBatch], words: int, bits: int, budget: int, limit: int) -> Iterator[pa.RecordBatch]:
    """bucket, print, node rows sorted by bucket -> u, v: each member of a class and its smallest node.
    A bucket is a key of 20 bits, whose highest say which word it is of, and a part of 40 bits."""

    def emit(key, prints, node):
        prints = np.ascontiguousarray(prints)
        if bits == 64:
            word = prints[:, 0]
        else:
            halves = prints.view(np.uint32).reshape(len(prints), -1)
            word = halves[np.arange(len(prints)), key >> 56].astype(np.uint64)
        order = np.lexsort((word, key))
        key, word, prints, node = key[order], word[order], prints[order], node[order]
        comp = trie_classes(key, word, prints, bits, budget, limit)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, node)
        v = least[comp]
        apart = v != node
        return pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(v[apart])], ["u", "v"])

    held: list[tuple] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, words)
        held.append((b.column(0).to_numpy().astype(np.int64), raw, b.column(2).to_numpy()))
        rows += b.num_rows
        if rows >= ROWS_AT_ONCE:
            key, prints, node = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.searchsorted(key, key[-1])  # the last bucket may go on
            if last:  # else one bucket is larger than that, and is traversed whole
                yield emit(key[:last], prints[:last], node[:last])
            held, rows = [(key[last:], prints[last:], node[last:])], len(key) - last
    if held:
        yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))


def similar_sets(sets: list[np.ndarray]) -> np.ndarray:
    """For each of some sorted sets of hashes, the first of its component: sets are linked at a
    Jaccard similarity of ``SIMILAR``.  A set is compared with those not reached yet, so a dense
    group costs about its size."""
    a, b = SIMILAR
    comp = np.arange(len(sets))
    sizes = np.array([len(x) for x in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(token) + 1, bool)
    left, flat = np.arange(len(sets)), token
    while len(left):
        queue = [first := left[0]]
        fresh = np.zeros(len(left), bool)
        fresh[0] = True
        while queue:
            if fresh.any():
                flat, left = flat[np.repeat(~fresh, sizes[left])], left[~fresh]
            if not len(left):
                break
            x = queue.pop()
            own = token[begin[x] : begin[x + 1]]
            mark[own] = True
            seen = np.concatenate([[0], np.cumsum(mark[flat])])
            mark[own] = False
            ends = np.cumsum(sizes[left])
            common = seen[ends] - seen[ends - sizes[left]]
            fresh = common * b >= (len(own) + sizes[left] - common) * a
            fresh &= sizes[left] > 0
            comp[left[fresh]] = first
            queue += left[fresh].tolist()
    return comp


def _similar_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, part, node, set rows sorted by these -> u, v: each member of a component and its smallest node."""
    nodes: list[int] = []
    sets: list[np.ndarray] = []

    def decided():
        at = np.array(nodes, np.int64)
        least = at[similar_sets(sets)]
        apart = least != at
        return at[apart], least[apart]

    held = None
    for b in batches:
        out = []
        for key, part, node, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (key, part) != held and nodes:
                out.append(decided())
                nodes, sets = [], []
            held = key, part
            if not nodes or nodes[-1] != node:  # a stranger meets itself
                nodes.append(node)
                sets.append(np.frombuffer(raw, np.uint64))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["u", "v"])
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in decided()], ["u", "v"])


def _differing(a: str, b: str, octets: int) -> Column:
    """The number of bits in which two binary columns differ."""
    word = lambda c, i: F.conv(F.hex(F.substring(c, i, 4)), 16, 10).cast("long")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(1, octets, 4)), F.lit(0))


def linked_classes(prints: DataFrame, similar: bool = False, limit: int | None = None) -> DataFrame:
    """node, component for nodes linked to a smaller one.  ``prints`` has node and print (bytes),
    one row for each print.  With ``similar`` these are candidates, and ``prints`` has keys as well."""
    arrow_batches(prints.sparkSession, rows=20_000)
    octet = lambda i, n: F.conv(F.hex(F.substring("print", i + 1, n)), 16, 10).cast("long")
    if similar:
        words, bits, budget, most = WIDE, TRIE_BITS, TRIE_BUDGET, SIMILAR_BITS
        keys = [F.lit((t << 16) + (k << 8)) + octet(4 * t + k, 1) for t in range(WIDE * 2) for k in range(4)]
    else:
        words, bits, budget, most = 1, BITS, BUDGET, BUDGET
        keys = [F.lit(k << 16) + octet(2 * k, 2) for k in range(4)]
    rows = prints.select(F.explode(F.array(*keys)).alias("key"), "print", "node")
    # a traversal holds a running sum for each bit
    rows, links = dealt(rows, F.lit(8 * words + 40 + 8 * bits), "print", lambda df: df.withColumn("hit", _differing("print", "centre", 8 * words) <= most), limit)
    bucket = (F.shiftleft("key", 40) + F.col("part")).alias("bucket")
    stars = rows.select(bucket, "print", "node").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(lambda b: _bucket_stars(b, words, bits, budget, most)), "u long, v long")
    if links is not None:
        stars = stars.unionByName(links)
    if similar:
        met = prints.select(F.explode("keys").alias("key"), F.col("node").alias("u"))
        least = checkpointed(met.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1"))
        stars = stars.unionByName(join_unique(met, least, "key").where("u <> v").select("u", "v"))
    return components(stars)


def document_prints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the fingerprint's bytes, lowest first."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [majority(shingle_hashes(t or "", width)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(got, pa.binary())], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, print binary")


def set_prints(docs: DataFrame, width: int = SIMILAR_SHINGLE) -> DataFrame:
    """doc_id, hash (of the text), size (bytes of the set), same (a 128-bit hash of the set of shingles),
    print and keys (of candidates)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t or "", width)) for t in b.column(2).to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            keys = pa.array([candidate_keys(h).view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h.nbytes for h in sets], pa.int64()), same, pa.array([wide_print(h) for h in sets], pa.binary()), keys], ["doc_id", "hash", "size", "same", "print", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("hash"), "text").mapInArrow(lean(run), "doc_id long, hash long, size long, same binary, print binary, keys array<long>")


def _with_least(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``nodes`` (node, first, ...) with least, the smallest ``first`` of each node's class."""
    linked = checkpointed(classes.unionByName(classes.select(F.col("component").alias("node"), "component")).distinct())
    least = linked.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(least, "component").select("node", "least")
    return nodes.join(named, "node", "left").withColumn("least", F.coalesce("least", "first"))


def near_duplicate_classes(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id, print, component_id for each row of ``docs``."""
    prints = checkpointed(document_prints(docs))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    named = _with_least(nodes, linked_classes(nodes, limit=limit))
    return join_unique(prints, checkpointed(named.select("print", F.col("least").alias("component_id"), "n")), "print").select("doc_id", "print", "component_id")


def similar_classes(docs: DataFrame, width: int = SIMILAR_SHINGLE, limit: int | None = None) -> DataFrame:
    """doc_id, hash, component_id, first for each row of ``docs``, of links by exact similarity of the sets; first is
    the row that stands for the class, that with the smallest doc_id, then hash (struct of none, doc_id, hash)."""
    prints = checkpointed(set_prints(docs, width))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    nodes = prints.groupBy("same").agg(F.min(first).alias("first"), F.count("*").alias("n"), F.min_by(F.struct("print", "keys", "size"), first).alias("p"))
    nodes = checkpointed(nodes.select("same", "first", "n", "p.*", F.monotonically_increasing_id().alias("node")))
    decided = _similar_links(docs, nodes, linked_classes(nodes, True, limit), width, limit)
    named = _with_least(nodes.select("same", "first", "n", "node"), components(decided))
    return join_unique(prints.select("doc_id", "hash", "same"), checkpointed(named.select("same", "least", "n")), "same").select("doc_id", "hash", F.col("least.doc_id").alias("component_id"), F.col("least").alias("first"))


def _similar_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, width: int, limit: int | None) -> DataFrame:
    """u, v: nodes of one component, by the sets themselves, of those that ``candidates`` puts in one class."""
    members = candidates.unionByName(candidates.select(F.col("component").alias("node"), "component")).distinct()
    members = checkpointed(members.join(nodes.select("node", "first"), "node").select("node", F.col("component").alias("class"), F.col("first.doc_id").alias("id"), F.col("first.hash").alias("hash")))
    arrow_batches(docs.sparkSession)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            fresh = []
            for n in b.column(1).to_pylist():  # repeated rows are one node
                fresh.append(n not in seen)
                seen.add(n)
            if len(seen) > 1_000_000:
                seen.clear()
            b = b.filter(pa.array(fresh, pa.bool_()))
            sets = [np.unique(shingle_hashes(t or "", width)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], ["key", "node", "set"])

    def near(df: DataFrame) -> DataFrame:
        kept = df.columns
        at = [kept.index(c) for c in ("set", "centre")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = zip(*(b.column(i).to_pylist() for i in at), strict=True)
                hit = [similar_sets([np.frombuffer(x, np.uint64) for x in p])[1] == 0 for p in pairs]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit, pa.bool_())], [*kept, "hit"])

        return df.mapInArrow(lean(run), ", ".join(f"{k} {t}" for k, t in df.dtypes) + ", hit boolean")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("own"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash"))
    sets = texts.join(bounded(members), same).select("class", "node", "text").mapInArrow(lean(sets_of), "key long, node long, set binary")
    big = nodes.join(bounded(members.select("node", "class")), "node").groupBy("class").agg(F.sum("size").alias("held"))
    if not big.where(F.col("held") > (BUCKET_BYTES if limit is None else limit)).isEmpty():
        sets = checkpointed(sets)  # read more than once
        rows, links = dealt(sets, F.length("set"), "set", near, limit)
    else:
        rows, links = sets.select("key", "node", "set", F.lit(0).cast("long").alias("part")), None
    stars = rows.select("key", "part", "node", "set").repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(lean(_similar_stars), "u long, v long")
    return stars if links is None else stars.unionByName(links)


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each class of similar documents, with all columns: that of the smallest doc_id.

    Rows of one doc_id with different texts are rows of their own; among them, and among rows without a doc_id, which
    come last, the smallest hash of the text stays.  Of rows with the same doc_id and text one stays, that with
    the smallest hash of all its columns.
    """
    rows = checkpointed(similar_classes(docs))
    at = {"doc_id": docs["doc_id"].cast("long"), "hash": text_hash()}
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    kept = drop_rows(docs, checkpointed(rows.where(own != F.col("first")).select("doc_id", "hash").distinct()), at)
    again = checkpointed(rows.groupBy("doc_id", "hash").count().where("count > 1").select("doc_id", "hash"))
    if again.isEmpty():
        return kept
    repeated = kept.groupBy(F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash")).agg(F.count("*").alias("n"), F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("one"))
    return drop_rows(kept, again, at).unionByName(repeated.where("n > 1").select("one.*"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", fingerprint_text().alias("fingerprint"), "component_id")


def fingerprint_text() -> Column:
    """16 hex digits, the highest byte first."""
    return F.lower(F.concat(*(F.hex(F.substring("print", i, 1)) for i in range(8, 0, -1))))
