"""Operator 9, benchmark decontamination by templates, in SQL functions only.

Texts become templates: names, numbers and units are replaced by typed
placeholders, case and punctuation dropped.  Windows of ``WINDOW`` template
tokens are hashed and joined with the windows of the benchmark; all windows
of every text are looked up.  A document contains an item when at least
``COVERED`` of the item's tokens lie in common windows, or a passage of at
least ``PASSAGE`` tokens running, whatever share of the item that is.  If the item has
placeholders, their values are compared as well: the document must replace
each value of the item by one value of its own throughout (the same question
with other parameters), or use the item's own.  Every place of a document with
enough windows is compared, and one that agrees is enough.

A window with few tokens that are no placeholders (under ``LITERAL``) stands
for the same values only.  The same one with other values counts where the
whole item is there and has at least ``LITERAL_ITEM`` such tokens, so a
question of numbers alone is found verbatim or with other parameters, while
rows of numbers are found verbatim only.  A capitalised word is a name behind
other text only, so an item is looked up in both forms of its first word.

Window hashes are built by doubling, so a window costs three hashes whatever
its width.  The benchmark's windows are broadcast while their bytes, counted,
are within the bound of ``bounded``; beyond it the join shuffles.

Defined results: a null text has no tokens; an item of under ``WINDOW`` tokens
is found by its windows of ``SHORT`` tokens, of which all must be there, and
one of under ``SHORT`` tokens as one window, verbatim only; null items and
items without a letter or digit are ignored; repeated items are each reported;
rows that share a doc_id are looked at one by one and reported as one
document; very long texts are looked up whole; an empty table on either side
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, checkpointed, drop_rows, table, text_hash

WINDOW, SHORT = 8, 4
COVERED = 0.5
#: Tokens running of an item that are enough whatever share of it they are.
PASSAGE = 13
#: Tokens of a window that are no placeholders, at least, of WINDOW, for its placeholders alone to stand for it.
LITERAL = 4
#: Tokens of an item that are no placeholders, at least, for it to be found as a whole by windows with fewer.
LITERAL_ITEM = 2

#: Units that count after a number.
UNITS = "km|kg|cm|mm|mg|ml|m|g|l|miles?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|percent|%|€|°C|°F"
NAME = r"(?<=[\p{Ll},;]\uE001?\x20)\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)*+"
NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"
UNIT = rf"(?<=[0-9]\x20?)(?:{UNITS})(?![\p{{L}}\p{{N}}])"
#: Placeholders begin with a digit, which no other token does once numbers are replaced.
SLOTS = {"0unit": UNIT, "0number": NUMBER, "0name": NAME}
#: A value is marked by a character before its kind and one behind it, none of which is left in the text itself.
OPEN, CLOSE = "\uE000", "\uE001"
KINDS = {"u": "0unit", "n": "0number", "p": "0name"}


def values_of(text: Column) -> Column:
    """The template tokens of a text, with the marked value in place of a placeholder."""
    put = lambda t, k, p: F.regexp_replace(t, p, f"{OPEN}{k}$0{CLOSE}")
    t = F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "  ")
    t = F.when(t.rlike("[0-9]"), put(put(t, "u", UNIT), "n", NUMBER)).otherwise(t)
    return F.regexp_extract_all(F.lower(put(t, "p", NAME)), F.lit(rf"{OPEN}[^{CLOSE}]*+{CLOSE}|[\p{{L}}\p{{N}}]++"), F.lit(0))


def placeholders(values: Column) -> Column:
    """The template tokens of those of ``values_of``."""
    kinds = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (OPEN + k, v)))
    return F.transform(values, lambda v: F.when(v.startswith(OPEN), F.element_at(kinds, F.substring(v, 1, 2))).otherwise(v))


def template(text: Column) -> Column:
    """The template tokens of a text."""
    return placeholders(values_of(text))


STRONG, WEAK, VERBATIM = range(3)


def _forms(text: Column) -> Column:
    """The tokens of an item that stands alone and, if they differ, of one behind other text, where its
    first word is a name if it is capitalised, there or in the document."""
    bare = F.regexp_replace(text, r"^\s+", "")
    behind = lambda t: F.slice(values_of(F.concat(F.lit("a "), t)), F.lit(2), F.size(values_of(F.concat(F.lit("a "), t))))
    return F.array_distinct(F.array(values_of(text), behind(bare), behind(F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, 2, 2**31 - 1)))))


def _doubled(h: Column, by: int, add=F.xxhash64) -> Column:
    """Hashes of windows twice as wide: each with the one ``by`` places on."""
    n = F.greatest(F.size(h) - by, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(by + 1), n), lambda a, b: add(a, b))


def windows(rows: DataFrame, width: int, *keep: str) -> DataFrame:
    """The columns ``keep``, and at, literal (tokens that are no placeholders), typed and verbatim (hashes with
    placeholders and with their values) for each window of ``width`` of ``values``."""
    rows = rows.select(*keep, F.transform(placeholders(F.col("values")), lambda t: F.xxhash64(t)).alias("typed"), F.transform("values", lambda v: F.xxhash64(v)).alias("verbatim"), F.transform("values", lambda v: (~v.startswith(OPEN)).cast("int")).alias("literal"))
    wide = 1
    while wide < width:  # windows overlap where the width is no power of two, but for what counts literal tokens
        by = min(wide, width - wide)
        rows = rows.select(*keep, *(_doubled(F.col(h), by).alias(h) for h in ("typed", "verbatim")), _doubled(F.col("literal"), by, lambda a, b: a + b).alias("literal"))
        wide += by
    # outer, as an inner one adds a filter that computes all of this again
    return rows.select(*keep, F.posexplode_outer(F.arrays_zip("typed", "verbatim", "literal")).alias("at", "w")).where("w is not null").select(*keep, "at", "w.*")


def _hashes(width: int) -> Column:
    """The hashes that stand for a window, and kind: STRONG with placeholders, WEAK with too many of them for
    that, VERBATIM with the values of a weak one."""
    kind = lambda h, k: F.struct(F.col(h).alias("hash"), F.lit(k).alias("kind"))
    if width < SHORT:
        return F.array(kind("verbatim", VERBATIM))
    enough = F.col("literal") >= LITERAL * width // WINDOW
    return F.when(enough, F.array(kind("typed", STRONG))).when(F.col("literal") > 0, F.array(kind("typed", WEAK), kind("verbatim", VERBATIM))).otherwise(F.array(kind("verbatim", VERBATIM)))


def _item_windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, form, ipos, hash, kind."""
    return windows(items, width, "item_id", "form").select("item_id", "form", F.col("at").alias("ipos"), F.explode(_hashes(width)).alias("k")).select("item_id", "form", "ipos", "k.*")


def _tokens_of(at: Column) -> Column:
    """The item's token positions in the windows ``at``."""
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, i + F.col("width") - 1))))


def _n_tokens(at: Column) -> Column:
    """The number of the item's tokens in the windows ``at``, which are in order."""
    new = F.zip_with(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.col("width")))
    return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(new, F.col("width"), lambda n, x: n + x))


def _enough(at: Column) -> Column:
    """Whether the windows ``at`` of the item, in order, are enough of it."""
    return F.when(F.col("n") >= WINDOW, _n_tokens(at) / F.col("n") >= COVERED).otherwise(F.size(at) == F.col("n") - F.col("width") + 1)


def _span(offset: Column, lo: Column, hi: Column) -> Column:
    return F.struct(offset.cast("int").alias("offset"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _passages(offset: Column, at: Column) -> Column:
    """The spans of at least ``PASSAGE`` tokens that windows one after the other make; ``at`` is in order."""
    first = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    last = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) != x + 1, F.lit(True)))
    runs = F.zip_with(first, last, lambda a, b: _span(offset, a, b + F.col("width")))
    return F.filter(runs, lambda r: r["hi"] - r["lo"] >= PASSAGE)


def _pairs(places: DataFrame, doc: list[str]) -> DataFrame:
    """doc, item_id, form with at (the item's windows that are somewhere in the document), n_windows and spans: where
    the document may contain the item, offset and the tokens from lo to before hi whose values count.  That is each
    offset with enough windows or the whole item, or, where only all offsets together have enough, the most frequent
    ones, and each long passage."""
    whole = F.coalesce(F.size("typed") == F.col("n_open"), F.lit(False))  # all windows with a literal token, whatever the values
    places = places.withColumn("whole", whole).withColumn("good", _enough(F.col("at")) | F.col("whole"))
    pair = Window.partitionBy(*doc, "item_id", "form")
    places = places.select("*", F.bool_or("good").over(pair).alias("some"), F.bool_or("whole").over(pair).alias("all"), F.max(F.size("at")).over(pair).alias("most"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("at").over(pair)))).alias("union"))
    counts = F.when(F.col("some"), F.col("good")).otherwise(_enough(F.col("union")) & (F.size("at") == F.col("most")))
    own = F.when(counts, F.array(_span(F.col("offset"), F.lit(0), F.col("n")))).otherwise(F.array().cast("array<struct<offset:int,lo:int,hi:int>>"))
    every = F.sequence(F.lit(0), F.col("n") - F.col("width"))
    places = places.select(*doc, "item_id", "form", "width", F.when(F.col("all"), every).otherwise(F.col("union")).alias("whole_at"), F.size(F.array_union("at", "typed")).alias("size"), F.concat(own, _passages(F.col("offset"), F.col("at"))).alias("here"))
    got = places.groupBy(*doc, "item_id", "form").agg(F.first("whole_at").alias("at"), F.first("width").alias("width"), F.sum("size").alias("n_windows"), F.flatten(F.collect_list("here")).alias("spans"))
    return got.where(F.size("spans") > 0)


def _contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As ``contamination``, with the hash of the text as a key beside doc_id."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", F.posexplode(_forms(F.col("text"))).alias("form", "values")).withColumn("tokens", placeholders(F.col("values"))).withColumn("n", F.size("tokens")).where(F.col("n") > 0)
    wide = F.when(F.col("n") >= WINDOW, WINDOW).otherwise(F.least("n", F.lit(SHORT)))
    literal = lambda tokens: F.size(F.filter(tokens, lambda t: ~t.isin(*SLOTS)))
    open_ = F.filter(F.sequence(F.lit(0), F.col("n") - wide), lambda i: literal(F.slice("tokens", i + 1, wide)) > 0)
    items = checkpointed(items.withColumn("n_open", F.when((literal(F.col("tokens")) >= LITERAL_ITEM) & (F.col("n") >= SHORT), F.size(open_))).withColumn("wide", wide))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), values_of(F.col("text")).alias("values"))
    doc = ["doc_id", "text_hash"]
    found = None
    for (width,) in sorted(items.select("wide").distinct().collect()):  # five widths at most
        own = bounded(checkpointed(_item_windows(items.where(F.col("wide") == width), width)), 48)
        looked = windows(texts, width, *doc).select(*doc, "at", F.explode(_hashes(width)["hash"]).alias("hash"))
        hits = looked.join(own, "hash").select(*doc, "item_id", "form", "ipos", (F.col("at") - F.col("ipos")).alias("offset"), "kind", F.lit(width).alias("width"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        none = F.lit(None).cast("long")
        return docs.select(none.alias("doc_id"), none.alias("text_hash"), none.alias("item_id"), none.cast("double").alias("covered"), none.alias("n_windows"), none.cast("int").alias("slots"), F.lit(True).alias("same_values")).where("false")
    of = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("ipos"))))
    places = checkpointed(found.groupBy(*doc, "item_id", "form", "offset").agg(of(STRONG, VERBATIM).alias("at"), of(STRONG, WEAK).alias("typed"), F.max("width").alias("width")))
    some = bounded(items.select("item_id", "form", "n", "n_open"))
    pairs = _pairs(places.join(some, ["item_id", "form"]), doc)
    pairs = pairs.join(bounded(items.drop("wide", "n_open"), 100 * F.col("n")), ["item_id", "form"])
    pairs = pairs.withColumn("covered", _n_tokens(F.col("at")) / F.col("n")).withColumn("slots", F.size(F.filter(_tokens_of(F.col("at")), lambda i: F.get("tokens", i).isin(*SLOTS))))
    pairs = checkpointed(pairs.drop("at"))
    out = [*doc, "item_id", "covered", "n_windows", "slots"]
    plain = pairs.where("slots = 0").select(*out, F.lit(True).alias("same_values"))
    with_slots = pairs.where("slots > 0")
    return plain if with_slots.isEmpty() else plain.unionByName(_consistent(docs, with_slots, out))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered (share of the item's tokens), n_windows, slots (of the item), same_values."""
    return _contaminated(docs, benchmark).groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("covered", "n_windows", "slots", "same_values")))


def _consistent(docs: DataFrame, pairs: DataFrame, out: list[str]) -> DataFrame:
    """Those pairs whose slots agree in one of the spans: one value of the document for each of the item's."""
    ids = checkpointed(pairs.select("doc_id", "text_hash").distinct()).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("own"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id_of"), text_hash().alias("hash_of"), "text")
    same = lambda a, b: F.col(a[0]).eqNullSafe(F.col(b[0])) & (F.col(a[1]) == F.col(b[1]))
    texts = texts.join(bounded(ids), same(("id_of", "hash_of"), ("id", "own")), "left_semi").dropDuplicates(["id_of", "hash_of"])
    own = texts.select("id_of", "hash_of", values_of(F.col("text")).alias("dv")).withColumn("dt", placeholders(F.col("dv")))
    got = pairs.join(own, same(("doc_id", "text_hash"), ("id_of", "hash_of")))
    # a text's tokens stay in one row, and its spans are looked at there
    item, there = (lambda i: F.get("values", i)), lambda s, i: F.get("dv", i + s["offset"])
    slots = lambda s: F.filter(F.sequence(s["lo"], s["hi"] - 1), lambda i: F.get("tokens", i).isin(*SLOTS) & (F.get("tokens", i) == F.coalesce(F.get("dt", i + s["offset"]), F.lit(""))))
    verbatim = F.exists("spans", lambda s: F.forall(slots(s), lambda i: item(i).eqNullSafe(there(s, i))))
    # as many different pairs of values as values of the item; a value ends with its mark, so pairs can be written together
    one_each = lambda at, s: F.size(F.array_distinct(F.transform(at, lambda i: F.concat(item(i), there(s, i))))) == F.size(F.array_distinct(F.transform(at, item)))
    got = got.withColumn("same_values", verbatim)
    return got.where(F.col("same_values") | F.exists("spans", lambda s: one_each(slots(s), s))).select(*out, "same_values")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text contains no item, with all their columns, also where a row of the same doc_id or without one does."""
    gone = checkpointed(_contaminated(docs, benchmark).select("doc_id", "text_hash").distinct())
    return drop_rows(docs, gone, {"doc_id": docs["doc_id"].cast("long"), "text_hash": text_hash()})


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
