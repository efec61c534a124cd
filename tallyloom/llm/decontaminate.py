"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Texts are lower-cased (A-Z) and cut into words. A window is WINDOW consecutive words of a benchmark item, or a whole item
of fewer words. The corpus frequencies of the benchmark's words pick the RAREST words of each window; a window with a word
that the corpus lacks cannot occur. Postings (word, document, position) are stored for those words alone. A posting minus
the word's place in the item is the place where the item would begin, so postings of the same document, item and beginning
are the intersection of offset-adjusted lists; a beginning that all rarest words of some window confirm is compared with
the document word by word, and every window that holds there is an occurrence. That loses nothing: an occurrence of a
window puts each of its rarest words at its place.

Defined cases: null and empty texts have no words and are clean; an item without words has no windows; items of equal id
and text count once, items of equal id and different text both match and count as one id; a null id matches but is not
listed; documents of equal id and text get equal results; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import BROADCAST_ROWS, lower_ascii, small_or_plain
from tallyloom.session import cut_lineage

WINDOW = 13
RAREST = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, terms): the distinct items that have words."""
    rows = benchmark.select("item_id", "text").distinct().select("item_id", words(F.col("text")).alias("terms"))
    named = rows.select(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.hex(F.xxhash64("terms"))).alias("item"), "item_id", "terms")
    return cut_lineage(named.filter(F.size("terms") > 0).dropDuplicates(["item"]))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): corpus frequency of the given distinct terms."""
    own = docs.select(F.explode(words(F.col("text"))).alias("term"))
    size = terms.count()
    if size <= BROADCAST_ROWS:
        return own.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term")


def anchors_of(items: DataFrame, counts: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(term, item, place, need): the places of the rarest words of every window that can occur.

    ``need`` is how many of an item's anchor places an occurrence confirms at least.
    """
    places = items.select("item", F.posexplode("terms").alias("place", "term"))
    ranked = places.join(counts, "term", "left").groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("row")
    )
    size = F.least(F.lit(window), F.size("row"))

    def rare(start: Column) -> Column:
        part = F.slice("row", start + 1, size)
        order = F.array_sort(F.transform(part, lambda x: F.struct(x["n"].alias("n"), x["place"].alias("place"))))
        return F.when(order[0]["n"] > 0, F.transform(F.slice(order, 1, rarest), lambda x: x["place"]))

    starts = F.sequence(F.lit(0), F.size("row") - size)
    chosen = F.array_distinct(F.flatten(F.array_compact(F.transform(starts, rare))))
    rows = ranked.select("item", "row", F.least(F.lit(rarest), size).alias("need"), F.explode(chosen).alias("place"))
    return rows.select(F.col("row")[F.col("place")]["term"].alias("term"), "item", "place", "need")


def postings_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, doc_id, h, position) of the given distinct terms."""
    own = _keyed(docs).select("doc_id", "h", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return own.join(small_or_plain(terms, terms.count()), "term")


def beginnings(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, h, item, begin): where an item may begin, after intersecting the offset-adjusted lists."""
    moved = postings.join(small_or_plain(anchors, anchors.count()), "term").select("doc_id", "h", "item", "need", (F.col("position") - F.col("place")).alias("begin"))
    met = moved.groupBy("doc_id", "h", "item", "begin").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    return met.filter(F.col("n") >= F.col("need")).drop("n", "need")


def occurrences(docs: DataFrame, items: DataFrame, begins: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, item, hits): the positions inside exact occurrences of windows, for documents and items that have some."""
    sized = begins.join(items.select("item", F.size("terms").alias("length")), "item")
    wanted = cut_lineage(sized.groupBy("doc_id", "h").agg(F.collect_list(F.struct("item", "begin", "length")).alias("wanted")))
    named = wanted.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    # equal documents give equal rows, which the union of positions later merges
    found = _keyed(docs).join(small_or_plain(named, wanted.count()), on).select("doc_id", "h", words(F.col("text")).alias("own"), "wanted")
    skip = lambda c: F.greatest(F.lit(0), -c["begin"])
    cut = F.transform("wanted", lambda c: F.struct(
        c["item"].alias("item"), c["begin"].alias("begin"), skip(c).alias("skip"), F.slice("own", c["begin"] + skip(c) + 1, c["length"] - skip(c)).alias("got")
    ))
    rows = found.select("doc_id", "h", F.explode(cut).alias("c")).select("doc_id", "h", "c.*").join(items.select("item", "terms"), "item")
    same = F.zip_with("got", F.slice("terms", F.col("skip") + 1, F.size("got")), lambda a, b: a == b)
    size = F.least(F.lit(window), F.size("terms"))
    staged = rows.withColumns({"same": same, "size": size}).filter(F.size("same") >= F.col("size"))
    whole = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("size")), lambda s: ~F.array_contains(F.slice("same", s + 1, F.col("size")), False))
    hits = F.array_distinct(F.flatten(F.transform("whole", lambda s: F.sequence(F.col("begin") + F.col("skip") + s, F.col("begin") + F.col("skip") + s + F.col("size") - 1))))
    return staged.withColumn("whole", whole).filter(F.size("whole") > 0).select("doc_id", "h", "item", hits.alias("hits"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The exact occurrences, and the items they are of."""
    items = items_of(benchmark)
    terms = items.select(F.explode("terms").alias("term")).distinct()
    counts = cut_lineage(term_counts(docs, terms))
    anchors = cut_lineage(anchors_of(items, counts, window))
    postings = postings_of(docs, anchors.select("term").distinct())
    return occurrences(docs, items, beginnings(postings, anchors), window), items


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(doc_id, h, item): documents where all distinct words of a phrase lie within its length plus ``slop`` positions.

    The rarest word of a phrase anchors the search; the postings of its other words are joined on document and stretch of
    positions, a stretch and its neighbours holding every word near enough.
    """
    items = items_of(phrases)
    terms = items.select(F.explode("terms").alias("term")).distinct()
    counts = term_counts(docs, terms)
    postings = cut_lineage(postings_of(docs, terms).distinct())
    span = items.select("item", (F.size("terms") + slop).alias("span"), F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("words"))
    sized = span.join(counts, "term", "left")
    first = sized.groupBy("item").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    anchor = postings.join(first, "term").select("item", "doc_id", "h", F.col("position").alias("at"))
    near = anchor.join(span, "item").withColumn("stretch", F.explode(F.array(*[F.floor(F.col("at") / F.col("span")) + k for k in (-1, 0, 1)])))
    other = postings.join(span.select("item", "term", "span"), "term").select(
        F.col("item").alias("i"), F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("term").alias("w"), "position", F.floor(F.col("position") / F.col("span")).alias("s")
    )
    on = (F.col("item") == F.col("i")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("term") == F.col("w")) & (F.col("stretch") == F.col("s"))
    # every window of `span` positions that holds the anchor begins at one of span places
    begin = F.explode(F.sequence(F.greatest(F.col("position"), F.col("at")) - F.col("span") + 1, F.least(F.col("position"), F.col("at"))))
    met = near.join(other, on).filter(F.abs(F.col("position") - F.col("at")) < F.col("span")).withColumn("begin", begin)
    full = met.select("item", "doc_id", "h", "begin", "term", "words").distinct().groupBy("item", "doc_id", "h", "begin").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    return full.filter(F.col("n") == F.col("words")).select("doc_id", "h", "item").distinct()


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, h, n_words, n_hit, items (sorted ids as text) and contaminated of every row."""
    found, items = phrase_matches(docs, benchmark, window)
    named = found.join(items.select("item", F.col("item_id").cast("string").alias("item_id")), "item")
    hit = named.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    rows = _keyed(docs).select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    result = joined.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return result.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    columns = docs.columns
    bad = cut_lineage(report(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct())
    packed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.struct("*").alias("_doc"))
    rows = packed.join(small_or_plain(bad, bad.count()), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_anti")
    return rows.select(*[F.col("_doc")[c].alias(c) for c in columns])
