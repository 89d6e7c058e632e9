"""Benchmark decontamination by a positional inverted index, with built-in functions only.

The index is partitioned by text: a row holds a text's posting lists, the ascending positions of every distinct word, one list
after the other, and beside them their inverse, the words by position. Document frequencies are sums over the lists.
``search`` returns exact phrase matches: the list of a window's rarest term, less the term's offset, gives the starts;
each is looked for in the next list, that of the second rarest term, and then in all others. A start is in the list of a
term, adjusted by its offset, just if the term stands at start + offset, which the inverse answers in one step, so
only the rarest lists are ever walked. ``near`` returns proximity matches: the rarest terms of an item together in a span.

Scale. The texts are read once, and the index is written once, as Parquet in the shared folder; neither building nor
searching it shuffles a posting, because all lists of a text are in one row. Only matches, frequencies and one
row of numbers for each text are shuffled. Windows are broadcast in blocks of about ``BLOCK_BYTES``; a larger
benchmark takes more blocks, each a scan of the index, so what is broadcast doesn't grow. No list is cut, and a term
that a third of all texts have is walked only where it is the rarest of a window.

Edge cases. Null and empty texts have no words: no hit, no items. Items without words are no windows; items of fewer
words than a window are one window; items without an id count as hits and have no name. Repeated rows are told apart by a row number (``docs`` must be a table as read, so that its
rows have the same numbers each time); repeated items all count, and several rows of one item id are one item. Very long
texts are one row of the index each, whole. Of equally rare terms the first in the window (of proximity: the first in order
of bytes) leads; the matches don't depend on it. Columns besides the key and the text are never read. Empty tables give
no index rows, or no windows, and so no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhold.llm.common import lower_ascii, staged, without

#: Everything but digits, a-z and non-ASCII characters, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of test windows or terms, that are broadcast at once.
BLOCK_BYTES = 32_000_000


def words(text: Column) -> Column:
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), GAP), "")


def _blocks(table: DataFrame, key: str, size: Column) -> Iterator[DataFrame]:
    """The rows of a staged table, by their key's hash, in blocks of about ``BLOCK_BYTES``, each to be broadcast."""
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        yield F.broadcast(table.where(F.pmod(F.xxhash64(key), F.lit(n)) == k))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def windows(items: DataFrame, size: int = 10, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window (a number), terms, item_ids of each distinct window; staged."""
    found = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    found = found.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))).alias("at"))
    found = found.groupBy(F.slice("words", F.col("at") + 1, F.lit(size)).alias("terms")).agg(F.collect_set("item_id").alias("item_ids"))
    return staged(found.select(F.monotonically_increasing_id().alias("window"), "terms", "item_ids"), "windows")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, n_words, words (by position), places and opens of every row; staged.

    ``places`` are the posting lists of the text's words, one after the other, each ascending; ``opens`` is where each begins.
    Positions are sorted by half of their word's hash, as numbers. Words that share it lie mixed, and then a word has several lists.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), words(F.col(text_col).cast("string")).alias("words"))
    # the high half of the word's hash, and the position
    key = F.transform("words", lambda w, i: F.xxhash64(w).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(i))
    rows = rows.withColumn("places", F.transform(F.sort_array(key), lambda k: k.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")))

    def word(k: Column) -> Column:
        return F.get("words", F.get("places", k))

    opens = F.filter(F.sequence(F.lit(0), F.size("places") - 1), lambda k: (k == 0) | (word(k) != word(k - 1)))
    opens = F.when(F.size("places") > 0, opens).otherwise(F.array().cast("array<int>"))
    return staged(rows.select("uid", "doc_id", F.size("words").cast("long").alias("n_words"), "words", "places", opens.alias("opens")), "index", compression="zstd")


def _lists(index: DataFrame) -> DataFrame:
    """uid, words, places, term, first, n: a row for each posting list, of n places from first on."""
    rows = index.select("uid", "words", "places", "opens", F.posexplode("opens").alias("j", "first"))
    n = F.coalesce(F.get("opens", F.col("j") + 1), F.size("places")) - F.col("first")
    return rows.select("uid", "words", "places", F.get("words", F.get("places", "first")).alias("term"), "first", n.alias("n"))


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: the number of postings of each of the terms; staged."""
    terms = staged(terms.select("term").distinct(), "terms")
    parts = [_lists(index).select("term", "n").join(block, "term").groupBy("term").agg(F.sum("n").alias("n")) for block in _blocks(terms, "term", F.octet_length("term") + 32)]
    found = _union(parts) if parts else terms.select("term", F.lit(None).cast("long").alias("n")).where("false")
    return staged(terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "frequencies")


def _seeds(index: DataFrame, leads: DataFrame) -> DataFrame:
    """The postings of the lists that ``leads`` (term and more) begin with: uid, words, pos and the columns of leads.

    A broadcast join and two generators in a row: the words are at hand but never copied.
    """
    own = [c for c in leads.columns if c != "term"]
    return _lists(index).join(leads, "term").select("uid", "words", F.explode(F.slice("places", F.col("first") + 1, F.col("n"))).alias("pos"), *own)


def search(index: DataFrame, wins: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Occurrences of windows: uid, start, length, window; staged. ``counts`` are the frequencies of their terms, if known."""
    terms = wins.select("window", F.posexplode("terms").alias("off", "term"))
    ranked = terms.join(frequencies(index, terms) if counts is None else counts, "term").groupBy("window").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("ranks"))
    ranked = ranked.where(F.col("ranks")[0]["n"] > 0).join(wins, "window")
    leads = ranked.select(F.col("ranks")[0]["term"].alias("term"), "window", F.col("ranks")[0]["off"].alias("by"), F.get("ranks", F.lit(1))["off"].alias("off2"), F.get("ranks", F.lit(1))["term"].alias("term2"), "terms")
    leads = staged(leads, "leads")
    parts = []
    for block in _blocks(leads, "window", F.octet_length(F.array_join("terms", " ")) + 16 * F.size("terms") + 96):
        start = F.col("pos") - F.col("by")
        second = F.col("off2").isNull() | F.coalesce(F.get("words", start + F.col("off2")) == F.col("term2"), F.lit(False))
        # the lists that are left, in one comparison
        rest = F.slice("words", start + 1, F.size("terms")) == F.col("terms")
        met = _seeds(index, block).where((start >= 0) & second).where(rest)
        parts.append(met.select("uid", start.alias("start"), F.size("terms").alias("length"), "window"))
    none = leads.select("window").where("false").selectExpr("0L as uid", "0 as start", "0 as length", "window")
    return staged(_union(parts) if parts else none, "matches")


def near(index: DataFrame, items: DataFrame, counts: DataFrame | None = None, *, span: int = 20, rarest: int = 3, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Proximity matches: uid, item_id, pos of its rarest term where its ``rarest`` rarest terms lie within ``span`` words of it,
    or as far as in the item if that is more, in any order. A term without postings is the rarest and isn't met."""
    terms = items.select(F.col(id_col).cast("string").alias("item_id"), F.posexplode(words(F.col(text_col).cast("string"))).alias("off", "term"))
    terms = staged(terms.groupBy("item_id", "term").agg(F.min("off").alias("off")), "item-terms")
    ranked = terms.join(frequencies(index, terms) if counts is None else counts, "term").groupBy("item_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term", "off"))), 1, rarest).alias("ranks"))
    lead = F.col("ranks")[0]
    reach = F.greatest(F.lit(span), F.array_max(F.transform("ranks", lambda r: F.abs(r["off"] - F.col("ranks")[0]["off"]))))
    leads = ranked.where(lead["n"] > 0).select(lead["term"].alias("term"), "item_id", reach.alias("reach"), *(F.get("ranks", F.lit(k))["term"].alias(f"term{k}") for k in range(1, rarest)))
    leads = staged(leads, "near-leads")
    parts = []
    for block in _blocks(leads, "item_id", F.lit(64 * (rarest + 2))):
        first = F.greatest(F.col("pos") - F.col("reach"), F.lit(0))
        about = F.slice("words", first + 1, F.col("pos") + F.col("reach") - first + 1)
        met = _seeds(index, block)
        for k in range(1, rarest):
            met = met.where(F.coalesce(F.array_contains(about, F.col(f"term{k}")), F.lit(True)))
        parts.append(met.select("uid", "item_id", "pos"))
    return _union(parts) if parts else leads.selectExpr("0L as uid", "item_id", "0 as pos").where("false")


def hits(docs: DataFrame, items: DataFrame, *, size: int = 10, span: int = 20, rarest: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: uid, doc_id, n_words, n_hit, item_ids (strings, sorted), contaminated; and near_ids, the items that are
    met in proximity (strings, sorted)."""
    wins, index = windows(items, size), build_index(docs, id_col=id_col, text_col=text_col)
    # every word of an item is in a window of it
    counts = frequencies(index, wins.select(F.explode("terms").alias("term")))
    close = near(index, items, counts, span=span, rarest=rarest)
    found = search(index, wins, counts)
    order = W.partitionBy("uid").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = found.select("uid", "start", "length").distinct().withColumn("before", F.max(end).over(order))
    parts = [spans.groupBy("uid").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("before", F.lit(0))))).alias("n_hit"))]
    named = found.select("uid", "window").distinct()
    names = [named.join(block, "window").select("uid", F.explode("item_ids").alias("item_id")) for block in _blocks(wins.select("window", "item_ids"), "window", F.octet_length(F.array_join("item_ids", ",")) + 16 * F.size("item_ids") + 32)]
    for pairs, name in ((_union(names) if names else named.selectExpr("uid", "cast(null as string) as item_id").where("false"), "item_ids"), (close, "near_ids")):
        parts.append(pairs.groupBy("uid").agg(F.sort_array(F.collect_set("item_id")).alias(name)))
    out = index.select("uid", "doc_id", "n_words")
    for part in parts:
        out = out.join(part, "uid", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return out.select("uid", "doc_id", "n_words", n_hit.alias("n_hit"), (n_hit > 0).alias("contaminated"), *(F.coalesce(name, none).alias(name) for name in ("item_ids", "near_ids")))


def clean(docs: DataFrame, items: DataFrame, *, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window, all columns as they are."""
    found = search(build_index(docs, id_col=id_col, text_col=text_col), windows(items, size))
    return without(docs, found.select("uid").distinct())


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and n_near, the number of items met in proximity."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", F.size("near_ids").cast("long").alias("n_near"))
