"""Benchmark decontamination over a distributed positional inverted index.

The index stores a posting (term, document, position) for every word of the
corpus, and one end posting per document that gives its word count; it is
written once and serves any benchmark. For every window of an item the posting
lists of its rarest terms, counted over the whole corpus, are adjusted by the
terms' offsets and intersected; windows that overlap mostly have the same
rarest terms, which then are looked up once. The alignments (item, document,
shift) that are left are held against the words themselves, which gives the
exact phrase matches. ``proximity_matches`` reads the same index for items
whose rarest terms stand close together in any order.

DataFrame and SQL functions only. The benchmark's terms and blocks are broadcast
up to a checked size and joined by shuffles beyond it.

Defined results: null or wordless texts have no words, and such items no
windows; an item of fewer words than a window is one window; a null item_id
marks hits but isn't listed; repeated items count once, repeated documents each
get their row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Written, only

#: A benchmark-side table of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000
#: A table of document keys of at most so many rows is broadcast.
BROADCAST_KEYS = 400_000
_NULL_ID = -(1 << 63)
_END = ""  # stands in for the term of the posting after a document's last word


def raw_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text as if A-Z were lower case, in their own case."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)), F.array().cast("array<string>"))


def lower_ascii(word: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, lower))


def _checked(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def term_key(word: Column) -> Column:
    """A word's 64-bit hash stands for it in the index; exact matches are held against the words themselves."""
    return F.xxhash64(word)


class PositionalIndex:
    """Postings of every word of a corpus, stored once for any number of benchmarks."""

    def __init__(self, docs: DataFrame):
        self._docs = only(docs, "doc_id", "text").select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64("text").alias("r"), "text"
        )
        words = self._docs.select("d", "r", F.posexplode(F.array_append(raw_words(F.col("text")), F.lit(_END))).alias("pos", "word"))
        self._postings = Written(words.select(term_key(lower_ascii(F.col("word"))).alias("t"), "d", "r", "pos"), "postings")

    @property
    def postings(self) -> DataFrame:
        """t (term key), d and r (document id and text hash), pos."""
        return self._postings.df

    def documents(self) -> DataFrame:
        """d, r, n_words of every document row."""
        return self.postings.filter(F.col("t") == term_key(F.lit(_END))).select("d", "r", F.col("pos").cast("long").alias("n_words"))

    def texts(self) -> DataFrame:
        return self._docs


class Lookup:
    """A benchmark held against an index: its items, and the postings of its terms."""

    def __init__(self, index: PositionalIndex, benchmark: DataFrame):
        self.index = index
        items = only(benchmark, "item_id", "text").select("item_id", F.transform(raw_words(F.col("text")), lower_ascii).alias("w")).distinct()
        self._items = Written(items.filter(F.size("w") > 0).select(F.monotonically_increasing_id().alias("b"), "item_id", "w", F.size("w").alias("n")), "items")
        self._terms = Written(self.items.select(F.explode("w").alias("term")).distinct().select("term", term_key(F.col("term")).alias("t")), "terms")
        keys = self._terms.df.select("t").distinct()
        counts = index.postings.join(_checked(keys, self._terms.df.count(), BROADCAST_ROWS), "t").groupBy("t").agg(F.count(F.lit(1)).alias("n_corpus"))
        self._counts = Written(self._terms.df.join(counts, "t", "left").select("term", "t", F.coalesce("n_corpus", F.lit(0)).alias("n_corpus")), "term-counts")

    @property
    def items(self) -> DataFrame:
        """b (key), item_id, w (words), n."""
        return self._items.df

    @property
    def counts(self) -> DataFrame:
        """term, t, n_corpus: occurrences in the whole corpus."""
        return self._counts.df

    def windows(self, window: int) -> DataFrame:
        """b, s (start of a window in the item), j (place in the item), t, n_corpus of all words of all windows."""
        starts = self.items.select("b", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))).alias("s"))
        words = starts.select("b", "s", F.posexplode(F.slice("w", F.col("s") + 1, window)).alias("j", "term"))
        return words.withColumn("j", F.col("j") + F.col("s")).join(self.counts, "term")


def rarest_terms(asked: Lookup, window: int, lists: int) -> DataFrame:
    """p (a set of places that is the rarest of some window), b, k, j, t; k_all: the places of the set."""
    of_window = Window.partitionBy("b", "s")
    ranked = asked.windows(window).withColumn("k", F.row_number().over(of_window.orderBy("n_corpus", "j"))).filter(F.col("k") <= lists)
    sets = ranked.groupBy("b", "s").agg(F.array_sort(F.collect_list(F.struct("j", "t"))).alias("places")).select("b", "places").distinct()
    keyed = sets.select(F.xxhash64("places").alias("p"), "b", F.size("places").alias("k_all"), F.posexplode("places").alias("k", "place"))
    return keyed.select("p", "b", "k_all", "k", "place.j", "place.t")


def align(asked: Lookup, window: int = 10, lists: int = 2) -> DataFrame:
    """b, d, r, shift: where the rarest terms of a window all stand as in the item."""
    probes = Written(rarest_terms(asked, window, lists), "probes").df
    probes = _checked(probes, probes.count(), BROADCAST_ROWS)
    met = asked.index.postings.join(probes, "t").select("p", "b", "d", "r", (F.col("pos") - F.col("j")).alias("shift"), "k", "k_all")
    held = met.groupBy("p", "b", "d", "r", "shift").agg(F.first("k_all").alias("k_all"), F.expr("bit_or(shiftleft(1L, k))").alias("which"))
    return held.filter(F.expr("bit_count(which) = k_all")).select("b", "d", "r", "shift").distinct()


def phrase_matches(asked: Lookup, window: int = 10, lists: int = 2) -> DataFrame:
    """d, r, item_id, b, runs: exact matches as word intervals [lo, hi) of the document, each a run of whole windows."""
    aligned = Written(align(asked, window, lists), "alignments").df
    keys = Written(aligned.select("d", "r").distinct(), "aligned-documents").df
    texts = asked.index.texts().join(_checked(keys, keys.count(), BROADCAST_KEYS), ["d", "r"], "left_semi")
    words = Written(texts.select("d", "r", F.transform(raw_words(F.col("text")), lower_ascii).alias("words")), "aligned-words").df
    items = _checked(asked.items, asked.items.count(), BROADCAST_ROWS)
    pair = aligned.join(words, ["d", "r"]).select("d", "r", "b", "shift", "words").join(items, "b")
    start = F.greatest(F.col("shift"), F.lit(0))
    own = F.expr("slice(words, greatest(shift, 0) + 1, greatest(n + least(shift, 0), 0))")
    item = F.expr("slice(w, greatest(-shift, 0) + 1, greatest(n + least(shift, 0), 0))")
    same = F.array_join(F.zip_with(own, item, lambda x, y: F.when(x.eqNullSafe(y), "1").otherwise("0")), "")
    marked = pair.select("d", "r", "b", "item_id", start.alias("start"), F.least(F.col("n"), F.lit(window)).alias("need"), same.alias("same"))
    marked = marked.filter(F.expr("locate(repeat('1', need), same) > 0"))
    runs = F.expr(
        "transform(filter(sequence(1, length(same)), i -> (i = 1 or substring(same, i - 1, 1) = '0') and substring(same, i, need) = repeat('1', need)),"
        " i -> named_struct('lo', start + i - 1, 'hi', start + locate('0', concat(same, '0'), i) - 1))"
    )
    return marked.select("d", "r", "b", "item_id", runs.alias("runs")).filter(F.size("runs") > 0)


def covered(runs: Column) -> Column:
    """Places in the union of intervals (lo, hi)."""
    zero = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["hi"]).alias("end"), (a["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], a["end"]), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(runs), zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, lists: int = 2) -> DataFrame:
    """Per document row: doc_id, r (hash of its text), n_words, n_hit, item_ids (sorted as strings), n_items, contaminated."""
    index = PositionalIndex(docs)
    found = phrase_matches(Lookup(index, benchmark), window, lists).groupBy("d", "r").agg(
        covered(F.flatten(F.collect_list("runs"))).alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    whole = index.documents().join(found, ["d", "r"], "left")
    return whole.select(
        F.when(F.col("d") != _NULL_ID, F.col("d")).alias("doc_id"),
        "r",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def proximity_matches(asked: Lookup, terms: int = 5, span: int = 20) -> DataFrame:
    """doc_id, item_id, pos: from pos on, ``span`` words hold the item's ``terms`` rarest different words in any order (all, if it has fewer)."""
    of_item = Window.partitionBy("b")
    word = asked.items.select("b", "item_id", F.explode(F.array_distinct("w")).alias("term")).join(asked.counts, "term")
    rare = word.withColumn("k", F.row_number().over(of_item.orderBy("n_corpus", "term"))).filter(F.col("k") <= terms).withColumn("k_all", F.count(F.lit(1)).over(of_item))
    rare = Written(rare.select("b", "item_id", "t", "k_all"), "rare-terms").df
    met = asked.index.postings.join(_checked(rare, rare.count(), BROADCAST_ROWS), "t")
    ahead = Window.partitionBy("b", "d", "r").orderBy("pos").rangeBetween(0, span - 1)
    near = met.withColumn("held", F.size(F.collect_set("t").over(ahead))).filter(F.col("held") == F.col("k_all"))
    return near.select(F.when(F.col("d") != _NULL_ID, F.col("d")).alias("doc_id"), "item_id", "pos")
