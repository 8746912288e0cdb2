"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

1. How often each word of the benchmark occurs in all training documents (one pass).
2. Each benchmark window's rarest words, with their offsets in the window, are its search terms.
3. The index: (term, document, sorted positions) of all search terms' postings in all documents, written as a table.
4. A window's lists, each less its offset, are intersected from the rarest on: what is left are starts.
5. The starts' words are compared with the window's, for an exact phrase; or starts that nearly agree are near matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, heat_limit, materialize, row_name, spread_join, words_column

WINDOW = 10
#: Lists that are intersected before the words themselves are compared.
LISTS = 2
#: Of a near match's words, in a hundred.
NEAR = 70
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z are lower-cased, for counting.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() does the same, and faster, where no other letter has a case to lose."""
    others = F.rlike(text, F.lit(r"[\p{IsUppercase}\p{IsTitlecase}&&[^\x00-\x7F]]"))
    return F.when((F.octet_length(text) == F.length(text)) | ~others, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return words_column(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if bounded(df, row_bytes) else df


def benchmark_windows(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """item and phrase of each window: width consecutive words, or the whole of a shorter item that has a word."""
    w = F.col("_w")
    n = F.greatest(F.size(w) - width, F.lit(0))
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    return items.select("item", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(w, i + 1, width), " "))).alias("phrase")).distinct()


class Index:
    """The postings of the benchmark's search terms in all documents, and the windows that look for them."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, width: int):
        # rows by their own name: others may have the same key, or none
        self.docs = docs.select(row_name(key, text).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
        self.items = materialize(benchmark_windows(benchmark, item, item_text, width), "windows")
        phrases = self.items.select("phrase").distinct()
        terms = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
        vocabulary = small(terms.select("term").distinct(), 200)
        counts = self.docs.select(F.explode(words_of(F.col("_text"))).alias("term")).join(vocabulary, "term").groupBy("term").count()
        # a word that isn't in the training texts makes its window impossible: the inner join and the size drop it
        rare = terms.join(small(materialize(counts, "counts"), 200), "term", "left").groupBy("phrase").agg(F.min(F.coalesce("count", F.lit(0))).alias("_least"), F.slice(F.array_sort(F.collect_list(F.struct("count", "offset", "term"))), 1, LISTS).alias("lists"))
        rare = rare.where("_least > 0").select("phrase", F.posexplode("lists").alias("nth", "t"))
        self.search = materialize(rare.select("phrase", "nth", "t.offset", "t.term", F.size(F.split("phrase", " ")).alias("width")), "search")
        wanted = small(self.search.select("term").distinct(), 200)
        at = self.docs.select("_row", F.posexplode(words_of(F.col("_text"))).alias("pos", "term")).join(wanted, "term")
        self.postings = materialize(at.groupBy("term", "_row").agg(F.array_sort(F.collect_set("pos")).alias("positions")), "postings")

    def starts(self) -> DataFrame:
        """phrase, document, width and lists: by list, where the phrase would start."""
        if bounded(self.search, 300):
            hit = self.postings.join(F.broadcast(self.search), "term")
        else:  # a frequent term's list goes to all tasks
            terms = materialize(self.postings.groupBy("term").count(), "terms")
            hot = terms.where(F.col("count") > heat_limit(terms, terms.agg(F.sum("count")).first()[0]))
            hit = spread_join(self.postings, self.search, ["term"], hot, "_row")
        return hit.select("phrase", "_row", "width", "nth", F.expr("transform(positions, p -> p - offset)").alias("at"))

    def candidates(self) -> DataFrame:
        """Starts that all of a window's lists agree on."""
        s = self.starts()
        first = s.where("nth = 0").drop("nth")
        both = first.join(s.where("nth = 1").select("phrase", "_row", F.col("at").alias("at1")), ["phrase", "_row"])
        alone = first.where("width = 1")
        agree = both.select("_row", "width", F.array_intersect("at", "at1").alias("at")).unionByName(alone.select("_row", "width", "at"))
        return agree.select("_row", "width", F.explode("at").alias("start")).where("start >= 0").distinct()

    def phrases(self) -> DataFrame:
        """Exact matches: document, first word and width of each place where a window of some item stands, with its phrase."""
        by_doc = materialize(self.candidates().groupBy("_row").agg(F.collect_list(F.struct("start", "width")).alias("at")), "candidates")
        size = by_doc.agg(F.coalesce(F.sum(F.size("at") * 40 + 100), F.lit(0))).first()[0]
        found = self.docs.join(F.broadcast(by_doc) if size <= BROADCAST_BYTES else by_doc, "_row")
        found = found.select("_row", words_of(F.col("_text")).alias("_w"), "at").select("_row", F.explode(F.transform("at", lambda a: F.struct(a["start"].alias("start"), a["width"].alias("width"), F.array_join(F.slice(F.col("_w"), a["start"] + 1, a["width"]), " ").alias("phrase")))).alias("a"))
        return found.select("_row", "a.*").join(small(self.items.select("phrase").distinct(), 300), "phrase", "left_semi").distinct()

    def near(self, slop: int) -> DataFrame:
        """Proximity matches: places where a window's two rarest words stand up to slop words nearer or farther than in it, and of all its
        words NEAR in a hundred stand around, slop words beyond its ends included."""
        s = self.starts()
        pair = s.where("nth = 0").join(s.where("nth = 1").select("phrase", "_row", F.col("at").alias("at1")), ["phrase", "_row"])
        near = F.filter("at", lambda a: F.exists("at1", lambda b: (F.abs(a - b) <= slop) & (a != b)))
        found = materialize(pair.select("phrase", "_row", "width", F.explode(near).alias("start")), "near")
        # the texts of few documents are read again
        texts = self.docs.join(small(found.select("_row").distinct(), 16), "_row", "left_semi").dropDuplicates(["_row"]).select("_row", words_of(F.col("_text")).alias("_w"))
        begin = F.greatest(F.lit(1), F.col("start") + 1 - slop)
        around = F.slice("_w", begin, F.col("start") + 1 + F.col("width") + slop - begin)
        asked = F.split("phrase", " ")
        there = F.size(F.filter(asked, lambda w: F.array_contains(F.col("_around"), w)))
        found = found.join(texts, "_row").withColumn("_around", around).where(100 * there >= NEAR * F.size(asked))
        return found.join(self.items, "phrase").select("_row", "item", "start", "width").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = 0) -> DataFrame:
    """All matches: key, item, start (word number), width and kind, phrase or (with slop > 0) near. Repeated rows have their matches once; null keys have theirs.

    Null and empty texts and items match nothing; empty tables give no rows; other columns aren't read.
    """
    index = Index(docs, benchmark, key, text, item, item_text, width)
    out = index.phrases().join(index.items, "phrase").select("_row", "item", "start", "width", F.lit("phrase").alias("kind"))
    if slop:
        out = out.unionByName(index.near(slop).withColumn("kind", F.lit("near")))
    names = index.docs.select("_row", "_key").join(small(materialize(out.select("_row").distinct(), "matched"), 16), "_row", "left_semi").distinct()
    return out.join(names, "_row").select(F.col("_key").alias(key), "item", "start", "width", "kind")


def contaminated(index: Index) -> DataFrame:
    """Rows with a hit: _row, n_hit and items."""
    found = materialize(index.phrases(), "matches")
    before = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("_row", "start", (F.col("start") + F.col("width")).alias("end")).distinct()
    hit = spans.select("_row", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))).alias("n")).groupBy("_row").agg(F.sum("n").cast("long").alias("n_hit"))
    items = found.join(small(index.items, 300), "phrase").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return materialize(hit.join(items, "_row"), "hits")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of any item, all columns as they are; contamination() says what that is."""
    bad = contaminated(Index(docs, benchmark, key, text, item, item_text, width)).select(F.col("_row").alias("_bad"))
    return docs.join(small(bad, 16), row_name(key, text) == F.col("_bad"), "left_anti")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items (sorted ids), contaminated.

    n_hit counts the words inside any occurrence of a window, n_items the items that have such windows. Null and empty
    texts have no words and no hits; items without words have no windows; short items are one window. Each row has its own hits,
    be its key shared or null; repeated rows have equal ones. Empty tables give no rows, or no hits. All texts are read whole. Only
    tables with a bounded size are broadcast (benchmark terms, candidate documents); otherwise the joins shuffle.
    """
    index = Index(docs, benchmark, key, text, item, item_text, width)
    hits = contaminated(index)
    sizes = index.docs.select("_row", "_key", F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    out = sizes.join(small(hits, 1024), "_row", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("_key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
