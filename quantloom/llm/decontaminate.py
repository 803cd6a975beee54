"""Benchmark decontamination: which windows of benchmark items occur in which documents.

A window occurs only where all its shingles do, so its rarest shingle is the one prefix token that
must be joined.  Shingles are ordered by their count over all documents.  A joined position fixes
where the window would have to start; length and position bounds and an exact comparison decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import ascii_lower

WINDOW, SHINGLE = 10, 3
#: Fixed value: what stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to this many rows of the benchmark's side are sent to all tasks; beyond, both sides are shuffled.
SMALL = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text)


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: window_id, item_id, words, n (words in it), width (of its shingles).  A shorter item is one window."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("n", F.least(F.size("words"), F.lit(window)))
    w = w.select("item_id", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    w = w.select("item_id", F.slice("words", F.col("at"), F.col("n")).alias("words"), "n")
    return w.select(F.xxhash64(F.array_join("words", " ")).alias("window_id"), "item_id", "words", "n",
                    F.least(F.col("n"), F.lit(SHINGLE)).alias("width")).distinct()


def exploded(docs: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """A row for every shingle of every document: the ``keep`` columns, pos and key.

    Words are zipped with their next ones, so each row carries only its own shingle; ``keep`` may
    hold the whole word array, which costs nothing as long as no row with it is stored.
    """
    words = F.col("words")
    ahead = [F.slice(words, k + 1, F.size(words)) if k else words for k in range(max(widths))]
    rows = docs.select(*keep, F.posexplode(F.arrays_zip(*ahead)).alias("pos", "w"))
    names = rows.schema["w"].dataType.names
    parts = [F.col("w").getField(name) for name in names]
    keys = [F.when(parts[w - 1].isNotNull(), F.xxhash64(*parts[:w])) for w in widths]
    if len(keys) == 1:
        rows = rows.select(*keep, "pos", keys[0].alias("key"))
    else:
        rows = rows.select(*keep, "pos", F.explode(F.array(*keys)).alias("key"))
    return rows.where(F.col("key").isNotNull())


def occurrences(docs: DataFrame, windows: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, text_key, window_id, start, n of every window in every document (doc_id, text)."""
    spark = docs.sparkSession
    shingles = windows.select("window_id", "words", "n", "width").dropDuplicates(["window_id"]).withColumn(
        "offset", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))))
    key = [F.when(F.col("width") == w, F.xxhash64(*[F.get("words", F.col("offset") + k) for k in range(w)])) for w in range(1, SHINGLE + 1)]
    shingles = stage(shingles.withColumn("key", F.coalesce(*key)), "leak-shingles")
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())  # at most SHINGLE values
    texts = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    if not widths:
        return spark.createDataFrame([], "doc_id long, text_key long, window_id long, start int, n int")

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= small else df

    keys = shingles.select("key").distinct()
    counts = exploded(texts, widths).join(sent(keys), "key").groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    rarest = shingles.join(counts, "key", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "key", "offset")).alias("rare")).where("rare.seen > 0")
    anchors = stage(rarest.join(shingles.dropDuplicates(["window_id"]).select("window_id", F.col("words").alias("window"), "n"), "window_id")
                    .select(F.col("rare.key").alias("key"), F.col("rare.offset").alias("offset"), "window_id", "window", "n"), "leak-anchors")
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("n") <= F.size("words")) & (F.slice("words", start + 1, F.col("n")) == F.col("window"))
    found = ["doc_id", "text_key", "window_id", start.alias("start"), "n"]
    if anchors.count() <= small:
        return exploded(texts, widths, "doc_id", "text_key", "words").join(F.broadcast(anchors), "key").where(
            F.when(start >= 0, fits).otherwise(False)).select(*found)
    # a large benchmark: positions are shuffled by shingle, then the candidates meet their text
    places = exploded(texts, widths, "doc_id", "text_key").join(anchors.select("key", "offset", "window_id"), "key")
    places = places.where(start >= 0).select("doc_id", "text_key", "window_id", "pos", "offset").distinct()
    places = places.join(anchors.select("window_id", "window", "n"), "window_id")
    other = places.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "window_id", "window", "n", "pos", "offset")
    both = texts.dropDuplicates(["doc_id", "text_key"]).join(other, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("t")))
    return both.where(F.when(start >= 0, fits).otherwise(False)).select(*found)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, small: int = SMALL) -> DataFrame:
    """doc_id, text_key, n_hit, items (sorted texts) of the documents in which a window occurs."""
    windows = stage(windows_of(items.select("item_id", "text"), window), "leak-windows")
    found = occurrences(docs, windows, small)
    found = found.join(windows.select("window_id", "item_id"), "window_id")
    by_doc = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    def step(acc, s):
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"),
                        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]
    return by_doc.select("doc_id", "text_key", covered.cast("long").alias("n_hit"), "items")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, small: int = SMALL) -> DataFrame:
    """doc_id, n_words, n_hit, items of every document (doc_id, text) against ``items`` (item_id, text).

    Null and empty texts have no words and no hits; items without words are ignored, items with fewer
    words than the window are one window.  Null item ids hit words but are not listed; repeated items
    count once.  Repeated documents each get their own row; rows that share a doc_id but not the text
    are kept apart.  Empty tables give no hits or no rows.  Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    h = hits(docs, items, window, small).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "n_hit", "items")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).alias("n_words"))
    rows = rows.join(h, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("t")), "left")
    return rows.select("doc_id", F.greatest(F.col("n_words"), F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"))
