"""Language identification with a bit-sliced Bloom filter of character trigrams.

Every slot of the filter holds one bit per language, so one lookup (the AND of K slots) gives the
set of all languages whose trigram list contains a trigram.  A text's bits are counted per language,
corrected for the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, unit

#: About this many training documents per language, picked by a hash of their id.
PER_LANG = 3000
#: Trigrams kept for the filter, those seen most often.
GRAMS = 60_000
#: A trigram belongs to a language if its share there is at least this part of its largest share.
PART = 0.25
SLOTS, HASHES = 1 << 20, 3
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Long texts are read in pieces of this many characters, overlapping by one trigram.
PIECE = 1 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Packed trigrams of the lower-cased letters, with one blank for every run of other characters."""
    for at in range(0, max(len(text), 1), PIECE):
        piece = text[max(at - 2, 0):at + PIECE].lower()
        c = np.frombuffer(f" {piece} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
        c = np.where(letters()[c], c, np.uint64(32))
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        if len(c) > 2:
            yield c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)


def slots(grams: np.ndarray) -> list[np.ndarray]:
    return [(grams * m) >> np.uint64(64 - 20) for m in MULTIPLIERS[:HASHES]]


class Filter:
    """The bit-sliced Bloom filter.  ``belongs``: trigram -> positions of its languages."""

    def __init__(self, langs: list[str], grams: np.ndarray, belongs: np.ndarray):
        self.langs = langs
        self.table = np.zeros((SLOTS, -(-len(langs) // 8)), dtype=np.uint8)
        bits = np.packbits(belongs, axis=1, bitorder="little")
        for s in slots(grams):
            np.bitwise_or.at(self.table, s, bits)
        filled = np.unpackbits(self.table, axis=1, count=len(langs), bitorder="little").mean(axis=0)
        self.wrong = filled ** HASHES

    def shares(self, text: str) -> np.ndarray:
        """Per language, the share of the text's trigrams that it contains, less false positives."""
        hits, n = np.zeros(len(self.langs)), 0
        for grams in trigrams(text):
            a, b, c = slots(grams)
            bits = self.table[a] & self.table[b] & self.table[c]
            for i in range(len(self.langs)):
                hits[i] += np.count_nonzero(bits[:, i >> 3] & (1 << (i & 7)))
            n += len(grams)
        return np.clip((hits / max(n, 1) - self.wrong) / (1 - self.wrong), 0, 1)


def learn(docs: DataFrame) -> Filter | None:
    """Fit on a bounded sample of labelled training rows (doc_id, text, lang); None without any."""
    train = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    rate = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(PER_LANG / sizes[lang]))])
    sample = train.where(unit(F.col("doc_id"), "lang:") < rate[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                found: dict[int, int] = {}
                for text in texts:
                    for grams in trigrams(text):
                        for g, n in zip(*(x.tolist() for x in np.unique(grams, return_counts=True))):
                            found[g] = found.get(g, 0) + n
                yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})

    counts = sample.select("text", "lang").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    top = by_gram.orderBy(F.desc("total"), "gram").limit(GRAMS).collect()  # at most GRAMS rows
    if not top:
        return None
    n = np.array([[r["by"].get(lang, 0) for lang in langs] for r in top], dtype=float)
    share = n / np.maximum(n.sum(axis=0), 1)
    belongs = (share >= PART * share.max(axis=1, keepdims=True)) & (n > 0)
    return Filter(langs, np.array([r["gram"] for r in top], dtype=np.uint64), belongs)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Filter | None, keep_text: bool = False) -> DataFrame:
    """``docs`` (with a ``text`` column) plus lang_pred, score and hit_rate, for the whole of every text.

    ``score`` is the winner's part of all languages' shares, ``hit_rate`` its share of the text.
    Ties go to the first language by name.  Texts that are null or have no letter, and all texts if
    nothing could be learned, get ``und`` and 0.  Repeated rows stay; empty tables stay empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS bytes for every 8 languages

    def row(text: str | None) -> tuple:
        m = shared.value
        if not text or m is None or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        s = m.shares(text)
        best = int(np.argmax(s))
        return m.langs[best], float(s[best] / s.sum()) if s[best] > 0 else 0.0, float(s[best])

    return add_columns(docs, "text", row, "lang_pred string, score double, hit_rate double", drop_inputs=not keep_text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, hit_rate of every document (doc_id, text, lang).

    Learns from text and non-null lang of the rows whose id does not fall in the held-out third;
    predicts from the text alone.  A null doc_id counts as the empty string.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, learn(docs))
