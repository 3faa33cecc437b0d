"""Quotes that stand verbatim in documents, found by a join on word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import flat

#: Words of the window that a quote is looked up by; a quote of few words has a shorter one.
WINDOW = 5


def _windows(words: Column, size: Column) -> Column:
    """Every run of ``size`` words, as a hash."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + 1))
    return F.transform(starts, lambda at: F.xxhash64(F.array_join(F.slice(words, at, size), " ")))


def quoted_in(docs: DataFrame, quotes: DataFrame, doc_id: str, quote_id: str) -> DataFrame:
    """``doc_id, quote_id`` of every document (``text``) that holds a quote (``quote``), white space and case aside.

    A quote may begin and end inside a word of the document, so it is looked up by the words after its first, and not by its last.
    Documents that have that window are compared with the whole quote. Quotes need three words; null and shorter ones are
    looked for nowhere. Each pair comes once.
    """
    words = F.split("flat_quote", " ")
    named = quotes.select(quote_id, flat(F.col("quote")).alias("flat_quote")).where(F.size(words) >= 3)
    keyed = named.withColumn("size", F.least(F.lit(WINDOW), F.size(words) - 2)).withColumn("window", F.xxhash64(F.array_join(F.slice(words, F.lit(2), F.col("size")), " ")))
    sizes = keyed.select("size").distinct()  # five numbers at most
    texts = docs.select(doc_id, flat(F.col("text")).alias("flat_text"))
    split = texts.select(doc_id, F.split("flat_text", " ").alias("words"))
    seen = split.join(F.broadcast(sizes)).select(doc_id, "size", F.explode(F.array_distinct(_windows(F.col("words"), F.col("size")))).alias("window"))
    met = seen.join(keyed.select(quote_id, "size", "window"), ["size", "window"]).select(doc_id, quote_id).distinct()
    both = texts.join(met, doc_id).join(named, quote_id).where(F.contains("flat_text", F.col("flat_quote")))
    return both.select(doc_id, quote_id).distinct()
