"""Text operators: words, shingles, overlaps, style, rewriting, cross references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case words of a letter and two letters or hyphens at least, without control characters and citation marks."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", " "), r"\[[0-9, -]+\]", " ")
    return F.regexp_extract_all(F.lower(clean), F.lit("([a-z][a-z-]{2,})"), F.lit(1))


def shingles(w: Column, n: int = 8) -> Column:
    """Distinct runs of n words."""
    last = F.size(w) - n
    return F.array_distinct(F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))


#: Places of the bitmap of target shingles: its words are BITS / 64 rows of two longs at most, whatever the targets.
BITS = 1 << 24


def shingle_overlap(docs: DataFrame, targets: DataFrame, n: int = 8) -> DataFrame:
    """Pairs (doc_id, item_id) that share shingles, with their number and its share of the item.

    The shingles of documents are held against a broadcast bitmap of the targets' hashes where they are made, so nearly all of
    those without a target never travel; what passes is joined on the whole shingle.
    """
    a = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingles(F.col("w"), n)).alias("s"))
    b = targets.select("item_id", words(F.col("text")).alias("w")).select("item_id", shingles(F.col("w"), n).alias("all")).select("item_id", F.size("all").alias("of"), F.explode("all").alias("s"))
    place = F.pmod(F.xxhash64("s"), F.lit(BITS))
    bitmap = b.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    passed = a.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(bitmap), "word").where(F.getbit("bits", (place % 64).cast("int")) == 1).select("doc_id", "s")
    return passed.join(b, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.max("of").alias("of")).withColumn("rate", F.col("shared") / F.col("of")).drop("of")


def without_markup(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)))


def style(text: Column) -> dict[str, Column]:
    """Sentence statistics: number, mean and median words, shares of more than 35 and 45 words, commas per 1000 words."""
    sentences = F.filter(F.split(text, r"[.!?]+[ \n\t\r]+"), lambda s: F.rlike(s, F.lit("[A-Za-z0-9]")))
    lengths = F.array_sort(F.transform(sentences, word_count))
    n = F.size(lengths)
    low, high = F.get(lengths, F.floor((n - 1) / 2).cast("int")), F.get(lengths, F.floor(n / 2).cast("int"))
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    return {
        "sentences": n.cast("long"), "mean_words": total / F.nullif(n, F.lit(0)), "median_words": (low + high) / 2,
        "over35": F.size(F.filter(lengths, lambda x: x > 35)) / F.nullif(n, F.lit(0)), "over45": F.size(F.filter(lengths, lambda x: x > 45)) / F.nullif(n, F.lit(0)),
        "commas_per_1000": 1000 * F.regexp_count(text, F.lit(",")) / F.nullif(total, F.lit(0)),
    }


def find_pattern(df: DataFrame, pattern: str, context: int = 20) -> DataFrame:
    """One row per match with what stands around it."""
    around = f"(.{{0,{context}}}(?:{pattern}).{{0,{context}}})"
    return df.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(around), F.lit(1))).alias("n", "found"))


def plain_dashes(text: Column) -> Column:
    """Dashes between words as commas, between numbers as hyphens."""
    numbers = F.regexp_replace(text, "([0-9])[–—]([0-9])", "$1-$2")
    return F.regexp_replace(numbers, " *[–—] *", ", ")


def cross_reference(used: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """Keys used but not defined and defined but not used, with how often each was used."""
    u = used.groupBy(key).agg(F.count("*").alias("uses"))
    both = u.join(defined.select(key).distinct().withColumn("d", F.lit(1)), key, "full")
    kind = F.when(F.col("d").isNull(), "undefined").when(F.col("uses").isNull(), "unused")
    return both.select(key, kind.alias("kind"), F.coalesce("uses", F.lit(0)).alias("uses")).where("kind is not null")


def within_tolerance(claimed: DataFrame, found: DataFrame, key: str, tolerance: float) -> DataFrame:
    both = claimed.join(found.withColumnRenamed("value", "found"), key, "left")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("value") - F.col("found")) <= tolerance, F.lit(False)))
