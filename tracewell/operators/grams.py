"""Containment by posting lists of character trigrams.

A word can only lie in a text that holds all its trigrams, so each word is looked up under its rarest
one, and only the texts posted there are compared. The index grows with the texts' length, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams, in the order they come; none of a text below three characters."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda k: F.substring(text, k, 3)))).otherwise(F.array().cast("array<string>"))


def holding(words: DataFrame, word: str, texts: DataFrame, text: str) -> DataFrame:
    """(word, text) of every word that lies in a text, each pair once; words below three characters are in none.

    Equal words and equal texts are looked up once; nulls take no part.
    """
    posted = texts.select(text).where(F.length(text) >= 3).distinct().select(F.col(text).alias("_text"), F.explode(trigrams(F.col(text))).alias("_gram"))
    size = posted.groupBy("_gram").agg(F.count("*").alias("_size"))
    asked = words.select(word).where(F.length(word) >= 3).distinct().select(F.col(word).alias("_word"), F.explode(trigrams(F.col(word))).alias("_gram"))
    rarest = asked.join(size, "_gram", "left").groupBy("_word").agg(F.min(F.struct(F.coalesce("_size", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_r"))
    found = rarest.where("_r.n > 0").select("_word", F.col("_r.g").alias("_gram")).join(posted, "_gram").where(F.contains("_text", F.col("_word")))
    return found.select(F.col("_word").alias(word), F.col("_text").alias(text))
