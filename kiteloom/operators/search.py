"""Lexical search over an inverted index: all words of a query must occur, in any script.

The score is hits over the root of a text's length: this library's own, plain and
documented; it doesn't claim to equal a database's rank function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: letters, their marks and digits of any script.
WORD = "[\\p{L}\\p{M}\\p{N}]+"


def words_of(text: Column) -> Column:
    """The words of a text in lower case, in order; none of a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def inverted_index(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """term, ``key``, hits and n_words (of the text): a row a term and text.

    Hits are counted where a text is read, so one row for each leaves the task. With
    ``terms`` (term) only these are indexed; write the index to use it again.
    """
    opened = docs.select(key, words_of(F.col(text)).alias("words")).select(key, F.size("words").alias("n_words"), F.explode("words").alias("term"))
    if terms is not None:
        opened = opened.join(terms.select("term").distinct(), "term", "left_semi")
    return opened.groupBy("term", key, "n_words").agg(F.count(F.lit(1)).alias("hits")).select("term", key, "hits", "n_words")


def query_terms(queries: DataFrame, query: str, text: Column) -> DataFrame:
    """``query``, term and needed: the distinct words of each query and their number."""
    words = queries.select(query, F.array_distinct(words_of(text)).alias("words"))
    return words.select(query, F.size("words").alias("needed"), F.explode("words").alias("term"))


def lexical_search(index: DataFrame, key: str, terms: DataFrame, query: str, most: int) -> DataFrame:
    """``query``, ``key``, score and rank (from 1) of the ``most`` best texts with all words.

    A query's rarest word gives its candidates; its other words are looked up for these
    only, by (term, text), so the long lists of common words are never joined whole. A
    query with a word that no text has finds nothing.
    """
    often = index.groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    rarest = F.row_number().over(Window.partitionBy(query).orderBy(F.coalesce("texts", F.lit(0)), "term"))
    ranked = terms.join(often, "term", "left").withColumn("nth", rarest)
    seeds = ranked.filter("nth = 1").join(index, "term").select(query, "needed", key, "n_words", "hits")
    others = ranked.filter("nth > 1").select(query, "term")
    looked = seeds.drop("hits").join(others, query).join(index.select("term", key, "hits"), ["term", key]).select(query, "needed", key, "n_words", "hits")
    found = seeds.unionByName(looked).groupBy(query, "needed", key, "n_words").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("have"))
    scored = found.filter("have = needed").select(query, key, F.round(F.col("hits") / F.sqrt("n_words"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)
