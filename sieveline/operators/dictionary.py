"""Which terms of a list occur in which texts, for lists and corpora of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.functions.bind import bind
from sieveline.operators.filters import key_filter
from sieveline.operators.skew import broadcast_if_small


def term_hits(docs: DataFrame, terms: DataFrame, max_words: int, id_col: str = "doc_id") -> DataFrame:
    """(id, term, n_hits): word runs of up to ``max_words`` of each text that are a listed term.

    ``terms`` has one column, term. Inside the row, a filter finds the places where a word begins some term, and
    another the runs from there that may be terms; only those are opened. They meet the list by equality,
    map-side when it is counted to be small; hits are added up before they are shuffled.
    """
    listed = terms.select(F.array_join(tx.plain_words(F.col("term")), " ").alias("run"), "term").filter("run <> ''")
    begins = key_filter(listed.select(F.substring_index("run", " ", 1).alias("word")).distinct(), "word")
    known = key_filter(listed.select("run").distinct(), "run")

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: begins(F.get(words, i - 1)))
        lengths = lambda i: F.sequence(F.lit(1), F.least(F.lit(max_words), F.size(words) - i + 1))
        made = F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda k: F.array_join(F.slice(words, i, k), " "))))
        return F.when(F.size(words) > 0, F.filter(made, known)).otherwise(F.array().cast("array<string>"))

    opened = docs.select(id_col, F.explode(bind(tx.plain_words(F.col("text")), runs)).alias("run"))
    return opened.join(broadcast_if_small(listed), "run").groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n_hits"))
