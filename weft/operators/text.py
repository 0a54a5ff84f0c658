"""TF-IDF in long form (document, term, weight), from counts of the vocabulary's terms; dense columns and sparse vectors on top."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def term_counts(df: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """doc, term, tf of the terms in a small table. Others go before the shuffle: most pairs of a document and a term are of terms outside a vocabulary."""
    found = df.select(F.col(id_col).alias("doc"), F.explode(tokens(F.col(text_col))).alias("term"))
    return found.join(F.broadcast(terms), "term").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class Tokenizer:
    """``vocabulary``: term, index (alphabetical), df, idf; at most ``max_features`` rows. ``terms``: its terms alone."""

    vocabulary: DataFrame
    n_docs: int
    terms: DataFrame

    def long(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """doc, term, index, weight: tf times idf, of length 1 a document."""
        counts = term_counts(df, id_col, text_col, self.terms).join(F.broadcast(self.vocabulary), "term")
        raw = F.col("tf") * F.col("idf")
        norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("doc")))
        return counts.select("doc", "term", "index", (raw / norm).alias("weight"))

    def columns(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Dense columns ``{text}_tfidf_{i}``."""
        size = self.vocabulary.count()
        long = self.long(df, id_col, text_col).groupBy("doc").pivot("index", list(range(size))).agg(F.first("weight"))
        wide = long.select(F.col("doc").alias("__doc"), *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"{text_col}_tfidf_{i}") for i in range(size)])
        out = df.join(wide, df[id_col] == wide["__doc"], "left").drop("__doc", text_col)
        return out.na.fill(0.0, [f"{text_col}_tfidf_{i}" for i in range(size)])

    def vectors(self, df: DataFrame, id_col: str, text_col: str, out: str = "features") -> DataFrame:
        """A sparse vector a document (``index -> weight``)."""
        from pyspark.ml.linalg import SparseVector, VectorUDT

        size = self.vocabulary.count()
        make = F.udf(lambda m: SparseVector(size, dict(m or {})), VectorUDT())
        rows = self.long(df, id_col, text_col).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("index", "weight"))).alias("m"))
        return df.join(rows, df[id_col] == rows["doc"], "left").withColumn(out, make("m")).drop("doc", "m")


def tokenize(df: DataFrame, id_col: str, text_col: str, max_features: int = 100) -> Tokenizer:
    """The most frequent terms by total count (ties alphabetical), with smoothed inverse document frequency.

    Totals choose the terms and need no documents, so they shuffle a row a term and task; document frequencies are then counted for the chosen terms alone.
    """
    n = df.count()
    totals = df.select(F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    terms = totals.orderBy(F.desc("total"), "term").limit(max_features).select("term")
    # Counts whose tf is used are those of ``long``, so that Spark makes them once for both.
    stats = term_counts(df, id_col, text_col, terms).groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    index = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1).alias("index")
    return Tokenizer(stats.select("term", index, "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), n, terms)


embed = tokenize
