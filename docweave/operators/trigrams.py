"""Trigram postings: which texts can hold a substring, so that only these are looked at.

The index is a table (gram, item) of the distinct three-character runs of each lower-cased text, sorted by gram, and
the number of texts of each gram. A text that holds a pattern holds all its trigrams: candidates are the texts that
hold the pattern's FEWEST rarest ones, told by equi-joins and a count. Whoever asks still tests the substring.

Patterns of one or two characters have no trigram; runs of their own length are posted beside the trigrams for
them. A null text or pattern has no run; an empty pattern has no candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a pattern that its candidates are told by.
FEWEST = 4


def runs(text: Column, n: int) -> Column:
    """Distinct runs of n characters: a lookahead matches at every place, so they overlap, and one pass finds all."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def all_runs(text: Column) -> Column:
    """Distinct runs of one, two and three characters."""
    return F.concat(*[runs(text, n) for n in (1, 2, 3)])


def pattern_runs(pattern: Column) -> Column:
    """A pattern's trigrams, or the pattern itself if it is shorter."""
    return F.when(F.length(pattern) >= 3, runs(pattern, 3)).when(F.length(pattern) > 0, F.array(pattern)).otherwise(F.array().cast("array<string>"))


def spread(pattern: Column) -> Column:
    """At most FEWEST of a pattern's runs, evenly apart: for texts whose runs are not counted beforehand."""
    g = pattern_runs(pattern)
    step = F.greatest(F.ceil(F.size(g) / F.lit(float(FEWEST))).cast("int"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(g, lambda x, i: F.when(i % step == 0, x)), lambda x: x.isNotNull()))


def candidates_in(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pattern_id: texts that hold all chosen runs of a pattern (pattern_id, pattern), without a stored index: the
    texts' runs are made as they stream by, and only those that some pattern asks for are shuffled."""
    asked = patterns.select("pattern_id", F.explode(spread(F.lower("pattern"))).alias("gram")).distinct()
    need = asked.groupBy("pattern_id").agg(F.count("*").alias("need"))
    held = texts.select(id_col, F.explode(all_runs(F.lower(text_col))).alias("gram")).join(asked, "gram").groupBy(id_col, "pattern_id").agg(F.count_distinct("gram").alias("n"))
    return held.join(need, "pattern_id").filter("n = need").select(id_col, "pattern_id")


class TrigramIndex:
    """The stored postings at `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, texts: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "content") -> TrigramIndex:
        rows = texts.select(F.col(id_col).alias("item"), F.explode(all_runs(F.lower(text_col))).alias("gram")).select("gram", "item").distinct()
        rows.repartition("gram", F.pmod(F.xxhash64("item"), F.lit(8))).sortWithinPartitions("gram", "item").write.mode("overwrite").parquet(f"{path}/postings")
        index = cls(texts.sparkSession, path)
        index.postings().groupBy("gram").agg(F.count("*").alias("df")).sort("gram").write.mode("overwrite").parquet(f"{path}/grams")
        return index

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, item: texts that hold the rarest runs of each pattern (pattern_id, pattern)."""
        asked = patterns.select("pattern_id", F.explode(pattern_runs(F.lower("pattern"))).alias("gram")).join(self.grams(), "gram", "left")
        rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))), 1, FEWEST)
        chosen = asked.groupBy("pattern_id").agg(rarest.alias("g")).select("pattern_id", F.size("g").alias("need"), F.explode("g.gram").alias("gram"))
        hits = self.postings().join(chosen, "gram").groupBy("pattern_id", "item").agg(F.count("*").alias("n"), F.first("need").alias("need"))
        return hits.filter("n = need").select("pattern_id", "item")

    def holding(self, pattern: str) -> DataFrame:
        """item: candidates of one pattern. Its runs are a filter on the sorted postings, which the scan prunes by."""
        low = pattern.lower()
        own = sorted({low[k : k + 3] for k in range(max(1, len(low) - 2))} if low else set())
        counted = {r.gram: r.df for r in self.grams().filter(F.col("gram").isin(own)).collect()} if own else {}
        if not own or len(counted) < len(own):
            return self.postings().select("item").limit(0)
        chosen = sorted(own, key=lambda g: (counted[g], g))[:FEWEST]
        return self.postings().filter(F.col("gram").isin(chosen)).groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") == len(chosen)).select("item")
