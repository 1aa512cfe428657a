"""Substring search by an inverted index of trigrams.

Every lower-cased text, with two marks after its end, gives its distinct trigrams; the index has a row for each trigram, column and
key, sorted by trigram, and the number of rows of each trigram. A term's rarest trigrams are looked up, which the sorted files answer
with few row groups; keys that have them all are candidates, and the literal test decides. A term of one or two characters is the
beginning of some trigram of every text that contains it, the marks included.

The number of trigrams is known before they are made (one a character) and before they are looked up (the counts), so the
texts, the index and what is looked up are dealt into tasks of a bounded number of them, however the table is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.operators.filters import text_matches

#: A mark after a text's end, which no term has.
MARK = "\x00"
#: Trigrams of a term that are looked up, the rarest ones.
MOST_GRAMS = 4
#: Trigrams that a task is meant to make or sort.
PART_ROWS = 1_000_000
#: Rows of looked-up trigrams that a task is meant to count by key.
LOOKUP_ROWS = 250_000


def grams(text: Column) -> Column:
    """Distinct trigrams of a lower-cased text with two marks after it; none for an empty or null one."""
    padded = F.concat(F.lower(text), F.lit(MARK * 2))
    places = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(places, lambda i: F.substring(padded, i, F.lit(3)))))


def _parts(rows: int | None, most: int) -> int:
    return max(1, -(-(rows or 0) // most))


def write_trigrams(df: DataFrame, path: str, key: str, columns: list[str], parts: int | None = None) -> None:
    """Index some text columns of ``df`` by a key that isn't null; ``parts`` files, by default as many as the texts' lengths ask for."""
    texts = {f"text_{i}": F.col(c).cast("string") for i, c in enumerate(columns)}
    if not parts:
        chars = df.select(sum((F.coalesce(F.length(text), F.lit(0)).cast("long") for text in texts.values()), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _parts(chars, PART_ROWS))
    # the texts are dealt before they become trigrams: a table in one row group is read by one task
    dealt = df.select(F.col(key).alias("key"), *[text.alias(name) for name, text in texts.items()]).repartition(parts, "key", *texts)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(name).alias("text")) for c, name in zip(columns, texts, strict=True)]))
    found = dealt.select("key", each.alias("own")).select("key", "own.column", F.explode(grams(F.col("own.text"))).alias("gram"))
    # the key splits a trigram that most texts have
    found.repartitionByRange(parts, "gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{path}/postings")
    counts = df.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange(max(1, parts // 4), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


class TrigramIndex:
    """A written index over the columns of a table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.postings, self.counts = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts")

    def candidates(self, term: str) -> DataFrame:
        """``key`` of the texts that may contain a term that isn't empty."""
        term = term.lower()
        if len(term) < 3:
            begun = F.startswith("gram", F.lit(term))
            rows = self.counts.where(begun).agg(F.sum("n")).first()[0]
            return self.postings.where(begun).select("key").repartition(_parts(rows, LOOKUP_ROWS), "key").distinct()
        own = sorted({term[i : i + 3] for i in range(len(term) - 2)})
        known = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(own)).collect()}  # a row for each trigram of the term at most
        if len(known) < len(own):
            return self.postings.where(F.lit(False)).select("key")
        rare = sorted(own, key=lambda x: (known[x], x))[:MOST_GRAMS]
        # a bit a trigram: rows that share a key repeat them
        bit = F.coalesce(*[F.when(F.col("gram") == x, F.lit(1 << i)) for i, x in enumerate(rare)])
        found = self.postings.where(F.col("gram").isin(rare)).select("key", "column", bit.alias("bit")).repartition(_parts(sum(known[x] for x in rare), LOOKUP_ROWS), "key")
        held = found.groupBy("key", "column").agg(F.bit_or("bit").alias("bits"))
        return held.where(F.col("bits") == (1 << len(rare)) - 1).select("key").distinct()

    def search(self, df: DataFrame, term: str | None, key: str, *columns: str) -> DataFrame:
        """Rows of the indexed table of which a column contains the trimmed term; all rows for an empty term."""
        term = (term or "").strip()
        if not term:
            return df
        near = self.candidates(term).withColumnRenamed("key", key)
        return df.join(near, key, "left_semi").where(text_matches(term, *columns))
