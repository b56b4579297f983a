"""A table with postings of trigrams and whole tokens, so that a search opens the rows that can match, not all.

    {root}/rows/load=L/part=P/            a load's rows in parts of about ``PART_ROWS``, each row numbered in its part
    {root}/postings/load=L/bucket=B/      (word, part, rows): the rows of a part that hold a trigram or a token
    {root}/done/load=L                    made last: a load without it isn't there

A search takes the postings of all its trigrams (or of its token), keeps the rows that hold every one, opens their parts
and looks at the rows themselves. A text without three characters to go by is looked for in all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S
from tenantlake.operators.filters import text_search
from tenantlake.session import stage

#: Rows of a part, about: no posting is longer.
PART_ROWS = 65_536
BUCKETS = 64
#: Parts that a search names to its reader; with more it reads all parts and the join alone tells the rows.
NAMED_PARTS = 5_000
#: Trigrams that a search goes by; a longer text has more, and its rows are looked at anyway.
GRAMS = 64
_GRAM = 3
# fixed values: what a whole token is made of, as in ``scalars.has_token``
_TOKEN = r"[A-Za-z0-9_\-]+"


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the text in lower case, by code points; none for null and for shorter texts."""
    # the letters are split off once: inside a lambda they are a variable, not the expression
    made = F.flatten(F.transform(F.array(F.split(F.lower(text), "")), lambda letters: F.transform(
        letters, lambda c, i: F.concat(c, F.get(letters, i + 1), F.get(letters, i + 2)))))
    return F.coalesce(F.array_distinct(F.filter(made, lambda g: F.char_length(g) == _GRAM)), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """The distinct whole tokens of a text; none for null."""
    found = F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


class TextIndex:
    """``columns`` are searched by text; ``records`` make, of a table's column names, the texts whose whole tokens count."""

    def __init__(self, spark: SparkSession, root: str, columns: Sequence[str] = (),
                 records: Sequence[Callable[[list[str]], Column]] = (), buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.columns, self.records = list(columns), list(records)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def add(self, load: int, df: DataFrame, part_rows: int = PART_ROWS) -> None:
        """Append a load under its number; the same number again replaces what it had, so a retry adds nothing twice.

        Columns named ``part`` or ``row`` would clash and are refused.
        """
        if {"part", "row", "load"} & {c.lower() for c in df.columns}:
            raise ValueError("the table has a column named part, row or load")
        done, fs = self._at(f"done/load={load}")
        fs.delete(done, False)
        n = max(1, -(-df.count() // part_rows))
        dealt = df.repartition(n).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(
            F.lit((1 << 33) - 1)).cast("int")})
        at = f"{self.root}/rows/load={load}"
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(at)
        df.where("false").write.mode("overwrite").parquet(f"{self.root}/schema")
        self._post(self._rows([load], None).drop("load"), load)
        fs.create(done, True).close()

    def _post(self, rows: DataFrame, load: int) -> None:
        names = [c for c in rows.columns if c not in ("part", "row")]
        words = [F.transform(trigrams(F.col(f"`{c}`").cast("string")), lambda g: F.concat(F.lit("g"), g)) for c in self.columns]
        words += [F.transform(tokens(record(names)), lambda t: F.concat(F.lit("t"), t)) for record in self.records]
        found = rows.select("part", "row", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *words))).alias("word"))
        # a word's rows are gathered part by part, at most ``PART_ROWS`` of them, in the task that reads the part first
        posted = found.groupBy("word", "part").agg(F.array_sort(F.collect_list("row")).alias("rows")).withColumn("bucket", self._bucket(F.col("word")))
        # by range, so that a word of very many parts is spread over several files of its bucket
        posted.repartitionByRange("bucket", "word", "part").sortWithinPartitions("bucket", "word", "part").write.mode("overwrite").option(
            "partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.root}/postings/load={load}")

    def loads(self) -> list[int]:
        at, fs = self._at("done")
        return sorted(int(s.getPath().getName().removeprefix("load=")) for s in fs.listStatus(at)) if fs.exists(at) else []

    def _there(self, paths: Sequence[str]) -> list[str]:
        return [f"{self.root}/{p}" for p in paths if (lambda x: x[1].exists(x[0]))(self._at(p))]

    def _rows(self, loads: Sequence[int], parts: Sequence[tuple[int, int]] | None) -> DataFrame:
        """Rows of whole loads, or of the (load, part) given, with load, part and row."""
        schema = self.spark.read.parquet(f"{self.root}/schema").schema
        full = schema.add("row", "integer").add("part", "integer").add("load", "integer")
        paths = [f"rows/load={n}" for n in loads] if parts is None else [f"rows/load={n}/part={p}" for n, p in parts]
        paths = self._there(paths)
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/rows").parquet(*paths)

    def candidates(self, words: Sequence[str]) -> DataFrame:
        """(load, part, row) of the rows that hold every one of the words."""
        words = sorted(set(words))
        wanted = self.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(w).alias("w"), self._bucket(F.lit(w)).alias("b")) for w in words])).alias("x"))
        buckets = sorted({r.b for r in wanted.select("x.b").collect()})  # at most one a word
        paths = self._there([f"postings/load={n}/bucket={b}" for n in self.loads() for b in buckets])
        schema = "word string, part int, rows array<int>, bucket int, load int"
        if not paths:
            return self.spark.createDataFrame([], "load int, part int, row int")
        held = self.spark.read.schema(schema).option("basePath", f"{self.root}/postings").parquet(*paths).where(F.col("word").isin(words))
        # a part that lacks one of the words goes before its rows are laid out
        whole = held.groupBy("load", "part").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(words))
        shared = F.aggregate(F.slice(F.col("lists"), 2, F.size("lists")), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        return whole.select("load", "part", F.explode(shared).alias("row"))

    def opened(self, words: Sequence[str]) -> list[tuple[int, int]] | None:
        """The (load, part) that a search opens; None when there are more than it names."""
        found = self.candidates(words).select("load", "part").distinct().limit(NAMED_PARTS + 1).collect()
        return sorted((r[0], r[1]) for r in found) if len(found) <= NAMED_PARTS else None

    def holding(self, words: Sequence[str]) -> DataFrame:
        """The rows that hold every one of the words; all rows if there is none."""
        if not words:
            return self.read()
        rows = self._rows(self.loads(), self.opened(words))
        return rows.join(self.candidates(words), ["load", "part", "row"], "left_semi").drop("load", "part", "row")

    def read(self) -> DataFrame:
        """All rows of all loads."""
        return self._rows(self.loads(), None).drop("load", "part", "row")

    @staticmethod
    def words_of(term: str) -> list[str]:
        low = term.lower()
        grams = sorted({"g" + low[i:i + _GRAM] for i in range(len(low) - _GRAM + 1)})
        return grams[::-(-len(grams) // GRAMS) or 1]

    def search(self, term: str) -> DataFrame:
        """``text_search`` over the indexed columns: rows that hold the term in one of them, whatever its case."""
        return text_search(self.holding(self.words_of(term)), term, self.columns)

    def with_token(self, token: str) -> DataFrame:
        """The rows that hold a whole token in one of the records; one of other characters is looked for in all rows.

        The rows that the postings name are staged: Spark would move this look at the records, and each one of a report
        over the result, before the join with the postings, to every row of the opened parts.
        """
        if not self.records:
            raise ValueError("the index has no tokens")
        plain = token and all(c.isascii() and (c.isalnum() or c in "_-") for c in token)
        rows = stage(self.holding(["t" + token]), "holding") if plain else self.read()
        return rows.where(reduce(or_, [S.has_token(record(rows.columns), token) for record in self.records]))
