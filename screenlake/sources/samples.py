"""Labelled samples as JSON lines or Parquet, by name: one schema, aliases, splits and seeded limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import md5_bucket

SCHEMA = "text string, label string, attack_type string, target_layer string, source_benchmark string, sample_id string, metadata map<string,string>"
#: Per cent of a source whose texts' MD5 makes up its test split.
TEST_SHARE = 20


@dataclass
class Catalog:
    """Paths by name, with other names for them and the layer and licence that a source declares."""

    paths: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    facts: dict[str, tuple[str, str]] = field(default_factory=dict)

    def add(self, name: str, path: str, layer: str = "all", licence: str = "", aliases: tuple[str, ...] = ()) -> "Catalog":
        self.paths[name], self.facts[name] = path, (layer, licence)
        self.aliases.update({a.lower(): name for a in aliases})
        return self

    def resolve(self, name: str) -> str:
        return name if name in self.paths else self.aliases.get(name.lower(), name)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, path, layer, licence) of all sources."""
        return spark.createDataFrame([(n, p, *self.facts[n]) for n, p in sorted(self.paths.items())], "name string, path string, layer string, licence string")

    def load(self, spark: SparkSession, name: str, split: str | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
        """A source's samples; split is train or test. An unknown name raises; rows that do not parse are left out."""
        known = self.resolve(name)
        if known not in self.paths:
            raise KeyError(f"no source {name}; known are {sorted(self.paths)}")
        df = in_split(read_samples(spark, self.paths[known]).withColumn("source_benchmark", F.coalesce("source_benchmark", F.lit(known))), split)
        return df if limit is None else seeded(df, limit, seed)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (or Parquet, by the path's end) under the one schema; other columns are not read."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        names = [x.strip().split(" ")[0] for x in SCHEMA.split(", ")]
        return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("map<string,string>" if n == "metadata" else "string").alias(n) for n in names])
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def in_split(df: DataFrame, split: str | None) -> DataFrame:
    """By the text's MD5, so that equal texts fall in one split."""
    if split is None:
        return df
    test = md5_bucket(F.col("text")) < TEST_SHARE
    return df.where(test if split == "test" else ~test)


def seeded(df: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """A sample of ``limit`` rows, the same in any run: a sampling operator."""
    return df.orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(limit)


def write_samples(df: DataFrame, path: str, replace: bool = False) -> None:
    """One file of JSON lines a partition; a source that is there already stays, unless it is to be replaced."""
    df.write.mode("overwrite" if replace else "ignore").json(path)


def integrity(df: DataFrame) -> DataFrame:
    """One row: rows with an empty text, without an id, with an unknown label, and benign rows that name an attack."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    known = F.col("label").isin("malicious", "benign")
    return df.agg(
        F.count("*").alias("n"), n(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), n(F.col("sample_id").isNull()).alias("no_id"), n(F.col("label").isNull() | ~known).alias("bad_label"),
        n((F.col("label") == "benign") & (F.coalesce("attack_type", F.lit("none")) != "none")).alias("benign_attacks"),
    )


def held_out(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: texts and attack types that both have."""
    shared = lambda c: train.select(c).intersect(test.select(c)).agg(F.count("*"))
    texts, kinds = shared(F.sha2("text", 256).alias("h")).toDF("shared_texts"), shared("attack_type").toDF("shared_types")
    return texts.crossJoin(kinds)  # one row each


def balanced(df: DataFrame, group: str = "source_benchmark", label: str = "label", bins: int = 8) -> DataFrame:
    """Distinct texts (case aside); no source gives more than twice its even share of a label; then, by length, as many of
    each label as the rarer one has. What is left out is chosen by a hash of the text."""
    from pyspark.sql import Window

    key = F.sha2(F.lower("text"), 256)
    once = df.withColumn("__h", key).groupBy("__h").agg(*[F.min_by(F.struct(*df.columns), F.struct("source_benchmark", "sample_id")).alias("__r")]).select("__h", "__r.*")
    shares = once.groupBy(label, group).agg(F.count("*").alias("__n")).withColumn("__cap", F.ceil(2 * F.sum("__n").over(Window.partitionBy(label)) / F.count("*").over(Window.partitionBy(label))))
    spread = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    kept = once.join(F.broadcast(shares), [label, group]).where(spread < F.col("__cap") / F.col("__n"))  # a row a source and label
    length = F.least(F.floor(F.log2(F.length("text") + 1)), F.lit(bins - 1))
    kept = kept.withColumn("__bin", length)
    sizes = kept.groupBy("__bin", label).agg(F.count("*").alias("__m")).withColumn("__least", F.min("__m").over(Window.partitionBy("__bin")))
    again = F.conv(F.substring("__h", 9, 8), 16, 10).cast("double") / float(1 << 32)
    return kept.join(F.broadcast(sizes), ["__bin", label]).where(again < F.col("__least") / F.col("__m")).select(*df.columns)


def substitute(df: DataFrame, mark: str, token: str) -> DataFrame:
    """A mark in the texts replaced by the token that is in use."""
    return df.withColumn("text", F.replace("text", F.lit(mark), F.lit(token)))


def chat_messages(messages: str, role: str, content: str) -> "F.Column":
    """Of a column array<struct>, the texts in order, each after its role."""
    return F.array_join(F.transform(F.col(messages), lambda m: F.concat(F.lit("["), m[role], F.lit("] "), F.coalesce(m[content], F.lit("")))), "\n")
