"""From documents to packed training sequences: language, near duplicates, secrets, packing.

Each stage takes all that its predecessor kept and returns the columns of ``documents``; the last returns pieces of
sequences.  Decisions reach the documents by their keys, in a join that moves only the decisions where they are
few (``BROADCAST_ROWS``) and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import jaccard_join, language_id, packing, secret_scan
from riskframe.llm.registry import table
from riskframe.llm.skew import salted_join
from riskframe.llm.tokens import vocabulary
from riskframe.session import cut_lineage, scratch_folder, ship_package

#: Decisions (or spans) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: What stands in a text in place of a secret.
REDACTED = "[secret]"
#: Base values under so many owners go even where they look made up.
MOST_OWNERS = 2
#: A value that a larger share of all owners has is a copied example, and stays.
WIDE_SHARE = 0.5


def _few(decisions: DataFrame, size: int) -> DataFrame:
    return F.broadcast(decisions) if size <= BROADCAST_ROWS else decisions


def _key():
    """Documents of equal id and text are the same."""
    return F.xxhash64("doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; those without letters or with a posterior under one half go.  Where no
    document declares a language nothing can be told of them, and all stay."""
    ship_package(spark)
    judged = language_id.identify(language_id.document_rows(docs, _key().alias("_key")))
    rejected = cut_lineage(judged.where("NOT accepted AND lang IS NOT NULL").select("_key").distinct())
    return docs.withColumn("_key", _key()).join(_few(rejected, rejected.count()), "_key", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares four fifths of its 5-word shingles: that of the smallest id, null being the
    largest.  Rows are judged by id and text together, so null and repeated ids tie nothing together; of rows equal in
    both, one stays."""
    ship_package(spark)
    keyed = docs.withColumn("_key", _key())
    joined = jaccard_join.join(keyed, words=5, percent=80, id="_key", keep=("doc_id",))
    joined = cut_lineage(joined.groupBy("_key", "component_id", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    first = joined.groupBy("component_id").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("first")).where("k > 1")
    gone = salted_join(joined, first, ["component_id"], "_key", how="inner").where("_key <> first")
    gone = cut_lineage(gone.select("_key"))
    kept = keyed.join(_few(gone, gone.count()), "_key", "left_anti")
    repeated = cut_lineage(joined.where("n > 1").select("_key"))
    several = repeated.count()
    if several:
        # Aggregated before they are shuffled: a row may be repeated any number of times.
        once = kept.join(_few(repeated, several), "_key", "left_semi").groupBy("_key").agg(
            F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
        kept = kept.join(_few(repeated, several), "_key", "left_anti").select(*docs.columns).union(once)
    return kept.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced: values that look live unless a large share of all owners has them, and
    of the base kinds also those of one or two owners."""
    ship_package(spark)
    keyed = docs.withColumn("_key", _key())
    owners = docs.select(secret_scan.owner_of("source")).distinct().count()
    found = secret_scan.scan(keyed, max(MOST_OWNERS, int(WIDE_SHARE * owners)), id="_key")
    spans = F.filter("spans", lambda s: s["live"] | (s["owners"] <= MOST_OWNERS))
    found = cut_lineage(found.select("_key", F.transform(spans, lambda s: F.struct(s["start"], s["end"])).alias("_spans"))
                        .where(F.size("_spans") > 0).groupBy("_key").agg(F.first("_spans").alias("_spans")))
    size = found.agg(F.sum(F.size("_spans"))).first()[0] or 0
    text = F.col("text")

    def step(done, s):
        before = F.substr(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        mark = F.when(s["start"] >= done["at"], F.lit(REDACTED)).otherwise(F.lit(""))
        return F.when(s["end"] <= done["at"], done).otherwise(
            F.struct(s["end"].alias("at"), F.concat(done["out"], before, mark).alias("out")))

    redacted = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                           lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1)))
    has = F.col("_spans").isNotNull()
    out = keyed.join(_few(found, size), "_key", "left").withColumn("_new", F.when(has, redacted).otherwise(text))
    out = out.withColumn("n_chars", F.when(has, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("_new")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4,096 tokens, in the mixture of sources that is left."""
    ship_package(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]

#: No stage can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
