"""URL filters: rules, and gradient-boosted trees on lexical features for the urls no rule fits.

Features are SQL expressions over the url: lengths, depth, digit ratio, character entropy, parameter counts, and
statistics of the host's suffix.  Suffix statistics are grouped aggregates over all urls: how many urls have the
suffix (as a power of two), and which share of its judgements blocks, smoothed towards the share of all.  Training
labels are given, or the verdicts of the rules.  All urls that one rule labels, or whose labels are given and whose host
is the same, are one judgement; a url meets the share without the judgements of its own fold (``FOLDS``), and in
steps of a tenth, so neither its own label nor a lone rule shows in it.  The trees are fitted by ``pyspark.ml`` on a
bounded sample of labelled rows (``SAMPLE``); everything else covers all urls.  No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.registry import llm_query, table
from riskframe.session import cut_lineage

#: (verdict, host, path) of the rules (fixed values).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Labelled rows that the trees are fitted on, about; taken by a hash of the row, so repeated urls are sampled too.
SAMPLE = 50_000
#: Weight of the overall share in a suffix's share, in judgements, and folds of judgements.
SMOOTHING, FOLDS = 20.0, 8
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_length",
            "has_fragment", "hyphens", "odd_ratio", "suffix_urls", "suffix_blocked"]


def lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(urls: DataFrame, url: str) -> DataFrame:
    """Adds ``rest`` (what follows the first '://'), ``host`` and ``path``; empty if there is none."""
    at = F.locate("://", F.col(url))
    return (urls.withColumn("rest", F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit("")))
            .withColumn("host", lower_ascii(F.regexp_extract("rest", r"^([^/?#]*)", 1)))
            .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)))


def rule_of(rules: list[tuple[str, str, str]]):
    """(rule, verdict) columns of the longest rule that fits ``host`` and ``path``; null without one."""
    rule = verdict = None
    for name, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)) if rule is None else rule.when(fits, F.lit(host + path))
        verdict = F.when(fits, F.lit(name)) if verdict is None else verdict.when(fits, F.lit(name))
    null = F.lit(None).cast("string")
    return (rule, verdict) if rules else (null, null)


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """Adds the features that need no other rows, and ``suffix``: the host's last two labels."""
    text, rest = F.coalesce(F.col(url), F.lit("")), F.col("rest")
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)

    def count(pattern, c=text):
        return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")

    # Entropy from the runs of equal characters in the sorted text: bits are log2(n) - sum(c log2 c) / n.
    letters = F.array_sort(F.split(text, ""))
    bits = F.aggregate(letters, F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
                       lambda s, x: F.when(x == s["last"], F.struct(
                           x.alias("last"), (s["run"] + 1).alias("run"), s["sum"].alias("sum"))).otherwise(
                           F.struct(x.alias("last"), F.lit(1.0).alias("run"),
                                    (s["sum"] + xlog(s["run"])).alias("sum"))),
                       lambda s: F.log2(size) - (s["sum"] + xlog(s["run"])) / size)
    return urls.withColumns({
        "suffix": F.substring_index(F.col("host"), ".", -2),
        "length": F.length(text).cast("double"),
        "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
        "labels": (1 + F.length(F.regexp_replace("host", "[^.]", ""))).cast("double"),
        "digit_ratio": count("[0-9]") / size, "entropy": bits,
        "parameters": F.when(query == "", 0.0).otherwise(1.0 + F.length(F.regexp_replace(query, "[^&;]", ""))),
        "query_length": F.length(query).cast("double"),
        "has_fragment": F.contains(rest, F.lit("#")).cast("double"),
        "hyphens": F.length(F.regexp_replace(text, "[^-]", "")).cast("double"),
        "odd_ratio": count("[^A-Za-z0-9/:.?&=#_-]") / size})


def xlog(n):
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def with_suffix_statistics(urls: DataFrame, label: str, judgement: str) -> DataFrame:
    """Adds ``suffix_urls`` and ``suffix_blocked`` from ``label`` (1 blocked, 0 allowed, null unknown).

    The statistics of a suffix meet its urls over salted keys, so a suffix may hold any share of them.
    """
    salts = 16
    fold = F.pmod(F.xxhash64(judgement), F.lit(FOLDS)).cast("int")
    each = urls.groupBy("suffix", judgement).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("blocked")).withColumn("fold", fold)
    share = F.coalesce(urls.where(F.col(label).isNotNull()).groupBy("suffix", judgement).agg(F.avg(label).alias("blocked"))
                       .agg(F.avg("blocked")).scalar(), F.lit(0.5))

    def without(f):
        blocked = F.when(F.col("fold") != f, F.col("blocked"))
        return F.round((F.coalesce(F.sum(blocked), F.lit(0.0)) + SMOOTHING * F.first("share")) / (F.count(blocked) + SMOOTHING), 1)

    stats = each.withColumn("share", share).groupBy("suffix").agg(
        F.sum("n").alias("n"), F.array(*map(without, range(FOLDS))).alias("shares"))
    stats = stats.select(
        "suffix", "shares", F.floor(F.log2("n")).cast("double").alias("suffix_urls"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return (urls.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(stats, ["suffix", "salt"])
            .withColumn("suffix_blocked", F.get("shares", fold)).drop("salt", "shares"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, label: str | None = None, sample: int = SAMPLE,
          id: str = "page_id", url: str = "url", seed: int = 7) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` of every row: the rule's verdict where one fits, else block if the
    trees' score (probability to be blocked) is over one half.

    ``label`` names a column with 1 (block), 0 (allow) or null; by default the rules' verdicts are the labels.
    With labels of one kind only there is nothing to learn: the score is then that label, or 0 without labels.
    Null urls and urls without '://' have empty host and path, and those share a suffix.  Null and repeated ids are kept, row by row; an
    empty table gives an empty table; other columns are not read.
    """
    given = F.col(label).cast("int") if label else F.lit(None).cast("int")
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), given.alias("given"),
                        F.monotonically_increasing_id().alias("row"))
    rule, verdict = rule_of(rules)
    rows = parse(rows, "url").withColumns({"rule": rule, "ruled": verdict})
    target = F.col("given") if label else F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    judged = F.col("host") if label else F.coalesce("rule", "host")
    rows = lexical(rows.withColumns({"label": target.cast("double"), "judgement": judged}), "url").drop("rest", "given")
    # The features are read by each round of the fit and again by the scores.
    rows = cut_lineage(with_suffix_statistics(rows, "label", "judgement").withColumns(
        {f: F.coalesce(f, F.lit(0.0)) for f in FEATURES}).drop("suffix", "judgement"))
    n, blocked = rows.where("label IS NOT NULL").agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if 0 < blocked < n:
        model = fit(rows.where("label IS NOT NULL"), n, sample, seed)
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        scored = scored.withColumn("score", F.get(_to_array("probability"), F.lit(1)))
    else:
        scored = rows.withColumn("score", F.lit(1.0 if blocked else 0.0))
    return scored.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def fit(labelled: DataFrame, n: int, sample: int, seed: int):
    """Trees on about ``sample`` of the ``n`` labelled rows, by a hash of the row."""
    part = min(1.0, sample / n)
    some = labelled.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))
    some = some if part < 1 else labelled
    some = cut_lineage(some.select(*FEATURES, "label"))  # read by each round
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(some).select("features", "label")
    return GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=seed).fit(data)


def _to_array(c):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(c))


@llm_query("op2_url_filter")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge(table(spark, folder, "pages"))
