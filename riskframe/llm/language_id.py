"""Language identification by Bayesian evidence fusion.

Four kinds of evidence make one posterior over languages:

* the text: letter trigrams under each language, multinomial, counted over all texts that declare a language;
* the declared markup language: how often texts that read like a language declare each tag;
* the address suffix and the host: shares of languages, smoothed from all rows to the suffix to the host, so
  that a host with few rows leans on its suffix.

No row confirms itself: its trigrams are taken out of the language it declares before it is scored, its reading out
of its host's share.  A language's trigrams are smoothed with a fixed share of those of all rows and weigh the less the
fewer other rows declare it, so a stray tag fits neither its own text nor others, and a language of a few rows does.

A text may also fit none of the languages.  Its background has all trigrams equally likely, or as unlikely as those of
the text at the ``LEAST_FIT`` quantile of the rows that declare the language it reads like, whichever is less.

The counts are grouped aggregates over all rows.  A text is read twice (counting, scoring) and never shuffled; what
moves are trigram counts (languages x ``BUCKETS``) and one short row for each text, with a number for each language.
Every declared language is known, however rare, so the model grows with the number of different declarations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.batches import bounded, record_batch
from riskframe.llm.registry import llm_query, table
from riskframe.llm.skew import salted_join
from riskframe.session import cut_lineage

#: Buckets of trigrams, by hash.
BUCKETS = 1 << 14
#: Text that a task turns into trigrams at once; the arrays of each byte take some sixty times as much.
HELD_BYTES = 1 << 20
#: Share of all rows' trigrams in those of each language.
SMOOTHING = 0.1
#: Rows a language needs for half of its weight.
HALF_ROWS = 10.0
#: Prior of a text that fits no language, and the share of a language's declared texts that may fit it worse.
NONE, LEAST_FIT = 0.01, 0.01
#: Overlapping trigrams count each letter three times: what a text says is divided by so much.
OVERLAP = 3.0
#: Rows that a suffix or a host needs to weigh as much as what it is smoothed with.
WEIGHT = 10.0


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts, and the text each belongs to.  Bytes that are no letters are blanks,
    A-Z count in lower case; trigrams of blanks only, and across texts, are left out."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or bounds[-1] - bounds[0] < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = _LETTERS[np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]].astype(np.uint32)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    key = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
    inside = (doc[:-2] == doc[2:]) & (key != _BLANKS)
    key = key[inside]
    return ((key * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), doc[:-2][inside]


_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_BLANKS = 32 << 16 | 32 << 8 | 32


def languages_of(rows: DataFrame) -> list[str]:
    """Declared languages."""
    return sorted(r[0] for r in rows.where("declared IS NOT NULL").select("declared").distinct().collect())


def text_counts(rows: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams by language and bucket, and rows with trigrams by language."""
    size = len(languages) * BUCKETS

    def run(batches):
        sums, rows_of = {}, np.zeros(len(languages), np.int64)
        place = pa.array(languages, pa.string())
        for batch in bounded(batches, "text", HELD_BYTES, 8192):
            known = pc.index_in(batch.column("declared"), value_set=place)
            at = np.asarray(pc.fill_null(known, -1))
            bucket, doc = trigrams(batch.column("text"))
            language = at[doc]
            some = language >= 0
            here = np.unique(at[at >= 0])
            each = np.bincount(np.searchsorted(here, language[some]) * BUCKETS + bucket[some], minlength=len(here) * BUCKETS)
            for i, row in zip(here.tolist(), each.reshape(-1, BUCKETS)):
                sums[i] = sums[i] + row if i in sums else row.copy()
            np.add.at(rows_of, at[np.unique(doc[some])], 1)
        for i, row in sums.items():
            where = np.flatnonzero(row)
            yield record_batch(i=pa.array(i * BUCKETS + where, pa.int64()), n=pa.array(row[where]))
        yield record_batch(i=pa.array(size + np.arange(len(languages)), pa.int64()), n=pa.array(rows_of))

    found = rows.select("declared", "text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    found = found.toArrow()  # languages x (BUCKETS + 1) rows at most
    counts = np.zeros(size + len(languages))
    counts[found["i"].to_numpy()] = found["n"].to_numpy()
    return counts[:size].reshape(-1, BUCKETS), counts[size:]


def log_model(counts: np.ndarray, rows_of: np.ndarray, total: np.ndarray, common: np.ndarray) -> np.ndarray:
    """log weights of trigrams that a language (of so many rows and trigrams in ``total``) has ``counts`` times."""
    weight = (1 - SMOOTHING) * rows_of / (rows_of + HALF_ROWS) / np.maximum(total, 1)
    return np.log(counts * weight + SMOOTHING * common)


def read_texts(rows: DataFrame, languages: list[str], counts: np.ndarray, rows_of: np.ndarray) -> DataFrame:
    """Rows without text, but with ``reading`` (log-likelihood by language, the declared one without this text) and
    ``letters`` (trigrams seen)."""
    common = counts.sum(axis=0) + 1.0
    common /= common.sum()
    totals = counts.sum(axis=1)
    shared = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(counts), rows_of, totals, common))
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        counts, rows_of, totals, common = shared.value
        logs = log_model(counts, rows_of[:, None], totals[:, None], common)
        place = pa.array(languages, pa.string())
        for batch in bounded(batches, "text", HELD_BYTES, 8192):
            bucket, doc = trigrams(batch.column("text"))
            n = len(batch.column("text"))
            each = np.stack([np.bincount(doc, row[bucket], n) for row in logs], axis=1)
            letters = np.bincount(doc, minlength=n).astype(np.int64)
            at = np.asarray(pc.fill_null(pc.index_in(batch.column("declared"), value_set=place), -1))
            key, times = np.unique((doc * BUCKETS + bucket)[at[doc] >= 0], return_counts=True)
            of, seen = key // BUCKETS, key % BUCKETS
            own = at[of]
            without = log_model(counts[own, seen] - times, rows_of[own] - 1, totals[own] - letters[of], common[seen])
            some = np.flatnonzero(at >= 0)
            each[some, at[some]] = np.bincount(of, times * without, n)[some]
            yield record_batch(**{c: batch.column(c) for c in names},
                               reading=pa.array((each / OVERLAP).tolist(), pa.list_(pa.float64())), letters=pa.array(letters))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, reading array<double>, letters long")


def best(values: str) -> Column:
    """Place of the largest entry, the first of equals, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def identify(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``(..., text, declared, host, suffix)`` without ``text``, ``host`` and ``suffix``, but with ``lang``,
    ``probability``, ``text_lang`` (by the text alone) and ``accepted``.

    A row is accepted if its text has letters and the posterior of ``lang`` is at least ``least``; the posterior that
    the text fits no known language counts against it.  Null and empty
    texts have no letters: they get the language that the other evidence favours, and are not accepted.  Null
    declarations, hosts and suffixes count as none.  Repeated rows count each, so a tag that copies share is theirs; an empty table, or one that
    declares no language, gives rows with null ``lang`` that are not accepted.
    """
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "suffix": F.coalesce("suffix", F.lit("")),
                             "text": F.coalesce("text", F.lit(""))})
    languages = languages_of(rows)
    if not languages:
        null = F.lit(None).cast("string")
        return rows.drop("text", "host", "suffix").withColumns({
            "lang": null, "probability": F.lit(None).cast("double"), "text_lang": null, "accepted": F.lit(False)})
    n = len(languages)
    rows = read_texts(rows, languages, *text_counts(rows, languages)).withColumn("first", best("reading"))
    tags = rows.sparkSession.createDataFrame([(x, i + 1) for i, x in enumerate(languages)], "declared string, tag int")
    rows = rows.join(F.broadcast(tags), "declared", "left").withColumn("tag", F.coalesce("tag", F.lit(0)))
    rows = rows.withColumn("fit", F.array_max("reading") + F.col("letters") * (np.log(BUCKETS) / OVERLAP))  # over equal trigrams
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))  # short rows
    names = F.lit(languages)

    counts = rows.where("letters > 0").groupBy("suffix", "host", "first", "tag").agg(F.count(F.lit(1)).alias("n"))
    # Declared tag (0: none or unknown) by reading: at most languages x (languages + 1) rows.
    table_ = np.full((n, n + 1), 1.0 / (n + 1))
    for first, tag, times in counts.groupBy("first", "tag").agg(F.sum("n")).collect():
        table_[first, tag] += times
    overall = (table_.sum(axis=1) / table_.sum()).tolist()
    declared = np.log(table_ / table_.sum(axis=1, keepdims=True))
    said = rows.sparkSession.createDataFrame([(tag, declared[:, tag].tolist()) for tag in range(n + 1)], "tag int, said array<double>")
    rows = rows.join(F.broadcast(said), "tag")
    fits = rows.where("letters > 0 AND tag = first + 1").groupBy("first").agg(
        F.percentile_approx(F.col("fit") / F.col("letters"), LEAST_FIT, 10_000).alias("usual"))
    rows = rows.join(F.broadcast(fits), "first", "left")

    def by(*keys):
        each = counts.groupBy(*keys, "first").agg(F.sum("n").alias("n")).groupBy(*keys).agg(  # a row for each language
            F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("n"))
        return each.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(
            F.try_element_at("n", i), F.lit(0).cast("long"))))

    both = salted_join(by("suffix", "host").toDF("suffix", "host", "in_host"), by("suffix").toDF("suffix", "in_suffix"),
                       ["suffix"], "host")
    rows = salted_join(rows, both, ["suffix", "host"], "row")
    zeros = F.array_repeat(F.lit(0), n).cast("array<bigint>")
    own = F.when(F.col("letters") > 0, 1).otherwise(0)

    def others(c):  # counts without the row's own reading
        return F.transform(F.coalesce(c, zeros), lambda x, i: x - F.when(i == F.col("first"), own).otherwise(0))

    def smoothed(counts_, below):
        whole = F.aggregate(counts_, F.lit(0).cast("bigint"), lambda a, b: a + b) + WEIGHT
        return F.transform(counts_, lambda x, i: (x + WEIGHT * F.get(below, i)) / whole)

    rows = rows.withColumn("at_suffix", others(F.col("in_suffix"))).withColumn("at_host", others(F.col("in_host")))
    rows = rows.withColumn("p_suffix", smoothed(F.col("at_suffix"), F.lit(overall)))
    rows = rows.withColumn("p_host", smoothed(F.col("at_host"), F.col("p_suffix")))
    rows = rows.withColumn("logs", F.transform("reading", lambda x, i: x + F.log(F.get("p_host", i))
                                               + F.get("said", i)))
    # What the tag, the address and a language's usual text say of texts of no language: the same as of its nearest.
    usual = F.least(F.coalesce("usual", F.lit(0.0)), F.lit(0.0))
    none = F.array_max("logs") - F.col("fit") + F.col("letters") * usual + float(np.log(NONE / (1 - NONE)))
    top = F.greatest(F.array_max("logs"), none)
    total = F.aggregate(F.transform("logs", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumn("probability", F.exp(F.array_max("logs") - top) / (total + F.exp(none - top)))
    out = rows.withColumns({
        "lang": F.get(names, best("logs")), "text_lang": F.when(F.col("letters") > 0, F.get(names, F.col("first"))),
        "accepted": (F.col("letters") > 0) & (F.col("probability") >= least)}).drop(
        "row", "host", "suffix", "reading", "letters", "first", "tag", "fit", "usual", "said", "in_suffix", "in_host",
        "at_suffix", "at_host", "p_suffix", "p_host", "logs")
    # Short rows; without this a filter on the result would be pushed down with all of the above written out in it.
    return cut_lineage(out)


def document_rows(docs: DataFrame, *keep: Column, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents as rows for ``identify``: the source is the host, with what follows its last '.' as suffix."""
    host = F.lower(F.col(source).cast("string"))
    return docs.select(*keep, F.col(text).cast("string").alias("text"), F.nullif(F.lower(F.col(lang).cast("string")), F.lit("")).alias("declared"),
                       host.alias("host"), F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1)).alias("suffix"))


def page_rows(pages: DataFrame, *keep: Column, url: str = "url", html: str = "html") -> DataFrame:
    """Pages as rows for ``identify``: visible text, the html element's lang, host and top-level suffix of the url."""
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ")
    lang = F.regexp_extract(F.col(html), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    host = F.lower(F.regexp_extract(F.col(url), r"://([^/?#:]*)", 1))
    return pages.select(*keep, text.alias("text"), F.lower(F.nullif(lang, F.lit(""))).alias("declared"),
                        host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


@llm_query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    rows = document_rows(table(spark, folder, "documents"), F.col("doc_id"))
    return identify(rows).select("doc_id", "lang", "probability", "text_lang", "declared", "accepted")


@llm_query("page_languages")
def page_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page, from text, markup and address."""
    rows = page_rows(table(spark, folder, "pages"), F.col("page_id"))
    return identify(rows).select("page_id", "lang", "probability", "text_lang", "declared", "accepted")
