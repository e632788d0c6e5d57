"""Quality rules on documents, and verdicts on the hosts they come from.

DataFrame functions only. Every measure of a document is worked out within its row,
so no word is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portolan.llm.common import BLANKS, blanked, let, with_row, words, written

MIN_WORDS = 50
MOST_REPEATED = 50          # per cent of the words
MOST_FAILURES = 0.5         # shrunk share of a host's documents that fail
WINDOW = 3
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def repeated_words(word: Column) -> Column:
    """How many words of an array lie in a window of three that occurs in it twice or more.

    Windows are compared by 64-bit hash: sorted with their places, equal ones are
    neighbours. A text without equal windows is not sorted.
    """
    def covered(places: Column) -> Column:
        gap = F.transform(places, lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gap, F.lit(0), lambda total, g: total + g)

    def places_of_equals(ranked: Column) -> Column:
        equal = F.filter(ranked, lambda x, i: F.coalesce(
            x.h == F.get(ranked, i - 1).h, F.lit(False)) | F.coalesce(
            x.h == F.get(ranked, i + 1).h, F.lit(False)))
        return F.array_sort(F.transform(equal, lambda x: x.i))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(word) - WINDOW),
        lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(WINDOW)]))

    def count(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(
            hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(let(ranked, places_of_equals), covered))

    return F.when(F.size(word) < WINDOW, 0).otherwise(let(windows, count))


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text; a NULL text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    counted = let(words(text), lambda word: F.struct(
        F.size(word).alias("n"), repeated_words(word).alias("repeated")))
    with_word = F.filter(F.split(text, "\n"), lambda line: F.trim(blanked(line)) != "")
    found = {
        "word_counts": counted,
        "word_chars": F.char_length(F.translate(text, BLANKS, "")),
        "n_symbols": F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": let(with_word, lambda line: F.size(line) - F.size(F.array_distinct(line))),
    }
    return found


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(row, host, *MEASURES, base_failed) of each document, `row` the whole input row."""
    raw = with_row(docs, host=F.col(host).cast("string"), **measures(F.col("text")))
    counts = {"n_words": F.col("word_counts.n"), "n_repeat_words": F.col("word_counts.repeated")}
    typed = raw.select("row", "host", *[
        counts.get(m, F.col(m)).cast("bigint").alias(m) for m in MEASURES])
    return typed.withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words")))


def host_rates(measured_docs: DataFrame) -> DataFrame:
    """(host, docs, failures, rate): each host's failure rate, shrunk to the common one.

    Failures are counted per task before the shuffle, so a host with a third of all
    documents is one row per task. The prior is a beta distribution fitted to the
    hosts by moments: its mean is the common rate m; the spread of the hosts' rates
    beyond what chance gives sets its strength

        k = m (1 - m) / (spread - chance) - 1,   rate = (failures + k m) / (docs + k).

    Where chance explains all spread, or the hosts all fail or all pass, every rate
    is m. NULL is a host of its own.
    """
    hosts = measured_docs.groupBy("host").agg(
        F.count("*").alias("docs"), F.count_if("base_failed").alias("failures"))
    all_docs, share = F.sum("docs"), F.sum("failures") / F.sum("docs")
    own = F.col("failures") * F.col("failures") / F.col("docs")
    spread = F.sum(own) / all_docs - share * share
    chance = F.count("*") * share * (1 - share) / all_docs
    excess = spread - chance
    prior = hosts.agg(F.struct(
        share.alias("m"),
        F.when(excess > 0, F.greatest(share * (1 - share) / excess - 1, F.lit(0.0))).alias("k")))
    fitted = F.col("prior")
    shrunk = (F.col("failures") + fitted.k * fitted.m) / (F.col("docs") + fitted.k)
    return hosts.withColumn("prior", prior.scalar()).select(
        "host", "docs", "failures", F.coalesce(shrunk, fitted.m).alias("rate"))


def with_verdicts(measured_docs: DataFrame) -> DataFrame:
    """`measured_docs` plus `host_rate` and `kept`.

    `measured_docs` is read twice: for the hosts and for the join, so hand in a
    written table. A host is judged by its rate; a document is kept if it passes
    and its host does. Hosts are written, so that Spark knows their size: under its
    limit they are broadcast and no row is shuffled, else sort-merged with hot hosts
    split.
    """
    hosts = written(host_rates(measured_docs).select(F.col("host").alias("_host"), "rate"), "hosts")
    return measured_docs.join(
        hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host").withColumn(
        "kept", ~F.col("base_failed") & (F.col("rate") <= MOST_FAILURES)).withColumnRenamed(
        "rate", "host_rate")


def judge_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, *MEASURES, base_failed, host, host_rate, kept), one row per document.

    Texts are read once; the measures are written and the rest works on them. Empty
    and NULL texts have no words and fail; repeated rows are judged each; an empty
    table gives no rows; other columns of `docs` are not touched.
    """
    slim = measured(docs, host).select(F.col("row.doc_id").alias("doc_id"), "host", *MEASURES,
                                       "base_failed")
    return with_verdicts(written(slim, "measures"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of `docs` that are kept, all columns.

    The rows that pass on their own are written with the verdicts' input in one pass
    over the texts; those of rejected hosts go in the join.
    """
    judged = measured(docs, host).select(
        F.when(~F.col("base_failed"), F.col("row")).alias("row"), "host", "base_failed")
    return with_verdicts(written(judged, "measures")).where("kept").select("row.*")
