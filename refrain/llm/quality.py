"""Operator 3, quality rules: fixed rules, then gradient-boosted trees over document statistics.

One pass over the texts computes the statistics, which are written; the trees are fitted on the
driver on about ``sample`` labelled rows (those with the smallest hash of their id) and sent to
the executors as numpy arrays, which score the statistics a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.boosting import Forest, fit
from refrain.llm.scratch import Scratch, read

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A statistic and how quality may depend on it: 1 only rise, -1 only fall, 0 either.
STATISTICS = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "stop_share": 0,
    "digit_share": 0,
    "upper_share": 0,
    "words_per_line": 0,
    "longest_word": 0,
}
SAMPLE = 20_000


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, each word once."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ ids[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((edge.cumsum() > 0).sum())


def statistics(text: str) -> tuple:
    """COUNTS, then STATISTICS, of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: blanks are ASCII only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    full = [x for x in lines if x.strip(BLANKS)]
    dup = len(full) - len(set(full))
    repeat = repeated_words(words)
    some = max(1, n)
    chars = max(1, word_chars)
    digits = sum(map(text.count, "0123456789"))
    stops = sum(w[-1:] in (b".", b"!", b"?") for w in words)
    upper = sum(w[:1].isupper() for w in words)
    more = (
        float(np.log1p(n)), word_chars / some, symbols / some, dup / max(1, len(full)), repeat / some, len(set(words)) / some,
        stops / some, digits / chars, upper / some, n / max(1, len(full)), float(max(map(len, words), default=0)),
    )
    return (n, word_chars, symbols, dup, repeat, *more)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, STATISTICS of every row; null texts count as empty."""
    names = [*COUNTS, *STATISTICS]
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in STATISTICS)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([statistics(t or "") for t in batch["text"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            # pandas reads a long column with nulls as floats, exact to 2**53; Int64 brings the nulls back.
            yield out.astype({"doc_id": "Int64"} | dict.fromkeys(COUNTS, "int64") | dict.fromkeys(STATISTICS, "float64"))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, y of about ``sample`` labels, those with the least hashes; never more than twice as many.

    The hash is cut where that many are expected, so that nothing is sorted; the bound lets the rows be broadcast.
    """
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"))
    share = sample / max(1, known.count())
    if share < 1:
        known = known.filter(F.xxhash64("doc_id", F.lit(3)) <= int(-(2**63) + share * 2**64))
    return known.limit(2 * sample)


def fit_quality(stats: DataFrame, chosen: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Trees for P(quality = 1), or None where the labels chosen by ``labelled_sample`` do not hold both classes.

    At most 2 * ``sample`` rows reach the driver.
    """
    rows = stats.join(F.broadcast(chosen), "doc_id").select("y", *STATISTICS).limit(2 * sample).collect()
    rows.sort()  # the fit does not depend on the order in which tasks end
    data = np.array([tuple(r) for r in rows], float).reshape(len(rows), len(STATISTICS) + 1)
    y, x = data[:, 0], data[:, 1:]
    if len(np.unique(y)) < 2:
        return None
    return fit(x, y, list(STATISTICS.values()))


def quality(docs: DataFrame, labels: DataFrame, *, least_words: int = 10, most_repeat: int = 20, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, score (null without a model), kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeat`` per cent of them
    in repeated windows. kept is false for those, else it says whether P(quality = 1) reaches
    ``threshold``. Null and empty texts fail. Labels of unknown documents or other values than 0
    and 1 are ignored; without labels of both classes, base_failed decides alone. Repeated rows
    are judged each. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.table(document_statistics(docs), "stats")
    model = fit_quality(stats, labelled_sample(labels, sample), sample)
    cut = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.concat([batch[["doc_id", *COUNTS]], verdict(batch, model, least_words, most_repeat, cut)], axis=1)
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return stats.mapInPandas(run, schema)


def verdict(stats: pd.DataFrame, model: Forest | None, least_words: int, most_repeat: int, cut: float) -> pd.DataFrame:
    """base_failed, score and kept of rows of statistics."""
    failed = (stats["n_words"] < least_words) | (100 * stats["n_repeat_words"] > most_repeat * stats["n_words"])
    score = model.score(stats[list(STATISTICS)].to_numpy(float)) if model else np.full(len(stats), np.nan)
    return pd.DataFrame({"base_failed": failed, "score": score, "kept": ~failed & ((score >= cut) if model else True)}, index=stats.index)


def keep_good(docs: DataFrame, labels: DataFrame, *, least_words: int = 10, most_repeat: int = 20, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that ``quality`` keeps, with all their columns, without moving a text.

    For the fit, statistics are computed of the labelled documents of the sample only; then a pass computes each
    text's statistics and filters the row where it stands.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    chosen = scratch.table(labelled_sample(labels, sample), "chosen")
    labelled = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit_quality(document_statistics(labelled), chosen, sample)
    cut = float(np.log(threshold / (1 - threshold)))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        stats = pd.DataFrame([statistics(t or "") for t in texts], columns=[*COUNTS, *STATISTICS])
        return verdict(stats, model, least_words, most_repeat, cut)["kept"].astype(bool)

    return docs.filter(good(F.col("text")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
