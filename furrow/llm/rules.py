"""Quality rules: counted repetition and symbols, and a log-likelihood ratio of hashed n-grams.

All of it is Catalyst expressions. The ratio compares a trusted-target with the
raw-corpus multinomial over hashed unigrams and bigrams of word and punctuation
runs; a text's verdict is its mean over the text's n-grams against a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.folder import table, written

BINS = 16_384
SMOOTHING = 1.0
#: Mean log-likelihood ratio per n-gram below which a text is rejected.
THRESHOLD = -0.25
#: Rows of marks of trusted ids up to which they are broadcast, of some 30 bytes each.
MAX_MARKS = 4_000_000
#: Between words, and runs that are tokens of their own, as runs of anything else but white space are. Java's own classes for
#: ASCII white space and punctuation take a fraction of the time of classes spelled out as ranges, and spaces set around
#: such runs half that of a pattern that looks around at every character; regexp_extract_all would copy the whole text for each token.
_SPACE = r"\s+"
_BETWEEN = r"\p{Punct}+"


def _parts(df: DataFrame, name: str, between: str = "") -> DataFrame:
    """df with the runs between white space of its whole texts (null, or nothing else: none), those that match a pattern, if any, apart from the rest."""
    text = F.coalesce("text", F.lit(""))
    text = F.regexp_replace(text, between, " $0 ") if between else text
    df = df.withColumn(name, F.split(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), _SPACE))
    return df.withColumn(name, F.expr(f"if(get({name}, 0) = '', slice({name}, 1, 0), {name})"))  # only a text without words has an empty part


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with __one, a hash per token of the whole text (null: none), and __two, the bin of each bigram."""
    tokens = _parts(docs, "__tokens", _BETWEEN)
    hashes = tokens.withColumn("__one", F.expr("transform(__tokens, t -> xxhash64(t))")).drop("__tokens")
    return hashes.withColumn("__two", F.expr(f"transform(slice(__one, 1, greatest(size(__one) - 1, 0)), (h, i) -> cast(pmod(xxhash64(h, get(__one, i + 1)), {BINS}) as int))"))


def _marks(ids: DataFrame) -> tuple[DataFrame, list[str], str]:
    """Trusted ids as rows to join with documents, the keys as expressions on doc_id, and the condition of a match.

    Whole numbers come 64 to a row, a bit each: dense ids take an eighth of a byte.
    """
    if dict(ids.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        rows = ids.groupBy(F.expr("shiftright(cast(doc_id as bigint), 6)").alias("__key")).agg(F.bit_or(F.expr("shiftleft(1L, cast(doc_id & 63 as int))")).alias("__bits"))
        return rows, "shiftright(cast(doc_id as bigint), 6)", "coalesce((shiftrightunsigned(__bits, cast(doc_id & 63 as int)) & 1) = 1, false)"
    return ids.select(F.col("doc_id").alias("__key"), F.lit(1).alias("__bits")).distinct(), "doc_id", "__bits is not null"


def _bins(docs: DataFrame, *more: str) -> DataFrame:
    """A row per n-gram of docs with its bin (null for a text without any) and more columns."""
    # explode_outer: for explode, Catalyst infers a filter that repeats the whole tokenising inside a lambda
    bins = F.expr(f"concat(transform(__one, h -> cast(pmod(h, {BINS}) as int)), __two)")
    return _hashed(docs).select(bins.alias("bins"), *more).select(F.explode_outer("bins").alias("bin"), *more)


def ratio_weights(docs: DataFrame, trusted: DataFrame, most: int = MAX_MARKS) -> list[float]:
    """Log ratio of the trusted to the raw multinomial for each bin, both smoothed.

    Raw counts are over all docs, target counts over all of them that trusted
    (doc_id) names. Without any the ratios are those of a uniform target. No text
    is shuffled while the marks of the trusted ids, which are counted, are most
    rows at most and travel by broadcast. Beyond, the raw counts need no join,
    and the texts of trusted documents alone are dealt by id.
    """
    ids = trusted.where("doc_id is not null").select("doc_id")
    marks, key, hit = _marks(ids)
    marks = written(marks, "marks")
    n, target_n = F.count(F.lit(1)).alias("raw"), F.count_if("__trusted").alias("target")
    texts = docs.select("doc_id", "text").withColumn("__key", F.expr(key))
    if marks.count() <= most:
        marked = texts.join(F.broadcast(marks), "__key", "left").withColumn("__trusted", F.expr(hit))
        counts = _bins(marked, "__trusted").groupBy("bin").agg(n, target_n)
    else:
        target = _bins(texts.join(marks, "__key").where(hit)).groupBy("bin").agg(F.count(F.lit(1)).alias("target"))
        counts = _bins(texts).groupBy("bin").agg(n).join(target, "bin", "left").fillna(0, ["target"])
    raw, target = [0] * BINS, [0] * BINS
    for b, r, t in counts.select("bin", "raw", "target").collect():  # BINS rows at most, and one of texts without n-grams
        if b is not None:
            raw[b], target[b] = r, t
    off_t, off_r = (math.log(sum(x) + SMOOTHING * BINS) for x in (target, raw))
    return [math.log(t + SMOOTHING) - off_t - math.log(r + SMOOTHING) + off_r for t, r in zip(target, raw, strict=True)]


def base_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. Null texts count as empty."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    df = _parts(df, "__words")
    df = df.withColumns({"n_words": F.size("__words").cast("long"), "__hashes": F.expr("transform(__words, w -> xxhash64(w))")})
    df = df.withColumns(
        {
            "word_chars": F.expr("cast(length(array_join(__words, '')) as bigint)"),
            "n_symbols": F.expr("cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '')) as bigint)"),
            "__lines": F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
            "__grams": F.expr("transform(slice(__hashes, 1, cast(greatest(n_words - 4, 0) as int)), (h, i) -> xxhash64(h, get(__hashes, i + 1), get(__hashes, i + 2), get(__hashes, i + 3), get(__hashes, i + 4)))"),
        }
    )
    df = df.drop("__words", "__hashes").withColumns(
        {
            "n_dup_lines": F.expr("cast(size(__lines) - size(array_distinct(__lines)) as bigint)"),
            # only texts with a repeated window pay for sorting their windows
            "__sorted": F.expr("if(size(array_distinct(__grams)) = size(__grams), null, sort_array(transform(__grams, (h, i) -> struct(h, i))))"),
        }
    )
    df = df.drop("__lines", "__grams").withColumn(
        "__at", F.expr("sort_array(transform(filter(__sorted, (x, j) -> coalesce(x.h = get(__sorted, j - 1).h, false) or coalesce(x.h = get(__sorted, j + 1).h, false)), x -> x.i))")
    )
    covered = "aggregate(__at, struct(0L as n, 0 as upto), (a, p) -> struct(a.n + (p + 5 - greatest(a.upto, p)) as n, p + 5 as upto), a -> a.n)"
    df = df.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0L)")).drop("__sorted", "__at")
    return df.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, mean_ratio and kept.

    kept is false if base_failed, else whether mean_ratio >= threshold. Texts
    without n-grams have mean_ratio 0. The weights are one constant of BINS doubles.
    """
    weights = ",".join(f"{w:.6f}" for w in ratio_weights(docs, trusted))
    df = _hashed(base_rules(docs.select("doc_id", "text"))).drop("text")
    table_ = f"cast(split('{weights}', ',') as array<double>)"
    total = f"aggregate(__one, 0D, (a, h) -> a + get({table_}, cast(pmod(h, {BINS}) as int))) + aggregate(__two, 0D, (a, b) -> a + get({table_}, b))"
    df = df.withColumn("mean_ratio", F.expr(f"({total}) / greatest(size(__one) + size(__two), 1)"))
    return df.drop("__one", "__two").withColumn("kept", ~F.col("base_failed") & (F.col("mean_ratio") >= threshold))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)
