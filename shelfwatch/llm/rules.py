"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Every document gets integer rates (symbols, repeated lines, repeated words, word length). Per
language and source each rate is gathered in a quantile sketch: a histogram over buckets of 1/32
relative width, which merges by adding counts, so it is one map-side combined aggregate with a
bounded number of rows per group, however many rows a source has. The threshold of a rate is a fence
above two quantiles of its group, hi + k * (hi - lo), widened by one bucket. ``FENCES`` names them: word lengths lie
around a middle, so quartiles serve; symbols are 0 in most prose, so the upper half is looked at, and where its
tenth is 0, too, no symbols are the norm; repeated lines and words do occur in good prose, so only the last hundredth
says what is too much. No threshold is a number given beforehand. The smaller a group, the more its threshold leans
on that of its language, and that on the one of all: n documents have a weight of n^2 against ``TRUST``^2.

Results in special cases: a NULL or empty text has no words, all counts 0, and fails the base
rule. NULL languages and sources are groups of their own. Repeated rows each get the same verdict.
An empty table gives an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwatch.llm.common import columns_of, pin, shield, without

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
MIN_WORDS = 50
TRUST = 30  # documents at which a group's own threshold and that of its language weigh the same
BUCKETS = 32  # of the sketch, between a value and its double
BROADCAST_GROUPS = 100_000
# Per rate the percents of the low and the high quantile and how far beyond them the fence stands.
FENCES = {"symbol_rate": (50, 90, 3), "dup_line_rate": (90, 99, 1), "repeat_rate": (90, 99, 1), "word_length": (25, 75, 3)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(windows: Column) -> Column:
    """Words in windows that occur twice: sort (hash, place), keep equal neighbours, add up the cover."""
    def places(s: Column) -> Column:
        twin = lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def cover(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - p)).cast("long").alias("n"), (p + 3).alias("end"))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    total = F.aggregate(_let(ordered, places), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
                        cover, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of each text."""
    docs = without(docs, [*COUNTS, "__words", "__lines", "__windows"])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *columns_of(docs),
        F.array_remove(F.split(text, SPACE), "").alias("__words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    words = F.col("__words")
    rows = rows.select(
        "*",
        F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
                    lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).alias("__windows"))
    return rows.select(
        *columns_of(docs),
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__windows")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    def part(a: str, b: str, unit: int) -> Column:
        return F.when(F.col(b) > 0, F.floor(F.col(a) * unit / F.col(b))).otherwise(0).cast("long")

    return {"symbol_rate": part("n_symbols", "word_chars", 10_000), "dup_line_rate": part("n_dup_lines", "n_lines", 10_000),
            "repeat_rate": part("n_repeat_words", "n_words", 10_000), "word_length": part("word_chars", "n_words", 100)}


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket: values under 64 are exact, others keep six leading bits."""
    width = F.expr("1L") * F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return value - value % width


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): the mergeable sketch of every rate, over documents with words."""
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bucket(v).alias("bucket")) for k, v in rates().items()]))
    return (measured.where("n_words > 0").select("lang", "source", of.alias("r"))
            .groupBy("lang", "source", F.col("r.rate").alias("rate"), F.col("r.bucket").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def _of_rate(place: int) -> Column:
    out = F.lit(0)
    for rate, fence in FENCES.items():
        out = F.when(F.col("rate") == rate, F.lit(fence[place])).otherwise(out)
    return out


def _fences(buckets: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Number of documents and fence of each merged sketch; a group has a bounded number of buckets."""
    merged = buckets.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rate")
    ranked = merged.select("*", F.sum("n").over(group).alias("total"), F.sum("n").over(group.orderBy("bucket")).alias("upto"))

    def quantile(place: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("total") * _of_rate(place), F.col("bucket")))

    found = ranked.groupBy(*keys, "rate").agg(F.max("total").alias("total"), quantile(0).alias("lo"), quantile(1).alias("hi"))
    fence = F.col("hi") + _of_rate(2) * (F.col("hi") - F.col("lo"))
    return found.select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], F.col("rate").alias(f"{tag}_rate"),
                        F.col("total").cast("double").alias(f"{tag}_total"), fence.cast("double").alias(f"{tag}_fence"))


def thresholds(buckets: DataFrame, trust: int = TRUST) -> DataFrame:
    """One row per language and source with the threshold of each rate."""
    own, lang, every = _fences(buckets, ["lang", "source"], "own"), _fences(buckets, ["lang"], "lang"), _fences(buckets, [], "all")
    joined = (own.join(lang, F.col("own_lang").eqNullSafe(F.col("lang_lang")) & (F.col("own_rate") == F.col("lang_rate")))
              .join(every, F.col("own_rate") == F.col("all_rate")))
    prior = F.lit(float(trust * trust))

    def leaning(tag: str, other: Column) -> Column:
        weight = F.col(f"{tag}_total") * F.col(f"{tag}_total")
        return (weight * F.col(f"{tag}_fence") + prior * other) / (weight + prior)

    fence = leaning("own", leaning("lang", F.col("all_fence")))
    limit = F.floor(fence + fence / BUCKETS).cast("long")
    return joined.groupBy(F.col("own_lang").alias("__lang"), F.col("own_source").alias("__source")).agg(
        *[F.max(F.when(F.col("own_rate") == r, limit)).alias(f"__max_{r}") for r in FENCES])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept, by a join with the thresholds of its group.

    The thresholds are a row per language and source; up to ``BROADCAST_GROUPS`` of them are broadcast, so
    that texts are not shuffled by so coarse a key. More are joined by shuffle.
    """
    measured = without(measured, ["base_failed", "kept"])
    limits = pin(limits, "limits")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    within = F.lit(True)
    for name, value in rates().items():
        within = within & (value <= F.col(f"__max_{name}"))
    return joined.select(*columns_of(measured), base_failed().alias("base_failed"),
                         (~base_failed() & F.coalesce(within, F.lit(False))).alias("kept"))


def adaptive_rules(docs: DataFrame, keep_text: bool = True, trust: int = TRUST) -> DataFrame:
    """``docs`` with counts, base_failed and kept. Texts are read once; the counts are written down,
    as both the sketches and the verdict need them. ``keep_text=False`` leaves the text out of that table."""
    measured = measure(docs)
    measured = pin(measured if keep_text else measured.drop("text"), "rules")
    return judge(measured, thresholds(sketch(measured), trust))


def filter_documents(docs: DataFrame, trust: int = TRUST) -> DataFrame:
    """The columns of ``docs``, of the documents that the rules keep."""
    docs, back = shield(docs, [*COUNTS, "base_failed", "kept"])
    return back(adaptive_rules(docs, trust=trust).where("kept"))
