"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

A rule rejects a document whose measure exceeds a cutoff. The cutoffs of all rules are put in one
fixed order, so that each step rejects what the steps before it do and more. For a stratum, a step is
safe if an exact binomial test on the labelled documents shows that the steps up to it, together,
reject at most the allowed share of good documents. Steps are tested in their order and only up to
the first that fails, which needs no correction for their number; the error level is shared by the
strata alone (Bonferroni). What is tested is what is promised, the rejections of all rules together,
so no share is set aside for each rule. Without a safe step, a stratum is held to the base rules.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir

#: ASCII white space, as in the word rule.
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Strata up to this number are broadcast; beyond it they are joined by shuffle.
BROADCAST_STRATA = 10_000
#: Partitions of tables with a row for each stratum.
FEW_FILES = 4


@dataclass(frozen=True)
class RiskControl:
    """At most ``share`` of a stratum's good documents are rejected, with probability 1 - ``error`` for all strata at once."""

    share: float = 0.01
    error: float = 0.05


#: Rules and cutoffs in the order of their tests; a document is rejected if its measure is above the cutoff. All stand well clear of ordinary prose, those that come closest to it last.
STEPS: tuple[tuple[str, float], ...] = (
    ("symbols_per_word", 0.8),
    ("symbols_per_word", 0.4),
    ("symbols_per_word", 0.2),
    ("symbols_per_word", 0.1),
    ("long_words", 12.0),
    ("long_words", 10.0),
    ("short_words", -2.5),
    ("short_words", -3.0),
    ("duplicate_lines", 0.7),
    ("duplicate_lines", 0.5),
    ("long_words", 9.0),
    ("short_words", -3.5),
    ("duplicate_lines", 0.3),
    ("long_words", 8.0),
)


def with_measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_word_lines and base_failed, their names under ``prefix``.

    A null text has no words. The steps stand in separate projections because a later one uses an
    array several times; no column of the input is replaced unless it bears one of these names.
    """
    p = lambda name: F.col(f"`{prefix}{name}`")
    step = lambda df, **cols: df.withColumns({prefix + k: v for k, v in cols.items()})
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = step(
        docs,
        _words=F.filter(F.split(text, WORD_GAP), lambda w: w != ""),
        _lines=F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, WORD_GAP, "") != ""),
        n_symbols=F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
    )
    out = step(
        out,
        n_words=F.size(p("_words")).cast("long"),
        word_chars=F.length(F.array_join(p("_words"), "")).cast("long"),
        n_word_lines=F.size(p("_lines")).cast("long"),
        n_dup_lines=(F.size(p("_lines")) - F.size(F.array_distinct(p("_lines")))).cast("long"),
        _hashes=F.transform(p("_words"), lambda w: F.xxhash64(w)),
    )
    # five-word windows by hash; only where two agree are the words themselves compared
    window = lambda col, i: [F.get(p(col), i + k) for k in range(5)]
    places = F.sequence(F.lit(0), p("n_words").cast("int") - 5)
    out = step(out, _windows=F.when(p("n_words") >= 6, F.transform(places, lambda i: F.xxhash64(*window("_hashes", i)))))
    out = step(out, _again=F.coalesce(F.size(F.array_distinct(p("_windows"))) < F.size(p("_windows")), F.lit(False)))
    out = step(out, _sorted=F.when(p("_again"), F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window("_words", i)).alias("w"), i.alias("i"))))))
    near = lambda i, k: F.get(p("_sorted"), i + k)["w"].eqNullSafe(F.get(p("_sorted"), i)["w"])
    found = F.filter(F.sequence(F.lit(0), F.size(p("_sorted")) - 1), lambda i: near(i, 1) | near(i, -1))
    out = step(out, _places=F.when(p("_again"), F.sort_array(F.transform(found, lambda i: F.get(p("_sorted"), i)["i"]))))
    # each place covers five words or as many as lie before the next place
    covered = F.aggregate(
        p("_places"),
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    out = step(out, n_repeat_words=F.coalesce(F.when(p("_again"), covered), F.lit(0).cast("long")))
    out = step(out, base_failed=(p("n_words") < 10) | (100 * p("n_repeat_words") > 20 * p("n_words")))
    return out.drop(*(prefix + c for c in ("_words", "_lines", "_hashes", "_windows", "_again", "_sorted", "_places")))


def rule_measures(prefix: str = "") -> dict[str, Column]:
    """The measure that each rule of ``STEPS`` compares with its cutoff."""
    p = lambda name: F.col(f"`{prefix}{name}`").cast("double")
    words = F.greatest(p("n_words"), F.lit(1.0))
    return {
        "symbols_per_word": p("n_symbols") / words,
        "duplicate_lines": p("n_dup_lines") / F.greatest(p("n_word_lines"), F.lit(1.0)),
        "long_words": p("word_chars") / words,
        "short_words": -p("word_chars") / words,
    }


def log_gamma(x: Column) -> Column:
    """ln(Gamma(x)) for x >= 1 by Stirling's series at x + 8."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    return series - reduce(lambda a, b: a + b, (F.log(x + k) for k in range(8)))


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(X <= k) for X binomial(n, share), to ten digits or more where k is below the mean; 1 from there on.

    The terms fall from k downwards, so those beyond some standard deviations are nothing to a double.
    """
    nd, kd = n.cast("double"), k.cast("double")
    top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(share) + (nd - kd) * math.log1p(-share)
    steps = F.least(k, F.ceil(F.sqrt(nd) * 12) + 50).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.exp(top).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * (kd - j) * (1 - share) / ((nd - kd + j + 1) * share)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when((n > 0) & (kd < nd * share), total).otherwise(F.lit(1.0))


def first_step(prefix: str = "") -> Column:
    """The first step that rejects a document, from 0; as many as there are steps if none does."""
    measures = rule_measures(prefix)
    return F.least(F.lit(len(STEPS)), *(F.when(measures[rule] > c, F.lit(i)) for i, (rule, c) in enumerate(STEPS)))


def safe_steps(measured: DataFrame, labels: DataFrame, stratum_col: str, *, control: RiskControl = RiskControl(), id_col: str = "doc_id", label_col: str = "quality", prefix: str = "") -> DataFrame:
    """One row for each stratum with a good document: stratum, n (good documents) and steps, the number of steps that are safe.

    measured: the documents' measures with id and stratum. No rule is fitted to the labels, so all
    labelled documents are the holdout. Several labels of one document count once, as good if one is, and so
    do several rows of it in a stratum, as rejected by a step if one of them is: copies prove nothing.
    """
    good = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_labelled")).agg(F.max(label_col).alias("_good")).where(F.col("_good") == 1)
    rows = measured.join(good, F.col(id_col) == F.col("_labelled")).where(~F.col(f"`{prefix}base_failed`"))
    # a document counts once however many rows it has, as rejected by the first step that rejects one of them
    held = rows.groupBy(F.col(stratum_col).alias("stratum"), "_labelled").agg(F.min(first_step(prefix)).alias("_first"))
    # a row for each stratum: few files will do
    counts = cut(held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col("_first") <= i).alias(f"k{i}") for i in range(len(STEPS)))).coalesce(FEW_FILES))
    each = counts.select("stratum", "n", F.inline(F.array(*(F.struct(F.lit(i).alias("step"), F.col(f"k{i}").alias("k")) for i in range(len(STEPS))))))
    strata = counts.agg(F.count("*").alias("strata"))
    tests = each.crossJoin(F.broadcast(strata))  # one row
    fails = binomial_tail(F.col("n"), F.col("k"), control.share) > F.lit(control.error) / F.col("strata")
    return tests.groupBy("stratum", "n").agg(F.coalesce(F.min(F.when(fails, F.col("step"))), F.lit(len(STEPS))).alias("steps")).coalesce(FEW_FILES)


def with_verdict(measured: DataFrame, safe: DataFrame, stratum_col: str, prefix: str = "") -> DataFrame:
    """measured with kept: not base_failed, and not rejected by a safe step of its stratum."""
    renamed = safe.select(F.col("stratum").alias("_stratum"), F.col("steps").alias("_steps"))
    if safe.count() <= BROADCAST_STRATA:
        renamed = F.broadcast(renamed)
    joined = measured.join(renamed, F.col(f"`{stratum_col}`").eqNullSafe(F.col("_stratum")), "left")
    rejected = F.coalesce(first_step(prefix) < F.col("_steps"), F.lit(False))
    return joined.withColumn(f"{prefix}kept", ~(F.col(f"`{prefix}base_failed`") | rejected)).drop("_stratum", "_steps")


def judge_quality(docs: DataFrame, labels: DataFrame, *, stratum_col: str = "lang", control: RiskControl = RiskControl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and the verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. A
    null or empty text has no words and fails. A null stratum is a stratum of its own; documents of a
    stratum without safe steps are only held to the base rules. A null id is judged but can't be
    labelled. Repeated rows are judged each; other columns are not read; empty tables give an empty
    result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum_col).alias("stratum"))
    measured = cut(with_measures(slim).drop("text"))
    safe = cut(safe_steps(measured, labels.withColumnRenamed(id_col, "doc_id"), "stratum", control=control))
    return with_verdict(measured, safe, "stratum").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, stratum_col: str = "lang", control: RiskControl = RiskControl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that ``judge_quality`` rejects; their columns and further ones stay as they are.

    Measures are taken once and written beside the documents in the shared folder; the tests then read
    the measures alone.
    """
    store = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/measured-{uuid.uuid4().hex}"
    with_measures(docs, text_col, "_q_").write.parquet(store)
    measured = docs.sparkSession.read.schema(with_measures(docs, text_col, "_q_").schema).parquet(store)
    slim = measured.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum_col}`").alias("stratum"), *(F.col(f"`{c}`") for c in measured.columns if c.startswith("_q_") and c not in docs.columns))
    safe = cut(safe_steps(slim, labels.withColumnRenamed(id_col, "doc_id"), "stratum", control=control, prefix="_q_"))
    return with_verdict(measured, safe, stratum_col, "_q_").where("_q_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
