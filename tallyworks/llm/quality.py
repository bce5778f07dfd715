"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects documents whose feature exceeds a cutoff. The rules are tightened one after
the other along one path of levels, each from lenient to strict down to its own floor; the
path is fixed beforehand. Labelled documents tell for each stratum (language) how far it
is safe: at a level the number of good documents that all rules together reject is held
against the exact binomial distribution, and the level is certified if so few would be
seen with probability ``delta`` or less were the true rate above ``alpha``. ``delta`` is
shared among the strata (Bonferroni); within one, testing goes from the most lenient level
on and ends with the first failure (fixed sequence), which needs no further correction. Of
the certified levels the one that rejects most bad documents is used, the most lenient
among equals. Rules passed on the way go back to the most lenient cutoff that catches the
same bad documents, which can only reject fewer; a rule that catches none is left out.

A trial is a distinct text that passes the base rule, so copies are no evidence. Strata with too few good labels for
any certificate are pooled and certified as one, which bounds the false rejections of the
pool and not of each member. What stays too small rejects nothing by these rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.distribution import join_on

from .common import GAP_CHARS, aside, bitmap, holds, let, materialise, text_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
ALPHA = 0.02
DELTA = 0.05
# Levels of the path, from lenient to strict.
CUTOFFS = tuple(round(1.0 - 0.02 * i, 2) for i in range(50)) + (0.01, 0.005)


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(tokens: Column) -> Column:
    """Words in windows of five that occur at least twice, by their sorted hashes.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes.
    """

    def covered(ordered: Column) -> Column:
        n = F.size(ordered)

        def same(i: Column, j: Column) -> Column:
            return F.get(ordered, i)["h"] == F.get(ordered, j)["h"]

        twice = F.filter(
            ordered,
            lambda w, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
        )
        places = F.array_sort(F.transform(twice, lambda w: w["i"]))
        return F.when(n < 2, F.lit(0)).otherwise(
            let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda a, b: a + b,
                ),
            )
        )

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        )

    def count(hashes: Column) -> Column:
        return let(
            windows(hashes),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                let(
                    F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered
                )
            ),
        )

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < WINDOW + 1, F.lit(0)).otherwise(let(hashed, count)).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def features() -> Column:
    """A struct of counts; a null text counts as empty."""
    text = text_of()
    return F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat"))).alias("w"),
        F.length(F.translate(text, GAP_CHARS, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
        count_of(text, "!").alias("bangs"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("upper"),
    )


# In the order of the path.
RULES = ("symbols", "bangs", "capitals", "lines", "repeats")
# No cutoff is stricter than this: what ordinary prose of some language may have.
FLOORS = {"symbols": 0.01, "bangs": 0.02, "capitals": 0.2, "lines": 0.2, "repeats": 0.1}


def values(f: Column) -> Column:
    """What each rule judges, between 0 and about 1, higher is worse; a map by rule."""

    def share(n: Column, of: Column) -> Column:
        return F.when(of > 0, n / of).otherwise(F.lit(0.0))

    judged = (
        share(f["n_symbols"], f["word_chars"]),
        share(f["bangs"], f["w"]["n"]),
        share(f["upper"], f["word_chars"]),
        share(f["n_dup_lines"] * F.lit(10), f["w"]["n"]),
        share(f["w"]["repeat"], f["w"]["n"]),
    )
    return F.create_map(*[x for k, v in zip(RULES, judged) for x in (F.lit(k), v)])


def base_fails(f: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (f["w"]["n"] < 10) | (f["w"]["repeat"] * 100 > f["w"]["n"] * 20)


def log_binomial_below(n: Column, k: Column, rate: float) -> Column:
    """log P(X <= k) for X binomial with n trials, term by term in logarithms."""
    odds = math.log(rate) - math.log1p(-rate)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i).cast("double") / (i + 1)) + F.lit(odds)
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    first = n.cast("double") * F.lit(math.log1p(-rate))
    start = F.struct(first.alias("term"), first.alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda acc: acc["sum"])


def ladder(rule: str) -> list[float]:
    """The cutoffs of a rule."""
    return [c for c in CUTOFFS if c >= FLOORS[rule]]


# The path: at each level the rule that is tightened and its cutoff.
PATH = tuple((r, c) for r in RULES for c in ladder(r))


def certificates(labelled: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with labels: what was certified for it, and on what.

    ``labelled`` has the stratum, ``_good`` (boolean) and ``_values`` (map of rule to
    value), one row for each distinct text. Result: ``good`` and ``bad`` labels of the
    stratum, ``pooled``, ``level`` (null without a certificate), ``rejected`` good and
    ``caught`` bad ones at that level, among those it was certified on, and ``_cuts``, a
    map from rule to cutoff. Rows are counted by level before anything is shuffled.
    """
    # A rule without a value rejects nothing.
    value = lambda r: F.coalesce(F.element_at("_values", F.lit(r)), F.lit(0.0))
    steps = lambda r: F.array(*[F.lit(c) for c in ladder(r)])
    within = lambda r: F.size(F.filter(steps(r), lambda c: value(r) <= c))
    first = {r: [x for x, _ in PATH].index(r) for r in RULES}
    # The first level that rejects the text; the number of levels if none does.
    at = F.least(*[F.when(within(r) < len(ladder(r)), within(r) + first[r]) for r in RULES], F.lit(len(PATH)))
    sums = lambda good, bad: [F.sum(good).alias("_g"), F.sum(bad).alias("_b")]
    bad = lambda r, keep: F.when(~F.col("_good") & keep, value(r))
    extremes = {f"_most_{r}": lambda c: F.max(c) for r in RULES} | {f"_next_{r}": lambda c: F.min(c) for r in RULES}
    told = {f"_most_{r}": bad(r, F.lit(True)) for r in RULES} | {
        # The least value that the rule's strictest cutoff catches.
        f"_next_{r}": bad(r, value(r) > ladder(r)[-1]) for r in RULES
    }
    counts = labelled.groupBy(F.col(stratum).alias("_s"), at.alias("_at")).agg(
        *sums(F.col("_good").cast("long"), (~F.col("_good")).cast("long")),
        *[extremes[n](c).alias(n) for n, c in told.items()],
    )
    counts = materialise(counts)
    sizes = counts.groupBy("_s").agg(F.sum("_g").alias("good"), F.sum("_b").alias("bad"))
    # So many good labels without one rejection are the least that certify a level.
    family = sizes.agg(F.count("*").cast("double"))
    bound = lambda family: F.lit(math.log(delta)) - F.log(family)
    sizes = sizes.withColumn("_family", family.scalar())
    sizes = sizes.withColumn("pooled", F.col("good") * math.log1p(-alpha) > bound(F.col("_family")))
    sizes = materialise(sizes)
    unit = F.when(F.col("pooled"), F.struct(F.lit(None).cast(counts.schema["_s"].dataType).alias("s"), F.lit(True).alias("p")))
    unit = unit.otherwise(F.struct(F.col("_s").alias("s"), F.lit(False).alias("p")))
    told = join_on(counts, sizes, ["_s"]).withColumn("_unit", unit)
    by_level = told.groupBy("_unit", "_at").agg(
        F.max("_family").alias("_family"), *sums(F.col("_g"), F.col("_b")),
        *[extreme(F.col(n)).alias(n) for n, extreme in extremes.items()],
    )
    # A map of no more than the levels, and the level past the last.
    filled = by_level.groupBy("_unit").agg(
        F.max("_family").alias("_family"), F.sum("_g").alias("_n"),
        F.map_from_entries(F.collect_list(F.struct("_at", F.struct("_g", "_b")))).alias("_by"),
        *[extreme(F.col(n)).alias(n) for n, extreme in extremes.items()],
    )
    rows = filled.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(PATH) - 1))))
    here = F.element_at("_by", F.col("_i"))
    zero = F.lit(0).cast("long")
    along = Window.partitionBy("_unit").orderBy("_i")
    rows = rows.withColumns({"_g": F.coalesce(here["_g"], zero), "_b": F.coalesce(here["_b"], zero)})
    rows = rows.withColumns({"_g": F.sum("_g").over(along), "_b": F.sum("_b").over(along)})
    possible = (F.col("_g") <= F.col("_n") * F.lit(alpha)) & (F.col("_n") > 0)
    seen = F.when(possible, log_binomial_below(F.col("_n"), F.col("_g"), alpha)).otherwise(F.lit(0.0))
    rows = rows.withColumn("_ok", (seen <= bound(F.col("_family"))) & possible)
    rows = rows.withColumn("_ok", F.min("_ok").over(along)).filter("_ok")
    i = F.col("_i")

    def cut(r: str) -> Column:
        """The cutoff of a rule at a level, null where it catches nothing or its turn has not come."""
        here = F.get(steps(r), i - first[r])
        passed = F.get(F.filter(steps(r), lambda c: c < F.col(f"_next_{r}")), F.lit(0))
        own = F.when(F.col(f"_most_{r}") > here, here)
        return F.when(i < first[r], None).when(i < first[r] + len(ladder(r)), own).otherwise(passed)

    named = F.array(*[F.struct(F.lit(r).alias("r"), cut(r).alias("c")) for r in RULES])
    useful = F.filter(named, lambda x: x["c"].isNotNull())
    best = rows.withColumn("_cuts", F.map_from_entries(useful)).groupBy("_unit").agg(
        F.max_by(F.struct("_i", "_g", "_b", "_cuts"), F.struct(F.col("_b"), -F.col("_i"))).alias("_best")
    )
    best = best.withColumnRenamed("_unit", "_u")
    found = sizes.withColumn("_unit", unit).join(best, F.col("_unit") == F.col("_u"), "left")
    return found.select(
        F.col("_s").alias(stratum), "good", "bad", "pooled", F.col("_best._i").alias("level"),
        F.col("_best._g").alias("rejected"), F.col("_best._b").alias("caught"), F.col("_best._cuts").alias("_cuts"),
    )


def thresholds(labelled: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum a map ``_cuts`` from rule to certified cutoff; strata without one are absent."""
    found = certificates(labelled, stratum, alpha, delta)
    return found.filter(F.size("_cuts") > 0).select(stratum, "_cuts")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id``, the stratum, the base counts, and ``kept``; other columns are left out.

    ``labels`` has doc_id and quality (1 is good); an id labelled more than once is good
    if one label says so, null labels and ids are left out. A null stratum is one of its
    own. Repeated rows are judged alike. An empty table gives an empty table.
    """
    return verdicts(docs.select("doc_id", "text", stratum), labels, stratum).drop("_f", "text")


def trials(docs: DataFrame, known: DataFrame, stratum: str) -> DataFrame:
    """The labelled texts that pass the base rule, once in a stratum, with ``_good`` and ``_values``.

    A bitmap of fixed size leaves out most documents without a label before their
    features are taken, so no text is shuffled to meet its label.
    """
    asked = bitmap(known.select(F.xxhash64("doc_id").alias("h")))
    # Bound in one expression, or the counts would be taken once for each use.
    some = docs.filter(holds(asked.scalar(), F.xxhash64("doc_id")))
    some = some.select(
        "doc_id", F.col(stratum).alias("_stratum"), F.xxhash64(text_of()).alias("_h"), F.length(text_of()).alias("_n"),
        let(features(), lambda f: F.struct(values(f).alias("v"), base_fails(f).alias("f"))).alias("_j"),
    )
    texts = some.join(known, "doc_id").groupBy("_stratum", "_h", "_n")
    # A text with labels of both kinds is good.
    texts = texts.agg(F.max("_good").alias("_good"), F.any_value("_j").alias("_j"))
    # After the sums, where it does not take the features of a text once more.
    return texts.filter("NOT _j.f").select("_stratum", "_h", "_n", "_good", F.col("_j.v").alias("_values"))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg((F.max("quality") == 1).alias("_good"))
    )
    safe = materialise(thresholds(trials(docs, known, stratum), "_stratum"))
    rows = docs.withColumn("_stratum", F.col(stratum)).withColumn("_f", features())
    rows = join_on(rows, safe, ["_stratum"], "left").drop("_stratum")
    f = F.col("_f")
    n, repeat = f["w"]["n"], f["w"]["repeat"]
    failed = base_fails(f)
    cuts = F.coalesce("_cuts", F.create_map().cast("map<string,double>"))
    rejected = let(values(f), lambda v: F.exists(F.map_entries(cuts), lambda c: F.element_at(v, c["key"]) > c["value"]))
    return rows.withColumns(
        {
            "n_words": n,
            "word_chars": f["word_chars"],
            "n_symbols": f["n_symbols"],
            "n_dup_lines": f["n_dup_lines"],
            "n_repeat_words": repeat,
            "base_failed": failed,
            "kept": ~failed & ~rejected,
        }
    ).drop("_cuts")


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that the rules keep, columns unchanged."""
    rows, back = aside(docs, "doc_id", "text", stratum)
    return back(verdicts(rows, labels, stratum).filter("kept"))
