"""Personal data and the terms that give it away, in DataFrame functions only.

Four kinds of identifiers are found by pattern. Each distinct identifier is a protected
entity. A term tells as much about an entity as the chance that a text with the term is one
of the entity's: ``-log2`` of that chance is the uncertainty about the entity that is left
when the term is known. The chance is estimated from the distinct texts of the corpus that
hold the term, by a lower confidence bound, so that one text alone proves nothing and the
same counts mean the same in a corpus of any size. Terms that leave at most one bit
(a chance of ``GENERALISE``) are generalised to a placeholder, those that leave at most a
third of one (``REMOVE``) removed, wherever they occur as whole terms in any text.

Equal texts count once. Which texts are repeated, which terms are in question and which
texts hold a disclosing one are told by bitmaps of fixed size, so most rows are counted on
the map side and most texts are never shuffled. A false hit costs work, never a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.distribution import join_on

from .common import aside, bitmap, holds, let, materialise, text_of

# In the order of ties.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
PLACEHOLDER = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")
GENERALISE = 0.5
REMOVE = 0.8
# Normal quantile of the bound's one-sided certainty, 90 %.
CERTAIN = 1.2815515655446004

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
# A failing start inside a run of local characters fails from the run's start as well, so
# only run starts, or the end of the last match, are tried: no quadratic scans.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++\.[A-Za-z0-9.-]++"
# Dots that join no two labels are blurred first, so that the domain is one run of characters.
EMAIL_BLUR = rf"(?<!{LABEL})\.|\.(?!{LABEL})"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
# Separators that join no two digits are blurred, so a card is one run of characters.
CARD = r"[0-9][0-9\x20-]+"
CARD_BLUR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Stands for the code points of identifiers, so that no term touches one.
BLANK = "\ue000"
LETTER = r"\p{L}\p{N}"
TERM = rf"(?<![{LETTER}{BLANK}])[{LETTER}]++(?!{BLANK})"

STEP = 128


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The fold of all earlier elements for each element, by blocks of ``STEP``."""
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int"))
    totals = F.transform(starts, lambda b: F.aggregate(F.slice(values, b * STEP + 1, STEP), zero, merge))
    heads = F.aggregate(
        totals,
        F.array(zero),
        lambda out, t: F.concat(out, F.array(merge(F.element_at(out, -1), t))),
    )
    inner = let(
        heads,
        lambda h: F.transform(
            values,
            lambda _, i: F.aggregate(
                F.slice(values, i - i % STEP + 1, i % STEP), F.get(h, F.floor(i / STEP).cast("int")), merge
            ),
        ),
    )
    return F.when(F.size(values) == 0, F.slice(values, 1, 0)).otherwise(inner)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as structs of start, kind, end, value; places count code points from 0."""

    def place(gaps: Column, found: Column) -> Column:
        pairs = F.transform(found, lambda v, i: F.struct(v.alias("v"), F.length(F.get(gaps, i)).alias("gap")))

        def build(p: Column) -> Column:
            steps = F.transform(p, lambda x: x["gap"] + F.length(x["v"]))
            return let(
                steps,
                lambda s: let(
                    running(s, F.lit(0), lambda a, b: a + b),
                    lambda before: F.transform(
                        p,
                        lambda x, i: F.struct(
                            (F.get(before, i) + x["gap"]).alias("start"),
                            F.lit(kind).alias("kind"),
                            (F.get(before, i) + x["gap"] + F.length(x["v"])).alias("end"),
                            x["v"].alias("value"),
                        ),
                    ),
                ),
            )

        return let(pairs, build)

    return let(
        text,
        lambda t: let(
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda found: F.when(F.size(found) == 0, none()).otherwise(
                let(F.split(t, pattern, -1), lambda gaps: place(gaps, found))
            ),
        ),
    )


def none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def digit(i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.sequence(F.lit(1), F.length(number))
    return F.aggregate(places, F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """The identifiers of a text, sorted by start and kind."""
    email = F.when(
        F.contains(text, F.lit("@")), matches(F.regexp_replace(text, EMAIL_BLUR, "_"), EMAIL, 0)
    ).otherwise(none())
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), matches(text, IP, 1)).otherwise(none())
    ip = F.filter(ip, lambda s: s["value"].rlike(rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$"))
    card = F.when(
        text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), matches(F.regexp_replace(text, CARD_BLUR, "_"), CARD, 2)
    ).otherwise(none())
    card = F.filter(
        card,
        lambda s: let(
            digits(s["value"]),
            lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)),
        ),
    )
    phone = F.when(text.rlike(r"\+[0-9]"), matches(text, PHONE, 3)).otherwise(none())
    phone = F.filter(phone, lambda s: F.length(digits(s["value"])).between(9, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def entity(span: Column) -> Column:
    """The protected value: kind and address in lower case, or kind and digits."""
    plain = F.when(span["kind"] < 2, F.lower(span["value"])).otherwise(digits(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), plain)


def blanked(text: Column, spans: Column) -> Column:
    """The text, each code point of a span as ``BLANK``; places stay as they are."""
    plain = F.translate(text, BLANK, " ")

    def build(ends: Column) -> Column:
        def all_parts(before: Column) -> Column:
            def part(s: Column, i: Column) -> Column:
                done = F.get(before, i)
                gap = F.greatest(s["start"] - done, F.lit(0))
                return F.concat(
                    F.substr(plain, done + 1, gap),
                    F.repeat(F.lit(BLANK), F.greatest(s["end"] - F.greatest(s["start"], done), F.lit(0))),
                )

            rest = F.substr(plain, F.array_max(ends) + 1, F.length(text))
            return F.concat(F.array_join(F.transform(spans, part), ""), rest)

        return let(running(ends, F.lit(0), lambda a, b: F.greatest(a, b)), all_parts)

    return F.when(F.size(spans) == 0, plain).otherwise(let(F.transform(spans, lambda s: s["end"]), build))


def terms(text: Column, spans: Column) -> Column:
    """The distinct whole terms of a text that touch no identifier, in lower case."""
    found = F.regexp_extract_all(blanked(text, spans), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def words_of(text: Column) -> Column:
    """The distinct whole terms of a text in lower case, those in identifiers too."""
    found = F.filter(F.split(text, rf"[^{LETTER}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def term_spans(text: Column, spans: Column, kinds: Column) -> Column:
    """Every place of a term of the map ``kinds`` that touches no identifier."""

    def span(r: Column) -> Column:
        return F.struct(
            r["start"].alias("start"), F.element_at(kinds, F.lower(r["value"])).alias("kind"),
            r["end"].alias("end"), F.lit("").alias("value"),
        )

    found = F.transform(matches(blanked(text, spans), TERM, 4), span)
    return F.filter(found, lambda s: s["kind"].isNotNull())


def content_key(text: Column) -> list[Column]:
    """Tells texts apart: hash and length."""
    return [F.xxhash64(text).alias("_h"), F.length(text).alias("_n")]


def lower_bound(k: Column, n: Column, z: float = CERTAIN) -> Column:
    """Wilson's lower bound of a chance of which ``k`` cases of ``n`` were seen."""
    k, n = k.cast("double"), n.cast("double")
    middle = k + z * z / 2
    spread = z * F.sqrt(k * (n - k) / n + z * z / 4)
    return (middle - spread) / (n + z * z)


def weighed(docs: DataFrame, generalise: float, remove: float) -> DataFrame:
    """Terms and entities with ``both`` (distinct texts of both), ``texts`` (of the term),
    ``chance`` and ``kind``, for all pairs that reach ``generalise``."""
    texts = docs.select(text_of().alias("_t")).select("_t", *content_key(F.col("_t")))
    spanned = texts.withColumn("_spans", base_spans(F.col("_t"))).filter(F.size("_spans") > 0)
    entities = F.array_distinct(F.transform("_spans", lambda s: entity(s)))
    # One row for each distinct text that holds an identifier.
    near = spanned.select("_h", "_n", entities.alias("_es"), terms(F.col("_t"), F.col("_spans")).alias("_terms"))
    near = materialise(near.dropDuplicates(["_h", "_n"]))
    # Fewer texts than this cannot reach the threshold, even if there are no others.
    least = 1
    while least / (least + CERTAIN**2) < generalise:
        least += 1
    held = near.select(F.explode("_es").alias("_e")).groupBy("_e").agg(F.count("*").alias("_with"))
    held = materialise(held.filter(F.col("_with") >= least))
    often = near.select("_terms", F.explode("_es").alias("_e")).join(held.select("_e"), "_e", "left_semi")
    both = often.select("_e", F.explode("_terms").alias("term")).groupBy("_e", "term").agg(F.count("*").alias("both"))
    both = materialise(both.filter(F.col("both") >= least))
    asked = bitmap(both.select(F.xxhash64("term").alias("h")).distinct())
    repeated = bitmap(texts.groupBy("_h", "_n").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("_h").alias("h")))
    # A text that is not repeated is counted by its terms alone, a repeated one once.
    wanted = F.filter(words_of(F.col("_t")), lambda w: holds(F.col("_asked"), F.xxhash64(w)))
    # From the text itself: a hash used twice would keep the bitmaps as columns.
    again = holds(F.col("_repeated"), F.xxhash64("_t"))
    # Each bitmap is used once, so it is put in its place and is no column of a row. The outer
    # form of explode has no filter inferred that would take the words of each text twice.
    told = texts.withColumns({"_asked": asked.scalar(), "_repeated": repeated.scalar()})
    told = told.select("_h", "_n", wanted.alias("_wanted"), again.alias("_again"))
    only = lambda c: F.when(F.col("_again"), F.col(c)).alias(c)
    words = told.select(only("_h"), only("_n"), F.explode_outer("_wanted").alias("term")).filter("term IS NOT NULL")
    seen = words.groupBy("term", "_h", "_n").agg(F.count("*").alias("rows"))
    known = seen.groupBy("term").agg(F.sum(F.when(F.col("_h").isNull(), F.col("rows")).otherwise(1)).alias("texts"))
    # Identifiers hold terms too, so a term is in all the texts that it shares with one.
    pairs = both.join(known, "term").withColumn("texts", F.greatest("texts", "both"))
    pairs = pairs.withColumn("chance", lower_bound(F.col("both"), F.col("texts"))).filter(F.col("chance") >= generalise)
    kind = F.when(F.col("chance") >= remove, F.lit(5)).otherwise(F.lit(4))
    return pairs.withColumn("kind", kind)


def disclosing(docs: DataFrame, generalise: float, remove: float) -> DataFrame:
    """Per distinct text (``_h``, ``_n``) with terms to sanitise the map ``_kinds`` of them."""
    # A term of two entities is treated by the stricter of the two.
    strict = materialise(weighed(docs, generalise, remove).groupBy("term").agg(F.max("kind").alias("kind")))
    asked = bitmap(strict.select(F.xxhash64("term").alias("h")))
    texts = docs.select(text_of().alias("_t")).select("_t", *content_key(F.col("_t")))
    wanted = F.filter(words_of(F.col("_t")), lambda w: holds(F.col("_asked"), F.xxhash64(w)))
    told = texts.withColumn("_asked", asked.scalar()).select("_h", "_n", wanted.alias("_wanted"))
    words = told.select("_h", "_n", F.explode_outer("_wanted").alias("term")).filter("term IS NOT NULL").distinct()
    # Terms of one text only, as many as it has.
    kinds = F.map_from_entries(F.collect_list(F.struct("term", "kind")))
    return materialise(words.join(strict, "term").groupBy("_h", "_n").agg(kinds.alias("_kinds")))


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Add ``_base`` and ``_all``, sorted arrays of spans (start, kind, end, value).

    Reads ``text``; null counts as empty. The statistics are over all distinct texts of
    ``docs``, so repeated rows weigh once and are treated alike. A term is a run of letters
    and digits of any length. An empty table gives an empty table.
    """
    extra = disclosing(docs, generalise, remove)
    keyed = docs.withColumns({"_h": F.xxhash64(text_of()), "_n": F.length(text_of())})
    # Only texts that may hold a disclosing term meet the table of those that do.
    marked = bitmap(extra.select(F.col("_h").alias("h")))
    hit = holds(marked.scalar(), F.col("_h"))
    plain = keyed.filter(~hit).withColumn("_base", base_spans(text_of())).withColumn("_all", F.col("_base"))
    joined = join_on(keyed.filter(hit), extra, ["_h", "_n"], "left").withColumn("_base", base_spans(text_of()))
    found = F.when(F.col("_kinds").isNull(), none()).otherwise(term_spans(text_of(), F.col("_base"), F.col("_kinds")))
    spans = F.array_sort(F.concat(F.col("_base"), found))
    return plain.unionByName(joined.withColumn("_all", spans).drop("_kinds")).drop("_h", "_n")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))

    def number(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [number(kind) for kind in range(4)]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced; a span inside an earlier one adds nothing."""
    names = F.array(*[F.lit(p) for p in PLACEHOLDER])

    def build(ends: Column) -> Column:
        def all_parts(before: Column) -> Column:
            pieces = F.transform(
                spans,
                lambda s, i: F.when(
                    s["start"] >= F.get(before, i),
                    F.concat(
                        F.substr(text, F.get(before, i) + 1, s["start"] - F.get(before, i)), F.get(names, s["kind"])
                    ),
                ).otherwise(F.lit("")),
            )
            last = F.array_max(ends)
            return F.concat(F.array_join(pieces, ""), F.substr(text, last + 1, F.length(text)))

        return let(running(ends, F.lit(0), lambda a, b: F.greatest(a, b)), all_parts)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.transform(spans, lambda s: s["end"]), build))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with identifiers and disclosing terms replaced; other columns unchanged.

    A text without spans is left as it is, null included.
    """
    rows, back = aside(docs, "text")
    found = find(rows)
    text = F.when(F.size("_all") == 0, F.col("text")).otherwise(masked(text_of(), F.col("_all")))
    return back(found.withColumn("text", text))
