"""Personal data: fixed base patterns, and further spans chosen by boosted trees.

Everything that runs over the corpus is a projection of built-in functions: no shuffle, no Python.
Base spans (email, ip, card, phone) come from their patterns and checks alone. Three generators
propose further spans with high recall, overlapping each other: words that hold a digit, assignments
of a value to a name, and grouped digits. Each candidate is described by its format and its context;
gradient-boosted trees score it, and a threshold per generator, read off a calibration table, selects
the spans to redact. There are no labelled spans in the tables, so the trees and the thresholds learn from weak
labels of all candidates of all documents (equal ones are one row with its count as weight): a candidate counts as private if it lies in a base span, follows
a name for secrets, or starts with a known key prefix; these rules are not among the features.

Patterns use possessive quantifiers and start conditions so that matching stays linear on any text;
they match the same spans as the plain forms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.rows import hold, stored, whole_text

# Patterns and checks of the base kinds, in the order of their listing.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

# Generators of further candidates, and the weak rules.
GENERATORS = {
    "token": r"(?<!\S)[^\s0-9]*+[0-9]\S*+",
    "assignment": r"(?<![A-Za-z_])[A-Za-z_]{2,24}+ ?[=:] ?[\"']?[^\s\"'=:]{6,}+[\"']?",
    "number": r"[+(]?[0-9][0-9 ().-]{5,}[0-9]",
}
ADDED_KINDS = {"token": "secret", "assignment": "secret", "number": "number"}
SECRET_NAMES = r"(?i)(password|passwd|pwd|secret|token|api_?key|access_?key|auth)\w*\s?[=:]\s?[\"']?\S*$"
KEY_PREFIXES = r"^(AKIA|ASIA|ghp_|xox[abp]-|sk_live_|eyJ)"

SPAN = "array<struct<start:int,end:int,value:string>>"
FEATURES = [
    "length", "digits", "upper", "lower", "other", "digit_share", "switches", "vowel_share", "points",
    "groups", "has_equals", "has_quote", "has_at", "name_before", "blank_before", "blank_after", "capital_first",
]


def spans(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping, with code point positions (end exclusive)."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), values.alias("value"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.coalesce(F.length(pair["value"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))
        out = F.when(pair["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], found))
        return F.struct(end.alias("at"), out.cast(SPAN).alias("out"))

    return F.aggregate(pairs, nothing, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _small_part(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans by kind; a pattern is tried only where its necessary character occurs."""
    none = F.array().cast(SPAN)
    has_digit = text.rlike("[0-9]")
    count = lambda v: F.length(_digits(v))
    ip = F.filter(spans(text, IP), lambda s: F.forall(F.split(s["value"], r"\."), _small_part))
    card = F.filter(
        spans(text, CARD), lambda s: F.when(count(s["value"]).between(*CARD_DIGITS), passes_luhn(_digits(s["value"]))).otherwise(False)
    )
    phone = F.filter(spans(text, PHONE), lambda s: count(s["value"]).between(*PHONE_DIGITS))
    return {
        "email": F.when(text.contains("@"), spans(text, EMAIL)).otherwise(none),
        "ip": F.when(has_digit & text.contains("."), ip).otherwise(none),
        "card": F.when(has_digit, card).otherwise(none),
        "phone": F.when(has_digit & text.contains("+"), phone).otherwise(none),
    }


def candidates(text: Column, generator: str, pattern: str) -> Column:
    """Proposals of one generator, without closing punctuation, with their context."""
    needs = text.rlike("[=:]") if generator == "assignment" else text.rlike("[0-9]")

    def shape(s: Column) -> Column:
        value = F.regexp_replace(s["value"], r"[.,;:!?)\]]+$", "")
        end = s["start"] + F.length(value)
        before = F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(s["start"], F.lit(24)))
        after = F.substring(text, end + 1, F.lit(1))
        return F.struct(
            s["start"].alias("start"), end.alias("end"), value.alias("value"), before.alias("before"), after.alias("after")
        )

    proposed = F.filter(F.transform(spans(text, pattern), shape), lambda c: F.length(c["value"]) > 1)
    return F.when(needs, proposed).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    )


def format_features(c: Column) -> list[Column]:
    """Numbers that describe a candidate and its surroundings, in the order of FEATURES."""
    v, n = c["value"], F.length(c["value"])
    left = lambda rx: F.length(F.regexp_replace(v, rx, ""))
    digits, upper, lower = left("[^0-9]"), left("[^A-Z]"), left("[^a-z]")
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return [
        n, digits, upper, lower, n - digits - upper - lower, digits / n,
        left("[^0-9][^0-9]+|[0-9][0-9]+") + F.length(F.regexp_replace(v, "[^0-9]+|[0-9]+", "x")),
        left("[^AEIOUaeiou]") / n, left(r"[^.]"),
        F.length(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "x"), "[^x]", "")),
        flag(F.concat(F.substring(c["before"], -3, 3), v).contains("=")), flag(v.rlike("[\"']")), flag(v.contains("@")),
        F.length(F.regexp_extract(c["before"], r"([A-Za-z_]+)\s?[=:]?\s?[\"']?$", 1)),
        flag(c["before"].rlike(r"(^|\s)$")), flag((c["after"] == "") | c["after"].rlike(r"\s")), flag(v.rlike("^[A-Z]")),
    ]


def looks_private(c: Column, base: Column) -> Column:
    """The weak label of a candidate."""
    in_base = F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    named = F.concat(c["before"], c["value"]).rlike(SECRET_NAMES) | c["value"].rlike(SECRET_NAMES)
    return in_base | named | c["value"].rlike(KEY_PREFIXES)


@dataclass
class SpanModel:
    """Trees as (feature, threshold, left, right) or leaf values, weights, and thresholds."""

    trees: list
    weights: list[float]
    thresholds: dict[str, float]

    def margin(self, features: list[Column]) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            k, cut, low, high = node
            return F.when(features[k] <= F.lit(float(cut)), value(low)).otherwise(value(high))

        return sum((F.lit(w) * value(t) for t, w in zip(self.trees, self.weights)), F.lit(0.0))


def _tree(node):
    if node.numDescendants() == 0:
        return node.prediction()
    split = node.split()
    return (split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def _prepared(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One column of spans per base kind and of candidates per generator."""
    whole = df.withColumn("_pii_text", whole_text(text)).select(*keep, "_pii_text")
    return whole.select(
        *keep,
        *[c.alias(f"_base_{k}") for k, c in base_spans(F.col("_pii_text")).items()],
        *[candidates(F.col("_pii_text"), g, p).alias(f"_gen_{g}") for g, p in GENERATORS.items()],
    )


def _all_base() -> Column:
    return F.concat(*[F.col(f"_base_{k}") for k in KINDS])


def train_spans(prepared: DataFrame, trees: int, precision: float) -> SpanModel | None:
    """Boosted trees and calibrated thresholds from all weakly labelled candidates; None if one kind is missing."""
    based = prepared.withColumn("_base", _all_base())
    each = [based.select("_base", F.explode(f"_gen_{g}").alias("c"), F.lit(g).alias("_g")) for g in GENERATORS]
    seen = each[0].unionByName(each[1]).unionByName(each[2])
    c = F.col("c")
    described = seen.select(
        "_g",
        F.when(looks_private(c, F.col("_base")), 1.0).otherwise(0.0).alias("label"),
        *[f.cast("double").alias(name) for f, name in zip(format_features(c), FEATURES)],
    )
    # candidates that the trees cannot tell apart are one row
    table = stored(described.groupBy("_g", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    if table.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    model = GBTClassifier(maxIter=trees, maxDepth=3, maxBins=32, seed=1, stepSize=0.3, weightCol="weight").fit(vectors)
    probability = vector_to_array("probability")[1]
    bins = (
        model.transform(vectors)
        .groupBy("_g", F.floor(probability * 100).alias("_bin"))
        .agg(F.sum(F.col("label") * F.col("weight")).alias("_yes"), F.sum("weight").alias("_n"))
        .collect()
    )
    thresholds = {g: _threshold([r for r in bins if r["_g"] == g], precision) for g in GENERATORS}
    java = model._java_obj.trees()
    return SpanModel([_tree(java[k].rootNode()) for k in range(len(java))], list(model.treeWeights), thresholds)


def _threshold(bins: list, precision: float) -> float:
    """Lowest probability (in hundredths) from which on the share of weak positives is high enough."""
    best, yes, n = 2.0, 0.0, 0
    for r in sorted(bins, key=lambda r: -r["_bin"]):
        yes, n = yes + r["_yes"], n + r["_n"]
        if yes / n < precision:
            break
        best = r["_bin"] / 100
    return max(best, 0.5)


def _selected(model: SpanModel, generator: str) -> Column:
    """Candidates of a generator that the trees select and that base spans do not cover already."""
    threshold = model.thresholds[generator]
    base = F.col("_base")

    def chosen(c: Column) -> Column:
        probability = 1 / (1 + F.exp(-2 * model.margin(format_features(c))))
        shared = F.aggregate(
            base,
            F.lit(0),
            lambda total, s: total + F.greatest(F.lit(0), F.least(s["end"], c["end"]) - F.greatest(s["start"], c["start"])),
        )
        return (2 * shared < c["end"] - c["start"]) & (probability >= threshold)

    return F.transform(
        F.filter(f"_gen_{generator}", chosen), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"))
    )


def _without_overlaps(found: Column) -> Column:
    """Of overlapping spans the leftmost, and of those the longest, stays."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["value"].alias("value"))))
    nothing = F.struct(F.lit(-1).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["value"].alias("value"))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), out.cast(SPAN).alias("out"))

    return F.aggregate(order, nothing, step, lambda acc: acc["out"])


def find_private(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    trees: int = 12,
    precision: float = 0.95,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` (default: the id) of `df`, `_base_<kind>` spans of the four base kinds, and `_added`.

    Spans are structs of start, end (code points, end exclusive) and value; `_added` also has a kind
    (`secret`, `number`), does not overlap itself, and is not covered by base spans. Null and empty texts
    have no spans; where no model can be learned (no candidates, or only one weak label) nothing is
    added. Repeated rows repeat their spans; an empty table gives an empty table; other columns
    are ignored, whatever their names.
    """
    kept = [doc_id] if keep is None else keep
    inner = df.select(*kept, F.col(text).alias("_raw"))
    # spans are kept, texts are not: the trees and the result read this narrow table
    prepared = hold(_prepared(inner, "_raw", kept))
    model = train_spans(prepared, trees, precision)
    kinds = [f"_base_{k}" for k in KINDS]
    if model is None:
        return prepared.select(*kept, *kinds, F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("_added"))
    named = lambda kind, found: F.transform(
        found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    )
    with_base = prepared.withColumn("_base", _all_base())
    chosen = with_base.select(*kept, *kinds, *[_selected(model, g).alias(f"_pick_{g}") for g in GENERATORS])
    secrets = _without_overlaps(F.concat("_pick_token", "_pick_assignment"))
    apart = chosen.withColumn("_secrets", secrets).withColumn(
        "_numbers",
        F.filter("_pick_number", lambda c: ~F.exists("_secrets", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))),
    )
    return apart.select(*kept, *kinds, F.concat(named("secret", F.col("_secrets")), named("number", F.col("_numbers"))).alias("_added"))


def redact(text: Column, found: Column) -> Column:
    """The text with every span (structs of kind, start, end; any order, overlaps allowed) replaced by [kind]."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        put = F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]")))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], put))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(
        order, nothing, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    )
