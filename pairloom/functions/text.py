"""String columns: transcript cleaning, word normalisation, distances, marker predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairloom.constants import BLANKS, DIALECT_ENDINGS, WORD_EDGE_PUNCTUATION

# The characters of BLANKS as ranges, which keeps the patterns cheap. A single plain space is
# left alone where it needs no change, since it is by far the most frequent match.
_RARE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK_RUN = f"[ {_RARE}]+"
_UNEVEN_BLANKS = f"[ {_RARE}]{{2,}}|[{_RARE}]"
_RARE_BLANK = f"[{_RARE}]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once.

    Expressions inside a lambda are evaluated per element and per use; a bound one is a variable.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column | str) -> Column:
    """Blanks off both ends (all Unicode blanks, unlike `trim`)."""
    return F.btrim(col(text), F.lit(BLANKS))


def squeeze(text: Column | str) -> Column:
    """Runs of blanks to one space, then strip."""
    return strip(F.regexp_replace(col(text), _UNEVEN_BLANKS, " "))


def words(text: Column | str) -> Column:
    """Blank-separated words, without empty ones."""
    # splitting at one plain character needs no pattern per row
    return F.filter(F.split(F.regexp_replace(col(text), _RARE_BLANK, " "), " "), lambda w: w != "")


def without_blanks(text: Column | str) -> Column:
    return F.regexp_replace(col(text), _BLANK_RUN, "")


# ---- transcript cleaning ------------------------------------------------------------


def resolve_dual(text: Column | str, side: str) -> Column:
    """`(dialect)/(standard)` becomes the token of the asked side."""
    if side not in ("standard", "dialect"):
        raise ValueError(f"side must be 'standard' or 'dialect', got {side!r}")
    return F.regexp_replace(
        col(text), r"\(([^()]*)\)/\(([^()]*)\)", "$1" if side == "dialect" else "$2"
    )


def drop_annotations(text: Column | str) -> Column:
    """Remove `((..))`, `(..)`, `{..}` and `&..&` spans, in that order."""
    out = col(text)
    for span in (r"\(\([^()]*\)\)", r"\([^()]*\)", r"\{[^}]*\}", r"&[^&]*&"):
        out = F.regexp_replace(out, span, "")
    return out


def drop_hash(text: Column | str) -> Column:
    return F.translate(col(text), "#", "")


def drop_orphans(text: Column | str) -> Column:
    """Brackets and ampersands whose partner lies outside this string."""
    return F.translate(col(text), "()[]{}&", "")


def clean_transcript(text: Column | str, side: str) -> Column:
    """The whole cleaning chain for one field; null gives an empty string."""
    resolved = resolve_dual(F.coalesce(col(text), F.lit("")), side)
    return squeeze(drop_orphans(drop_hash(drop_annotations(resolved))))


# ---- words --------------------------------------------------------------------------


def normalize_word(word: Column | str) -> Column:
    return strip(F.btrim(strip(word), F.lit(WORD_EDGE_PUNCTUATION)))


def word_set(text: Column | str) -> Column:
    """Distinct normalised words of a text."""
    return F.array_distinct(F.filter(F.transform(words(text), normalize_word), lambda w: w != ""))


def completion_text(df: DataFrame, column: str) -> Column:
    """A model completion as text, whether stored as string, message list or message."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        content = F.get(F.col(column), 0)["content"]
    elif isinstance(kind, T.StructType):
        content = F.col(column)["content"]
    else:
        content = F.col(column).cast("string")
    return F.coalesce(content, F.lit(""))


# ---- distances and predicates --------------------------------------------------------


LONG_WORD = 64


def distance_by_words(a: Column | str, b: Column | str) -> Column:
    """Cost of turning each word into the word at the same place: no less than the edit distance.

    Words that only one side has cost their length and a blank; words of over `LONG_WORD` characters count as replaced.
    """

    def cost(x: Column, y: Column) -> Column:
        lx, ly = F.length(x), F.length(y)
        longer = F.greatest(lx, ly)
        return (
            F.when(x.isNull() | y.isNull(), longer + 1)
            .when(x == y, F.lit(0))
            .when(longer > LONG_WORD, longer)
            .otherwise(F.levenshtein(x, y))
        )

    costs = F.zip_with(F.split(col(a), " ", -1), F.split(col(b), " ", -1), cost)
    return F.aggregate(costs, F.lit(0), lambda total, c: total + c)


def edit_distance(a: Column | str, b: Column | str, only_if: Column | None = None) -> Column:
    """Levenshtein distance; null where `only_if` is false.

    The built-in is linear in its band. The distance by words is an upper limit, so one try within it finds
    the distance: close texts cost little however long they are. Only texts that differ everywhere reach the whole matrix.
    """
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    within = lambda most: F.when(most < longest, F.call_function("levenshtein", a, b, most)).otherwise(F.levenshtein(a, b))
    distance = bind(distance_by_words(a, b), within)
    return distance if only_if is None else F.when(only_if, distance)


def norm_levenshtein(a: Column | str, b: Column | str, only_if: Column | None = None) -> Column:
    """Edit distance over the longer length: 0 when equal, 1 when one side is empty."""
    a, b = col(a), col(b)
    la, lb = F.length(a), F.length(b)
    differ = (a != b) & (la > 0) & (lb > 0)
    wanted = differ if only_if is None else differ & only_if
    return (
        F.when(a == b, F.lit(0.0))
        .when((la == 0) | (lb == 0), F.lit(1.0))
        .otherwise(edit_distance(a, b, wanted) / F.greatest(la, lb))
    )


def closer_than(
    a: Column | str, b: Column | str, threshold: float, only_if: Column | None = None
) -> Column:
    """`norm_levenshtein(a, b) < threshold` without computing far distances.

    The length difference is a lower bound of the distance, and the band of the edit matrix
    is limited to the distances that can still pass. Null or false where `only_if` is false.
    """
    a, b = col(a), col(b)
    la, lb = F.length(a), F.length(b)
    longest = F.greatest(la, lb)
    open_case = (a != b) & (la > 0) & (lb > 0) & (F.abs(la - lb) < longest * F.lit(threshold))
    if only_if is not None:
        open_case = open_case & only_if
    band = F.ceil(longest * F.lit(threshold)).cast("int")
    # the distance is bound, since both comparisons would compute it
    near = bind(F.call_function("levenshtein", a, b, band), lambda d: (d >= 0) & (d / longest < threshold))
    return (
        F.when(a == b, F.lit(0.0 < threshold))
        .when((la == 0) | (lb == 0), F.lit(1.0 < threshold))
        .when(open_case, near)
        .otherwise(F.lit(False))
    )


def carries_marker(text: Column | str, endings: Sequence[str] = DIALECT_ENDINGS) -> Column:
    return col(text).rlike("|".join(re.escape(e) for e in endings))


def edit_bucket(standard: Column | str, dialect: Column | str, small: int = 3, med: int = 8) -> Column:
    """small / med / large by edit distance, null if a side is; the band stops at `med`, so it is linear."""
    distance = F.levenshtein(col(standard), col(dialect), med)
    return (
        F.when(distance < 0, F.lit("large"))
        .when(distance <= small, F.lit("small"))
        .when(distance <= med, F.lit("med"))
    )


def region_group(do: Column | str) -> Column:
    lowered = F.lower(col(do))
    return (
        F.when(lowered.contains("gangwon"), F.lit("gangwon"))
        .when(lowered.contains("gyeongsang"), F.lit("gyeongsang"))
        .otherwise(F.lit("other"))
    )


def word_difference(standard: Column | str, dialect: Column | str) -> Column:
    """Words that differ by position, plus the difference in word count."""
    s, d = words(standard), words(dialect)
    return F.aggregate(
        F.zip_with(s, d, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)),
        F.lit(0),
        lambda acc, one: acc + one,
    )


def changed_words(standard: Column | str, dialect: Column | str) -> Column:
    """Word map of a pair with equal word counts: entries where the two words differ."""

    def entries(sides: Column) -> Column:
        s, d = sides["s"], sides["d"]
        pairs = F.zip_with(s, d, lambda x, y: F.struct(x.alias("standard"), y.alias("dialect")))
        same_count = F.size(s) == F.size(d)
        return F.filter(pairs, lambda p: same_count & (p["standard"] != p["dialect"]))

    return bind(F.struct(words(standard).alias("s"), words(dialect).alias("d")), entries)


# ---- tokeniser for BLEU, version 13a ---------------------------------------------------


def tokenize_13a(text: Column | str) -> Column:
    """Punctuation split off words by the public mteval-v13a rules; tokens joined by a space."""
    return squeeze(spaced_13a(text))


def spaced_13a(text: Column | str) -> Column:
    """As `tokenize_13a`, but with runs of any blanks between and around the tokens."""
    out = F.replace(F.replace(col(text), F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit(""))
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    # the published class also spaces out blanks, which the final squeeze undoes
    out = F.regexp_replace(out, r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", r" $1 ")
    out = F.regexp_replace(out, r"([^0-9])([\.,])", r"$1 $2 ")
    out = F.regexp_replace(out, r"([\.,])([^0-9])", r" $1 $2")
    out = F.regexp_replace(out, r"([0-9])(-)", r"$1 $2 ")
    return out
