"""Column expressions shared by all operators (built-in functions only)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake.params import DEFAULTS, ModelParams

# Ties of binary doubles are nudged upwards so that the result does not depend on
# the order in which a distributed sum was added up.
ROUND_NUDGE = 1e-9


def to_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rounded(x, digits: int = 0) -> Column:
    """Round half up to ``digits`` decimals as a double."""
    scale = float(10**digits)
    return F.floor(to_col(x).cast("double") * scale + 0.5 + ROUND_NUDGE) / F.lit(scale)


def clamp(x, low, high) -> Column:
    return F.greatest(as_lit(low), F.least(as_lit(high), to_col(x)))


def ratio(num, den, empty: float = 0.0, times: float = 1.0) -> Column:
    """num / den * times, and ``empty`` where the denominator is 0 or null."""
    n, d = to_col(num).cast("double"), to_col(den).cast("double")
    return F.when(d != 0, n / d * F.lit(float(times))).otherwise(F.lit(float(empty)))


def or_zero(x) -> Column:
    return F.coalesce(to_col(x), F.lit(0))


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as not holding)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def signed(n) -> Column:
    """``+7`` / ``-3`` / ``0``."""
    c = to_col(n).cast("long")
    return F.when(c > 0, F.concat(F.lit("+"), c.cast("string"))).otherwise(c.cast("string"))


def tolerant_int(text) -> Column:
    """Trimmed, thousands separators dropped, null when not a whole number."""
    return F.regexp_replace(F.trim(to_col(text)), ",", "").try_cast("int")


def tolerant_double(text) -> Column:
    return F.trim(to_col(text)).try_cast("double")


def roster_key(roster) -> Column:
    return F.array_join(F.sort_array(to_col(roster)), "|")


def roster_of(key) -> Column:
    return F.split(to_col(key), r"\|")


def overlap(current, past, size: int = DEFAULTS.roster_size) -> Column:
    """Share of shared players; an absent roster shares nobody."""
    n = F.size(F.array_intersect(to_col(current), to_col(past)))
    return F.when(to_col(current).isNull() | to_col(past).isNull(), F.lit(0.0)).otherwise(
        n / F.lit(float(size))
    )


def decay(day, as_of, p: ModelParams = DEFAULTS) -> Column:
    """Time weight of a match day seen from ``as_of``."""
    age = F.date_diff(as_lit(as_of), to_col(day))
    return F.when(to_col(day).isNull(), F.lit(p.undated_weight)).otherwise(
        clamp(F.exp(age * F.lit(-p.decay_rate)), p.decay_floor, 1.0)
    )


def margin_weight(diff, p: ModelParams = DEFAULTS) -> Column:
    """Multiplier of a map by its score difference; 1 when there is no score."""
    return F.coalesce(
        clamp(F.abs(to_col(diff)) / F.lit(p.diff_scale) + 1.0, p.diff_min, p.diff_max), F.lit(1.0)
    )


def share(a, b) -> Column:
    """a's share of a + b in percent, 50 when both are nothing."""
    total = to_col(a) + to_col(b)
    return F.when(total > 0, to_col(a) / total * 100.0).otherwise(F.lit(50.0))


def score_text(first, second) -> Column:
    return F.concat(to_col(first).cast("string"), F.lit("-"), to_col(second).cast("string"))


def score_part(text, index: int) -> Column:
    return F.get(F.split(to_col(text), "-"), index).try_cast("int")


def bands(value, steps: Iterable[tuple[float, object]], otherwise) -> Column:
    """First label whose lower bound the value reaches."""
    expr = None
    for bound, label in steps:
        cond = to_col(value) >= bound
        expr = F.when(cond, as_lit(label)) if expr is None else expr.when(cond, as_lit(label))
    return expr.otherwise(as_lit(otherwise))


# ---- fixed values: score and label bands ------------------------------------
SCORE_BANDS = ((0.75, "3-0"), (0.65, "3-1"), (0.55, "3-2"), (0.45, "2-3"), (0.35, "1-3"))
SCORE_BANDS_ELSE = "0-3"
MAP_COUNT_BANDS = ((70.0, (3, 0)), (60.0, (3, 1)))
MAP_COUNT_ELSE = (3, 2)
TEXT_CONFIDENCE = ((30.0, "HIGH"), (15.0, "MODERATE"))
IMAGE_CONFIDENCE = ((30.0, "HIGH"), (20.0, "MODERATE"), (10.0, "LOW"))
# -----------------------------------------------------------------------------


def score_band(prob_a) -> Column:
    """Side-oriented score text of a probability in 0..1 (rating and learned models)."""
    return bands(prob_a, SCORE_BANDS, SCORE_BANDS_ELSE)


def map_count(prob_a, prob_b) -> Column:
    """Side-oriented score text from the favourite's percentage."""
    favoured_a = to_col(prob_a) > to_col(prob_b)

    def text(pair):
        return F.when(favoured_a, F.lit(f"{pair[0]}-{pair[1]}")).otherwise(
            F.lit(f"{pair[1]}-{pair[0]}")
        )

    steps = [(bound, text(pair)) for bound, pair in MAP_COUNT_BANDS]
    return bands(F.greatest(to_col(prob_a), to_col(prob_b)), steps, text(MAP_COUNT_ELSE))


def confidence_text(confidence) -> Column:
    c = to_col(confidence)
    return (
        F.when(c > TEXT_CONFIDENCE[0][0], F.lit(TEXT_CONFIDENCE[0][1]))
        .when(c > TEXT_CONFIDENCE[1][0], F.lit(TEXT_CONFIDENCE[1][1]))
        .otherwise(F.lit("LOW"))
    )


def confidence_image(confidence) -> Column:
    return bands(confidence, IMAGE_CONFIDENCE, "VERY LOW")


def margin_note(confidence) -> Column:
    c = to_col(confidence)
    return F.when(c < 10, F.lit("very close")).when(c > 30, F.lit("strong favorite"))


def form_mark(momentum) -> Column:
    m = to_col(momentum)
    return F.when(m > 0.3, F.lit("hot")).when(m < -0.3, F.lit("cold")).otherwise(F.lit("steady"))
