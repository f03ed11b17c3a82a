"""Text, label and nested-record column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwise.functions.numeric import finite

# Spellings that count as missing, labels and display texts.
MISSING_WORDS = ["", "nan", "none", "null", "not reported", "unknown", "not available", "not applicable"]
MISSING_CELLS = ["NaN", "nan", "NA", ""]
SAMPLE_MISSING = ["", "nan", "none", "not reported", "unknown"]
NOT_REPORTED = "Not Reported"
PRIMARY = "Primary Tumor"
NORMAL = "Solid Tissue Normal"
MASK_GRAY, MASK_SATURATION, MASK_GRAY_STRICT = 235.0, 8.0, 220.0
GATE_OCCUPANCY, GATE_WHITE, GATE_SATURATION = 0.70, 0.75, 3.0
COMPONENT_LENGTH = 160
WHITE_SPACE = " \t\n\r\x0b\x0c\u00a0"
# End of fixed values.


def stripped(col: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def norm_missing(col: Column) -> Column:
    """Trimmed text, NULL for every spelling of a missing value."""
    text = stripped(col.cast("string"))
    return F.when(~F.lower(text).isin(MISSING_WORDS), text)


def clean_text(col: Column) -> Column:
    return F.coalesce(norm_missing(col), F.lit(NOT_REPORTED))


def missing_cell(col: Column) -> Column:
    """Raw matrix cell: missing tokens, unparsable text and infinities become NULL."""
    return finite(F.when(~col.isin(MISSING_CELLS), col).try_cast("double"))


def sample_type(col: Column) -> Column:
    text = stripped(F.coalesce(col, F.lit("")))
    low = F.lower(text)
    return (F.when(low.contains("primary") & low.contains("tumor"), PRIMARY)
            .when(low.contains("normal"), NORMAL)
            .when(low.isin(SAMPLE_MISSING), NOT_REPORTED)
            .otherwise(text))


def stage_advanced(col: Column) -> Column:
    """True for stage III/IV, false for 0-II, NULL when it cannot be told."""
    text = stripped(F.regexp_replace(F.upper(norm_missing(col)), "STAGE", ""))
    return F.when(text.rlike("^(III|IV)"), True).when(text.rlike("^[0I]"), False)


def node_positive(col: Column) -> Column:
    text = F.upper(norm_missing(col))
    return F.when(text.startswith("N0"), False).when(text.rlike("^N.*[1-9]"), True)


def metastasis_positive(col: Column) -> Column:
    text = F.upper(norm_missing(col))
    return F.when(text.startswith("M0"), False).when(text.startswith("M1"), True)


def any_known(*signals: Column) -> Column:
    """OR over the known signals; NULL only when none is known."""
    known = F.coalesce(*signals)
    hit = F.coalesce(signals[0], F.lit(False))
    for s in signals[1:]:
        hit = hit | F.coalesce(s, F.lit(False))
    return F.when(known.isNotNull(), hit)


def feature_accession(col: Column) -> Column:
    return stripped(F.split_part(col, F.lit(":"), F.lit(1)))


def feature_sites(col: Column) -> Column:
    """``acc:s12t34`` to ``[S12, T34]``."""
    tail = F.regexp_replace(col, "^[^:]*:", "")
    return F.transform(F.regexp_extract_all(tail, F.lit("([A-Za-z][0-9]+)"), F.lit(1)), F.upper)


def split_feature(col: Column) -> list[Column]:
    """``sign__set__feature`` to its three parts."""
    parts = F.split(col, "__", 3)
    return [
        F.when(parts[0] == "pos", "positive").otherwise("negative").alias("direction"),
        parts[1].alias("target_set"),
        parts[2].alias("feature"),
    ]


def safe_component(col: Column) -> Column:
    text = stripped(F.coalesce(col.cast("string"), F.lit("")))
    text = F.when(text == "", "unknown").otherwise(text)
    return F.left(F.regexp_replace(text, r"[^\p{L}\p{N}_.\-]", "_"), F.lit(COMPONENT_LENGTH))


def bag_key(col: Column) -> Column:
    return F.substring(F.sha1(col), 1, 16)


def contains_flag(*cols_and_needles: tuple[Column, str]) -> Column:
    """Case-insensitive contains, true when any pair matches, never NULL."""
    out = F.lit(False)
    for col, needle in cols_and_needles:
        out = out | F.coalesce(F.lower(col).contains(needle.lower()), F.lit(False))
    return out


def comma_items(col: Column) -> Column:
    return F.filter(F.split(F.coalesce(col, F.lit("")), ","), lambda v: v != "")


def include_filter(col: Column, text: str | None) -> Column:
    """Comma list of accepted values; an empty list accepts everything."""
    values = [v.strip() for v in (text or "").split(",") if v.strip()]
    return col.isin(values) if values else F.lit(True)


def first_usable(items: Column, keys: Sequence[str]) -> Column:
    """First non-missing value, item by item and within an item key by key."""
    found = F.flatten(F.transform(items, lambda it: F.array(*[norm_missing(it[k]) for k in keys])))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def max_numeric(values: Column) -> Column:
    return F.array_max(F.transform(values, lambda v: finite(stripped(v).try_cast("double"))))


def sex_male(col: Column, unknown_as_zero: bool = False) -> Column:
    low = F.lower(stripped(col))
    known = F.when(low == "male", 1.0).when(low == "female", 0.0)
    return F.coalesce(known, F.lit(0.0)) if unknown_as_zero else known


def recurrence_yes(col: Column) -> Column:
    """Only an explicit yes is known; anything else stays missing."""
    return F.when(F.lower(stripped(col)) == "yes", 1.0)


def quality_gate(occupancy: Column, white: Column | None = None, saturation: Column | None = None) -> Column:
    bad = occupancy < GATE_OCCUPANCY
    if white is not None:
        bad = bad | (white > GATE_WHITE)
    if saturation is not None:
        bad = bad | (saturation < GATE_SATURATION)
    return F.when(F.coalesce(bad, F.lit(True)), "WARN").otherwise("PASS")


def foreground(r: Column, g: Column, b: Column) -> Column:
    """Foreground test of a coloured point: not bright, or clearly coloured."""
    gray = (r + g + b) / F.lit(3.0)
    sat = F.greatest(r, g, b) - F.least(r, g, b)
    return (gray < MASK_GRAY) & ((sat > MASK_SATURATION) | (gray < MASK_GRAY_STRICT))


def polygon_area(points: Column) -> Column:
    """Shoelace area of ``array<struct<x,y>>``; NULL below three points."""
    n = F.size(points)
    nxt = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / F.lit(2.0))


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(x2 - x1, zero) * F.greatest(y2 - y1, zero)


def model_slug(col: Column) -> Column:
    return F.translate(col, "/-", "__")
