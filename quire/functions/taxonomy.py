"""Announcement-type taxonomy: label -> case-insensitive partial regex.

Labels overlap (every ``Placements`` match is also a ``Shares 3B's, 2A's``
match), so labelling is multi-label: an announcement carries an array of all
labels whose pattern matches its type string.  A NULL type string matches no
label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's taxonomy byte for byte --------
# label, pattern (matched case-insensitively, anywhere in the string)
TAXONOMY = [
    ("Cashflow Reports", "Cash"),
    ("Mining studies/resources", "dfs|pfs|scoping|study|feasibility|jorc|resource"),
    ("Placements", "Placement|Renounceable|Security Purchase|Trading Halt"),
    ("Shares 3B's, 2A's", "Placement|Appendix 2A|Appendix 3B|Renounceable|Security Purchase|Appendix 3G|Trading Halt"),
    ("Presentations", "presentation"),
]
# ---------------------------------------------------------------------------

LABELS = [label for label, _ in TAXONOMY]
# Java regex: (?i) alone folds ASCII only; (?iu) folds Unicode like RE2's 'i'.
_FLAGS = "(?iu)"


def label_matches(col: Column, label: str) -> Column:
    """Boolean Column: does ``col`` match the pattern of ``label``? NULL -> false."""
    pattern = dict(TAXONOMY)[label]
    return F.coalesce(col.rlike(_FLAGS + pattern), F.lit(False))


def type_predicate(col: Column, labels) -> Column | None:
    """FLT-4: OR over the *known* selected labels; None when no label is known.

    Unknown labels are ignored; if none of the selected labels is known the
    caller applies no type filter at all (the reference's behaviour).
    """
    known = [lab for lab in (labels or []) if lab in dict(TAXONOMY)]
    if not known:
        return None
    return reduce(lambda a, b: a | b, [label_matches(col, lab) for lab in known])


def labels_array(col: Column) -> Column:
    """JN-4 (static taxonomy): array of every matching label, in taxonomy order."""
    return F.filter(
        F.array(*[F.when(label_matches(col, lab), F.lit(lab)) for lab in LABELS]),
        lambda x: x.isNotNull(),
    )


def label_mask(col: Column) -> Column:
    """Bit mask of matching labels (bit i = LABELS[i]); a small class key."""
    bits = [F.when(label_matches(col, lab), F.lit(1 << i)).otherwise(F.lit(0))
            for i, lab in enumerate(LABELS)]
    return reduce(lambda a, b: a + b, bits).cast("int")


def known_mask(labels_col: Column) -> Column:
    """Bit mask of the known labels in an array<string> of selected labels."""
    bits = [F.when(F.array_contains(labels_col, F.lit(lab)), F.lit(1 << i)).otherwise(F.lit(0))
            for i, lab in enumerate(LABELS)]
    return F.coalesce(reduce(lambda a, b: a + b, bits), F.lit(0)).cast("int")


def taxonomy_frame(spark: SparkSession) -> DataFrame:
    """The taxonomy as a 5-row DataFrame (label, pattern), for table-driven joins."""
    return spark.createDataFrame(TAXONOMY, "label string, pattern string")
