"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakforge.schema import CLASS_CODES

# How each interpretation is rewritten, per policy. Unlisted values pass through.
RECODE = {
    "merge_i": {"S": "S", "R": "R", "I": "R", "R*": None, "ESBL": None, "EBL?": None},
    "keep_i": {"S": "S", "R": "R", "I": "I", "R*": "R", "ESBL": None, "EBL?": None},
}

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad8(c) -> Column:
    """Left-pad with zeros to eight characters; longer values stay whole (``lpad`` alone would cut them)."""
    c = _col(c).cast("string")
    return F.when(F.length(c) < 8, F.lpad(c, 8, "0")).otherwise(c)


def canonical_id(c) -> Column:
    """Numeric text such as ``18117816.0`` to an eight-digit id; NULL when it is not a number."""
    c = _col(c).cast("string")
    return pad8(F.when(c.rlike(NUMBER), F.trim(c).try_cast("double").try_cast("long").cast("string")))


def capitalise(c) -> Column:
    """First character upper, the rest lower (``initcap`` would also touch inner words)."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def recode(c, policy: str = "merge_i") -> Column:
    """Rewrite a susceptibility letter; empty text and the codes without a letter become NULL."""
    c = _col(c)
    out = F.when(c == "", F.lit(None).cast("string"))
    for raw, new in RECODE[policy].items():
        out = out.when(c == raw, F.lit(new).cast("string"))
    return out.otherwise(c)


def class_code(c, classes=("R", "S")) -> Column:
    """Integer code of a class letter, NULL outside ``classes``."""
    c, out = _col(c), None
    for name in classes:
        out = (F.when if out is None else out.when)(c == name, F.lit(CLASS_CODES[name]))
    return out


def hash_uniform(*parts) -> Column:
    """Repeatable draw in [0, 1) from the given columns and constants; independent of partitioning."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
