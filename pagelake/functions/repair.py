"""Deterministic repairs of recognised text, in a fixed order, with a count for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The letters of the repairs, and prefixes that keep their hyphen.
LOWER, UPPER = "a-zäöüß", "A-ZÄÖÜ"
PREFIXES = ("pseudo", "selbst", "quasi", "anti", "post", "self", "semi", "well", "non", "pre", "co", "ex", "re")

_L, _BREAK = LOWER + UPPER, " *\\r?\\n *"
FRONT_MATTER = r"(?sU)\A---\s*\n(.*?\n)?---\s*\n"
#: (name, Java pattern, replacement), in order; each works on what the one before has left.
RULES = (
    ("hyphen_prefix_keep", rf"(?iu)(?<![{_L}])({'|'.join(PREFIXES)})-{_BREAK}([{LOWER}][{_L}]*)", "$1-$2"),
    ("hyphen_rejoin", rf"([{_L}])-{_BREAK}([{LOWER}])", "$1$2"),
    ("hyphen_keep", rf"([{_L}])-{_BREAK}([{UPPER}])", "$1-$2"),
    ("emdash_break_join", "—[ \\t]*\\r?\\n[ \\t]*", "—"),
    ("line_break_join", rf"([{LOWER},;:»“”„)\]])[ \t]*\r?\n[ \t]*([{LOWER}])", "$1 $2"),
    ("spaces_collapsed", "[ \\t]{2,}", " "),
    ("space_before_punct", "[ \\t]+([,.;:!?])", "$1"),
)


def repair(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `repaired`, front_matter_stripped and a count for each rule; a null text stays null.

    Each rule is one more projection over the last one's result, so nothing is matched twice for a later rule.
    """
    out = df.withColumn("front_matter_stripped", F.col(text).rlike(FRONT_MATTER)).withColumn("repaired", F.regexp_replace(F.col(text), FRONT_MATTER, ""))
    for name, pattern, to in RULES:
        out = out.withColumns({name: F.regexp_count("repaired", F.lit(pattern)), "repaired": F.regexp_replace("repaired", pattern, to)})
    return out


def apply_rule(text: Column, name: str) -> Column:
    pattern, to = next((p, t) for n, p, t in RULES if n == name)
    return F.regexp_replace(text, pattern, to)
