"""Column expressions that level spellings, so that values compare by meaning.

All of them return null for null, for blanks and for stand-in words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value.
MISSING_WORDS = ["", "n/a", "na", "unk", "unknown", "none", "null", "nil", "-", "--", "?"]
# Synonyms of severities.
SEVERITY_SYNONYMS = {"info": "informational", "moderate": "medium"}
# Words for verdicts.
CONFIRM_WORDS = ["confirm", "confirmed", "true positive", "tp"]
REJECT_WORDS = ["reject", "rejected", "false positive", "fp"]
UNCERTAIN_WORDS = ["uncertain", "unsure", "unk"]


def _known(c: Column) -> Column:
    return F.when(~c.isin(MISSING_WORDS), c)


def level_word(c: Column) -> Column:
    """Lower case, blanks and hyphens as underscores, no padding."""
    return _known(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"))


def level_severity(c: Column) -> Column:
    word = _known(F.lower(F.trim(c)))
    for given, meant in SEVERITY_SYNONYMS.items():
        word = F.when(word == given, F.lit(meant)).otherwise(word)
    return word


def level_cwe(c: Column) -> Column:
    """The number of a weakness class, from any spelling of it, as an integer."""
    low = F.lower(c)
    digits = F.coalesce(
        F.nullif(F.regexp_extract(low, r"cwe[^0-9a-z]*0*([0-9]{1,7})", 1), F.lit("")),
        F.nullif(F.regexp_extract(low, r"^\s*0*([0-9]{1,7})\s*$", 1), F.lit("")),
    )
    return digits.cast("int")


def level_path(c: Column) -> Column:
    """One spelling per path: ``/`` as separator, lower case, no blanks, no ``.`` or ``..`` parts."""
    p = F.regexp_replace(F.lower(c), r"\s+", "")
    p = F.regexp_replace(p, r"%2f|%5c|\\", "/")
    p = F.regexp_replace(p, r"^file://", "")
    p = F.regexp_replace(p, r"/+", "/")
    p = F.regexp_replace(p, r"(^|/)(\./)+", "$1")
    p = F.regexp_replace(p, r"^/+|/+$", "")
    # Each ``..`` takes away the part before it, in order; those with none before them stay.
    return _known(F.when(p.contains(".."), _without_hops(p)).otherwise(p))


def _without_hops(p: Column) -> Column:
    def step(done: Column, part: Column) -> Column:
        goes_up = (part == "..") & (done != "") & ~done.rlike(r"(^|/)\.\.$")
        longer = F.when(done == "", part).otherwise(F.concat(done, F.lit("/"), part))
        return F.when(goes_up, F.regexp_replace(done, r"(^|/)[^/]+$", "")).otherwise(longer)

    return F.aggregate(F.split(p, "/"), F.lit(""), step)


def path_tail(levelled: Column, parts: int = 3) -> Column:
    """The last parts of a levelled path; shorter paths stay whole."""
    return F.substring_index(levelled, "/", -parts)


def level_repo(c: Column) -> Column:
    """The bare name of a repository: no address, no owner, no ``.git``, lower case."""
    r = F.regexp_replace(F.lower(c), r"^\s+|[\s/]+$", "")
    r = F.regexp_replace(r, r"\.git$", "")
    r = F.regexp_extract(r, r"([^/:\\]*)$", 1)
    return _known(F.regexp_replace(r, r"[\s_]+", "-"))


def level_verdict(c: Column) -> Column:
    """``confirm``, ``reject`` or ``uncertain`` from a word or from ``{"verdict": word}``."""
    inner = F.nullif(F.regexp_extract(F.lower(c), r'"verdict"\s*:\s*"([^"]*)"', 1), F.lit(""))
    word = F.regexp_replace(F.trim(F.coalesce(inner, F.lower(c))), r"[\s_\-]+", " ")
    return (
        F.when(word.isin(CONFIRM_WORDS), "confirm")
        .when(word.isin(REJECT_WORDS), "reject")
        .when(word.isin(UNCERTAIN_WORDS), "uncertain")
    )
