"""Text rules shared by every operator (O-SCL-1/2/6/19/21/27, T9, T13, T27).

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``,
so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The numeric reading pattern and the trim/title rules.
NUMERIC_PATTERN = r"-?\d+(?:\.\d+)?"
LETTER_RUNS = r"[A-Za-z]+|[^A-Za-z]+"
# Characters Python's str.strip() removes (str.isspace), as code points.
WHITESPACE_CODES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197,
                    8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
WHITESPACE = "".join(chr(c) for c in WHITESPACE_CODES)


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: ColumnOrName) -> Column:
    """NULL -> '', strip leading/trailing whitespace of any kind (not only spaces, T9).

    A character-set ``trim`` (no regex), so it stays cheap inside codegen.
    """
    return F.coalesce(F.trim(col(c).cast("string"), F.lit(WHITESPACE)), F.lit(""))


def is_blank(c: ColumnOrName) -> Column:
    return clean(c) == F.lit("")


def nonblank(c: ColumnOrName) -> Column:
    """Cleaned text, or NULL when blank (for coalesce chains)."""
    return F.nullif(clean(c), F.lit(""))


def title_case(c: ColumnOrName) -> Column:
    """Capitalise the first letter after any non-letter, lower the rest.

    ``initcap`` only restarts after spaces (``h2o2`` -> ``H2o2``); splitting into
    letter / non-letter runs and capitalising each run gives ``H2O2``.
    """
    runs = F.regexp_extract_all(col(c), F.lit(LETTER_RUNS), 0)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def parse_numeric(c: ColumnOrName) -> Column:
    """First signed decimal in the text after dropping commas; NULL if none."""
    digits = F.regexp_extract(F.regexp_replace(clean(c), ",", ""), NUMERIC_PATTERN, 0)
    return F.nullif(digits, F.lit("")).try_cast("double")


def contains_pattern(search: str) -> str:
    """LIKE pattern for a substring search: ``%`` and ``_`` stay wildcards, a backslash is an ordinary character."""
    return "%" + search.replace("\\", "\\\\") + "%"


def comment_label(c: ColumnOrName) -> Column:
    """``rinse_comments`` -> ``Rinse``; nothing left -> ``Comments``."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(clean(c)), r"_?comments?$", ""), r"^_+|_+$", "")
    return F.when(stem == "", F.lit("Comments")).otherwise(title_case(F.regexp_replace(stem, "_+", " ")))


def safe_filename(c: ColumnOrName, fallback: str = "item") -> Column:
    """Runs of characters outside ``[A-Za-z0-9._-]`` -> ``_``, edges ``._-`` stripped, 90 chars."""
    cleaned = F.regexp_replace(F.regexp_replace(clean(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(fallback)), 1, 90)


def photo_refs(c: ColumnOrName) -> Column:
    """Upload references in a free-text photo field, ordered and distinct.

    Text without ``static/uploads/`` cannot hold a reference, so the array
    functions (evaluated outside generated code) only run on the rest.
    """
    parts = F.transform(F.split(clean(c), r"[\r\n,]+"), lambda p: clean(p))
    rooted = F.transform(parts, lambda p: F.when(p.startswith("static/uploads/"), F.concat(F.lit("/"), p)).otherwise(p))
    refs = F.array_distinct(F.filter(rooted, lambda p: p.startswith("/static/uploads/")))
    return F.when(F.coalesce(col(c), F.lit("")).contains("static/uploads/"), refs).otherwise(
        F.array().cast("array<string>"))
