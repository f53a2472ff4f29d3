"""Texts without content: nothing, blanks, invisible characters, punctuation, or a stand-in for a missing value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed stand-ins for a missing value, compared without case, blanks and punctuation.
STAND_INS = (
    "null", "none", "nan", "na", "nil", "nul", "tbd", "tba", "todo", "tk", "empty", "blank", "void", "missing", "undefined", "unknown",
    "nooutput", "noanswer", "noresponse", "nocontent", "nodata", "notext", "noresult", "notavailable", "notapplicable", "placeholder", "insertessayhere", "insertprompthere",
)
_TAG = r"</?[A-Za-z][^<>]*>"
_LONGEST = max(map(len, STAND_INS))
_CONTENT = re.compile(r"[^\W_]+")


def is_blank(text: str | None) -> bool:
    """Whether a text has no content, however long it is; null has none either."""
    if not text:
        return True
    squeezed = ""
    for m in _CONTENT.finditer(re.sub(_TAG, "", text) if "<" in text else text):
        squeezed += m.group()
        if len(squeezed) > _LONGEST:
            return False
    return not squeezed or squeezed.lower() in STAND_INS


def blank(c: Column) -> Column:
    """``is_blank`` as a column expression. Texts without tags that hold more than a stand-in are told by one scan."""
    filled = ~c.contains("<") & c.rlike(rf"(?:[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]*+){{{_LONGEST + 1}}}")
    squeezed = F.lower(F.regexp_replace(F.regexp_replace(c, _TAG, ""), r"[^\p{L}\p{N}]+", ""))
    return c.isNull() | ~filled & ((squeezed == "") | squeezed.isin(*STAND_INS))
