"""JSON answers: fences stripped, raw control characters in strings repaired, first value found."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def repaired(text: str) -> str:
    """Raw newlines, returns and tabs inside string literals are escaped."""
    out, inside, escaped = [], False, False
    for c in text:
        if inside and not escaped and c in "\n\r\t":
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c])
            continue
        if c == '"' and not escaped:
            inside = not inside
        escaped = inside and c == "\\" and not escaped
        out.append(c)
    return "".join(out)


#: The fence before and behind an answer.
_OPENING, _CLOSING = re.compile(r"^```(?:json)?\s*\n?"), re.compile(r"\n?```\s*$")


def parsed(raw: str | None) -> str | None:
    """The JSON value of an answer as compact text; None if there is none.

    Fences go. The whole is tried as it is and repaired; then what follows the first bracket, and
    what follows the first brace, if anything stands before it. Text behind a value is an error."""
    if raw is None:
        return None
    text = _CLOSING.sub("", _OPENING.sub("", raw.strip(), count=1), count=1).strip()
    tails = [text[i:] for i in (text.find("["), text.find("{")) if i > 0]
    for attempt in (text, repaired(text), *map(repaired, tails)):
        try:
            return json.dumps(json.loads(attempt), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def json_answer(raw: pd.Series) -> pd.Series:
    return raw.map(parsed)


def unfenced(raw: Column) -> Column:
    """The text between code fences, or the text itself, without a user function."""
    return F.regexp_replace(F.trim(raw), r"(?s)^```[a-zA-Z]*\n(.*?)\n?```$", "$1")


def payload(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
