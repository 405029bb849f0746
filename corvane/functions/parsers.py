"""What texts hold besides prose: blocks that a host put in, JSON documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of blocks that a host puts into a user's turn.
HOST_TAGS = (
    "ide_opened_file", "ide_selection", "system-reminder", "task-notification", "local-command-caveat",
    "local-command-stdout", "command-name", "command-message", "command-args", "user-prompt-submit-hook",
)
FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)\n?```", re.DOTALL)


def without_host_blocks(text: Column) -> Column:
    """text with each block between equal host tags, and then each host tag that stands alone, replaced by a blank; other tags stay."""
    tags = "|".join(HOST_TAGS)
    return F.regexp_replace(F.regexp_replace(text, rf"(?is)<({tags})\b[^>]*>.*?</\1>", " "), rf"(?is)</?({tags})\b[^>]*/?>", " ")


def balanced(text: str) -> str | None:
    """The stretch from the first brace that is closed to the one that closes it, by depth; braces inside the JSON strings of an open brace don't count. None where no brace is closed.

    One pass with the open braces on a stack. Where a string never ends, quotes are taken as plain characters in a second pass.
    """
    for quotes in (True, False):
        stack, best, quoted, i = [], None, False, 0
        while i < len(text):
            c = text[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = quotes and bool(stack)
            elif c == "{":
                stack.append(i)
            elif c == "}" and stack:
                start = stack.pop()
                if best is None or start < best[0]:
                    best = (start, i + 1)
                if not stack:
                    break
            i += 1
        if not quoted:
            break
    return text[best[0] : best[1]] if best else None


def json_in(text: str | None) -> str | None:
    """A text's JSON: the document that it begins with, else what is inside its first fence, else its first balanced braces."""
    body = (text or "").strip()
    if body.startswith("{"):
        try:
            return body[: json.JSONDecoder().raw_decode(body)[1]]
        except (json.JSONDecodeError, RecursionError):
            pass
    fenced = FENCE.search(body)
    return fenced.group(1).strip() if fenced else balanced(body)


def embedded_json(text: Column) -> Column:
    """json_in of a column; null where there is none."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([json_in(t) for t in part], dtype=object)

    return F.pandas_udf(run, "string")(text)
