"""JSON out of free text: whole arrays, lines of objects, objects inside prose, repairs.

Balanced bracket spans are found in one pass with a stack; a span that does not parse gives way to the spans inside it.
The kernels are Python because a parser is needed on text that is not JSON; they run on Arrow batches, one text per
element, and nothing of them is used where ``from_json`` or ``try_parse_json`` would do.
"""

from __future__ import annotations

import json
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a text may be wrapped in.
_FENCE = re.compile(r"\A\s*```\w*\s*|\s*```\s*\Z")
_PAIR = {"}": "{", "]": "["}


def _load(text: str):
    """The JSON value of a text, or a value of no JSON type."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return ...


def balanced(text: str) -> tuple[list[tuple[int, int]], list[str], bool]:
    """((start, end) of every closed bracket pair, brackets left open, is a string left open)."""
    spans, open_at, in_string, skip = [], [], False, False
    for m in re.finditer(r'[{}\[\]"\\]', text):
        c, i = m[0], m.start()
        if skip is not False and i == skip:
            skip = False
        elif in_string:
            if c == "\\":
                skip = i + 1
            in_string = c != '"'
        elif c == '"':
            # Quotation marks of the prose around are no strings.
            in_string = bool(open_at)
        elif c in "{[":
            open_at.append(i)
        elif c in _PAIR and open_at and text[open_at[-1]] == _PAIR[c]:
            spans.append((open_at.pop(), i + 1))
    return spans, [text[i] for i in open_at], in_string


def objects_in(text: str) -> list[dict]:
    """All objects of a text in order, those inside arrays too."""
    out, done = [], 0
    for start, end in sorted(balanced(text)[0], key=lambda s: (s[0], -s[1])):
        if start >= done and (value := _load(text[start:end])) is not ...:
            done = end
            out += [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
    return out


def parsed(text: str | None) -> tuple[str, list[dict]]:
    """(mode, objects): strict (one array), lines (one object a line), lenient (objects in prose), none."""
    body = _FENCE.sub("", text or "").strip()
    if isinstance(whole := _load(body), list):
        return "strict", [v for v in whole if isinstance(v, dict)]
    by_line = [_load(x.strip(" ,\t\r")) for x in body.splitlines() if x.lstrip().startswith("{")]
    if by_line and all(isinstance(v, dict) for v in by_line):
        return "lines", by_line
    # An object that follows its equal is the same one said twice.
    found = [next(same) for _, same in groupby(objects_in(body), key=canonical)]
    return ("lenient" if found else "none"), found


def mended(text: str) -> str:
    """The text with trailing commas out, commas between a value and the next line's key in, and all that is open closed."""
    text = re.sub(r",\s*([}\]])", r"\1", text)
    text = re.sub(r'(["}\]0-9el])(\s*\n\s*)(")', r"\1,\2\3", text)
    _, left_open, in_string = balanced(text)
    return re.sub(r",\s*$", "", text) + '"' * in_string + "".join("}" if c == "{" else "]" for c in reversed(left_open))


def rounded(value):
    """The value with floats to four places."""
    if isinstance(value, dict):
        return {k: rounded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [rounded(v) for v in value]
    return round(value, 4) if isinstance(value, float) else value


def canonical(value) -> str:
    """Sorted keys, no blanks, floats to four places."""
    return json.dumps(rounded(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StructType([T.StructField("mode", T.StringType()), T.StructField("objects", T.ArrayType(T.StringType()))]))
def parse_objects(text: pd.Series) -> pd.DataFrame:
    """struct(mode, objects as canonical JSON)."""
    rows = [parsed(t) for t in text]
    return pd.DataFrame({"mode": [m for m, _ in rows], "objects": [[canonical(o) for o in os] for _, os in rows]})


@F.pandas_udf(T.StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The first object of a text as canonical JSON, mended if need be; null if there is none."""
    def one(t):
        start = (t or "").find("{")
        if start < 0:
            return None
        # What the text breaks off in comes before what is whole inside it.
        whole = any(a == start for a, _ in balanced(t)[0])
        value = ... if whole else _load(mended(t[start:]))
        if not isinstance(value, dict):
            value = next(iter(objects_in(t)), None)
        return None if value is None else canonical(value)

    return text.map(one)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of a JSON text, null where it is none."""
    return text.map(lambda t: None if t is None or (v := _load(t)) is ... else canonical(v))
