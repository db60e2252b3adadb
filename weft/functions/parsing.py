"""Tolerant parsing of what models and people write: broken JSON, numerals in words. Arrow-batched, a small helper for each row."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from weft.functions import text as T

_FENCE = re.compile(r"```[A-Za-z]*\s*(.*?)```", re.S)
#: Full-width punctuation and curly quotes that stand for JSON's own.
_PLAIN = str.maketrans({"“": '"', "”": '"', "：": ":", "，": ",", "｛": "{", "｝": "}", "［": "[", "］": "]"})


def closed(body: str) -> str | None:
    """body with its open brackets closed; null if it ends inside a string or brackets don't match."""
    stack, text, skip = [], False, False
    for c in body:
        if skip:
            skip = False
        elif text:
            skip, text = c == "\\", c != '"'
        elif c == '"':
            text = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and (not stack or stack.pop() != c):
            return None
    return None if text else body.rstrip().rstrip(",") + "".join(reversed(stack))


def _candidates(body: str) -> Iterator[str]:
    for text in (body, body.translate(_PLAIN)):
        text = re.sub(r",\s*([}\]])", r"\1", text)
        yield text
        for cut in (text, text + '"', *(text[: m.start()] for m in reversed(list(re.finditer(r",", text))[-20:]))):
            if (whole := closed(cut)) is not None:
                yield whole


def loose_object(text: str | None) -> dict | None:
    """The first JSON object in a text: fenced or not, with prose around it, trailing commas, curly quotes or a cut-off end."""
    if not text:
        return None
    body = m[1] if (m := _FENCE.search(text)) else text
    at = body.find("{")
    if at < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(body[at:])
        return found
    except ValueError:
        pass
    end = body.rfind("}")
    for part in (body[at : end + 1] if end > at else "", body[at:]):
        for candidate in _candidates(part) if part else ():
            try:
                found = json.loads(candidate)
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
    return None


def loose_items(text: str | None) -> list[dict]:
    """All complete objects of an array that may be cut off, in order."""
    out, at, decoder = [], 0, json.JSONDecoder()
    text = (text or "").translate(_PLAIN) if text and "“" in text else text or ""
    while (at := text.find("{", at)) >= 0:
        try:
            found, n = decoder.raw_decode(text[at:])
            out.append(found)
            at += n
        except ValueError:
            at += 1
    return out


#: Chinese digits and units.
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_UNITS = {"十": 10, "百": 100, "千": 1000}


def numeral(text: str | None) -> int | None:
    """The number that ASCII digits or a Chinese numeral below a hundred million mean; null for anything else."""
    text = (text or "").strip()
    if text.isascii() and text.isdigit():
        return int(text)
    if not text or any(c not in _DIGITS and c not in _UNITS and c != "万" for c in text):
        return None
    if all(c in _DIGITS for c in text):
        return int("".join(str(_DIGITS[c]) for c in text))
    total = part = digit = 0
    for c in text:
        if c in _DIGITS:
            digit = _DIGITS[c]
        elif c in _UNITS:
            part, digit = part + (digit or 1) * _UNITS[c], 0
        else:
            total, part, digit = (part + digit) * 10_000, 0, 0
    return total + part + digit


@F.pandas_udf(StringType())
def parsed(text: pd.Series) -> pd.Series:
    """loose_object as canonical JSON (sorted keys); null where there is none."""
    found = [loose_object(x) for x in text]
    return pd.Series([None if x is None else json.dumps(x, sort_keys=True, ensure_ascii=False) for x in found])


@F.pandas_udf(LongType())
def number_of(text: pd.Series) -> pd.Series:
    """numeral of each text."""
    return pd.Series([numeral(x) for x in text], dtype="Int64")


def text_list(data: Column, field: str, most: int | None = None) -> Column:
    """The texts of a JSON field that is a list, or one text with separators: trimmed, without blanks, `most` at most."""
    raw = F.get_json_object(data, f"$.{field}")
    listed = F.coalesce(F.from_json(F.when(raw.startswith("["), raw), "array<string>"), T.as_list(F.when(~raw.startswith("["), raw)))
    out = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(out, 1, most) if most else out


def actions(data: Column, field: str, most: int = 8) -> Column:
    """An array of (action, what) of a JSON list of objects with desc (or description) and action, or of plain texts, which are
    hints; those without a text are left out."""
    item = lambda x: F.struct(F.coalesce(F.nullif(F.trim(F.get_json_object(x, "$.action")), F.lit("")), F.lit("hint")).alias("action"), F.trim(F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.desc"), F.get_json_object(x, "$.description"))).otherwise(x)).alias("what"))
    return F.slice(F.filter(F.transform(text_list(data, field), item), lambda a: F.coalesce(a["what"], F.lit("")) != ""), 1, most)


def entities(data: Column, field: str, kinds: list[str], most: int = 12) -> Column:
    """An array of (kind, name, owner) of a JSON list of objects: those with a name and an allowed kind (character if none)."""
    text = lambda x, f: F.nullif(F.trim(F.get_json_object(x, f"$.{f}")), F.lit(""))
    item = lambda x: F.struct(F.lower(F.coalesce(text(x, "kind"), F.lit("character"))).alias("kind"), text(x, "name").alias("name"), text(x, "owner").alias("owner"))
    return F.slice(F.filter(F.transform(text_list(data, field), item), lambda e: e["name"].isNotNull() & e["kind"].isin(*kinds)), 1, most)
