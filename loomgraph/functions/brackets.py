"""Brackets of any depth for regular expressions: each pair gets a number of its own.

``paired`` writes after an opening bracket, and before the one that closes it, a mark with the pair's number. A pattern that takes the mark
as a group finds the partner by a back reference, whatever nests in between: ``PAIR`` is what to write for the mark.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MARK = "\x01"
#: The mark of a pair in a pattern; as a group of its own it is referred to at the closing bracket.
PAIR = r"\x01\d+\x01"
_CLOSES = {")": "(", "]": "[", "}": "{"}
_BRACKET = re.compile(r"[()\[\]{}]")
_PARENTHESIS = re.compile(r"[()]")
_OUTSIDE_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"|[()\[\]{}]', re.S)


def number_pairs(text: str | None, tokens: re.Pattern = _BRACKET) -> str | None:
    """``text`` with the brackets among ``tokens`` marked by pairs, in the order in which they open; brackets without a partner stay bare."""
    if text is None:
        return None
    open_at, marks, number = [], {}, 0
    for m in tokens.finditer(text):
        token = m.group()
        if len(token) > 1 or token == '"':
            continue
        if token in _CLOSES:
            while open_at and open_at[-1][0] != _CLOSES[token]:
                open_at.pop()  # never closed
            if open_at:
                _, at, n = open_at.pop()
                marks[at + 1] = marks[m.start()] = f"{_MARK}{n}{_MARK}"
                if at + 1 == m.start():
                    marks[at + 1] *= 2
        else:
            open_at.append((token, m.start(), number))
            number += 1
    out, last = [], 0
    for at in sorted(marks):
        out += [text[last:at], marks[at]]
        last = at
    return "".join([*out, text[last:]])


@F.pandas_udf(StringType())
def paired(text: pd.Series) -> pd.Series:
    """All brackets by pairs, those in double-quoted strings aside."""
    return text.map(lambda t: number_pairs(t, _OUTSIDE_STRINGS))


@F.pandas_udf(StringType())
def paired_parentheses(text: pd.Series) -> pd.Series:
    """Parentheses by pairs, wherever they stand."""
    return text.map(lambda t: number_pairs(t, _PARENTHESIS))


def unmarked(text: Column) -> Column:
    """What ``paired`` was given."""
    return F.regexp_replace(text, PAIR, "")
