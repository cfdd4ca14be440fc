"""Expressions that are written once and read by Spark SQL and by the SQL of the checks.

``0.5`` is a double; ``R6(x)`` rounds x to six digits the same way everywhere; ``RX(column, 'pattern')`` is true where the
pattern is found; ``DIV(a, b)`` divides whole numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _calls(text: str, name: str, make) -> str:
    """Rewrites each call of ``name``, innermost last, by ``make`` (the text between its parentheses)."""
    while (at := text.find(f"{name}(")) >= 0:
        depth, k = 1, at + len(name) + 1
        start = k
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        text = text[:at] + make(text[start : k - 1]) + text[k:]
    return text


def _common(text: str) -> str:
    text = _calls(text, "R6", lambda x: f"(floor(({x}) * 1e6 + 5e-1) / 1e6)")
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", text)


#: A phrase of plain words between classes of characters: only texts that contain it need the expression.
_PLAIN = re.compile(r"RX\((\w+|lower\(\w+\)), '(\(\^\|\[[^\]']+\]\)([a-z ]+)\(\[[^\]']+\]\|\$\))'\)")


def spark_text(text: str) -> str:
    text = _PLAIN.sub(r"(contains(\1, '\3') AND regexp_like(\1, r'\2'))", text)
    text = re.sub(r"RX\((.+?), '", r"regexp_like(\1, r'", text)
    return _calls(_common(text), "DIV", lambda x: "((%s) DIV (%s))" % tuple(x.split(", ")))


def check_text(text: str) -> str:
    text = text.replace("RX(", "regexp_matches(")
    return _calls(_common(text), "DIV", lambda x: "((%s) // (%s))" % tuple(x.split(", ")))


def ex(text: str) -> Column:
    return F.expr(spark_text(text))


def r6(column: Column) -> Column:
    return F.floor(column * 1e6 + 0.5) / 1e6
