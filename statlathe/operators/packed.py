"""Several values packed in one field: dictionary-guided segmentation (problem 7).

A packed string is segmented in two passes. The first reads every distinct string by its notation alone (separators,
quotes, escapes, a bracketed list) and counts the values found; values held by at least ``DICTIONARY_PART`` of the
strings form the dictionary, which therefore has at most ``mean values per string / DICTIONARY_PART`` entries. The
second finds the dictionary's values in every string with an Aho-Corasick automaton and takes the cheapest cover by
dynamic programming. A dictionary value beats cutting it at a delimiter that belongs to it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import is_blank

#: The least part of all distinct packed strings that hold a value for it to be in the dictionary.
DICTIONARY_PART = 0.001
SEPARATORS = frozenset("$;|,/\t\n\r")
QUOTES = {'"': '"', "“": "”", "«": "»"}
#: Costs of the pieces of a cover: a value of the dictionary, one read by its quotes or escapes, one of plain text.
KNOWN, QUOTED, PLAIN = 1.0, 1.5, 2.0


def _quoted(s: str, i: int) -> tuple[str, int] | None:
    """The value in the quotes that open at ``i`` and where it ends; None unless they close before a separator."""
    close, out, j, n = QUOTES[s[i]], [], i + 1, len(s)
    while j < n:
        c = s[j]
        if c == "\\" and j + 1 < n:
            out.append(s[j + 1])
            j += 2
        elif c == close:
            if close == '"' and s[j + 1 : j + 2] == '"':
                out.append('"')
                j += 2
                continue
            k = j + 1
            while k < n and s[k] == " ":
                k += 1
            return ("".join(out), j + 1) if k == n or s[k] in SEPARATORS or s[k] == "]" else None
        else:
            out.append(c)
            j += 1
    return None


def _plain(s: str, i: int) -> tuple[str, int, bool]:
    """The unquoted value from ``i`` up to the next bare separator; whether it holds escapes."""
    out, j, n, escaped = [], i, len(s), False
    while j < n and s[j] not in SEPARATORS:
        if s[j] == "\\" and j + 1 < n:
            escaped = True
            j += 1
        out.append(s[j])
        j += 1
    return "".join(out), j, escaped


def _body(s: str) -> str | None:
    """What stands within the brackets of a list notation."""
    t = s.strip()
    return t[1:-1] if len(t) > 1 and (t[0], t[-1]) in {("[", "]"), ("{", "}"), ("(", ")")} else None


def automaton(values: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for v in values:
        found.add_word(v.lower(), len(v))
    if values:
        found.make_automaton()
    return found if values else None


def segment(s: str, known=None) -> list[str]:
    """The values of a packed string in their order, empty ones left out."""
    if s is None:
        return []
    body = _body(s)
    if body is not None:
        s = body
    n = len(s)
    low = s.lower()
    hits: dict[int, list[int]] = {}
    if known is not None and len(low) == n:
        for end, size in known.iter(low):
            hits.setdefault(end - size + 1, []).append(end + 1)
    # best[i]: the least cost of what follows place i, where a value may begin; and the first step of that cover
    best: list[tuple[float, int, str | None]] = [(0.0, n, None)] * (n + 1)
    edge = lambda i: i == 0 or s[i - 1] in SEPARATORS or s[i - 1] == " "
    for i in range(n - 1, -1, -1):
        c = s[i]
        if c in SEPARATORS or c.isspace():
            best[i] = (best[i + 1][0], i + 1, None)
            continue
        if not edge(i):
            best[i] = (float("inf"), i + 1, None)
            continue
        options = []
        if c in QUOTES and (q := _quoted(s, i)):
            options.append((QUOTED + best[q[1]][0], q[1], q[0]))
        text, end, escaped = _plain(s, i)
        options.append(((QUOTED if escaped else PLAIN) + best[end][0], end, text))
        for end in hits.get(i, ()):
            k = end
            while k < n and s[k] == " ":
                k += 1
            if k == n or s[k] in SEPARATORS:
                options.append((KNOWN + best[k][0], k, s[i:end]))
        best[i] = min(options, key=lambda x: (x[0], -x[1]))
    out, i = [], 0
    while i < n:
        _, j, value = best[i]
        if value is not None and (v := value.strip()):
            out.append(v)
        i = j
    return out


def _segment_all(values: list[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = automaton(values) if values else None
        for b in batches:
            found = [segment(s, known) for s in b.iloc[:, 0]]
            yield pd.DataFrame({"packed": b.iloc[:, 0], "found": found})

    return run


def dictionary(df: DataFrame, column: str, part: float = DICTIONARY_PART) -> list[str]:
    """Values that at least ``part`` of the distinct strings of ``column`` hold by their notation; the bound on their
    number (see above) is what lets them be collected. A value with no separator inside needs no protection and is kept
    as well: it makes a cover of known values cheaper than one with unknown ones."""
    texts = df.where(~is_blank(F.col(column))).select(F.col(column).alias("packed")).distinct()
    n = texts.count()
    if not n:
        return []
    rows = texts.mapInPandas(_segment_all(None), "packed string, found array<string>")
    counts = rows.select(F.explode(F.array_distinct("found")).alias("v")).groupBy("v").count()
    return sorted(r.v for r in counts.where((F.col("count") >= F.lit(max(2.0, part * n)))).select("v").collect())


def split_packed(df: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """``packed`` (each distinct non-blank string of ``column``) with ``found``, the array of its values in order.

    NULL, empty and blank strings have no row here. Strings are segmented once however often they are repeated."""
    if values is None:
        values = dictionary(df, column)
    texts = df.where(~is_blank(F.col(column))).select(F.col(column).alias("packed")).distinct()
    return texts.mapInPandas(_segment_all(values), "packed string, found array<string>")


def unpack(df: DataFrame, key: str, column: str, least: int = 1, values: list[str] | None = None) -> DataFrame:
    """One row for each value: ``key``, ``pos`` from 1, ``value``; rows with fewer than ``least`` values left out.

    Strings are segmented where the rows are, with each partition's own memory of repeated strings, so that no hot
    string is shuffled. Blank strings give no row; repeated values keep their places; other columns are ignored."""
    if values is None:
        values = dictionary(df, column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, memory = automaton(values) if values else None, {}
        for b in batches:
            found = []
            for s in b["packed"]:
                if s not in memory:
                    if len(memory) > 200_000:
                        memory.clear()
                    memory[s] = segment(s, known)
                found.append(memory[s])
            yield pd.DataFrame({"k": b["k"], "found": found})

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(~is_blank(F.col(column))).select(F.col(key).alias("k"), F.col(column).alias("packed"))
    rows = rows.mapInPandas(run, f"k {kind}, found array<string>").where(F.size("found") >= least)
    return rows.select(F.col("k").alias(key), F.posexplode("found").alias("p", "value")).select(key, (F.col("p") + 1).alias("pos"), "value")


def as_json(values: list[str]) -> str:
    """A packed string that reads back as ``values``; for tests and sinks."""
    return json.dumps(values, ensure_ascii=False)
