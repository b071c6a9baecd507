"""Mapping free-entered values to a canonical list (problem 6).

Distinct values are normalised and read in a few ways (with or without what was added to them); candidates come from an
inverted index of character n-grams of the list's entries; weighted cosine scores them, and the best is accepted above a
threshold and a margin over the next.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import is_blank
from statlathe.plans.shared import salted_join, written

#: Length of character n-grams; tokens are padded at both ends.
GRAM = 3
#: The least cosine of an accepted value, and its least lead over the next entry's.
THRESHOLD, MARGIN = 0.56, 0.04
#: Entries whose postings one task may hold; longer lists are searched in slices of this size.
LIST_SLICE = 50_000

# English function words, which weigh little; and what is used for a whole word without its letters in order.
LIGHT = frozenset("a an the of to in on at for by and or from during with".split())
SHORT_FORMS = {"tv": "television", "iv": "interview", "presser": "conference", "organisation": "organization", "labor": "labour"}
DATES = "january february march april may june july august september october november december jan feb mar apr jun jul aug sept sep oct nov dec monday tuesday wednesday thursday friday saturday sunday".split()


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.replace("’", "'")).lower() if not unicodedata.combining(c))


def tokens(s: str) -> list[tuple[str, bool]]:
    """Words of a folded text, each with whether a full stop cut it short; single letters joined by stops or slashes are
    one word."""
    s = re.sub(r"\b(?:[^\W\d_][./]){1,}[^\W\d_]\b\.?", lambda m: re.sub(r"[./]", "", m.group()), s)
    return [(m.group(1), bool(m.group(2))) for m in re.finditer(r"([^\W_]+)(\.?)", s)]


def readings(value: str) -> list[str]:
    """A value, and what is left of it without bracketed text, a part after a comma, a place or a date."""
    whole = " ".join(value.split())
    out = [whole]
    bare = re.sub(r"\s*[(\[][^)\]]*[)\]]?\s*", " ", whole).strip()
    out.append(bare)
    if "," in bare:
        out.append(bare.split(",")[0])
    for x in list(out):
        cut = re.split(r"\s+(?:in|near|from|for|with|on|after|before|since)\s+(?=[A-ZÀ-Þ0-9])", x)[0]
        out.append(cut)
        out.append(re.sub(r"^\s*(?:at|in|during|on|from|via)\s+", "", cut, flags=re.I))
        out.append(re.sub(r"\s+(?:members?|supporter|\(\w+\))$", "", cut, flags=re.I))
    dates = "|".join(DATES)
    out += [re.sub(rf"[\s,]+(?:on\s+|last\s+|this\s+|next\s+)?(?:{dates})\b\.?\s*\d*(?:,?\s*\d{{4}})?\s*$", "", x, flags=re.I) for x in list(out)]
    return [x for x in dict.fromkeys(out) if x.strip()]


def short_for(t: str, word: str) -> bool:
    """Whether ``t`` is ``word`` cut short: its start, or some of its letters in their order from the first on."""
    if len(t) >= len(word) or t[0] != word[0]:
        return False
    if word.startswith(t):
        return True
    rest = iter(word)
    return len(t) >= 3 and all(c in rest for c in t) and t[-1] in word[-4:]


def one_slip(a: str, b: str, most: int) -> bool:
    """Whether ``a`` becomes ``b`` by at most ``most`` changed, added, dropped or swapped letters."""
    if abs(len(a) - len(b)) > most:
        return False
    n, start = min(len(a), len(b)), 0
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return max(len(a), len(b)) <= most
    big = most + 1
    before, row = [], [min(j, big) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [big] * (len(b) + 1)
        new[0] = min(i, big)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new[j] = min(d, big)
        if min(new) > most:
            return False
        before, row = row, new
    return row[-1] <= most


def slip_keys(token: str) -> set[str]:
    """Tokens of more than three letters a slip apart (two slips where both have more than six) share one of these: what is
    left of a token without one of its letters (two where it is long). Of very long tokens, the first or last letters, or
    some between two slips."""
    n, out = len(token), set()
    if n > 3 and n <= 26:
        out = {token} | {token[:i] + token[i + 1 :] for i in range(n)}
        if n > 6:
            out |= {w[:i] + w[i + 1 :] for w in list(out - {token}) for i in range(n - 1)}
    if n > 22:
        out |= {"^" + token[:7], "$" + token[-7:], "-" + token[8:14], "-" + token[9:15]}
    return out


def grams(word: str) -> Counter:
    s = f"^{word}$"
    return Counter(s[i : i + GRAM] for i in range(max(1, len(s) - GRAM + 1)))


class Index:
    """Inverted index of the n-grams of a list's entries, each with the words it is part of."""

    def __init__(self, entries: list[tuple[int, str]], part: int = 0, parts: int = 1):
        """Weights, known words and initials are those of all ``entries``; only every ``parts``-th entry from ``part`` on is
        posted."""
        names = [[t for t, _ in tokens(fold(n))] for _, n in entries]
        self.words = {w for n in names for w in n}
        self.long = sorted(w for w in self.words if w not in LIGHT and len(w) > 2)
        # what a word that is in no entry is looked up by: slips, and first with one of the last letters
        self.slips: dict[str, list[str]] = defaultdict(list)
        self.ends: dict[tuple[str, str], list[str]] = defaultdict(list)
        for w in self.long:
            for k in slip_keys(w):
                self.slips[k].append(w)
            for c in set(w[-4:]):
                self.ends[w[0], c].append(w)
        held = Counter(g for n in names for g in {g for w in n for g in grams(w)})
        n = len(names)
        self.idf = {g: math.log(1 + n / k) for g, k in held.items()}
        self.unknown = math.log(1 + n)
        self.memory: dict[str, Counter] = {}
        initials = Counter(self._initials(n) for n in names)
        self.initials = {self._initials(n): i for (i, _), n in zip(entries, names, strict=True) if len(self._initials(n)) > 2 and initials[self._initials(n)] == 1}
        self.first = part == 0  # which answers for initials
        self.ids, self.names = [i for i, _ in entries[part::parts]], names[part::parts]
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, name in enumerate(self.names):
            v = self.vector([(w, False) for w in name])
            size = math.sqrt(sum(x * x for x in v.values())) or 1.0
            for g, x in v.items():
                self.postings[g].append((k, x / size))

    @staticmethod
    def _initials(name: list[str]) -> str:
        return "".join(w[0] for w in name if w not in LIGHT)

    def starting(self, t: str) -> list[str]:
        """Known longer words that start with ``t``."""
        out = self.long[bisect_left(self.long, t) : bisect_left(self.long, t + "\U0010ffff")]
        return [w for w in out if w != t]

    def slipped(self, t: str) -> list[str]:
        """Known words that ``t`` is by one slip, then by two (when both are long), each in their order."""
        near = sorted({w for k in slip_keys(t) for w in self.slips.get(k, ())})
        return [w for most in (1, 2) if len(t) > 3 * most for w in near if len(w) > 3 * most and one_slip(t, w, most)]

    def word(self, t: str, cut: bool) -> Counter:
        """The n-grams of a word as it weighs: a short form counts as the words it may stand for."""
        key = t + "." * cut
        if key not in self.memory:
            t = SHORT_FORMS.get(t, t)
            full = [t]
            part = 1.0
            if t not in self.words and t not in LIGHT and (len(t) > 1 or cut):
                start = self.starting(t) if cut else []
                near = [] if start else self.slipped(t)
                short = [] if start or near else sorted({*self.starting(t), *(w for w in self.ends.get((t[0], t[-1]), ()) if short_for(t, w))})
                full = start or near[:1] or [w for w in short if len(w) - len(t) > 1 or cut] or [t]
                part = 0.97 if full != [t] else 1.0
            out: Counter = Counter()
            for w in full:
                weight = (0.2 if w in LIGHT else part) / len(full) ** 0.5
                for g, x in grams(w).items():
                    out[g] += weight * x * self.idf.get(g, self.unknown)
            if len(self.memory) < 500_000:
                self.memory[key] = out
            return out
        return self.memory[key]

    def vector(self, words: list[tuple[str, bool]]) -> Counter:
        out: Counter = Counter()
        for t, cut in words:
            for g, x in self.word(t, cut).items():
                out[g] += x
        return out

    def best(self, value: str) -> list[tuple[float, int]]:
        """The two best entries of a value, best first, ties by the smaller id."""
        score: dict[int, float] = defaultdict(float)
        if (short := re.sub(r"[\s.]", "", fold(value))) in self.initials:
            return [(1.0, self.initials[short])] if self.first else []
        for r in readings(value):
            v = self.vector(tokens(fold(r)))
            size = math.sqrt(sum(x * x for x in v.values()))
            if not size:
                continue
            one: dict[int, float] = defaultdict(float)
            for g, x in v.items():
                for k, y in self.postings.get(g, ()):
                    one[k] += x * y / size
            for k, x in one.items():
                score[k] = max(score[k], x)
        return sorted(((x, self.ids[k]) for k, x in score.items()), key=lambda s: (-s[0], s[1]))[:2]


def _match(entries: dict[str, list[tuple[int, str]]], part: int = 0, parts: int = 1):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {f: Index(e, part, parts) for f, e in entries.items()}
        for b in batches:
            out = []
            for f, v in zip(b["field_name"], b["value"], strict=True):
                for rank, (x, i) in enumerate(index[f].best(v) if f in index else []):
                    out.append((f, v, i, x, rank))
            yield pd.DataFrame(out, columns=["field_name", "value", "canon_id", "score", "rank"]).astype({"canon_id": "int32", "score": "float64", "rank": "int32"})

    return run


def match_values(values: DataFrame, canon: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """``(field_name, value, canon_id, score, lead)`` for each distinct ``(field_name, value)``; canon_id 0 when no entry
    reaches the threshold with the margin, or when the field has no list. ``canon``: field_name, canon_id, canon_name.

    Each task holds the list, and the postings of about ``LIST_SLICE`` of its entries; the best two of each slice are
    merged, which all weigh by the whole list."""
    rows = canon.where(F.col("canon_name").isNotNull()).select("field_name", F.col("canon_id").cast("int").alias("canon_id"), "canon_name")
    entries = defaultdict(list)
    for r in rows.orderBy("field_name", "canon_id", "canon_name").collect():
        entries[r.field_name].append((r.canon_id, r.canon_name))
    slices = max(1, -(-sum(map(len, entries.values())) // LIST_SLICE))
    found = None
    for k in range(slices):
        one = values.mapInPandas(_match(dict(entries), k, slices), "field_name string, value string, canon_id int, score double, rank int")
        found = one if found is None else found.union(one)
    top = found.groupBy("field_name", "value").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "canon_id"))).alias("top"))
    score, lead = -F.col("top")[0].s, F.get("top", F.lit(1)).s - F.col("top")[0].s
    sure = (score >= threshold) & (F.coalesce(lead, score) >= margin)
    got = top.select("field_name", "value", F.when(sure, F.col("top")[0].canon_id).otherwise(0).alias("canon_id"), score.alias("score"), F.coalesce(lead, score).alias("lead"))
    return values.join(got, ["field_name", "value"], "left").select("field_name", "value", F.coalesce("canon_id", F.lit(0)).alias("canon_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("lead", F.lit(0.0)).alias("lead"))


def map_fields(df: DataFrame, key: str, fields: list[str], canon: DataFrame, **how) -> DataFrame:
    """``(key, field_name, canon_id)`` for every row and field whose value is not blank and not, as stored, an entry of the
    field's list; canon_id 0 for unmatched values. Values are matched once however many rows hold them."""
    entries = {}
    for r in canon.where(F.col("field_name").isin(fields)).select("field_name", "canon_name").distinct().limit(10_001).collect():
        entries.setdefault(r.field_name, []).append(r.canon_name)
    if sum(map(len, entries.values())) > 10_000:  # a long list is joined instead
        entries = None
    parts = []
    for f in fields:
        rows = df.select(F.col(key).cast("long").alias(key), F.lit(f).alias("field_name"), F.col(f).alias("value")).where(~is_blank(F.col("value")))
        parts.append(rows.where(~F.col("value").isin(entries.get(f, []))) if entries is not None else rows)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    if entries is None:
        rows = rows.join(canon.select("field_name", F.col("canon_name").alias("value")).distinct(), ["field_name", "value"], "left_anti")
    rows = rows.withColumn("entry", F.concat_ws("\x1f", "field_name", "value"))
    counts = written(rows.groupBy("field_name", "value", "entry").agg(F.count("*").alias("n")))
    matched = match_values(counts.select("field_name", "value").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value"), canon, **how)
    table = written(counts.select("entry", "n", "field_name", "value").join(matched.select("field_name", "value", "canon_id"), ["field_name", "value"]).select("entry", "n", "canon_id"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return salted_join(rows.select(key, "field_name", "entry"), table, "entry", "n", total, key, "inner").select(key, "field_name", "canon_id")


def unmatched(df: DataFrame, fields: list[str], canon: DataFrame, **how) -> DataFrame:
    """``(field_name, value, n_rows)`` of values no entry was accepted for."""
    parts = [df.select(F.lit(f).alias("field_name"), F.col(f).alias("value")).where(~is_blank(F.col("value"))) for f in fields]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    counts = rows.groupBy("field_name", "value").agg(F.count("*").alias("n_rows"))
    counts = written(counts.join(canon.select("field_name", F.col("canon_name").alias("value")), ["field_name", "value"], "left_anti"))
    return counts.join(match_values(counts.select("field_name", "value"), canon, **how).where("canon_id = 0"), ["field_name", "value"]).select("field_name", "value", "n_rows")
