"""Garbled text from wrong character encoding (problem 2).

A hidden Markov model labels characters: one clean state, and one state for each pair of encodings a text can have gone
through. A pair's state emits the images of characters (one or more characters for each), and each labelled span gets the
pair's inverse. Emission costs are minus log probabilities up to scale: a garbled state pays for the character it restores
where it would stand, the clean state for the character as it stands, both by the same model of clean text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in at least this part of the texts are known words. With w words a text there are at most w / KNOWN_PART of them,
#: which is why they may be collected.
KNOWN_PART = 0.0005
#: Costs of entering a garbled state, of staying in it, and of leaving it.
ENTER, STAY, LEAVE = 5.0, 1.5, 0.5

# Pairs of encodings (what the bytes were, what they were read as, how many times over).
PAIRS = [
    ("utf-8", "cp1252", 1),
    ("utf-8", "latin-1", 1),
    ("utf-8", "mac_roman", 1),
    ("utf-8", "cp437", 1),
    ("utf-8", "cp850", 1),
    ("utf-8", "cp1251", 1),
    ("utf-8", "cp1252", 2),
    ("utf-8", "latin-1", 2),
    ("cp1252", "mac_roman", 1),
    ("mac_roman", "cp1252", 1),
    ("cp1252", "cp437", 1),
    ("cp1252", "cp1251", 1),
]
LOSSY = len(PAIRS)
MARKS = "“”‘’–—…«»"
SOURCES = [chr(c) for c in [*range(0xA0, 0x100), *range(0x100, 0x180)]] + [*MARKS, "€", "™", "•", "„", "‚", "†"]
#: How light cleaning changes images: curly quotes and dashes become ASCII, unusual spaces plain ones.
CLEANED = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\xa0": " ", "\x85": " ", "\x1c": " "})


def _decode(data: bytes, encoding: str) -> str:
    """As readers do: bytes that windows-1252 leaves open become the control characters of the same number."""
    if encoding != "cp1252":
        return data.decode(encoding)
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)


def _encode(text: str, encoding: str) -> bytes:
    if encoding != "cp1252":
        return text.encode(encoding)
    return b"".join(bytes([ord(c)]) if ord(c) in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else c.encode("cp1252") for c in text)


def garble(text: str, pair: tuple[str, str, int]) -> str:
    for _ in range(pair[2]):
        text = _decode(_encode(text, pair[0]), pair[1])
    return text


def _images() -> list[dict[str, tuple[str, float]]]:
    """For each pair, image -> (source, extra cost). Images that were cleaned or lost their case after the damage cost
    more; of several sources of one image the commoner one is kept."""
    out = []
    for pair in PAIRS:
        table: dict[str, tuple[str, float]] = {}
        for c in SOURCES:
            try:
                image = garble(c, pair)
            except UnicodeError:
                continue
            if image == c or image.isascii() or "�" in image or (pair[0] != "utf-8" and ord(c) == 0xA0):
                continue
            rare = 4.0 if 0x100 <= ord(c) < 0x180 else 0.0
            for form, extra in ((image, 0.0), (image.lower(), 1.0), (image.upper(), 1.0), (image.translate(CLEANED), 1.0), (image.lower().translate(CLEANED), 2.0)):
                if pair[0] != "utf-8" and form != image:
                    continue
                if form.isascii() or (len(form) == 1 and len(image) > 1):
                    continue
                extra += rare + (2.0 if form.endswith(" ") else 0.0)
                if form not in table or table[form][1] > extra:
                    table[form] = (c, extra)
        out.append(table)
    return out


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD_BEFORE, _WORD_AFTER = re.compile(f"[{_LETTERS}]+$"), re.compile(f"[{_LETTERS}]+")
_CONTRACTED = re.compile(r"(?:n't|'s|'re|'ve|'ll|'d)\b", re.I)


class Model:
    def __init__(self, known: set[str]):
        self.known = known
        self.images = _images()
        self.firsts = [frozenset(i[0] for i in t) for t in self.images]
        self.sizes = [sorted({len(i) for i in t}, reverse=True) for t in self.images]
        self.memory: dict[str, tuple[str, bool]] = {}

    def clean_cost(self, c: str, before: str, after: str) -> float:
        """What a character costs in clean text between the text before and after it."""
        if c.isascii():
            return 0.0
        o = ord(c)
        if c == "�":
            return 40.0
        if 0x80 <= o < 0xA0:
            return 25.0
        p, n = before[-1:], after[:1]
        inside = p.isalpha() or n.isalpha()
        within = p.isalpha() and n.isalpha()
        lead = p != "" and p in _ENDS
        if c in MARKS:
            return 2.0 + 7.0 * (within and c not in "’–—…") + 6.0 * (c in "«»" and lead)
        if c in "€£¥":
            return (2.0 if n.isdigit() else 5.0) + 7.0 * p.isalpha()
        if c in "\xa0\xad\u2009\u202f":
            return 3.0 + 7.0 * (lead or c == "\xad" and within)
        if 0xC0 <= o < 0x180 and c not in "×÷" and c not in "ıŒœſŸŠšŽž":
            cost = 3.0
            if c.isupper():
                left, right = p.islower(), n.islower()
                if left and n.isupper():
                    cost += 2.0
                elif left or (not p.isalpha() and not n.isalpha()):
                    cost += 9.0
                elif not p.isalpha() and right:
                    cost += 2.0 * (c in "ÃÂ")
                elif p.isupper() and right and len(before) > 1 and before[-2:-1].islower():
                    cost += 9.0
                elif p.isupper() and right:
                    cost += 6.0
            return cost + self.boundary(before, after) if c.islower() else cost
        if 0x370 <= o < 0x530:
            near = [x for x in (p, n) if x]
            return 3.0 if any(0x370 <= ord(x) < 0x530 for x in near) and not any(x.isascii() and x.isalpha() for x in near) else 14.0
        if c in "ŒœŸŠšŽž":
            return 12.0 if (c.isupper() and p.islower()) or c in "Œœ" or (p.isalpha() and not p.isascii()) else 5.0
        return 12.0 if inside or lead else 9.0

    def boundary(self, before: str, after: str) -> float:
        """What a small letter costs that stands where the words around it are whole without it."""
        left, right = _WORD_BEFORE.search(before), _WORD_AFTER.match(after)
        a, b = left.group() if left else "", right.group() if right else ""
        if not a and not b:
            return 8.0
        if _CONTRACTED.match((a[-1:] + "'" + b) if a[-1:].lower() == "n" else "'" + b) and b and len(b) <= 2 and (a.lower() + "'" + b.lower()) in self.known:
            return 10.0
        ka, kb = a.lower() in self.known and len(a) > 3, b.lower() in self.known and len(b) > 3
        if ka and kb:
            return 10.0
        if (ka and (not b or b[0].isupper() and a[-1:].islower())) or (kb and (not a or len(b) > 4)):
            return 8.0
        if b and b[0].isupper() and (not a or a[-1].islower()) and not before.endswith(tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) and kb:
            return 8.0
        return 0.0

    def label(self, s: str) -> list[tuple[int, int, int, str]]:
        """The most likely path over a text: (from, to, state, restored), state -1 clean."""
        n, states = len(s), len(PAIRS) + 2  # clean is the last one
        big = float("inf")
        clean = states - 1
        cost = [[big] * states for _ in range(n + 1)]
        back: list[list] = [[None] * states for _ in range(n + 1)]
        cost[0][clean] = 0.0
        for i in range(n):
            here, c = cost[i], s[i]
            low = min(here)
            if low == big:
                continue
            best = here.index(low)

            def relax(j: int, state: int, add: float, text: str, here=here, i=i, best=best) -> None:
                # from the same state, from the clean one, or from the cheapest other one
                for prev in {state, clean, best}:
                    if here[prev] == big:
                        continue
                    move = 0.0 if prev == state == clean else STAY if prev == state else LEAVE if state == clean else ENTER + (0.0 if prev == clean else LEAVE)
                    if (t := here[prev] + move + add) < cost[j][state]:
                        cost[j][state] = t
                        back[j][state] = (i, prev, text)

            relax(i + 1, clean, self.clean_cost(c, s[max(0, i - 40) : i], s[i + 1 : i + 41]), c)
            if c.isascii():
                continue
            if c == "�":
                relax(i + 1, LOSSY, 0.0, c)
            for k, table in enumerate(self.images):
                if c not in self.firsts[k]:
                    continue
                for size in self.sizes[k]:
                    hit = table.get(s[i : i + size]) if i + size <= n else None
                    if hit:
                        relax(i + size, k, self.clean_cost(hit[0], s[max(0, i - 40) : i], s[i + size : i + size + 40]) + hit[1], hit[0])
        path, j, state = [], n, min(range(states), key=lambda x: cost[n][x])
        while j > 0:
            i, prev, text = back[j][state]
            path.append((i, j, -1 if state == clean else state, text))
            j, state = i, prev
        return path[::-1]

    def piece(self, s: str) -> tuple[str, bool]:
        if s not in self.memory:
            if len(self.memory) > 300_000:
                self.memory.clear()
            path = self.label(s)
            self.memory[s] = ("".join(t for *_, t in path), any(k >= 0 for _, _, k, _ in path))
        return self.memory[s]

    def restore(self, text: str | None) -> tuple[str | None, bool]:
        """The text with every labelled span restored (what was lost stays as it is), and whether there was any.

        Only words with other than ASCII characters, with the word after each, are labelled: a garbled state emits no
        ASCII character but at an image's end, so the path is clean everywhere else."""
        if text is None or text.isascii():
            return text, False
        words = re.split(r"([ \n\t]+)", text)
        out, found, k = [], False, 0
        while k < len(words):
            if words[k].isascii():
                out.append(words[k])
                k += 1
                continue
            j = k + 1
            while j < len(words) and (not words[j].isascii() or words[j].isspace() and words[k : j + 2][-1] != words[j] and not words[j + 1].isascii()):
                j += 1
            tail = words[j : j + 2] if words[j - 1][-1:] in _ENDS else []
            restored, hit = self.piece("".join(words[k:j] + tail))
            out.append(restored)
            found |= hit
            k = j + len(tail)
        return "".join(out), found


#: Characters whose image may go on with a space.
_ENDS = frozenset("ÃãÂâ√├Г")


def known_words(df: DataFrame, text: str, part: float = KNOWN_PART) -> list[str]:
    """Words (contractions too) in at least ``part`` of the texts; see ``KNOWN_PART`` for their bound."""
    n = df.where(F.col(text).isNotNull()).count()
    words = df.select(F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace(text, "’", "'")), "[^\\p{L}']+"))).alias("w"))
    return sorted(r.w for r in words.groupBy("w").count().where(F.col("count") >= max(3.0, part * n)).select("w").collect() if r.w)


def find_garbled(df: DataFrame, key: str, fields: list[str], known: list[str] | None = None) -> DataFrame:
    """``(key, field_name, restored)``: each row and field whose stored value holds garbled characters, with the original
    text wherever it can be had; characters lost for good stay as U+FFFD. NULL, empty and plain ASCII values are no case,
    and do not reach Python."""
    if known is None:
        known = known_words(df, fields[0])
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(set(known))
        for b in batches:
            out = []
            for f in fields:
                for k, t in zip(b["k"], b[f], strict=True):
                    if t is not None:
                        restored, hit = model.restore(t)
                        if hit:
                            out.append((k, f, restored))
            yield pd.DataFrame(out, columns=["k", "field_name", "restored"]).astype({"k": b["k"].dtype})

    odd = [F.when(F.col(f).rlike("[^\\x00-\\x7F]"), F.col(f)).alias(f) for f in fields]
    rows = df.select(F.col(key).alias("k"), *odd)
    some = F.coalesce(*fields).isNotNull()
    return rows.where(some).mapInPandas(run, f"k {kind}, field_name string, restored string").withColumnRenamed("k", key)
