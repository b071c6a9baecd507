"""Evaluation texts leaking into training text (problem 8): a distributed positional inverted index.

The index has one row for each segment (a run of documents of one partition) with the postings of all its tokens: the
positions of every term. A search takes the evaluation items in blocks of bounded size and looks up, in every segment,
word runs of each item: their rarest term's postings, adjusted by its offset, intersected with the next rarest's and so
on. Any passage that counts holds one of an item's runs whole, so this finds them all; a chain of matches around each
hit then decides. All lists of a segment lie together, so intersections move no postings between executors.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.llm.lookalike import INVISIBLE, LIGATURES, SPACES, one_to_one
from statlathe.plans.shared import written

#: The least part of an item's words that a passage covers, and the most of the passage's words that may be changed.
COVER, CHANGED = 1 / 3, 0.1
#: Documents of one segment at most, and items searched for at once: the bounds of what a task and the driver hold.
SEGMENT_DOCS, ITEM_BLOCK = 10_000, 2_000
SCHEMA = "segment long, terms array<string>, starts binary, positions binary, doc_id binary, doc_start binary"


def _fold_table() -> dict[int, str]:
    table = dict(zip(map(ord, one_to_one()[0]), one_to_one()[1], strict=True))
    table |= {ord(k): v for k, v in LIGATURES.items()} | {ord(c): " " for c in SPACES}
    hidden = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), INVISIBLE))
    return table | {c: "" for c in (*range(0x10000), *range(0xE0000, 0xE0200)) if hidden.match(chr(c))}


_TABLE: dict[int, str] = {}
_WORD = re.compile(r"[^\W_]+")
_SETTLED = re.compile("[^\x00-\x7f\u00a1-\u00ac\u00ae-\u017e“”‘’–—…€]")


def tokens(text: str | None) -> list[str]:
    """Lower-case words with look-alike characters made plain; everything but letters and digits only separates."""
    if not text:
        return []
    if not text.isascii() and _SETTLED.search(text):
        if not _TABLE:
            _TABLE.update(_fold_table())
        text = unicodedata.normalize("NFC", text.translate(_TABLE))
    return _WORD.findall(text.lower())


def _segment(ids: list[int], words: list[list[str]], number: int) -> dict:
    import numpy as np

    codes, terms = pd.factorize(np.array([w for d in words for w in d] or [""], dtype=object))
    if not any(words):
        codes, terms = codes[:0], terms[:0]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    # one empty place after each document keeps runs from crossing into the next
    start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1].astype(np.int32)
    position = (np.arange(len(codes)) + np.repeat(np.arange(len(words)), lengths)).astype(np.int32)
    order = np.argsort(codes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms)))]).astype(np.int32)
    return {"segment": number, "terms": list(terms), "starts": starts.tobytes(), "positions": position[order].tobytes(), "doc_id": np.array(ids, dtype=np.int64).tobytes(), "doc_start": start.tobytes()}


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, n, ids, words, size = TaskContext.get().partitionId(), 0, [], [], 0
    for b in batches:
        for k, text in zip(b["k"], b["t"], strict=True):
            ids.append(k)
            words.append(tokens(text))
            size += len(words[-1])
            if len(ids) >= SEGMENT_DOCS or size >= 300 * SEGMENT_DOCS:
                yield pd.DataFrame([_segment(ids, words, (part << 32) + n)])
                n, ids, words, size = n + 1, [], [], 0
    if ids:
        yield pd.DataFrame([_segment(ids, words, (part << 32) + n)])


def build_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """The index of all documents, as a table in the shared folder. NULL and empty texts are in it, without words."""
    return written(df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(_build, SCHEMA))


def run_length(n: int) -> int:
    """The longest run such that every passage that counts, of an item of ``n`` words cut into such runs, holds one whole."""
    least = -(-n // 3)
    edits = int(least * CHANGED)
    for b in range(6, 1, -1):
        if (least - b + 1) // b >= edits + 1:
            return b
    return 1


class _Items:
    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items
        self.runs: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(items):
            b = run_length(len(w))
            for i in range(0, len(w) - b + 1, b):
                self.runs[tuple(w[i : i + b])].append((k, i))

    def hits(self, codes: dict[str, int], starts, positions, ids) -> dict[int, object]:
        """For each item (by its number here), rows of the place in the segment where it would begin and the place of the
        run of it that was found and that ``worth`` keeps. ``ids``: the term at each place."""
        import numpy as np

        out: dict[int, list] = defaultdict(list)
        own = np.zeros(len(codes) + 1, dtype=bool)  # the last one is for places without a term
        bags = {}
        for run, where in self.runs.items():
            terms = [codes.get(w) for w in run]
            if None in terms:
                continue
            lists = sorted(((positions[starts[t] : starts[t + 1]], j) for j, t in enumerate(terms)), key=lambda x: len(x[0]))
            at = intersected(lists)
            if len(at):
                for k, i in where:
                    if k not in bags:
                        bags[k] = np.array([codes[w] for w in set(self.items[k][1]) if w in codes], dtype=np.int64)
                    own[bags[k]] = True
                    kept = worth(len(self.items[k][1]), len(run), own, ids, at)
                    own[bags[k]] = False
                    if len(kept):
                        kept = in_order([codes.get(w, -2) for w in self.items[k][1]], len(run), ids, kept)
                    if len(kept):
                        places = kept.astype(np.int64)
                        out[k].append(np.stack([places - i, places], axis=1))
        return {k: np.unique(np.concatenate(v), axis=0) for k, v in out.items()}


def intersected(lists: list[tuple]):
    """The places where a phrase begins: ``lists`` has, from the rarest term on, the sorted positions of each of its terms
    and the term's offset in the phrase; each list, less its offset, is intersected with what is left so far."""
    import numpy as np

    at = lists[0][0] - lists[0][1]
    for places, offset in lists[1:]:
        if not len(at):
            break
        k = np.minimum(np.searchsorted(places, at + offset), len(places) - 1)
        at = at[places[k] == at + offset]
    return at


def worth(n: int, run: int, own, ids, at):
    """Which of the places ``at``, where a run of an item of ``n`` words was found, can lie in a passage that counts. A
    passage of the least length goes on by half of what is left of it before or after the run, with at most a tenth of it
    changed; so most words there are out of the item's (``own``, by term). A longer passage has such a part as well."""
    import numpy as np

    least = -(-n // 3)
    edits = int(least * CHANGED) + 1
    side = (least - edits - run + 1) // 2
    if side <= edits:
        return at
    keep = np.zeros(len(at), dtype=bool)
    for offsets in (np.arange(-side, 0), np.arange(run, run + side)):
        places = np.clip(at[:, None] + offsets, 0, len(ids) - 1)
        keep |= own[ids[places]].sum(axis=1) >= side - edits
    return at[keep]


def in_order(item: list[int], run: int, ids, at):
    """As ``worth``, by neighbours: some stretch of nearly the least length around the run has most of its word pairs out
    of the item's (each change breaks at most two)."""
    import numpy as np

    least = -(-len(item) // 3)
    edits = int(least * CHANGED) + 1
    width = least - edits - 1
    if width <= run + 2 * edits:
        return at
    a = np.array(item, dtype=np.int64)
    pairs = np.unique((a[:-1] << 32) + a[1:])
    keep = np.zeros(len(at), dtype=bool)
    offsets = np.arange(run - width - 1, width)
    for k in range(0, len(at), 8192):
        places = np.clip(at[k : k + 8192, None] + offsets, 0, len(ids) - 1)
        found = ids[places].astype(np.int64)
        found = (found[:, :-1] << 32) + found[:, 1:]
        hit = pairs[np.clip(np.searchsorted(pairs, found), 0, len(pairs) - 1)] == found
        total = np.concatenate([np.zeros((len(hit), 1), np.int32), np.cumsum(hit, axis=1, dtype=np.int32)], axis=1)
        keep[k : k + 8192] = (total[:, width - 1 :] - total[:, : 1 - width]).max(axis=1) >= width - 1 - 2 * edits
    return at[keep]


def passage(item: list[int], doc: list[int], shift: int) -> tuple[int, int, int] | None:
    """The best passage of ``item`` in ``doc`` near the diagonal ``shift`` (place in the document less place in the
    item): words covered, and the first and last place in the document; None when none counts.

    Runs of equal words on nearby diagonals are chained in order; words between two runs of a chain are changes. A
    stretch of the chain counts when its changes stay within ``CHANGED`` of its words and it covers ``COVER`` of the item
    (a change at its very end, which can't be seen, is allowed for within the same limit)."""
    n, m = len(item), len(doc)
    slack = max(1, -(-n // 10))
    runs = []
    for d in range(shift - slack, shift + slack + 1):
        i, end = max(0, -d), min(n, m - d)
        while i < end:
            if item[i] == doc[i + d] and item[i] >= 0:
                j = i + 1
                while j < end and item[j] == doc[j + d]:
                    j += 1
                if j - i >= 2 or d == shift:
                    runs.append((i, j, d))
                i = j
            else:
                i += 1
    if not runs:
        return None
    runs.sort()
    score, back = [], []
    for x, (i, j, d) in enumerate(runs):
        # where nothing before is worth its gap, the score starts anew, but the link back stays: a longer stretch with a
        # worse score may count as well
        best, prev, most = j - i, -1, None
        for y in range(x):
            a, b, e = runs[y]
            # runs on other diagonals may overlap; then the later one begins where the earlier ends
            cut = max(0, b - i, b + e - (i + d))
            if j - i - cut < 1 or a > i:
                continue
            gap = max(i + cut - b, i + cut + d - (b + e))
            got = score[y] + (j - i - cut) - 9 * gap
            if most is None or got > most:
                most, prev = got, y
        score.append(best if most is None else max(best, most))
        back.append(prev)
    found = None
    for x in range(len(runs)):
        chain = [x]
        while back[chain[-1]] >= 0:
            chain.append(back[chain[-1]])
        edits, k = 0, 0
        last = runs[x][1]
        for k, y in enumerate(chain):
            if k:
                a, b, e = runs[y]
                i, _, d = runs[chain[k - 1]]
                cut = max(0, b - i, b + e - (i + d))
                edits += max(i + cut - b, i + cut + d - (b + e))
            covered = last - runs[y][0]
            spare = int(covered * CHANGED + 1e-9) - edits
            if spare >= 0 and covered + spare >= n * COVER and (found is None or covered > found[0]):
                found = (covered, runs[y][0] + runs[y][2], last + runs[x][2] - 1)
    return found


def _search(items: list[tuple[int, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        known = _Items([(k, tokens(t)) for k, t in items])
        for b in batches:
            out = []
            for s in b.itertuples():
                codes = {w: i for i, w in enumerate(s.terms)}
                starts, positions = np.frombuffer(s.starts, np.int32), np.frombuffer(s.positions, np.int32)
                doc_id, doc_start = np.frombuffer(s.doc_id, np.int64), np.frombuffer(s.doc_start, np.int32)
                ids = np.full((int(positions.max()) + 2 if len(positions) else 1), -1, dtype=np.int32)
                ids[positions] = np.repeat(np.arange(len(s.terms), dtype=np.int32), np.diff(starts))
                for k, found in known.hits(codes, starts, positions, ids).items():
                    item_id, w = known.items[k]
                    coded = [codes.get(x, -2) for x in w]
                    best: dict[int, tuple[int, int, int]] = {}
                    tried = set()
                    # documents without words begin where the next one does, or hold the empty place before it; a run's
                    # place is a word's, so the last document that begins there or before is the one that holds it
                    docs = np.searchsorted(doc_start, found[:, 1], side="right") - 1
                    for (shift, place), e in zip(found.tolist(), docs.tolist(), strict=True):
                        if (shift, e) in tried:
                            continue
                        tried.add((shift, e))
                        begin = int(doc_start[e])
                        end = int(doc_start[e + 1]) - 1 if e + 1 < len(doc_start) else len(ids)
                        lo, hi = max(begin, shift - 20), min(end, shift + len(w) + 20)
                        if hi - lo < len(w) * COVER * 0.9:
                            continue
                        if e in best and best[e][1] <= place - begin <= best[e][2]:
                            continue
                        got = passage(coded, ids[lo:hi].tolist(), shift - lo)
                        if got and (e not in best or got[0] > best[e][0]):
                            best[e] = (got[0], got[1] + lo - begin, got[2] + lo - begin)
                    out.extend((int(doc_id[e]), item_id, v[0] / len(w), v[1], v[2]) for e, v in best.items())
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "covered", "first_word", "last_word"]).astype({"doc_id": "int64", "item_id": "int64", "covered": "float64", "first_word": "int32", "last_word": "int32"})

    return run


def search(index: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, item_id, covered, first_word, last_word)``: every document with a passage of an item, the part of the
    item's words it covers and where it stands. Items are taken in blocks of about ``ITEM_BLOCK``, all documents against
    each; the driver holds one block at a time, and its result is a table in the shared folder. Items without words find
    nothing."""
    schema = "doc_id long, item_id long, covered double, first_word int, last_word int"
    rows = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null")
    parts = -(-rows.count() // ITEM_BLOCK)
    found = None
    for p in range(parts):
        block = [(r.k, r.t) for r in rows.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == p).collect()]
        one = index.mapInPandas(_search(block), schema)
        one = written(one) if parts > 1 else one
        found = one if found is None else found.union(one)
    return found if found is not None else index.sparkSession.createDataFrame([], schema)
