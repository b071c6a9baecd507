"""Same or near-same records across splits (problem 5).

Exact overlaps: hashes of the canonicalised records, evaluation side joined to training side. Near overlaps: of any d + 1
disjoint word runs of a text, one at least stands whole in every text that is at most d word edits away. So each training
class chooses one run more than any partner allows edits, and looks them up among all the runs of the evaluation classes.
Runs are chosen where they are rare; every choice of disjoint runs is complete, so rarity, which is estimated, only affects
speed. A 64-bit sketch of each text's words travels along: an edit takes at most one word away, so pairs whose sketches
differ by more than the edits allowed are dropped in the join itself; the rest are confirmed on the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import digest, is_blank, norm_key
from statlathe.plans.shared import salted_join, scratch, written

#: At most one word in PART of the longer text may differ.
PART = 6
#: Words and word pairs in at least this part of the texts have their frequency looked up when runs are chosen. A text of
#: w words has fewer than w pairs, so at most (mean words) / COMMON_PART pairs qualify; that bound lets them travel whole,
#: as hashes. All texts are counted.
COMMON_PART = 0.0005
#: A run counts as rare when the expected number of texts that hold it is at most this; texts without enough rare runs
#: try the next level, and those without enough of these are cut into equal blocks. The more texts there are, the later the
#: level that most find theirs at; equal blocks, chosen blindly, hold phrases that a large part of all texts has.
RARE = (6.0, 60.0, 400.0, 2_000.0, 10_000.0, 50_000.0)
#: Bits of the filter that spares the runs nobody asks for: four for each that is asked for, within these bounds. A full one
#: lets more through, which the join then drops.
FILTER_BITS = (1 << 20, 1 << 28)
#: The filter is made in so many parts, by key.
FILTER_PARTS = 16
#: The longest run that is tried to become rare.
LONGEST = 8


def words_of(text: str) -> list[str]:
    """Lower-case words, cut at everything that is no letter or digit."""
    return re.findall(r"[^\W_]+", text.lower())


def allowed(longer: int) -> int:
    return longer // PART


def longest_partner(n: int) -> int:
    """The most words of a text that at most a sixth of its words separate from one of ``n``."""
    m = n * PART // (PART - 1)
    while m + 1 - n <= allowed(m + 1):
        m += 1
    return m


def _mixed(h, salt: int = 0):
    """64-bit values whose bits all depend on all of ``h``'s."""
    import numpy as np

    h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of a batch of texts, one after the other: ``h``, each one's hash; text k has those from ``at[k]`` to
    ``at[k + 1]``. The hash of any run of words takes one step."""

    BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, texts: pa.Array):
        import numpy as np
        import pyarrow.compute as pc
        import xxhash

        lists = pc.split_pattern(texts, " ")
        self.at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(self.at[0], self.at[-1] - self.at[0]).dictionary_encode()
        self.at -= self.at[0]
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], dtype=np.uint64)
        self.h = known[coded.indices.to_numpy()]
        self.n = np.diff(self.at)
        self.end = np.repeat(self.at[1:], self.n)
        size = len(self.h)
        powers = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]), dtype=np.uint64)
        self.power = powers(self.BASE)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * powers(self.INVERSE)[:size], dtype=np.uint64)])

    def runs(self, start, end, salt: int = 0):
        """Hashes of the runs from ``start`` to ``end``; equal words give equal hashes wherever they stand."""
        return _mixed((self.total[end] - self.total[start]) * self.power[end - 1], salt)

    def pairs(self):
        """The first place of each pair of neighbours within a text."""
        import numpy as np

        return np.flatnonzero(np.arange(1, len(self.h) + 1) < self.end)

    def sketch(self):
        """Of each text, a bit for each word, by its hash. No text is without words."""
        import numpy as np

        return np.bitwise_or.reduceat(np.uint64(1) << (self.h & np.uint64(63)), self.at[:-1]).view(np.int64)


class Runs:
    """Chooses runs of words. ``common``: sorted hashes of common words and of common pairs, each with the share of the
    texts that hold it; ``n``: number of texts."""

    def __init__(self, common, n: int):
        self.common = common
        self.floor = COMMON_PART / 2
        self.rare = [r / max(n, 1) for r in RARE]

    def _share(self, which: int, h):
        import numpy as np

        keys, shares = self.common[which]
        if not len(keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, shares[at], 0.0)

    def shares(self, w: Words):
        """The share of texts that hold the pair of neighbours that begins at each place (infinite where a text ends), and
        by how much a further word lessens it."""
        import numpy as np

        size = len(w.h)
        one = self._share(0, _mixed(w.h))
        one[one == 0] = self.floor
        two, step, first = np.full(size, np.inf), np.ones(size), w.pairs()
        known = self._share(1, w.runs(first, first + 2))
        two[first] = np.where(known > 0, known, np.minimum(self.floor, 4 * one[first] * one[first + 1]))
        step[first] = np.minimum(1.0, two[first] / one[first])
        return two, step

    def rare_runs(self, w: Words, level: int, shares):
        """``(start, end)`` of the shortest run that starts at each place and is rare; a function of its own words alone."""
        import numpy as np

        two, step = shares
        p, end, place = two.copy(), np.arange(2, len(w.h) + 2), np.arange(len(w.h))
        for size in range(3, LONGEST + 1):
            more = np.flatnonzero((p > self.rare[level]) & (place + size <= w.end))
            p[more] *= step[more + size - 2]
            end[more] = more + size
        start = np.flatnonzero(p <= self.rare[level])
        return start, end[start]

    def chosen(self, w: Words):
        """``(text, level, key)``: for each text disjoint runs, one more than the edits any partner allows; blocks of q
        words are level 10 + q. A text none of whose partners allows an edit has none: only its equals match it."""
        import numpy as np

        sizes, where = np.unique(w.n, return_inverse=True)
        need = np.array([allowed(longest_partner(int(k))) + 1 for k in sizes], dtype=np.int64)[where]
        shares = self.shares(w)
        open_, out = np.flatnonzero(need > 1), []
        for level in range(len(self.rare)):
            if not len(open_):
                break
            start, end = self.rare_runs(w, level, shares)
            # the run that ends first of those that start at a place or after it; the shorter one of equals
            best = np.full(len(w.h) + 1, np.iinfo(np.int64).max)
            best[start] = end * 64 + (end - start)
            best = np.minimum.accumulate(best[::-1])[::-1]
            place, got = w.at[open_], []
            alive = np.ones(len(open_), dtype=bool)
            for k in range(int(need[open_].max())):
                e = best[place] >> 6
                alive &= (e <= w.at[open_ + 1]) | (k >= need[open_])
                took = alive & (k < need[open_])
                got.append((open_[took], e[took] - (best[place][took] & 63), e[took]))
                place = np.where(took, e, place)
            done = np.zeros(len(w.n), dtype=bool)
            done[open_[alive]] = True
            for text, a, b in got:
                keep = done[text]
                out.append((text[keep], np.full(keep.sum(), level), w.runs(a[keep], b[keep], level)))
            open_ = open_[~alive]
        if len(open_):
            count = np.minimum(need[open_], w.n[open_])
            q = np.repeat(np.maximum(1, w.n[open_] // need[open_]), count)
            text = np.repeat(open_, count)
            a = w.at[text] + q * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
            for x in np.unique(q):
                k = q == x
                out.append((text[k], np.full(k.sum(), 10 + x), w.runs(a[k], a[k] + x, 10 + int(x))))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        if not len(b):
            continue
        w = Words(b["words"])
        first = w.pairs()
        for kind, h in ((0, _mixed(w.h)), (1, w.runs(first, first + 2))):
            keys, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])


def _common(classes: DataFrame):
    """For words and for pairs, sorted hashes of the common ones and the shares of texts that hold them (see COMMON_PART
    for the bound); and the number of texts."""
    import numpy as np

    n = classes.count()
    counted = classes.select("words").mapInArrow(_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    got = counted.where(F.col("n") >= max(2.0, COMMON_PART * n)).toPandas()
    out = []
    for kind in (0, 1):
        mine = got[got["kind"] == kind]
        keys, share = mine["key"].to_numpy().view(np.uint64), np.minimum(1.0, mine["n"].to_numpy() / max(n, 1))
        order = np.argsort(keys)
        out.append((keys[order], share[order]))
    return out, n


def _once(text, key):
    """Without repeats of a key within a text."""
    import numpy as np

    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return order[new]


_KEYS = "class_id long, n int, sketch long, level int, key long"


def _rows(b: pa.RecordBatch, w: Words, text, level, key) -> pa.RecordBatch:
    import numpy as np

    columns = [b["class_id"].to_numpy()[text], w.n[text].astype(np.int32), w.sketch()[text], level.astype(np.int32), key.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["class_id", "n", "sketch", "level", "key"])


def _emit_asked(common, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(common, n)
        for b in batches:
            if len(b):
                w = Words(b["words"])
                text, level, key = runs.chosen(w)
                k = _once(text, key)
                yield _rows(b, w, text[k], level[k], key[k])

    return run


def _emit_given(common, n: int, levels: list[tuple[int, int, int]], wanted: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        runs, bits = Runs(common, n), np.frombuffer(wanted, dtype=np.uint8)
        for b in batches:
            if not len(b):
                continue
            w = Words(b["words"])
            shares = runs.shares(w)
            of = np.repeat(np.arange(len(w.n)), w.n)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for x, low, high in levels:
                # only texts near enough in length to one that asks at this level
                near = (np.maximum(low, w.n) // PART >= low - w.n) & (w.n // PART >= w.n - high)
                if not near.any():
                    continue
                if x < 10:
                    start, end = runs.rare_runs(w, x, shares)
                else:
                    start = np.flatnonzero(np.arange(x - 10, len(w.h) + x - 10) <= w.end)
                    end = start + (x - 10)
                mine = near[of[start]]
                text, key = of[start[mine]], w.runs(start[mine], end[mine], x)
                at = (key & np.uint64(8 * len(bits) - 1)).astype(np.int64)
                asked = (bits[at >> 3] >> (at & 7)) & 1 > 0
                found.append((text[asked], key[asked]))
            text, key = (np.concatenate(c) for c in zip(*found, strict=True))
            k = _once(text, key)
            yield _rows(b, w, text[k], np.zeros(len(k)), key[k])

    return run


def _filter_bits(size: int):
    """``(part, bits)`` of a filter of ``size`` bits; all keys of a part come to one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        parts: dict[int, object] = {}
        width = size // FILTER_PARTS
        for b in batches:
            at = b["key"].to_numpy().view(np.uint64) & np.uint64(size - 1)
            for part in np.unique(at // np.uint64(width)).tolist():
                mine = (at[at // np.uint64(width) == part] % np.uint64(width)).astype(np.int64)
                bits = parts.setdefault(part, np.zeros(width >> 3, dtype=np.uint8))
                np.bitwise_or.at(bits, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        yield pd.DataFrame({"part": list(parts), "bits": [x.tobytes() for x in parts.values()]}).astype({"part": "int32"})

    return run


def _filter(asked: DataFrame, n: int) -> bytes:
    """The filter of ``asked``'s ``n`` keys: a bit for the low bits of each."""
    size = min(max(FILTER_BITS[0], 1 << (4 * n).bit_length()), FILTER_BITS[1])
    part = F.floor(F.pmod("key", F.lit(size)) / (size // FILTER_PARTS))
    got = asked.select("key").repartition(FILTER_PARTS, part).mapInPandas(_filter_bits(size), "part int, bits binary").collect()
    parts = {r.part: bytes(r.bits) for r in got}
    return b"".join(parts.get(k) or bytes(size // FILTER_PARTS >> 3) for k in range(FILTER_PARTS))


def _words_distance(a: list[str], b: list[str], most: int) -> bool:
    """Whether the word edit distance is at most ``most``. For each number of edits, how far each diagonal can be followed;
    so texts that differ little take about as long as reading them, however long they are."""
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > most:
        return False
    reach: dict[int, int] = {}
    for e in range(most + 1):
        after = {}
        left = most - e  # diagonals that can still be left for the goal's
        for k in range(max(-e, goal - left), min(e, goal + left) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1) if e else 0
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            after[k] = i
        if after.get(goal, -1) >= n:
            return True
        reach = after
    return False


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = []
        for x, y in zip(b["words_a"], b["words_b"], strict=True):
            p, q = x.split(" "), y.split(" ")
            keep.append(_words_distance(p, q, allowed(max(len(p), len(q)))))
        yield b.loc[keep, ["train_class", "eval_class"]]


def text_classes(df: DataFrame, row_id: str, text: str, split: str, train: str = "train", held: tuple[str, ...] = ("val", "test")) -> tuple[DataFrame, DataFrame]:
    """``members(r, s, d, cut)``, a row's id, split, and the digests of its letters and digits and of its words; and the
    classes of texts with the same words, ``(d, cut, class_id, in_train, in_eval, n_rows, text)``, named by their least row id.
    Rows of other splits or none, and texts without a letter or digit, are left out."""
    rows = df.where(F.col(split).isin(train, *held)).select(F.col(row_id).cast("long").alias("r"), F.col(split).alias("s"), F.col(text).alias("text"))
    words = norm_key(F.col("text"))
    # words may be cut differently in texts with the same letters, so each cut is a class of its own
    flat = F.translate("w", "ς ", "σ")
    members = rows.where(~is_blank(F.col("text"))).select("r", "s", words.alias("w")).where(flat != "")
    members = written(members.select("r", "s", digest(flat).alias("d"), digest(F.col("w")).alias("cut")))
    is_train = F.col("s") == train
    cuts = members.groupBy("d", "cut").agg(F.min("r").alias("class_id"), F.max(is_train).alias("in_train"), F.max(~is_train).alias("in_eval"), F.count("*").alias("n_rows"))
    return members, cuts.join(rows.select(F.col("r").alias("class_id"), "text"), "class_id")


def near_classes(classes: DataFrame) -> DataFrame:
    """``(train_class, eval_class)``: all pairs of different classes, one in training and one in evaluation, whose words
    turn into each other by at most one sixth of the longer one's. ``classes``: class_id, in_train, in_eval, text."""
    plain = written(classes.select("class_id", "in_train", "in_eval", norm_key(F.col("text")).alias("words")).where("words != ''"))
    common, n = _common(plain)
    asked = written(plain.where("in_train").select("class_id", "words").mapInArrow(_emit_asked(common, n), _KEYS))
    levels = [tuple(r) for r in asked.groupBy("level").agg(F.min("n"), F.max("n")).orderBy("level").collect()]
    emit = _emit_given(common, n, levels, _filter(asked, asked.count()))
    given = plain.where("in_eval").select("class_id", "words").mapInArrow(emit, _KEYS).drop("level")
    # a text makes many keys, which the planner can't know; so neither side is broadcast
    a, g = asked.drop("level").alias("a").hint("merge"), given.alias("g")
    most = F.floor(F.greatest("a.n", "g.n") / PART)
    lost = lambda x, y: F.bit_count(F.col(f"{x}.sketch").bitwiseAND(F.bitwise_not(F.col(f"{y}.sketch"))))
    close = (F.abs(F.col("a.n") - F.col("g.n")) <= most) & (lost("a", "g") <= most) & (lost("g", "a") <= most) & (F.col("a.class_id") != F.col("g.class_id"))
    cands = a.join(g, (F.col("a.key") == F.col("g.key")) & close).select(F.col("a.class_id").alias("train_class"), F.col("g.class_id").alias("eval_class")).distinct()
    left = plain.where("in_train").select(F.col("class_id").alias("train_class"), F.col("words").alias("words_a"))
    right = plain.where("in_eval").select(F.col("class_id").alias("eval_class"), F.col("words").alias("words_b"))
    return cands.join(left, "train_class").join(right, "eval_class").mapInPandas(_confirm, "train_class long, eval_class long")


def cross_split_links(df: DataFrame, row_id: str, text: str, split: str) -> tuple[DataFrame, DataFrame]:
    """``members(row_id, split, class_id)`` and ``links(train_class, eval_class)``, a class being the texts with the same
    words. Links hold every pair of classes that have the same letters and digits or are near, a class's own pair too
    (when it lies on both sides). Copies are not expanded, so a group of any size costs its rows once."""
    with scratch() as keep:
        members, cuts = text_classes(df, row_id, text, split)
        cuts = written(cuts)
        near = near_classes(cuts.select("class_id", "in_train", "in_eval", "text"))
        train, held = (cuts.where(x).select("d", F.col("class_id").alias(y)) for x, y in (("in_train", "train_class"), ("in_eval", "eval_class")))
        same = train.join(held, "d").select("train_class", "eval_class")
        links = keep(written(near.union(same).distinct()))
        # equal cuts have equal letters and digits; a class may hold any part of the rows
        named = salted_join(members.select("r", "s", "cut"), cuts.select("cut", "class_id", "n_rows"), "cut", "n_rows", members.count(), "r", "inner")
        return keep(written(named.select(F.col("r").alias("row_id"), F.col("s").alias("split"), "class_id"))), links


def cross_split_pairs(df: DataFrame, row_id: str, text: str, split: str) -> DataFrame:
    """``(row_id_a, row_id_b)``, smaller first: every pair of a train row and a val or test row that is linked."""
    members, links = cross_split_links(df, row_id, text, split)
    t = members.where("split = 'train'").select(F.col("row_id").alias("t"), F.col("class_id").alias("train_class"))
    e = members.where("split != 'train'").select(F.col("row_id").alias("e"), F.col("class_id").alias("eval_class"))
    pairs = links.join(t, "train_class").join(e, "eval_class")
    return pairs.select(F.least("t", "e").alias("row_id_a"), F.greatest("t", "e").alias("row_id_b"))


def overlap_report(df: DataFrame, row_id: str, text: str, split: str, source: str) -> DataFrame:
    """Evaluation rows by split and source: how many there are, how many have a match in training, and how many pairs.
    Pairs are counted from class sizes, never expanded."""
    members, links = cross_split_links(df, row_id, text, split)
    n_train = members.where("split = 'train'").groupBy(F.col("class_id").alias("train_class")).agg(F.count("*").alias("n"))
    matches = links.join(n_train, "train_class").groupBy(F.col("eval_class").alias("class_id")).agg(F.sum("n").alias("n_pairs"))
    held = members.where("split != 'train'").join(df.select(F.col(row_id).cast("long").alias("row_id"), F.col(source).alias("source")), "row_id")
    by = held.groupBy("class_id", "split", "source").agg(F.count("*").alias("n")).join(matches, "class_id", "left")
    hit = F.when(F.col("n_pairs").isNotNull(), F.col("n")).otherwise(0)
    return by.groupBy("split", "source").agg(F.sum("n").alias("n_rows"), F.sum(hit).alias("n_matched"), F.sum(F.coalesce("n_pairs", F.lit(0)) * F.col("n")).alias("n_pairs"))
