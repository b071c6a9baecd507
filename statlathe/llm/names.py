"""Variant spellings of names typed by people (problem 3).

Names are read as tokens. Tokens are compared by MinHash bands over padded q-grams, with as many bands as the collision
curve asks for, and by deletion keys. Names are candidates when they share an equal or similar token and what is left of
both can agree as well: of people the other name (equal, of one full name, similar, or an initial), of organisations the
initials of the other words. So no token makes candidates by itself, however common it is, and the rule is the same at
every size. Candidates are verified by the Monge-Elkan similarity, whose token measure knows typos, initials, short forms
and nicknames; star clustering then gives every spelling to one fullest, most used spelling.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import is_blank
from statlathe.llm.canon import fold, one_slip, short_for, slip_keys
from statlathe.plans.shared import drop_written, scratch, written

GRAM = 3
#: Rows of a band, the Jaccard similarity of q-grams at which a token pair must be found, and how surely.
BAND_ROWS, AT, RECALL = 3, 0.42, 0.97
#: The least Monge-Elkan similarity of two spellings of a person's name, and of an organisation's.
PERSON, ORGANISATION = 0.9, 0.866
#: How similar tokens are: of one full name, with one slip, a short form, two slips (long tokens only), an initial.
NICK, SLIP, SHORT, SLIPS, INITIAL = 0.97, 0.94, 0.92, 0.85, 0.84
MAX_ROUNDS = 30

# Forms of address, generation marks, words of no weight, and short names with the full ones.
TITLES = frozenset("dr hon sen gov mr ms mrs rep prof judge mayor senator governor rev sir".split())
MARKS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "2nd": "ii", "iii": "iii", "3rd": "iii", "iv": "iv"}
EMPTY = frozenset("the of and for".split())
NICKNAMES = {
    "abby": "abigail", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "bernie": "bernard", "bill": "william",
    "bob": "robert", "chuck": "charles", "cindy": "lucinda", "connie": "constance", "debbie": "deborah", "dick": "richard",
    "dot": "dorothea", "doug": "douglas", "etta": "henrietta", "flo": "florence", "frank": "franklin", "fred": "frederick",
    "gabe": "gabriel", "greg": "gregory", "gus": "augustus", "hal": "harold", "iggy": "ignatius", "jerry": "gerald",
    "jim": "james", "jo": "josephine", "jon": "jonathan", "kate": "katherine", "ken": "kenneth", "larry": "lawrence",
    "len": "leonard", "liz": "elizabeth", "livvy": "olivia", "lyss": "ulysses", "maddie": "madeline", "matt": "matthew",
    "monty": "montgomery", "nate": "nathaniel", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "oz": "oswald",
    "peggy": "margaret", "penny": "penelope", "pip": "philip", "ray": "raymond", "roz": "rosalind", "sam": "samuel",
    "sandy": "alexander", "steve": "stephen", "sue": "susannah", "ted": "theodore", "tim": "timothy", "tina": "christina",
    "tony": "anthony", "trish": "patricia", "vicky": "victoria", "vince": "vincent", "walt": "walter", "zach": "zachary",
}


def bands(at: float = AT, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """The number of bands at which 1 - (1 - at ** rows) ** bands, the collision curve, reaches ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - at**rows))


def read_name(name: str) -> tuple[list[str], str]:
    """A name's tokens, a person's family name last, and its generation mark. Given names come first where a comma turned
    them round; initials and short forms that stand last are taken for given names. Forms of address and empty words are
    left out; initials joined by full stops are single letters."""
    s = fold(name).replace("ø", "o").replace("'", "").replace("/", " ")
    s = re.sub(r"\b(mr|ms|mrs|dr)\b\.?", " ", s)
    if "," in s:
        last, _, first = s.partition(",")
        s = f"{first} {last}"
    found = [(m.group(1), bool(m.group(2))) for m in re.finditer(r"([^\W_]+)(\.?)", re.sub(r"(?<=\b\w)\.", " ", s))]
    mark = next((MARKS[w] for w, _ in found if w in MARKS), "")
    left = [(w, cut) for w, cut in found if w not in MARKS and w not in EMPTY]
    left = [x for x in left if x[0] not in TITLES] or left
    n = len(left)
    while n and (len(left[n - 1][0]) == 1 or left[n - 1][1] and len(left[n - 1][0]) <= 4):
        n -= 1
    return [w for w, _ in (left[n:] + left[:n] if n else left)] or [s.strip()], mark


def full_name(token: str) -> str:
    return NICKNAMES.get(token, token)


def slip_similarity(a: str, b: str) -> float:
    """Of tokens that are equal or differ by a slip (two where both are long), or 0."""
    if a == b:
        return 1.0
    if len(a) > 3 and len(b) > 3 and one_slip(a, b, 1):
        return SLIP
    return SLIPS if len(a) > 6 and len(b) > 6 and one_slip(a, b, 2) else 0.0


@lru_cache(200_000)
def token_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    p, q = full_name(a), full_name(b)
    if p == q:
        return NICK
    if len(a) == 1 or len(b) == 1:
        return INITIAL if p[0] == q[0] or a[0] == b[0] else 0.0
    slip = slip_similarity(p, q)
    short = SHORT if (len(a) >= 3 or len(b) >= 3) and (short_for(a, b) or short_for(b, a)) and min(len(a), len(b)) <= 5 else 0.0
    return max(slip, short)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The mean, over the tokens of one name, of each one's best match in the other; of both directions the smaller."""
    mean = lambda x, y: sum(max(token_similarity(v, w) for w in y) for v in x) / len(x)
    return min(mean(a, b), mean(b, a))


def is_person(tokens: list[str]) -> bool:
    """Whether tokens may be a person's name: a family name, and a given one or two, of which one is an initial."""
    return 2 <= len(tokens) <= 3 and sum(len(w) > 1 for w in tokens) <= 2


def first_letters(token: str) -> set[str]:
    return {token[0], full_name(token)[0]}


def initials(tokens: list[str]) -> set[str]:
    """The sorted first letters of tokens, as typed and of the full names."""
    return {"".join(sorted(w[0] for w in tokens)), "".join(sorted(full_name(w)[0] for w in tokens))}


def same_name(x: tuple[list[str], str], y: tuple[list[str], str]) -> float:
    """The Monge-Elkan similarity of two read names, or 0 when it is below ``PERSON`` or ``ORGANISATION`` or something
    speaks against it: other generation marks; of people, family names that agree only as an initial or short form would
    (unless given and family name are turned round), given names that don't agree, or slips in both with other first
    letters; of organisations, a word without a match, or no equal or similar word beside which the initials of the
    others agree. A person's middle initial doesn't count where the other spelling has none."""
    (a, ma), (b, mb) = x, y
    if ma != mb or (len(a) == 1) != (len(b) == 1):
        return 0.0
    if is_person(a) and is_person(b):
        if len(a) != len(b):
            a, b = [a[0], a[-1]], [b[0], b[-1]]
        family = slip_similarity(a[-1], b[-1])
        if family:
            if not token_similarity(a[0], b[0]) or (family < 1 and not first_letters(a[0]) & first_letters(b[0])):
                return 0.0
        elif not all(slip_similarity(full_name(v), full_name(w)) for v, w in ((a[-1], b[0]), (a[0], b[-1]))):
            return 0.0
        least = PERSON
    else:
        if len(a) != len(b) or (len(a) == 1 and not slip_similarity(a[0], b[0])):
            return 0.0
        least = ORGANISATION if len(a) > 1 else PERSON
        if any(not any(token_similarity(v, w) for w in q) for p, q in ((a, b), (b, a)) for v in p):
            return 0.0
        rest = lambda t, i: initials(t[:i] + t[i + 1 :])
        if not any(len(v) > 1 and slip_similarity(v, w) and rest(a, i) & rest(b, j) for i, v in enumerate(a) for j, w in enumerate(b)):
            return 0.0
    score = monge_elkan(a, b)
    return score if score >= least else 0.0


def _grams(token: str) -> set[str]:
    s = "^" * (GRAM - 1) + token + "$" * (GRAM - 1)
    return {s[i : i + GRAM] for i in range(len(s) - GRAM + 1)}


def _band_keys(n_bands: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        rng = np.random.default_rng(7)
        size = n_bands * BAND_ROWS
        salt = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        odd = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            token, key = [], []
            for t in b["token"]:
                h = np.array([xxhash.xxh3_64_intdigest(g) for g in _grams(t)], dtype=np.uint64)
                mixed = (h[:, None] ^ salt) * odd  # wraps around, as wanted
                mixed = (mixed ^ (mixed >> np.uint64(29))) * odd
                least = (mixed ^ (mixed >> np.uint64(32))).min(axis=0).reshape(n_bands, BAND_ROWS)
                slips = slip_keys(t)
                token.extend([t] * (n_bands + len(slips)))
                key.extend(xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least))
                key.extend(xxhash.xxh64_intdigest(w, n_bands) - (1 << 63) for w in slips)
            yield pd.DataFrame({"token": token, "key": key}).astype({"key": "int64"})

    return run


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """``(token, other)``: pairs of different ``tokens`` (distinct) that share a band or a slip key and differ by one slip
    (at most two when both are long). Bands alone miss many slips of short tokens (smith and simth share 0.27 of their
    q-grams); slip keys find them all."""
    # a token makes many keys, which the planner can't know: they are spread over all tasks and never broadcast
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = tokens.repartition(parts, "token").mapInPandas(_band_keys(bands()), "token string, key long").hint("merge")
    pairs = keys.join(keys.select(F.col("token").alias("other"), "key"), "key").where("token < other")
    size = F.least(F.length("token"), F.length("other"))
    # swaps of neighbours are one slip here and two to levenshtein
    apart = F.levenshtein("token", "other", 4)  # -1 beyond 4, which is soon known however long the tokens are
    pairs = pairs.where((apart >= 0) & (apart <= F.when(size > 6, 4).otherwise(2)) & (size > 3)).select("token", "other").distinct()
    return pairs.mapInPandas(_slipped, "token string, other string")


def _slipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[bool(slip_similarity(x, y)) for x, y in zip(b["token"], b["other"], strict=True)]]


#: How a key of a name is used: it is only found; only asks; does both; asks with tokens similar to ``x``; or with tokens
#: similar to ``rest``.
GIVES, ASKS, BOTH, ASKS_NEAR, ASKS_NEAR_REST = range(5)


def name_keys(tokens: list[str]) -> list[tuple[str, str, int, str]]:
    """``(x, trait, use, rest)``: two names are candidates when what one asks for, the other gives."""
    if len(tokens) == 1:
        return [(tokens[0], "s", BOTH, ""), (tokens[0], "s", ASKS_NEAR, "")]
    out = set()
    if is_person(tokens):
        given, family = tokens[0], tokens[-1]
        out.add((family, "=" + full_name(given), BOTH, ""))
        out |= {(w, "=" + full_name(family), GIVES, "") for w in (given, full_name(given))}
        out.add((full_name(family), "=" + full_name(given), ASKS, ""))  # a name turned round
        for c in first_letters(given):
            out |= {(family, c, GIVES, ""), (family, c, ASKS_NEAR, "")}
        out |= {(given, c, GIVES, "") for c in first_letters(family)}
        if len(given) <= 5:
            out.add((family, given[0], ASKS, ""))
        out.add((family, "=", ASKS_NEAR_REST, full_name(given)))
    if not is_person(tokens) or len(tokens) == 3:
        for i, w in enumerate(tokens):
            if len(w) > 1:
                for c in initials(tokens[:i] + tokens[i + 1 :]):
                    out |= {(w, f"{len(tokens)} {c}", BOTH, ""), (w, f"{len(tokens)} {c}", ASKS_NEAR, "")}
    return [k for k in out if k[2] < ASKS_NEAR or len(k[3] or k[0]) > 3]


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(n, m, *k) for n, m, t in zip(b["name"], b["mark"], b["tokens"], strict=True) for k in name_keys(list(t))]
        yield pd.DataFrame(out, columns=["name", "mark", "x", "trait", "use", "rest"]).astype({"use": "int32"})


def candidates(names: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: pairs of names that ``same_name`` can take for one. Of two similar tokens the one that fewer names
    hold asks for the other, so a much-used token isn't repeated for all its slips."""
    each = names.select(F.explode("tokens").alias("token"))
    nick = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    often = written(each.union(each.select(F.try_element_at(nick, "token").alias("token")).where("token is not null")).groupBy("token").agg(F.count("*").alias("k")))
    near = similar_tokens(often.where(F.length("token") > 3).select("token"))
    rank = often.select("token", F.struct("k", "token").alias("rank"))
    near = near.join(rank.withColumnRenamed("rank", "rank_a"), "token").join(rank.select(F.col("token").alias("other"), F.col("rank").alias("rank_b")), "other")
    first = F.col("rank_a") < F.col("rank_b")
    near = written(near.select(F.when(first, F.col("token")).otherwise(F.col("other")).alias("token"), F.when(first, F.col("other")).otherwise(F.col("token")).alias("asked")))
    keys = written(names.select("name", "tokens", "mark").mapInPandas(_keys, "name string, mark string, x string, trait string, use int, rest string"))
    key = F.xxhash64("x", "trait", "mark").alias("key")
    gives = keys.where(F.col("use").isin(GIVES, BOTH)).select(F.col("name").alias("b"), key)
    plain = keys.where(F.col("use").isin(ASKS, BOTH)).select(F.col("name").alias("a"), key)
    by_x = keys.where(F.col("use") == ASKS_NEAR).join(near, F.col("x") == F.col("token")).select(F.col("name").alias("a"), F.xxhash64("asked", "trait", "mark").alias("key"))
    by_rest = keys.where(F.col("use") == ASKS_NEAR_REST).join(near, F.col("rest") == F.col("token")).select(F.col("name").alias("a"), F.xxhash64("x", F.concat("trait", "asked"), "mark").alias("key"))
    asks = plain.union(by_x).union(by_rest)
    return asks.join(gives, "key").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [read_name(n) for n in b["name"]]
        b["tokens"], b["mark"] = [t for t, _ in out], [m for _, m in out]
        yield b[["name", "n", "tokens", "mark"]]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    read = lru_cache(200_000)(read_name)
    for b in batches:
        b["score"] = [same_name(read(x), read(y)) for x, y in zip(b["a"], b["b"], strict=True)]
        yield b.loc[b["score"] > 0, ["a", "b", "score"]]


def linked_names(df: DataFrame, name: str, job: str) -> tuple[DataFrame, DataFrame]:
    """``names(name, n, tokens, mark)`` and ``links(a, b, score)``, a < b: verified pairs of spellings. The score is raised
    by up to 0.1 by the agreement of the jobs stated with both."""
    rows = df.where(~is_blank(F.col(name))).select(F.col(name).alias("name"), F.when(~is_blank(F.col(job)), F.lower(F.trim(F.col(job)))).alias("job"))
    by_job = written(rows.groupBy("name", "job").agg(F.count("*").alias("n")))
    counted = by_job.groupBy("name").agg(F.sum("n").alias("n"))
    names = written(counted.mapInPandas(_read, "name string, n long, tokens array<string>, mark string"))
    found = written(candidates(names).mapInPandas(_verify, "a string, b string, score double"))
    stated = by_job.where("job is not null").join(found.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "name")
    size = stated.groupBy("name").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    jobs = stated.join(size, "name").select("name", "job", (F.col("n") / F.col("size")).alias("w"))
    agree = found.join(jobs.select(F.col("name").alias("a"), "job", "w"), "a").join(jobs.select(F.col("name").alias("b"), "job", F.col("w").alias("v")), ["b", "job"])
    agree = agree.groupBy("a", "b").agg(F.sum(F.col("w") * F.col("v")).alias("jobs"))
    links = found.join(agree, ["a", "b"], "left").select("a", "b", (F.col("score") + 0.1 * F.coalesce("jobs", F.lit(0.0))).alias("score"))
    return names, links


def star_clusters(names: DataFrame, links: DataFrame) -> DataFrame:
    """``(name, centre)`` of every name: in each round the free names that rank above all free names they are linked with
    become centres, and the free names linked to centres join the one with the best score (ties: the better rank). A name
    ranks by its number of spelt-out tokens, then by rows, then by code points. Names without links are their own centre."""
    full = F.size(F.filter("tokens", lambda t: F.length(t) > 3))
    rank = F.struct(full.alias("full"), F.col("n").alias("n"), F.col("name").alias("name"))
    ranks = names.select("name", rank.alias("rank"))
    both = links.select("a", "b", "score").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    free = written(both.join(ranks.select(F.col("name").alias("a"), F.col("rank").alias("ra")), "a").join(ranks.select(F.col("name").alias("b"), F.col("rank").alias("rb")), "b"))
    done = []
    for _ in range(MAX_ROUNDS):
        if free.isEmpty():
            break
        centres = written(free.groupBy("a").agg(F.max("rb").alias("top"), F.max("ra").alias("ra")).where(F.col("ra") > F.col("top")).select(F.col("a").alias("centre")))
        joined = free.join(centres, free.b == centres.centre).groupBy("a").agg(F.max(F.struct("score", "rb")).alias("best"))
        joined = joined.select(F.col("a").alias("name"), F.col("best.rb.name").alias("centre"))
        settled = written(joined.join(centres.select(F.col("centre").alias("name")), "name", "left_anti").union(centres.select("centre", "centre")))
        done.append(settled)
        left = free.join(settled.select(F.col("name").alias("a")), "a", "left_anti").join(settled.select(F.col("name").alias("b")), "b", "left_anti")
        after = written(left)
        drop_written(free)
        free = after
    else:
        raise RuntimeError("star clustering did not settle")
    out = None
    for d in done:
        out = d if out is None else out.union(d)
    alone = names.select("name") if out is None else names.select("name").join(out.select("name"), "name", "left_anti")
    alone = alone.select("name", F.col("name").alias("centre"))
    return alone if out is None else out.union(alone)


def cluster_names(df: DataFrame, name: str, job: str) -> DataFrame:
    """``(name, centre)`` for every distinct non-blank spelling. NULL and blank names have no row."""
    with scratch() as keep:
        return keep(written(star_clusters(*linked_names(df, name, job))))


def variant_pairs(clusters: DataFrame) -> DataFrame:
    """``(name_a, name_b)``, in code-point order: spellings of one cluster."""
    c = clusters.select(F.col("name").alias("name_a"), "centre")
    return c.join(c.select(F.col("name_a").alias("name_b"), "centre"), "centre").where("name_a < name_b").select("name_a", "name_b")
