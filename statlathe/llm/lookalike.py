"""Visually identical text with different characters (problem 10).

DuckDB runs inside each Arrow partition and brings texts to one form by embedded SQL: compatibility forms and look-alike
letters by ``translate``, invisible characters by a regular expression, combining accents by ``nfc_normalize``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.plans.shared import salted_join, written

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮһасеѕіјорухԁԛԝӀ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYhacesijopyxdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυιχκ"
GREEK_AS = "ABEZHIKMNOPTYXavopuixk"
OTHER = "ɑɡℓ‐‑⁃−"
OTHER_AS = "agl----"
ARMENIAN = "օսհյցքզ"
ARMENIAN_AS = "ouhjgpq"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTAJEWMHGZVSLCPKB"
SMALL_CAPITALS = "ᴄᴏᴠᴡᴢ"
SMALL_CAPITALS_AS = "covwz"
#: Characters that show nothing.
INVISIBLE = "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{E0000}-\\x{E007F}\\x{E0100}-\\x{E01EF}]"
#: What a text in its one form need not be searched for: ASCII, composed Latin letters, usual marks. All other characters
#: send a text through the whole mapping (which leaves those of them alone that have no plain form).
UNSETTLED = "[^\\x00-\\x7F\\x{00A1}-\\x{00AC}\\x{00AE}-\\x{017E}“”‘’–—…€]"
#: Spaces that show as the plain one.
SPACES = "               　⠀"


def one_to_one() -> tuple[str, str]:
    """The ``translate`` arguments: full-width forms and mathematical letters by Unicode's own compatibility mapping,
    special spaces, and the look-alikes above (which also apply to what the first mapping gives)."""
    letters = CYRILLIC + GREEK + OTHER + ARMENIAN + CHEROKEE + SMALL_CAPITALS
    plain_letters = CYRILLIC_AS + GREEK_AS + OTHER_AS + ARMENIAN_AS + CHEROKEE_AS + SMALL_CAPITALS_AS
    table = dict(zip(letters + SPACES, plain_letters + " " * len(SPACES), strict=True))
    for block in (range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800), range(0x2160, 0x2180)):
        for code in block:
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain != chr(code):
                table.setdefault(chr(code), table.get(plain, plain))
    return "".join(table), "".join(table.values())


# Ligatures, which become several letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Roman numerals that are one character, by Unicode's compatibility mapping.
LIGATURES |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180) if len(unicodedata.normalize("NFKC", chr(c))) > 1}


def canonical_sql(text: str) -> str:
    """The DuckDB expression of a text's canonical form. NULL stays NULL; plain ASCII is returned as it is."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    source, target = one_to_one()
    several = f"regexp_replace({text}, '{INVISIBLE}', '', 'g')"
    for a, b in LIGATURES.items():
        several = f"replace({several}, '{a}', '{b}')"
    once = f"nfc_normalize(translate({several}, {quote(source)}, {quote(target)}))"
    return f"CASE WHEN regexp_matches({text}, '{UNSETTLED}') THEN {once} ELSE {text} END"


def _map(select: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            for batch in batches:
                part = pa.Table.from_batches([batch])
                con.register("part", part)
                out = con.sql(select).to_arrow_table()
                con.unregister("part")
                yield from out.to_batches()

    return run


def canonical(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``canonical``, the text in its one form; two texts look the same when these are equal. NULL gives
    NULL, '' gives ''. Letter case, accents, digits and line breaks stay."""
    kind = df.schema[key].dataType.simpleString()
    sql = f"SELECT k, {canonical_sql('t')} AS canonical FROM part"
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_map(sql), f"k {kind}, canonical string").withColumnRenamed("k", key)


def forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, look, raw)``: 16-byte digests of each text's canonical form and of the text as stored; NULL left out.
    Only digests leave the partition."""
    sql = f"SELECT k, unhex(md5({canonical_sql('t')})) AS look, unhex(md5(t)) AS raw FROM part"
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(_map(sql), "k long, look binary, raw binary").withColumnRenamed("k", key)


def look_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, look_id, n_forms, n_rows)`` for every row whose text looks like another, different one: the group's least
    key, the number of its different strings and of its rows."""
    rows = written(forms(df, key, text))
    by_form = rows.groupBy("look", "raw").agg(F.min(key).alias("m"), F.count("*").alias("n"))
    groups = by_form.groupBy("look").agg(F.min("m").alias("look_id"), F.count("*").alias("n_forms"), F.sum("n").alias("n_rows")).where("n_forms > 1")
    return salted_join(rows.select(key, "look"), groups, "look", "n_rows", rows.count(), key, "inner").select(key, "look_id", "n_forms", "n_rows")


def look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(a, b)``, smaller key first: rows whose texts look the same but are different strings. The different strings of
    a group are paired before their rows, so identical strings cost nothing however many there are."""
    rows = written(forms(df, key, text))
    by_form = written(rows.groupBy("look", "raw").agg(F.count("*").alias("n")))
    several = by_form.groupBy("look").agg(F.count("*").alias("n_forms")).where("n_forms > 1").select("look")
    shown = by_form.join(several, "look").select("look", "raw")
    pairs = shown.select("look", F.col("raw").alias("raw_a")).join(shown.select("look", F.col("raw").alias("raw_b")), "look").where("raw_a < raw_b").drop("look")
    left = rows.select(F.col(key).alias("x"), F.col("raw").alias("raw_a"))
    right = rows.select(F.col(key).alias("y"), F.col("raw").alias("raw_b"))
    both = pairs.join(left, "raw_a").join(right, "raw_b")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
