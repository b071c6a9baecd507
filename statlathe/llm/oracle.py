"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables in reasonable time, written apart
from the operators: problem 1 spreads least row ids step by step, problem 10 has its own table of code points. The others
are tested against brute force on small fixtures in ``tests/llm``."""

from __future__ import annotations

#: Rounds in which a least row id reaches every row of its group; a group's rows are at most this many links apart.
ROUNDS = 24

# Code points of letters of other scripts, each with the Latin letter it looks like.
LOOKS = """
410 A 412 B 415 E 405 S 406 I 408 J 41A K 41C M 41D H 41E O 420 P 421 C 422 T 423 Y 425 X 4AE Y 4BA h
430 a 441 c 435 e 455 s 456 i 458 j 43E o 440 p 445 x 443 y 501 d 51B q 51D w 4C0 l
391 A 392 B 395 E 396 Z 397 H 399 I 39A K 39C M 39D N 39F O 3A1 P 3A4 T 3A5 Y 3A7 X
3B1 a 3BD v 3BF o 3C1 p 3C5 u 3B9 i 3C7 x 3BA k 251 a 261 g 2113 l
2010 - 2011 - 2043 - 2212 -
"""
HIDDEN = "173, 847, 1564, 4447, 4448, 12644, 65279, 65440"
SPACES = "160, 5760, 8239, 8287, 10240, 12288"


def _look(text: str) -> str:
    pairs = LOOKS.split()
    cases = " ".join(f"WHEN {int(pairs[i], 16)} THEN '{pairs[i + 1]}'" for i in range(0, len(pairs), 2))
    code = "unicode(c)"
    one = (
        f"CASE WHEN {code} < 128 THEN c WHEN {code} BETWEEN 65281 AND 65374 THEN chr({code} - 65248)"
        f" WHEN {code} IN ({HIDDEN}) OR {code} BETWEEN 8203 AND 8207 OR {code} BETWEEN 8234 AND 8238 OR {code} BETWEEN 8288 AND 8303 OR {code} BETWEEN 65024 AND 65039 OR {code} BETWEEN 6155 AND 6158 THEN ''"
        f" WHEN {code} IN ({SPACES}) OR {code} BETWEEN 8192 AND 8202 THEN ' ' WHEN {code} = 64257 THEN 'fi' WHEN {code} = 64258 THEN 'fl' WHEN {code} = 64256 THEN 'ff'"
        f" ELSE CASE {code} {cases} ELSE c END END"
    )
    # string_split goes by grapheme, which keeps a letter and its accents together; range goes by code point
    chars = f"list_transform(range(1, length({text}) + 1), lambda i: array_slice({text}, i, i))"
    return f"nfc_normalize(array_to_string(list_transform({chars}, lambda c: {one}), ''))"


def _groups() -> str:
    steps = [
        "rows AS MATERIALIZED (SELECT row_id, CASE WHEN trim(speaker_name) <> '' THEN speaker_name END AS s, CASE WHEN trim(norm_key) <> '' THEN norm_key END AS k FROM statements)",
        "g0 AS MATERIALIZED (SELECT row_id, s, k, row_id AS g FROM rows)",
    ]
    for i in range(ROUNDS):
        part = lambda c: f"min(g) OVER (PARTITION BY coalesce({c}, '\x1f' || row_id))"
        steps.append(f"h{i} AS MATERIALIZED (SELECT row_id, s, k, {part('s')} AS g FROM g{i})")
        steps.append(f"g{i + 1} AS MATERIALIZED (SELECT row_id, s, k, {part('k')} AS g FROM h{i})")
    return ", ".join(steps) + f", sized AS (SELECT row_id, g AS group_row_id, count(*) OVER (PARTITION BY g) AS n FROM g{ROUNDS})"


def oracle_sql() -> dict[str, str]:
    look = _look("text")
    forms = f"forms AS MATERIALIZED (SELECT doc_id, text, {look} AS look FROM documents WHERE text IS NOT NULL)"
    return {
        "p1_found": f"WITH {_groups()} SELECT row_id, group_row_id FROM sized WHERE n > 1",
        "p10_canonical": f"SELECT doc_id, {look} AS canonical FROM documents",
        "p10_found": f"WITH {forms} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
        "p10_groups": f"WITH {forms}, g AS (SELECT look, min(doc_id) AS look_id, count(DISTINCT text) AS n_forms, count(*) AS n_rows FROM forms GROUP BY look HAVING count(DISTINCT text) > 1)"
        " SELECT doc_id, look_id, n_forms, n_rows FROM forms JOIN g USING (look)",
    }
