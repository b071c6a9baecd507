"""Recall and precision on planted cases; each must reach 0.9 (most are found entirely)."""

import random

from statlathe.llm import canon, leaks, mojibake, names


def _score(found: set, want: set) -> tuple[float, float]:
    return len(found & want) / len(want), len(found & want) / max(1, len(found))


def test_garbled_rows(spark):
    rng = random.Random(1)
    plain = "the union before taxes didn't rise while schools in the county closed whereas roads got funding".split()
    special = ["“no”", "São", "Ñandovar", "didn’t", "€5", "Übersund", "—", "Château", "Kundálwetil", "Drumel’s", "junctîon"]
    pairs = [p for p in mojibake.PAIRS if p[0] == "utf-8"]
    rows, want = [], set()
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(6, 25))]
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(special))
        text = " ".join(w)
        if i % 6 == 0:
            try:
                damaged = mojibake.garble(text, rng.choice(pairs))
            except UnicodeError:
                damaged = text
            if damaged != text:
                want.add((i, "statement"))
                text = damaged
        rows.append((i, text, None))
    d = spark.createDataFrame(rows, "row_id long, statement string, statement_clean string")
    got = {(r.row_id, r.field_name) for r in mojibake.find_garbled(d, "row_id", ["statement", "statement_clean"]).collect()}
    recall, precision = _score(got, want)
    assert len(want) > 50 and recall >= 0.95 and precision >= 0.95


def test_spellings_of_planted_people(spark):
    rng = random.Random(2)
    part = "ban dal fin gol hul jan kel lom mur nep pra sil tor vin zan".split()
    given = ["gregory", "robert", "constance", "harold", "margaret", "theodore", "alexander"]
    short = {full: nick for nick, full in names.NICKNAMES.items()}
    rows, who = [], {}
    for k in range(120):
        g, f = rng.choice(given), "".join(rng.choice(part) for _ in range(3))
        typo = list(f)
        i = rng.randrange(1, len(typo) - 1)
        typo[i : i + 2] = [typo[i + 1], typo[i]] if rng.random() < 0.5 else [typo[i]]
        spelt = {f"{g}-{f}", f"{g.title()} {f.title()}", f"{f.title()}, {g.title()}", f"{g[0].upper()}. {f.title()}", f"{g} {''.join(typo)}", f"Sen. {g.title()} {f.title()}", f"{short.get(g, g).title()} {f.title()}"}
        for s in spelt - set(who):
            who[s] = (g, f)
            rows.append((s, f"job {k}"))
    d = spark.createDataFrame(rows, "speaker_name string, speaker_job string")
    got = {(r.name_a, r.name_b) for r in names.variant_pairs(names.cluster_names(d, "speaker_name", "speaker_job")).collect()}
    want = {(a, b) for a in who for b in who if a < b and who[a] == who[b]}
    recall, precision = _score(got, want)
    assert len(want) > 1000 and recall >= 0.95 and precision >= 0.95


def test_values_typed_for_a_list(spark):
    rng = random.Random(3)
    part = "bas hart kell nor sul mar ost wen dor fal".split()
    kinds = ["county council", "radio station", "charter society", "labor federation", "teachers institute"]
    entries = sorted({f"{rng.choice(part)}{rng.choice(part)}ia {rng.choice(kinds)}" for _ in range(300)})
    c = spark.createDataFrame([("f", i + 1, e.title()) for i, e in enumerate(entries)], "field_name string, canon_id int, canon_name string")
    rows, want = [], set()
    for i in range(500):
        k = rng.randrange(len(entries))
        v = entries[k]
        w = v.split()
        at = rng.randrange(1, len(w[0]) - 2)
        form = rng.choice([v.upper(), f"  {v} ", f"{w[0]} {w[1]} {w[2][:4]}.", f"{w[1].title()} {w[2].title()}, {w[0].title()}", w[0][:at] + w[0][at + 1] + w[0][at] + w[0][at + 2 :] + " " + " ".join(w[1:]), f"{v.title()} (Northfield)"])
        rows.append((i, form))
        want.add((i, k + 1))
    rows += [(1000 + i, "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(12))) for i in range(50)]
    d = spark.createDataFrame(rows, "row_id long, f string")
    got = {(r.row_id, r.canon_id) for r in canon.map_fields(d, "row_id", ["f"], c).collect()}
    recall, precision = _score({x for x in got if x[1]}, want)
    assert recall >= 0.9 and precision >= 0.95
    assert {(1000 + i, 0) for i in range(50)} <= got


def test_planted_passages(spark):
    rng = random.Random(4)
    vocab = [f"term{i}" for i in range(800)] + ["the", "of", "and"] * 60
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randint(40, 150)) for _ in range(40)]
    rows, want = [], set()
    for i in range(500):
        w = text(rng.randint(60, 200))
        if i % 4 == 0:
            k = rng.randrange(len(items))
            n = len(items[k])
            size = rng.randint(-(-n // 3) + 1, n)
            a = rng.randrange(n - size + 1)
            passage = list(items[k][a : a + size])
            for _ in range(int(size * 0.1 * rng.random())):
                passage[rng.randrange(1, size - 1)] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() if rng.random() < 0.1 else x for x in passage]
            want.add((i, k))
        elif i % 4 == 1:
            k = rng.randrange(len(items))
            w[10:10] = items[k][: len(items[k]) // 5]  # a quotation too short to count
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    e = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.search(leaks.build_index(d, "doc_id", "text"), e, "item_id", "text").collect()}
    recall, precision = _score(got, want)
    assert recall >= 0.95 and precision >= 0.95
