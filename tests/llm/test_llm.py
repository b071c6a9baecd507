import os
import random

import pytest

from statlathe.llm import canon, copies, leaks, lookalike, mixture, mojibake, names, overlap, splits


def test_groups_match_union_find(spark):
    rng = random.Random(3)
    pick = lambda n: rng.choice([None, "", " ", *[f"v{i}" for i in range(n)]])
    rows = [(i, "hot" if i % 3 == 0 and i > 150 else pick(60), pick(150), "x") for i in range(300)]
    d = spark.createDataFrame(rows, "row_id long, speaker_name string, norm_key string, n string")
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, s, k, _ in rows:
        for tag, v in (("s", s), ("k", k)):
            if v and v.strip():
                a, b = find(i), find(seen.setdefault((tag, v), i))
                parent[max(a, b)] = min(a, b)
    got = {r.row_id: r.group_row_id for r in splits.group_related(d, "row_id", "speaker_name", "norm_key").collect()}
    assert got == {i: find(i) for i in range(300)}
    placed = splits.assign_splits(splits.group_related(d, "row_id", "speaker_name", "norm_key"), {"train": 0.7, "val": 0.15, "test": 0.15})
    by = {}
    for r in placed.collect():
        assert by.setdefault(r.group_row_id, r.split) == r.split
    alone = splits.assign_splits(spark.range(4000).selectExpr("id as row_id", "id as group_row_id", "1L as n_rows"), {"train": 0.7, "val": 0.15, "test": 0.15}, large=None)
    share = {r.split: r.share for r in splits.split_report(alone, {"train": 0.7, "val": 0.15, "test": 0.15}).collect()}
    assert share["train"] == pytest.approx(0.7, abs=0.03) and share["val"] == pytest.approx(0.15, abs=0.03)
    assert splits.group_related(d.limit(0), "row_id", "speaker_name", "norm_key").count() == 0


def test_copies(spark):
    rows = [
        (5, "Taxes rose, fast!", "Ann B", "a$b", "x"), (2, "taxes ROSE  fast", "ann-b", '["B", "a"]', "y"), (9, "taxes rose fast", "ann b", "a", "z"),
        (7, None, None, None, "x"), (8, " ", "", " ", "x"), (11, "t" * 50_000, "c", "a;b;a", "x"), (12, "T" * 50_000, "C", "b, a", "x"),
    ]
    d = spark.createDataFrame(rows, "row_id long, statement string, speaker_name string, subjects string, root string")
    got = {r.row_id: (r.first_row_id, r.n_copies) for r in copies.record_groups(d, "row_id", ["statement", "speaker_name"], "subjects").collect()}
    assert got == {2: (2, 2), 5: (2, 2), 9: (9, 1), 7: (7, 2), 8: (7, 2), 11: (11, 2), 12: (11, 2)}
    assert copies.collapse(d.limit(0), "row_id", ["statement", "speaker_name"], "subjects").count() == 0


def _edits(a, b, swaps=False):
    """Edit distance straight from its definition; with swaps of neighbours where asked for."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distances_match_the_definition():
    rng = random.Random(11)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.choice("abc") for _ in range(rng.randint(0, 1))]
        for most in range(5):
            assert overlap._words_distance(a, b, most) == (_edits(a, b) <= most)
        for most in (1, 2):
            assert canon.one_slip("".join(a), "".join(b), most) == (_edits(a, b, swaps=True) <= most)


def test_very_long_texts_and_tokens(spark):
    words = [f"w{i % 977}" for i in range(60_000)]
    changed = list(words)
    changed[100] = changed[40_000] = "other"
    d = spark.createDataFrame([(1, " ".join(words), "train", "x"), (2, " ".join(changed), "val", "x"), (3, "a " * 20_000, "test", "x"), (4, None, "val", "x"), (5, "", None, "x")], "row_id long, statement string, split_name string, key string")
    assert [tuple(r) for r in overlap.cross_split_pairs(d, "row_id", "statement", "split_name").collect()] == [(1, 2)]
    long = "x" * 20_000
    n = spark.createDataFrame([(f"{long} smith", None), (f"{long}y smith", None), (None, "j")], "speaker_name string, speaker_job string")
    assert len({r.centre for r in names.cluster_names(n, "speaker_name", "speaker_job").collect()}) == 1


def test_overlap_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        if i < 40 or rng.random() < 0.2:
            w = [rng.choice(vocab) for _ in range(rng.randint(1, 40))]
        else:
            w = list(rng.choice(rows)[1].split(" "))
            for _ in range(rng.randint(0, max(1, len(w) // 5))):
                k = rng.randrange(len(w) + 1)
                rng.choice([lambda k=k: w.insert(k, rng.choice(vocab)), lambda k=k: w.pop(k - 1) if len(w) > 1 else None])()
        rows.append((i, " ".join(w), rng.choice(["train", "train", "val", "test", None])))
    d = spark.createDataFrame(rows, "row_id long, statement string, split_name string")
    want = set()
    for a, x, s in rows:
        for b, y, t in rows:
            if s == "train" and t in ("val", "test"):
                p, q = overlap.words_of(x), overlap.words_of(y)
                if "".join(p) == "".join(q) or _edits(p, q) <= overlap.allowed(max(len(p), len(q))):
                    want.add((min(a, b), max(a, b)))
    got = [tuple(r) for r in overlap.cross_split_pairs(d, "row_id", "statement", "split_name").collect()]
    assert set(got) == want and len(got) == len(want)
    report = overlap.overlap_report(d.selectExpr("*", "'f' as feed"), "row_id", "statement", "split_name", "feed").collect()
    assert sum(r.n_pairs for r in report) == len(want)
    assert overlap.cross_split_pairs(d.limit(0), "row_id", "statement", "split_name").count() == 0


def _of_phrases(rng, n):
    phrases = [" ".join(f"p{i}x{j}" for j in range(6)) for i in range(12)]
    return [" ".join(f"{rng.choice(phrases)} {' '.join(f'v{rng.randrange(300)}' for _ in range(4))}" for _ in range(4)) for _ in range(n)]


def test_overlap_runs_stay_selective_among_many_texts():
    import numpy as np
    import pyarrow as pa

    w = overlap.Words(pa.array(_of_phrases(random.Random(8), 2000)))
    first, common = w.pairs(), []
    for h in (overlap._mixed(w.h), w.runs(first, first + 2)):
        keys, n = np.unique(h, return_counts=True)
        common.append((keys[n > 1], np.minimum(1.0, n[n > 1] / 2000)))
    text, level, key = overlap.Runs(common, 20_000_000).chosen(w)
    assert len(np.unique(text)) == 2000
    # equal blocks of these texts hold little but phrases, which every third text has
    assert (level >= 10).mean() < 0.01
    assert (np.unique(key, return_counts=True)[1].astype(float) ** 2).sum() < 20 * len(key)


def test_overlap_matches_brute_force_at_later_levels(spark, monkeypatch):
    rng = random.Random(9)
    texts = _of_phrases(rng, 60)
    for x in texts[:60]:
        w = x.split(" ")
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(300)}"
        texts.append(" ".join(w))
    rows = [(i, x, rng.choice(["train", "val"])) for i, x in enumerate(texts)]
    want = set()
    for a, x, s in rows:
        for b, y, t in rows:
            if (s, t) == ("train", "val") and _edits(x.split(" "), y.split(" ")) <= overlap.allowed(40):
                want.add((min(a, b), max(a, b)))
    common = overlap._common
    d = spark.createDataFrame(rows, "row_id long, statement string, split_name string")
    for times in (10**5, 10**8):
        monkeypatch.setattr(overlap, "_common", lambda c, times=times: (common(c)[0], common(c)[1] * times))
        got = [tuple(r) for r in overlap.cross_split_pairs(d, "row_id", "statement", "split_name").collect()]
        assert want and set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("pair", [p for p in mojibake.PAIRS if p[0] == "utf-8" and p[1] != "cp850" and p[1:] != ("latin-1", 2)])
def test_mojibake_round_trip(pair):
    model = mojibake.Model({"before", "union", "didn't", "whereas"})
    text = "He said “no” in São Ñandovar — didn’t pay €5 for Übersund"
    restored, hit = model.restore(mojibake.garble(text, pair))
    assert hit and restored == text


def test_mojibake_leaves_genuine_text_alone(spark):
    model = mojibake.Model({"union", "before"})
    for text in ["Château Drumel’s “plan” — €4.2", "SÃO BRELO", "Junctîon Übersund", "plain", "", None, "í" * 10_000]:
        assert model.restore(text) == (text, False)
    rows = [(1, "didnâ€™t", None, "x"), (2, None, "ok", "x"), (3, "lost �", "", "x")]
    d = spark.createDataFrame(rows, "row_id long, statement string, statement_clean string, k string")
    got = {(r.row_id, r.field_name): r.restored for r in mojibake.find_garbled(d, "row_id", ["statement", "statement_clean"]).collect()}
    assert got == {(1, "statement"): "didn’t", (3, "statement"): "lost �"}
    assert mojibake.find_garbled(d.limit(0), "row_id", ["statement", "statement_clean"]).count() == 0


def test_names(spark):
    people = ["gregory-prumifipan", "Prumifipan, Greg", "G. Prumifipan", "Gregory Prumifipann", "constance-prumifipan", "gregory-prumifipan-jr", "Gregory Prumifipan Jr."]
    orgs = ["kiltobova-harbor-teachers-committee", "Kiltobova H.T.C.", "Committee of Kiltobova Harbor Teachers"]
    rows = [(n, "Governor", i) for i, n in enumerate([*people, *orgs, *orgs, "gregory-prumifipan"])] + [(None, "x", 99), ("  ", None, 98)]
    d = spark.createDataFrame(rows, "speaker_name string, speaker_job string, token int")
    got = {r.name: r.centre for r in names.cluster_names(d, "speaker_name", "speaker_job").collect()}
    assert len({got[n] for n in people[:4]}) == 1 and got[people[4]] != got[people[0]]
    assert got[people[5]] == got[people[6]] != got[people[0]]
    assert len({got[n] for n in orgs}) == 1 and len(got) == 10
    assert names.cluster_names(d.limit(0), "speaker_name", "speaker_job").count() == 0
    assert 1 - (1 - names.AT**names.BAND_ROWS) ** names.bands() >= names.RECALL


def test_similar_tokens_finds_every_slip(spark):
    rng = random.Random(4)
    words = ["smith", "jones", "davis", "clark", "hale", "reed", "walker", "nguyen", "thompson", "abcdefghijklmnopqrstuvwx", "abcdefghijklmnopqrstuvwxyzabcd"]
    made = set(words)
    for w in words:
        for _ in range(40):
            t = list(w)
            for _ in range(1 + (len(w) > 6 and rng.random() < 0.7)):
                i = rng.randrange(len(t) - 1)
                t[i : i + 2] = rng.choice([[t[i + 1], t[i]], [t[i]], [t[i], "e", t[i + 1]], [t[i], "o"], ["x", t[i + 1]]])
            made.add("".join(t))
    made = sorted(made)
    # (short for each other is found by bands, without a promise)
    slips = {(a, b) for i, a in enumerate(made) for b in made[i + 1 :] if names.slip_similarity(a, b) > 0}
    got = {tuple(r) for r in names.similar_tokens(spark.createDataFrame([(t,) for t in made], "token string")).collect()}
    assert len(slips) > 500 and slips <= got


def test_names_of_common_tokens(spark):
    given = "john mary peter alice henry laura oscar nancy walter irene victor sophie".split()
    last = "smith jones taylor brown walker".split()
    common = [f"{g.title()} {x.title()}" for g in given for x in last]
    names_, same = [*common, "Smith, John", "JOHN SMITH", "Smiht, John", "Jhon Smith", "Li, Bo", "Bo Li", "Bo Lu"], ["John Smith", "Smith, John", "JOHN SMITH", "Smiht, John", "Jhon Smith"]
    d = spark.createDataFrame([(n, None) for n in names_], "speaker_name string, speaker_job string")
    got = {r.name: r.centre for r in names.cluster_names(d, "speaker_name", "speaker_job").collect()}
    assert len({got[n] for n in same}) == 1 and got["Li, Bo"] == got["Bo Li"] != got["Bo Lu"]
    assert sum(got[n] == got["John Smith"] for n in names_) == len(same) and len({got[n] for n in common}) == len(common)


def test_namesakes_do_not_hide_spellings(spark):
    # 70 people called Smith and 70 called Robert: neither token makes a link hard to find
    others = [f"{a}{b}{c}o Smith" for a in "BCDGHKLMNP" for b, c in ("an", "el", "im", "or", "us", "yt", "af")] + [f"Robert {a}{b}{c}sen" for a in "BCDGHKLMNP" for b, c in ("an", "el", "im", "or", "us", "yt", "af")]
    same = ["Robert Smith", "Bob Smith", "R. Smith", "Smith, Robert", "Robrt Smith", "Robert Smiht", "SMITH ROBERT", "Sen. Robert Smith"]
    apart = ["Robert Smith Jr.", "R. Smith II"]
    d = spark.createDataFrame([(n, None) for n in [*others, *same, *apart]], "speaker_name string, speaker_job string")
    got = {r.name: r.centre for r in names.cluster_names(d, "speaker_name", "speaker_job").collect()}
    assert len({got[n] for n in same}) == 1
    assert not {got[n] for n in apart} & {got[n] for n in same} and got[apart[0]] != got[apart[1]]
    assert sum(c == got["Robert Smith"] for c in got.values()) == len(same)


def test_name_score_is_the_mean_of_best_matches():
    sim = names.token_similarity
    for a, b in [("gregory prumifipan", "greg prumifipann"), ("g prumifipan", "gregory prumifipan"), ("bob smith", "robert smiht"), ("k h t c", "kilto harbor teachers committee")]:
        p, q = a.split(), b.split()
        plain = []
        for x, y in ((p, q), (q, p)):
            best = [0.0] * len(x)
            for i in range(len(x)):
                for w in y:
                    if sim(x[i], w) > best[i]:
                        best[i] = sim(x[i], w)
            plain.append(sum(best) / len(best))
        assert names.monge_elkan(p, q) == pytest.approx(min(plain))
        assert names.same_name((p, ""), (q, "")) in (0.0, pytest.approx(min(plain)))
    assert names.same_name((["j", "f", "lum"], ""), (["j", "k", "lum"], "")) == 0
    assert names.same_name((["j", "f", "lum"], ""), (["john", "lum"], "")) > 0


def test_candidates_hold_every_pair_the_score_accepts(spark):
    rng = random.Random(9)
    given, last = "robert bob gerald jerry walter walt ann harold mary".split(), "smith smithson jones lumikohan prumifipan bandanva".split()
    made = set()
    for _ in range(260):
        g, f = rng.choice(given), rng.choice(last)
        if rng.random() < 0.3:
            t = list(rng.choice([g, f]))
            i = rng.randrange(len(t) - 1)
            t[i : i + 2] = rng.choice([[t[i + 1], t[i]], [t[i]], ["o", t[i + 1]]])
            g, f = ("".join(t), f) if rng.random() < 0.5 else (g, "".join(t))
        made.add(rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g[:3]}. {f}", f"{f} {g}", f"{g} {f} union council", f"{f} {g[0]}.U.C.", f"{g[0]}. K. {f}", f"{g} {f} jr", f]))
    made = sorted(made)
    read = [names.read_name(n) for n in made]
    want = {(made[i], made[j]) for i in range(len(made)) for j in range(i + 1, len(made)) if names.same_name(read[i], read[j])}
    rows = spark.createDataFrame([(n, 1, *r) for n, r in zip(made, read, strict=True)], "name string, n long, tokens array<string>, mark string")
    got = {(r.a, r.b) for r in names.candidates(rows).collect()}
    assert len(want) > 100 and want <= got


def test_canon(spark):
    entries = [("f", 1, "Trade association"), ("f", 2, "Old Charter Society"), ("f", 3, "a radio ad"), ("f", 4, "a radio interview")]
    c = spark.createDataFrame(entries, "field_name string, canon_id int, canon_name string")
    want = {"trade assn.": 1, "OCS": 2, "Society, Old Charter": 2, "a rdaio ad": 3, "radio i/v": 4, "a radio jingle contest": 0, "??": 0, "Trade association (Bastonia)": 1, "x" * 20_000: 0}
    rows = [(i, v, "n") for i, v in enumerate(want)] + [(90, None, "n"), (91, " ", "n"), (92, "Trade association", "n")]
    d = spark.createDataFrame(rows, "row_id long, f string, n string")
    got = {r.row_id: r.canon_id for r in canon.map_fields(d, "row_id", ["f"], c).collect()}
    assert got == dict(enumerate(want.values()))
    assert canon.map_fields(d.limit(0), "row_id", ["f"], c).count() == 0
    assert canon.map_fields(d, "row_id", ["f"], c.limit(0)).where("canon_id <> 0").count() == 0


def test_canon_slices_agree_with_the_whole(spark, monkeypatch):
    towns = ["Bastonia", "Bostonia", "Hartwell", "Hartwick", "Old Charter Society", "Kellmore", "Radio interview", "Radio ad", "Northfield", "Southfield"]
    c = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(towns)], "field_name string, canon_id int, canon_name string")
    d = spark.createDataFrame([("f", v) for v in ["bastonia", "bostonia", "hartwel", "OCS", "kelmore", "radio i/v", "north field"]], "field_name string, value string")
    want = sorted(tuple(r) for r in canon.match_values(d, c).collect())
    assert {v: i for _, v, i, _, _ in want}["bastonia"] == 1
    monkeypatch.setattr(canon, "LIST_SLICE", 3)
    got = sorted(tuple(r) for r in canon.match_values(d, c).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3:] for x in got] == [pytest.approx(x[3:]) for x in want]


def test_leaks(spark):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(90) for _ in range(5)]
    changed = items[1][20:60]
    changed[7] = changed[25] = "other"
    shuffled = items[4][:40]
    rng.shuffle(shuffled)
    docs = [text(30) + items[0][10:45] + text(20), text(10) + changed + text(10), text(30) + items[2][:18] + text(30), shuffled, text(200), ["*" + w.upper() for w in items[3]]]
    d = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(docs)] + [(50, None, "x"), (51, "", "x"), (52, " ".join(text(60_000) + items[3]), "x")], "doc_id long, text string, segment string")
    e = spark.createDataFrame([(100 + i, " ".join(w)) for i, w in enumerate(items)] + [(200, ""), (201, None)], "item_id long, text string")
    index = leaks.build_index(d, "doc_id", "text")
    assert {(r.doc_id, r.item_id) for r in leaks.search(index, e, "item_id", "text").collect()} == {(0, 100), (1, 101), (5, 103), (52, 103)}
    assert leaks.search(leaks.build_index(d.limit(0), "doc_id", "text"), e, "item_id", "text").count() == 0
    assert leaks.search(index, e.limit(0), "item_id", "text").count() == 0


def test_leak_words_are_folded():
    assert leaks.tokens("Ｔhe “Ѕenate’s” 2\u200b0\U000e0020\u00ad9 caf\u0065\u0301\u00a0plan ⅷ") == ["the", "senate", "s", "209", "café", "plan", "viii"]


def test_leaks_beside_short_documents(spark):
    item = [f"w{i}" for i in range(90)]
    docs = [" ".join(["x"] * 5 + item[:30]), "a b c d e f", "", None, "g h i j k l", "m n", "", " ".join(item[60:] + ["y"] * 5)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    e = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in leaks.search(leaks.build_index(d, "doc_id", "text"), e, "item_id", "text").collect()) == [0, 7]


def test_lookalike(spark):
    rows = [(1, "Café one", "x"), (2, "Café one", "x"), (3, "Ｃａｆé\xa0one", "x"), (4, "Сafé o​ne", "x"), (5, "Cafe one", "x"), (6, "Café one", "x"), (7, None, "x"), (8, "", "x"), (9, "cafÉ one", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, look string")
    got = {(r.a, r.b) for r in lookalike.look_pairs(d, "doc_id", "text").collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (2, 6), (3, 6), (4, 6)}
    assert {r.doc_id: r.canonical for r in lookalike.canonical(d, "doc_id", "text").collect()}[4] == "Café one"
    assert lookalike.look_groups(d, "doc_id", "text").first().n_rows == 5
    assert lookalike.look_pairs(d.limit(0), "doc_id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists(mixture.TOKENIZERS), reason="no tokenizer files")
def test_mixture(spark):
    rows = [(i, f"some text number {i}", "ab"[i % 2]) for i in range(400)] + [(1000 + i, f"some text number {2 * i}", "b") for i in range(20)] + [(5000, None, "a"), (5001, "", "b"), (5002, "t", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 2)], "source string, target_share double, max_repeats int")
    chosen = mixture.mix(d, "doc_id", "text", "source", t)
    by = {r.source: r for r in mixture.mix_report(chosen, "source", t).collect()}
    assert by["a"].share == pytest.approx(0.75, abs=0.02) and by["a"].most_uses == 1
    assert mixture.mix(d.limit(0), "doc_id", "text", "source", t).count() == 0


@pytest.mark.skipif(not os.path.exists(mixture.TOKENIZERS), reason="no tokenizer files")
def test_mixture_keeps_all_sources_of_many_patterns(spark, monkeypatch):
    # c holds nothing of its own: all its texts are a's and b's as well
    rows = [(100 * k + i, f"text {i}", s) for i in range(60) for k, s in enumerate("abc") if k < 2 or i < 30]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.25, 1), ("b", 0.25, 1), ("c", 0.5, 1)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixture, "MAX_PATTERNS", 1, raising=False)
    by = {r.source: r for r in mixture.mix_report(mixture.mix(d, "doc_id", "text", "source", t), "source", t).collect()}
    assert by["c"].share == pytest.approx(0.5, abs=0.05)


def test_mixture_plan_uses_repeats_last():
    quota, flows = mixture.plan([(("a",), 100), (("b",), 100), (("a", "b"), 50)], {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2})
    assert abs(quota["a"] - quota["b"]) <= 1 and quota["a"] == 150
    assert sum(n for (_, use), to in flows.items() for _, n in to if use == 2) == 50


def test_mixture_goes_on_without_a_source_that_has_no_text():
    quota, flows = mixture.plan([(("a",), 1000), (("b",), 1000)], {"a": 0.5, "b": 0.49, "c": 0.01}, {"a": 1, "b": 1, "c": 1})
    assert "c" not in quota and quota["a"] >= 999 and quota["a"] / quota["b"] == pytest.approx(0.5 / 0.49, rel=0.01)


def test_leaks_in_blocks_equal_one(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(300)]
    items = [[rng.choice(vocab) for _ in range(60)] for _ in range(12)]
    docs = [[rng.choice(vocab) for _ in range(40)] + items[i % 12][5 : 5 + 18 + i] + [rng.choice(vocab) for _ in range(40)] for i in range(30)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    index = leaks.build_index(d, "doc_id", "text")
    want = sorted(tuple(r) for r in leaks.search(index, e, "item_id", "text").collect())
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 5)
    assert sorted(tuple(r) for r in leaks.search(index, e, "item_id", "text").collect()) == want
    assert {(i, i % 12) for i in range(2, 30)} <= {x[:2] for x in want}  # from 20 of 60 words on


def test_phrase_is_where_all_lists_meet():
    import numpy as np

    text = [random.Random(k).randrange(4) for k in range(400)]
    at = {t: np.array([i for i, x in enumerate(text) if x == t]) for t in range(4)}
    for phrase in ([0, 1], [2, 2, 3], [1, 0, 3, 3]):
        lists = sorted(((at[t], j) for j, t in enumerate(phrase)), key=lambda x: len(x[0]))
        assert leaks.intersected(lists).tolist() == [i for i in range(len(text)) if text[i : i + len(phrase)] == phrase]
