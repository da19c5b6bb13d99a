"""Operators on documents against brute-force versions."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from dendrolake.llm import exact_dedup, jaccard_join, language_id, license_scan, packing, surrogates, windows

KEY = b"test"


# surrogates

def test_surrogates_keep_format_coreference_and_distinctness(make):
    people = "".join(f"Mr. Name{chr(97 + i % 26)}{chr(97 + i // 26)} Sur{chr(97 + i % 26)}{chr(97 + i // 26)}. " for i in range(60))
    rows = [
        (1, "mail Ann.B@Corp.example.com or ann.b@corp.example.com, call +1 (212) 555-7713 or +12125557713"),
        (2, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" card 4111 1111 1111 1111 ip 10.20.30.40'),
        (3, "nothing to see, version 3.0 of 2024"), (4, None), (5, ""), (6, people), (6, people), (None, "ann.b@corp.example.com"),
        (7, "г-жа Анна Иванова и Frau ERIKA Mustermann"),
    ]
    got = surrogates.pseudonymise(make(rows), KEY).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].text == rows[2][1] and by[3].n_entities == 0 and by[4].text is None and by[5].text == ""
    a, b = [e.surrogate for e in by[1].entities if e.kind == "email"]
    assert a.lower() == b and b != "ann.b@corp.example.com" and b.endswith(".com") and a[0].isupper()
    assert by[None].text == b
    x, y = [e.surrogate for e in by[1].entities if e.kind == "phone"]
    assert "".join(filter(str.isdigit, x)) == y[1:] and x.startswith("+1 (")
    secret, card, ip = [e.surrogate for e in by[2].entities]
    assert len(secret) == 40 and set(secret) <= set("0123456789abcdef")
    digits = card.replace(" ", "")
    assert card[4] == " " and digits[0] == "4" and surrogates.luhn_digit(digits[:-1]) == digits[-1]
    assert all(0 < int(v) < 256 for v in ip.split("."))
    names = [e.surrogate for e in by[6].entities]
    assert len(names) == len(set(names)) == 120 and not any("-" in x for x in names)  # more given names than the list has
    names = [e.surrogate for e in by[7].entities]
    assert names[0] in surrogates.GIVEN["cyrillic", "f"] and names[2].isupper() and names[2].title() in surrogates.GIVEN["latin", "f"]
    originals = {t for _, t in [(r[0], r[1]) for r in rows] if t}
    assert not any(e.surrogate in originals for r in got for e in r.entities)


def test_one_person_is_one_entity_under_any_form(make):
    text = "Mr. Adam Smith met Prof. Dr. Anna Weber. Later Smith said Adam left; Dr. Adam Smith's friend WEBER, Frau Dr. Anna Weber, stayed. Mr. John F. Kennedy and Frau von der Leyen came."
    row = surrogates.pseudonymise(make([(1, text), (2, "Mrs. Adam Jones"), (3, "Mr. Adam Jones")]), KEY).where("doc_id = 1").first()
    new = {}
    for e in row.entities:
        new.setdefault(text[e.start: e.start + e.length].lower(), set()).add(e.surrogate.lower())
    assert set(new) == {"adam", "smith", "anna", "weber", "john", "f", "kennedy", "leyen"}
    assert all(len(x) == 1 for x in new.values()) and len(set.union(*new.values())) == len(new)
    assert not any(w in row.text.lower() for w in ("smith", "adam", "anna", "weber", "kennedy", "leyen")) and " F. " not in row.text
    assert "Prof. Dr. " in row.text and "Frau von der " in row.text and "'s friend" in row.text
    assert new["anna"].pop().title() in surrogates.GIVEN["latin", "f"] and new["adam"].pop().title() in surrogates.GIVEN["latin", "m"]


def test_surrogates_are_distinct_whatever_the_form_of_address(make):
    import re

    rng, names = random.Random(2), set()
    while len(names) < 180:
        names.add("".join(rng.choices("bcdfgklmnprst", k=1) + rng.choices("aeiou", k=1) + rng.choices("bcdfgklmnprst", k=2)).title() + rng.choice("aeo"))
    names = sorted(names)
    rows = [(i, f"{form} {x} {y} spoke. {y} agreed with {x}.") for i, (x, y, form) in enumerate(zip(names[:90], names[90:], ["Mr.", "Mrs.", "Dr."] * 30))]
    got = surrogates.pseudonymise(make(rows), KEY).collect()
    maps = {}
    for r in got:
        old, new = (re.findall(r"[A-Z]\w+", t)[1:] for t in (rows[r.doc_id][1], r.text))
        assert len(old) == len(new) == 4
        for x, y in zip(old, new):
            assert maps.setdefault(x, y) == y
    assert len(set(maps.values())) == 180 and not set(maps.values()) & set(names)


def test_surrogates_need_a_key_and_enough_values(make, spark):
    with pytest.raises(ValueError):
        surrogates.pseudonymise(make([]), b"")
    full = spark.createDataFrame([("initial", c, "") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, value string, form string")
    with pytest.raises(RuntimeError):
        surrogates.settle(full, KEY, surrogates.Scratch(spark, "test"), attempts=2)


def test_surrogates_keep_the_script_of_any_letter_and_long_texts(make):
    mail = "дом.ñé٣@пример.рф"
    text = "x " * 200_000 + mail + " שלום \"token\": \"שלוםשלום\" "
    row = surrogates.pseudonymise(make([(1, text)]), KEY).first()
    new = row.entities[0].surrogate
    assert [surrogates.script_of(c) for c in new] == [surrogates.script_of(c) for c in mail] and new != mail and new[6].isdecimal() and len(row.text) == len(text)


def test_surrogates_differ_by_key_and_agree_between_runs(make):
    df = make([(1, "a.b@c.org 1.2.3.4")])
    one, two, other = (surrogates.pseudonymise(df, k).first().text for k in (KEY, KEY, b"else"))
    assert one == two != other


def test_surrogates_of_an_empty_table(make):
    assert surrogates.pseudonymise(make([]), KEY).count() == 0


# license scans

def test_patience_pairs_are_increasing_and_equal():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    text = list(range(30))
    assert len(license_scan.patience(text, text[:10] + [99] + text[10:])) == 30


def best_coverage(text, template):
    """Longest common subsequence over all spans of the allowed length, as a share of the template."""
    w, best = license_scan.words_of(text), 0
    span = int(license_scan.STRETCH * len(template))
    for at in range(max(1, len(w) - span + 1)):
        part, row = w[at: at + span], [0] * (len(template) + 1)
        for x in part:
            prev = 0
            for j, y in enumerate(template, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        best = max(best, row[-1])
    return best / len(template)


def test_licenses_are_found_and_others_are_not(make, words):
    t = license_scan.TEMPLATES
    rows = [
        (1, words(50, 1) + " " + t["MIT"] + " " + words(50, 2)), (2, words(80, 3)), (3, "Released under the MIT License. Released under the MIT License."),
        (4, t["Apache-2.0"].replace("compliance", "agreement").upper()), (5, None), (6, ""), (7, "the the the license license under"), (9, words(9, 4) + "\n" + t["CC-BY-NC-4.0-notice"]),
        (8, t["BSD-2-Clause"][:60]), (None, t["ISC"]),
    ]
    got = license_scan.license_matches(make(rows)).collect()
    found = sorted((r.doc_id or 0, r.license) for r in got)
    assert found == [(0, "ISC"), (1, "MIT"), (3, "MIT-notice"), (3, "MIT-notice"), (4, "Apache-2.0"), (9, "CC-BY-NC-4.0-notice")]
    for doc_id, text in rows:
        for name, template in t.items():
            if (doc_id or 0, name) in found:
                assert best_coverage(text, license_scan.words_of(template)) >= 0.8
    assert license_scan.license_matches(make([])).count() == 0


def test_relatives_are_told_apart_and_none_is_missed(make, words):
    t, rng, rows, want = license_scan.TEMPLATES, random.Random(6), [], set()
    for i, (name, template) in enumerate(sorted(t.items())):
        w = template.split()
        free = [k for k in range(1, len(w) - 1) if not set(license_scan.words_of(w[k])) & license_scan.TELLING]
        for k in rng.sample(free, len(w) // 12):  # some words changed, none that tells it from its relatives
            w[k] = "changed"
        for copy in range(2):  # repeated rows
            rows.append((i, words(30, i) + " " + " ".join(w) + " " + words(3000 if i == 5 else 30, i + 500)))
            want.add((i, name))
    rows += [(900, "GNU General Public License, version 4"), (901, "Licensed under CC BY-XX 4.0."), (902, words(60_000, 3) + " Licensed under CC BY 4.0."), (902, "This work is licensed under the GNU General Public License, version 2.")]
    got = [(r.doc_id, r.license) for r in license_scan.license_matches(make(rows)).collect()]
    assert {x for x in got if x[0] < 900} == want and all(got.count(x) == 2 for x in want)
    assert {x for x in got if x[0] >= 900} >= {(902, "CC-BY-4.0-notice"), (902, "GPL-2.0-notice")} and not any(x[0] == 900 for x in got)


# Jaccard join

def shingles(text):
    w = (text or "").split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    sets = {d: shingles(t) for d, t in rows}
    links = {(a, b) for a, b in combinations(sets, 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {d: (find(d), sum(d in x for x in links)) for d in sets}


def near_copies(words, n, seed):
    """Documents of several families: copies with a few words changed, and a long hot family."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        family = rng.choice([0, 0, 0, 1, 2, 3, 4 + i])
        w = words(120, 1000 + family).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = "changed%d" % rng.randrange(3)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("limit", [256, 4])
def test_jaccard_equals_brute_force(make, words, monkeypatch, limit):
    monkeypatch.setattr(jaccard_join, "LIMIT", limit)  # 4: nodes are split many times
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 32 if limit == 4 else 512)
    rows = near_copies(words, 150, 3) + [(500, None), (501, ""), (502, "a b"), (503, "a  b"), (504, "a b c"), (505, " "), (506, words(9000, 5)), (507, words(9000, 5) + " end")]
    got = {r.doc_id: r for r in jaccard_join.classes(make(rows)).collect()}
    want = brute_classes(rows)
    for d, (root, links) in want.items():
        assert (got[d].class_id, got[d].n_links, got[d].kept) == (root, links, root == d), d


def test_jaccard_of_repeated_rows_and_null_ids_equals_brute_force(make, words):
    rng = random.Random(14)
    rows = near_copies(words, 60, 9)
    rows += [rng.choice(rows) for _ in range(40)]  # repeated rows, also of near copies
    rows += [(None, rows[i][1]) for i in (0, 3, 3)] + [(None, words(60, 77)), (None, words(60, 77) + " end"), (None, None), (7, rows[1][1])]  # 7 twice, with different texts
    sets = [shingles(t) for _, t in rows]
    n, root = [0] * len(rows), list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            n[i], n[j] = n[i] + 1, n[j] + 1
            root = [root[i] if x == root[j] else x for x in root]
    least = {r: min((rows[i][0] for i, x in enumerate(root) if x == r and rows[i][0] is not None), default=None) for r in root}
    want = [(d, least[root[i]], n[i], d == least[root[i]]) for i, (d, _) in enumerate(rows)]
    got = jaccard_join.classes(make(rows)).select("doc_id", "class_id", "n_links", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_jaccard_of_repeats_and_nothing(make):
    assert jaccard_join.classes(make([])).count() == 0
    text = "one two three four five six seven eight nine ten eleven twelve"
    got = jaccard_join.classes(make([(1, text), (1, text), (2, text + " more")])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert sorted((r.doc_id or 0, r.text) for r in jaccard_join.one_of_each(make([(None, "a b"), (1, "a b"), (2, "a b"), (None, "c")])).collect()) == [(0, "c"), (1, "a b")]


def test_runs_meet_the_target():
    assert jaccard_join.runs_needed(0.8, 0.999) == 3


# language identification

def test_languages_of_held_out_texts(make):
    rng = random.Random(2)
    sounds = {"aa": ["ba", "na", "ko", "ra"], "bb": ["sch", "ung", "ei", "ver"], "cc": ["eau", "oux", "tre", "ç"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[x], k=3)) for _ in range(60)), x) for i in range(150) for x in [["aa", "bb", "cc"][i % 3]]]
    rows += [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "", None), (903, "bakora nakora", None), (904, rows[0][1].upper(), "aa"), (904, rows[0][1].upper(), "aa")]
    df = make(rows)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == 155
    assert all(got[i].lang_pred == r[2] and 0 <= got[i].score <= 1 for i, r in enumerate(rows[:150]))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred == "aa"
    out = language_id.identified_documents(df)
    assert out.columns == df.columns and out.where("doc_id IN (900, 901, 902)").count() == 0 and out.count() >= 150


def test_languages_equal_plain_compression(make, words):
    import re

    import zstandard

    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcde" if i % 2 else "defgh", k=4)) for _ in range(rng.randint(1, 400))), "xy"[i % 2]) for i in range(60)]
    rows += [(100, rows[0][1] * 300, None), (101, rows[1][1].upper() * 300, None), (102, "é ñ 7", None)]  # very long texts
    df = make(rows)
    model = language_id.learn(df)
    assert all(len(v) <= language_id.SAMPLE_ROWS * (language_id.SAMPLE_CHARS + 1) for v in model.values())
    got = {r.doc_id: r for r in language_id.classify(df, model).collect()}
    for d, text, _ in rows:
        letters = re.sub("[^a-zà-ÿ]+", " ", text.lower()).strip().encode()
        sizes = {}
        for name, content in model.items():
            packer = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
            sizes[name] = sum(len(packer.compress(letters[i: i + language_id.CHUNK_BYTES])) for i in range(0, len(letters), language_id.CHUNK_BYTES))
        least = min(sizes.values())
        assert sizes[got[d].lang_pred] == least, (d, sizes)
        assert got[d].margin == pytest.approx((max(sizes.values()) - least) / max(sizes.values())) and got[d].rejected == (got[d].margin < language_id.MIN_MARGIN)


def test_samples_come_from_anywhere_in_a_text(make):
    text = "".join(chr(97 + i // 1000) * 1000 for i in range(20000))
    learned = language_id.learn(make([(i, text, "en") for i in range(40)]))["en"]
    assert len(set(learned.decode()) - {" "}) > 10


def test_language_of_nothing(make):
    assert language_id.identify(make([])).count() == 0
    assert {r.lang_pred for r in language_id.identify(make([(1, "abc", None)])).collect()} == {"und"}


# exact dedup

def brute_copies(rows):
    import hashlib
    import re

    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(d)
    out = []
    for t, ids in groups.items():
        keep = min((x for x in ids if x is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["plain", "weak digest", "many batches"])
def test_exact_dedup_equals_brute_force(make, words, how):
    rng = random.Random(4)
    rows = [(i, words(5, rng.randrange(25)).replace(" ", rng.choice([" ", "\n", " \t"]))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n"), (None, "lonely"), (None, words(5, 1)), (5, rows[5][1]), (300, "a b"), (301, "a b"), (302, words(30000, 1)), (303, words(30000, 1))]
    kinds = {"plain": {}, "weak digest": {"digest": lambda t: F.unhex(F.substring(F.md5(t), 1, 1))}, "many batches": {"waves": 7, "digest": lambda t: F.unhex(F.substring(F.md5(t), 1, 2))}}
    got = exact_dedup.dedup(make(rows, parts=5), **kinds[how]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_copies(rows)


def test_exact_dedup_of_nothing_and_of_rows_that_repeat(make):
    assert exact_dedup.dedup(make([])).count() == 0
    df = make([(1, "x  y"), (1, "x y"), (2, "x y"), (3, "z"), (3, "other")])
    out = exact_dedup.unique_documents(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text.replace("  ", " ")) for r in out.collect()) == [(1, "x y"), (3, "other"), (3, "z")]


# compact windows

def test_windows_are_the_cartesian_tree():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 40):
        h = rng.integers(0, 12, n).astype(np.uint64)
        got = sorted(zip(*(x.tolist() for x in windows.compact_windows(h, np.array([0]), np.array([n]), 3))))
        want = []

        def split(a, b):
            if b - a >= 3:
                c = a + int(h[a:b].argmin())
                want.append((c, a, b - 1))
                split(a, c), split(c + 1, b)

        split(0, n)
        assert got == sorted(want)


def passages_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.start, r.start + r.n_words))
    return out


def test_equal_passages_are_all_found(make, words):
    rng = random.Random(8)
    shared = [words(n, 50 + n) for n in (50, 51, 60, 120, 400)]
    rows = []
    for i in range(40):
        parts = [words(rng.randint(0, 200), 100 + i)]
        if i % 2 == 0:
            parts += [shared[i // 2 % 5], words(rng.randint(1, 90), 300 + i)]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "short"), (103, " ".join([words(55, 9), words(70, 10), words(55, 9)])), (None, shared[0]), (104, words(20000, 11)), (105, words(30, 12)), (106, words(30, 12))]
    got = passages_of(windows.repeated_passages(make(rows)))
    seen, true = {}, set()
    for d, t in rows:
        w = (t or "").split() if d is not None else []
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i: i + 50]), []).append((d, i))
    for places in seen.values():
        if len({d for d, _ in places}) > 1 or max(i for _, i in places) - min(i for _, i in places) >= 50:
            for d, i in places:
                true.add(d)
                assert any(min(b, i + 50) - max(a, i) >= 40 for a, b in got.get(d, [])), (d, i)
    assert set(got) == true
    assert 103 in got and len(got[103]) == 2


def test_changed_passages_are_mostly_found(make, words):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        w = words(90, 700 + i // 2).split()
        if i % 2:
            # no equal run of fifty words is left
            if i % 4 == 1:
                w.insert(45, "inserted")
            else:
                for at in range(11 + i % 7, 90, 45):
                    w[at] = "other"
        rows.append((i, words(40, 2000 + i) + " " + " ".join(w) + " " + words(40, 3000 + i)))
    rows += [(200 + i, words(150, 5000 + i)) for i in range(20)]
    got = passages_of(windows.repeated_passages(make(rows)))
    assert not [d for d in got if d >= 200]
    hit = sum(any(min(b, 130) - max(a, 40) >= 40 for a, b in got.get(i, [])) for i in range(60))
    assert hit >= 54, hit


def test_changed_copies_of_passages_with_exact_copies_are_found(make, words):
    rows = []
    for i in range(30):
        w = words(60, 8000 + i).split()
        changed = [" ".join(w[:at] + ["other"] + w[at + 1:]) for at in (30, 33)]
        rows += [(4 * i + n, " ".join([words(40, 9000 + 4 * i + n), text, words(40, 9500 + 4 * i + n)])) for n, text in enumerate([" ".join(w)] * 2 + changed[i % 2:][:1])]
    got = passages_of(windows.repeated_passages(make(rows)))
    assert all(4 * i in got and 4 * i + 1 in got for i in range(30))
    hit = sum(any(min(b, 100) - max(a, 40) >= 40 for a, b in got.get(4 * i + 2, [])) for i in range(30))
    assert hit >= 27, hit


def places_of_signatures(spark, texts, groups):
    """Windows that give the places 60 of each group of documents one signature, and no covered spans."""
    rows = [(d, [(4 * n + k, 60, 119) for n, members in enumerate(groups) if d in members for k in (0, 1)]) for d in texts]
    kept = spark.createDataFrame(rows, "doc_id long, windows array<struct<key:long,c:int,lr:long>>")
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string"), kept, spark.createDataFrame([], "doc_id long, start int, n_words int")


@pytest.mark.parametrize("limit", (512, 16))
def test_changed_copies_meet_in_large_signatures(spark, words, monkeypatch, limit):
    monkeypatch.setattr(windows, "BLOCK", limit, raising=False)
    texts = {}
    for i in range(8):  # four families of two copies among many unrelated texts of the same signature
        w = words(130, 600 + i // 2).split()
        w[58:66] = "a frequent line of some eight words".split() + ["x"]
        w[20 + i % 2] = w[100 - i % 2] = "other"
        texts[i] = " ".join(w)
    texts |= {i: words(130, 4000 + i) for i in range(8, 200)}
    got = windows._changed(*places_of_signatures(spark, texts, [set(texts)]), 50, 0.8, windows.Scratch(spark, "test"))
    assert {r.doc_id for r in got.collect()} == set(range(8))


def test_matched_places_stay_partners(spark, words, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 4, raising=False)
    texts, groups = {}, []
    for i in range(12):  # p is like q up to its anchor and like z from there
        p, at = words(130, 7000 + i).split(), 20 * i
        for n, part in enumerate((slice(0, 130), slice(10, 66), slice(58, 115))):
            w = words(130, 7100 + at + n).split()
            w[part] = p[part]
            texts[at + n] = " ".join(w)
        texts |= {at + n: words(130, 7500 + at + n) for n in range(3, 14)}
        groups += [{at, at + 1, *range(at + 3, at + 6)}, {at, at + 2, *range(at + 6, at + 14)}]
    got = windows._changed(*places_of_signatures(spark, texts, groups), 50, 0.8, windows.Scratch(spark, "test"))
    assert {r.doc_id for r in got.collect()} == {20 * i + n for i in range(12) for n in range(3)}


def test_repeated_rows_are_one_document(make, words):
    text = " ".join([words(30, 1), words(60, 2), words(30, 3)])
    alone = windows.repeated_passages(make([(1, text), (1, text), (2, words(100, 4))]))
    assert alone.count() == 0
    both = passages_of(windows.repeated_passages(make([(1, text), (1, text), (2, words(20, 5) + " " + words(60, 2))])))
    assert set(both) == {1, 2}


def test_passages_of_nothing(make):
    assert windows.repeated_passages(make([])).count() == 0


# packing

SPECIAL = [
    "İstanbul <|endoftext|> ǅ", "áé", "it's I'LL 'tis", "x1y2 3.5%", "日本語 テキスト", "ΣΑΣ ς", " wide space", "ﬁ ligature", "K kelvin", "", "  a  b\x1cc \x0b\n",
    "ȺȾ. Ⱥ?", "hello <|endoftext|> world", "ab<|startoftext|>cd. <|ENDOFTEXT|>", "a</w> b", "é \u0301x", "µ ª. ŉ", "..., #a b# !!??", "don't. WE'RE'", "\ud7ff \ue000",
]


def check_packing(got, want, window=2048):
    """want: doc_id -> lists of ids, one for each of its rows."""
    import numpy as np

    pieces, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and r.offset + r.length <= window
        pieces.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for d, texts in want.items():
        assert sorted(x for p in pieces[d] for x in p[1]) == sorted(x for y in texts for x in y)
        if len(texts) == 1:
            assert sum((p[1] for p in sorted(pieces[d])), []) == texts[0] and all(p[2] == len(texts[0]) for p in pieces[d])
    for s, parts in sequences.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_round_trip(make, words):
    import zlib

    from tokenizers import Tokenizer

    rng = random.Random(5)
    rows = [(i, words(rng.randint(1, 300), i), "en", [None, "a", "b", "c"][min(3, i % 7)]) for i in range(60)] + [(100 + i, t, "en", "d") for i, t in enumerate(SPECIAL)]
    rows += [(200, None, "en", "a"), (200, None, "en", "a"), (None, "no id", "en", "a"), (201, words(8000, 3), "en", "b")]
    got = packing.pack(make(rows)).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())  # as it is: special tokens in a text are special tokens
    want = {}
    for d, text, *_ in rows:
        want.setdefault(d, []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    check_packing(got, want)
    assert 49407 in want[112][0]
    assert {r.ids_crc32 for r in packing.digests(make(rows)).collect()} == {zlib.crc32(r.ids) for r in got}


def test_a_full_cache_of_parts_changes_nothing(words, monkeypatch):
    import pyarrow as pa

    texts = [words(40, i) + " Tail" + str(i) + "... x" for i in range(30)] + SPECIAL
    whole, lengths = packing.Ids(packing.default_tokenizer()).encode(pa.array(texts), 1)
    monkeypatch.setattr(packing, "KNOWN", 20)
    small = packing.Ids(packing.default_tokenizer())
    assert [x for t in texts for x in small.encode(pa.array([t]), 1)[0].tolist()] == whole.tolist()


def test_grains_have_each_place_once():
    import numpy as np

    rng = random.Random(12)
    for _ in range(30):
        sizes, levels = [rng.choice([0, 1, 3, rng.randrange(400)]) for _ in range(rng.randrange(1, 12))], 4
        places, sent = [], []
        for s, size in enumerate(sizes):
            node = [[sum(n for i, n in enumerate(sizes) if i >> levels - d == s >> levels - d) for d in range(levels)]]
            first = [[sum(n for i, n in enumerate(sizes) if i >> levels - d - 1 == (s >> levels - d) * 2) for d in range(levels)]]
            other = [[bool(s >> levels - d - 1 & 1) for d in range(levels)]]
            total, first, other = (np.repeat(np.array(x), size, 0) for x in (node, first, other))
            places.append(packing.grain_places(np.arange(size), total, first, other, 8).tolist())
        assert sorted(sum(places, [])) == list(range(sum(sizes)))
        for p, size in zip(places, sizes):  # the order of a queue stays, and its share of any windows is within a grain a level
            assert p == sorted(p)
            assert all(abs(sum(x < 8 * w for x in p) - 8 * w * size / sum(sizes)) <= levels for w in range(sum(sizes) // 8))
    t, n = np.array([2**44 + 12345, 7]), np.array([2**45 - 1, 2**49])
    q, rest = packing.divided(t, np.array([2**43 + 1, 2**48]), n)
    assert [(int(a), int(b)) for a, b in zip(q, rest)] == [divmod(int(x) * y, int(z)) for x, y, z in zip(t, (2**43 + 1, 2**48), n)]


@pytest.mark.parametrize("sources", [3, 20, 600])
def test_windows_follow_the_mixture(make, words, sources):
    rows = [(i, words(120, i), "en", f"s{i % sources * (i % 3 > 0)}") for i in range(1200)]
    source = {r[0]: r[3] for r in rows}
    got = packing.pack(make(rows)).collect()
    total, size, by = sum(r.length for r in got), {}, {}
    for r in got:
        size[source[r.doc_id]] = size.get(source[r.doc_id], 0) + r.length
        here = by.setdefault(r.sequence_id, {})
        here[source[r.doc_id]] = here.get(source[r.doc_id], 0) + r.length
    levels = max(1, (len(size) - 1).bit_length())
    left = sum(n % packing.GRAIN for n in size.values())
    sent = dict.fromkeys(size, 0)
    for k in range((total - left) // 2048):
        for s in size:
            share = (size[s] - size[s] % packing.GRAIN) / (total - left) * 2048
            assert abs(by[k].get(s, 0) - share) <= 2 * levels * packing.GRAIN
            sent[s] += by[k].get(s, 0)
            assert abs(sent[s] - share * (k + 1)) <= levels * packing.GRAIN
        if sources < 600:  # in every window, not only in the long run
            assert len(by[k]) >= 0.9 * len(size)
    assert {s for here in by.values() for s in here} == set(size)


def test_packing_of_nothing(make):
    assert packing.pack(make([])).count() == 0
