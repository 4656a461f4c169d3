import random
import re
import time
from collections import Counter

from semloom.llm import licenses

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(rng, phrase, n):
    out = list(phrase)
    for _ in range(n):
        k, kind = rng.randrange(1, len(out) - 1), rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice("qxz")
        elif kind == 1:
            out.insert(k, rng.choice("qxz"))
        else:
            del out[k]
    return "".join(out)


def test_edits_within_bounds_are_found_and_spans_hold():
    rng, look = random.Random(6), licenses.scanner()
    for _ in range(300):
        k = rng.randrange(len(licenses.NOTICES))
        notice = licenses.NOTICES[k]
        hit = edited(rng, notice.phrase, rng.randrange(notice.errors + 1))
        text = " ".join(["lorem ipsum"] * rng.randrange(3) + [hit] + ["dolor sit"] * rng.randrange(3))
        found = [x for x in look(text) if x[0] == k]
        assert found, (notice, text)
        for n, start, end, errors in look(text):
            assert distance(text[start:end], licenses.NOTICES[n].phrase) <= errors <= licenses.NOTICES[n].errors
    assert look("") == [] and look("mit") == []


def test_report_against_brute_force(spark):
    rng = random.Random(9)
    bits = ["MIT", "License", "mit-license", "Apache", "general", "PUBLIC", "license", " ", "\n", "limit", "licenses", "GNU", "é", "Mit Licence", "all rights reserved."]
    rows = [(i, rng.choice([" ", ", "]).join(rng.choice(bits) for _ in range(rng.choice([0, 3, 20, 200])))) for i in range(150)] + [(900, None), (None, "MIT License"), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, labels string")
    got = licenses.report(df).collect()
    want = [(i, *brute_base(t)) for i, t in rows]
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == sorted(want, key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0) for r in got)
    assert licenses.report(df.limit(0)).count() == 0


def brute_places(text):
    starts, ends = [m.start() for m in re.finditer(r"(?<![^ ])[^ ]", text)], [m.end() for m in re.finditer(r"[^ ](?![^ ])", text)]
    out = []
    for k, n in enumerate(licenses.NOTICES):
        spans = [(s, e) for s in starts for e in ends if abs(e - s - len(n.phrase)) <= n.errors]
        near = sorted((d, s, e) for s, e in spans if (d := distance(text[s:e], n.phrase)) <= n.errors)
        taken = []
        for d, s, e in near:
            if not d or all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                out.append((k, s, e, d))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def test_added_ends_and_neighbours_against_all_spans():
    rng, look = random.Random(4), licenses.scanner()
    for text, errors in (("mit licensed", [1]), ("general public licenses", [1]), ("all rights reservedd", [1]), ("mit licence mit license", [1, 0])):
        assert [x[3] for x in look(text) if licenses.NOTICES[x[0]].phrase[:3] == text[:3]] == errors, text
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            notice = rng.choice(licenses.NOTICES)
            hit = edited(rng, notice.phrase, rng.randrange(notice.errors + 1))
            parts += [rng.choice(["", "x"]) + hit + rng.choice(["", "d", "s"]), *["lorem"] * rng.randrange(2)]
        text = " ".join(" ".join(parts).split())
        assert look(text) == brute_places(text), text


def test_all_places_of_edited_neighbours():
    look = licenses.scanner()
    labels = lambda text: sorted((licenses.NOTICES[k].label, n) for k, _, _, n in look(text) if licenses.NOTICES[k].base)
    assert labels("mit licens mit license") == [("mit", 0), ("mit", 1)]
    assert labels("apache licens mit licens apache license") == [("apache", 0), ("apache", 1), ("mit", 1)]
    assert len(look("mit licens " * 500)) == 500
    assert len(look(" ".join(["mit licens"] * 90_000))) == 90_000  # about 1 MB of near places alone


def test_a_long_text_of_different_near_places_takes_seconds():
    rng = random.Random(3)
    notices = [n for n in licenses.NOTICES if n.errors > 1]
    text = " ".join(" ".join([edited(rng, rng.choice(notices).phrase, 2), "lorem"]) for _ in range(25_000))
    began = time.process_time()
    found = licenses.Scanner()(text)
    assert len(found) >= 25_000 and time.process_time() - began < 60


def test_labels_with_errors_against_all_spans(spark):
    rng, rows = random.Random(12), []
    for i in range(120):
        hits = [edited(rng, n.phrase, rng.randrange(n.errors + 2)) for n in rng.choices(licenses.NOTICES, k=rng.randrange(4))]
        rows.append((i, " ".join(" ".join([h, *["Lorem"] * rng.randrange(3)]) for h in hits)))
    rows += [(200, None), (201, ""), (202, "mit licence, MIT licence"), (202, "mit licence, MIT licence")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.labels, r.n_fuzzy) for r in licenses.report(df).collect())
    want = Counter()
    for i, t in rows:
        places = brute_places(" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())))
        names = {licenses.NOTICES[k].label + ("-like" if d else "") for k, _, _, d in places}
        want[i, ",".join(sorted(names)), sum(d > 0 for *_, d in places)] += 1
    assert got == want
