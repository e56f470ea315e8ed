"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tallyframe.llm.variants import near_words, spelling_variants

from .data import CLASHES, EDGES, SCHEMA, corpus


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, least, count, ratio, slip):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    out, form = {}, {}
    for w in words:
        near = [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
        out[w] = (words[w], len(near), form[w], words[form[w]] if form[w] else None)
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w] += (end,)
    return out


def got(frame):
    rows = [tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_variants_are_those_of_brute_force(spark):
    rng = random.Random(9)
    chain = ["handling"] * 400 + ["handlling"] * 40 + ["handllingo"] * 4 + ["tapping", "tapping", "taping"] * 3
    accents = ["éléphant"] * 30 + ["elephant"] * 3 + ["Éléphant"] * 3 + ["straßen÷x", "straßen×x"] * 2
    loose = chain + accents + [w.upper() for w in chain[:50]]
    rng.shuffle(loose)
    rows = [(i, t, None, None, None) for i, (_, t, *_) in enumerate(corpus(120))]
    rows += [(1000 + i, " ".join(loose[i::7]), None, None, None) for i in range(7)] + EDGES
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for least, ratio, slip in ((7, 10, 31), (5, 3, 4), (1, 2, None)):
        want = plain(rows, least, 2, ratio, slip)
        assert got(spelling_variants(frame, least, 2, ratio, slip)) == want and any(v[2] for v in want.values())
    assert plain(rows, 7, 2, 10, None)["handllingo"][2:] == ("handlling", 40, "handling")


def test_short_alphabets_have_large_groups(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 9))) for _ in range(500)})
    pairs = [(r.a, r.b) for r in near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs))
    assert {tuple(sorted(p)) for p in pairs} == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_edges(spark):
    frame = spark.createDataFrame(EDGES, SCHEMA)
    clashing = frame.selectExpr("*", *[f"'other' AS {c}" for c in (*CLASHES, "form", "root", "signature", "up", "a", "b")])
    assert got(spelling_variants(clashing, 4, 2)) == plain(EDGES, 4, 2, 10, None)
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
