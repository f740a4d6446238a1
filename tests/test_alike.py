"""Texts that are most alike: no pairs are kept, few are compared, and results are those of difflib."""

import random
from difflib import SequenceMatcher

import pytest

from lodegraph.operators import alike, linking


def texts(r, n):
    return [f"As shown in Figure {r.randrange(12)} and [{r.randrange(9)}] Table {r.randrange(12)}. Eq. {r.randrange(8)}" * r.choice([1, 1, 1, 4]) for _ in range(n)]


def ratio(a, b):
    return SequenceMatcher(None, a[:200], b[:200]).ratio()


def test_matched_is_that_of_difflib():
    r = random.Random(3)
    for letters in ("ab", "abc d", "abcdefgh é𝒳"):
        for _ in range(300):
            a, b = ("".join(r.choices(letters, k=r.choice([0, 5, 60, 199, 200]))) for _ in range(2))
            assert alike.matched(a, b) == sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks())


def test_best_compares_few_and_forgets(monkeypatch):
    monkeypatch.setattr(alike, "REMEMBER", 64)
    monkeypatch.setattr(alike, "_memo", None)
    compared, matched = [], alike.matched
    monkeypatch.setattr(alike, "matched", lambda a, b: compared.append(1) or matched(a, b))
    r = random.Random(4)
    for _ in range(6):
        there, asking = texts(r, 50), texts(r, 50)
        block = alike.Block(there)
        for t in asking:
            scores = [ratio(t, x) for x in there]
            want = (scores.index(max(scores)), max(scores)) if max(scores) >= 0.9 else None
            assert block.best(t, 0.9, lambda x, k: x) == want
    assert len(compared) < 6 * 50 * 50 / 4


@pytest.fixture()
def kept(monkeypatch):
    """How many rows each table has that linking keeps."""
    rows, cut = [], linking.cut

    def counted(d):
        d = cut(d)
        rows.append(d.count())
        return d

    monkeypatch.setattr(linking, "cut", counted)
    return rows


def sides(spark, n=70):
    r = random.Random(5)
    rows = [(f"d{i % 2}", f"{'vf'[side]}{i}", i, r.choice(["figure", "table"]), t) for side in (0, 1) for i, t in enumerate([*texts(r, n), "", None])]
    make = lambda side, name: spark.createDataFrame([x for x in rows if x[1][0] == side], f"doc_id string, {name} string, ord int, type string, text string")
    return rows, make("f", "file"), make("v", "id")


def test_pairs_of_visuals_are_not_kept(spark, kept):
    rows, f, v = sides(spark)
    want = {}
    for d, file, _, kind, t in rows:
        scores = [(-ratio(t, x[4]), x[2], x[1]) for x in rows if file[0] == "f" and x[1][0] == "v" and x[0] == d and x[3] == kind and t and x[4]]
        if scores and min(scores)[0] <= -0.5:
            want[d, file] = (min(scores)[2], -min(scores)[0])
    for block in (7, 512):
        assert {(x.doc_id, x.file): (x.id, x.similarity) for x in linking.alike_visuals(f, v, block=block).collect()} == want
    assert len(want) > 60 and max(kept) <= len(rows)


def test_wishes_are_not_kept(spark, kept):
    rows, f, v = sides(spark)
    want, taken = {}, set()
    for d, who, _, kind, t in sorted((x for x in rows if x[1][0] == "v"), key=lambda x: x[2]):
        scores = [(-ratio(t, x[4]), x[2], x[1]) for x in rows if x[1][0] == "f" and x[0] == d and x[3] == kind and t and x[4] and (d, x[1]) not in taken]
        if scores and min(scores)[0] <= -0.6:
            want[d, who] = (min(scores)[2], -min(scores)[0])
            taken.add((d, min(scores)[2]))
    told = lambda d: {(x.doc_id, x.id): (x.file, x.similarity) for x in d.collect()}
    assert told(linking.assign_greedily(v, f)) == want and len(want) > 30
    assert max(kept) <= len(rows) and len(kept) == 1
    assert told(linking.assign_greedily(v, f, most=15)) == want  # some of the groups in rounds
