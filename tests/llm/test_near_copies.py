import random

import pytest

from terramark.llm import exact_dedup, near_copies, simhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def rows(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_near_copies_beyond_three_bits_leave_one_row(spark):
    rng, texts = random.Random(7), []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        texts.append((10 * k, " ".join(words)))
        for j in range(1, 1 + k % 3):
            changed = list(words)
            changed[rng.randrange(5, 115)] = f"new{j}"
            texts.append((10 * k + j, " ".join(changed)))
    texts += [(900, "one two"), (901, "one three"), (902, None)]
    sets = {i: grams(t) for i, t in texts}
    comp = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in pairs:
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert any(bin(simhash.fingerprint(dict(texts)[i]) ^ simhash.fingerprint(dict(texts)[j])).count("1") > 3 for i, j in pairs)
    stay = near_copies.deduplicated(rows(spark, texts))
    assert stay.columns == ["doc_id", "text"] and sorted(r.doc_id for r in stay.collect()) == sorted(set(comp.values()))


def test_a_row_just_below_the_similarity_stays(spark):
    base = [f"w{i}" for i in range(104)]
    head = lambda k, n: " ".join([f"t{k}x{i}" for i in range(n)] + base[n:])
    texts = [(1, " ".join(base[:91] + [f"z{i}" for i in range(13)])), (2, head(2, 10)), (3, head(3, 9)), (4, " ".join(base))]
    found = {r.id: r.component for r in near_copies.groups(near_copies.keyed(rows(spark, texts))).collect()}
    assert len({found[k] for k in (2, 3, 4)}) == 1 and found[1] != found[2]


def test_repeated_ids_are_no_hindrance(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    texts = [(1, a), (1, b), (2, a), (2, "else"), (None, b), (None, "other"), (1, a)]
    for stage in (near_copies, exact_dedup):
        got = sorted((r.text, r.doc_id is None, r.doc_id) for r in stage.deduplicated(rows(spark, texts)).collect())
        assert got == sorted([(a, False, 1), (b, False, 1), ("else", False, 2), ("other", True, None)])


def edited(words, rng, at, name):
    out = list(words)
    for i in at:
        out[i] = f"{name}{i}" if rng.random() < 0.7 else ""
    return " ".join(w for w in out if w)


@pytest.mark.parametrize(("with_base", "share"), [(True, 10), (False, 3)])
def test_copies_changed_in_different_places_do_not_all_meet(spark, monkeypatch, with_base, share):
    """A band of many copies that aren't near each other: the same components as by all pairs, from a part of these."""
    rng, base = random.Random(11), [f"w{i}" for i in range(150)]
    texts = [" ".join(base)] * with_base + [edited(base, rng, rng.sample(range(150), 2 if k % 3 == 0 else 7), f"k{k}x") for k in range(300)]
    for k in range(40):  # far from the base, near each other
        far = rng.sample(range(150), 8)
        first = edited(base, random.Random(k), far, f"f{k}x")
        texts += [first, first.replace(first.split()[75], f"g{k}")]
    texts = list(enumerate(texts))
    sets = {i: grams(t) for i, t in texts}
    comp, asked = {i: i for i in sets}, []
    near = [(i, j) for i in sets for j in sets if i < j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    while True:
        before = dict(comp)
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    for name in ("likely", "similar"):
        if hasattr(near_copies, name):
            monkeypatch.setattr(near_copies, name, lambda pairs, *more, own=getattr(near_copies, name): (asked.append(pairs.distinct().count()), own(pairs, *more))[1])
    found = {r.id: r.component for r in near_copies.groups(near_copies.keyed(rows(spark, texts))).collect()}
    assert len(set(comp.values())) > 150
    assert {frozenset(i for i in found if found[i] == k) for k in found.values()} == {frozenset(i for i in comp if comp[i] == k) for k in comp.values()}
    assert max(asked) < len(texts) ** 2 / 2 / share


def test_rows_that_may_be_asked_for_are_marked(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "WORDS_OF_BITS", 8)
    own = spark.range(3000).selectExpr("id * 5 + shiftleft(id % 3, 33) AS __terramark_row", "id AS `a.b`")
    keys = own.filter("`a.b` % 400 = 7").select("__terramark_row")
    found = near_copies.marked(own, keys)
    assert found.columns == ["__terramark_row", "a.b", "__marked"] and found.count() == 3000
    assert found.filter("__marked").join(keys, "__terramark_row").count() == keys.count() == 8 and found.filter("__marked").count() < 1000
