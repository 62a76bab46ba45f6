import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gazette.llm import decontaminate, graph, minhash, toxicity


LONG_A = "a text of some words that is long enough to have shingles of five words in it"


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(texts, size, percent):
    sets = {d: shingles(t, size) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in texts}, {d: len(s) for d, s in sets.items()}


def near_corpus(seed, long=False):
    """Copies at all distances, a crowd of mutated copies, and a passage shared by many short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    base = [word() for _ in range(400 if long else 60)]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    passage = [word() for _ in range(40)]
    texts += [" ".join([word() for _ in range(rng.randint(2, 12))] + passage) for _ in range(50)]
    texts += [" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(40)]
    texts += [texts[-1], texts[-2], texts[-2].upper(), "", None, "one", "one", "two words", " \n"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize(("seed", "size", "long"), [(1, 4, False), (2, 5, False), (3, 4, True)])
def test_near_duplicates_equal_brute_force(spark, seed, size, long):
    texts = near_corpus(seed, long)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want, sizes = brute_components(texts, size, 80)
    got = minhash.near_duplicates(docs, size, 80).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in got} == {d: (want[d], sizes[d], want[d] == d) for d in texts}


def test_near_duplicates_odd_rows(odd_docs):
    rows = minhash.near_duplicates(odd_docs, 5, 80).collect()
    assert len(rows) == 9
    assert all(r["component_id"] == r["doc_id"] and r["kept"] == (r["doc_id"] is not None) for r in rows)
    assert minhash.near_duplicates(odd_docs.limit(0), 5, 80).isEmpty()


X, Y = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")


def test_texts_of_one_id_are_classes_of_their_own(spark):
    rows = [(5, X), (5, Y), (6, X + " more"), (7, Y + " more"), (8, Y + " other"), (9, "alone"), (9, "alone"), (9, "also alone here")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 5), (9, 9), (9, 9), (9, 9)]


@pytest.mark.parametrize("size", [4, 5])
def test_one_row_of_each_group_survives(spark, size):
    rows = [(1, X, "a"), (1, X, "b"), (3, "a text of its own", "c"), (3, X, "d"), (4, X + " more", "e"), (5, Y, "f"), (5, Z := Y + " z", "g"), (2, Z, "h"), (6, None, "i"), (6, "", "j"), (None, X, "k")]
    left = minhash.survivors(spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(3), size, 80)
    assert left.columns == ["doc_id", "text", "more"]
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(got, key=repr) == sorted([(1, X), (3, "a text of its own"), (2, Z), (6, None), (6, ""), (None, X)], key=repr)


def test_survivors_equal_brute_force(spark):
    texts = near_corpus(7)
    want, sizes = brute_components(texts, 5, 80)
    left = minhash.survivors(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), 5, 80)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d in texts if want[d] == d)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


ITEMS = [(0, "A train leaves London at 60 km per hour and meets Alice after 3 hours on the way to Paris in the rain."), (1, "too short"), (2, None), (3, "")]


def found(spark, docs, items=ITEMS):
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}


def test_leaks(spark):
    item = ITEMS[0][1]
    docs = [
        (0, f"Before this, some words. {item} And after."),
        (1, item.upper()),
        (2, "A train leaves Madrid at 75 km per hour and meets Bruno after 4 hours on the way to Lisbon in the rain."),
        (3, "A train goes from a town and nobody meets it at all, after many hours on the way."),
        (4, None),
        (5, ""),
        (6, "it was far too short for us"),
        (None, item),
        (7, item.replace("London", "Rome").replace(".", ".\n")),
    ]
    assert found(spark, docs) == {(0, 0), (1, 0), (2, 0), (6, 1), (7, 0), (None, 0)}
    assert found(spark, docs[4:6]) == set()


def test_slots_have_to_be_steady(spark):
    items = spark.createDataFrame([(0, "give 5 apples to Ann and then 5 pears to Ann and then 5 plums to Ann")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "give 7 apples to Bob and then 7 pears to Bob and then 7 plums to Bob"), (1, "give 7 apples to Bob and then 8 pears to Cid and then 9 plums to Dan")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(docs, items).collect()] == [0]


def test_slots_are_compared_in_aligned_occurrences(spark):
    item = "a bike costs 3 euros per day and a tent costs 5 euros per day and a boat costs 8 euros per day"
    other = lambda *n: f"a bike costs {n[0]} euros per day and a tent costs {n[1]} euros per day and a boat costs {n[2]} euros per day"
    items = [(0, item), (1, "costs 3 euros per day and costs 5 euros per day")]
    docs = [
        (0, other(7, 9, 2)),
        (1, f"{other(7, 9, 2)} {'filler words stand here ' * 9} {other(11, 12, 13)}"),
        (2, f"{other(7, 9, 2)} {'filler words stand here ' * 9} each tent costs 99 euros per day"),
        (3, "costs 7 euros per day and costs 9 euros per day"),
        (4, "a bike costs 7 euros per day and also a tent costs 9 euros per day and a boat costs 2 euros per day"),
    ]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["item_id"] == 0} >= {0, 1, 2}
    assert {r["doc_id"] for r in got if r["item_id"] == 1} >= {3}
    steady = [(0, "3 cats and 3 dogs and 3 hens and 3 cows and 3 pigs were in the yard")]
    mixed = [(0, "4 cats and 5 dogs and 6 hens and 7 cows and 8 pigs were in the yard"), (1, "4 cats and 4 dogs and 4 hens and 4 cows and 4 pigs were in the yard")]
    got = decontaminate.leaks(spark.createDataFrame(mixed, "doc_id long, text string"), spark.createDataFrame(steady, "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1}


def test_names_that_begin_sentences_and_single_changes(spark):
    item = "Anna walks slowly to the old market today. Bruno gives her seven pears there. Anna eats half of them all alone."
    short = "one old man sold his small boat to the rich king of a far land"
    items = [(0, item), (1, short)]
    docs = [
        (0, item.replace("Anna", "Clara").replace("Bruno", "David")),
        (1, short.replace("boat", "house")),
        (2, short.replace("man", "cat")),
        (3, short.replace("sold", "bought")),
        (4, short.replace("man", "cat").replace("boat", "house").replace("king", "queen").replace("far", "near")),
        (5, "Then one old man sold his goat and went to the rich town of a bad land"),
    ]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 0), (1, 1), (2, 1), (3, 1)}


def test_literal_leaks_equal_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    bench = items.collect()
    assert got == {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in bench if i["text"] in d["text"]}


def test_names_of_several_words_and_numbers_in_words(spark):
    item = "Tom has 5 apples and gives 3 of them to Mary before the bus leaves the old town and he walks home"
    docs = [
        (0, "Mary Ann has 8 apples and gives 2 of them to Anna Lee Smith before the bus leaves the old town and he walks home"),
        (1, "Tom has nine apples and gives two of them to Mary before the bus leaves the old town and he walks home"),
        (2, "So it began. Jean Luc has twenty-one apples and gives seven of them to Bo before the bus leaves the old town and he walks home. The end."),
        (3, "Mary Ann has a bus and Anna Lee walks home before the old town has nine apples"),
    ]
    assert found(spark, docs, [(0, item)]) == {(0, 0), (1, 0), (2, 0)}


def test_reparameterised_items_are_found(spark):
    """A generated set: items of several sentences, each asked again with other names, numbers and units."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    name = lambda: " ".join(word().capitalize() for _ in range(rng.choice((1, 1, 2, 3))))
    number = lambda: rng.choice((str(rng.randint(2, 999)), rng.choice(decontaminate.ONES), f"{rng.choice(decontaminate.TENS)}-{rng.choice(decontaminate.ONES)}"))

    def template():
        slots = [f"{{{kind}{k}}}" for kind in "nku" for k in range(3)]
        return [[rng.choice(slots) if rng.random() < 0.3 else word() for _ in range(rng.randint(9, 16))] for _ in range(rng.randint(2, 4))]

    def filled(parts):
        """Each slot stands for one value throughout, and no two for the same."""
        units = rng.sample(("km", "kg", "hours", "euros", "miles"), 3)
        values = {}
        while len(set(values.values())) < 9:
            values = {f"{{{kind}{k}}}": make(k) for kind, make in (("n", lambda _: name()), ("k", lambda _: number()), ("u", units.__getitem__)) for k in range(3)}
        sentences = [" ".join(values.get(w, w) for w in p) for p in parts]
        return " ".join(x[0].upper() + x[1:] + "." for x in sentences)

    filler = lambda n: " ".join(word() for _ in range(n)) + "."
    templates = [template() for _ in range(60)]
    items = [(k, filled(t)) for k, t in enumerate(templates)]
    docs = [(k, f"{filler(30)} {filled(t)} {filler(25)}") for k, t in enumerate(templates)] + [(100 + k, filled(template()) + " " + filler(40)) for k in range(60)]
    got = found(spark, docs, items)
    missed = [k for k in range(60) if (k, k) not in got]
    assert len(missed) <= 6, [(dict(items)[k], dict(docs)[k]) for k in missed]
    assert all(d == i for d, i in got)


def test_texts_of_one_id_are_judged_apart(spark):
    item = ITEMS[0][1]
    docs = [(1, f"words before {item}", "x"), (1, "a clean text under the same id with enough words", "y"), (None, item, "z"), (None, "clean and without an id", "w"), (None, None, "v"), (1, f"words before {item}", "u")]
    given = spark.createDataFrame(docs, "doc_id long, text string, hash string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.without_leaks(given, bench)
    assert got.columns == given.columns and {r["hash"] for r in got.collect()} == {"y", "w", "v"}
    assert Counter((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(given, bench).collect()) == {(1, 0): 1, (None, 0): 1}


def test_survivors_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, LONG_A, "keep me", 5), (2, LONG_A, "copy", 6), (3, "other words entirely here", "mine", 7)], "doc_id long, text string, t string, whole_row int")
    got = minhash.survivors(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == {(1, LONG_A, "keep me", 5), (3, "other words entirely here", "mine", 7)}


def toxic_corpus(spark, n=400):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bdkst") for _ in range(3))
    rows = []
    for i in range(n):
        w = [word() for _ in range(30)]
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(30)] = rng.choice(["vileword", "nastyword", "zzgrim" + word()])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus(spark)
    got = toxicity.score(rows.select("doc_id", "text"), rows.select("doc_id", "toxic")).join(rows, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and 80 < len(held) < 190
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95


def plain_features(text):
    out = Counter()
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        out.update([w, *(w[:k] + "~" for k in (4, 5, 6) if len(w) > k)])
    return out


def test_neighbours_equal_brute_force_cosines(spark):
    """Weights, unit vectors and cosines over all features, worked out from the texts alone."""
    rows = toxic_corpus(spark)
    index, vectors = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    docs = {r["doc_id"]: r for r in rows.collect()}
    used = [d for d in docs if zlib.crc32(str(d).encode()) % 3 != 1]
    bags = {d: plain_features(r["text"]) for d, r in docs.items()}
    names = sorted({f for d in used for f in bags[d]})
    n_toxic = sum(docs[d]["toxic"] for d in used)
    rate, weight = n_toxic / len(used), {}
    df = Counter(f for b in bags.values() for f in b)
    n_in, n_tox = Counter(f for d in used for f in bags[d]), Counter(f for d in used if docs[d]["toxic"] for f in bags[d])
    for f in names:
        n, k = n_in[f], n_tox[f]
        z = abs(k - n * rate) / math.sqrt(n * rate * (1 - rate))
        weight[f] = math.log((2 + len(docs)) / (1 + df[f])) * max(0.1, min(1.0, max(0.0, (z - 2) / 4)) * abs(k / n - rate))
    np.testing.assert_allclose(index.weight, [weight[f] for f in names])

    def unit(d):
        w = {f: (1 + math.log(c)) * weight[f] for f, c in bags[d].items() if f in weight}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {f: x / size for f, x in w.items()}

    examples = {d: unit(d) for d in used}
    assert sorted(index.ids) == sorted(used)
    given = {r["doc_id"]: (np.cumsum(r["step"]), np.array(r["tf"], float)) for r in vectors.collect()}
    order = sorted(docs)
    for d, (found, cos) in zip(order, index.nearest([index.unit(given[x]) for x in order]), strict=True):
        own = unit(d)
        every = {e: sum(x * own.get(f, 0.0) for f, x in v.items()) for e, v in examples.items()}
        np.testing.assert_allclose(cos, sorted((x for x in every.values() if x > 1e-6), reverse=True)[: toxicity.NEIGHBOURS], rtol=1e-4)
        np.testing.assert_allclose([every[index.ids[x]] for x in found], cos, rtol=1e-4)


def test_only_some_blocks_are_scored_and_copies_are_left_out(spark):
    """Two vocabularies: the blocks of the other one are ruled out by their bounds. And one text under many ids is one example."""
    rng = random.Random(1)
    one, two = (["".join(rng.choice(c) for _ in range(3)) for _ in range(60)] for c in ("abc", "xyz"))
    rows = [(i, " ".join(rng.choices(one if i % 2 else two, k=25)) + (" grim" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(900)]
    rows += [(10_000 + i, "the same text each time", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index, vectors = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert sum(x >= 10_000 for x in index.ids) == 1
    ids, tf = next((np.cumsum(r["step"]), np.array(r["tf"], float)) for r in vectors.filter("doc_id = 10000").collect())
    assert len(index.nearest([index.unit((ids, tf))], toxicity.COPY)[0][0]) == 0 or index.nearest([index.unit((ids, tf))], toxicity.COPY)[0][1].max() < toxicity.COPY


def test_toxicity_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([(1, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    rows = toxicity.score(odd_docs, none).collect()
    assert len(rows) == 9 and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd_docs, labels).collect())
    assert toxicity.score(odd_docs.limit(0), labels).isEmpty()
    texts = spark.createDataFrame([(1, "good day"), (1, "grim day"), (4, "grim"), (3, "fine day")], "doc_id long, text string")
    both = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    assert toxicity.score(texts, both).count() == 4

def test_rows_without_keys_equal_an_anti_join(spark):
    from gazette.llm.common import without

    rng = random.Random(1)
    rows = [(rng.choice((None, *range(200))), rng.randint(0, 9), f"text {k}") for k in range(3000)]
    keys = list({(a, b) for a, b, _ in rows[:300]} | {(None, 3), (9999, 1)})
    for least in (1 << 20, 64):  # a filter that is full lets everything through to the join
        import gazette.llm.common as common

        sure, open_ = common.cleared(spark.createDataFrame(rows, "a long, b long, text string"), spark.createDataFrame(keys, "a long, b long"), ["a", "b"], least, max(least, 64))
        assert sure.count() + open_.count() == 3000
    got = without(spark.createDataFrame(rows, "a long, b long, text string"), spark.createDataFrame(keys, "a long, b long"), ["a", "b"])
    assert Counter(map(tuple, got.collect())) == Counter(r for r in rows if r[:2] not in set(keys))
