"""The fill-in-the-middle, resampling and fingerprint operators against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gazette.llm import fill_middle, fingerprints, resampling

ODD = ["", None, "one", "a\nb\n", "\n\n\n", "no end\nof line", "é\n日本🎉\n\nñ", "<P", "a <M> b", "<<S>>", "x<\n<\n", "word " * 3000, "l\n" * 3000, "\r\n\r\n", " \n <S", "<P>\n"]


def odd_rows():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab<PSM>\n é🎉") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*enumerate(texts), (3, "a\nb\n"), (None, "no id\nhere")]


def units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    cut = [m.start() for m in re.finditer(r"(?<![^ \t\n\x0b\x0c\r])[^ \t\n\x0b\x0c\r]", text)]
    return [text[a:b] for a, b in zip([0, *cut[1:]], [*cut[1:], len(text)], strict=True)] if cut else []


def brute_middle(doc_id, text, plan):
    text = text or ""
    x = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    u = units(text, plan.unit)
    n = len(u)
    p, s, m = plan.marks
    if not text or any(k in text for k in plan.marks) or h3 % 100 >= plan.rate:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid = "".join(u[:a]), "".join(u[a:b])
    suf = text[len(pre) + len(mid) :]
    out = s + suf + p + pre + m + mid if h4 % 100 < plan.spm else p + pre + s + suf + m + mid
    return (n, "spm" if h4 % 100 < plan.spm else "psm", len(pre), len(mid), out)


@pytest.mark.parametrize("plan", [fill_middle.Plan(), fill_middle.Plan("word", 11, 60, 30), fill_middle.Plan("char", 3, 90, 0, ("<|pre|>", "<|suf|>", "<|mid|>"))])
def test_middles_equal_brute_force_and_are_restored(spark, plan):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, form string").repartition(3)
    got = fill_middle.restored(fill_middle.transform(docs, plan), plan).collect()
    want = Counter((i, *brute_middle(i, t, plan), t or "") for i, t in rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} - ({"spm"} if plan.spm == 0 else set())


def test_sentinels_that_could_mix_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<P>>", "<M>"), ("<P<", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.Plan(marks=marks)
    with pytest.raises(ValueError):
        fill_middle._restore([b"<P>a<S>b"], ["psm"], fill_middle.Plan())


def test_no_rows(spark, odd_docs):
    none = odd_docs.filter("false")
    assert fill_middle.transform(none).isEmpty() and fingerprints.half_edited(none).isEmpty() and resampling.resample(none, none).isEmpty()


def brute_features(text, plan):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % plan.buckets for n in range(1, plan.ngrams + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, plan):
    of = [(i, *brute_features(t, plan)) for i, t in docs]
    s = Counter(f for _, _, fs in of for f in fs)
    t = Counter(f for x in target for f in brute_features(x, plan)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(plan.scale * math.log((t[k] + 1) * (total_s + plan.buckets) / ((s[k] + 1) * (total_t + plan.buckets))))
    rows = []
    for i, n, fs in of:
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, fs))
        rows.append((i, n, len(fs), w, w + math.floor(-plan.scale * math.log(-math.log((h + 0.5) / 4294967296)))))
    best = sorted((r for r in rows if r[1] >= plan.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], r[2]))
    most = plan.percent * len(best) // 100
    rank = Counter()
    out = Counter((i, f, w, x, None) for i, n, f, w, x in rows if n < plan.least_words)
    for k, (i, _, f, w, x) in enumerate(best):
        rank[(i, f, w, x, k + 1 if k < most else None)] += 1
    return out + rank


@pytest.mark.parametrize("plan", [resampling.Draw(), resampling.Draw(ngrams=3, buckets=97, scale=100, seed=1, least_words=2, percent=35)])
def test_ranks_equal_brute_force(spark, plan):
    rng = random.Random(2)
    word = lambda: rng.choice(("the", "The", "été", "x9", "rare", "日本", "of", "Of", "z"))
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(400)]
    docs += [(k, docs[0][1]) for k in range(500, 700)] + [(1, docs[1][1]), (900, None), (901, ""), (902, "-- ..."), (None, docs[2][1] + " no id" * 9), (903, "long " * 20_000)]
    target = [" ".join(word() for _ in range(30)) for _ in range(5)] + [None, "the the THE"]
    given = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, rank int, key string").repartition(5)
    got = resampling.resample(given, spark.createDataFrame([(t,) for t in target], "text string"), plan)
    assert Counter(map(tuple, got.collect())) == brute_resample(docs, target, plan)


def test_ranks_over_many_ranges(spark):
    rng = random.Random(8)
    scores = [rng.randint(0, 40) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(scores)), "doc_id long, score long").repartition(7)
    got = dict(resampling.ranked(rows, 1234, [F.desc("score"), F.asc("doc_id")]).select("doc_id", "rank").collect())
    order = sorted(range(3000), key=lambda i: (-scores[i], i))
    assert got == {i: k + 1 if k < 1234 else None for k, i in enumerate(order)}


def tree(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections, run = [], []
    lines = re.findall(fingerprints.PARAGRAPH, text) or [""]
    for k, x in enumerate(lines):
        run.append(x)
        if k == len(lines) - 1 or sha(x)[0] in "01" or x == "\n":
            sections.append(run)
            run = []
    heads = [sha("".join(map(sha, s))) for s in sections]
    body = "".join("/" + h[:16] + "".join(":" + sha(p)[:16] + "." + ".".join(sha(x)[:8] for x in re.findall(fingerprints.PIECE, p)) for p in s) for h, s in zip(heads, sections, strict=True))
    return sha("".join(heads)) + body


def brute_likeness(a, b):
    x, y = set(re.split("[/:.]", a)), set(re.split("[/:.]", b))
    return 1.0 if a[:64] == b[:64] else 2.0 * len(x & y) / (len(x) + len(y))


def lines_of(rng, n):
    return "".join(" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 9))) + rng.choice((".", "", ", so", "\n", "! Or: no")) + "\n" for _ in range(n))


def test_trees_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["", "\n", "a", "a\n", "\n\na", "x" * 300, ". . .", "日本。🎉\n", *(lines_of(rng, rng.randint(1, 60)) for _ in range(60))]
    texts += [texts[-1], texts[-1][:-1], texts[-1] + "more\n"]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", fingerprints.fingerprint(F.col("text"))).collect()
    assert {i: f for i, f in got} == {i: tree(t) for i, t in enumerate(texts)}
    assert all((tree(a)[:64] == tree(b)[:64]) == (a == b) for a in texts for b in texts)


def test_edits_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [lines_of(rng, rng.randint(0, 30)) for _ in range(150)] + ["", None, "é🎉" * 500, "line\n" * 4000]
    ids = rng.sample(range(-500, 5000), len(texts))
    docs = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_chars int, next string, _own int").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.half_edited(docs).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        t, then, r = t or "", order[(k + 1) % len(order)][1] or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + then[:half]
        want = (len(t), edited, tree(t), tree(edited), brute_likeness(tree(t), tree(edited)), brute_likeness(tree(t), tree(then)))
        assert (r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) == want
        assert r["n_changed"] == 0 or t != edited
        same = [a == b for a, b in zip(re.findall(fingerprints.PARAGRAPH, t), re.findall(fingerprints.PARAGRAPH, edited), strict=False)]
        if t != edited and all(x.strip() for x in re.findall(fingerprints.PARAGRAPH, t)) and r["first_changed"] is not None:
            assert all(same[: r["first_changed"]])  # nothing before the located paragraph differs


def test_an_edit_is_located(spark):
    rng = random.Random(9)
    lines = [f"Paragraph {k} says {rng.random()}.\n" for k in range(200)]
    changed = [*lines[:120], "Another one.\n", *lines[121:]]
    pair = spark.createDataFrame([("".join(lines), "".join(changed))], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    r = pair.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("near"), fingerprints.changed_paragraphs(F.col("a"), F.col("b")).alias("c"), fingerprints.place(F.col("a"), fingerprints.changed_paragraphs(F.col("a"), F.col("b"))[0]).alias("at")).first()
    assert r["c"] == [hashlib.sha256(lines[120].encode()).hexdigest()[:16]] and r["at"] == 120 and 0.97 < r["near"] < 1


def test_rows_without_or_with_repeated_ids_have_defined_fingerprints(spark):
    rows = [(1, "a. b. c. d."), (1, "a. b. c. d."), (2, "e. f."), (None, "g. h. i. j.")]
    got = fingerprints.half_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["edited"]) for r in got) == Counter([(2, "e. a."), (1, "a. b. a. b."), (1, "a. b. e. f."), (None, "g. h. ")])
    assert [r["near_next"] for r in got if r["doc_id"] is None] == [None]
