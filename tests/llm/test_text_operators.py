"""Substring dedup, line dedup, decontamination and near-dedup against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parcelry.operators.components import connected_components
from parcelry.llm.decontam import mark_contamination
from parcelry.llm.lines import remove_repeated_lines
from parcelry.llm.neardup import near_duplicate_classes
from parcelry.llm.substrings import remove_repeated_passages

DOC = "doc_id long, text string"
SPACED = re.compile("[^\x20\x09-\x0d]+")


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def made(seed, docs=40, letters="abcdefgh", passages=4, length=50):
    """Random documents of which some hold the same passages, whole copies and inner repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) + rng.choice(["", "", ",", "é"])
    shared = [" ".join(word() for _ in range(rng.randrange(length // 2, length))) for _ in range(passages)]
    out = []
    for i in range(docs):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 60)))]
        parts += rng.choices(shared, k=rng.randrange(0, 3))
        parts.append(rng.choice(["\n", "\t", "  "]).join(word() for _ in range(rng.randrange(0, 20))))
        rng.shuffle(parts)
        out.append((i, rng.choice([" ", "\n"]).join(parts)))
    out += [(docs + k, out[k][1]) for k in range(3)]
    return out


# Nulls, empty and blank texts, a very long one, repeated rows and repeated ids with other texts.
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two three"), (4, "x " * 60_000), (5, "same text here"), (5, "same text here"), (5, "another text"), (6, "w" * 50_000), (None, None), (7, "\n\n\n\n\n")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOC).repartition(3)


def clashing(spark, *names):
    df = spark.createDataFrame([(1, "a b c\nd\ne")], DOC)
    extra = ("n_words", "n_removed", "n_hit", "items", "names", "h1", "window", "bucket", "node", "id", "component", "chunk", "size", "pos", "item", "text2", "label", "__row", "__hits", "__names", "__of", "__text", "__lines", "__kept", "__at", "__id", "__hash", *names)
    return df.withColumns({n: F.lit("kept") for n in extra})


def kept(row):
    return all(row[c] == "kept" for c in ("__row", "__hits", "__names", "__of", "__text", "__lines", "__kept", "__at", "__id", "__hash"))


# Substring dedup ------------------------------------------------------------------------------------


def passages_removed(docs, window, longest=False):
    words = [SPACED.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    lengths = [window]
    while lengths[-1] <= max(map(len, words), default=0):
        lengths.append(2 * lengths[-1])
    counts = {n: Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1)) for n in lengths} if longest else {}
    out = []
    for (i, _), w in zip(docs, words):
        if longest:
            out.append((i, max([0, *(n for n in lengths if any(counts[n][tuple(w[k : k + n])] > 1 for k in range(len(w) - n + 1)))])))
            continue
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window, chunk_bytes", [(35, 1 << 20), (35, 600), (5, 300), (2, 2000)])
def test_passages_equal_brute_force(spark, window, chunk_bytes):
    docs = made(window + chunk_bytes)
    got = remove_repeated_passages(spark.createDataFrame(docs, DOC).repartition(3), window=window, extend=True, chunk_bytes=chunk_bytes)
    rows = got.collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows) == sorted(passages_removed(docs, window))
    assert sorted((r["doc_id"], r["longest_repeat"]) for r in rows) == sorted(passages_removed(docs, window, longest=True))
    assert all(r["longest_repeat"] in (r["repeat_at_least"], 2 * r["repeat_at_least"]) for r in rows)
    plain = remove_repeated_passages(spark.createDataFrame(docs, DOC).repartition(2), window=window).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in plain) == sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in rows)
    assert all(p["longest_repeat"] == (window if p["n_removed"] else 0) for p in plain)


def test_passages_defined_cases(spark, odd):
    got = remove_repeated_passages(odd, window=3, chunk_bytes=5000).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, passages_removed(ODD, 3)))
    assert remove_repeated_passages(spark.createDataFrame([], DOC)).count() == 0
    row = remove_repeated_passages(clashing(spark, "__chunk", "kept_text")).first()
    assert kept(row) and row["label"] == row["bucket"] == "kept" and row["n_words"] == 5 and row["n_removed"] == 0


def test_passages_extend_until_nothing_survives(spark):
    rng = random.Random(5)
    long, short = (" ".join(str(rng.random()) for _ in range(n)) for n in (100, 12))
    docs = [(1, long), (2, "a " + long), (3, short + " b"), (4, "c " + short), (5, "none of it")]
    got = {r["doc_id"]: r["longest_repeat"] for r in remove_repeated_passages(spark.createDataFrame(docs, DOC), window=10, extend=True).collect()}
    assert got == {1: 80, 2: 80, 3: 10, 4: 10, 5: 0}


def test_passages_are_doubled_by_representatives_until_nothing_survives(spark):
    rng = random.Random(6)
    long, middle, short = (" ".join(str(rng.random()) for _ in range(n)) for n in (400, 100, 12))
    docs = [(1, long), (2, "a " + long + " b"), (3, middle), (4, "c " + middle), (5, short), (6, short + " d"), (7, "none of it"), (8, None), (9, "x " * 90)]
    rows = remove_repeated_passages(spark.createDataFrame(docs, DOC), window=10, extend=True, chunk_bytes=500).collect()
    got = {r["doc_id"]: (r["repeat_at_least"], r["longest_repeat"]) for r in rows}
    assert {i: e for i, (_, e) in got.items()} == {1: 320, 2: 320, 3: 80, 4: 80, 5: 10, 6: 10, 7: 0, 8: 0, 9: 80}
    assert all(e in (r, 2 * r) for r, e in got.values()) and got[1][0] >= 160 and got[9][0] == 40
    again = remove_repeated_passages(spark.createDataFrame(docs, DOC).repartition(5), window=10, chunk_bytes=50_000).collect()
    assert {r["doc_id"]: r["repeat_at_least"] for r in again} == {i: r for i, (r, _) in got.items()}


# Line dedup -----------------------------------------------------------------------------------------


def lines_removed(docs, window=3):
    """Distinct (id, text) are documents; ids in order, nulls last."""
    lines = {d: d[1].split("\n") for d in docs if d[1] is not None}
    places = defaultdict(list)
    for d, ls in lines.items():
        for k in range(len(ls) - window + 1):
            places[tuple(ls[k : k + window])].append((d[0] is None, d[0] or 0, d, k))
    gone = defaultdict(set)
    for p in places.values():
        first = min(p, key=lambda x: (x[0], x[1], x[3]))
        for x in p:
            if x is not first:
                gone[x[2]] |= set(range(x[3], x[3] + window))
    out = []
    for d in docs:
        ls = lines.get(d, [])
        kept = [x for k, x in enumerate(ls) if k not in gone[d]]
        out.append((d[0], len(ls), len(ls) - len(kept), None if d[1] is None else "\n".join(kept)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(i, "\n".join(rng.choice(["a", "b", "", "c d", "e"]) for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    got = remove_repeated_lines(spark.createDataFrame(docs, DOC).repartition(3)).select("doc_id", "n_lines", "n_removed", "kept_text")
    assert sorted(map(tuple, got.collect())) == sorted(lines_removed(docs))


def test_lines_defined_cases(spark, odd):
    got = remove_repeated_lines(odd).select("doc_id", "n_lines", "n_removed", "kept_text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, lines_removed(ODD)))
    assert remove_repeated_lines(spark.createDataFrame([], DOC)).count() == 0
    row = remove_repeated_lines(clashing(spark, "__id", "__at", "a", "w1", "n_lines")).first()
    assert kept(row) and row["label"] == row["pos"] == "kept" and (row["n_lines"], row["n_removed"]) == (3, 0)


def test_lines_merge_overlapping_windows(spark):
    docs = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ne\ny"), (3, "q\na\nb\nc\nz")]
    got = {r["doc_id"]: r["kept_text"] for r in remove_repeated_lines(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {1: docs[0][1], 2: "x\ny", 3: "q\nz"}


# Decontamination ------------------------------------------------------------------------------------


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, found = plain_words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= names
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("seed", range(3))
def test_contamination_equals_brute_force(spark, seed):
    docs = made(seed, letters="abAB", length=30)
    rng = random.Random(seed)
    items = [(i, " ".join(plain_words(rng.choice(docs)[1])[a : a + rng.choice([3, 7, 9, 10, 11, 25])])) for i, a in enumerate(rng.choices(range(30), k=25))]
    items += [(900, "never seen words of which there are more than ten in a row"), (901, ""), (902, None), (None, docs[0][1]), (5, docs[1][1])]
    got = mark_contamination(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, "item_id long, text string")).select(*COLS)
    assert sorted(map(tuple, got.collect())) == sorted(contamination(docs, items))


def test_contamination_of_passages_in_every_document_and_item(spark):
    rng = random.Random(11)
    common, *own = (" ".join(f"w{rng.randrange(9999)}" for _ in range(14)) for _ in range(5))
    items = [(i, f"{common} x{i} {own[i % 4]}") for i in range(40)]
    docs = [(i, " . ".join([common, *rng.sample(own, i % 3)])) for i in range(120)]
    got = mark_contamination(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, "item_id long, text string")).select(*COLS)
    assert sorted(map(tuple, got.collect())) == sorted(contamination(docs, items))


def test_contamination_defined_cases(spark, odd):
    items = [(1, "Same text HERE"), (2, "x x"), (2, "another text"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = mark_contamination(odd, bench).select(*COLS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, contamination(ODD, items)))
    assert mark_contamination(spark.createDataFrame([], DOC), bench).count() == 0
    assert mark_contamination(odd, bench.limit(0)).filter("contaminated OR n_hit > 0").count() == 0
    row = mark_contamination(clashing(spark, "contaminated", "__row", "__hits"), bench.withColumn("label", F.lit(1))).first()
    assert kept(row) and row["label"] == row["h1"] == row["names"] == "kept" and row["n_hit"] == 0 and not row["contaminated"]


# Near-dedup -----------------------------------------------------------------------------------------


def bag(text):
    w = plain_words(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def near(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def classes(docs, threshold=0.8):
    """The set of row numbers of each class."""
    bags = [bag(t) for _, t in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(bags):
        for j in range(i):
            if a and bags[j] and near(a, bags[j]) >= threshold - 1e-12 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def altered(text, rng, share):
    return " ".join(rng.choice("stuvw") * 3 + str(rng.random()) if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    bases = [" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.choice([3, 60, 200]))) for _ in range(12)]
    texts = [altered(rng.choice(bases), rng, rng.choice([0, 0.01, 0.02, 0.04, 0.08])) for _ in range(120)] + ["again and again " * 30, "Again, and again " * 31, "again and again " * 60]
    docs = list(enumerate(texts))
    group = classes(docs)
    smallest = {}
    for i, g in enumerate(group):
        smallest.setdefault(g, i)
    got = near_duplicate_classes(spark.createDataFrame(docs, DOC).repartition(4)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: smallest[g] for i, g in enumerate(group)}
    assert all(r["representative"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_a_crowd_that_only_its_hub_links(spark):
    rng = random.Random(9)
    hub = " ".join(str(rng.random()) for _ in range(150))
    docs = [(i, altered(hub, rng, 0.025)) for i in range(300)] + [(300, hub)]
    group = classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(spark.createDataFrame(docs, DOC)).collect()}
    assert len(set(group)) > 1
    assert all(got[i] == got[group[i]] for i in got) and len(set(got.values())) == len(set(group))


def test_a_family_of_two_thousand_near_documents(spark, monkeypatch):
    """Chains of edits, so that links run across many components; recall of the links by brute force over all pairs."""
    import numpy as np

    from parcelry.llm import neardup

    monkeypatch.setattr(neardup, "_CHUNK_WORDS", 4000)
    rng = random.Random(17)
    word = lambda: str(rng.random())
    chains = [[word() for _ in range(70)] for _ in range(25)]
    start, texts = list(chains[0]), []
    for i in range(2000):
        c = i % 25
        if i < 25:
            chains[c] = [word() if rng.random() < 0.04 else w for w in start]
        elif rng.random() < 0.5:
            chains[c][rng.randrange(70)] = word()
        else:
            chains[c] = [word() if rng.random() < 0.02 else w for w in chains[c]]
        texts.append(" ".join(chains[c]))
    bags = [bag(t) for t in texts]
    number = {}
    grid = np.zeros((2000, len({s for b in bags for s in b})), np.float32)
    for i, b in enumerate(bags):
        for s in b:
            grid[i, number.setdefault(s, len(number))] = 1
    size, common = grid.sum(1), grid @ grid.T
    a, b = np.nonzero(np.triu(common >= 0.8 * (size[:, None] + size[None, :] - common) - 1e-4, 1))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4)).collect()}
    recall = np.mean([got[i] == got[j] for i, j in zip(a.tolist(), b.tolist())])
    print(f"{len(a)} links, {len(set(got.values()))} classes, recall {recall:.5f}")
    assert len(a) > 2000 and recall > 0.999
    group = list(range(2000))
    for i, j in zip(a.tolist(), b.tolist()):
        if group[i] != group[j]:
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    assert len(set(got.values())) >= len(set(group)) and all(group[i] == group[c] for i, c in got.items())


def test_classes_defined_cases(spark, odd):
    got = near_duplicate_classes(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["text"]].append((r["doc_id"], r["class_id"], r["representative"]))
    assert sorted(by["same text here"]) == [(5, 5, False), (5, 5, True)]
    assert by[""] == [(2, 2, True)] and sorted(by[None], key=str) == sorted([(1, 1, True), (None, None, True)], key=str) and by["one two three"] == [(None, None, True)]
    assert near_duplicate_classes(spark.createDataFrame([], DOC)).count() == 0
    row = near_duplicate_classes(clashing(spark, "class_id", "representative", "__row", "__n")).first()
    assert kept(row) and row["label"] == row["node"] == "kept" and row["class_id"] == 1 and row["representative"]


def test_signatures_estimate_weighted_similarity():
    import numpy as np

    from parcelry.llm.neardup import signatures

    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = rng.integers(1, 20, 300), rng.integers(1, 20, 300)
    of = np.repeat([0, 1], 300)
    s = signatures(of, np.concatenate([h, h]), np.concatenate([a, b]), 2, 8192)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(101, 100), (100, 100), (102, 101), (None, 5), (101, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
