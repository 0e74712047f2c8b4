"""Quality rules against plain loops, and their defined cases."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parcelry.llm.rules import js_distance, quality_rules

DOC = "doc_id long, lang string, text string"
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[ \t]", r"\n", r"[.,;:'\"()?!-]", r"[#*$%&|<>]", None, "[\x80-˿]", "[̀-\U0010ffff]")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    words, lines = spaced(text), [x for x in (text or "").split("\n") if spaced(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {p for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a, b: a * math.log2(a / ((a + b) / 2)) if a else 0.0
    return math.sqrt(max(0, sum(part(a, b) + part(b, a) for a, b in zip(p, q))) / 2)


def classes(text):
    n = [len(re.findall(c, text or "")) if c else 0 for c in CLASSES]
    n[7] = len(text or "") - sum(n)
    return n


def plain_rules(rows, common=50):
    """All languages here are large enough for a reference."""
    measured = {i: (lang, base(t), classes(t), Counter(plain_words(t))) for i, lang, t in rows}
    langs = {lang for lang, *_ in measured.values()}
    total = {k: sum((w for lang, _, _, w in measured.values() if lang == k), Counter()) for k in langs}
    langs = {k for k in langs if sum(total[k].values())}
    top = {k: sorted(total[k].items(), key=lambda x: (-x[1], x[0].encode()))[:common] for k in langs}
    bins = lambda k, n: [n[w] for w, _ in top[k]] + [sum(n.values()) - sum(n[w] for w, _ in top[k])]
    inside = {i for i, (_, b, *_) in measured.items() if not b[5]}
    for round_ in range(3):
        sums = {k: [sum(x) for x in zip([0] * 10, *[c for i, (lang, _, c, _) in measured.items() if lang == k and i in inside])] for k in langs}
        inside = {i for i, (lang, b, c, _) in measured.items() if not b[5] and lang in langs and (sum(c) < 500 or distance(c, sums[lang]) < 0.2)}
    out = {}
    for i, (lang, b, c, w) in measured.items():
        n = sum(w.values())
        chars = distance(c, sums[lang]) if lang in langs and sum(c) and sum(sums[lang]) else None
        words = distance(bins(lang, w), bins(lang, total[lang])) if lang in langs and n else None
        far = (chars is not None and sum(c) >= 500 and chars > 0.14 + 2.6 / math.sqrt(sum(c))) or (words is not None and n >= 100 and words > 0.10 + 3.2 / math.sqrt(n))
        out[i] = (*b, chars, words, not b[5] and not far)
    return out


def made(seed):
    rng = random.Random(seed)
    vocabulary = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(300)] for k, letters in (("aa", "abcdeé"), ("bb", "mnopqr"), (None, "uvwxyzж"))}
    weights, rows = [1 / (i + 1) for i in range(300)], []
    for i in range(150):
        lang = rng.choice(["aa", "aa", "bb", None])
        words = rng.choices(vocabulary[lang], weights, k=rng.choice([5, 30, 150, 400, 900]))
        kind = rng.randrange(8)
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w + rng.choice(["***", " |", "%%"]) for w in words]
        elif kind == 2:
            words = words[: len(words) // 4] * 4
        elif kind == 3:
            words = rng.choices(vocabulary[rng.choice(["aa", "bb"])], k=len(words))
        rows.append((i, lang, "".join(w + rng.choice([" ", " ", " ", "\n", "\t", ", "]) for w in words)))
    return [*rows, (900, "aa", None), (901, None, ""), (902, "bb", " \n\t\n "), (903, "aa", "same line here\nsame line here\n\nsame line here\n" + "x " * 40)]


def test_equals_plain_loops(spark):
    rows = made(4)
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, DOC).repartition(5)).collect()}
    want = plain_rules(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"], g["kept"]) == (*w[:6], w[8]), rows[i]
        assert all((x is None and y is None) or abs(x - y) < 1e-9 for x, y in ((g["js_chars"], w[6]), (g["js_words"], w[7])))
    assert 5 < sum(not r["base_failed"] and not r["kept"] for r in got.values()) < len(rows) / 2


def test_clean_texts_of_the_given_table_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules(docs).join(labels, "doc_id").filter("n_words >= 100").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in found}
    assert kept[1] > 0.97 and kept[0] < 0.1


def test_js_distance(spark):
    df = spark.createDataFrame([([1, 3], [2, 6]), ([5, 0], [0, 9]), ([1, 1], [0, 0]), (None, [1, 2]), ([4, 1, 2], [1, 1, 9])], "p array<long>, q array<long>")
    got = [r[0] for r in df.select(js_distance(F.col("p"), F.col("q"))).collect()]
    assert got[0] < 1e-9 and got[1] == 1.0 and got[2] is None and got[3] is None and abs(got[4] - distance([4, 1, 2], [1, 1, 9])) < 1e-12


def test_defined_cases(spark):
    assert quality_rules(spark.createDataFrame([], DOC)).collect() == []
    names = ("text_", "lang_", "m", "__m", "Kept", "words", "chars", "__text")
    rows = [(1, None, None), (1, "x", ""), (None, "x", "word " * 60_000), (2, "x", "tiny"), (2, "x", "tiny")]
    got = quality_rules(spark.createDataFrame(rows, DOC).withColumns({n: F.lit("kept") for n in names})).collect()
    assert len(got) == 5 and "text" not in got[0].asDict() and all(r["__m"] == r["words"] == "kept" and not r["kept"] for r in got)
    assert sorted(r["n_words"] for r in got) == [0, 0, 1, 1, 60_000] and max(r["n_repeat_words"] for r in got) == 60_000
    # A language below the smallest share has no reference, so only the base rules count.
    rng = random.Random(1)
    rare = " ".join(f"#{rng.random()}" for _ in range(40))
    many = [(i, "x", " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(4000))) for i in range(30)]
    out = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame([*many, (99, "rare", rare)], DOC), carry_text=True).collect()}
    assert out[99]["kept"] and out[99]["js_chars"] is None and out[99]["text"] == rare and out[0]["js_chars"] is not None
