"""Toxicity, packing, sharding, chat windows, WARC archives and top-k search, against brute force or exact round trips."""

import base64
import gzip
import glob
import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelry.llm.chat import CLOSE, OPEN, chat_windows, escape, read_windows, unescape
from parcelry.llm.packing import best_fit, pack_best_fit, sequence_cost
from parcelry.llm.sharding import shard_by_bytes
from parcelry.llm.topk import best_pairs, integer_vectors, top_inner_products
from parcelry.llm.toxicity import Objective, fit_severity, score_severity
from parcelry.llm import toxicity, warc
from parcelry.llm.words import PLAIN, Words
from parcelry.llm.warc import LoserTree, merge_index, payload_digest, read_archives, url_key, write_archives

DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (None, "one two"), (3, "x " * 30_000), (4, "same"), (4, "same"), (None, None)]


# Toxicity -------------------------------------------------------------------------------------------


def graded(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for i in range(n):
        grade = rng.choice([0, 0, 0, 1, 2])
        bad = [rng.choice(["idiot", "scum"]) for _ in range(grade)] + [f"awfu{word()}" for _ in range(2 * grade)] + (["vicious"] if grade == 2 else [])
        words = [word() for _ in range(rng.randrange(10, 80))] + bad
        rng.shuffle(words)
        out.append((i, " ".join(words).capitalize(), grade))
    return out


def test_severity_on_held_out_rows(spark):
    train, test = spark.createDataFrame(graded(1, 600), DOC + ", grade int"), spark.createDataFrame(graded(2, 300), DOC + ", grade int").withColumnRenamed("grade", "truth")
    model = fit_severity(train.select("doc_id", "text"), train.select("doc_id", "grade"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = score_severity(test, model).collect()
    assert np.mean([r["toxic"] == (r["truth"] > 0) for r in got]) > 0.97
    assert np.mean([r["grade"] == r["truth"] for r in got]) > 0.9
    means = [np.mean([r["expected_severity"] for r in got if r["truth"] == g]) for g in range(3)]
    assert means[0] < 0.2 < means[1] < 1.5 < means[2]


def test_severity_of_the_given_labels_on_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").alias("grade")), "doc_id")
    model = fit_severity(docs, rows.filter("doc_id % 4 > 0"))
    got = score_severity(rows.filter("doc_id % 4 = 0"), model).collect()
    truth = {r["doc_id"]: r["grade"] for r in rows.collect()}
    wrong_clean = [r for r in got if r["toxic"] and not truth[r["doc_id"]]]
    found = [r for r in got if r["toxic"] and truth[r["doc_id"]]]
    # Some labels have no sign of it in the text, and this table is small.
    assert not wrong_clean and len(found) >= 0.4 * sum(truth[r["doc_id"]] for r in got)


def test_severity_defined_cases(spark):
    train = spark.createDataFrame(graded(3, 200) + [(900, None, 1), (901, "text", None), (None, "text", 1)], DOC + ", grade int")
    fit = lambda df: fit_severity(df.drop("grade"), df.drop("text"))
    odd = spark.createDataFrame(ODD, DOC).withColumns({n: F.lit("kept") for n in ("grade", "toxic", "feature", "label", "weights")})
    got = score_severity(odd, fit(train)).collect()
    assert len(got) == len(ODD) and all(r["label"] == "kept" and r["grade"] == 0 and not r["toxic"] for r in got)
    empty = spark.createDataFrame([], DOC + ", grade int")
    none = fit(empty)
    assert {r["grade"] for r in score_severity(odd, none).collect()} == {0}
    assert {r["expected_severity"] for r in score_severity(odd, fit(train.filter("grade = 0"))).collect()} == {0.0}
    assert score_severity(empty.select("doc_id", "text"), none).count() == 0


def plain_loss(x, rows, grades, top, l2, prior):
    """The likelihood by its definition, text by text."""
    k = len(x) - top
    theta, total = [x[k]], 0.0
    for step in x[k + 1 :]:
        theta.append(theta[-1] + np.exp(step))
    for row, grade in zip(rows, grades):
        at_least = lambda g: 1.0 if g == 0 else 0.0 if g > top else 1 / (1 + np.exp(theta[g - 1] - sum(v * x[c] for c, v in row.items())))
        total -= np.log(at_least(grade) - at_least(grade + 1))
    return total / len(rows) + l2 / 2 * sum(w * w for w in x[:k]) + sum((a - b) ** 2 for a, b in zip(x[k:], prior)) / 2 / len(rows)


def test_the_fit_descends_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(21)
    grades = rng.choice([0, 0, 1, 2, 3], 40)
    rows = [{int(c): float(rng.uniform(0.5, 2)) + (g if c == 1 else 0) for c in rng.choice(5, 3, replace=False)} for g in grades]
    row = np.repeat(np.arange(40), 3)
    col, value = (np.array([f(i) for r in rows for i in r.items()]) for f in (lambda i: i[0], lambda i: i[1]))
    goal = Objective(grades, row, col, value, 5, 3, 0.01)
    x = goal.start() + rng.normal(0, 0.3, 8)
    loss, gradient = goal(x)
    assert np.isclose(loss, plain_loss(x, rows, grades, 3, 0.01, goal.prior))
    for i in range(len(x)):
        step = np.zeros(8)
        step[i] = 1e-5
        slope = (plain_loss(x + step, rows, grades, 3, 0.01, goal.prior) - plain_loss(x - step, rows, grades, 3, 0.01, goal.prior)) / 2e-5
        assert np.isclose(gradient[i], slope, atol=1e-7)
    weights, thresholds = toxicity._fit(goal, 2000)
    end = np.concatenate([weights, thresholds[:1], np.log(np.diff(thresholds))])
    assert np.abs(goal(end)[1]).max() < 0.01 < np.abs(goal(goal.start())[1]).max() and list(thresholds) == sorted(thresholds)


def test_the_fitting_sample_is_bounded(spark, monkeypatch):
    sizes = {}
    real = toxicity.keep
    monkeypatch.setattr(toxicity, "keep", lambda df, name: sizes.setdefault(name, real(df, name)))
    docs = graded(5, 300)
    many = spark.createDataFrame([(7, f"{docs[7][1]} {i}") for i in range(5000)] + [d[:2] for d in docs], DOC)
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs] + [(7, 2), (8, -3), (9, 10**6), (10, None)], "doc_id long, grade int")
    fit_severity(many, labels, sample_rows=10)
    assert sizes["drawn"].count() == 10 and sizes["sample"].count() <= 10
    sizes.clear()
    model = fit_severity(many, labels)
    sample = sizes["sample"].collect()
    assert len(sample) == 300 and len(model.thresholds) == 2
    assert [r["grade"] for r in sample if r["text"].startswith(docs[7][1])] == [2]


def word_features(text):
    """The word and prefix hashes of each word of a text, word by word."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [toxicity._features(Words(pa.array([w]), PLAIN))[1].tolist() for w in words]


def test_feature_choice_and_scores_equal_plain_loops(spark):
    train, test = graded(11, 300), graded(12, 60)
    df = spark.createDataFrame(train, DOC + ", grade int")
    model = fit_severity(df.select("doc_id", "text"), df.select("doc_id", "grade"))
    n, bad = Counter(), Counter()
    for _, text, grade in train:
        present = {f for fs in word_features(text) for f in fs}
        n.update(present)
        bad.update(present if grade else ())
    other, clean = sum(g > 0 for *_, g in train), sum(g == 0 for *_, g in train)

    def z(f):
        share = n[f] / (other + clean)
        return abs(bad[f] / other - (n[f] - bad[f]) / clean) / math.sqrt(max(share * (1 - share), 1e-9) * (1 / other + 1 / clean))

    assert set(model.features.tolist()) == {f for f in n if n[f] >= 3 and z(f) >= 4.5}
    weights, odd = dict(zip(model.features.tolist(), model.weights)), [(900, None, 0), (901, "", 0), (902, "idiot " * 500, 0)]
    got = {r["doc_id"]: r for r in score_severity(spark.createDataFrame(test + odd, DOC + ", truth int"), model).collect()}
    for i, text, _ in test + odd:
        counts = Counter(f for fs in word_features(text) for f in fs if f in weights)
        margin = sum(math.log1p(c) * weights[f] for f, c in counts.items())
        at_least = [1 / (1 + math.exp(t - margin)) for t in model.thresholds]
        each = [a - b for a, b in zip([1.0, *at_least], [*at_least, 0.0])]
        assert abs(got[i]["expected_severity"] - sum(at_least)) < 1e-9 and got[i]["toxic"] == (at_least[0] >= 0.5) and got[i]["grade"] == each.index(max(each))


# Packing --------------------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_open_bin():
    rng = random.Random(4)
    sizes = (8, 16, 32)
    lengths = sorted((rng.randrange(0, 33) for _ in range(500)), reverse=True)
    at, used = best_fit(lengths, sizes, sequence_cost)
    room, opened = {}, 0
    for n, b in zip(lengths, at):
        fitting = {x: r for x, r in room.items() if r >= n}
        if b == opened:
            assert not fitting
            opened += 1
            room[b] = None
            continue_with = [s for s in sizes if s >= n]
            # The opened size shows in what later fits; any permitted size that holds the piece is valid.
            room[b] = max(continue_with) - n
            total = sum(m for m, c in zip(lengths, at) if c == b)
            room[b] = min(s for s in sizes if s >= max(total, n)) - n if total else room[b]
        else:
            assert b in room
            room[b] -= n
    assert used == [sum(n for n, b in zip(lengths, at) if b == x) for x in range(len(used))] and max(used) <= 32


def plain_packing(lengths, sizes):
    """Best fit by falling length with lists: the tightest open bin, else the size of least cost per token filled greedily with what is left."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        n = left.pop(0)
        open_bins = [b for b in bins if b["room"] >= n]
        if open_bins:
            b = min(open_bins, key=lambda b: b["room"])
        else:
            def price(size):
                space = size - n
                for m in left:
                    space -= m if m <= space else 0
                return sequence_cost(size) / max(1, size - space)

            b = {"room": min((x for x in sizes if x >= n), key=price), "has": []}
            bins.append(b)
        b["room"] -= n
        b["has"].append(n)
    return sorted((min(x for x in sizes if x >= sum(b["has"])), sorted(b["has"])) for b in bins)


def test_whole_packing_costs_what_the_plain_one_costs(spark):
    rng = random.Random(8)
    sizes = (32, 64, 128)
    docs = [(i, "w " * rng.choice([0, 1, 5, 31, 60, 127, 128, 129, 300, rng.randrange(200)])) for i in range(150)]
    rows = pack_best_fit(spark.createDataFrame(docs, DOC), sizes=sizes).collect()
    pieces = [n for _, t in docs for c in [len(t.split())] for n in ([128] * (-(-c // 128) - 1) + [c - 128 * (-(-c // 128) - 1)] if c else [0])]
    bins = {}
    for r in rows:
        bins.setdefault((r["bin"], r["bin_size"]), []).append(r["n_tokens"])
    got = sorted((size, sorted(own)) for (_, size), own in bins.items())
    want = plain_packing(pieces, sizes)
    cost = lambda found: sum(sequence_cost(size) for size, _ in found)
    # Bins of equal room may be taken in another order, which later pieces do not feel in sum.
    assert sorted(n for _, own in got for n in own) == sorted(pieces) and len(got) == len(want) and math.isclose(cost(got), cost(want))


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 100, 300]))) for i in range(400)] + ODD
    df = spark.createDataFrame(docs, DOC).withColumns({n: F.lit("x") for n in ("id", "bin", "row", "group", "length")})
    got = pack_best_fit(df, sizes=(32, 64, 128), group_pieces=100).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["id"], []).append(r)
    for i, text in docs[:400]:
        own = sorted(pieces[i], key=lambda r: r["piece"])
        if i not in (1, 2, 3, 4):
            assert sum(r["n_tokens"] for r in own) == len(text.split())
            assert [r["first_token"] for r in own] == [128 * k for k in range(len(own))]
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) for _, t in docs)
    bins = {}
    for r in got:
        bins.setdefault(r["bin"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: (r["bin_offset"], r["n_tokens"]))
        total = sum(r["n_tokens"] for r in own)
        assert {r["bin_size"] for r in own} == {min(s for s in (32, 64, 128) if s >= total)}
        assert [r["bin_offset"] for r in own] == [sum(x["n_tokens"] for x in own[:k]) for k in range(len(own))]
    assert sum(r["n_tokens"] for r in got) / sum(o[0]["bin_size"] for o in bins.values()) > 0.9
    assert pack_best_fit(spark.createDataFrame([], DOC)).count() == 0
    given = pack_best_fit(spark.createDataFrame([(1, None), (2, -3), (3, 5)], "doc_id long, n int"), tokens=F.col("n"), text_col="n").collect()
    assert sorted((r["id"], r["n_tokens"]) for r in given) == [(1, 0), (2, 0), (3, 5)]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_opens_the_size_of_least_cost(seed):
    """Each step against plain searches: the tightest open bin, or else the size whose cost per token is least when filled by what still waits, longest first."""
    rng = random.Random(seed)
    sizes = ((8, 16, 32), (4, 64), (10, 20, 40, 80), (32,))[seed]
    lengths = sorted((rng.randrange(0, sizes[-1] + 1) for _ in range(300)), reverse=True)
    at, used = best_fit(lengths, sizes, sequence_cost)
    room, held = {}, Counter()
    for i, (n, b) in enumerate(zip(lengths, at)):
        fitting = [r for r in room.values() if r >= n]
        if b in room:
            assert room[b] == min(fitting)
        else:
            assert not fitting and b == len(room)

            def price(size):
                left = size - n
                for m in lengths[i + 1 :]:
                    left -= m if m <= left else 0
                return sequence_cost(size) / max(1, size - left)

            room[b] = min((s for s in sizes if s >= n), key=price)
        room[b] -= n
        held[b] += n
    assert [held[b] for b in range(len(used))] == used and all(r >= 0 for r in room.values())


# Sharding -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["mixed", "one text", "repeated", "null ids", "few", "odd"])
def test_shards(spark, kind):
    rng = random.Random(6)
    docs = {
        "mixed": [(i, "x" * rng.randrange(1, 200) + str(i % 700)) for i in range(3000)],
        "one text": [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)],
        "repeated": [(1, "the same row")] * 2500 + [(i, f"text {i}") for i in range(500)],
        "null ids": [(None, "the same row")] * 2000 + [(None, None)] * 1000,
        "few": [(i, str(i)) for i in range(5)],
        "odd": ODD,
    }[kind]
    df = spark.createDataFrame(docs, DOC).repartition(5).withColumns({n: F.lit("kept") for n in ("bin", "base", "cuts", "before", "size", "slot", "k1", "label", "__bin", "__base", "__before", "__K1", "__cuts", "__at", "___piece")})
    got = shard_by_bytes(df, shards=7, piece_bytes=4000).collect()
    assert len(got) == len(docs) and all(r["label"] == r["base"] == r["__base"] == r["__K1"] == r["___piece"] == "kept" for r in got)
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < 7 and sorted(r["slot"] for r in own) == list(range(len(own))) for s, own in by.items())
    if len(docs) > 100:
        sizes = [sum(r["size"] for r in own) for own in by.values()]
        assert len(by) == 7 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got) + 0.002 * sum(sizes) / 7


@pytest.mark.parametrize("kind", ["groups", "repeated"])
def test_shards_equal_a_plain_sorted_cut(spark, kind):
    rng = random.Random(7)
    docs = [(i, "x" * rng.randrange(1, 300) + str(i % 900)) for i in range(3000)] + [(5, "again")] * (1500 if kind == "repeated" else 1)
    df = spark.createDataFrame(docs, DOC).repartition(3)
    got = shard_by_bytes(df, shards=9, piece_bytes=3000, tolerance=0.002, keep_group=0.01).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("doc_id")}).collect()
    got.sort(key=lambda r: (r["shard"], r["slot"]))
    assert [(r["k1"], r["k2"]) for r in got] == sorted((r["k1"], r["k2"]) for r in got)
    edges, groups, done = [0], [0], 0
    for r, after in zip(got, [*got[1:], None]):
        done += r["size"]
        edges.append(done)
        if after is None or after["text"] != r["text"]:
            groups.append(done)
    share = done / 9
    for shard in range(1, 9):
        cut = sum(r["size"] for r in got if r["shard"] < shard)
        near = lambda places: min(abs(x - share * shard) for x in places)
        small = [b for a, b in zip(groups, groups[1:]) if b - a <= 0.01 * share]
        assert abs(cut - share * shard) <= max(0.002 * share, near(edges), near(small) if cut in groups else 0)


def test_equal_texts_stay_together(spark):
    docs = [(i, f"text {i // 4}") for i in range(4000)]
    got = shard_by_bytes(spark.createDataFrame(docs, DOC), shards=8).groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert got.filter("n > 1").count() == 0
    assert shard_by_bytes(spark.createDataFrame([], DOC)).count() == 0


def test_equal_texts_of_the_given_table_share_a_shard(spark):
    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    got = shard_by_bytes(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), shards=24)
    share = got.agg(F.sum("size") / 24).collect()[0][0]
    groups = got.groupBy("text").agg(F.count_distinct("shard").alias("n"), F.sum("size").alias("bytes")).filter(F.col("bytes") <= 0.1 * share)
    assert groups.count() > 500 and groups.filter("n > 1").count() == 0
    sizes = [r[0] for r in got.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 24 and max(sizes) < 1.1 * share and min(sizes) > 0.9 * share


# Chat windows ---------------------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string"
CONTROL = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[\\INST]", "<\\\\|im_end|>\n", "<", "[", "\\", "<<|im_end|>", "$1", "\n", "é😀"]


def talks(seed, n=30):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        roles = (["system"] if rng.random() < 0.4 else []) + [("user", "assistant")[k % 2] for k in range(rng.randrange(1, 14))]
        for i, role in enumerate(roles):
            words = [rng.choice(CONTROL + ["word", "other"]) for _ in range(rng.choice([0, 3, 20, 90]))]
            out.append((c, i, role, rng.choice([" ", ""]).join(words)))
    rng.shuffle(out)
    return out


def test_escapes_are_reversible(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(CONTROL + ["/", "INST]", "s>", "SYS>>"]) for _ in range(8)) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).withColumn("u", unescape(F.col("e"))).collect()
    for r in got:
        assert r["u"] == r["t"] and not re.search(r"<\|im_(start|end)\|>|</?s>|\[/?INST\]|<</?SYS>>", r["e"])


def test_windows_hold_every_turn_once_and_train_each_answer_once(spark):
    turns = talks(8) + [(50, 0, None, None), (50, None, "assistant", "early"), (50, 0, "a\nb %", "x"), (50, 0, "a\nb %", "x"), (None, 0, "user", "hi"), (None, 1, "assistant", "ho")]
    df = spark.createDataFrame(turns, TURN).repartition(3).withColumns({n: F.lit(1) for n in ("window", "tokens", "t", "starts", "formatted")})
    windows = chat_windows(df, budget=60, history_turns=2, history_budget=30)
    got = {r["conv_id"]: r for r in read_windows(windows).collect()}
    convs = {}
    for c, i, role, text in turns:
        convs.setdefault(c, []).append((i is not None, i or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, own in convs.items():
        own.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(role, text) for _, _, role, text in own]
        assert got[c]["loss_text"] == "".join(text for _, _, role, text in own if role == "assistant")
    rows = windows.collect()
    assert sum(len(r["formatted"]) for r in rows) == sum(r["formatted_chars"] for r in got.values())
    for r in rows:
        pieces = r["formatted"].split(CLOSE)[:-1]
        assert all(p.startswith(OPEN) for p in pieces)
        system = convs[r["conv_id"]][0][2] == "system"
        assert pieces[0].startswith(OPEN + "system\n") == system
        assert len(pieces) - r["n_repeated"] == 1 or r["n_tokens"] <= 60
        assert r["n_repeated"] <= 2 + system and (r["window"] > 0 or r["n_repeated"] == 0)
        assert r["n_tokens"] <= 60 or r["n_repeated"] == system * (r["window"] > 0)
    assert chat_windows(spark.createDataFrame([], TURN)).count() == 0 and read_windows(chat_windows(spark.createDataFrame([], TURN))).count() == 0


def test_windows_keep_their_budget(spark):
    """Only a turn that with the system turn alone exceeds the budget does; the first conversation is one that history would push over it."""
    rng = random.Random(9)
    lengths = [[400, 400, 200, 900, 100], *[[rng.randrange(0, 2048) for _ in range(rng.randrange(1, 9))] for _ in range(60)]]
    turns = [(c, i, "system" if c % 2 and not i else ("user", "assistant")[i % 2], "w " * n) for c, own in enumerate(lengths) for i, n in enumerate(own)]
    windows = chat_windows(spark.createDataFrame(turns, TURN), budget=1024, history_turns=2, history_budget=900).collect()
    first = {}
    for r in windows:
        own, system = lengths[r["conv_id"]], r["conv_id"] % 2
        at = first.get(r["conv_id"], 0)
        n_new = len(r["formatted"].split(CLOSE)) - 1 - r["n_repeated"]
        first[r["conv_id"]] = at + n_new
        alone = own[at] + 4 + (own[0] + 4 if system and at else 0)
        assert r["n_tokens"] <= 1024 or (alone > 1024 and n_new == 1 and r["n_tokens"] == alone)
    assert [first[c] for c in range(len(lengths))] == [len(own) for own in lengths]


# WARC -----------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, captured timestamp"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_archives_round_trip(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "_BROADCAST_ROWS", broadcast)
    rng = random.Random(9)
    evil = "\r\n\r\nWARC/1.1\r\n"
    bodies = ["", None, evil, evil + evil, "a" + evil + "WARC-Type: response\r\n\r\nb", "\r\n\r\n", "x\r\n", "\n", "é" * 10, "WARC/1.1\r\n", "a" + evil[:-2]]
    bodies += ["".join(rng.choice(["\r", "\n", "W", "\r\n", evil, "text"]) for _ in range(20)) for _ in range(60)]
    pages = [(i, f"HTTP://www.Ex.com:80/a b%20{i % 3}\n", html, None) for i, html in enumerate(bodies * 2)] + [(None, None, "null id", None), (7, "u", bodies[7], None)]
    path = str(tmp_path / "warc")
    df = spark.createDataFrame(pages, PAGE).withColumns({n: F.lit(1) for n in ("digest", "first", "body", "n", "rows")}).repartition(3)
    write_archives(df, path)
    got = read_archives(spark, path).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, html, _ in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for i, url, html, _ in pages:
        r = by[i].pop()
        want = first.get(html or "")
        assert (r["payload_bytes"], r["payload_digest"]) == (len((html or "").encode()), b32(html))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want in (i, None) else ("revisit", want))
    for archive in glob.glob(path + "/*.gz"):
        stream = gzip.open(archive).read()
        for r in got:
            if r["archive"].endswith(os.path.basename(archive)):
                assert stream[r["record_at"] :].startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())


def test_small_payloads_are_responses_and_an_empty_table_gives_none(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abc", None), (4, "u", "abc", None)], PAGE)
    write_archives(pages, str(tmp_path / "a"), min_revisit_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in read_archives(spark, str(tmp_path / "a")).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    write_archives(pages.limit(0), str(tmp_path / "b"))
    assert merge_index(read_archives(spark, str(tmp_path / "b")).withColumn("url_key", url_key(F.col("url")))).count() == 0


def test_digest_and_keys(spark):
    df = spark.createDataFrame([("",), ("é text",)], "x string").select("x", payload_digest(F.col("x")).alias("d"))
    assert all(r["d"] == b32(r["x"]) for r in df.collect())
    urls = {"https://www.Blog.Example.com:443/Path?Q=1#top": "com,example,blog)/path?q=1", "http://user@example.org": "org,example)", "": ")", None: ")"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_key(F.col("u")).alias("k")).collect()
    assert {r["u"]: r["k"] for r in got} == urls


def test_loser_tree_merges_sorted_runs():
    rng = random.Random(10)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(0, 12))) for _ in range(k)]
        got = [(runs[r][i], r) for r, i in LoserTree(runs)]
        assert got == sorted((x, r) for r, run in enumerate(runs) for x in run)
    assert list(LoserTree([])) == []


def test_index_is_in_one_global_order(spark):
    rng = random.Random(11)
    data = [(f"k{rng.randrange(4)}" if rng.random() < 0.9 else None, str(rng.randrange(50)), i, f"archive{i % 5}", (1 << 60) + i if i % 2 else None) for i in range(2000)]
    df = spark.createDataFrame(data, "url_key string, captured string, page_id long, archive string, refers_to long").repartition(5, "archive")
    got = merge_index(df, range_rows=300).collect()
    got.sort(key=lambda r: r["position"])
    key = lambda r: (r[0] is not None, r[0] or "", r[1], r[2])
    assert [tuple(r)[:5] for r in got] == sorted(data, key=key) and [r["position"] for r in got] == list(range(len(data)))


def test_the_tree_gets_every_run_in_its_own_order(spark, monkeypatch):
    rng = random.Random(31)
    data = [(f"u{rng.randrange(9)}", f"t{rng.randrange(50):02}", i, f"a{i % 6}", "kept") for i in range(2000)]
    df = spark.createDataFrame(data, "url_key string, captured string, page_id long, archive string, __run string").repartition(4)
    kept = {}
    real = warc.keep
    monkeypatch.setattr(warc, "keep", lambda df, name: kept.setdefault(name, real(df, name)))
    got = merge_index(df, range_rows=400).collect()
    runs = kept["runs"].collect()
    number, run = kept["runs"].columns[-1], kept["runs"].columns[-2]
    by = {}
    for r in sorted(runs, key=lambda r: r[number]):
        by.setdefault(r[run], []).append((r["url_key"], r["captured"], r["page_id"]))
    assert len(by) > 6 and all(keys == sorted(keys) for keys in by.values())
    ranges = kept["merged"].groupBy(kept["merged"].columns[-2]).count().count()
    assert ranges > 3 and {r["__run"] for r in got} == {"kept"}
    assert [r["page_id"] for r in sorted(got, key=lambda r: r["position"])] == [r[2] for r in sorted(data)]


# Top-k ----------------------------------------------------------------------------------------------


def top(rows, k, every):
    """Every row with an id divisible by ``every`` against every other row of its length, by Python integers."""
    out = []
    for n, (q, v) in enumerate(rows):
        if q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v))[:k]
            out += [(q, rank, None if none else i, max(min(-s, 2**63 - 1), -(2**63))) for rank, (s, none, i) in enumerate(scored, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("scale, group", [(1, 64), (64, 7), (10**7, 50), (10**14, 40)])
def test_top_k_equals_brute_force(spark, scale, group):
    rng = random.Random(12)
    rows = [(i, [rng.randrange(-9, 10) * scale * (1 + 9 * (i % 17 == 0)) for _ in range(6)]) for i in range(200)]
    rows += [(i, rows[3][1]) for i in range(200, 230)] + [(3, rows[3][1]), (10, rows[5][1]), (10, rows[10][1]), (None, rows[3][1]), (None, rows[17][1])] + [(40, rows[7][1])] * 30
    rows += [(i, [rng.randrange(-9, 10) * scale for _ in range(3)]) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = top_inner_products(df, queries="vec_id % 10 = 0", k=5, group_rows=(group, 2 * group), lead=2)
    assert sorted(map(tuple, got.collect()), key=repr) == top(rows, 5, 10)


def test_top_k_of_huge_components(spark):
    data = [(0, [1e18, 2.0]), (1, [-1e18, 1.0]), (2, [1e18, 3.0]), (3, [0.5, 0.5]), (20, [1e38, 1.0]), (21, [2e38, 0.0])]
    ints = integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    rows = [(r["vec_id"], [int(x) for x in r["v"]]) for r in ints.collect()]
    assert rows[3][1] == [32, 32] and len(rows) == 6
    for k in (2, 5):
        assert sorted(map(tuple, top_inner_products(ints, k=k, group_rows=(2, 2)).collect()), key=repr) == top(rows, k, 20)


def test_top_k_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [0.5, -0.51]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (20, [0.0, 0.0]), (40, []), (41, [])]
    names = ("v", "score", "rank", "block", "row", "norm", "dims", "asked", "group", "piece", "least", "last", "need")
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in names})
    ints = integer_vectors(df)
    assert [(r["vec_id"], r["v"]) for r in ints.collect()] == [(0, [32, -33]), (1, [64, 64]), (None, [64, 64]), (6, [64]), (20, [0, 0]), (40, []), (41, [])]
    got = sorted(map(tuple, top_inner_products(ints).collect()), key=repr)
    assert got == sorted([(0, 1, 20, 0), (0, 2, 1, -64), (0, 3, None, -64), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, None, 0), (40, 1, 41, 0)], key=repr)
    assert top_inner_products(ints.limit(0)).count() == 0 and top_inner_products(ints.filter("vec_id = 1")).count() == 0
    assert top_inner_products(ints.filter("vec_id = 20")).count() == 0


def test_pruned_pairs_are_never_among_the_best():
    rng = np.random.default_rng(13)
    c = rng.integers(-50, 50, (900, 8)) * np.linspace(3, 1, 900)[:, None].astype(int)
    c = c[np.argsort(-np.linalg.norm(c, axis=1))]
    q = c[::40]
    axes = np.linalg.svd((c.T @ c).astype(float))[0]
    ids = np.arange(900)
    rows, found, scores = best_pairs(ids[::40], q.astype(float), np.full(len(q), -np.inf), np.full(len(q), np.iinfo(np.int64).max), ids, ids, c.astype(float), 10, 3, axes)
    rows = ids[::40][rows]
    for i, v in zip(ids[::40], q):
        exact = sorted((-int(v @ c[j]), j) for j in ids if j != i)[:10]
        assert [(-s, f) for r, f, s in zip(rows, found, scores) if r == i] == exact
