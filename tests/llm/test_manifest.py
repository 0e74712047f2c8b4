"""The Merkle manifest against a plain tree, and its defined cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parcelry.llm.merkle import folded_root, hashed, leaf_digest, merkle_manifest, proof_digest

ROW = "source string, doc_id long, leaf string"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_tree(leaves):
    """Levels of digests from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    groups = {}
    for source, doc, leaf in rows:
        groups.setdefault(source, []).append((doc is not None, doc or 0, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for *_, leaf in sorted(groups[s])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (has, doc, leaf) in enumerate(sorted(groups[s])):
            out.append((s, doc if has else None, leaf, i, trees[s][-1][0], top[-1][0], plain_path(trees[s], i) + plain_path(top, k)))
    return out, trees


def made(seed, sizes):
    rng = random.Random(seed)
    rows = [(s, rng.choice([None, rng.randrange(n), i]), digest(f"{rng.random()}")) for s, n in sizes.items() for i in range(n)]
    rows += rows[:2]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 3}, {"b": 82}, {"a": 4, "Z": 81, None: 2, "é": 1, "": 28}, {f"s{i}": i % 5 + 1 for i in range(90)}, {"big": 6700, "small": 5}])
def test_equals_a_plain_tree(spark, sizes):
    rows = made(len(sizes), sizes)
    got = merkle_manifest(spark.createDataFrame(rows, ROW))
    want, trees = plain_manifest(rows)
    found = [(r["source"], r["doc_id"], r["leaf"], r["rank"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["path"]]) for r in got.rows.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    nodes = [(s, k, i * 3**k, min((i + 1) * 3**k, len(t[0])), d) for s, t in trees.items() for k, level in enumerate(t) for i, d in enumerate(level)]
    assert sorted(((r["source"], r["level"], r["lo"], r["hi"], r["digest"]) for r in got.nodes.collect()), key=repr) == sorted(nodes, key=repr)


def test_proofs_fold_to_the_root_and_show_a_change(spark):
    rows = spark.createDataFrame(made(3, {"a": 200, "b": 7}), ROW)
    out = merkle_manifest(rows).rows.withColumns({"fold": folded_root(F.col("leaf"), "path"), "wrong": folded_root(hashed(F.col("leaf")), "path"), "proof": proof_digest("path")})
    for r in out.collect():
        assert r["fold"] == r["root"] != r["wrong"] and r["proof"] == digest(*[s[k] for s in r["path"] for k in ("before", "after")])


def test_leaf_digest_tells_null_from_text(spark):
    text = "zwei\nZeilen, ä"
    df = spark.createDataFrame([(1, text), (2, None), (3, "-"), (4, "")], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", leaf_digest(F.col("doc_id"), F.col("text"))).collect()}
    assert got == {1: digest("1:1", f"{len(text.encode())}:", text), 2: digest("1:2", "-"), 3: digest("1:3", "1:-"), 4: digest("1:4", "0:")}


def test_defined_cases(spark):
    empty = merkle_manifest(spark.createDataFrame([], ROW))
    assert empty.rows.collect() == [] and empty.nodes.collect() == []
    # Rows that repeat in full, null ids and null groups; other columns stay, those named like a result are replaced.
    names = ("grp", "block", "members", "Rank", "digest", "n", "of", "range", "tie", "carried")
    rows = [("a", 1, "x")] * 90 + [(None, None, "y")] * 3 + [("a", None, "w")]
    df = spark.createDataFrame(rows, ROW).withColumns({n: F.lit("kept") for n in names})
    got = merkle_manifest(df).rows
    assert sorted(got.columns) == sorted({"source", "doc_id", "leaf", "rank", "subroot", "root", "path", *names} - {"Rank"})
    found = got.collect()
    want, _ = plain_manifest(rows)
    assert sorted(((r["source"], r["doc_id"], r["leaf"], r["rank"], r["root"]) for r in found), key=repr) == sorted(((s, d, leaf, i, root) for s, d, leaf, i, _, root, _ in want), key=repr)
    assert {r["block"] for r in found} == {"kept"}
