"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset verification.

A document is the multiset of its five-word shingles. For a shingle of weight c the weight axis (0, c]
is cut at 1, 2, 4, 8, ...; each piece carries its own Poisson process whose points have a time, a
register and a place in the piece, all drawn from the shingle's hash. A document sees the
points whose place is within its weight, and each register keeps the earliest time. Two documents
agree in a register with probability sum(min) / sum(max), the weighted Jaccard similarity.
Points later than the slowest register cannot matter, so processes stop early.

Equal word sequences collapse to one node first. Nodes that agree in a whole band share a bucket. A
bucket never lists its pairs: its members are verified against the member that shares
most buckets. Members that are still in different components after that are compared across components only, and only
where they share one of the rarest of their shingles, of which sizes and the shingles that nobody else has leave few
(a prefix filter). Verification computes the multiset Jaccard similarity from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.operators.components import connected_components
from parcelry.sources.scratch import discard, keep
from parcelry.llm.names import unused
from parcelry.operators.lookups import looked_up
from parcelry.llm.words import PLAIN, Words, mix, slices

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)
_GROUP_WORDS = 30_000
_CHUNK_WORDS = 50_000


def near_duplicate_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    bands: int = 20,
    rows: int = 4,
) -> DataFrame:
    """Give every document the class of those it is linked with, directly or through others.

    Two documents are linked if their multisets of ``shingle``-word shingles have a Jaccard
    similarity sum(min) / sum(max) of at least ``threshold``; words are runs of ASCII letters (A-Z
    lower-cased), digits and non-ASCII characters. A document of fewer words is one
    shingle. At the threshold a pair shares no band with probability (1 - threshold ** rows) ** bands,
    3e-5 at the defaults and less above; every pair that shares one is linked exactly. Returns the
    columns of ``docs`` with ``class_id`` (smallest id in the class) and ``representative`` (true for one
    row of each class, one with that id).

    Defined cases: a document without words (null, empty, only punctuation) is a class of its own, its own
    representative; repeated rows are in one class; a null id never becomes a class id
    unless all ids of the class are null; an empty table gives an empty result. Columns of
    ``docs`` named like an added one are replaced, all others stay, whatever their names.
    """
    docs = docs.drop("class_id", "representative")
    helpers = unused(docs, "row", "k1", "k2", "n", "bands")
    docs = docs.withColumn(helpers[0], F.monotonically_increasing_id())
    at = docs.columns.index(text_col)
    added = ", ".join(f"{c} {t}" for c, t in zip(helpers[1:], ("long", "long", "long", "array<long>")))
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(added).fields])
    whole = keep(docs.mapInArrow(lambda batches: _signed(batches, at, helpers[1:], shingle, bands, rows), schema), "signed")
    signed = whole.select(*[F.col(c).alias(n) for c, n in zip(helpers, ("__row", "__k1", "__k2", "__n", "__bands"))], F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    content = signed.filter("__n > 0").groupBy("__k1", "__k2").agg(F.min("__row").alias("node"))
    nodes = keep(content, "nodes")
    members = keep(signed.select("__row", "id", "__k1", "__k2", "__n").join(nodes, ["__k1", "__k2"], "left").select("__row", "id", "__n", F.coalesce("node", "__row").alias("node")), "members")
    # A node is one of its own rows, so its bands come from that row.
    bucketed = keep(
        signed.select("__row", "__n", "__bands").join(nodes.select(F.col("node").alias("__row")), "__row").select(F.col("__row").alias("node"), F.col("__n").alias("n"), F.explode("__bands").alias("bucket")),
        "bands",
    )
    sizes = keep(bucketed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    shared = keep(looked_up(bucketed, sizes, "bucket", "size"), "shared")
    discard(nodes, bucketed, sizes)
    # Only texts that share a bucket are compared; they move once here, and later joins move them alone.
    # Lists of nodes grow with the corpus, so joins with texts are merges at every size.
    suspects = shared.select("node").distinct()
    texts = keep(signed.select(F.col("__row").alias("node"), "text").join(suspects.hint("merge"), "node"), "suspects")

    reach = shared.groupBy("node").agg(F.sum("size").alias("reach"))
    led = keep(shared.join(reach, "node").groupBy("bucket").agg(F.max(F.struct("reach", -F.col("node"), F.col("n"))).alias("top")).select("bucket", (-F.col("top.col2")).alias("leader"), F.col("top.n").alias("leader_n")), "leaders")
    star = shared.join(led, "bucket").filter("leader <> node").filter(_sizes_allow("leader_n", "n", threshold)).select("leader", "leader_n", "node", "n").distinct()
    star = keep(star, "star")
    edges = keep(verified(star, texts, shingle, threshold), "edges")
    discard(led, star)
    labels = connected_components(edges)

    # What is still apart within a bucket is compared across components only, and only where a link is possible.
    apart = shared.select("bucket", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = keep(apart, "apart")
    split = keep(apart.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket"), "split")
    left = keep(apart.join(split, "bucket").select("bucket", "node", "n", "component"), "left")
    discard(apart, split, shared)
    if left.head(1):
        more = keep(_linked_across(left, texts, shingle, threshold), "more")
        if more.head(1):
            labels = connected_components(edges.unionByName(more))
        discard(more)
    discard(left, texts, edges)

    classed = keep(members.join(labels, "node", "left").select("__row", "id", F.coalesce("component", "node").alias("component")), "classed")
    first = keep(classed.groupBy("component").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("first")).select("component", "class_id", F.col("first.__row").alias("first_row")), "first")
    final = classed.join(first, "component").select("__row", "class_id", (F.col("first_row") == F.col("__row")).alias("representative"))
    return whole.drop(*helpers[1:]).join(final.withColumnRenamed("__row", helpers[0]), helpers[0]).drop(helpers[0])


def _sizes_allow(a: str, b: str, threshold: float) -> F.Column:
    """The similarity is at most the ratio of the sizes."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(threshold)


def _prefixes(left: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(node, n, component, spare, h): the rarest shingles of the members of divided buckets, as many as a link needs.

    ``spare`` are the shingles that a member shares with any other. Members linked with a member of size n share at least threshold * n
    shingles. So if each lists its shingles from the rarest on, they meet within the first n - threshold * n + 1, and those that nobody
    else has are the first of these. Most of a crowd of similar documents that each miss the threshold have no place left and leave here.
    """
    nodes = left.select("node", "n", "component").distinct()
    counted = keep(nodes.join(texts.hint("merge"), "node").select("node", "text").mapInArrow(lambda batches: _shingles(batches, shingle), "node long, h long, w long"), "shingles")
    common = keep(counted.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "common")
    shared = keep(looked_up(counted, common, "h", "df"), "shared")
    spare = shared.groupBy("node").agg(F.sum("w").alias("spare"))
    room = F.col("spare") - F.ceil(F.col("n") * F.lit(threshold) - 1e-6) + 1
    able = keep(nodes.join(spare, "node").withColumn("room", room).filter("room > 0"), "able")
    order = Window.partitionBy("node").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    first = shared.join(able.hint("merge"), "node").withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0))).filter("before < room")
    first = keep(first.select("node", "n", "component", "spare", "h"), "prefixes")
    discard(counted, common, shared, able)
    return first


def _linked_across(left: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Edges (a, b) between members of different components, found family by family.

    A family is what hangs together through prefix shingles that lie in several components. Its large components are cut into chunks of bounded
    text of their own, its small ones share chunks. Every two chunks that hold different components meet in one task, which looks shared
    shingles up in an index; no pair becomes a row unless it is linked. Beside one large component a family costs in proportion to its size.
    """
    prefixes = _prefixes(left, texts, shingle, threshold)
    ends = prefixes.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("a"), F.count("*").alias("times"))
    ends = keep(ends.filter("low < high").select("h", "a", "times"), "ends")
    met = keep(looked_up(prefixes, ends, "h", "times").select("a", F.col("node").alias("b")).distinct(), "met")
    families = connected_components(met)
    able = prefixes.select("node", "n", "component", "spare").distinct()
    members = keep(able.join(families.select("node", F.col("component").alias("family")), "node"), "family")
    discard(prefixes, ends, met)
    chunks = lambda words: F.ceil(words / F.lit(_CHUNK_WORDS)).cast("int")
    per = keep(members.groupBy("family", "component").agg(F.sum("n").alias("words")), "per")
    pooled = per.filter(F.col("words") <= _CHUNK_WORDS).groupBy("family").agg(chunks(F.sum("words")).alias("pools"))
    alone = F.col("words") > _CHUNK_WORDS
    # of: the component that a chunk is made of, or null for small ones together.
    parts = F.when(alone, chunks(F.col("words"))).otherwise(F.col("pools"))
    per = per.join(pooled, "family", "left").select("family", "component", F.when(alone, F.col("component")).alias("of"), parts.alias("parts"))
    dealt = members.join(per, ["family", "component"])
    at = F.pmod(F.when(F.col("of").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("node")), F.col("parts")).cast("int")
    dealt = keep(dealt.withColumn("chunk", F.struct(F.coalesce("of", F.lit(-1)).alias("of"), at.alias("part"))).drop("of", "parts"), "dealt")
    held = dealt.select("family", "chunk").distinct()
    differ = (F.col("i") <= F.col("j")) & ((F.col("i.of") != F.col("j.of")) | (F.col("i.of") == -1))
    tiles = keep(held.select("family", F.col("chunk").alias("i")).join(held.select("family", F.col("chunk").alias("j")), "family").filter(differ), "tiles")
    sides = tiles.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    rows = dealt.join(sides, ["family", "chunk"]).join(texts.hint("merge"), "node")
    rows = rows.select("family", "i", "j", (F.col("i") == F.col("j")).alias("same"), (F.col("chunk") == F.col("i")).alias("left"), "node", "n", "component", "spare", "text")
    return rows.groupBy("family", "i", "j").applyInArrow(lambda t: _tile(t, shingle, threshold), "a long, b long")


def _tile(t: pa.Table, shingle: int, threshold: float) -> pa.Table:
    node, n, component, spare = (t.column(c).to_numpy() for c in ("node", "n", "component", "spare"))
    same, left = t.column("same")[0].as_py(), np.array(t.column("left").to_pylist(), bool)
    of, h, weight = _bag(Words(t.column("text").combine_chunks(), PLAIN), shingle)
    cut = np.searchsorted(of, np.arange(len(node) + 1))
    order = np.argsort(h, kind="stable")
    token, owner, count = h[order], of[order], weight[order]
    links = []
    for x in range(len(node)) if same else np.flatnonzero(left):
        rest = (component != component[x]) & ((node > node[x]) if same else ~left)
        rest &= np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x])
        rest &= np.minimum(spare, spare[x]) >= threshold / (1 + threshold) * (n + n[x]) - 1e-6
        if not rest.any():
            continue
        own, own_count = h[cut[x] : cut[x + 1]], weight[cut[x] : cut[x + 1]]
        low = np.searchsorted(token, own, "left")
        size = np.searchsorted(token, own, "right") - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.bincount(owner[at], np.minimum(count[at], np.repeat(own_count, size)), len(node))
        linked = np.flatnonzero(rest & (common >= threshold * (n + n[x] - common) - 1e-9))
        links += [(int(node[x]), int(node[y])) for y in linked]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            of, h, weight = _bag(Words(part.column(1), PLAIN), shingle)
            node = np.array(part.column(0).to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[of]), pa.array(h.view(np.int64)), pa.array(weight, pa.int64())], names=["node", "h", "w"])


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (leader, node) whose exact similarity reaches the threshold, as edges (a, b).

    A leader's pairs are split into groups of bounded text, each with a copy of the leader's text; groups are ten
    times the leader's size at least, so the copies add a tenth at most.
    """
    most = F.greatest(F.lit(_GROUP_WORDS), 10 * F.max("leader_n"))
    groups = keep(pairs.groupBy("leader").agg(F.ceil(F.sum("n") / most).cast("int").alias("groups")), "groups")
    member = pairs.join(groups, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("part"), "node")
    leader = groups.select("leader", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("leader").alias("node"))
    rows = member.unionByName(leader).join(texts.hint("merge"), "node")
    return rows.groupBy("leader", "part").applyInArrow(lambda t: _verify(t, shingle, threshold), "a long, b long")


def _bag(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and count of every distinct shingle of every text, in that order."""
    h = words.windows(shingle).copy()
    starts = words.fits(shingle)
    for n in np.unique(words.count[(words.count > 0) & (words.count < shingle)]):
        at = words.first[:-1][words.count == n]
        h[at] = words.windows(int(n))[at]
        starts[at] = True
    of, h = words.text_of()[starts], h[starts]
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], h[at], np.diff(np.append(at, len(h)))


def signatures(of: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """One row of ``registers`` earliest times per text; infinite where a text has no shingle."""
    total = np.bincount(of, weight, texts)
    out = np.full((texts, registers), np.inf)
    todo, reach = total > 0, np.full(texts, 9.0)
    while todo.any():
        limit = np.where(todo, reach / np.maximum(total, 1), -1.0)
        out[todo] = np.inf
        pick = todo[of]
        _points(of[pick], h[pick], weight[pick], limit, out)
        # A register that is still later than the limit could have been reached by a point not drawn yet.
        todo = todo & (out.max(axis=1) > limit)
        reach *= 2
    return out


def _points(of: np.ndarray, h: np.ndarray, weight: np.ndarray, limit: np.ndarray, out: np.ndarray) -> None:
    """Draw the points up to each text's limit, process by process, and keep the earliest time of each register."""
    registers = out.shape[1]
    flat = out.ravel()
    pieces = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    of, h, weight = (np.repeat(x, pieces) for x in (of, h, weight))
    low = np.where(piece > 0, 1 << np.maximum(piece - 1, 0), 0)  # the piece is (low, low + width]
    width = np.maximum(low, 1)
    state = mix(h + piece.astype(np.uint64) * _SALT)
    time = np.zeros(len(state))
    while len(state):
        state = state + _GAMMA
        draw = mix(state)
        time = time - np.log1p(-((draw >> np.uint64(11)) * 2.0**-53)) / (registers * width)
        live = time <= limit[of]
        of, low, width, weight, state, time = (x[live] for x in (of, low, width, weight, state, time))
        if not len(state):
            return
        draw = mix(state ^ _SALT)
        register = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)
        place = low + 1 + ((draw >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64)
        seen = place <= weight
        np.minimum.at(flat, of[seen] * registers + register[seen].astype(np.int64), time[seen])


def _signed(batches: Iterator[pa.RecordBatch], text_at: int, added: list[str], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, batch.schema.names[text_at]):
            words = Words(part.column(text_at), PLAIN)
            of, h, weight = _bag(words, shingle)
            size = np.bincount(of, weight, part.num_rows).astype(np.int64)
            bits = signatures(of, h, weight, part.num_rows, bands * rows).astype(np.float32).view(np.uint32).astype(np.uint64).reshape(part.num_rows, bands, rows)
            key = np.zeros((part.num_rows, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _SALT
            for r in range(rows):
                key = mix((key ^ bits[:, :, r]) * _GAMMA)
            some = size > 0
            ends = np.r_[0, np.cumsum(np.where(some, bands, 0))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[some].ravel().view(np.int64)))
            keys = [pa.array(_sequence(words, seed).view(np.int64)) for seed in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *keys, pa.array(size), lists], names=[*part.schema.names, *added])


def _sequence(words: Words, seed: int) -> np.ndarray:
    """A hash of each text's words in order."""
    place = np.arange(len(words.start)) - np.repeat(words.first[:-1], words.count)
    each = np.append(mix(words.hashes(seed) ^ mix(place.astype(np.uint64) * _GAMMA + _SALT)), np.uint64(0))
    total = np.add.reduceat(each, words.first[:-1]) if len(words.count) else each[:0]
    return mix(np.where(words.count > 0, total, np.uint64(0)) + words.count.astype(np.uint64))


def _verify(t: pa.Table, shingle: int, threshold: float) -> pa.Table:
    node = np.array(t.column("node").to_pylist(), np.int64)
    leader = int(t.column("leader")[0].as_py())
    of, h, weight = _bag(Words(t.column("text").combine_chunks(), PLAIN), shingle)
    cut = np.searchsorted(of, np.arange(len(node) + 1))
    i = int(np.flatnonzero(node == leader)[0])
    own, own_weight = h[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]
    at = np.minimum(np.searchsorted(own, h), len(own) - 1)
    common = np.bincount(of, np.where(own[at] == h, np.minimum(own_weight[at], weight), 0), len(node))
    size = np.bincount(of, weight, len(node))
    linked = (common >= threshold * (size + size[i] - common) - 1e-9) & (node != leader)
    return pa.table({"a": pa.array(np.full(linked.sum(), leader), pa.int64()), "b": pa.array(node[linked], pa.int64())})
