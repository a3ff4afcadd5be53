"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct k-word shingles, and carries for each of many
hash functions the shingle that is least under it, its *minwise tokens*.  In each of
several independent trees documents are branched recursively: a node that is too
large is split by the minwise token that the tree has selected for its level, and a
node stops where the pairs left to compare in it are few (``NODE_PAIRS``).  Two sets
of similarity s take the same branch with probability s, so they share a node of
depth d in one of t trees with probability ``1 - (1 - s^d)^t``; t is the least that
reaches the recall asked for at the threshold and the depth at which nodes of
unrelated documents are small.  Several levels are laid out and counted at a time.

Equal sets are one class first, whatever their number.  Inside its nodes each
document is compared with its *home*, the member that meets most others: one
comparison a document, by their minwise tokens and, if these may reach the threshold, by
their full sets, connects nearly all of a group of near copies.  Then the small
nodes that still hold several components are compared exhaustively: all pairs across
components by their minwise tokens, and those that may reach the threshold (4.5
standard deviations below it) by their full sets.  A large node of one component has
nothing left to find and ends; a large node of several is branched further.  So a
node costs a bounded number of comparisons, gives at most a forest of links, and no
row is made for a pair.

Defined cases: null, empty and blank texts have the empty set and are linked with
nothing; a text with fewer than k words is one shingle; rows with equal ids are one
document and take the smallest component of their texts; null ids form no links,
have a null component and are kept; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwright.functions.naming import unused
from leakwright.llm.textcore import FIRST, Words, mix, signed, stream, text_slices
from leakwright.operators.graph import connected_components, contract
from leakwright.sources.shared_tables import discard, release, stash

#: Pairs across components that are compared in a node; a node with more is branched.
NODE_PAIRS = 2016
#: Levels laid out at a time, and the depth at which branching ends and what is left in a node is compared as it is.
LEVELS, MAX_DEPTH = 3, 32
#: Ids of documents that meet others are broadcast up to this number, and joined beyond it.
BROADCAST_IDS = 500_000
#: Documents laid out at once.
DOCS_AT_ONCE = 2000


@dataclass(frozen=True)
class Forest:
    """Which minwise token each tree selects at each level: fresh ones at the first levels, then the tree's own order of all."""

    trees: int
    first: int
    last: int

    @property
    def width(self) -> int:
        return max(128, self.trees * self.last)

    def selected(self, tree: int) -> np.ndarray:
        own = np.arange(self.last) + tree * self.last
        others = np.setdiff1d(np.arange(self.width), own)
        return np.concatenate([own, others[np.argsort(stream(200 + tree, len(others)))]])


def forest_for(n_docs: int, threshold: float, recall: float = 0.99999) -> Forest:
    """The trees for a number of documents: counting starts where nodes can first be small, and trees reach the recall at the last level of the first layout."""
    first = 1 + max(0, math.floor(math.log(max(n_docs, 1) / 64) / math.log(256)))
    last = first + LEVELS - 1
    return Forest(math.ceil(math.log(1 - recall) / math.log(1 - threshold**last)), first, last)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    words = Words(data, offsets, lower=lower)
    starts, text = words.runs(k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    sizes = np.concatenate([np.full(len(starts), k), words.counts[short]]).astype(np.int64)
    starts, text = np.concatenate([starts, words.first[short]]), np.concatenate([text, short])
    values = FIRST.spans(words.hashes(), starts, sizes)
    order = np.argsort(values)
    n = len(offsets) - 1
    order = order[np.argsort(text[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    values, text = values[order], text[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(n + 1))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("tokens", pa.binary()), ("sketch", pa.binary())])


def _signatures(k: int, lower: bool, width: int):
    """Of each text the size of its set, a digest of it, and its minwise tokens, whole and by one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = stream(101, width) | np.uint64(1)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, end, data, offsets in text_slices(batch.column("text")):
                values, cuts = shingle_sets(data, offsets, k, lower)
                sizes = np.diff(cuts)
                full = np.flatnonzero(sizes)
                tokens = np.zeros((end - at, width), dtype=np.uint32)
                for c in range(width if len(full) else 0):
                    least = np.minimum.reduceat(values * factors[c], cuts[:-1][full])
                    tokens[full, c] = (mix(least) >> np.uint64(32)).astype(np.uint32)
                digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                rows = [ids.slice(at, end - at), pa.array(sizes.astype(np.int64)), digests, list(map(bytes, tokens)), list(map(bytes, tokens.astype(np.uint8)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if isinstance(c, list) else c for c, f in zip(rows, _SIGNED)], schema=_SIGNED)

    return run


_STEP = pa.schema([("rep", pa.int64()), ("comp", pa.int64()), ("tree", pa.int32()), ("level", pa.int32()), ("node", pa.int64()), ("parent", pa.int64())])
_STEPS = "rep long, comp long, tree int, level int, node long, parent long"


def _steps(forest: Forest, first: int, last: int):
    """The nodes of levels first..last on the paths of documents, in the trees that each is alive in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(stream(102, forest.trees))
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                tokens = np.frombuffer(b"".join(part.column("tokens").to_pylist()), dtype=np.uint32).reshape(part.num_rows, -1)
                alive = part.column("alive").to_numpy(zero_copy_only=False)
                reps, comps = (part.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp"))
                for tree in range(forest.trees):
                    own = np.flatnonzero(np.array([tree in a for a in alive])) if alive[0] is not None else np.arange(len(reps))
                    if not len(own):
                        continue
                    selected = forest.selected(tree)
                    path = np.full(len(own), salts[tree], dtype=np.uint64)
                    for level in range(1, min(last, len(selected)) + 1):
                        above = path
                        path = mix((path ^ tokens[own, selected[level - 1]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
                        if level >= first:
                            same = [pa.array(np.full(len(own), x, dtype=np.int32)) for x in (tree, level)]
                            yield pa.RecordBatch.from_arrays([pa.array(reps[own]), pa.array(comps[own]), *same, pa.array(signed(path)), pa.array(signed(above))], schema=_STEP)

    return run


def _grow(rows: DataFrame, forest: Forest, first: int, last: int, fresh: bool) -> DataFrame:
    """``(rep, tree, node, n, large)``: the nodes where paths end by level ``last``, small ones or, at that level, large ones.

    ``rows`` has rep, comp, tokens and alive (trees, null for all); with ``fresh`` each
    document is a component of its own.  Nodes of one component are left out.
    """
    steps = rows.mapInArrow(_steps(forest, first, last), _STEPS)
    n = F.col("n")
    if fresh:
        nodes = steps.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("level").alias("level")).withColumn("pairs", n * (n - 1) / 2)
    else:
        cells = steps.groupBy("node", "comp").agg(F.count("*").alias("c"), F.min("parent").alias("parent"), F.min("level").alias("level"))
        nodes = cells.groupBy("node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("alike"), F.min("parent").alias("parent"), F.min("level").alias("level")).withColumn("pairs", (n * n - F.col("alike")) / 2)
    nodes = stash(nodes.where("pairs > 0").select("node", "parent", "level", "n", "pairs"), "nodes")
    above = nodes.select(F.col("node").alias("parent"), (F.col("pairs") > NODE_PAIRS).alias("open"))
    large = F.col("pairs") > NODE_PAIRS
    ended = nodes.join(above, "parent", "left").where((~large & F.coalesce("open", F.lit(True))) | (large & (F.col("level") == last)))
    ended = stash(ended.select("node", "n", large.alias("large")), "ended")
    members = stash(steps.select("rep", "tree", "node").join(ended, "node").select("rep", "tree", "node", "n", "large"), "members")
    discard(nodes)
    discard(ended)
    return members


_SET = pa.schema([("id", pa.int64()), ("items", pa.list_(pa.int64()))])


def _sets(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch.column("text")):
                values, cuts = shingle_sets(data, offsets, k, lower)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(signed(values)))], schema=_SET)

    return run


_PAIR = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _similar(both: np.ndarray, a: np.ndarray, b: np.ndarray, ratio: tuple[int, int]) -> np.ndarray:
    return ratio[1] * both >= ratio[0] * (a + b - both)


def _confirm(ratio: tuple[int, int]):
    """Links among rows of two sets each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                if ratio[1] * min(len(a), len(b)) >= ratio[0] * max(len(a), len(b)):
                    good[i] = _similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), ratio)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], schema=_PAIR)

    return run


def _maybe(least: float):
    """Of rows of two sketches the pairs that share at least ``least`` of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("left", "right"))
                good = pa.array((one == two).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in "ab"], names=["a", "b"])

    return run


class _Sets:
    """Full sets of documents, made anew from their texts for the ids asked for."""

    def __init__(self, docs: DataFrame, k: int, lower: bool, unique: bool):
        self.docs, self.k, self.lower, self.unique = docs, k, lower, unique

    def of(self, ids: DataFrame) -> DataFrame:
        """``(id, items)`` for the ids of one column, as a written table; rows of one id and set are one."""
        asked = stash(ids.toDF("doc_id").distinct(), "asked")
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
        sets = self.docs.join(asked, "doc_id", "left_semi").mapInArrow(_sets(self.k, self.lower), "id long, items array<long>")
        return stash(sets if self.unique else sets.distinct(), "sets")


def _links(sets: _Sets, pairs: DataFrame, marked: DataFrame, ratio: tuple[int, int], width: int) -> DataFrame:
    """Of pairs ``(a, b)`` those whose full sets are similar enough, as a written table; sketches tell first which may be."""
    sketch = lambda side, name: marked.select(F.col("rep").alias(side), F.col("sketch").alias(name))
    drawn = pairs.join(sketch("a", "left"), "a").join(sketch("b", "right"), "b").select("a", "b", "left", "right")
    likely = stash(drawn.mapInArrow(_maybe(least_share(ratio, width)), "a long, b long").distinct(), "pairs")
    whole = sets.of(likely.select("a").union(likely.select("b")))
    left = likely.join(whole.select(F.col("id").alias("a"), F.col("items").alias("left")), "a")
    met = left.join(whole.select(F.col("id").alias("b"), F.col("items").alias("right")), "b").select("a", "b", "left", "right")
    links = stash(met.mapInArrow(_confirm(ratio), "src long, dst long").distinct(), "links")
    discard(likely)
    discard(whole)
    return links


def least_share(ratio: tuple[int, int], width: int) -> float:
    """The share of equal tokens that sets at the threshold reach but for one pair in 300,000: 4.5 standard deviations below it."""
    share = ratio[0] / ratio[1]
    return share - 4.5 * math.sqrt(share * (1 - share) / width)


def near_pairs(sketches: np.ndarray, comps: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Members of a node, by place, that are of two components and share at least ``least`` of their tokens."""
    _, code, sizes = np.unique(comps, return_inverse=True, return_counts=True)
    outside = np.flatnonzero(code != sizes.argmax())  # a pair across components has a member outside the largest
    one, two = [], []
    at_once = max(1, (8 << 20) // sketches.size)
    for at in range(0, len(outside), at_once):
        rows = outside[at : at + at_once]
        alike = (sketches[rows, None, :] == sketches[None, :, :]).sum(2) >= least * sketches.shape[1]
        i, j = np.nonzero(alike & (code[rows, None] != code[None, :]))
        one.append(rows[i])
        two.append(j)
    return np.concatenate(one), np.concatenate(two)


_CLUMP = pa.schema([("clump", pa.binary()), ("rep", pa.int64()), ("comp", pa.int64())])


def _clumps(least: float):
    """What hangs together in a node by pairs that may be similar; alike in all trees, so that each is compared once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                own = members.values
                reps, comps = (own.field(c).to_numpy() for c in ("rep", "comp"))
                sketches = np.frombuffer(b"".join(own.field("sketch").to_pylist()), dtype=np.uint8).reshape(len(reps), -1)
                one, two = near_pairs(sketches, comps, least)
                if not len(one):
                    continue
                met = np.unique(np.concatenate([one, two]))
                root = dict(zip(*(x.tolist() for x in contract(one, two))))
                groups: dict[int, list[int]] = {}
                for place in met.tolist():
                    groups.setdefault(root.get(place, place), []).append(place)
                for places in groups.values():
                    ids = np.sort(reps[places])
                    name = hashlib.blake2b(ids.tobytes(), digest_size=16).digest()
                    order = np.argsort(reps[places])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.binary()), pa.array(ids), pa.array(comps[places][order])], schema=_CLUMP)

    return run


def set_links(ids: list[int], comps: list[int], sets: list[np.ndarray], ratio: tuple[int, int]) -> list[tuple[int, int]]:
    """A forest of the similar pairs across components: all intersections by a product of incidence matrices, in slices of items."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    codes, code = np.unique(np.array(comps), return_inverse=True)
    values, item = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    outside = np.flatnonzero(code != np.bincount(code).argmax())
    place = np.full(len(sets), -1)
    place[outside] = np.arange(len(outside))
    both = np.zeros((len(outside), len(sets)), dtype=np.float64)
    width = max(256, min(4096, (16 << 20) // (4 * len(sets))))
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    cuts = np.searchsorted(item, np.arange(0, len(values) + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        whole = np.zeros((len(sets), width), dtype=np.float32)
        whole[owner[a:b], item[a:b] - k * width] = 1
        both += whole[outside] @ whole.T
    good = _similar(np.rint(both).astype(np.int64), sizes[outside, None], sizes[None, :], ratio) & (code[outside, None] != code[None, :])
    label = list(range(len(codes)))
    found = []
    for i, j in np.argwhere(good).tolist():
        a, b = int(code[outside[i]]), int(code[j])
        while label[a] != a:
            a = label[a]
        while label[b] != b:
            b = label[b]
        if a != b:
            label[max(a, b)] = min(a, b)
            found.append((ids[outside[i]], ids[j]))
    return found


def _confirm_clumps(ratio: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                own = members.values
                items = own.field("items")
                found = set_links(own.field("rep").to_pylist(), own.field("comp").to_pylist(), [items[i].values.to_numpy() for i in range(len(own))], ratio)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=_PAIR)

    return run


def _node_links(members: DataFrame, comps: DataFrame, marked: DataFrame, sets: _Sets, ratio: tuple[int, int], width: int) -> DataFrame:
    """Links across components among the members ``(rep, node)`` of small nodes, as a written table."""
    placed = _placed(members, comps)
    mixed = stash(placed.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("node"), "mixed")
    drawn = placed.join(mixed, "node").join(marked.select("rep", "sketch"), "rep").groupBy("node").agg(F.collect_list(F.struct("rep", "comp", "sketch")).alias("members"))
    clumps = stash(drawn.select("members").mapInArrow(_clumps(least_share(ratio, width)), "clump binary, rep long, comp long").distinct(), "clumps")
    full = sets.of(clumps.select("rep"))
    whole = clumps.join(full, clumps["rep"] == full["id"]).groupBy("clump").agg(F.collect_list(F.struct("rep", "comp", "items")).alias("members"))
    links = stash(whole.select("members").mapInArrow(_confirm_clumps(ratio), "src long, dst long").distinct(), "links")
    discard(mixed)
    discard(clumps)
    discard(full)
    return links


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    named = comps.select(F.col("node").alias("rep"), "component")
    return members.join(named, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _homes(members: DataFrame) -> DataFrame:
    """``(rep, home)``: the pivot of a node is its document that meets most others in all trees; a document's home, its most frequent pivot."""
    degree = stash(members.groupBy("rep").agg(F.sum("n").alias("degree")), "degree")
    central = F.struct("degree", (-F.col("rep")).alias("rep"))
    pivots = stash(members.select("rep", "node").join(degree, "rep").groupBy("node").agg((-F.max(central)["rep"]).alias("pivot")), "pivots")
    meets = members.select("rep", "node").join(pivots, "node").where("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("times"))
    homes = meets.groupBy("rep").agg(F.max(F.struct("times", (-F.col("pivot")).alias("pivot"))).alias("best")).select("rep", (-F.col("best.pivot")).alias("home"))
    homes = stash(homes, "homes")
    discard(degree)
    discard(pivots)
    return homes


def _joined(comps: DataFrame, new: DataFrame) -> DataFrame:
    """Components after new links; where there are none they are as before."""
    if new.isEmpty():
        return comps
    known = comps.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    return stash(connected_components(known.unionByName(new)), "components")


def near_duplicates(docs: DataFrame, k: int = 5, ratio: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", lower: bool = True, recall: float = 0.99999) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept (is the smallest id of its component).

    ``ratio`` is the least similarity as numerator and denominator, compared in
    integers; ``recall`` is that of a pair just at it.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    forest = forest_for(docs.count(), ratio[0] / ratio[1], recall)
    signed_docs = stash(docs.mapInArrow(_signatures(k, lower, forest.width), "doc_id long, n_shingles long, digest binary, tokens binary, sketch binary"), "signatures")

    full = signed_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stash(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = full.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    marked = stash(firsts.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp"), "tokens", "sketch", F.lit(None).cast("array<int>").alias("alive")), "marked")
    members = _grow(marked.drop("sketch"), forest, forest.first, forest.last, fresh=True)
    release(docs.sparkSession)
    sets = _Sets(docs, k, lower, full.groupBy("doc_id").count().where("count > 1").isEmpty())

    homes = _homes(members)
    links = _links(sets, homes.select(F.col("rep").alias("a"), F.col("home").alias("b")), marked, ratio, forest.width)
    comps = stash(connected_components(links), "components")
    release(docs.sparkSession)
    comps = _joined(comps, _node_links(members.where("NOT large").select("rep", "node"), comps, marked, sets, ratio, forest.width))

    # Large nodes of several components are branched further, until none is left.
    large, depth = members.where("large"), forest.last
    while not (live := stash(_mixed_paths(large, comps), "live")).isEmpty():
        alive = live.groupBy("rep", "comp").agg(F.collect_set("tree").alias("alive"))
        first, depth = depth + 1, min(depth + 4 * LEVELS, MAX_DEPTH)
        deeper = _grow(marked.select("rep", "tokens").join(alive, "rep").select("rep", "comp", "tokens", "alive"), forest, first, depth, fresh=False)
        ends = deeper if depth == MAX_DEPTH else deeper.where("NOT large")
        comps = _joined(comps, _node_links(ends.select("rep", "node"), comps, marked, sets, ratio, forest.width))
        large = deeper.where("large")
        if depth == MAX_DEPTH:
            break

    twice = full.select("doc_id", "n_shingles", "digest").join(classes, "digest").select("doc_id", "n_shingles", "rep")
    named = stash(signed_docs.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("rep")).unionByName(twice), "named")
    several = named.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("top")).where("src < top").select("doc_id", "src")
    comps = _joined(comps, named.join(several, "doc_id").select("src", F.col("rep").alias("dst")))
    for table in (signed_docs, classes, marked, members, homes, links):
        discard(table)
    out = named.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _mixed_paths(large: DataFrame, comps: DataFrame) -> DataFrame:
    """``(rep, comp, tree)`` of members of large nodes that still hold several components."""
    placed = _placed(large.select("rep", "tree", "node"), comps)
    mixed = stash(placed.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("node"), "mixed")
    return placed.join(mixed, "node").select("rep", "comp", "tree")


def drop_near_duplicates(docs: DataFrame, k: int = 5, ratio: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that of the smallest id, null ids last.

    Every row is judged by itself, whatever its id: of repeated rows one stays, null ids
    are deduplicated too, and a different text under the same id is not a copy.  Null,
    empty and blank texts all stay.  The rows that go are broadcast if they are no more
    than ``broadcast_ids``, and joined otherwise.  An empty table stays empty; columns of
    any name keep their values.
    """
    row = unused(docs.columns, "row_number")[0]
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    near = stash(near_duplicates(numbered, k, ratio, "row", "text").select(F.col("doc_id").alias("row"), "component_id"), "near")
    together = near.join(near.where("component_id <> row").select("component_id").distinct(), "component_id", "left_semi")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    ranked = together.join(numbered.select("row", "id"), "row")
    stays = stash(ranked.groupBy("component_id").agg(F.min(order)["row"].alias("stays")), "stays")
    gone = stash(together.join(stays, "component_id").where("row <> stays").select(F.col("row").alias(row)), "dropped")
    return rows.join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, row, "left_anti").drop(row)
