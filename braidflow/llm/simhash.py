"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming budget by a binary trie self-join.

1. Fingerprints are computed row by row and written as a narrow table; equal ones meet in one map-side-combined count.
2. Two fingerprints that differ in at most 3 of 64 bits agree on at least two of five bit blocks. So there are ten
   tries, one for each pair of blocks, whose first 25 or 26 levels are that pair's bits; node pairs with an error up
   there need not be followed. Spark deals fingerprints to the nodes below those levels ("groups").
3. Each group's trie is joined with itself: pairs of nodes are traversed together, level by level, down to single
   fingerprints; differing bits add up, and a pair is dropped as soon as they exceed the budget. Node pairs that lie in
   one known component are dropped too. The links are merged at once, so that a group gives one edge for each
   fingerprint, not one for each pair.
4. A group beyond :data:`MOST_IN_TASK` fingerprints is not held in a task but handed on: the next six levels are
   traversed as a shuffle, each fingerprint going to every pair of child nodes within the budget, until groups fit.
5. Components of the edges come from alternating large and small stars over written tables; nodes with very many
   neighbours are joined apart. A fingerprint is its own node; keys are looked at only when components are known.

A step that hands a group on repeats each member for up to 42 pairs of child nodes, each a part of the group; a group of
a million fingerprints so costs some 40 million narrow rows in its first step, and less in the next, as parts with errors
have less budget left.

Nothing that grows with the corpus reaches the driver; exact copies are one fingerprint.
Defined results: null or wordless text has fingerprint 0 and links like any other; rows with a null key link too; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, written

BUDGET = 3
#: Five bit blocks; any two fingerprints within the budget share two of them.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
SEED = 42
SHINGLE = 3
PAIRS_AT_ONCE = 1 << 18
HOT_SHARE = 1000
MOST_IN_TASK = 100_000
ROWS_AT_ONCE = 1 << 16
#: Levels of the trie that one shuffle traverses.
LEVELS = 6


def fingerprint(text: str) -> int:
    """Majority bits of the XXH64 of the word shingles, as an unsigned integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    h = xxhash.xxh64_intdigest
    values = np.array([h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``carry`` columns and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py() or "") for t in batch.column(len(carry) + 1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry) + 1)), pa.array(fp)], names=[key, *carry, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(key, *carry, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry)) + ", fp bigint")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _split(fps: np.ndarray, bit: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the children of trie nodes part: the first place of each ``[a, b)`` whose fingerprint has the bit set."""
    lo, hi = a.copy(), b.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        set_ = (fps[mid] >> np.uint64(bit)) & np.uint64(1) == 1
        hi[open_[set_]] = mid[set_]
        lo[open_[~set_]] = mid[~set_] + 1
    return lo


def trie_links(fps: np.ndarray, pairs: np.ndarray, known, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within ``budget`` bits of each other, below the given pairs of trie nodes.

    A trie node is an interval of a sorted run whose members share their leading bits; ``pairs`` has a column
    ``a0, a1, b0, b1`` for each pair of roots. A level splits both nodes of every pair by the next bit. Pairs of single
    fingerprints have reached the leaves, and their remaining bits are counted. ``known(a0, a1, b0, b1)`` tells which
    pairs of nodes need no more links.
    """
    rest = np.array([(1 << (k + 1)) - 1 for k in range(64)] + [0], dtype=np.uint64)  # bits 0 to k; none for k = -1
    stack = [(63, np.concatenate([pairs, np.zeros((1, pairs.shape[1]), np.int64)]))]
    while stack:
        bit, f = stack.pop()
        a0, a1, b0, b1, d = f
        same = a0 == b0
        alive = ~(same & (a1 - a0 < 2)) & ~known(a0, a1, b0, b1)
        leaf = alive & ~same & (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = d[leaf] + np.bitwise_count((fps[i] ^ fps[j]) & rest[bit]) <= budget
            if near.any():
                yield i[near], j[near]
        f = f[:, alive & ~leaf]
        if bit < 0 or not f.shape[1]:  # below the last bit only equal fingerprints are left, and there are none
            continue
        a0, a1, b0, b1, d = f
        am, same = _split(fps, bit, a0, a1), a0 == b0
        bm = am.copy()
        bm[~same] = _split(fps, bit, b0[~same], b1[~same])
        parts = [np.stack([a0, am, b0, bm, d]), np.stack([am, a1, bm, b1, d]), np.stack([a0, am, bm, b1, d + 1]), np.stack([am, a1, b0, bm, d + 1])[:, ~same]]
        f = np.concatenate(parts, axis=1)
        f = f[:, (f[1] > f[0]) & (f[3] > f[2]) & (f[4] <= budget)]
        for at in range(0, f.shape[1], PAIRS_AT_ONCE):
            stack.append((bit - 1, f[:, at : at + PAIRS_AT_ONCE]))


def _group_edges(fps: np.ndarray, group: np.ndarray, side: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked member to the least node of its links, over whole groups (sorted by group, side, fp).

    Members of side 0 are joined with each other, those of side 1 with those of side 2.
    """
    n = len(fps)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [n]])
    own = side[lo] == 0
    first = np.flatnonzero((side[lo] == 1)[:-1] & (side[lo] == 2)[1:] & (group[lo][1:] == group[lo][:-1]))
    pairs = np.concatenate([np.stack([lo[own], hi[own]] * 2), np.stack([lo[first], hi[first], lo[first + 1], hi[first + 1]])], axis=1)
    back = np.argsort(node, kind="stable")
    rank = np.empty(n, np.int64)  # so that the least member is the least node
    rank[back] = np.arange(n)
    root, changes = np.arange(n), np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def known(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Pairs of nodes all of whose members lie in one component already."""
        return (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (root[rank[a0]] == root[rank[b0]]) & (a1 - a0 + b1 - b0 > 2)

    def merge() -> None:
        nonlocal root, changes, held, size
        linked = np.flatnonzero(root != np.arange(n))
        root = _roots(n, np.concatenate([linked, *(x for x, _ in held)]), np.concatenate([root[linked], *(y for _, y in held)]))
        placed = root[rank]
        changes = np.concatenate([[0], np.cumsum(placed[1:] != placed[:-1])])
        held, size = [], 0

    for i, j in trie_links(fps, pairs, known):
        held.append((rank[i], rank[j]))
        size += len(i)
        if size > PAIRS_AT_ONCE:
            merge()
    if held:
        merge()
    a = np.flatnonzero(root != np.arange(n))
    return node[back[a]], node[back[root[a]]]


def _joined(keyed: DataFrame, most: int | None) -> DataFrame:
    """``u, v`` edges of groups, and the rows of groups with over ``most`` members, from ``g, k, side, d, fp, node``."""
    schema = "u bigint, v bigint, g bigint, k int, side int, d int, fp bigint, node bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * 2

    def rows(values: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(next(iter(values.values())))
        return pa.RecordBatch.from_arrays([pa.array(values[c], t) if c in values else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size, passing = 0, None  # ``passing``: the group that is handed on

        def edges(part: dict[str, np.ndarray]) -> pa.RecordBatch:
            order = np.lexsort((part["fp"].view(np.uint64), part["side"], part["g"]))
            part = {c: x[order] for c, x in part.items()}
            u, v = _group_edges(part["fp"].view(np.uint64), part["g"], part["side"], part["node"])
            return rows({"u": u, "v": v})

        def whole() -> dict[str, np.ndarray]:
            return {c: np.concatenate([h[c] for h in held]) for c in names[2:]}

        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names[2:]}
            if passing is not None and batch.num_rows:
                on = int(np.searchsorted(new["g"], passing, side="right"))
                if on:
                    yield rows({c: x[:on] for c, x in new.items()})
                new = {c: x[on:] for c, x in new.items()}
                passing = passing if not len(new["g"]) else None
            if not len(new["g"]):
                continue
            held.append(new)
            size += len(new["g"])
            last = new["g"][-1]
            if size >= ROWS_AT_ONCE and held[0]["g"][0] != last:
                part = whole()
                cut = int(np.searchsorted(part["g"], last))  # the last group may go on
                yield edges({c: x[:cut] for c, x in part.items()})
                held = [{c: x[cut:] for c, x in part.items()}]
                size = len(held[0]["g"])
            if most and size > most and held[0]["g"][0] == last:
                yield rows(whole())
                held, size, passing = [], 0, last
        if size:
            yield edges(whole())

    return keyed.select(*names[2:]).repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)


def _deeper(rows: DataFrame, level: int) -> DataFrame:
    """Groups one step down: each member goes to every pair of child nodes within the budget, over the next bits."""
    pick = F.lit(None).cast("int")
    for k, pair in enumerate(combinations(BLOCKS, 2)):
        free = [bit for bit in range(63, -1, -1) if not any(lo <= bit < hi for lo, hi in pair)][level * LEVELS : (level + 1) * LEVELS]
        bits = [F.shiftright("fp", bit).bitwiseAND(F.lit(1)).cast("int") * (1 << n) for n, bit in enumerate(free)]
        pick = F.when(F.col("k") == k, sum(bits, F.lit(0))).otherwise(pick)
    errors = [e for e in range(1 << LEVELS) if e.bit_count() <= BUDGET]
    near = F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(e.bit_count()).alias("n")) for e in errors])).alias("x")
    a = rows.select("*", pick.alias("c")).select("*", near).filter(F.col("d") + F.col("x.n") <= BUDGET).withColumn("o", F.col("c").bitwiseXOR(F.col("x.e")))
    side = F.when(F.col("side") != 0, F.col("side")).when(F.col("o") == F.col("c"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2)
    first, second = F.when(side == 2, F.col("o")).otherwise(F.col("c")), F.when(side == 2, F.col("c")).otherwise(F.col("o"))
    return a.select(F.xxhash64("g", first, second).alias("g"), "k", side.cast("int").alias("side"), (F.col("d") + F.col("x.n")).cast("int").alias("d"), "fp", "node")


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``u, v`` (``v`` the lesser) that connect what lies within the budget, from ``fp, node`` rows."""
    masks = [sum(((1 << hi) - (1 << lo)) for lo, hi in pair) for pair in combinations(BLOCKS, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # groups are told apart by a hash: two that share one are compared together, which costs time but makes no false link
    groups = F.array(*[F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))).alias("g"), F.lit(k).alias("k")) for k, m in enumerate(signed)])
    keyed = distinct.select("fp", "node", F.inline(groups)).withColumns({"side": F.lit(0), "d": F.lit(0)})
    deepest = -(-(64 - min(b - a for a, b in BLOCKS) * 2) // LEVELS)
    found = []
    for level in range(deepest + 1):
        out = written(_joined(keyed, MOST_IN_TASK if level < deepest else None), "trie")
        found.append(out.filter("u is not null").select("u", "v"))
        handed = out.filter("u is null").select("g", "k", "side", "d", "fp", "node")
        if handed.isEmpty():
            break
        keyed = _deeper(handed, level)
    return reduce(DataFrame.unionByName, found).distinct()


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over ``u > v`` edges (``total`` of them): neighbours of a node move to the least of its neighbourhood."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    # Nodes with over a thousandth of all edges would make a long task of the join; there are at most two thousand such.
    hot = F.broadcast(least.filter(F.col("degree") > max(total / HOT_SHARE, 1)).select(F.col("u").alias("w"), "m"))
    cold = least.filter(F.col("degree") <= max(total / HOT_SHARE, 1)).select(F.col("u").alias("w"), "m")
    same = F.col("u") == F.col("w")
    moved = near.join(hot, same).unionByName(near.join(hot, same, "left_anti").join(cold, same))
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v"))
    else:
        out = moved.select("v", "m").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: each linked node with the least node of its component (nodes that are the least themselves are left out)."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges, "links")
    seen = mark(e)
    while seen[0]:  # every round that changes an edge moves it to a lesser node, so this ends
        before, e = e, written(_star(_star(e, True, seen[0]), False, seen[0]), "stars")
        now = mark(e)
        discard(before)
        if now == seen:
            break
        seen = now
    return e


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``carry`` columns, ``fingerprint``, ``component`` (its component's least fingerprint; 16 hexadecimal digits both) and ``component_id`` of every row.

    ``component_id`` is the least key reachable; null where no row of a component has a key. Fingerprints link whether or
    not their rows have keys.
    """
    fps = written(fingerprints(docs, key, text, carry), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("rows"))
    roots = components(links(distinct.select("fp", F.col("fp").alias("node"))))
    placed = written(distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "rows", "least", F.coalesce("v", "fp").alias("root")), "fingerprint-roots")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    mapped = join_counted(placed.drop("least"), written(ids, "components"), "root", placed.count(), "inner")
    mapped = written(mapped.select("fp", F.col("rows").alias("n"), "root", "component_id"), "fingerprint-components")
    found = join_counted(fps, mapped, "fp", fps.count(), "inner")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.select(key, *carry, digits("fp").alias("fingerprint"), digits("root").alias("component"), "component_id")
