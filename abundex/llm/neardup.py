"""MinHash near-dedup by a chosen-path set similarity join.

One scan gives every document its shingle count, a 128-bit hash of its whole shingle set and a signature of `WIDTH`
minwise tokens. Documents with equal sets collapse into a class; the join runs over one representative of each.

Each of several independent trees sends a representative down one or two minwise tokens chosen by the node (1 / 0.8 in
the mean), so documents that share the chosen tokens meet in a node. Nodes of at most BLOCK members are compared
exhaustively on signatures; pairs that pass the estimate, set five deviations below the threshold, are confirmed on
the full sets. The best edges come first: a spanning forest of each small node, and of random blocks of BLOCK members
of some large ones. By the components that these make, a large node whose members form one component is done. In any
other of at most LIMIT members, those outside its largest component are compared with all others. Where the pairs that
pass the estimate are many for the members (a dense group of copies near the threshold), they aren't emitted: tiles of
the members' full sets meet, a matrix product counts all intersections exactly, and only links that unite two components
leave the task. Nodes beyond LIMIT branch again, but for dense ones of at most DENSE_LIMIT members (a tenth of the pairs
of a sample pass), which branching would hardly thin out: their tiles meet, spread over tasks. So a member takes part in
at most DENSE_LIMIT comparisons a tree, a branching makes 1.25 rows of one in the mean, and nothing is capped: every
pair that meets in a node and passes the estimate is confirmed or already connected.

The number of trees follows from the target recall and the depth: the chance that a pair stays together in a tree falls
with every branching, so members of nodes that branched deeper than the trees so far allow for go down further trees
(with fewer members around them), until their number meets the target at the depth that was reached. A dense
group of more than DENSE_LIMIT texts makes about as many rows at each of some log(size / DENSE_LIMIT) / 0.2 levels.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; a text with fewer words than a
shingle is one shingle; rows with the same doc_id are one document, linked; a null doc_id stands alone and is kept;
extra columns pass through dedup_documents(), and columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.llm.common import forget, keep, small_batches
from abundex.llm.components import components

WIDTH = 512
QUICK = 64
#: Members that are compared at once, whatever their components.
BLOCK = 64
#: Members of the largest node that is compared instead of branching again, and of the largest dense one.
LIMIT, DENSE_LIMIT = 4096, 16384
#: Pairs a member that pass the estimate in a node; nodes with more are compared in tiles of full sets.
DENSE = 8
#: Branchings that the trees of the scan allow for; members that go deeper get further trees.
LEVELS = 1
#: Ids that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 2_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240229)
_A, _B = (_rng.integers(1, 1 << 32, WIDTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)), _rng.integers(0, 1 << 32, WIDTH, dtype=np.uint64).astype(np.uint32)
_K = [np.uint64(x | 1) for x in _rng.integers(0, 1 << 63, 16, dtype=np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(size, len(w))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * _K[i]
    s = _mix(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def signature(s: np.ndarray) -> np.ndarray:
    """Minwise tokens (32 bits) under WIDTH hash functions."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), 1024):
        x = low[lo : lo + 1024, None] * _A
        x += _B
        x ^= x >> np.uint32(15)
        np.minimum(best, x.min(0), out=best)
    return best


def chosen(node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node: the first coordinate, a second one, and whether the second is taken (a quarter of the time)."""
    h = _mix(node * np.uint64(0xD6E8FEB86659FD93))
    return (h % np.uint64(WIDTH)).astype(np.int64), ((h >> np.uint64(20)) % np.uint64(WIDTH)).astype(np.int64), (h >> np.uint64(50)) % np.uint64(4) == 0


def child(node: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _mix(_mix(node + np.uint64(0x632BE59BD9B4E019)) + coordinate.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + value.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def first_level(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Roots of trees first to last - 1 (twice where a second token is taken), and their coordinates: no coordinate
    comes twice until all have come."""
    trees = np.arange(first, last)
    root = _mix((trees + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    second = trees % 4 == 0
    return np.concatenate((root, root[second])), np.concatenate((2 * trees, 2 * trees[second] + 1)) % WIDTH


def trees_for(recall: float, threshold: float, levels: int = LEVELS) -> int:
    """Trees after which a pair at the threshold has met below `levels` branchings with the target recall."""
    one = 0.75 * threshold + 0.25 * (1 - (1 - threshold) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - one**levels))


def trees_at(recall: float, threshold: float, levels: int) -> int:
    """The same by the exact recursion for the chance that any common node is left, which deep nodes need."""
    one = 1.0
    for _ in range(levels):
        one = 0.75 * threshold * one + 0.25 * (1 - (1 - threshold * one) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - one))


def _scan(docs: DataFrame, size: int, trees: int) -> DataFrame:
    """doc_id, n, key (hash of the set; null without shingles), sig, nodes (first-level nodes of all trees)."""
    root, coordinate = first_level(0, trees)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, key, sig, nodes = [], [], [], []
            for t in b["text"].to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                if not len(s):
                    key.append(None)
                    sig.append(None)
                    nodes.append(None)
                    continue
                x = signature(s)
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append((x & np.uint32(0xFF)).astype(np.uint8).tobytes())
                nodes.append(child(root, coordinate, x[coordinate]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "sig", "nodes"])

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n long, key binary, sig binary, nodes array<long>")


def _estimate(sig: np.ndarray, n: int, other: np.ndarray, m: np.ndarray, threshold: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that one signature of a set of n may be linked with, and the estimates (least or more).

    Signatures hold the low byte of each token, so one token in 256 agrees by chance. Pairs whose first QUICK tokens
    agree far too seldom (eight deviations) aren't looked at further."""
    few = QUICK * (least - 8 * (least * (1 - least) / QUICK) ** 0.5)
    j = np.flatnonzero(np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
    j = j[np.count_nonzero(other[j, :QUICK] == sig[:QUICK], axis=1) >= few]
    est = (np.count_nonzero(other[j] == sig, axis=1) / WIDTH - 1 / 256) / (1 - 1 / 256)
    return j[est >= least], est[est >= least]


def _forest(sig: np.ndarray, n: np.ndarray, ids: np.ndarray, labels: np.ndarray, threshold: float, least: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximum spanning forest over the labels of the block, and the other pairs between labels."""
    found = [_estimate(sig[x], n[x], sig[x + 1 :], n[x + 1 :], threshold, least) for x in range(len(sig) - 1)]
    i = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    j, est = np.concatenate([f[0] for f in found]) + i + 1, np.concatenate([f[1] for f in found])
    order = np.argsort(-est, kind="stable")
    parent: dict[int, int] = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    first, rest = [], []
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if labels[a] == labels[b] or ids[a] == ids[b]:
            continue
        x, y = find(labels[a]), find(labels[b])
        pair = (max(ids[a], ids[b]), min(ids[a], ids[b]))
        if x != y:
            parent[x] = y
            first.append(pair)
        else:
            rest.append(pair)
    return first, rest


def _unpack(members: list[dict]):
    ids, n, labels = (np.array([m[k] for m in members], np.int64) for k in ("id", "n", "label"))
    return ids, n, labels, np.frombuffer(b"".join(m["sig"] for m in members), np.uint8).reshape(-1, WIDTH)


def _compare_blocks(live: DataFrame, threshold: float, least: float) -> DataFrame:
    """(u, v, later): pairs found in nodes, or in random blocks of large nodes (then only the forest's)."""
    parts = F.ceil(F.col("cnt") / F.lit(BLOCK))
    live = live.where((F.col("cnt") <= BLOCK) | (F.pmod("node", F.lit(3)) == 0))  # each member is in several trees' large nodes
    blocks = live.withColumn("block", F.pmod(F.xxhash64("id", "node"), parts)).groupBy("node", "block").agg(F.first("cnt").alias("cnt"), F.collect_list(F.struct("id", "n", "label", "sig")).alias("members"))

    def run(batches):
        for b in batches:
            out: list[tuple[int, int, bool]] = []
            for cnt, members in zip(b["cnt"].to_pylist(), b["members"].to_pylist()):
                if len(members) < 2:
                    continue
                ids, n, labels, sig = _unpack(members)
                first, rest = _forest(sig, n, ids, labels, threshold, least)
                out += [(*p, False) for p in first]
                if cnt <= BLOCK:
                    out += [(*p, True) for p in rest]
            yield _pairs(out)

    return blocks.select("cnt", "members").mapInArrow(run, "u long, v long, later boolean").groupBy("u", "v").agg(F.min("later").alias("later"))


def _pairs(out: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    u, v, later = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(later, pa.bool_())], names=["u", "v", "later"])


PAIR, IS_DENSE, BRANCHES = 0, 1, 2


def _compare_nodes(mixed: DataFrame, threshold: float, least: float) -> DataFrame:
    """(kind, node, u, v): pairs that pass the estimate between the members outside a node's largest component and all
    others, or one row without a pair for a dense node, or for one that is to branch."""
    nodes = mixed.groupBy("node").agg(F.collect_list(F.struct("id", "n", "label", "sig", (F.col("label") != F.col("top")).alias("out"))).alias("members"))
    limit, most = LIMIT, DENSE

    def compared(members: list[dict]) -> tuple[int, list[tuple[int, int]]]:
        ids, n, labels, sig = _unpack(members)
        out = np.array([m["out"] for m in members], bool)
        found, total, at = [], 0, np.flatnonzero(out)
        if len(ids) > limit:
            at = np.random.default_rng(len(ids)).permutation(at)[:64]
        for i in at:
            j, _ = _estimate(sig[i], n[i], sig, n, threshold, least)
            j = j[(labels[j] != labels[i]) & (ids[j] != ids[i])]
            total += len(j)
            if len(ids) <= limit:
                if total > most * len(ids):
                    return IS_DENSE, []
                found.append((ids[i], ids[j[~out[j] | (j > i)]]))
        if len(ids) > limit:
            return (IS_DENSE if total >= 0.1 * len(at) * len(ids) else BRANCHES), []
        return PAIR, [(max(u, v), min(u, v)) for u, w in found for v in w]

    def run(batches):
        for b in batches:
            out = []
            for node, members in zip(b["node"].to_pylist(), b["members"].to_pylist()):
                kind, found = compared(members)
                out += [(PAIR, node, *p) for p in found] if kind == PAIR else [(kind, node, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], names=["kind", "node", "u", "v"])

    return nodes.mapInArrow(run, "kind long, node long, u long, v long")


#: Shingles, and members, of a tile of a dense node.
TILE_SHINGLES, TILE_MEMBERS = 400_000, 2048


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all sets of b."""
    x, y = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return out
    sides = []
    for sets, h in ((a, x), (b, y)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        code = np.minimum(np.searchsorted(common, h), len(common) - 1)
        hit = np.flatnonzero(common[code] == h)
        hit = hit[np.argsort(code[hit], kind="stable")]
        sides.append((len(sets), owner[hit], code[hit]))
    for lo in range(0, len(common), width):
        dense = []
        for size, owner, code in sides:
            m = np.zeros((size, min(width, len(common) - lo)), np.float32)
            own = slice(*np.searchsorted(code, (lo, lo + width)))
            m[owner[own], code[own] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _uniting(a: list[dict], b: list[dict], per_cent: int) -> list[tuple[int, int]]:
    """Links (u, v) between two tiles, as many as unite their components."""
    sets = [[np.frombuffer(m["s"], np.uint64) for m in tile] for tile in (a, b)]
    (ids, n, labels), (ids2, n2, labels2) = ([np.array([m[k] for m in tile], np.int64) for k in ("id", "n", "label")] for tile in (a, b))
    same, at = intersections(*sets), []
    for lo in range(0, len(ids), 256):
        s = same[lo : lo + 256].astype(np.int64)
        link = (s > 0) & (100 * s >= per_cent * (n[lo : lo + 256, None] + n2 - s)) & (labels[lo : lo + 256, None] != labels2)
        at.append(np.stack(np.nonzero(link)) + [[lo], [0]])
    i, j = np.concatenate(at, 1)
    x, y = np.minimum(labels[i], labels2[j]), np.maximum(labels[i], labels2[j])
    _, first = np.unique(np.stack((x, y), 1), axis=0, return_index=True)
    parent: dict[int, int] = {}

    def find(z):
        while parent.get(z, z) != z:
            z = parent[z]
        return z

    out = []
    for k in first.tolist():
        p, q = find(int(x[k])), find(int(y[k]))
        if p != q:
            parent[p] = q
            u, v = int(ids[i[k]]), int(ids2[j[k]])
            out.append((max(u, v), min(u, v)))
    return out


def _dense_links(dense: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (u, v) between the members outside a node's largest component and all of its members, exactly.

    Each pair of a tile of outsiders and a tile of members is a row of its own, so a large node is spread over tasks."""
    per_cent = round(threshold * 100)
    sets = shingle_sets(dense.select(F.col("id").alias("doc_id")).distinct(), docs, size)
    out = F.col("label") != F.col("top")

    def tiles(n, members):
        return F.ceil(F.greatest(n / TILE_SHINGLES, members / TILE_MEMBERS, F.lit(1))).cast("int")

    parts = dense.groupBy("node").agg(tiles(F.sum("n"), F.count("*")).alias("a"), tiles(F.sum(F.when(out, F.col("n")).otherwise(0)), F.sum(out.cast("int"))).alias("b"))
    rows = keep(dense.select("node", "id", "n", "label", "top").join(parts, "node").join(sets, "id"), "dense")
    forget(sets)
    tile = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id", "node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = ["node", F.struct("id", "n", "label", "s").alias("m")]
    members = rows.select(*own, tile(1, F.col("a")).alias("i"), every(F.col("b")).alias("j"), F.lit(False).alias("out"))
    outside = rows.where(out).select(*own, every(F.col("a")).alias("i"), tile(2, F.col("b")).alias("j"), F.lit(True).alias("out"))
    both = members.unionByName(outside).groupBy("node", "i", "j").agg(F.collect_list(F.when(F.col("out"), F.col("m"))).alias("x"), F.collect_list(F.when(~F.col("out"), F.col("m"))).alias("y"))

    def run(batches):
        for b in batches:
            found = []
            for i in range(b.num_rows):
                x, y = b["x"][i].as_py(), b["y"][i].as_py()
                if x and y:
                    found += _uniting(x, y, per_cent)
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    links = keep(both.select("x", "y").mapInArrow(run, "u long, v long").distinct(), "dense-links")
    forget(rows)
    return links


def _branch(rows: DataFrame) -> DataFrame:
    """The members of nodes that stay large, in their children."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node = b["node"].to_numpy(zero_copy_only=False).view(np.uint64)
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint8).reshape(-1, WIDTH)
            a, other, second = chosen(node)
            row = np.arange(len(node))
            at = np.concatenate((row, row[second]))
            c = np.concatenate((a, other[second]))
            new = child(node[at], c, sig[at, c])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), *(b[x].take(take) for x in ("id", "n", "label", "sig"))], names=["node", "id", "n", "label", "sig"])

    return rows.select("node", "id", "n", "label", "sig").mapInArrow(run, "node long, id long, n long, label long, sig binary")


def _live(rows: DataFrame) -> DataFrame:
    """Members of nodes with two or more, and the node's size."""
    counts = keep(rows.groupBy("node").agg(F.count("*").alias("cnt")).where("cnt > 1"), "nodes")
    return rows.join(counts, "node")


def shingle_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, s): the packed shingle sets of the documents in ids(doc_id)."""
    ids = keep(ids, "ids")
    if ids.count() <= MAX_BROADCAST:
        ids = F.broadcast(ids)

    def sets(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([shingles(t, size).tobytes() for t in b["text"].to_pylist()], pa.binary())], names=["id", "s"])

    return keep(small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).join(ids, "doc_id", "left_semi").mapInArrow(sets, "id long, s binary"), "sets")


def linked(x: bytes, y: bytes, per_cent: int) -> bool:
    """Whether two packed sets have 100 * intersection >= per_cent * union; empty sets are linked with nothing."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate((x, y))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same > 0 and 100 * same >= per_cent * (len(both) - same)


def confirm(pairs: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (u, v) whose full shingle sets have intersection >= threshold * union."""
    per_cent = round(threshold * 100)
    pairs = keep(pairs.select("u", "v").distinct(), "pairs")
    full = shingle_sets(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), docs, size)

    def check(batches):
        for b in batches:
            mask = pa.array([linked(x, y, per_cent) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["u"].filter(mask), b["v"].filter(mask)], names=["u", "v"])

    left = pairs.join(full.select(F.col("id").alias("u"), F.col("s").alias("x")), "u")
    out = keep(left.join(full.select(F.col("id").alias("v"), F.col("s").alias("y")), "v").select("u", "v", "x", "y").mapInArrow(check, "u long, v long"), "links")
    forget(full, pairs)
    return out


def _labelled(rows: DataFrame, labels: DataFrame | None, column: str = "id", name: str = "label") -> DataFrame:
    if labels is None:
        return rows.withColumn(name, F.col(column))
    own = labels.select(F.col("id").alias("_l"), F.col("label").alias("_m"))
    return rows.join(own, F.col(column) == F.col("_l"), "left").withColumn(name, F.coalesce("_m", column)).drop("_l", "_m")


def _further(reps: DataFrame, first: int, last: int) -> DataFrame:
    """(node, id, n, sig) of the representatives in the first-level nodes of trees first to last - 1."""
    root, coordinate = first_level(first, last)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint8).reshape(-1, WIDTH)
            at = np.repeat(np.arange(b.num_rows), len(root))
            c = np.tile(coordinate, b.num_rows)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(child(np.tile(root, b.num_rows), c, sig[at, c]).view(np.int64)), *(b[x].take(take) for x in ("id", "n", "sig"))], names=["node", "id", "n", "sig"])

    return small_batches(reps.select("id", "n", "sig")).mapInArrow(run, "node long, id long, n long, sig binary")


def _descend(large: DataFrame, rows: int, docs: DataFrame, size: int, threshold: float, least: float) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Links of dense nodes, pairs to be confirmed and (id, depth) of branching members, of large nodes of level 1."""
    edges, pending, depths, level = [], [], [], 1
    while rows:  # similar pairs that stay unlinked get fewer with each level, as 1.25 * 0.8 is no more than 1
        per = large.groupBy("node", "label").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"))
        tops = keep(per.where(F.col("all") > F.col("top.c")).select("node", F.col("top.label").alias("top")), "tops", rows)
        mixed = keep(large.join(tops, "node"), "mixed", rows)
        forget(large, tops)
        compared = keep(_compare_nodes(mixed.where(F.col("cnt") <= DENSE_LIMIT), threshold, least), "compared", rows)
        pending.append(compared.where(F.col("kind") == PAIR).select("u", "v"))
        dense, thin = (compared.where(F.col("kind") == k).select("node") for k in (IS_DENSE, BRANCHES))
        if not dense.isEmpty():
            edges.append(_dense_links(mixed.join(dense, "node"), docs, size, threshold))
        branching = mixed.where(F.col("cnt") > DENSE_LIMIT).unionByName(mixed.where(F.col("cnt") > LIMIT).join(thin, "node"))
        live = keep(_live(_branch(branching)), "live", 2 * rows)
        level += 1
        if level > LEVELS:
            depths.append(keep(branching.select("id").distinct().withColumn("depth", F.lit(level)), "depths", rows))
        forget(mixed)
        pending.append(keep(_compare_blocks(live.where(F.col("cnt") <= BLOCK), threshold, least), "found", rows).select("u", "v"))
        large = keep(live.where(F.col("cnt") > BLOCK), "large", rows)
        forget(live)
        rows = large.count()
    return edges, pending, depths


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def links(reps: DataFrame, docs: DataFrame, size: int, threshold: float, recall: float, same: DataFrame) -> DataFrame | None:
    """Component labels (id, label) of the representatives (id, n, sig, nodes) and of the ids in the edges `same`; None
    without any link."""
    least = threshold - 5 * (threshold * (1 - threshold) / WIDTH) ** 0.5
    first = reps.select("id", F.explode("nodes").alias("node"))
    live = keep(_live(first).join(reps.select("id", "n", "sig"), "id"), "live")
    found = keep(_compare_blocks(_labelled(live, None), threshold, least), "found")
    edges = confirm(found.where(~F.col("later")), docs, size, threshold).unionByName(same)
    labels = None if edges.isEmpty() else keep(components(edges), "labels")
    rows = live.where(F.col("cnt") > BLOCK).count()
    large = keep(_labelled(live.where(F.col("cnt") > BLOCK), labels), "large", rows)
    forget(live)
    outside, pending, depths = _descend(large, rows, docs, size, threshold, least)
    pending.append(found.where("later").select("u", "v"))
    step = done = trees_for(recall, threshold, LEVELS)
    while True:
        rest = _labelled(_labelled(_union(pending).distinct(), labels, "u", "lu"), labels, "v", "lv").where("lu <> lv").select("u", "v")
        edges = _union([edges, *outside, confirm(rest, docs, size, threshold)])
        labels = None if edges.isEmpty() else keep(components(edges), "labels")
        most = _union(depths).agg(F.max("depth")).first()[0] if depths else 0
        if not most or (need := trees_at(recall, threshold, most)) <= done:
            return labels
        level = next(d for d in range(1, most + 1) if trees_at(recall, threshold, d) > done)
        deep = keep(_union(depths).where(F.col("depth") >= level).groupBy("id").agg(F.max("depth").alias("depth")), "deep")
        last = min(done + step, need)
        live = keep(_live(_labelled(_further(reps.join(deep, "id", "left_semi"), done, last), labels)), "live")
        large = keep(live.where(F.col("cnt") > BLOCK), "large")
        found = keep(_compare_blocks(live.where(F.col("cnt") <= BLOCK), threshold, least), "found").select("u", "v")
        forget(live)
        outside, pending, more = _descend(large, large.count(), docs, size, threshold, least)
        pending.append(found)
        depths, done = [deep, *more], last


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id linked, directly or not) of every row."""
    scanned = keep(_scan(docs, size, trees_for(recall, threshold)), "scan")
    some = scanned.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = keep(some.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    members = keep(some.select("doc_id", "n", "key").join(classes, "key").select("doc_id", "n", "rep"), "members")
    reps = keep(some.join(classes.select(F.col("key").alias("k"), "rep"), (F.col("doc_id") == F.col("rep")) & (F.col("key") == F.col("k"))).select(F.col("doc_id").alias("id"), "n", "sig", "nodes").dropDuplicates(["id", "sig"]), "reps")
    # an id with several texts unites their classes
    several = members.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("doc_id")
    same = keep(members.select("doc_id", "rep").distinct().where("doc_id <> rep").join(several, "doc_id").select(F.greatest("doc_id", "rep").alias("u"), F.least("doc_id", "rep").alias("v")), "same")
    alone = keep(scanned.where(F.col("key").isNull() | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id")), "alone")
    forget(scanned)
    labels = links(reps, docs, size, threshold, recall, same)
    forget(reps)
    linked = _labelled(members, labels, "rep", "component_id").select("doc_id", "n", "component_id")
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles")


def dedup_documents(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that are the first of their component, and those with a null doc_id."""
    found = near_duplicates(docs, size, threshold)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
