"""Near-duplicate search: a chosen-path set similarity join, confirmed on full sets.

Each document is a set of word shingles. A tree branches documents by selected minwise
tokens: below a node go those that share the node's next minwise token. Nodes that are
small are compared exhaustively, on full sets and all pairs; larger ones branch again.
Independent trees are repeated until a pair at the threshold meets with the target
recall: below the first level for all documents, down to the last level for those that
a large node makes branch, which get further trees of their own. Nodes with the same
members in several trees are compared once.

A node that is still large at the last level mostly holds copies of one template. Each of
its documents goes to one block and meets that block and a few pivots of the node, which
links what the template links. Only documents of such a node that are then in different
components are compared further, in pairs of blocks whose sizes allow a link, so the
work beyond one comparison a document grows with what the template doesn't link.

Copies with the same words are one document here. A node gives each of its linked
groups as memberships, never as pairs. Components come from whole components that hook
to the least one they touch, and from pointer jumping along the hooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import WordHashes, alnum_words, chunks_of, column, drop_table, hot_keys, likely, materialise, partitions, release, row_of, rows_back, send_back, spaced_words

#: First and last level of a tree; documents and shingles of a small node; target recall.
FIRST, LAST, NODE_DOCS, NODE_SHINGLES, RECALL = 2, 6, 500, 1_000_000, 0.9995
#: Documents that each block of a large node meets beside its own; hooks that are broadcast; jumps between two looks at the hooks.
PIVOTS, BROADCAST_HOOKS, JUMPS = 8, 200_000, 4
#: Members of a linked group that are written under one name; each such part has the group's head.
PART = 64
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Rule:
    """What counts as a link: shingles of so many words, 100 * intersection >= percent * union."""

    shingle: int = 5
    percent: int = 80
    words: str = "alnum"  # or "space"
    recall: float = RECALL

    @property
    def trees(self) -> int:
        """Trees after which a pair at the threshold has met below the first level."""
        return self._trees(FIRST)

    @property
    def deep_trees(self) -> int:
        """Trees after which it has met below the last level, and so below each one before."""
        return self._trees(LAST)

    def _trees(self, level: int) -> int:
        meet = (self.percent / 100) ** level
        return 1 if meet >= 1 else max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - meet)))

    def split(self, text: str | None) -> list[bytes]:
        return spaced_words(text) if self.words == "space" else alnum_words(text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _Q
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], rule: Rule, hashes: dict) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashed shingles of all texts one after another (repeats included), where each begins, and digests of the words.

    A text of fewer words is one shingle; the number of words is part of its hash.
    """
    words: list[bytes] = []
    sizes, digests = [], []
    for text in texts:
        own = rule.split(text)
        words += own
        sizes.append(len(own))
        digests.append(hashlib.sha256(b" ".join(own)).digest()[:16])
    k = rule.shingle
    ids = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    sizes = np.array(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    firsts = np.cumsum(counts) - counts
    total = int(counts.sum())
    place = np.repeat(starts, counts) + np.arange(total) - np.repeat(firsts, counts)
    span = np.repeat(np.minimum(sizes, k), counts)
    key = span.astype(np.uint64) * _P
    for j in range(k):
        inside = span > j
        word = ids[np.where(inside, place + j, 0)] if len(ids) else ids
        key = np.where(inside, _mix((key ^ word) * _P), key)
    return key, np.append(firsts, total), digests


def _sketch(rule: Rule, trees: range) -> Callable:
    seeds = [_mix(np.array([7919 * (i + 1)], np.uint64) * _P)[0] for i in range(trees.start * LAST, trees.stop * LAST)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes = WordHashes()
        for batch in batches:
            at = 0
            for texts in chunks_of(batch.column(1)):
                keys, firsts, digests = shingle_sets(texts, rule, hashes)
                full = np.flatnonzero(np.diff(firsts) > 0)
                mins = np.empty((len(seeds), len(full)), np.int64)
                for i, seed in enumerate(seeds):
                    if len(full):
                        mins[i] = np.minimum.reduceat(_mix(keys ^ seed), firsts[full]).view(np.int64)
                n = np.zeros(len(texts), np.int64)
                n[full] = [len(np.unique(keys[a:b])) for a, b in zip(firsts[full], firsts[full + 1])]
                rows = [None] * len(texts)
                for d, column in zip(full.tolist(), mins.T.tolist()):
                    rows[d] = column
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(n), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["id", "n", "digest", "mins"]
                )
                at += len(texts)

    return run


def link_groups(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """Connected groups of two or more among sets (sorted distinct hashes), all pairs compared on full sets."""
    m = len(sets)
    sizes = np.array(list(map(len, sets)), np.int64)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [[0, 1]] if both and 100 * both >= percent * (sizes.sum() - both) else []
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    shared = np.bincount(place, minlength=len(tokens)) > 1
    keep = shared[place]
    column = (np.cumsum(shared) - 1)[place[keep]]
    row = row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((m, m), np.float32)
    n, step = int(shared.sum()), max(256, (4 << 20) // m)
    for a in range(0, n, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        part = np.zeros((m, min(step, n - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1.0
        both += part @ part.T
    both = both.astype(np.int64)
    linked = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    np.fill_diagonal(linked, False)
    left, groups = linked.any(1), []
    for i in range(m):
        if left[i]:
            group = np.zeros(m, bool)
            group[i] = True
            front = group
            while front.any():
                front = linked[front].any(0) & ~group
                group = group | front
            left &= ~group
            groups.append(np.flatnonzero(group).tolist())
    return groups


def _part_of(node: int, at: int) -> int:
    """A name for a part of a group of a node."""
    return node if at == 0 else int.from_bytes(hashlib.sha256(b"%d %d" % (node, at)).digest()[:8], "little", signed=True)


def _compare(rule: Rule, id_type: pa.DataType) -> Callable:
    """Rows (node, id, digest, text), sorted by node: (node, head, digest, id) for each member of a linked group."""
    schema = pa.schema([("node", pa.int64()), ("head", pa.binary()), ("digest", pa.binary()), ("id", id_type)])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        node, rows = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for n, i, d, t in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    if n != node:
                        if rows:
                            yield node, rows
                        node, rows = n, []
                    rows.append((i, d, t))
        if rows:
            yield node, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes, out = WordHashes(), []
        for node, rows in groups(batches):
            keys, firsts, digests = shingle_sets([t for _, _, t in rows], rule, hashes)
            # a repeated id with another text isn't the row that is meant; a repeated row is the same again
            own = {d: k for k, ((_, d, _), now) in enumerate(zip(rows, digests)) if d == now}
            if len(own) < 2:
                continue
            sets = [np.unique(keys[firsts[k] : firsts[k + 1]]) for k in own.values()]
            names = [(d, rows[k][0]) for d, k in own.items()]
            for group in link_groups(sets, rule.percent):
                for at in range(0, len(group), PART):
                    part = [group[0]] * (at > 0) + group[at : at + PART]
                    out += [(_part_of(node, at), names[group[0]][0], *names[k]) for k in part]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _roots(reps: DataFrame, trees: range) -> DataFrame:
    """A row (digest, n, path, node) for each set and tree; mins are those of these trees."""
    tree = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.slice("mins", k * LAST + 1, LAST).alias("path")) for k, t in enumerate(trees)]))
    return reps.select("digest", "n", tree.alias("t")).select(
        "digest", "n", F.col("t.path").alias("path"), F.xxhash64(F.col("t.tree"), *[F.col("t.path")[i] for i in range(FIRST)]).alias("node")
    )


def _settle(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame | None]:
    """Memberships of the small nodes, and the rows of the large ones (none: None)."""
    n = max(8, partitions(rows.sparkSession))
    sizes = rows.groupBy("node").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).cast("string").alias("members")).where("docs > 1")
    sizes = materialise(sizes, f"nodes-{label}")
    small = (F.col("docs") <= NODE_DOCS) & (F.col("shingles") <= NODE_SHINGLES)
    once = sizes.where(small).groupBy("docs", "shingles", "members").agg(F.min("node").alias("node")).select("node", F.lit(True).alias("leaf"))
    large = sizes.where(~small).select("node", F.lit(False).alias("leaf"))
    if large.isEmpty():
        return rows.join(once, "node").select("digest", "node"), None
    total = sizes.agg(F.sum("docs")).first()[0]
    met = materialise(send_back(rows, "node", once.unionByName(large), hot_keys(sizes, total, n, "docs")), f"met-{label}")
    return met.where("leaf").select("digest", "node"), met.where("NOT leaf").drop("leaf")


def plant_trees(reps: DataFrame, rule: Rule, more: Callable[[DataFrame, range], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Memberships (digest, node) of nodes to compare, and rows (digest, n, node) of those still large at the last level.

    reps: digest, n, mins, one row a set.

    Documents of a large node branch, so pairs there must agree on more minima. They get
    as many further trees as keep the recall at the last level; more(digests, trees) gives
    their rows of reps with the minima of these trees. Two documents of one large node
    are both among them.
    """
    found, rows = _settle(_roots(reps, range(rule.trees)), f"{FIRST}")
    if rows is not None and rule.deep_trees > rule.trees:
        deep = range(rule.trees, rule.deep_trees)
        digests = materialise(rows.select("digest").distinct(), "branching")
        leaves, further = _settle(_roots(materialise(more(digests, deep), "deep-sketches"), deep), f"{FIRST}-deep")
        found = found.unionByName(leaves)
        rows = rows if further is None else rows.unionByName(further)
    for level in range(FIRST, LAST):
        if rows is None:
            return found, None
        rows = materialise(rows.select("digest", "n", "path", F.xxhash64("node", F.col("path")[level]).alias("node")), f"branch-{level}")
        leaves, rows = _settle(rows, f"{level + 1}")
        found = found.unionByName(leaves)
    return found, None if rows is None else rows.select("digest", "n", "node")


def _blocks_for(docs: Column, shingles: Column) -> Column:
    """Blocks of which any two make a small node, about."""
    return F.ceil(F.greatest(docs * 2.0 / NODE_DOCS, shingles * 2.0 / NODE_SHINGLES, F.lit(1.0))).cast("int")


def _block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("digest"), blocks).cast("int")


def blocks_with_pivots(large: DataFrame) -> DataFrame:
    """Memberships (digest, node): each document of large nodes in one block of one of them, and pivots in all its blocks."""
    n = max(8, partitions(large.sparkSession))
    chosen = materialise(large.groupBy("digest", "n").agg(F.min("node").alias("node")), "chosen-nodes")
    pivot = F.min(F.struct(F.xxhash64("digest", "node").alias("h"), "digest"))
    mine = F.pmod(F.xxhash64("digest"), F.lit(PIVOTS))
    facts = chosen.withColumn("mine", mine).groupBy("node", "mine").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"), pivot.alias("pivot"))
    nodes = facts.groupBy("node").agg(F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"), F.collect_list("pivot.digest").alias("pivots"))
    nodes = materialise(nodes.withColumn("blocks", _blocks_for(F.col("docs"), F.col("shingles"))), "large-nodes")
    total = nodes.agg(F.sum("docs")).first()[0]
    own = send_back(chosen, "node", nodes.select("node", "blocks"), hot_keys(nodes, total, n, "docs")).select("digest", "node", _block_of(F.col("blocks")).alias("block"))
    pivots = nodes.select("node", F.explode("pivots").alias("digest"), "blocks").select("digest", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return own.unionByName(pivots).select("digest", F.xxhash64("node", "block", F.lit("pivots")).alias("node")).distinct()


def unlinked_pairs(large: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Memberships (digest, node) of pairs of blocks that hold all pairs of a large node whose documents are in different components.

    found: (digest, component). Beside the node's main component, the others meet one another
    and the main one; blocks hold texts of like size, and only sizes that allow a link meet.
    """
    n = max(8, partitions(large.sparkSession))
    label = F.coalesce(F.col("component").cast("string"), F.concat(F.lit("alone "), F.hex("digest")))
    rows = materialise(large.join(found, "digest", "left").select("digest", "n", "node", label.alias("label")), "large-labels")
    per = rows.groupBy("node", "label").agg(F.count("*").alias("docs"))
    nodes = materialise(per.groupBy("node").agg(F.sum("docs").alias("docs"), F.max_by("label", F.struct("docs", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1"), "large-mains")
    total = nodes.agg(F.sum("docs")).first()[0] or 0
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(percent, 99)) + 1e-9).cast("int")
    sided = send_back(rows, "node", nodes.select("node", "main"), hot_keys(nodes, total, n, "docs")).select("digest", "n", "node", (F.col("label") == F.col("main")).alias("is_main"), size.alias("size"))
    sided = materialise(sided, "large-sides")
    keys = ["node", "is_main", "size"]
    sizes = materialise(sided.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).select(*keys, _blocks_for(F.col("docs"), F.col("shingles")).alias("blocks")), "large-blocks")
    blocks = sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    name = F.struct("is_main", "size", "block")
    a = blocks.where("NOT is_main").select("node", "size", name.alias("a"))
    b = blocks.select("node", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"), name.alias("b"))
    met = a.join(b, ["node", "size"]).where("b.is_main OR a <= b").select("node", "a", "b", F.xxhash64("node", "a", "b", F.lit("sides")).alias("pair"))
    ends = met.select("node", F.explode(F.array("a", "b")).alias("own"), "pair").groupBy("node", "own.is_main", "own.size", "own.block").agg(F.collect_set("pair").alias("pairs"))
    ends = materialise(ends, "large-pairs")
    small = (ends.agg(F.sum(F.size("pairs"))).first()[0] or 0) <= BROADCAST_HOOKS  # of these, and so of sizes: a block has a pair
    dealt = sided.join(F.broadcast(sizes) if small else sizes, keys).withColumn("block", _block_of(F.col("blocks")))
    return dealt.join(F.broadcast(ends) if small else ends, [*keys, "block"]).select("digest", F.explode("pairs").alias("node"))


def _follow(hooks: DataFrame) -> DataFrame:
    """Hooks (label, up) after one jump: to where up itself hooks."""
    above = hooks.select(F.col("label").alias("up"), F.col("up").alias("top"))
    return hooks.join(above, "up", "left").select("label", F.coalesce("top", "up").alias("up"))


def components(groups: DataFrame) -> DataFrame:
    """(digest, component) of memberships (node, head, digest, id): the least id that can be reached.

    Each round, every component hooks to the least one that a group joins it to; hooks are
    followed to their end by jumps that double, so a chain takes rounds by its logarithm.
    Groups are written in small parts, so no window is hot.
    """
    digests = groups.groupBy("digest").agg(F.min("id").alias("label"))
    state = materialise(groups.select("node", "head", "digest").distinct().join(digests, "digest"), "labels")
    while True:
        low = state.select("label", F.min("label").over(Window.partitionBy("node", "head")).alias("up")).where("up < label")
        hooks = materialise(low.groupBy("label").agg(F.min("up").alias("up")), "hooks")
        n = hooks.count()
        if not n:
            return state.select("digest", F.col("label").alias("component")).distinct()
        while True:
            further = hooks
            for _ in range(JUMPS):
                further = _follow(further)
            further = materialise(further, "hooks")
            same = further.join(hooks, ["label", "up"], "left_anti").isEmpty()
            drop_table(hooks)
            hooks = further
            if same:
                break
        if n <= BROADCAST_HOOKS:
            met = state.join(F.broadcast(hooks), "label", "left")
        else:
            met = send_back(state, "label", state.select("label").distinct().join(hooks, "label", "left"))
        new = materialise(met.select("node", "head", "digest", F.coalesce("up", "label").alias("label")), "labels")
        drop_table(state)
        drop_table(hooks)
        state = new


def _texts_of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups (node, head, digest, id) that join the texts of an id: blocks of them, each with the same pivot."""
    print_of = F.xxhash64("digest")
    shared = rows.groupBy("id").agg(F.min(print_of).alias("low"), F.max(print_of).alias("high"), F.count("*").alias("docs")).where("low != high")
    shared = materialise(shared.select("id", F.ceil(F.col("docs") / NODE_DOCS).cast("int").alias("blocks")), "shared-ids")
    if shared.isEmpty():
        return rows.limit(0).select(F.xxhash64("id").alias("node"), F.lit(b"").alias("head"), "digest", "id")
    own = materialise(send_back(rows.select("id", "digest"), "id", shared), "texts-of-ids")
    pivots = own.groupBy("id", "blocks").agg(F.min("digest").alias("digest")).select("id", "digest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = own.select("id", "digest", _block_of(F.col("blocks")).alias("block")).unionByName(pivots)
    return dealt.select(F.xxhash64("id", "block", F.lit("id")).alias("node"), F.lit(b"").alias("head"), "digest").distinct().join(classes.select("digest", "id"), "digest")


def near_dedup(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    n_shingles is the number of distinct shingles; component_id is the smallest id that
    links reach, the row's own included; kept where that is its own id. Texts without
    words, null ones too, have no shingles and no links. Equal texts are linked. Rows
    without an id can't be linked: their component_id is null and they are kept. Repeated
    rows all get the same answer; an id that stands for several texts joins all their
    components. An empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[kind]
    sql = kind.simpleString()
    named = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    sketched, groups_of = f"id {sql}, n long, digest binary, mins array<bigint>", f"node long, head binary, digest binary, id {sql}"
    narrow = materialise(named.mapInArrow(_sketch(rule, range(rule.trees)), sketched), "sketches")
    linkable = narrow.where("n > 0 AND id IS NOT NULL")
    classes = materialise(linkable.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("mins").alias("mins")), "classes")

    def more(digests: DataFrame, trees: range) -> DataFrame:
        meant = digests.join(classes.select("digest", "id"), "digest")
        ids = materialise(meant.select("id").distinct(), "branching-ids")
        again = likely(named, "id", ids, ids.count()).mapInArrow(_sketch(rule, trees), sketched)
        return again.join(meant, ["id", "digest"]).groupBy("digest").agg(F.first("n").alias("n"), F.first("mins").alias("mins"))

    def compared(members: DataFrame, label: str) -> DataFrame:
        """Linked groups of memberships (digest, node): (node, head, digest, id)."""
        nodes = materialise(members.groupBy("digest").agg(F.collect_set("node").alias("nodes")).join(classes.select("digest", "id"), "digest"), f"wanted-{label}")
        texts = likely(named, "id", nodes.select("id"), nodes.count()).join(nodes, "id").select(F.explode("nodes").alias("node"), "id", "digest", "text")
        sorted_texts = texts.repartition("node").sortWithinPartitions("node")
        return materialise(sorted_texts.mapInArrow(_compare(rule, arrow), groups_of), f"groups-{label}")

    members, large = plant_trees(classes, rule, more)
    if large is not None:
        large = materialise(large, "large")
        members = members.unionByName(blocks_with_pivots(large))
    groups = compared(materialise(members, "members"), "nodes").unionByName(_texts_of_one_id(linkable, classes))
    found = components(groups)
    if large is not None:
        rest = materialise(unlinked_pairs(large, found, rule.percent), "unlinked")
        if not rest.isEmpty():
            found = components(groups.unionByName(compared(rest, "unlinked")))
    labels = classes.select("digest", "id").join(found, "digest", "left").select("digest", F.coalesce("component", "id").alias("component"))
    linked = send_back(linkable.select("id", "n", "digest"), "digest", labels)
    rest = narrow.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    rows = linked.select("id", "n", "component").unionByName(rest)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def without_near_copies(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that near_dedup keeps."""
    gone = near_dedup(docs, rule, id_col, text_col).where("NOT kept").select(column(id_col).alias("gone")).distinct()
    rows = row_of(docs)
    return rows_back(rows.join(gone, F.col("row")[id_col] == F.col("gone"), "left_anti"))
