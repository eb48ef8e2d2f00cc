"""A Merkle tree over a dataset, and a proof for each of its rows.

Rows are leaves; the leaves of a group form a tree of runs of three, and the roots of
the groups form one more. Leaves are numbered by a range partitioning, so a tree of
any size is cut into blocks of whole subtrees, and one task hashes a block. Proofs come
from pointer jumping: a node holds the digests of its siblings on the way to an
ancestor; a self-join hands it what that ancestor holds, so the way doubles, until every
leaf reaches the root of its group.

Hashes are lowercase hex sha256 over text: digests are concatenated as hex, and the
columns of a leaf as ``-`` for null, else their number of UTF-8 bytes, ``:`` and their
value. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casegate.llm.common import written

RUN = 3
# Levels that one task hashes at once, and the leaves below that many levels.
BLOCK_LEVELS = 7
BLOCK = RUN**BLOCK_LEVELS
# Leaves at each level's first node; a bigint holds no more.
POWERS = [RUN**k for k in range(39)]


def part(column: Column) -> Column:
    """One column as a leaf's hash takes it."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The hash of a row's columns."""
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.size(_levels(n))


def _powers() -> Column:
    return F.expr(f"array({', '.join(f'{p}L' for p in POWERS)})")


def _levels(n: Column) -> Column:
    return F.filter(_powers(), lambda p: p < n)


def _power(level: Column) -> Column:
    return F.element_at(_powers(), level + 1)


def _div(a: Column, b: int | Column) -> Column:
    return F.call_function("div", a, F.lit(b))


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (tree string, not null; hash binary; ...) with ``pos``, the number of
    each among its tree's in the order of the columns ``order`` and the hash, and ``n``,
    the leaves of its tree.

    Ranges of (tree, order) are sorted apart and their counts added up; rows that are
    equal in all of it are spread by a row number and stand in any order.
    """
    rows = written(leaves.withColumn("__row", F.monotonically_increasing_id()), "merkle_leaves")
    ranged = rows.repartitionByRange("tree", *order, "hash", "__row").sortWithinPartitions("tree", *order, "hash", "__row")
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "merkle_order")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("tree", "__part").agg(F.count("*").alias("k"), F.min("__at").alias("__first"))
    tree = W.partitionBy("tree")  # one row per range that holds some of the tree
    starts = counts.select(
        "tree", "__part", "__first", F.sum("k").over(tree).alias("n"), (F.sum("k").over(tree.orderBy("__part")) - F.col("k")).alias("__before")
    )
    return placed.join(starts, ["tree", "__part"]).select(
        *[F.col(c) for c in leaves.columns], (F.col("__before") + F.col("__at") - F.col("__first")).alias("pos"), "n"
    )


def _above(hashes: Column) -> Column:
    """Hashes of the runs of three."""
    runs = F.sequence(F.lit(0), _div(F.size(hashes) - 1, RUN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(hashes, i * RUN + 1, F.lit(RUN)), "").cast("binary"), 256))


def _entries(hashes: Column, level: int, first: Column, last: Column) -> Column:
    """The nodes of one level of a block, whose first is number ``first`` of its level."""

    def entry(digest: Column, i: Column) -> Column:
        before = F.slice(hashes, i - i % RUN + 1, i % RUN)
        after = F.slice(hashes, i + 2, RUN - 1 - i % RUN)
        return F.struct(
            F.lit(level).alias("level"), (first + i).alias("idx"),
            F.unhex(F.array_join(F.concat(before, after), "")).alias("siblings"), F.when(last, F.unhex(digest)).alias("hash"),
        )

    return F.transform(hashes, entry)


def _nodes(layer: DataFrame, base: int) -> DataFrame:
    """Hash the ``BLOCK_LEVELS`` levels above ``layer`` (tree, n, idx, hash), the nodes
    of level ``base``: tree, n, level, idx, siblings (digests of the others of the
    node's run, in order) and hash (of the nodes that the next layer starts from)."""
    blocks = layer.groupBy("tree", "n", _div(F.col("idx"), BLOCK).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: F.lower(F.hex(x["hash"]))).alias("l0")
    )
    top = height(F.col("n"))
    for k in range(BLOCK_LEVELS):
        blocks = blocks.withColumn(f"l{k + 1}", F.when(top > base + k, _above(F.col(f"l{k}"))).otherwise(F.array().cast("array<string>")))
    # Hashes travel on where a layer ends: at its top, or at the root of the tree.
    rows = [
        _entries(F.col(f"l{k}"), base + k, F.col("block") * POWERS[BLOCK_LEVELS - k], F.lit(k == BLOCK_LEVELS) | (top == base + k))
        for k in range(BLOCK_LEVELS + 1)
    ]
    return blocks.select("tree", "n", F.inline(F.concat(*rows)))


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes below the roots (tree, n, level, idx, siblings), and roots (tree, n, hash),
    of numbered leaves (tree, n, pos, hash)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    layer, base, nodes, roots = leaves.select("tree", "n", F.col("pos").alias("idx"), "hash"), 0, [], []
    while True:
        made = written(_nodes(layer, base), "merkle_nodes")
        top = height(F.col("n"))
        nodes.append(made.where((F.col("level") < top) & (F.col("level") < base + BLOCK_LEVELS)).drop("hash"))
        roots.append(made.where((F.col("level") == top) & ((F.col("level") < base + BLOCK_LEVELS) | (F.lit(POWERS[base + BLOCK_LEVELS] >= most)))).select("tree", "n", "hash"))
        base += BLOCK_LEVELS
        if POWERS[base] >= most:
            break
        layer = made.where((F.col("level") == base) & (top >= base)).select("tree", "n", "idx", "hash")
    all_nodes, all_roots = nodes[0], roots[0]
    for more, root in zip(nodes[1:], roots[1:], strict=True):
        all_nodes, all_roots = all_nodes.unionByName(more), all_roots.unionByName(root)
    return all_nodes, all_roots


def paths(nodes: DataFrame, most: int) -> DataFrame:
    """Leaves (tree, pos) with ``siblings`` all the way to the root of their tree, of
    trees of at most ``most`` leaves.

    After a round with distance d, a node holds the siblings of 2d levels. Only nodes
    at multiples of 2d are asked again, so only they go on. A node that many ask has
    a copy per block of its leaves, and they ask the copy of their own block: no key
    has more than a block of rows.
    """
    distance, now = 1, nodes
    while POWERS[distance] < most:
        first = F.col("idx") * _power(F.col("level"))
        last = F.least((F.col("idx") + 1) * _power(F.col("level")), F.col("n")) - 1
        asks = now.where(F.col("level") % (2 * distance) == 0).withColumns(
            {"up": _div(F.col("idx"), POWERS[distance]), "block": _div(first, BLOCK)}
        )
        answers = (
            now.where(F.col("level") % (2 * distance) == distance)
            .withColumn("block", F.explode(F.sequence(_div(first, BLOCK), _div(last, BLOCK))))
            .select("tree", (F.col("level") - distance).alias("level"), F.col("idx").alias("up"), "block", F.col("siblings").alias("more"))
        )
        joined = asks.join(answers, ["tree", "level", "up", "block"], "left")
        more = F.coalesce("more", F.lit(b""))
        now = written(joined.select("tree", "n", "level", "idx", F.concat("siblings", more).alias("siblings")), "merkle_paths")
        distance *= 2
    return now.where("level = 0").select("tree", F.col("idx").alias("pos"), "siblings")


def folded(digest: Column, siblings: Column, pos: Column, n: Column) -> Column:
    """The root (binary) that a leaf's ``digest`` (binary) and its ``siblings`` lead to, if
    the leaf is number ``pos`` of ``n``."""

    def step(state: Column, power: Column) -> Column:
        idx, count = _div(pos, power), _div(n + power - 1, power)
        before = (idx % RUN).cast("int")
        after = F.least(F.lit(RUN - 1) - before, (count - 1 - idx).cast("int"))
        cut = lambda start, k: F.substring(siblings, start, k * 32)
        run = F.concat(cut(state["at"], before), state["hash"], cut(state["at"] + before * 32, after))
        return F.struct(F.unhex(F.sha2(F.lower(F.hex(run)).cast("binary"), 256)).alias("hash"), (state["at"] + (before + after) * 32).alias("at"))

    return F.aggregate(_levels(n), F.struct(digest.alias("hash"), F.lit(1).alias("at")), step)["hash"]


def prove(leaves: DataFrame, *order: str) -> DataFrame:
    """Proofs of ``leaves`` (group string, hash binary, the columns ``order``, more).

    Returns their columns with pos and n (the leaf's place in its group), siblings,
    subroot, group_pos and groups (its group's place), group_siblings and root; digests
    are binary. Groups stand in bytewise order, the null group first; leaves in that of
    ``order``, nulls first, then of their hashes. Rows that are equal in all of it stand
    in any order, each with a proof of its own. No rows give no proofs, and there is no
    root. A group of one row has that row's hash as its subroot.
    """
    tree_of = F.coalesce(F.concat(F.lit("s"), F.col("group")), F.lit("n"))
    rows = written(numbered(leaves.withColumn("tree", tree_of), *order), "merkle_numbered")
    nodes, roots = tree(rows)
    most = rows.agg(F.max("n")).first()[0] or 0
    under = paths(nodes, most)

    roots = written(roots, "merkle_roots")
    groups = written(
        numbered(roots.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "hash", F.col("n").alias("size")), "name"), "merkle_groups"
    )
    top_nodes, top = tree(groups)
    over = paths(top_nodes, groups.agg(F.max("n")).first()[0] or 0)
    root = top.select("tree", F.col("hash").alias("root"))  # one row
    known = groups.join(over, ["tree", "pos"], "left").join(F.broadcast(root), "tree")
    # A group has a copy per block of its leaves, for the join below.
    known = known.select(
        F.col("name").alias("tree"), F.col("hash").alias("subroot"), F.col("pos").alias("group_pos"), F.col("n").alias("groups"),
        F.coalesce("siblings", F.lit(b"")).alias("group_siblings"), "root",
        F.explode(F.sequence(F.lit(0).cast("bigint"), _div(F.col("size") - 1, BLOCK))).alias("__block"),
    )
    proofs = rows.join(under, ["tree", "pos"], "left").withColumn("__block", _div(F.col("pos"), BLOCK))
    return proofs.join(known, ["tree", "__block"]).select(
        *[F.col(c) for c in leaves.columns], "pos", "n", F.coalesce("siblings", F.lit(b"")).alias("siblings"),
        "subroot", "group_pos", "groups", "group_siblings", "root",
    )


def proof_digest(siblings: Column) -> Column:
    """The hash of a proof: of its siblings, level by level."""
    return F.sha2(F.lower(F.hex(siblings)).cast("binary"), 256)


def manifest(docs: DataFrame, text_found: Column | None = None) -> DataFrame:
    """Leaves, proofs and roots of ``docs`` (doc_id, source, lang, n_chars, text), a tree
    per source, and what ``text_found`` (the texts found later; their own if it is not
    given) folds to: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Every row is a leaf: rows without an id stand first in their source, and rows of
    one id in the order of their hashes. Any column may be null, a text may be empty or
    of any length; other columns are not looked at.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    found = F.col("text") if text_found is None else text_found
    leaves = docs.select(
        "doc_id", F.col("source").alias("group"), F.unhex(leaf(*columns, F.col("text"))).alias("hash"), F.unhex(leaf(*columns, found)).alias("found")
    )
    proofs = prove(leaves, "doc_id")
    sub = folded(F.col("found"), F.col("siblings"), F.col("pos"), F.col("n"))
    whole = proofs.withColumn("__sub", sub).withColumn(
        "__root", folded(F.col("__sub"), F.col("group_siblings"), F.col("group_pos"), F.col("groups"))
    )
    text = lambda c: F.lower(F.hex(c))
    return whole.select(
        "doc_id", text("hash").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        proof_digest(F.concat("siblings", "group_siblings")).alias("proof_sha256"),
        text("__root").alias("folded_root"), (F.col("__root") == F.col("root")).alias("verified"),
    )
