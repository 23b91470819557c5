"""Merkle manifest of a documents table: leaves, per-source subroots, one root, a proof per row and a check of it.

Every row is a leaf: H of its fields doc_id, source, lang, n_chars, text, each written `-` if null, else as the
byte count of its UTF-8 text, `:` and the text (integers in decimal). H is the lowercase hex sha256 of its inputs
concatenated, hashes among them as hex text. Per source the leaves ascend by doc_id (null doc_id first; rows of
one doc_id by their leaf, so that equal rows are interchangeable); while a level has more than one node, every
`FAN` consecutive nodes (the last run fewer, even one) become the H of their hashes. The one node left is the
source's subroot. Subroots, ordered by source (null first, then UTF-8 bytewise), make the root the same way.

Building: each level is one grouping on (tree, pos div FAN) and is written to the shared folder as node rows that
name their parent (tree, level, pos) and their slot in it; a parent row holds its children's hashes. Positions
come from a range-partitioned sort and a prefix sum over (partition, tree) runs, so a source holding a third of
all rows is spread over many tasks. No list grows on the driver except the number of levels.

Checking: a recursive query (`WITH RECURSIVE`) climbs from every leaf through the parent links to the root, one
level per step; each step emits the siblings it meets and folds the leaf's possibly tampered hash with them.
Tampering (`tampered_text`) is a parameter; where it changes nothing, the folded root is the root.

Edge cases: an empty table has no leaves, no root and no rows. Null doc_id, source, lang, n_chars or text are
written `-`. Repeated rows are separate leaves with equal hashes. Extra columns of the caller are not read and
do not appear in the result; all working names are generated by this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from coursequarry.sources.scratch import cut_lineage

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROOT_TREE = -1
_LIMIT = "spark.sql.cteRecursionRowLimit"


def encoded(value: Column) -> Column:
    """`-` for null, else `<UTF-8 byte count>:<value>`; integers are written in decimal."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The driver's tampering: where 2 divides unsigned crc32 of the decimal doc_id, every \\n of the text goes.

    A null doc_id or text is left as it is.
    """
    hit = (F.crc32(doc_id.cast("string")) % 2) == 0
    return F.when(hit & text.isNotNull(), F.regexp_replace(text, "\n", "")).otherwise(text)


def _positions(df: DataFrame, tree: str, order: list[Column], name: str) -> DataFrame:
    """`df` with `pos`: the row's 0-based place within its `tree` by `order`, written to the shared folder.

    The rows are range-partitioned on (tree, order) and sorted in each partition, so a tree runs over several
    partitions in order; a row's place is its offset in its (partition, tree) run plus the rows of that tree in
    earlier partitions (a prefix sum over runs, one row per partition and tree).
    """
    keys = [F.col(tree).asc_nulls_first(), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_mk_part"), F.monotonically_increasing_id().alias("_mk_seq"))
    ranged = cut_lineage(ranged, f"{name}-sorted")
    runs = ranged.groupBy("_mk_part", tree).agg(F.count(F.lit(1)).alias("_mk_n"), F.min("_mk_seq").alias("_mk_first"))
    before = F.sum("_mk_n").over(
        Window.partitionBy(tree).orderBy("_mk_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_mk_part", tree, "_mk_first", F.coalesce(before, F.lit(0)).alias("_mk_offset"))
    return ranged.join(runs, ["_mk_part", tree]).select(
        *[c for c in df.columns], (F.col("_mk_seq") - F.col("_mk_first") + F.col("_mk_offset")).alias("pos"))


def _levels_above(nodes: DataFrame, sizes: DataFrame, name: str, depth: int) -> list[DataFrame]:
    """The written levels 1..depth of trees whose level 0 is `nodes` (tree, pos, h); `sizes` gives (tree, n)."""
    levels, now = [], nodes.select("tree", "pos", "h")
    for level in range(depth):
        span = FAN ** level
        width = sizes.select("tree", F.expr(f"(n + {span - 1}) div {span}").alias("_mk_width"))
        # Only trees that still have more than one node climb; the last run may be shorter.
        climbing = now.join(width.filter("_mk_width > 1"), "tree").select("tree", "pos", "h")
        parent = climbing.groupBy("tree", F.expr(f"pos div {FAN}").alias("pos")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("_mk_kids"))
        parent = parent.select("tree", "pos", F.transform("_mk_kids", lambda k: k["h"]).alias("children"))
        parent = cut_lineage(parent.select(
            "tree", F.lit(level + 1).alias("level"), "pos", F.sha2(F.array_join("children", ""), 256).alias("h"),
            "children"), f"{name}-level")
        levels.append(parent)
        now = parent
    return levels


def _top_level(n: Column, largest: int) -> Column:
    """The level at which a tree of `n` leaves has one node: the least L with FAN ** L >= n (integers only)."""
    top = F.lit(0)
    for level in range(1, _depth(largest) + 1):
        top = F.when(n > FAN ** (level - 1), F.lit(level)).otherwise(top)
    return top


def _depth(n: int) -> int:
    depth, width = 0, n
    while width > 1:
        width, depth = -(-width // FAN), depth + 1
    return depth


def manifest(docs: DataFrame, tamper=tampered_text, name: str = "merkle") -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    proof_sha256 is H of the siblings met from the leaf via the subroot to the root, level by level, left to right
    in each run (H of nothing where there are none). folded_root is the root recomputed from the leaf of
    `tamper(doc_id, text)` (other fields as they are) and the original siblings; verified says it equals root.
    """
    spark = docs.sparkSession
    d = F.col
    leaves = docs.select(
        d("doc_id").cast("long").alias("doc_id"), d("source").cast("string").alias("source"),
        leaf_hash(d("doc_id"), d("source"), d("lang"), d("n_chars"), d("text")).alias("h"),
        leaf_hash(d("doc_id"), d("source"), d("lang"), d("n_chars"), tamper(d("doc_id"), d("text"))).alias("fh"))

    # Trees: one per source, numbered in source order (null first, UTF-8 bytewise).
    sources = cut_lineage(leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n")), f"{name}-sources")
    sources = _positions(sources.select(F.lit(0).alias("_mk_one"), "source", "n"), "_mk_one",
                         [d("source").asc_nulls_first()], f"{name}-sources").select(
        "source", "n", d("pos").alias("tree"))
    sources = cut_lineage(sources, f"{name}-trees")
    n_trees, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()

    leaves = leaves.join(sources.select("source", "tree"), leaves["source"].eqNullSafe(sources["source"])).drop(
        sources["source"])
    leaves = _positions(leaves, "tree", [d("doc_id").asc_nulls_first(), d("h")], f"{name}-leaves")
    sizes = sources.select("tree", "n")
    source_levels = _levels_above(leaves, sizes, name, _depth(largest))

    # Subroots: the single node of each tree's top level; they are level 0 of the root tree, at their tree's place.
    tops = sizes.select("tree", _top_level(F.col("n"), largest).alias("level"))
    every = leaves.select("tree", F.lit(0).alias("level"), "pos", "h", F.lit(None).cast("array<string>").alias(
        "children"))
    for level in source_levels:
        every = every.unionByName(level)
    subroots = cut_lineage(every.join(tops, ["tree", "level"]).select(
        "tree", F.col("h").alias("subroot")), f"{name}-subroots")
    root_levels = _levels_above(subroots.select(F.lit(ROOT_TREE).alias("tree"), d("tree").alias("pos"),
                                                d("subroot").alias("h")),
                                spark.createDataFrame([(ROOT_TREE, n_trees)], "tree long, n long"), name, _depth(n_trees))
    # Parent links: within a tree until its top, then from a subroot into the root tree (if there are several).
    linked = every.join(tops.withColumnRenamed("level", "_mk_top"), "tree").select(
        "tree", "level", "pos", "h", "children",
        F.when(d("level") < d("_mk_top"), d("tree")).when(F.lit(n_trees > 1), F.lit(ROOT_TREE)).alias("up_tree"),
        F.when(d("level") < d("_mk_top"), d("level") + 1).when(F.lit(n_trees > 1), F.lit(1)).alias("up_level"),
        F.when(d("level") < d("_mk_top"), F.expr(f"pos div {FAN}")).when(
            F.lit(n_trees > 1), F.expr(f"tree div {FAN}")).alias("up_pos"),
        F.when(d("level") < d("_mk_top"), d("pos") % FAN).otherwise(d("tree") % FAN).cast("int").alias("slot"))
    top = len(root_levels)
    for level in root_levels:
        linked = linked.unionByName(level.select(
            "tree", "level", "pos", "h", "children",
            F.when(d("level") < top, F.lit(ROOT_TREE)).alias("up_tree"),
            F.when(d("level") < top, d("level") + 1).alias("up_level"),
            F.when(d("level") < top, F.expr(f"pos div {FAN}")).alias("up_pos"),
            (d("pos") % FAN).cast("int").alias("slot")))
    # The climb joins its rows with the node table once per level: hashes travel as 32 bytes, and the table is
    # kept partitioned on its key so that only the climbing rows move at each step.
    nodes = cut_lineage(linked.select(
        "tree", "level", "pos", F.unhex("h").alias("h"), F.transform("children", F.unhex).alias("children"),
        "up_tree", "up_level", "up_pos", "slot"), f"{name}-nodes")
    start = leaves.select("tree", "pos", "doc_id", d("h").alias("leaf"), F.unhex("fh").alias("fh"))
    return _climb(spark, start, nodes, name)


def _climb(spark, start: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The recursive ascent of every leaf; its rows are written, so that the result does not repeat it."""
    tag = name.replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.repartition(parts, "tree", "level", "pos").persist()
    start.createOrReplaceTempView(f"_mk_{tag}_start")
    keyed.createOrReplaceTempView(f"_mk_{tag}_nodes")
    hexed = "lower(hex({}))"
    climb = spark.sql(f"""
        WITH RECURSIVE climb(tree, pos, step, node_tree, h, fh, up_tree, up_level, up_pos, slot, siblings) AS (
            SELECT s.tree, s.pos, 0, s.tree, n.h, s.fh, n.up_tree, n.up_level, n.up_pos, n.slot, X''
            FROM _mk_{tag}_start s JOIN _mk_{tag}_nodes n ON n.tree = s.tree AND n.level = 0 AND n.pos = s.pos
            UNION ALL
            SELECT c.tree, c.pos, c.step + 1, p.tree, p.h,
                   unhex(sha2(array_join(transform(p.children, (x, i) -> {hexed.format("IF(i = c.slot, c.fh, x)")}), ''),
                              256)),
                   p.up_tree, p.up_level, p.up_pos, p.slot,
                   aggregate(filter(p.children, (x, i) -> i <> c.slot), X'', (acc, x) -> concat(acc, x))
            FROM climb c JOIN _mk_{tag}_nodes p
              ON p.tree = c.up_tree AND p.level = c.up_level AND p.pos = c.up_pos)
        SELECT tree, pos, step, siblings,
               IF(up_tree IS NULL, h, NULL) AS root, IF(up_tree IS NULL, fh, NULL) AS folded_root,
               IF(node_tree >= 0 AND coalesce(up_tree, -1) < 0, h, NULL) AS subroot
        FROM climb""")
    previous = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, "-1")  # every leaf climbs every level: the rows grow with the table by design
    try:
        steps = cut_lineage(climb, f"{name}-climb")
    finally:
        spark.conf.set(_LIMIT, previous)
        keyed.unpersist()
    d = F.col
    path = steps.groupBy("tree", "pos").agg(
        F.sort_array(F.collect_list(F.struct("step", F.lower(F.hex("siblings")).alias("s")))).alias("_mk_path"),
        F.max(F.lower(F.hex("root"))).alias("root"), F.max(F.lower(F.hex("folded_root"))).alias("folded_root"),
        F.max(F.lower(F.hex("subroot"))).alias("subroot"))
    path = path.select("tree", "pos", "subroot", "root", "folded_root",
                       F.sha2(F.array_join(F.transform("_mk_path", lambda s: s["s"]), ""), 256).alias("proof_sha256"))
    return start.join(path, ["tree", "pos"]).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (d("folded_root") == d("root")).alias("verified"))
