"""Merkle manifest of a table: a leaf per row, a tree per source, a tree over those.

Leaves get their place by ranges of (source, id): rows are sorted within ranges,
and each range adds the number of rows that earlier ranges hold of its source, so
a source with a third of all rows is no group of its own anywhere. A level is one
grouping by (tree, place / fanout): conditional aggregates spread the children of
a parent into one column a slot. The columns joined and hashed are the parent;
joined without the own slot they are a child's siblings. Groups have ``fanout``
rows at most and every level is a sixteenth of the one below.

Siblings go down from the root the same way: a parent's row meets the siblings of
all its ancestors once and passes them to its children, so no leaf looks up a
level on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.writers import staged
from .common import small_side, table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_BITS = 33  # rows of a partition within monotonically_increasing_id


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows join to the same text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def placed(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with their ``place`` (from 0) and number ``n`` within the tree,
    ordered by columns that no two rows of a tree share (staged)."""
    numbered = nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order) \
        .withColumn("_at", F.monotonically_increasing_id())
    rows = staged(numbered.select("*", F.shiftright("_at", _ROW_BITS).alias("_part")), "placed")
    held = rows.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_tree = Window.partitionBy(tree)
    earlier = of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # neighbours only share a range: as many rows as ranges and trees together
    offsets = staged(held.select(
        F.col(tree).alias("_tree"), F.col("_part").alias("_in"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(of_tree).alias("n"),
    ), "offsets")
    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_in"))
    return rows.join(small_side(offsets), same).select(*nodes.columns, (F.col("_at") + F.col("_shift")).alias("place"), "n")


def _slots(children: DataFrame, tree: str, fanout: int, carried: list[str]) -> DataFrame:
    """One row per parent: tree, place, n of its level, and a column per slot."""
    child = F.struct("node", *carried)
    return children.withColumn("slot", F.col("place") % fanout).groupBy(
        tree, F.floor(F.col("place") / fanout).cast("long").alias("place"), F.ceil(F.col("n") / fanout).cast("long").alias("n"),
    ).agg(*[F.max(F.when(F.col("slot") == k, child)).alias(f"s{k}") for k in range(fanout)])


def _joined(slots: list[str]) -> Column:
    return F.concat_ws("", *[F.col(f"{s}.node") for s in slots]) if slots else F.lit("")


def _levels(nodes: DataFrame, tree: str, fanout: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Parents of each level, from the lowest, and the last node of each tree with
    its ``height``. ``nodes``: tree, node, place, n and the columns to carry along."""
    slots, levels, tops, height = [f"s{k}" for k in range(fanout)], [], [], 0
    while True:
        tops.append(nodes.filter("n = 1").select(tree, "node", F.lit(height).alias("height")))
        above = nodes.filter("n > 1")
        if above.isEmpty():  # after log16 of the largest tree
            return levels, reduce(DataFrame.unionByName, tops)
        levels.append(staged(_slots(above, tree, fanout, carried if height == 0 else []), "level"))
        height += 1
        nodes = levels[-1].select(tree, "place", "n", F.sha2(_joined(slots), 256).alias("node"))


def _step(k: int, slots: list[str]) -> Column:
    return F.struct(_joined(slots[:k]).alias("left"), _joined(slots[k + 1:]).alias("right"))


def _descend(levels: list[DataFrame], tops: DataFrame, tree: str, fanout: int, kept: list[str], carried: list[str]) -> DataFrame:
    """Every lowest node with the siblings of its ancestors and of itself from the
    root's end: tree, node, path, the carried columns, and ``kept`` columns of its
    tree. ``tops`` has the path above each tree's last node."""
    slots = [f"s{k}" for k in range(fanout)]
    for height in range(len(levels), 0, -1):
        own = carried if height == 1 else []
        here = tops.filter(F.col("height") == height).select(tree, F.lit(0).cast("long").alias("place"), "path", *kept)
        known = here if height == len(levels) else here.unionByName(below)
        known = known.withColumnsRenamed({tree: "_tree", "place": "_place"})
        parents = levels[height - 1].join(
            known, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("place") == F.col("_place")))
        children = F.array(*[
            F.when(F.col(s).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(s).alias("child"), _step(k, slots).alias("step")))
            for k, s in enumerate(slots)])
        spread = parents.select(tree, "place", "path", *kept, F.explode(F.array_compact(children)).alias("c"))
        below = spread.select(
            tree, (F.col("place") * fanout + F.col("c.k")).alias("place"), F.col("c.child.node").alias("node"),
            F.concat(F.array("c.step"), "path").alias("path"), *kept, *[F.col(f"c.child.{c}").alias(c) for c in own])
        if height > 1:
            below = below.drop("node")
    return below


def folded(leaf: Column, path: Column) -> Column:
    """Root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root,
    proof_sha256, path, folded_root, verified.

    ``columns`` name the id, the source and further hashed columns, the text last;
    ``tampered`` (by default nothing) says in which rows the text is put in ASCII
    lower case before the root is recomputed; a missing text stays missing.
    ``path`` holds the siblings left and right at each level, from the leaf. Within
    a source leaves ascend by id, a missing id first, equal ids by leaf; rows that
    are the same in all hashed columns are leaves of their own. A missing source is
    a source and comes first. A source of one row has that leaf as subroot, a single
    source's subroot is the root, and their proof is the hash of nothing where no
    level is left. Further columns are ignored. An empty table gives no rows.
    """
    id_col, source_col, text_col = columns[0], columns[1], columns[-1]
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    fields = [F.col(c) for c in columns]
    leaves = staged(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), leaf_hash(fields).alias("node"),
        F.when(changed, leaf_hash([*fields[:-1], lowered])).alias("other"),
        F.monotonically_increasing_id().alias("_row"),  # tells repeated rows apart
    ), "leaves")
    levels, subroots = _levels(placed(leaves, "source", ["doc_id", "node", "_row"]), "source", fanout, ["doc_id", "other"])
    subroots = staged(subroots, "subroots")
    over, roots = _levels(placed(subroots.withColumn("all", F.lit(0)), "all", ["source"]), "all", fanout, ["source", "height"])
    root = staged(roots.select("all", "height", F.col("node").alias("root")), "root")
    top = root.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    if over:
        of_source = _descend(over, top, "all", fanout, ["root"], ["source", "height"]).withColumnRenamed("node", "subroot")
    else:
        of_source = subroots.withColumn("all", F.lit(0)).withColumnRenamed("node", "subroot").join(top.drop("height"), "all")
    tops = staged(of_source.select("source", "height", "path", "subroot", "root"), "tops")
    single = tops.filter("height = 0").withColumnRenamed("source", "_source")
    lone = leaves.join(single, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "doc_id", "node", "other", "path", "subroot", "root")
    if levels:
        below = _descend(levels, tops, "source", fanout, ["subroot", "root"], ["doc_id", "other"])
        lone = lone.unionByName(below.select(*lone.columns))
    joined = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return lone.select(
        "doc_id", "source", F.col("node").alias("leaf"), "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), "path",
        folded(F.coalesce("other", "node"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, tampered=fifth).drop("source", "path")


_FIELDS = {c: f"CASE WHEN {{{c}}} IS NULL THEN '-' ELSE CAST(strlen(CAST({{{c}}} AS VARCHAR)) AS VARCHAR) || ':' || CAST({{{c}}} AS VARCHAR) END"
           for c in COLUMNS}


def _sql_leaf(text: str) -> str:
    names = {c: c for c in COLUMNS} | {"text": text}
    return "sha256(" + " || ".join(f.format(**names) for f in _FIELDS.values()) + ")"


# crc32 by its definition: a register shifted eight times a byte, polynomial 0xEDB88320
_CRC = ("xor(list_reduce([4294967295] || list_transform(range(1, length(t) + 1), lambda i: ascii(t[i])), "
        "lambda c, b: list_reduce([xor(c, b)] || range(8), "
        "lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295)")
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
SQL = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, CAST(doc_id AS VARCHAR) AS t FROM documents),
l AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS uid, doc_id, source, {_sql_leaf('text')} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM d),
up AS (
  SELECT source, 0 AS level, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM l
  UNION ALL
  SELECT source, min(level) + 1, place // 16, (min(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY place))
  FROM up WHERE n > 1 GROUP BY source, place // 16),
nodes AS MATERIALIZED (SELECT * FROM up),
subroots AS MATERIALIZED (SELECT source, level AS height, node AS subroot FROM nodes WHERE n = 1),
over AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n, subroot AS node
  FROM subroots
  UNION ALL
  SELECT min(level) + 1, place // 16, (min(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY place))
  FROM over WHERE n > 1 GROUP BY place // 16),
onodes AS MATERIALIZED (SELECT * FROM over),
steps AS MATERIALIZED (  -- the nodes left and right of each node in its run
  SELECT source, level, place,
    coalesce(string_agg(node, '') OVER (PARTITION BY source, level, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(node, '') OVER (PARTITION BY source, level, place // 16 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM nodes WHERE n > 1),
osteps AS MATERIALIZED (
  SELECT level, place,
    coalesce(string_agg(node, '') OVER (PARTITION BY level, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(node, '') OVER (PARTITION BY level, place // 16 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM onodes WHERE n > 1),
fold AS (
  SELECT uid, source, 0 AS level, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place,
    coalesce(other, leaf) AS node, '' AS proof FROM l
  UNION ALL
  SELECT f.uid, f.source, f.level + 1, f.place // 16, sha256(s.lft || f.node || s.rgt), f.proof || s.lft || s.rgt
  FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.level = f.level AND s.place = f.place),
low AS MATERIALIZED (
  SELECT f.uid, f.source, f.node, f.proof FROM fold f
  JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source AND s.height = f.level),
ofold AS (
  SELECT w.uid, 0 AS level, o.place, w.node, w.proof FROM low w
  JOIN (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM subroots) o ON o.source IS NOT DISTINCT FROM w.source
  UNION ALL
  SELECT f.uid, f.level + 1, f.place // 16, sha256(s.lft || f.node || s.rgt), f.proof || s.lft || s.rgt
  FROM ofold f JOIN osteps s USING (level, place)),
top AS (SELECT level, node AS root FROM onodes WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = top.root AS verified
FROM l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN ofold f USING (uid) JOIN top USING (level)
""",
}
