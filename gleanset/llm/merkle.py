"""Merkle manifest of a table: a digest of each row, a tree for each group of rows, a tree over the groups, and proofs.

Rows are hashed where they are read. The digests are sorted over the cluster by group, id and digest, so that a row's place
in its group is what stands before it in its range, plus what its group has in earlier ranges. No task holds a whole group.

Trees grow by events. A task keeps partial parents: child digests by slot. When a parent has the number of children that
its group's size gives it, its digest is made and is itself an event for the parent above. What is still open at the end of
a task, fewer than arity children for each level and end of a range, is dealt out again by common ancestors and goes on.
Proofs come from the reverse links: each parent row holds its children, and the steps of a path to the root are handed
down from parents to children, so that rows join only their own parent.

Defined results: null fields count as nulls, and a null group is a group of its own, before all others. Null ids come first
in their group. Rows with equal ids are leaves of their own, ordered by digest; rows that are equal in all fields change
places freely. An empty table has no rows and no root. Columns that aren't fields aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
LEVELS_A_ROUND = 3
NODE = "g string, level int, idx long, n long, digest string, children array<string>"
STEP = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """- for null, else the byte count and the value, so that no two rows give the same string."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, the place in the group g by order, and n, the group's size. Groups are split among tasks."""
    # Spark samples the ranges from rows, so these are a written table.
    placed = written(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id()))
    run = F.shiftright("at", 33).alias("run")
    runs = placed.groupBy("g", run).agg(F.min("at").alias("first"), F.count("*").alias("n_run"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n_run").over(group.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "run", (before - F.col("first")).alias("shift"), F.sum("n_run").over(group).alias("n"))
    return placed.withColumn("run", run).join(runs, ["g", "run"]).withColumn("idx", F.col("at") + F.col("shift")).drop("run", "at", "shift")


def _grow(arity: int):
    """Nodes in, parents out: those that are full, and the children of those that aren't (children: null)."""

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["g", "level", "idx", "n", "digest", "children"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple, dict[int, str]] = {}
        sizes: dict[str, int] = {}
        out: list[tuple] = []
        for batch in batches:
            for g, level, idx, n, digest in zip(*(batch.column(i).to_pylist() for i in range(5))):
                sizes[g] = n
                event = (level, idx, digest)
                while event:
                    level, idx, digest = event
                    event = None
                    wide = -(-n // arity**level)
                    if wide == 1:
                        if level == 0:
                            out.append((g, 0, 0, n, digest, None))
                        break
                    key = (g, level + 1, idx // arity)
                    held = partial.setdefault(key, {})
                    held[idx % arity] = digest
                    if len(held) == min(arity, wide - key[2] * arity):
                        children = [held[i] for i in range(len(held))]
                        del partial[key]
                        made = hashlib.sha256("".join(children).encode()).hexdigest()
                        out.append((g, level + 1, key[2], n, made, children))
                        event = (level + 1, key[2], made)
            if len(out) > 4096:
                yield rows(out)
                out = []
        for (g, level, parent), held in partial.items():
            out += [(g, level - 1, parent * arity + slot, sizes[g], digest, None) for slot, digest in held.items()]
        if out:
            yield rows(out)

    return run


def tree(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """NODE tables: all parents with their children, and lone leaves (level 0). nodes: g, idx, n, digest."""
    start = nodes.select("g", F.lit(0).alias("level"), "idx", "n", "digest")
    made = [written(start.mapInArrow(_grow(arity), NODE))]
    above = F.ceil(F.col("n") / F.pow(F.lit(arity), F.col("level")))
    while True:
        open_nodes = made[-1].filter("children is null").filter(above > 1)
        low = open_nodes.agg(F.min("level")).first()[0]
        if low is None:
            return [m.filter(F.col("children").isNotNull() | (above == 1)) for m in made]
        # All children of a common ancestor meet in one task: at most arity ** LEVELS_A_ROUND of them.
        up = F.greatest(F.lit(low + LEVELS_A_ROUND) - F.col("level"), F.lit(0))
        ancestor = F.floor(F.col("idx") / F.pow(F.lit(arity), up))
        made.append(written(open_nodes.repartition("g", F.col("level") + up, ancestor).drop("children").mapInArrow(_grow(arity), NODE)))


def _step(children: Column, slot: Column, arity: int) -> Column:
    """What stands to the left and to the right of a child, as a path of one step."""
    left = F.array_join(F.slice(children, F.lit(1), slot), "")
    return F.array(F.struct(left.alias("left"), F.array_join(F.slice(children, slot + 2, F.lit(arity)), "").alias("right")))


def with_paths(leaves: DataFrame, made: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """leaves with path, its steps from the leaf to the top, and tops' other columns. tops: a row for each g with path above it."""
    parents = made[0]
    for more in made[1:]:
        parents = parents.unionByName(more)
    parents = parents.filter("children is not null").select("g", "level", "idx", "n", "children")
    carried = [c for c in tops.columns if c not in ("g", "path")]
    deepest = parents.agg(F.max("level")).first()[0] or 0
    above = None
    for level in range(deepest, -1, -1):
        rows = leaves if level == 0 else parents.filter(F.col("level") == level)
        kept = [c for c in rows.columns if c != "level"]
        last = F.col("n") <= arity**level
        found = rows.filter(last).join(tops, "g").select(*kept, "path", *carried)
        if above is not None:
            up = above.select("g", F.col("idx").alias("parent"), F.col("children").alias("siblings"), F.col("path").alias("rest"), *carried)
            lower = rows.filter(~last).withColumn("parent", F.floor(F.col("idx") / arity)).join(up, ["g", "parent"])
            path = F.concat(_step(F.col("siblings"), (F.col("idx") % arity).cast("int"), arity), "rest").alias("path")
            found = found.unionByName(lower.select(*kept, path, *carried))
        above = found
    return above


def tops_of(made: list[DataFrame], arity: int = ARITY) -> DataFrame:
    """g, digest: the node at the top of each group's tree."""
    top = F.ceil(F.col("n") / F.pow(F.lit(arity), F.col("level"))) == 1
    found = made[0].filter(top)
    for more in made[1:]:
        found = found.unionByName(more.filter(top))
    return found.select("g", "digest")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", presented: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """A row for each row of docs: its id, leaf, the group's subroot, root, path (STEP), and presented, the leaf that the row
    has with the presented values in place of its own (the same leaf without any)."""
    now = {c: F.col(c) for c in fields} | (presented or {})
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))  # null before all strings
    leaf, other = row_digest([F.col(c) for c in fields]), row_digest([now[c] for c in fields])
    leaves = written(docs.select(F.col(id_col).alias("doc_id"), group.alias("g"), leaf.alias("digest"), (other if presented else leaf).alias("presented")))
    rows = ranked(leaves, ["doc_id", "digest"])
    made = tree(rows, arity)
    groups = written(ranked(tops_of(made, arity).select(F.lit("all").alias("g"), F.col("g").alias("own"), "digest"), ["own"]))
    over = tree(groups, arity)
    roots = tops_of(over, arity).take(1)
    start = groups.sparkSession.createDataFrame([("all",)], "g string").withColumn("path", F.array().cast(STEP))
    tops = written(with_paths(groups, over, start, arity).select(F.col("own").alias("g"), F.col("digest").alias("subroot"), "path"))
    found = with_paths(rows, made, tops, arity)
    root = F.lit(roots[0].digest if roots else None).cast("string")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", "presented")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest's digest columns with every fifth document's text lower-cased after the tree was built, and what the proofs say to it."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(chosen, F.translate("text", upper, lower)).otherwise(F.col("text"))
    found = manifest(docs, presented={"text": text})
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("presented"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
