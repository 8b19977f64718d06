"""Merkle manifest of a table: a hash tree per group, one root over the groups' roots, a proof per row.

Slot pivot: a parent's children are the rows of one (group, index div fanout); conditional aggregates spread them
into ``fanout`` columns. All columns joined are the input of the parent's hash; all but a child's own column are
its siblings. Parents carry their path to the root, so a proof meets only the tables of parents (one row for
``fanout`` leaves), never a column of long strings by row.

Defined results: a null field is ``-``; a null group comes first, as a group of its own; a null id comes first in
its group. Rows of equal id are ordered by their leaf, so repeated rows are leaves side by side and equal rows give
equal digests whatever the order. A group of one row has its leaf as subroot, one group has its subroot as root; an
empty table gives no rows. Texts of any length are hashed whole in their row. Of other columns, whatever their
names, nothing is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, written

FANOUT = 16
_PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts in UTF-8, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: of each field ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _slots(fanout: int, name: str) -> list[str]:
    return [f"{name}{k}" for k in range(fanout)]


def _pivot(nodes: DataFrame, fanout: int, values: list[str]) -> DataFrame:
    """Parents of all nodes of groups with several: ``g, idx, m`` (the group's parents) and a column by value and slot."""
    spread = [
        F.expr(f"max(CASE WHEN idx % {fanout} = {k} THEN {v} END) AS {name}")
        for v in values for k, name in enumerate(_slots(fanout, v))
    ]
    return nodes.filter("m > 1").groupBy("g", F.expr(f"idx div {fanout}").alias("idx")).agg(
        F.expr(f"(max(m) + {fanout - 1}) div {fanout}").alias("m"), *spread
    )


def _others(fanout: int, k: int) -> str:
    """The siblings of slot ``k`` as the text on its left and on its right."""
    names = _slots(fanout, "h")
    left, right = (", ".join(["''", *side]) for side in (names[:k], names[k + 1 :]))
    return f"named_struct('left', concat_ws({left}), 'right', concat_ws({right}))"


@dataclass
class Tree:
    """Parents by level, the lowest first, and the roots: ``g, level, h`` (the level at which one node remained)."""

    leaves: DataFrame
    values: list[str]
    levels: list[DataFrame]
    roots: DataFrame
    fanout: int

    def _children(self, k: int, paths: DataFrame, values: list[str], carried: list[str]) -> DataFrame:
        """Children of the parents of level ``k``, with their values, their path and what the parent's path carries."""
        kids = ", ".join(
            f"named_struct('idx', idx * {self.fanout} + {slot}, "
            + "".join(f"'{v}', {v}{slot}, " for v in values)
            + f"'path', concat(array({_others(self.fanout, slot)}), path))"
            for slot in range(self.fanout)
        )
        parents = self.levels[k].join(paths, ["g", "idx"])
        return parents.select("g", *carried, F.expr(f"inline(array({kids}))")).filter("h is not null")

    def paths(self, tops: DataFrame) -> DataFrame:
        """All leaves with their siblings from the bottom up, then the ``path`` and the other columns of ``tops`` (by g)."""
        carried = [c for c in tops.columns if c not in ("g", "path")]
        ends = self.roots.select("g", "level").join(tops, "g").select("g", *carried, F.lit(0).cast("long").alias("idx"), "path", "level")
        alone = self.leaves.filter("m = 1").join(tops, "g").select("g", *carried, *self.values, "path")
        if not self.levels:
            return alone
        paths = ends.filter(F.col("level") == len(self.levels)).drop("level")
        for k in range(len(self.levels) - 1, 0, -1):
            paths = self._children(k, paths, ["h"], carried).drop("h").unionByName(ends.filter(F.col("level") == k).drop("level"))
        return self._children(0, paths, self.values, carried).drop("idx").unionByName(alone)


def _tree(nodes: DataFrame, fanout: int, values: list[str]) -> Tree:
    """``nodes``: g, idx, m and the columns ``values``, of which ``h`` is the digest."""
    leaves, most = nodes, nodes.agg(F.max("m")).first()[0] or 0
    levels, roots, k = [], [], 0
    while True:
        roots.append(nodes.filter("m = 1").select("g", F.lit(k).alias("level"), "h"))
        if most <= 1:
            break
        parents = written(_pivot(nodes, fanout, values if k == 0 else ["h"]))
        levels.append(parents)
        nodes = parents.select("g", "idx", "m", F.sha2(F.concat_ws("", *_slots(fanout, "h")), 256).alias("h"))
        most, k = -(-most // fanout), k + 1
    all_roots = roots[0]
    for more in roots[1:]:
        all_roots = all_roots.unionByName(more)
    return Tree(leaves, values, levels, written(all_roots), fanout)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a proof in one text, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def manifest(
    rows: DataFrame, fields: list[str], id_col: str, group_col: str, now: dict[str, Column] | None = None,
    fanout: int = FANOUT, with_path: bool = False,
) -> DataFrame:
    """Digests and proof of every row: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``now`` names fields whose present value differs from the one that was hashed: ``folded_root`` is what the
    present row and the original siblings lead to, and ``verified`` whether that is the root. ``with_path`` adds
    the siblings themselves, ``path``, from the leaf up.
    """
    held = [F.col(c) for c in fields]
    present = [(now or {}).get(c, F.col(c)) for c in fields]
    group = F.col(group_col).cast("string")
    leaves = written(rows.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"), F.col(id_col).alias("id"),
        leaf(held).alias("h"), leaf(present).alias("now"),
    ))  # a null group sorts before any other
    tree = _tree(numbered(leaves, "g", ["id", "h", "now"]), fanout, ["h", "id", "now"])
    groups = tree.roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "h")
    top = _tree(numbered(groups, "g", ["of"]), fanout, ["h", "of"])
    root = top.roots.select("g", F.array().cast(_PATH).alias("path"), F.col("h").alias("root"))  # one row
    tops = written(top.paths(F.broadcast(root)).select(F.col("of").alias("g"), "path", F.col("h").alias("subroot"), "root"))
    path = F.col("path")
    out = tree.paths(tops).select(
        F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root",
        F.sha2(siblings(path), 256).alias("proof_sha256"), fold(F.col("now"), path).alias("folded_root"),
        *([path] if with_path else []),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
