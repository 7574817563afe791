"""A Merkle manifest of a dataset, and the versions of it that changed documents make.

Leaves are digests of rows. The leaves of a group (a source) form a tree of ``FAN`` children per node, and the groups'
subroots form one above them. A tree is cut into aligned blocks of ``FAN ** BLOCK_LEVELS`` nodes of one level. A task
has one block as a persistent tree: a changed leaf makes a version of it that shares every node but its ancestors,
which are copied. The block's node goes on as one row of the block above, so higher levels are small distributed
tables. Downwards every block is told the untouched nodes beside its own ancestors, at most ``FAN - 1`` per level: with
these a version goes on copying ancestors above the block, up to its own root, wherever the block is.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm.texts import field_type, schema, written
from scholium.plans import number_rows

FAN = 16
BLOCK_LEVELS = 2
BLOCK = FAN**BLOCK_LEVELS
HEX = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUTPUTS = {"proof": T.ArrayType(T.StringType()), "copied": T.ArrayType(T.StringType()), "proof_sha256": "string", "folded_root": "string"}


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(count: int) -> int:
    """Levels between so many nodes and their root: none above a single one."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FAN), levels + 1
    return levels


class PathTree:
    """The nodes of an aligned block, level by level, which versions share and never change."""

    def __init__(self, nodes: list[str], height: int):
        self.levels = [nodes]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def run(self, level: int, place: int) -> tuple[list[str], int]:
        """The nodes that are hashed together with this one, and which of them it is."""
        start = place // FAN * FAN
        return self.levels[level][start : start + FAN], place - start

    def beside(self, place: int) -> list[tuple[int, str]]:
        """Per level: the place in its run of the node's ancestor, and the other nodes of the run."""
        path = []
        for level in range(len(self.levels) - 1):
            run, at = self.run(level, place)
            path.append((at, "".join(run[:at] + run[at + 1 :])))
            place //= FAN
        return path

    def version(self, place: int, node: str) -> Version:
        """The tree with another node at ``place`` of the lowest level."""
        copied = []
        at = place
        for level in range(len(self.levels) - 1):
            run, own = self.run(level, at)
            run[own] = node
            node = digest(run)
            copied.append(node)
            at //= FAN
        return Version(self, place, copied)


class Version:
    """The ancestors of one changed leaf; all other nodes are those of the tree it was made from."""

    def __init__(self, base: PathTree, place: int, copied: list[str]):
        self.base, self.place, self.copied = base, place, copied

    def node(self, level: int, place: int) -> str:
        """A node above the leaves."""
        own = place == self.place // FAN**level
        return self.copied[level - 1] if own else self.base.levels[level][place]

    def continued(self, node: str, above: Sequence[tuple[int, str]]) -> list[str]:
        """All ancestors of the leaf (``node`` if its block copied none), those above the block included."""
        copied = list(self.copied)
        node = copied[-1] if copied else node
        for at, others in above:
            node = digest((others[: at * HEX], node, others[at * HEX :]))
            copied.append(node)
        return copied


def leaf_digest(values: Mapping[str, Column]) -> Column:
    """Digest of the values, each ``-`` if null, else its bytes' number, a colon and itself as text."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return F.sha2(F.concat(*parts), 256)


def _blocked(nodes: DataFrame):
    return nodes.withColumn("_block", F.floor(F.col("_at") / BLOCK)).groupBy("_tree", "_block")


def _ascend(nodes: DataFrame) -> DataFrame:
    """The nodes that stand for the blocks of ``nodes`` (_tree, _at, _count: nodes of the tree on this level, _node)."""
    out = schema(("_tree", "string"), ("_at", "long"), ("_count", "long"), ("_node", "string"))

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        count = table.column("_count")[0].as_py()
        height = min(levels_above(count), BLOCK_LEVELS)
        root = PathTree(table.column("_node").to_pylist(), height).root
        values = [table.column("_tree")[0].as_py(), table.column("_at")[0].as_py() // BLOCK, -(-count // FAN**height), root]
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=out.names)

    return written(_blocked(nodes.select("_tree", "_at", "_count", "_node")).applyInArrow(up, out), "nodes")


def _forest(leaves: DataFrame) -> list[DataFrame]:
    """``leaves`` and the nodes above them, block by block, until every tree has one."""
    most = leaves.agg(F.max("_count")).first()[0] or 1
    steps = [leaves]
    for _ in range(-(-levels_above(most) // BLOCK_LEVELS)):
        steps.append(_ascend(steps[-1]))
    return steps


_ABOVE = (
    ("_tree", "string"), ("_at", "long"), ("_places", T.ArrayType(T.IntegerType())), ("_others", T.ArrayType(T.StringType())),
    ("_subroot", "string"), ("_root", "string"),
)
_ABOVE_TYPES = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string()]


def _lowered(block: pa.Table, above: pa.Table) -> tuple[pa.Table, PathTree, list[tuple[int, str]]]:
    """A block in order, its tree, and what stands beside its ancestors."""
    block = block.sort_by("_at")
    height = min(levels_above(block.column("_count")[0].as_py()), BLOCK_LEVELS)
    places, others = above.column("_places")[0].as_py(), above.column("_others")[0].as_py()
    return block, PathTree(block.column("_node").to_pylist(), height), list(zip(places, others))


def _descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """For every node what stands beside it and its ancestors, from the same of the blocks."""

    def down(block: pa.Table, told: pa.Table) -> pa.Table:
        block, tree, beyond = _lowered(block, told)
        paths = [tree.beside(place) + beyond for place in range(block.num_rows)]
        columns = [
            block.column("_tree"), block.column("_at"), [[p for p, _ in path] for path in paths], [[o for _, o in path] for path in paths],
            told.column("_subroot").to_pylist() * block.num_rows, told.column("_root").to_pylist() * block.num_rows,
        ]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, _ABOVE_TYPES)], names=[n for n, _ in _ABOVE])

    told = above.withColumnRenamed("_at", "_block").groupBy("_tree", "_block")
    return _blocked(nodes.select("_tree", "_at", "_count", "_node")).cogroup(told).applyInArrow(down, schema(*_ABOVE))


def _spread_down(steps: list[DataFrame], top: DataFrame) -> DataFrame:
    """What stands beside the blocks of the leaves, from what stands beside the roots of the trees."""
    for nodes in reversed(steps[1:-1]):
        top = written(_descend(nodes, top), "above")
    return top


def merkle_manifest(
    docs: DataFrame,
    changes: Mapping[str, Column] | None = None,
    changed: Column | None = None,
    id_column: str = "doc_id",
    group_column: str = "source",
    fields: Sequence[str] = FIELDS,
    outputs: Sequence[str] = ("proof", "copied"),
) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot``, ``root``, the ``outputs`` asked for, and ``verified``.

    The leaf is the digest of the row's ``fields``. Leaves of a group ascend by id (null first, equal ids by their leaf, so repeated
    rows have equal neighbours whatever order they came in); groups ascend by the bytes of their name, null first. Rows
    where ``changed`` holds are changed as ``changes`` says (new value per field) after the manifest was made, each on
    its own. Outputs: ``proof`` has per level the untouched nodes hashed together with the leaf's ancestor, joined;
    ``copied`` has the ancestors of the leaf in its version, the last being the version's root (none where the leaf is
    the root); ``proof_sha256`` is the digest of the joined proof and ``folded_root`` the version's root. ``verified`` says whether that is ``root``. Null
    fields and empty or very long texts have digests like any other. An empty table gives no rows; other columns are
    not read.
    """
    values = {name: F.col(name) for name in fields}
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group_column).cast("string")), F.lit(""))
    other = leaf_digest(values | dict(changes or {}))
    rows = docs.select(
        F.col(id_column).alias("_id"),
        tree.alias("_tree"),
        leaf_digest(values).alias("_node"),
        F.when(F.lit(False) if changed is None else changed, other).alias("_other"),
    )
    rows = written(rows, "leaves")
    placed = number_rows(rows, [F.col("_id").asc_nulls_first(), F.col("_node")], ["_tree"], "_at", "_count", always_slices=True)
    steps = _forest(written(placed.withColumn("_at", F.col("_at") - 1), "placed"))
    subroots = steps[-1].select(F.col("_tree").alias("_name"), "_node") if len(steps) > 1 else steps[0].select(F.col("_tree").alias("_name"), "_node")
    numbered = number_rows(subroots, [F.col("_name")], position="_at", size="_count")
    groups = written(numbered.select(F.lit("").alias("_tree"), (F.col("_at") - 1).alias("_at"), "_count", "_node", "_name"), "groups")
    upper = _forest(groups)
    none = F.array().cast("array<int>").alias("_places"), F.array().cast("array<string>").alias("_others")
    top = upper[-1].select("_tree", "_at", *none, F.lit(None).cast("string").alias("_subroot"), F.col("_node").alias("_root"))
    of_groups = top
    if len(upper) > 1:
        of_groups = _descend(groups, _spread_down(upper, top))
    of_trees = of_groups.drop("_tree", "_subroot").join(groups.select("_at", "_name", F.col("_node").alias("_subroot")), "_at")
    of_trees = written(of_trees.select(F.col("_name").alias("_tree"), F.lit(0).cast("bigint").alias("_at"), "_places", "_others", "_subroot", "_root"), "above")
    above = _spread_down(steps, of_trees)
    names = [name for name in outputs]
    out = schema(
        (id_column, field_type(rows, "_id")), ("leaf", "string"), ("subroot", "string"), ("root", "string"), *[(n, OUTPUTS[n]) for n in names], ("verified", "boolean")
    )

    def finish(block: pa.Table, told: pa.Table) -> pa.Table:
        block, tree, beyond = _lowered(block, told)
        subroot, root = told.column("_subroot")[0].as_py(), told.column("_root")[0].as_py()
        joined = "".join(others for _, others in beyond).encode()
        made: dict[str, list] = {name: [] for name in (*OUTPUTS, "verified")}
        for place, (leaf, other_leaf) in enumerate(zip(tree.levels[0], block.column("_other").to_pylist())):
            leaf = leaf if other_leaf is None else other_leaf
            copied = tree.version(place, leaf).continued(leaf, beyond)
            folded = copied[-1] if copied else leaf
            path = [others for _, others in tree.beside(place)]
            made["copied"].append(copied)
            made["folded_root"].append(folded)
            made["verified"].append(folded == root)
            if "proof" in names:
                made["proof"].append(path + [others for _, others in beyond])
            proof = hashlib.sha256("".join(path).encode())
            proof.update(joined)
            made["proof_sha256"].append(proof.hexdigest())
        same = [pa.array([value] * block.num_rows, pa.string()) for value in (subroot, root)]
        kinds = {"proof": pa.list_(pa.string()), "copied": pa.list_(pa.string())}
        columns = [pa.array(made[n], kinds.get(n, pa.string())) for n in names]
        return pa.table([block.column("_id"), block.column("_node"), *same, *columns, pa.array(made["verified"], pa.bool_())], names=out.names)

    told = above.withColumnRenamed("_at", "_block").groupBy("_tree", "_block")
    return _blocked(steps[0].select("_tree", "_at", "_count", "_id", "_node", "_other")).cogroup(told).applyInArrow(finish, out)


def lowercased(column: str) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters: each is added, then eight bits are shifted out."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT{', -1' * 8}]))"
    step = "CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda x, y: {step}), 4294967295)"


def merkle_sql(table: str, every: int, levels: int = 8) -> str:
    """DuckDB SQL for the digests of ``merkle_manifest`` over ``FIELDS``, with the texts of ids whose CRC-32 ``every``
    divides lower-cased; for at most ``FAN ** levels`` leaves of a group and as many groups."""
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

    def leaf(text: str) -> str:
        cells = [text if f == "text" else f for f in FIELDS]
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in cells) + ")"

    def climb(name: str, first: str) -> list[str]:
        """Tables of nodes by level, and of what stands before and behind each in its run."""
        tables = [f"{name}0 AS MATERIALIZED ({first})"]
        for k in range(levels):
            tables.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // {FAN} AS i, (any_value(n) + {FAN - 1}) // {FAN} AS n, "
                f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h "
                f"FROM {name}{k} GROUP BY tree, i // {FAN})"
            )
            window = f"PARTITION BY tree, i // {FAN} ORDER BY i ROWS BETWEEN"
            tables.append(
                f"{name}{k}_beside AS MATERIALIZED (SELECT tree, i, n, "
                f"coalesce(string_agg(h, '') OVER ({window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(h, '') OVER ({window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
        return tables

    def fold(source: str, name: str, tree: str, place: str) -> list[str]:
        """The leaves' versions and proofs, one level higher with each table."""
        tables = []
        for k in range(levels):
            into = f"{name}_fold{k + 1}"
            tables.append(
                f"{into} AS (SELECT f.* REPLACE (CASE WHEN b.n > 1 THEN sha256(b.l || f.folded || b.r) ELSE f.folded END AS folded, "
                f"CASE WHEN b.n > 1 THEN f.proof || b.l || b.r ELSE f.proof END AS proof) "
                f"FROM {source} f JOIN {name}{k}_beside b ON b.tree = {tree} AND b.i = f.{place} // {FAN**k})"
            )
            source = into
        return tables

    rows = f"""rows AS MATERIALIZED (
        SELECT doc_id, coalesce('+' || source, '') AS tree, {leaf("text")} AS leaf,
            CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % {every} = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS other
        FROM {table}
    ), leaves AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
        FROM rows
    )"""
    tables = [
        rows,
        *climb("nodes", "SELECT tree, i, n, leaf AS h FROM leaves"),
        f"groups AS MATERIALIZED (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS g, count(*) OVER () AS n FROM nodes{levels})",
        *climb("tops", "SELECT '' AS tree, g AS i, n, subroot AS h FROM groups"),
        "start AS (SELECT l.*, subroot, g, other AS folded, '' AS proof FROM leaves l JOIN groups ON name = tree)",
        *fold("start", "nodes", "f.tree", "i"),
        *fold(f"nodes_fold{levels}", "tops", "''", "g"),
    ]
    return f"""
    WITH {", ".join(tables)}
    SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
    FROM tops_fold{levels}, (SELECT h FROM tops{levels})
    """
