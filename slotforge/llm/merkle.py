"""Merkle manifest of a table: stored leaves and every third level, the levels between worked out again when asked for."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotforge.llm.common import materialize
from slotforge.llm.order import numbered

#: Children of a node, and levels from one stored level to the next: an aligned subtree has ARITY**LEVELS nodes at its foot.
ARITY, LEVELS = 8, 3
SPAN = ARITY**LEVELS

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(columns: list[Column]) -> Column:
    """Lowercase hex sha256 of all values: ``-`` for null, else UTF-8 byte count, ``:``, value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _up(nodes: list[str]) -> list[str]:
    return [_sha("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]


def _height(n: int) -> int:
    """Levels above ``n`` nodes until one is left, but LEVELS at most."""
    h = 0
    while n > 1 and h < LEVELS:
        n, h = -(-n // ARITY), h + 1
    return h


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: a subtree's foot as Python objects takes several times its bytes."""
    return (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


def _grouped(nodes: DataFrame, *more: str) -> DataFrame:
    """A row for each aligned subtree, with the SPAN nodes at its foot, at most, in order."""
    foot = F.array_sort(F.collect_list(F.struct("at", "node", *more)))
    return nodes.withColumn("top", F.expr(f"at div {SPAN}")).groupBy("tree", "top").agg(F.max("n").alias("n"), foot.alias("foot"))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tops = []
        for r in _each(b):
            nodes = [x["node"] for x in r["foot"]]
            for _ in range(_height(r["n"])):
                nodes = _up(nodes)
            tops.append(nodes[0])
        above = [-(-n // ARITY ** _height(n)) for n in b.column("n").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("top"), pa.array(above, pa.int64()), pa.array(tops, pa.string())], names=["tree", "at", "n", "node"])


def _build(leaves: DataFrame, path: str) -> int:
    """Write ``path/1``, ``path/2``... until each tree has one node in one of them; how many there are."""
    spark, r = leaves.sparkSession, 0
    below = leaves.select("tree", "at", "n", "node")
    while True:
        r += 1
        _grouped(below).mapInArrow(_tops, "tree string, at long, n long, node string").write.parquet(f"{path}/{r}")
        below = _level(spark, path, r)
        most = below.agg(F.max("n")).first()[0]
        if most is None or most <= 1:
            return r
        below = below.where("n > 1")


def _level(spark: SparkSession, path: str, r: int) -> DataFrame:
    return spark.read.schema("tree string, at long, n long, node string").parquet(f"{path}/{r}")


def build(docs: DataFrame, path: str, tree_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS, received: dict[str, Column] | None = None) -> None:
    """Write the manifest of a table below ``path``: leaves, every third level of each tree, and the same of their roots.

    A row is a leaf (``row_digest`` of ``columns``); leaves of a tree (one for each value of ``tree_col``, null too)
    ascend by id, null first, ties by digest; every ARITY neighbours become a node while a tree has several. The trees'
    roots, ordered by name (null first, UTF-8 bytewise), become the manifest's root in the same way. ``received`` gives
    other expressions for some columns: the digest of the row as received is stored beside its leaf, to be checked.

    Trees of any size are spread over tasks; a task holds SPAN nodes of a subtree. An empty table has no leaves and no
    root. Other columns are ignored.
    """
    own = [docs[f"`{c}`"] for c in columns]
    changed = row_digest([received.get(c, x) for c, x in zip(columns, own, strict=True)]) if received else F.lit(None).cast("string")
    name = docs[f"`{tree_col}`"].cast("string")
    tree = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name))
    rows = docs.select(tree.alias("tree"), docs[f"`{id_col}`"].cast("long").alias("id"), row_digest(own).alias("node"), changed.alias("received"))
    rows.withColumn("received", F.when(F.col("received") != F.col("node"), F.col("received"))).write.parquet(f"{path}/rows")
    spark = docs.sparkSession
    rows = spark.read.schema("tree string, id long, node string, received string").parquet(f"{path}/rows")
    numbered(rows, "tree", ["id", "node"], "merkle-leaves").write.parquet(f"{path}/leaves")
    rounds = _build(_leaves(spark, path), f"{path}/levels")
    done = None
    for r in range(1, rounds + 1):
        roots = _level(spark, f"{path}/levels", r).where("n = 1").select("tree", "node", F.lit(r).alias("round"))
        done = roots if done is None else done.unionByName(roots)
    done.withColumnRenamed("tree", "name").withColumn("tree", F.lit("")).write.parquet(f"{path}/subroots")
    named = spark.read.schema("name string, node string, round int, tree string").parquet(f"{path}/subroots")
    numbered(named, "tree", ["name"], "merkle-roots").write.parquet(f"{path}/trees")
    _build(_trees(spark, path), f"{path}/roots")


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tree string, id long, node string, received string, at long, n long").parquet(f"{path}/leaves")


def _trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, node string, round int, tree string, at long, n long").parquet(f"{path}/trees")


def _rounds(spark: SparkSession, path: str) -> int:
    """Levels that ``_build`` has written: the first without several nodes of a tree is the last."""
    r = 1
    while (_level(spark, path, r).agg(F.max("n")).first()[0] or 0) > 1:
        r += 1
    return r


_PATH = "lefts array<string>, rights array<string>"


def _siblings(nodes: list[str], n: int) -> tuple[list[list[str]], list[list[str]]]:
    """The digests left and right of each node of a subtree, for each of its levels, from regenerated interior nodes."""
    lefts, rights = [], []
    for _ in range(_height(n)):
        left, right = [], []
        for i in range(len(nodes)):
            a = i - i % ARITY
            left.append("".join(nodes[a:i]))
            right.append("".join(nodes[i + 1 : a + ARITY]))
        lefts.append(left)
        rights.append(right)
        nodes = _up(nodes)
    return lefts, rights


def _chains(foot: list[dict], n: int, above: tuple[list[str], list[str]]) -> Iterator[tuple[dict, list[str], list[str]]]:
    """Each node at the foot of a subtree with its siblings up to the root; ``above``: those of the subtree's top."""
    lefts, rights = _siblings([x["node"] for x in foot], n)
    for i, x in enumerate(foot):
        left, right, k = [], [], i
        for a, b in zip(lefts, rights, strict=True):
            left.append(a[k])
            right.append(b[k])
            k //= ARITY
        yield x, left + above[0], right + above[1]


def _paths(nodes: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """tree, at, path and ``carried`` for each node; ``above`` has them for the subtrees' tops."""
    joined = _grouped(nodes).join(above.withColumnRenamed("at", "top").hint("shuffle_hash"), ["tree", "top"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _each(b):
                rows = [(r["tree"], x["at"], left, right, *(r[c] for c in carried)) for x, left, right in _chains(r["foot"], r["n"], (r["lefts"], r["rights"]))]
                yield pa.RecordBatch.from_pydict(dict(zip(["tree", "at", "lefts", "rights", *carried], map(list, zip(*rows, strict=True)), strict=True)))

    return joined.select("tree", "n", "foot", "lefts", "rights", *carried).mapInArrow(work, f"tree string, at long, {_PATH}" + "".join(f", {c} string" for c in carried))


def _fold(node: str, left: list[str], right: list[str]) -> str:
    for a, b in zip(left, right, strict=True):
        node = _sha(a + node + b)
    return node


def _down(spark: SparkSession, path: str, above: dict[int, DataFrame], carried: list[str]) -> DataFrame:
    """Paths of the nodes of the first stored level; ``above``: paths of the trees that end in each round."""
    now = None
    for r in sorted(above, reverse=True):
        upper = _paths(_level(spark, path, r).where("n > 1"), now, carried) if now is not None else None
        now = above[r] if upper is None else above[r].unionByName(upper)
    return now


def proofs(spark: SparkSession, path: str, id_col: str = "doc_id", siblings: bool = False) -> DataFrame:
    """For each leaf of a manifest: id, leaf, subroot, root, proof_sha256, folded_root, verified; with ``siblings`` also the
    digests left and right of the path for each level.

    From the top down, each aligned subtree works out the nodes between two stored levels from those at its foot, hands
    every one of these its siblings and forgets the interior. The received digest, where it differs, else the leaf is folded
    with the stored siblings; ``verified`` says if that gives the root.
    """
    top = spark.createDataFrame([("", 0, [], [])], f"tree string, at long, {_PATH}")
    last = _rounds(spark, f"{path}/roots")
    roots = _down(spark, f"{path}/roots", {r: top if r == last else top.limit(0) for r in range(1, last + 1)}, [])
    trees = _paths(_trees(spark, path), roots, []).join(_trees(spark, path).select("at", "name", F.col("node").alias("subroot"), "round"), "at")
    fold = F.aggregate(F.arrays_zip("lefts", "rights"), F.col("subroot"), lambda s, x: F.sha2(F.concat(x["lefts"], s, x["rights"]), 256))
    trees = trees.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "lefts", "rights", "subroot", fold.alias("root"), "round")
    trees = materialize(trees, "merkle-paths")
    carried = ["subroot", "root"]
    above = {r: trees.where(F.col("round") == r).drop("round") for r in range(1, _rounds(spark, f"{path}/levels") + 1)}
    paths = _down(spark, f"{path}/levels", above, carried)
    joined = _grouped(_leaves(spark, path), "id", "received").join(paths.withColumnRenamed("at", "top").hint("shuffle_hash"), ["tree", "top"])
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", *(["lefts", "rights"] if siblings else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _each(b):
                rows = []
                for x, left, right in _chains(r["foot"], r["n"], (r["lefts"], r["rights"])):
                    proof = _sha("".join(a + c for a, c in zip(left, right, strict=True)))
                    rows.append((x["id"], x["node"], r["subroot"], r["root"], proof, _fold(x["received"] or x["node"], left, right), left, right)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string() if k < 6 else pa.list_(pa.string())) for k, c in enumerate(zip(*rows, strict=True))], names=names)

    kind = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (f", {_PATH}" if siblings else "")
    found = joined.select("tree", "n", "foot", "lefts", "rights", *carried).mapInArrow(work, kind)
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)
