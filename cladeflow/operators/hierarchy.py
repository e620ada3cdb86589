"""Parent links to full hierarchies: root, depth, path, descendants and faults of every node.

Splitters are chosen by a hash of the node's key. Every node walks to the next
splitter (or to a node without a parent row) by pointer jumping, keeping the
segment of ids it passes; the graph reduced to splitters is solved by pointer
jumping on (pointer, distance) alone; segments are expanded only where exact
paths or cycle members are wanted. Cycles without any splitter are found apart.
Rounds grow with the logarithm of the depth, and no tree is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cladeflow.session import Scratch

SPLIT_EVERY = 8
KEY = ["tree", "node_id"]


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """(tree, node_id, parent_id) once per node.

    Repeated rows fall together. Of rows that disagree on the parent the one
    with the latest ``written_at`` counts if there is such a column, the
    greatest parent breaking ties. Rows without tree or node_id name no node.
    """
    order = [F.col("written_at")] if "written_at" in rows.columns else []
    by = F.struct(*order, F.col("parent_id").isNotNull(), F.col("parent_id"))
    return (
        rows.where("tree IS NOT NULL AND node_id IS NOT NULL")
        .groupBy(*KEY)
        .agg(F.max_by(F.struct("parent_id"), by).getField("parent_id").alias("parent_id"))
    )


def _splits(tree: Column, node: Column, every: int) -> Column:
    return F.pmod(F.xxhash64(tree, node, F.lit(97)), F.lit(every)) == 0


def _image(active: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes on cycles, of (tree, node_id, ptr) rows that all lead into one.

    The images of ever more steps shrink to exactly the cycles' nodes; when
    doubling the steps doesn't shrink the image, it is those.
    """
    size, kept = -1, None
    while True:
        image = active.select("tree", F.col("ptr").alias("node_id")).distinct()
        now = image.count()
        if now == size:
            return image
        size = now
        ahead = active.select("tree", F.col("node_id").alias("ptr"), F.col("ptr").alias("ptr2"))
        jumped = active.join(ahead, ["tree", "ptr"]).select("tree", "node_id", F.col("ptr2").alias("ptr"))
        active = scratch.keep(jumped)
        if kept is not None:
            scratch.drop(kept)
        kept = active


class _Parts:
    """Rows of many rounds: those done stay where they were written, only the open ones are written anew."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.done_paths, self.open_path, self.n_open, self.schema = scratch, [], None, 0, None

    def add(self, rows: DataFrame) -> None:
        """Takes the rows (with a column ``done``) of a round, in one job; they replace all open ones."""
        seen = Observation()
        path = f"{self.scratch.root}/parts-{self.scratch.count}"
        self.scratch.count += 1
        watched = rows.observe(seen, F.count_if("done").alias("n_done"), F.count_if(~F.col("done")).alias("n_open"))
        watched.write.partitionBy("done").parquet(path)
        if self.open_path:
            self.scratch.remove(self.open_path)
        self.schema = StructType([f for f in rows.schema.fields if f.name != "done"])
        self.n_open = seen.get["n_open"]
        self.open_path = f"{path}/done=false" if self.n_open else None
        if seen.get["n_done"]:
            self.done_paths.append(f"{path}/done=true")

    def _read(self, paths: list[str]) -> DataFrame:
        spark = self.scratch.spark
        return self.scratch.read(self.schema, *paths) if paths else spark.createDataFrame([], self.schema)

    def done(self) -> DataFrame:
        return self._read(self.done_paths)

    def open(self) -> DataFrame:
        return self._read([self.open_path] if self.open_path else [])

    def every(self) -> DataFrame:
        return self.done().withColumn("done", F.lit(True)).unionByName(self.open().withColumn("done", F.lit(False)))

    def jump(self) -> None:
        """Pointer jumping until all rows are done, or none became so in a round.

        Distances along a way are contiguous: who hasn't arrived by then never will.
        """
        carried = [f.name for f in self.schema.fields if f.name not in ("tree", "node_id")]
        while self.n_open:
            before = self.n_open
            ahead = self.every().select("tree", F.col("node_id").alias("ptr"), *[F.col(c).alias(f"{c}_2") for c in [*carried, "done"]])
            grown = {"ptr": F.col("ptr_2"), "fate": F.col("fate_2")} | {c: F.col(c) + F.col(f"{c}_2") for c in carried if c == "steps" or c.startswith("sum_")}
            if "seg" in carried:
                grown["seg"] = F.concat("seg", "seg_2")
            self.add(self.open().join(ahead, ["tree", "ptr"]).select(*KEY, *[grown[c].alias(c) for c in carried], F.col("done_2").alias("done")))
            if self.n_open == before:
                return


class _Solved:
    """What is known of all nodes.

    ``walked`` has (tree, node_id, ptr, steps, fate[, seg]) of each node that
    reaches a stop, with a fate if that is an end; ends point at themselves.
    ``reduced`` has the same of splitters that reach an end, ``unsolved`` of
    those that don't; ``looped`` are nodes whose way meets no stop.
    """

    def __init__(self, walked, reduced, unsolved, looped, cycle_nodes, scratch):
        self.walked, self.reduced, self.unsolved, self.looped, self.cycle_nodes, self.scratch = walked, reduced, unsolved, looped, cycle_nodes, scratch


def _walk(nodes: DataFrame, every: int, scratch: Scratch, segments: bool) -> _Parts:
    """Ways of (tree, node_id, parent_id, fate, sum_…) rows to the next stop; rows with a fate are ends, sums are added up on the way."""
    inner = F.col("fate").isNull()
    sums = [F.when(inner, F.col(c)).otherwise(F.lit(0)).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns if c.startswith("sum_")]
    seg = [F.when(inner, F.array("parent_id")).otherwise(F.array().cast("array<bigint>")).alias("seg")] if segments else []
    parts = _Parts(scratch)
    parts.add(
        nodes.select(
            *KEY,
            F.when(inner, F.col("parent_id")).otherwise(F.col("node_id")).alias("ptr"),
            F.when(inner, 1).otherwise(0).cast("bigint").alias("steps"),
            "fate",
            *seg,
            *sums,
            (~inner | _splits(F.col("tree"), F.col("parent_id"), every)).alias("done"),
        )
    )
    parts.jump()
    return parts


def _solve(rows: DataFrame, every: int, segments: bool = False, edges: DataFrame | None = None) -> _Solved:
    scratch = Scratch(rows.sparkSession, "hierarchy")
    base = distinct_nodes(rows)
    sums = [c for c in edges.columns if c.startswith("sum_")] if edges is not None else []
    base = scratch.keep(base if edges is None else base.join(edges.select(*KEY, *sums), KEY))
    ids = base.select("tree", F.col("node_id").alias("parent_id"), F.lit(True).alias("found"))
    fate = F.when(F.col("parent_id").isNull(), "root").when(F.col("found").isNull(), "lost")
    walk = _walk(base.join(ids, ["tree", "parent_id"], "left").select(*KEY, "parent_id", fate.alias("fate"), *sums), every, scratch, segments)
    walked = walk.done()
    looped = walk.open().select(*KEY, "ptr")
    none = rows.sparkSession.createDataFrame([], base.select(*KEY).schema)
    cycle_nodes = _image(looped, scratch) if walk.n_open else none

    # The graph of splitters alone; one that walks into a cycle without splitters is an end as well.
    split = _splits(F.col("tree"), F.col("node_id"), every)
    own = walked.where(split).select(*KEY, "ptr", "steps", "fate", *sums)
    if walk.n_open:
        own = own.unionByName(looped.where(split).select(*KEY, "ptr", F.lit(0).cast("bigint").alias("steps"), F.lit("below_cycle").alias("fate"), *[F.lit(0).cast(base.schema[c].dataType).alias(c) for c in sums]))
        looped = looped.where(~split)
    graph = _Parts(scratch)
    graph.add(own.withColumn("done", F.col("fate").isNotNull()))
    graph.jump()
    if graph.n_open:
        on = scratch.keep(_image(graph.open().select(*KEY, "ptr"), scratch))
        # Ways between the splitters of cycles, with all their nodes.
        near = walked.join(on.select("tree", F.col("node_id").alias("ptr")), ["tree", "ptr"], "left_semi").select(*KEY)
        between = _walk(base.join(near, KEY, "left_semi").select(*KEY, "parent_id").withColumn("fate", F.lit(None).cast("string")), every, scratch, True)
        members = between.done().join(on, KEY, "left_semi").select("tree", F.explode("seg").alias("node_id"))
        cycle_nodes = cycle_nodes.unionByName(members).distinct()
    return _Solved(walked, graph.done(), graph.open(), looped, cycle_nodes, scratch)


def hierarchy_status(rows: DataFrame, every: int = SPLIT_EVERY) -> DataFrame:
    """(tree, node_id, fate, root_id, depth) of each node once.

    ``fate`` is ``rooted``, ``cycle`` (following the parents leads back to the
    node, its own parent included), ``below_cycle`` or ``lost`` (the way ends at
    a parent without a row in the tree). ``root_id`` and ``depth`` (0 for a
    root) are null unless rooted. Empty input gives an empty result; columns
    beyond tree, node_id, parent_id and written_at are ignored.
    """
    s = _solve(rows, every)
    split = _splits(F.col("tree"), F.col("node_id"), every)
    columns = [*KEY, F.col("ptr").alias("end_id"), F.col("steps").alias("depth"), "fate"]
    via = s.reduced.unionByName(s.unsolved).select("tree", F.col("node_id").alias("ptr"), F.col("ptr").alias("end_id"), F.col("steps").alias("rest"), "fate")
    others = s.walked.where(~split & F.col("fate").isNull()).drop("fate").join(via, ["tree", "ptr"]).select(*KEY, "end_id", (F.col("steps") + F.col("rest")).alias("depth"), "fate")
    lost = s.looped.select(*KEY, F.col("ptr").alias("end_id"), F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("fate"))
    everyone = (
        s.walked.where(~split & F.col("fate").isNotNull()).select(*columns)
        .unionByName(s.reduced.unionByName(s.unsolved).select(*columns))
        .unionByName(others)
        .unionByName(lost)
    )
    marked = everyone.join(s.cycle_nodes.withColumn("on_cycle", F.lit(True)), KEY, "left")
    rooted = F.col("fate") == "root"
    return marked.select(
        *KEY,
        F.when(rooted, "rooted")
        .when(F.col("fate") == "lost", "lost")
        .when(F.col("on_cycle"), "cycle")
        .otherwise("below_cycle")
        .alias("fate"),
        F.when(rooted, F.col("end_id")).alias("root_id"),
        F.when(rooted, F.col("depth")).alias("depth"),
    )


def hierarchy_sums(rows: DataFrame, edges: DataFrame, every: int = SPLIT_EVERY) -> DataFrame:
    """(tree, node_id, root_id, depth, …) of each rooted node once, with the sums of the ``sum_`` columns of ``edges`` from the root down to it.

    ``edges`` has one row per node, for the edge above it; a root's own doesn't
    count. The sums are added while pointers jump, so no path is unfolded.
    """
    s = _solve(rows, every, edges=edges)
    sums = [c for c in edges.columns if c.startswith("sum_")]
    split = _splits(F.col("tree"), F.col("node_id"), every)
    named = [*KEY, F.col("ptr").alias("root_id"), F.col("steps").alias("depth"), *sums]
    ends = s.reduced.where("fate = 'root'")
    direct = s.walked.where(~split & (F.col("fate") == "root")).select(*named)
    via = ends.select("tree", F.col("node_id").alias("ptr"), F.col("ptr").alias("root_id"), *[F.col(c).alias(f"{c}_2") for c in ("steps", *sums)])
    added = [(F.col("steps") + F.col("steps_2")).alias("depth"), *[(F.col(c) + F.col(f"{c}_2")).alias(c) for c in sums]]
    others = s.walked.where(~split & F.col("fate").isNull()).join(via, ["tree", "ptr"]).select(*KEY, "root_id", *added)
    return direct.unionByName(ends.select(*named)).unionByName(others)


def hierarchy_faults(rows: DataFrame, every: int = SPLIT_EVERY) -> DataFrame:
    """(tree, node_id, fault) of the nodes that reach no root."""
    return hierarchy_status(rows, every).where("fate != 'rooted'").select(*KEY, F.col("fate").alias("fault"))


def hierarchy_paths(rows: DataFrame, every: int = SPLIT_EVERY) -> DataFrame:
    """(tree, node_id, root_id, depth, path) of each rooted node; ``path`` lists ids from the root to the node.

    Paths of the splitters are joined end to end by doubling; every other node
    puts its own segment before the path of its next splitter.
    """
    s = _solve(rows, every, segments=True)
    split = _splits(F.col("tree"), F.col("node_id"), every)
    rooted = s.reduced.where("fate = 'root'").select(*KEY)
    graph = _Parts(s.scratch)
    own = s.walked.where(split).join(rooted, KEY, "left_semi")
    graph.add(own.withColumn("done", F.col("fate").isNotNull()))
    graph.jump()
    via = graph.done().select("tree", F.col("node_id").alias("ptr"), F.col("seg").alias("rest"))
    others = s.walked.where(~split)
    whole = (
        graph.done().select(*KEY, "seg")
        .unionByName(others.where("fate = 'root'").select(*KEY, "seg"))
        .unionByName(others.where("fate IS NULL").join(via, ["tree", "ptr"]).select(*KEY, F.concat("seg", "rest").alias("seg")))
    )
    return whole.select(
        *KEY,
        F.coalesce(F.try_element_at("seg", F.lit(-1)), F.col("node_id")).alias("root_id"),
        F.size("seg").cast("bigint").alias("depth"),
        F.concat(F.reverse("seg"), F.array("node_id")).alias("path"),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """(tree, ancestor_id, descendant_id, distance): every pair of a node and one below it."""
    return paths.select("tree", F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id")).where(
        "at < depth"
    ).select("tree", "ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
