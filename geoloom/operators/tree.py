"""Layer trees: what stands above each node by pointer doubling, group paths, and the tree as JSON.

A round replaces each node's pointer by that of the node it points to, so after k rounds a node knows its 2**k nearest
ancestors, and a tree of depth d takes log2(d) rounds, each written down. A round that finishes no node leaves only
nodes on cycles or below them. All nodes go only as far as the next chosen ancestor, and one in STRIDE is chosen, so that
long paths are written down and shuffled for these alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import names
from geoloom.operators.ranks import durable, ranked_within, with_previous

#: Why a node has no place in the tree.
CYCLE, ORPHAN, UNDER_LAYER = "cycle", "missing parent", "parent is a layer"
#: Characters of a group path.
LONGEST = 63


#: One node in so many keeps its whole path while the tree is gone through.
STRIDE = 8


def _joined(lower: DataFrame, upper: DataFrame, longest: int | None) -> DataFrame:
    """`lower` with what the nodes that their pointers name in `upper` know."""
    other = upper.select(
        F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("anchor").alias("_anchor"), F.col("fault").alias("_fault"), F.col("root").alias("_root"),
        F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.col("_above").alias("_before"),
    )
    path = F.when(F.col("_depth") > 0, F.concat("_path", F.lit("_"), "path")).otherwise(F.col("path"))
    moved = lower.join(other, "jump").withColumns(
        {
            "jump": F.col("_jump"), "anchor": F.col("_anchor"), "fault": F.coalesce("fault", "_fault"), "root": F.col("_root"), "depth": F.col("depth") + F.col("_depth"),
            "path": path if longest is None else F.substring(path, 1, longest), "_above": F.concat("_before", "_above"),
        }
    )
    return moved.select(lower.columns)


def _doubled(state: DataFrame, longest: int | None) -> DataFrame:
    """`state` with each pointer followed to its end; nodes on or below a cycle have that fault."""
    state, left = durable(state), None
    while True:
        open_ = state.filter("jump IS NOT NULL")
        count = open_.count()
        if count in (0, left):
            break
        left = count
        state = durable(state.filter("jump IS NULL").unionByName(_joined(open_, state, longest)))
    stuck = F.col("jump").isNotNull()
    return state.withColumns({"fault": F.when(stuck, CYCLE).otherwise(F.col("fault")), "jump": F.when(~stuck, F.col("jump"))})


def walked(nodes: DataFrame, longest: int | None = None, places: bool = False) -> DataFrame:
    """`nodes` (id, parent, name, layer), ids unique, with `root`, `depth`, `path` (the cleaned names of the groups above,
    root first; its first `longest` characters where that is given) and `fault`, null where a node has its place. With
    `places` also `at`: its ancestors' and its own numbers among their siblings, by id."""
    rows = nodes.withColumn("_clean", F.lower(names.table_name(F.col("name"))))
    if places:
        rows = ranked_within(rows, ["parent"], ["id"], "_place")
    else:
        rows = rows.withColumn("_place", F.lit(0).cast("long"))
    above = rows.select(F.col("id").alias("parent"), F.col("_clean").alias("_up"), F.col("layer").alias("_over"), F.array("_place").alias("_above"), F.lit(True).alias("_there"))
    none = F.array().cast("array<bigint>")
    start = rows.join(durable(above), "parent", "left").withColumns(
        {
            "fault": F.when(F.col("parent").isNotNull() & F.col("_there").isNull(), ORPHAN).when(F.col("_over"), UNDER_LAYER),
            "jump": F.when(F.col("_there") & ~F.coalesce("_over", F.lit(False)), F.col("parent")),
        }
    )
    known = F.col("jump").isNotNull()
    state = start.select(
        *nodes.columns, "jump", "fault", F.coalesce("jump", "id").alias("root"), F.when(known, 1).otherwise(0).alias("depth"), F.when(known, F.col("_up")).otherwise("").alias("path"),
        F.when(known, F.col("_above")).otherwise(none).alias("_above"), "_place",
    )
    # Every STRIDE-th node or so, by hash: first all nodes up to the next of these, by short paths, then these alone.
    chosen = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(STRIDE)) == 0
    nothing = F.lit(None).cast(state.schema["jump"].dataType)
    near = _doubled(state.withColumns({"anchor": F.when(chosen("jump"), F.col("jump")), "jump": F.when(~chosen("jump"), F.col("jump"))}), longest)
    far = _doubled(near.filter(chosen("id")).withColumns({"jump": F.col("anchor"), "anchor": nothing}), longest)
    rest = near.filter(~chosen("id"))
    under = rest.filter("anchor IS NOT NULL").withColumn("jump", F.col("anchor"))
    found = far.unionByName(rest.filter("anchor IS NULL")).unionByName(_joined(under, far, longest))
    at = [F.concat("_above", F.array("_place")).alias("at")] if places else []
    return found.select(*nodes.columns, "root", "depth", "path", "fault", *at)


def with_paths(nodes: DataFrame) -> DataFrame:
    """`nodes` (id, parent, name, layer) with `depth` and `path`: the cleaned names of the groups above, root first.
    See `faults` for nodes that have no place in the tree."""
    return walked(nodes).filter("fault IS NULL").select("id", "name", "layer", "depth", "path")


def faults(nodes: DataFrame) -> DataFrame:
    """(id, fault): nodes on or below a cycle, a missing parent or a layer."""
    return walked(nodes, 0).filter("fault IS NOT NULL").select("id", "fault")


def group_paths(nodes: DataFrame) -> DataFrame:
    """(id, group_path) of the layers: the path cut to 63 characters."""
    path = F.col("path")  # one character more tells a path of that length from a longer one
    cut = F.when(F.length(path) > LONGEST, F.rtrim(F.substring(path, 1, LONGEST), F.lit("_"))).otherwise(path)
    return walked(nodes, LONGEST + 1).filter("layer AND fault IS NULL").select("id", cut.alias("group_path"))


def tree_json(nodes: DataFrame) -> DataFrame:
    """(value): each node with its children's ids as JSON, a line a node; readers join lines by id."""
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("children"))
    full = with_paths(nodes).join(children, "id", "left")
    return full.select("id", F.to_json(F.struct("id", "name", "layer", "depth", "path", F.coalesce("children", F.array().cast("array<string>")).alias("children"))).alias("value"))


def tree_fragments(nodes: DataFrame) -> DataFrame:
    """(root, at, fragment, rest): what each node adds to its root's nested document, in the order of `at`; `rest` closes
    what is open behind it. Children come by id; a group is {type, name, children}, a layer {type, name}."""
    placed = walked(nodes, 0, places=True).filter("fault IS NULL").select("root", "at", "depth", "layer", "name")
    seen = with_previous(placed, ["root"], ["at"], ["depth", "layer"])
    # Groups that are still open behind the node before, and whether this one is its first child.
    open_ = F.col("prev_depth") + F.when(F.col("prev_layer"), 0).otherwise(1)
    comma = F.when(F.col("prev_depth").isNotNull() & (F.col("prev_layer") | (F.col("prev_depth") >= F.col("depth"))), ",").otherwise("")
    closed = F.coalesce(F.repeat(F.lit("]}"), (open_ - F.col("depth")).cast("int")), F.lit(""))
    named = F.regexp_extract(F.to_json(F.struct(F.coalesce("name", F.lit("")).alias("name"))), r"(?s)^\{(.*)\}$", 1)
    own = F.when(F.col("layer"), F.concat(F.lit('{"type":"layer",'), named, F.lit("}"))).otherwise(F.concat(F.lit('{"type":"group",'), named, F.lit(',"children":[')))
    rest = F.repeat(F.lit("]}"), F.col("depth") + F.when(F.col("layer"), 0).otherwise(1))
    return seen.select("root", "at", F.concat(closed, comma, own).alias("fragment"), rest.alias("rest"))


def tree_documents(nodes: DataFrame) -> DataFrame:
    """(root, value): each root's tree as one nested document, which has to fit a row; where it may not, write the
    fragments in order."""
    pieces = F.array_sort(F.collect_list(F.struct("at", "fragment", "rest")))
    whole = tree_fragments(nodes).groupBy("root").agg(pieces.alias("p"))
    return whole.select("root", F.concat(F.array_join(F.transform("p", lambda q: q["fragment"]), ""), F.element_at("p", -1)["rest"]).alias("value"))
