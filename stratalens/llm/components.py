"""Connected components of pairwise matches by reduction: leaves are stripped, chains compressed, the core solved.

One round marks every edge with the degrees of its ends. The vertices of degree two form chains, whose darts (a vertex
with the neighbour it is entered from) are ranked by pointer jumping: a dart learns, in steps of doubling length, the
end to which its chain leads. The ends are leaves (degree one) or hubs (three and more). Then all leaves and chains
go: what hangs on one hub is anchored there, a chain between two hubs becomes an edge between them and is anchored at
one of them, and a path between two leaves is a component of its own. Rounds repeat until no vertex of degree one or
two is left; rings, whose darts never find an end, are put aside as they appear. What remains, with the rings, is
solved by star contraction; then the removed vertices get their labels from their anchors, last round first.

Vertices are 64-bit hashes of the names, checked to be free of collisions (another seed is taken otherwise); the label
of a component is the smallest name in it. All tables of the rounds lie in the shared work folder, each until the next
round no longer needs it; darts that have found their end are written once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.skew import lookup
from stratalens.operators.stars import both_ways, star_labels
from stratalens.work import Workspace



def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _darts(marked: DataFrame) -> DataFrame:
    """Both darts (src, at) of every vertex `at` of degree two; they lead to nat, the other neighbour.

    nsrc -> nat is the next dart while the dart is open (nat is of degree two). src_deg and nat_deg are degrees: 1, 2
    and, for hubs, 3.
    """
    ways = F.array(
        F.struct(F.col("u").alias("at"), F.col("v").alias("other"), F.col("du").alias("d"), F.col("dv").alias("deg")),
        F.struct(F.col("v").alias("at"), F.col("u").alias("other"), F.col("dv").alias("d"), F.col("du").alias("deg")),
    )
    ends = marked.select(F.explode(ways).alias("w")).where("w.d = 2").select("w.at", F.struct("w.other", "w.deg").alias("o"))
    inner = ends.groupBy("at").agg(F.min("o").alias("a"), F.max("o").alias("b"))
    dart = lambda a, b: F.struct(F.col(f"{a}.other").alias("src"), "at", F.col("at").alias("nsrc"), F.col(f"{b}.other").alias("nat"), F.col(f"{a}.deg").alias("src_deg"), F.col(f"{b}.deg").alias("nat_deg"), (F.col(f"{b}.deg") == 2).alias("open"))
    return inner.select(F.explode(F.array(dart("a", "b"), dart("b", "a"))).alias("d")).select("d.*")


def _ranked(ws: Workspace, marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(closed darts, whose nat is the end of their chain; open darts, which lie on rings; the stored table of both)."""
    step, split, opened = 0, ("step", "open"), F.count_if("open").alias("open")
    darts, seen = ws.save_observed(_darts(marked).withColumn("step", F.lit(step)), "darts", opened, split=split)
    left, before = seen["open"], -1
    while left and left != before:
        # only darts that are entered from a vertex of degree two can be the next one of another
        targets = darts.where(f"(NOT open AND src_deg = 2) OR (open AND step = {step})")
        targets = targets.select(F.col("src").alias("nsrc"), F.col("at").alias("nat"), F.col("nsrc").alias("s2"), F.col("nat").alias("t2"), F.col("nat_deg").alias("deg2"), F.col("open").alias("open2"))
        jumped = darts.where(f"open AND step = {step}").select("src", "at", "nsrc", "nat", "src_deg").join(targets, ["nsrc", "nat"])
        jumped = jumped.select("src", "at", F.col("s2").alias("nsrc"), F.col("t2").alias("nat"), "src_deg", F.col("deg2").alias("nat_deg"), F.col("open2").alias("open"), F.lit(step + 1).alias("step"))
        # a chain closes a dart in every step, so what stays open when none closes lies on rings
        darts, seen = ws.save_observed(jumped, "darts", opened, split=split, to=darts)
        step, left, before = step + 1, seen["open"], left
    return darts.where("NOT open"), darts.where(f"open AND step = {step}"), darts


def _round(ws: Workspace, edges: DataFrame) -> tuple[DataFrame, int, DataFrame, int, DataFrame]:
    """(remaining edges, their number, removed vertices (x, anchor), their number, edges of rings)."""
    degrees = ws.save(both_ways(edges).groupBy("u").agg(F.least(F.count("*"), F.lit(3)).cast("tinyint").alias("d")), "degrees")
    end = lambda c: degrees.select(F.col("u").alias(c), F.col("d").alias(f"d{c}"))
    marked = ws.save(edges.join(end("u"), "u").join(end("v"), "v").select("u", "v", "du", "dv"), "marked")
    chains, open_, darts = _ranked(ws, marked)
    # every vertex of a chain sees both of its ends; one that is no leaf is the anchor, of two alike the smaller
    seen = chains.groupBy(F.col("at").alias("x")).agg(F.max(F.struct((F.col("nat_deg") > 1).alias("hub"), F.bitwise_not("nat").alias("least"))).alias("end"), F.count("*").alias("ends")).where("ends = 2")
    inner = seen.select("x", F.bitwise_not("end.least").alias("anchor"))
    # a leaf on a chain anchors at the other end, of two leaves the larger at the smaller; the smaller is its own root
    far = chains.where("src_deg = 1").select(F.col("src").alias("x"), F.when(F.col("nat_deg") > 1, F.col("nat")).otherwise(F.least("src", "nat")).alias("anchor"))
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y"), F.col("du").alias("d"), F.col("dv").alias("e")), F.struct(F.col("v").alias("x"), F.col("u").alias("y"), F.col("dv").alias("d"), F.col("du").alias("e")))
    near = marked.where("(du = 1 AND dv <> 2) OR (dv = 1 AND du <> 2)").select(F.explode(ends).alias("w")).where("w.d = 1")
    near = near.select("w.x", F.when(F.col("w.e") > 1, F.col("w.y")).otherwise(F.least("w.x", "w.y")).alias("anchor"))
    removed, gone = ws.save_observed(_union([inner, far, near]), "removed", F.count("*").alias("n"))
    # a chain between two hubs comes once from either side; loops at one hub vanish
    shortcuts = chains.where("src_deg = 3 AND nat_deg = 3 AND src <> nat").select(*_ordered("src", "nat"))
    rest, left = ws.save_observed(marked.where("du = 3 AND dv = 3").select("u", "v").unionByName(shortcuts).distinct(), "edges", F.count("*").alias("n"))
    rings = ws.save(open_.select(*_ordered("src", "at")).distinct(), "rings")
    ws.forget(degrees, marked, darts)
    return rest, left["n"], removed, gone["n"], rings


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(name, group) for every name in a pair of two different, non-null names; group is the smallest name linked with it.

    Repeated pairs, either direction and pairs of a name with itself make no difference; other columns are ignored.
    """
    ws = Workspace(pairs.sparkSession, "components")
    linked = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    seed = 0
    while True:
        code = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        names, counted = ws.save_observed(linked.select(F.explode(F.array("a", "b")).alias("name")).distinct().select("name", code("name").alias("x")), "names", F.count("*").alias("n"))
        total = counted["n"]
        if not names.groupBy("x").count().where("count > 1").take(1):
            break
        ws.forget(names)
        seed += 1
    edges, alive = ws.save_observed(linked.select(code("a").alias("s"), code("b").alias("t")).select(*_ordered("s", "t")).distinct(), "edges", F.count("*").alias("n"))
    left, layers, core = alive["n"], [], []
    while left:
        rest, left, removed, gone, rings = _round(ws, edges)
        core.append(rings)
        if not gone:  # only hubs and rings are left
            core.append(rest)
            break
        ws.forget(edges)
        edges = rest
        layers.append(removed)
    labels = names.select("x", F.col("x").alias("root")).limit(0)
    if core and _union(core).take(1):
        labels = ws.save(star_labels(ws, _union(core)), "labels")
    for removed in reversed(layers):
        back = ws.save(lookup(removed, labels.select(F.col("x").alias("anchor"), "root"), "anchor", total, "left"), "restored")
        # an anchor without a label is the root of a finished component
        roots = back.where("root IS NULL").select(F.col("anchor").alias("x"), F.col("anchor").alias("root")).distinct()
        found = back.select("x", F.coalesce("root", "anchor").alias("root")).join(roots.select("x"), "x", "left_anti")
        before, labels = labels, ws.save(_union([labels, roots, found]), "labels")
        ws.forget(removed, back, before)
    members = ws.save(names.join(labels, "x").select("name", "root"), "members")
    smallest = members.groupBy("root").agg(F.min("name").alias("group"))
    return lookup(members, smallest, "root", total).select("name", "group")
