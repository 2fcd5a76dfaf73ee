"""The call graph: neighbours, bounded traversals, impact, paths and cycles, as joins of frontiers with edges.

A stored graph of at most LOCAL_EDGES edges, which its count shows before anything is moved, is held by the
driver as arrays, so that a query of many steps is no series of small jobs. In a larger one frontiers and
edges are joined by their keys, each level is written to the shared folder, and no level is collected; the
number of jobs grows with the depth, not with the data. Both ways give the same results.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.durable import materialize
from lexiloom.functions import extract_module, risk_score, short_name


#: Up to so many edges (some 100 bytes each) a stored graph is walked by the driver.
LOCAL_EDGES = 1_000_000


class _Local:
    """A small graph as arrays: for each direction the neighbours of node i are ends[at[i]:at[i + 1]]."""

    def __init__(self, edges: DataFrame):
        t = edges.select("caller", "callee").toArrow()
        names = np.concatenate([t.column(c).to_numpy(zero_copy_only=False).astype(object) for c in ("caller", "callee")])
        self.names, codes = np.unique(names.astype(str), return_inverse=True)
        self.code = {x: i for i, x in enumerate(self.names.tolist())}
        caller, callee = codes[: t.num_rows], codes[t.num_rows :]
        self.ways = {"callees": self._way(caller, callee), "callers": self._way(callee, caller)}

    def _way(self, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((dst, src))
        return np.searchsorted(src[order], np.arange(len(self.names) + 1)), dst[order]

    def near(self, nodes: np.ndarray, direction: str) -> np.ndarray:
        """The distinct neighbours of some nodes."""
        at, ends = self.ways[direction]
        sizes = at[nodes + 1] - at[nodes]
        first = np.repeat(at[nodes] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(nodes) else at[:0]
        return np.unique(ends[first + np.arange(len(first))])

    def matches(self, text: str) -> np.ndarray:
        if text in self.code:
            return np.array([self.code[text]])
        short = [i for i, x in enumerate(self.names.tolist()) if x.rpartition("::")[2] == text]
        return np.array(short or [i for i, x in enumerate(self.names.tolist()) if text in x], np.int64)

    def levels(self, start: str, depth: int, direction: str) -> list[np.ndarray]:
        """The nodes of each level from 1 on, without the start; callers need its exact name."""
        own = self.code.get(start, -1)
        now = np.array([own] if own >= 0 else [], np.int64) if direction == "callers" else self.matches(start)
        seen = np.zeros(len(self.names), bool)
        if own >= 0:
            seen[own] = True
        out = []
        while len(out) < depth and len(now := self.near(now, direction)):
            now = now[~seen[now]]
            if not len(now):
                break
            seen[now] = True
            out.append(now)
        return out

    def reaches_itself(self, target: str) -> bool:
        if target not in self.code:
            return False
        own, now = self.code[target], self.matches(target)
        seen = np.zeros(len(self.names), bool)
        while len(now := self.near(now, "callees")):
            now = now[~seen[now]]
            seen[now] = True
            if seen[own]:
                return True
        return False

    def path(self, a: str, b: str) -> list[str] | None:
        """By search from both ends; of the shortest ways the one whose predecessors are least, from the end back."""
        if not len(x := self.matches(a)) or not len(y := self.matches(b)):
            return None
        x, y = int(x.min()), int(y.min())  # codes follow the order of names
        both = lambda n: np.union1d(self.near(n, "callers"), self.near(n, "callees"))
        far = [np.full(len(self.names), -1), np.full(len(self.names), -1)]
        rim, steps = [np.array([x]), np.array([y])], [0, 0]
        far[0][x], far[1][y] = 0, 0
        while not ((far[0] >= 0) & (far[1] >= 0)).any():
            k = 0 if len(rim[0]) <= len(rim[1]) else 1
            rim[k] = (n := both(rim[k]))[far[k][n] < 0]
            if not len(rim[k]):
                return None
            steps[k] += 1
            far[k][rim[k]] = steps[k]
        total = int((far[0] + far[1])[(far[0] >= 0) & (far[1] >= 0)].min())
        while steps[0] < total:  # distances from a, which the way back needs
            rim[0] = (n := both(rim[0]))[far[0][n] < 0]
            steps[0] += 1
            far[0][rim[0]] = steps[0]
        way = [y]
        for level in range(total - 1, -1, -1):
            n = both(np.array([way[-1]]))
            way.append(int(n[far[0][n] == level].min()))
        return [self.names[i] for i in reversed(way)]


class CallGraph:
    """edges: any table of (caller, callee); rows that repeat count once, null ends not at all."""

    local: _Local | None = None
    kept = False  # whether edges and nodes are stored

    def __init__(self, edges: DataFrame, distinct: bool = False):
        self.edges = edges if distinct else edges.select("caller", "callee").where("caller is not null and callee is not null").distinct()
        self.nodes = self.edges.select(F.explode(F.array("caller", "callee")).alias("name")).distinct().withColumn("short_name", short_name("name"))

    @classmethod
    def stored(cls, edges: DataFrame, distinct: bool = False) -> CallGraph:
        """A graph whose distinct edges, and nodes where they are many, are written once, for queries of several steps."""
        g = cls(materialize(cls(edges, distinct).edges, "edges"), distinct=True)
        if g.edges.count() <= LOCAL_EDGES:
            g.local = _Local(g.edges)
        else:
            g.nodes, g.kept, g.found = materialize(g.nodes, "nodes"), True, {}
        return g

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.edges.sparkSession.createDataFrame(rows, schema)

    @cached_property
    def most_called(self) -> str | None:
        """The node with the most callers, the first by name of several."""
        if self.local is not None:
            counts = np.diff(self.local.ways["callers"][0])
            return str(self.local.names[int(counts.argmax())]) if len(counts) else None
        top = self.edges.groupBy("callee").count().orderBy(F.desc("count"), "callee").first()
        return top["callee"] if top else None

    def short_names(self) -> DataFrame:
        return self.nodes.groupBy("short_name").agg(F.array_sort(F.collect_list("name")).alias("names"))

    def matches(self, text: str) -> DataFrame:
        """(name, tier): nodes by full name, else by short name, else by substring."""
        tier = F.when(F.col("name") == text, 0).when(F.col("short_name") == text, 1).when(F.col("name").contains(text), 2)
        ranked = self.nodes.withColumn("tier", tier).where("tier is not null")
        best = ranked.agg(F.min("tier").alias("best"))  # one row
        return ranked.join(F.broadcast(best), F.col("tier") == F.col("best")).select("name", "tier")

    def _near(self, text: str, at: str, to: str) -> DataFrame:
        if self.local is not None:
            found = self.local.near(self.local.matches(text), to + "s")
            return self._rows([(x,) for x in self.local.names[found].tolist()], "name string")
        found = self.matches(text).select("name")
        if self.kept:  # a table of known size, else all edges are shuffled for a few names
            found = self.found[text] = self.found[text] if text in self.found else materialize(found, "matches")
        return self.edges.join(found.select(F.col("name").alias("__m")), F.col(at) == F.col("__m"), "left_semi").select(F.col(to).alias("name")).distinct()

    def callers(self, text: str) -> DataFrame:
        return self._near(text, "callee", "caller")

    def callees(self, text: str) -> DataFrame:
        return self._near(text, "caller", "callee")

    def transitive(self, start: str, depth: int = 3, direction: str = "callers", callees: DataFrame | None = None) -> DataFrame:
        """(name, depth) reached in 1 to depth steps, at the least depth; the start itself isn't in it. Callers need the exact name, callees take partial ones. callees: those of the start, where they are known already."""
        if self.local is not None:
            levels = self.local.levels(start, depth, direction)
            return self._rows([(x, k) for k, level in enumerate(levels, 1) for x in self.local.names[level].tolist()], "name string, depth int")
        at, to = ("callee", "caller") if direction == "callers" else ("caller", "callee")
        first = self.edges.where(F.col(at) == start).select(F.col(to).alias("name")).distinct() if direction == "callers" else self.callees(start) if callees is None else callees
        seen = materialize(first.where(F.col("name") != start).withColumn("depth", F.lit(1)), "walk") if depth > 0 else first.limit(0).withColumn("depth", F.lit(1))
        frontier = seen
        for level in range(2, depth + 1):
            step = self.edges.join(frontier.select(F.col("name").alias("__f")), F.col(at) == F.col("__f"), "left_semi").select(F.col(to).alias("name")).distinct()
            step = step.where(F.col("name") != start).join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(level))
            frontier = materialize(step, "walk")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return seen

    def has_cycle(self, target: str) -> bool:
        """Whether the target, by its exact name, can reach itself."""
        if self.local is not None:
            return self.local.reaches_itself(target)
        return self._meets(target, *[materialize(self.callees(target), "cycle")] * 2)

    def _meets(self, target: str, frontier: DataFrame, seen: DataFrame) -> bool:
        """Whether the target is among the nodes seen, of which the frontier is the last level, or among those that they lead to."""
        while True:
            if not seen.where(F.col("name") == target).isEmpty():
                return True
            step = self.edges.join(frontier.select(F.col("name").alias("__f")), F.col("caller") == F.col("__f"), "left_semi").select(F.col("callee").alias("name")).distinct()
            frontier = materialize(step.join(seen, "name", "left_anti"), "cycle")
            if frontier.isEmpty():
                return False
            seen = seen.unionByName(frontier)

    def affected_modules(self, target: str, depth: int = 3) -> DataFrame:
        """(module): distinct modules of direct and transitive callers."""
        both = self.transitive(target, depth).select("name").union(self.callers(target))
        return both.select(extract_module("name").alias("module")).where("module is not null").distinct()

    def impact(self, target: str, depth: int = 3) -> DataFrame:
        """One row: counts of direct and transitive callers and callees, affected modules, cycle and risk."""
        callers, near = self.callers(target), self.callees(target)
        if self.local is None:  # each is read several times
            callers, near = materialize(callers, "near"), materialize(near, "near")
        up, down = self.transitive(target, depth), self.transitive(target, depth, "callees", near)
        direct = callers.agg(F.count(F.lit(1)).alias("direct_callers"))
        callees = near.agg(F.count(F.lit(1)).alias("direct_callees"))
        ups = up.agg(F.count(F.lit(1)).alias("transitive_callers"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth_reached"))
        downs = down.agg(F.count(F.lit(1)).alias("transitive_callees"))
        modules = up.select("name").union(callers).select(extract_module("name").alias("m")).where("m is not null").distinct().agg(F.count(F.lit(1)).alias("modules"))
        row = direct.crossJoin(callees).crossJoin(ups).crossJoin(downs).crossJoin(modules)  # each is one row
        dependents = F.greatest("transitive_callers", "direct_callers")
        return row.select(F.lit(target).alias("target"), "*", F.lit(self._in_cycle(target, near, down, depth)).alias("in_cycle"), (F.col("direct_callers") + F.col("transitive_callers")).alias("total_dependents"), F.round(risk_score(dependents, "depth_reached", depth, "modules"), 6).alias("risk"))

    def _in_cycle(self, target: str, near: DataFrame, down: DataFrame, depth: int) -> bool:
        """has_cycle from its callees and a walk down to a depth: the target is met next where its callers are among them, and only levels beyond are walked anew."""
        if self.local is not None or depth < 1:
            return self.has_cycle(target)
        into = self.edges.where(F.col("callee") == target).select(F.col("caller").alias("name"))
        if not near.where(F.col("name") == target).isEmpty() or not down.join(into, "name", "left_semi").isEmpty():
            return True
        last = down.agg(F.max("depth")).first()[0]
        return self._meets(target, down.where(F.col("depth") == last).select("name"), down.select("name"))

    def path(self, a: str, b: str) -> DataFrame:
        """(path, hops): a shortest undirected path between the first matches of two names, no row if there is none.

        Level by level from a; of the ways to a node the smallest predecessor is kept, so no path is enumerated.
        """
        if self.local is not None:
            way = self.local.path(a, b)
            return self._rows([(way, len(way) - 1)] if way else [], "path array<string>, hops int")
        spark = self.edges.sparkSession
        ends = [r["name"] if (r := self.matches(x).orderBy("name").first()) else None for x in (a, b)]
        schema = "path array<string>, hops int"
        if None in ends:
            return spark.createDataFrame([], schema)
        links = self.edges.select(F.col("caller").alias("u"), F.col("callee").alias("v")).union(self.edges.select("callee", "caller"))
        frontier = seen = spark.createDataFrame([(ends[0], None, 0)], "name string, via string, level int")
        level = 0
        while seen.where(F.col("name") == ends[1]).isEmpty():
            level += 1
            step = links.join(frontier.select(F.col("name").alias("f")), F.col("u") == F.col("f")).groupBy(F.col("v").alias("name")).agg(F.min("u").alias("via"))
            frontier = materialize(step.join(seen.select("name"), "name", "left_anti").withColumn("level", F.lit(level)), "path")
            if frontier.isEmpty():
                return spark.createDataFrame([], schema)
            seen = seen.unionByName(frontier)
        way = [ends[1]]
        for k in range(level, 0, -1):  # as many lookups as the path has steps
            way.append(seen.where((F.col("level") == k) & (F.col("name") == way[-1])).first()["via"])
        return spark.createDataFrame([(way[::-1], level)], schema)


def enriched(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """names with the kind, file and line of one symbol of each qualified or short name, if there is any."""
    wanted = names.select(F.col("name").alias("wanted")).distinct()
    keyed = symbols.select(F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("qualified_name").alias("key")), F.struct(F.lit(1).alias("rank"), F.col("name").alias("key")))).alias("k"), "id", "kind", "file_path", "start_line").select("k.*", "id", "kind", "file_path", "start_line")
    keyed = keyed.join(wanted, F.col("key") == F.col("wanted"), "left_semi")
    first = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("rank", "id"))).where("rn = 1")
    return names.join(first, names["name"] == first["key"], "left").select(names["name"], "kind", "file_path", "start_line")
