"""Turns a parsed pattern query into a DataFrame; Catalyst does the rest.

Every bound variable is a set of flat columns ``var.property``, so that unused properties are pruned
from the scans. Shared variables become equi-joins, and conditions on a single end of a path go below
the path search. ``compat`` keeps oddities of the older dialect: comma patterns are cross joined,
undirected edges match as stored, ``count(*)`` is 0, and WITH, DISTINCT and property maps are errors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.lineage import cut
from ..graph import Graph
from ..operators import paths
from ..schema import METADATA
from .syntax import AGGREGATES, Call, Chain, Literal, Name, Node, Op, Part, QueryError, parse, text_of

HIDDEN = {"content", "repo_id", "vector"}
MOST_INNER, MOST_ROWS = 10_000, 100_000


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def names_in(e: object) -> set[str]:
    if isinstance(e, Name):
        return {e.var}
    return set().union(*(names_in(a) for a in e.args)) if isinstance(e, Op | Call) else set()


def conjuncts(e: object) -> list:
    return [] if e is None else [y for x in e.args for y in conjuncts(x)] if isinstance(e, Op) and e.name == "and" else [e]


def aggregates(e: object) -> bool:
    return isinstance(e, Call) and e.name in AGGREGATES or isinstance(e, Op | Call) and any(aggregates(a) for a in e.args)


class Planner:
    def __init__(self, graph: Graph, compat: bool = False, functions: dict[str, Callable[..., Column]] | None = None) -> None:
        self.graph, self.compat = graph, compat
        self.functions = {"tolower": self.lower, "lower": self.lower, "toupper": self.upper, "upper": self.upper} | (functions or {})
        self.anonymous = 0

    lower = staticmethod(lambda x: F.lower(F.coalesce(x.cast("string"), F.lit(""))))
    upper = staticmethod(lambda x: F.upper(F.coalesce(x.cast("string"), F.lit(""))))

    # --- patterns --------------------------------------------------------------------------------

    def var(self, given: str | None) -> str:
        if given:
            return given
        self.anonymous += 1
        return f"_{self.anonymous}"

    def scan(self, node: Node, var: str) -> DataFrame:
        if node.label not in (None, "CodeSymbol", "File"):
            raise QueryError(f"unknown label {node.label}: only CodeSymbol and File exist; filter on .kind")
        df = self.graph.files if node.label == "File" else self.graph.symbols
        if "metadata" in df.columns:
            df = df.withColumn("metadata", F.from_json("metadata", METADATA))
        df = df.select(*[F.col(c).alias(f"{var}.{c}") for c in df.columns if c not in HIDDEN])
        if node.props and self.compat:
            raise QueryError("property maps are not supported")
        for key, value in node.props:
            df = df.where(self.expr(Op("=", (Name(var, key), value)), df))
        return df

    def edges(self, edge: object, var: str) -> DataFrame:
        """(__src, __dst) in the pattern's direction, and the edge's own columns."""
        e = self.graph.edges
        if edge.kinds:
            e = e.where(F.col("kind").isin(*edge.kinds))
        own = [F.col(c).alias(f"{var}.{c}") for c in ("kind", "source_uid", "target_uid")]
        out = e.select(F.col("source_uid").alias("__src"), F.col("target_uid").alias("__dst"), *own)
        back = e.select(F.col("target_uid").alias("__src"), F.col("source_uid").alias("__dst"), *own)
        if edge.hops:
            low, high = edge.hops
            one = (out if edge.direction != "in" else back).select("__src", "__dst")
            one = (one.union(back.select("__src", "__dst")) if edge.direction == "both" else one).distinct()
            onwards = one.select(F.col("__src").alias("__dst"), F.col("__dst").alias("__to"))
            step = lambda df: df.join(onwards, "__dst").select("__src", F.col("__to").alias("__dst")).distinct()
            level, last = one, high or (5 if self.compat else None)
            all_ = [one] if low <= 1 and last != 0 else []
            for n in range(2, min(last, 5) + 1 if last else max(low, 1) + 1):  # exchanges of a level are reused by the next
                level = step(level)
                if n >= low:
                    all_.append(level)
            if last is not None and last <= 5:
                return reduce(DataFrame.union, all_).distinct()
            return self.onward(level, step, reduce(DataFrame.union, all_).distinct() if all_ else None, 5 if last else max(low, 1), low, last)
        if edge.direction == "both":
            return out if self.compat else out.union(back)
        return out if edge.direction == "out" else back

    @staticmethod
    def onward(level: DataFrame, step: Callable[[DataFrame], DataFrame], found: DataFrame | None, n: int, low: int, last: int | None) -> DataFrame:
        """The pairs of ``n`` hops' ``level`` and of all longer walks up to ``last`` (None: any length), level by
        level; each level is written. From ``low`` hops on, only pairs not found before go further."""
        level = cut(level)
        found = cut(found) if found is not None else level if n >= low else level.limit(0)
        while (last is None or n < last) and not level.isEmpty():
            level, n = step(level), n + 1
            if n >= low:
                level = cut(level.join(found, ["__src", "__dst"], "left_anti") if n > low else level)
                found = cut(found.union(level).distinct())
            else:
                level = cut(level)
        return found

    def chain(self, chain: Chain) -> tuple[DataFrame, list[str]]:
        names = [self.var(n.var) for n in chain.nodes]
        df, bound = self.scan(chain.nodes[0], names[0]), {names[0]}
        for i, edge in enumerate(chain.edges):
            here, there = names[i], names[i + 1]
            df = df.join(self.edges(edge, self.var(edge.var)), quoted(f"{here}.uid") == F.col("__src")).drop("__src")
            if there in bound:
                df = df.where(F.col("__dst") == quoted(f"{there}.uid")).drop("__dst")
            else:
                df = df.join(self.scan(chain.nodes[i + 1], there), F.col("__dst") == quoted(f"{there}.uid")).drop("__dst")
                bound.add(there)
        return df, names

    def path(self, df: DataFrame, chain: Chain) -> DataFrame:
        """Adds the path between both ends, which are bound; rows without one keep a null shortest path."""
        a, b = chain.nodes[0].var, chain.nodes[1].var
        depth = (chain.edges[0].hops or (1, 5))[1] or 5
        if depth > 10:
            raise ValueError("a path search has 10 hops at most")
        find = {"shortest": paths.shortest_paths, "all": paths.all_paths, "any": paths.any_path}[chain.path]
        pairs = df.select(quoted(f"{a}.uid").alias("a"), quoted(f"{b}.uid").alias("b")).distinct()
        var = self.var(chain.var)
        found = find(paths.both_ways(self.graph), pairs, depth).select("a", "b", F.when(F.col("nodes").isNotNull(), F.struct("nodes", "edges")).alias(f"{var}.path"))
        return df.join(found, (quoted(f"{a}.uid") == F.col("a")) & (quoted(f"{b}.uid") == F.col("b"))).drop("a", "b")

    def match(self, query: object) -> DataFrame:
        rest, df, bound = conjuncts(query.where), None, set()
        for chain in query.chains:
            if chain.path and bound >= {n.var for n in chain.nodes}:
                continue
            if chain.path:  # both ends, each with the conditions on it alone
                own = None
                given = {n.var for n in chain.nodes if n.var in bound or n.props or any(names_in(e) == {n.var} for e in rest)}
                if not given:
                    raise QueryError("a path search between any two symbols: give a condition on an end")
                for n in chain.nodes:
                    if n.var not in bound:
                        end = self.scan(n, n.var)
                        for e in [e for e in rest if names_in(e) == {n.var}]:
                            end = end.where(self.expr(e, end))
                        own = end if own is None else own.crossJoin(end)
                names = [n.var for n in chain.nodes]
            else:
                own, names = self.chain(chain)
            shared = [n for n in dict.fromkeys(names) if n in bound]
            if df is None:
                df = own
            elif shared and not self.compat:
                twice = [c for c in own.columns if c in df.columns]
                for c in twice:
                    own = own.withColumnRenamed(c, f"__{c}")
                df = df.join(own, reduce(Column.__and__, [quoted(f"{n}.uid") == quoted(f"__{n}.uid") for n in shared])).drop(*[f"__{c}" for c in twice])
            else:
                df = df.drop(*[c for c in own.columns if c in df.columns]).crossJoin(own)
                if self.compat and df.limit(MOST_INNER + 1).count() > MOST_INNER:
                    raise QueryError(f"more than {MOST_INNER} rows before filtering")
            bound |= {c.split(".")[0] for c in df.columns}
        late = [c for c in query.chains if c.path]
        variables = {c.var for c in late}
        for e in [e for e in rest if not names_in(e) & variables]:  # below the path search
            df = df.where(self.expr(e, df))
        for chain in late:
            df = self.path(df, chain)
        for e in [e for e in rest if names_in(e) & variables]:
            df = df.where(self.expr(e, df))
        return df

    # --- expressions -----------------------------------------------------------------------------

    def value(self, e: Name, df: DataFrame) -> Column:
        if e.prop is not None:
            if f"{e.var}.{e.prop}" in df.columns:
                return quoted(f"{e.var}.{e.prop}")
            whole = [f for f in df.schema.fields if f.name == e.var and f.dataType.typeName() == "struct"]
            return quoted(e.var)[e.prop] if whole and e.prop in whole[0].dataType.names else F.lit(None).cast("string")
        if e.var in df.columns:
            return quoted(e.var)
        own = [c for c in df.columns if c.startswith(f"{e.var}.")]
        if own == [f"{e.var}.path"]:
            return quoted(own[0])
        if not own:
            return F.lit(None).cast("string")
        return F.struct(*[quoted(c).alias(c.split(".", 1)[1]) for c in own])

    def key(self, e: object, df: DataFrame) -> Column:
        """A value to count or compare by: a node is its uid."""
        if isinstance(e, Name) and e.prop is None and f"{e.var}.uid" in df.columns:
            return quoted(f"{e.var}.uid")
        return self.expr(e, df)

    def numeric(self, c: Column, df: DataFrame) -> bool:
        return isinstance(df.select(c.alias("x")).schema[0].dataType, NumericType)

    def expr(self, e: object, df: DataFrame) -> Column:
        if isinstance(e, Literal):
            return F.lit(e.value)
        if isinstance(e, Name):
            return self.value(e, df)
        if isinstance(e, Call):
            if e.name in AGGREGATES:
                return self.aggregate(e, df)
            if e.name == "length":
                return F.size(self.expr(e.args[0], df)["edges"]).cast("long")
            if e.name == "nodes":
                return self.expr(e.args[0], df)["nodes"]
            if f := self.functions.get(e.name):
                return f(*[self.expr(a, df) for a in e.args])
            return F.lit(None).cast("string")
        true = lambda c: F.coalesce(c, F.lit(False))
        args = [self.key(a, df) for a in e.args]
        if e.name in ("and", "or"):
            return true(args[0]) & true(args[1]) if e.name == "and" else true(args[0]) | true(args[1])
        if e.name == "not":
            return ~true(args[0])
        if e.name in ("null", "not null"):
            return args[0].isNull() if e.name == "null" else args[0].isNotNull()
        if e.name == "in":
            return reduce(Column.__or__, [args[0].eqNullSafe(a) for a in args[1:]], F.lit(False))
        if e.name in ("contains", "starts", "ends"):
            left, right = (F.coalesce(a.cast("string"), F.lit("")) for a in args)
            return F.lower(left).contains(F.lower(right)) if e.name == "contains" else left.startswith(right) if e.name == "starts" else left.endswith(right)
        a, b = args
        if self.numeric(a, df) != self.numeric(b, df):  # as texts
            a, b = a.cast(StringType()), b.cast(StringType())
        if e.name in ("=", "<>"):
            return a.eqNullSafe(b) if e.name == "=" else ~a.eqNullSafe(b)
        return true({"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e.name])

    def aggregate(self, e: Call, df: DataFrame) -> Column:
        if e.name == "count" and (not e.args or e.args[0] == "*"):
            return F.lit(0).cast("long") if self.compat else F.count(F.lit(1))
        value = self.key(e.args[0], df)
        if self.compat and e.name in ("sum", "avg", "min", "max"):
            value = F.coalesce(value.try_cast("double"), F.lit(0.0))
        if e.name == "count":
            return F.count_distinct(value) if e.distinct else F.count(value)
        if e.name == "collect":
            return F.sort_array(F.collect_set(value) if e.distinct else F.collect_list(value))
        return {"sum": F.sum_distinct if e.distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[e.name](value)

    # --- projections -----------------------------------------------------------------------------

    def project(self, df: DataFrame, part: Part, last: bool) -> DataFrame:
        order = []
        items = [(i.expr, i.alias) for i in part.items]
        if any(aggregates(x) for x, _ in items):
            keys = [(x, a) for x, a in items if not aggregates(x)]
            sums = [self.expr(x, df).alias(a) for x, a in items if aggregates(x)]
            # a whole node as key stays a node
            grouped = df.groupBy(*[self.expr(x, df).alias(a) for x, a in keys]).agg(*sums)
            out = grouped.select(*[quoted(a) for _, a in items])
            order = [(self.sort(x, items, out), down) for x, down in part.order]
        else:
            chosen = [c for x, a in items for c in self.columns(x, a, df, last)]
            extra = [self.expr(x, df).alias(f"__order{i}") for i, (x, _) in enumerate(part.order) if not self.named(x, items)]
            out = df.select(*chosen, *([] if part.distinct else extra))
            hidden = iter(f"__order{i}" for i, (x, _) in enumerate(part.order) if not self.named(x, items))
            order = [(quoted(n) if (n := self.named(x, items)) else quoted(next(hidden)) if not part.distinct else self.sort(x, items, out), down) for x, down in part.order]
        if part.distinct:
            out = out.distinct()
        if order:
            visible = [c for c in out.columns if not c.startswith("__order")]
            ties = [quoted(c) for c in visible if out.schema[c].dataType.typeName() not in ("struct", "array", "map")]
            out = out.orderBy(*[c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in order], *[c.asc_nulls_last() for c in ties])
        if part.skip:
            out = out.offset(part.skip)
        if part.limit is not None:
            out = out.limit(part.limit)
        return out.drop(*[c for c in out.columns if c.startswith("__order")])

    def columns(self, e: object, alias: str, df: DataFrame, last: bool) -> list[Column]:
        """One column for a RETURN; a WITH keeps a node's properties as columns of their own."""
        if not last and isinstance(e, Name) and e.prop is None and e.var not in df.columns:
            return [quoted(c).alias(f"{alias}.{c.split('.', 1)[1]}") for c in df.columns if c.startswith(f"{e.var}.")]
        return [self.expr(e, df).alias(alias)]

    def named(self, e: object, items: list) -> str | None:
        return next((a for x, a in items if x == e or a == text_of(e)), None)

    def sort(self, e: object, items: list, out: DataFrame) -> Column:
        name = self.named(e, items)
        return quoted(name) if name in out.columns else F.lit(None)

    def plan(self, text: str) -> DataFrame:
        query = parse(text)
        if self.compat and (len(query.parts) > 1 or query.parts[-1].distinct):
            raise QueryError("WITH and DISTINCT are not supported")
        df = self.match(query)
        for i, part in enumerate(query.parts):
            df = self.project(df, part, i == len(query.parts) - 1)
            if part.where is not None:
                df = df.where(self.expr(part.where, df))
        return df


def cypher(graph: Graph, text: str, compat: bool = False, functions: dict[str, Callable[..., Column]] | None = None, capped: bool = False) -> DataFrame:
    """The rows of a pattern query. ``capped`` makes more than 100,000 of them an error."""
    df = Planner(graph, compat, functions).plan(text)
    if capped and df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise QueryError(f"more than {MOST_ROWS} rows")
    return df
