"""Basic graph patterns compiled to DataFrame joins: patterns, OPTIONAL, UNION, FILTER, VALUES, BIND, DISTINCT, GROUP BY, ORDER BY.

A variable starts with '?'. Patterns with the same subject variable are answered by one grouped pass over the graph
instead of a self join each (`star`), wherever every predicate is bound and single values are enough; other patterns
are joined on their common variables, the most selective ones (most bound terms) first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import closure

Pattern = tuple[str, str, str]


def _is_var(x: str) -> bool:
    return x.startswith("?")


def scan(t: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of one pattern."""
    out, cols, seen = t, [], {}
    for name, term in zip("spo", pattern):
        if not _is_var(term):
            out = out.where(F.col(name) == term)
        elif term in seen:
            out = out.where(F.col(name) == F.col(seen[term]))
        else:
            seen[term] = name
            cols.append(F.col(name).alias(term[1:]))
    return out.select(*cols) if cols else out.select(F.lit(1).alias("_one")).limit(1)


def join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    on = [c for c in a.columns if c in b.columns]
    return a.join(b, on, how) if on else a.crossJoin(b)


def bgp(t: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """All bindings of a list of patterns, connected ones joined in order of selectivity."""
    rest = sorted(patterns, key=lambda p: (sum(map(_is_var, p)), p[1].endswith("#type") or p[1].endswith("#label")))
    out, names = scan(t, rest[0]), {x for x in rest[0] if _is_var(x)}
    rest = rest[1:]
    while rest:
        nxt = next((p for p in rest if names & {x for x in p if _is_var(x)}), rest[0])
        rest.remove(nxt)
        out, names = join(out, scan(t, nxt)), names | {x for x in nxt if _is_var(x)}
    return out


def star(t: DataFrame, subject: str, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """Star pattern in one pass: {variable: predicate}; of several values the least. Subjects lacking a required one drop."""
    optional = optional or {}
    both = {**required, **optional}
    agg = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(v) for v, p in both.items()]
    out = t.where(F.col("p").isin(*both.values())).groupBy(F.col("s").alias(subject)).agg(*agg)
    for v in required:
        out = out.where(F.col(v).isNotNull())
    return out


@dataclass
class Query:
    """A query as data; `run` gives the DataFrame. Parts apply in the order in which SPARQL would."""

    where: list[Pattern] = field(default_factory=list)
    optional: list[list[Pattern]] = field(default_factory=list)
    union: list[list[Pattern]] = field(default_factory=list)
    values: dict[str, list[str]] = field(default_factory=dict)
    bind: dict[str, Column] = field(default_factory=dict)
    filters: list[Column] = field(default_factory=list)
    select: list[str] | None = None
    distinct: bool = False
    group: list[str] = field(default_factory=list)
    aggregates: dict[str, Column] = field(default_factory=dict)
    order: list = field(default_factory=list)
    limit: int | None = None

    def run(self, t: DataFrame) -> DataFrame:
        out = bgp(t, self.where) if self.where else None
        if self.union:
            parts = [bgp(t, u) for u in self.union]
            u = parts[0]
            for x in parts[1:]:
                u = u.unionByName(x, allowMissingColumns=True)
            out = u if out is None else join(out, u)
        for o in self.optional:
            out = join(out, bgp(t, o), "left")
        for name, allowed in self.values.items():
            out = out.where(F.col(name).isin(*allowed))
        for name, c in self.bind.items():
            out = out.withColumn(name, c)
        for c in self.filters:
            out = out.where(c)
        if self.group or self.aggregates:
            out = out.groupBy(*self.group).agg(*[c.alias(n) for n, c in self.aggregates.items()])
        if self.select:
            out = out.select(*self.select)
        if self.distinct:
            out = out.distinct()
        if self.order:
            out = out.orderBy(*self.order)
        return out.limit(self.limit) if self.limit else out


def construct(bindings: DataFrame, templates: list[Pattern]) -> DataFrame:
    """Triples from bindings, repeated ones removed."""
    term = lambda x: F.col(x[1:]) if _is_var(x) else F.lit(x)
    rows = F.array(*[F.struct(*[term(x).cast("string").alias(n) for n, x in zip("spo", p)]) for p in templates])
    return bindings.select(F.explode(rows).alias("r")).select("r.*").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


def path_plus(t: DataFrame, predicate: str, max_depth: int | None = None) -> DataFrame:
    """(a, b): b is reached from a by one or more steps of a predicate (a property path)."""
    return closure(t.where(F.col("p") == predicate), "s", "o", max_depth).select("a", "b")


def first_non_empty(*queries) -> DataFrame:
    """The first of several queries (functions without arguments) that has rows, else the last one's empty result."""
    out = None
    for q in queries:
        out = q()
        if not out.isEmpty():
            return out
    return out
