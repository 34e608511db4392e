"""The graph that the queries run on: the relational tables as triples, with a few deliberate violations, and its ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LABEL, RDFS, TYPE, XSD, Ontology, as_graph
from ..operators.construct import table_triples
from ..session import table

NS, RES = "http://loom.example/ontology/", "http://loom.example/resource/"

CLASSES = [
    (NS + "Region", "region", [NS + "Nation"]), (NS + "Nation", "nation", [NS + "Region"]), (NS + "Customer", "customer", [NS + "Supplier", NS + "Part"]),
    (NS + "Supplier", "supplier", [NS + "Customer", NS + "Part"]), (NS + "Part", "part", [NS + "Customer", NS + "Supplier"]), (NS + "Order", "order", []), (NS + "Ghost", "ghost", []),
]
PROPERTIES = [
    (NS + "n_regionkey", "object", "in region", [], NS + "Nation", NS + "Region", 1, 1),
    (NS + "c_nationkey", "object", "customer of nation", ["home"], NS + "Customer", NS + "Nation", None, 1),
    (NS + "s_nationkey", "object", "supplier of nation", [], NS + "Supplier", NS + "Nation", None, 1),
    (NS + "o_custkey", "object", "ordered by", ["buyer"], NS + "Order", NS + "Customer", 1, 1),
    (NS + "c_mktsegment", "datatype", "segment", [], NS + "Customer", XSD + "string", None, 1),
    (NS + "c_cents", "datatype", "balance", [], NS + "Customer", XSD + "integer", None, 1),
    (NS + "p_size", "datatype", "size", [], NS + "Part", XSD + "integer", None, None),
    (NS + "p_brand", "datatype", "brand", [], NS + "Part", None, None, None),
    (NS + "o_orderdate", "datatype", "date", [], NS + "Order", XSD + "date", None, 1),
    (NS + "unused", "datatype", "unused", [], NS + "Ghost", XSD + "string", None, None),
]


def ontology(spark: SparkSession) -> Ontology:
    return Ontology.of(spark, CLASSES, PROPERTIES)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived graph as a set."""
    return as_graph(rows(spark, sf_dir))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its triples (s, p, o, k, dt), not yet rid of repeated ones: six tables, one scan each, and violations by rule on the keys:

    every 97th customer is a supplier too, every 50th has a second balance, every 41st a balance that is no number; every
    5th nation is pointed at by its region; every 89th order has a date without datatype.
    """
    t = lambda n: table(spark, sf_dir, n)
    customer = t("customer").withColumn("c_cents", F.round(F.col("c_acctbal") * 100).cast("bigint"))
    orders = t("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    parts = [
        table_triples(t("region"), "Region", "r_regionkey", RES, NS, "r_name"),
        table_triples(t("nation"), "Nation", "n_nationkey", RES, NS, "n_name", edges={"n_regionkey": "region"}),
        table_triples(customer, "Customer", "c_custkey", RES, NS, "c_name", {"c_mktsegment": "string", "c_cents": "integer"}, {"c_nationkey": "nation"}),
        table_triples(t("supplier"), "Supplier", "s_suppkey", RES, NS, "s_name", edges={"s_nationkey": "nation"}),
        table_triples(t("part"), "Part", "p_partkey", RES, NS, "p_name", {"p_size": "integer", "p_brand": "string"}),
        table_triples(orders.where("o_orderkey % 89 <> 0"), "Order", "o_orderkey", RES, NS, None, {"o_orderdate": "date"}, {"o_custkey": "customer"}),
        table_triples(orders.where("o_orderkey % 89 = 0"), "Order", "o_orderkey", RES, NS, None, {"o_orderdate": "string"}, {"o_custkey": "customer"}),
    ]
    c = F.concat(F.lit(RES + "customer/"), F.col("c_custkey").cast("string"))
    lit = lambda s, p, o, dt: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("literal").alias("k"), F.lit(dt).alias("dt"))
    odd = customer.select(
        F.explode(
            F.array(
                F.when(F.col("c_custkey") % 97 == 0, F.struct(c.alias("s"), F.lit(TYPE).alias("p"), F.lit(NS + "Supplier").alias("o"), F.lit("iri").alias("k"), F.lit(None).cast("string").alias("dt"))),
                F.when(F.col("c_custkey") % 50 == 0, lit(c, NS + "c_cents", (F.col("c_cents") + 1).cast("string"), XSD + "integer")),
                F.when(F.col("c_custkey") % 41 == 0, lit(c, NS + "c_cents", F.lit("about ten"), XSD + "integer")),
            )
        ).alias("r")
    )
    parts.append(odd.where("r IS NOT NULL").select("r.*"))
    n = t("nation").where("n_nationkey % 5 = 0")
    parts.append(n.select(F.concat(F.lit(RES + "region/"), F.col("n_regionkey").cast("string")).alias("s"), F.lit(NS + "n_regionkey").alias("p"), F.concat(F.lit(RES + "nation/"), F.col("n_nationkey").cast("string")).alias("o"), F.lit("iri").alias("k"), F.lit(None).cast("string").alias("dt")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rows(tbl: str, cls: str, key: str, label: str | None, literals: list[tuple[str, str, str]], edges: list[tuple[str, str]], where: str = "TRUE") -> list[str]:
    s = f"'{RES}{cls.lower()}/'||CAST({key} AS VARCHAR)"
    out = [f"SELECT {s} AS s, '{TYPE}' AS p, '{NS}{cls}' AS o, 'iri' AS k, CAST(NULL AS VARCHAR) AS dt FROM {tbl} WHERE {where}"]
    if label:
        out.append(f"SELECT {s}, '{LABEL}', {label}, 'literal', '{XSD}string' FROM {tbl} WHERE {where}")
    out += [f"SELECT {s}, '{NS}{c}', {e}, 'literal', '{XSD}{dt}' FROM {tbl} WHERE {where}" for c, e, dt in literals]
    out += [f"SELECT {s}, '{NS}{c}', '{RES}{target}/'||CAST({c} AS VARCHAR), 'iri', NULL FROM {tbl} WHERE {where}" for c, target in edges]
    return out


_CENTS = "CAST(CAST(ROUND(c_acctbal * 100) AS BIGINT) AS VARCHAR)"
_DATE = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"
_CUST = f"'{RES}customer/'||CAST(c_custkey AS VARCHAR)"

KG_SQL = "kg AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(
    [
        *_rows("region", "Region", "r_regionkey", "r_name", [], []),
        *_rows("nation", "Nation", "n_nationkey", "n_name", [], [("n_regionkey", "region")]),
        *_rows("customer", "Customer", "c_custkey", "c_name", [("c_mktsegment", "c_mktsegment", "string"), ("c_cents", _CENTS, "integer")], [("c_nationkey", "nation")]),
        *_rows("supplier", "Supplier", "s_suppkey", "s_name", [], [("s_nationkey", "nation")]),
        *_rows("part", "Part", "p_partkey", "p_name", [("p_size", "CAST(p_size AS VARCHAR)", "integer"), ("p_brand", "p_brand", "string")], []),
        *_rows("orders", "Order", "o_orderkey", None, [("o_orderdate", _DATE, "date")], [("o_custkey", "customer")], "o_orderkey % 89 <> 0"),
        *_rows("orders", "Order", "o_orderkey", None, [("o_orderdate", _DATE, "string")], [("o_custkey", "customer")], "o_orderkey % 89 = 0"),
        f"SELECT {_CUST}, '{TYPE}', '{NS}Supplier', 'iri', NULL FROM customer WHERE c_custkey % 97 = 0",
        f"SELECT {_CUST}, '{NS}c_cents', CAST(CAST(ROUND(c_acctbal * 100) AS BIGINT) + 1 AS VARCHAR), 'literal', '{XSD}integer' FROM customer WHERE c_custkey % 50 = 0",
        f"SELECT {_CUST}, '{NS}c_cents', 'about ten', 'literal', '{XSD}integer' FROM customer WHERE c_custkey % 41 = 0",
        f"SELECT '{RES}region/'||CAST(n_regionkey AS VARCHAR), '{NS}n_regionkey', '{RES}nation/'||CAST(n_nationkey AS VARCHAR), 'iri', NULL FROM nation WHERE n_nationkey % 5 = 0",
    ]
) + ") x WHERE o IS NOT NULL)"


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "CAST([" + ", ".join(map(_sql_value, v)) + "] AS VARCHAR[])"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in rows) + ")"


ONTO_SQL = _values("cls", "uri, label, disjoint", CLASSES) + ", " + _values("prop", "uri, kind, label, aliases, domain, range, min_card, max_card", PROPERTIES)

TYPES_SQL = f"""types AS (SELECT DISTINCT s, o AS c FROM kg WHERE p = '{TYPE}'),
inferred AS (SELECT * FROM types UNION SELECT s, domain FROM kg JOIN prop ON p = uri WHERE domain IS NOT NULL
  UNION SELECT o, range FROM kg JOIN prop ON p = uri WHERE k = 'iri' AND range IS NOT NULL AND NOT starts_with(range, '{XSD}'))"""

SUBCLASS = RDFS + "subClassOf"
