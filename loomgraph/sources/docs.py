"""Exchange documents, tool outputs and fixed-header tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start_pos:int,end_pos:int,surface_form:string,text:string,mapping:string>"
ER = "matches array<struct<id_1:string,id_2:string,score:double,id_type:string>>, blocks array<struct<entities:array<string>,block_key:string>>, clusters array<struct<entities:array<string>>>"
TE = f"text string, triples array<struct<subject:{SPAN},predicate:{SPAN},object:{SPAN}>>, chains array<struct<main:string,aliases:array<{SPAN}>>>, links array<struct<span:string,mapping:string,link_type:string,score:double>>"

#: Prefixes of matcher output: fixed values.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#", "foaf": "http://xmlns.com/foaf/0.1/", "dbr": "http://dbpedia.org/resource/", "dbo": "http://dbpedia.org/ontology/",
}

HEADERS = {
    "verified_matches": "left_dataset string, right_dataset string, left_id string, right_id string, entity_type string",
    "verified_entities": "dataset string, entity_id string, entity_label string, entity_type string",
    "verified_links": "doc_id string, entity_id string, entity_type string, dataset string",
}


def doc_name(c=None):
    """File name without directory and without what follows the first dot."""
    return F.substring_index(F.substring_index(F.url_decode(c if c is not None else F.input_file_name()), "/", -1), ".", 1)


def read_er(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ER).json(path, multiLine=True)


def er_matches(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("matches").alias("m")).select("m.*")


def read_te(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TE).json(path, multiLine=True).withColumn("doc_id", doc_name())


def te_triples(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("triples").alias("t")).select("doc_id", F.col("t.subject.surface_form").alias("subject"), F.col("t.predicate.surface_form").alias("predicate"), F.col("t.object.surface_form").alias("object"))


def te_links(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("links").alias("l")).select("doc_id", "l.*")


def te_chains(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("chains").alias("c")).select("doc_id", F.col("c.main").alias("main"), F.explode("c.aliases").alias("a")).select("doc_id", "main", F.col("a.surface_form").alias("alias"))


def er_document(matches: DataFrame) -> DataFrame:
    """One JSON document (column value) of a match table, for exchange of small results."""
    return matches.select(F.to_json(F.struct(F.array(F.struct("id_1", "id_2", "score", "id_type")).alias("matches"))).alias("value"))


def te_document(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select("doc_id", F.to_json(F.struct(*columns)).alias("value"))


def spotlight_links(docs: DataFrame, key: str = "doc_id", text: str = "text", min_score: float | None = None) -> DataFrame:
    """Links of entity spotting output: Resources[] with surface form, URI and similarity score."""
    x = docs.select(key, F.explode(F.from_json(text, "Resources array<map<string,string>>").Resources).alias("r"))
    out = x.select(key, F.element_at("r", "@surfaceForm").alias("span"), F.element_at("r", "@URI").alias("mapping"), F.lit("entity").alias("link_type"), F.element_at("r", "@similarityScore").try_cast("double").alias("score"))
    return out.where(F.col("score") >= min_score) if min_score is not None else out


def falcon_json_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links of entity and relation linking output; the score is fixed at 1."""
    j = F.from_json(text, "entities_wikidata array<map<string,string>>, relations_wikidata array<map<string,string>>")
    x = docs.select(key, j.alias("j"))
    side = lambda field, kind: x.select(key, F.explode(f"j.{field}").alias("r")).select(key, F.element_at("r", "surface form").alias("span"), F.element_at("r", "URI").alias("mapping"), F.lit(kind).alias("link_type"), F.lit(1.0).alias("score"))
    return side("entities_wikidata", "entity").unionByName(side("relations_wikidata", "relation"))


OPENIE = "sentences array<struct<openie:array<struct<subject:string,relation:string,object:string>>,tokens:array<struct<characterOffsetBegin:int,characterOffsetEnd:int>>>>, corefs map<string,array<struct<text:string,sentNum:int,startIndex:int,endIndex:int>>>"


def openie(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """{triples, chains} of open extraction output; chains need two mentions or more, offsets come from the token arrays."""
    x = docs.select(key, F.from_json(text, OPENIE).alias("j"))
    t = x.select(key, F.explode("j.sentences").alias("s")).select(key, F.explode("s.openie").alias("t")).select(key, "t.subject", F.col("t.relation").alias("predicate"), "t.object")
    c = x.select(key, F.col("j.sentences").alias("ss"), F.explode("j.corefs").alias("cid", "mentions")).where("size(mentions) >= 2")
    c = c.select(key, "cid", F.col("mentions")[0]["text"].alias("main"), "ss", F.explode("mentions").alias("m"))
    tok = lambda i: F.get(F.get(F.col("ss"), F.col("m.sentNum") - 1)["tokens"], i)
    chains = c.select(key, "cid", "main", F.col("m.text").alias("alias"), tok(F.col("m.startIndex") - 1)["characterOffsetBegin"].alias("start"), tok(F.col("m.endIndex") - 2)["characterOffsetEnd"].alias("end"))
    return {"triples": t, "chains": chains}


def expand(c):
    """Prefixed names in full; an unknown prefix is an error."""
    table = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    prefix = F.substring_index(c, ":", 1)
    known = F.element_at(table, prefix)
    full = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown prefix: "), prefix)).cast("string"))
    return F.when(c.contains("://") | ~c.contains(":"), c).otherwise(F.concat(full, F.substring(c, F.length(prefix) + 2, F.length(c))))


def matcher_directory(spark: SparkSession, path: str) -> DataFrame:
    """Matches of an iterative matcher's directory: the last non-empty `N_eqv.tsv`, and the relations of iteration N-1 both ways."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = {s.getPath().getName(): s.getLen() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)}
    done = sorted((int(n.split("_")[0]) for n, size in files.items() if n.endswith("_eqv.tsv") and size > 0), reverse=True)
    empty = spark.createDataFrame([], "id_1 string, id_2 string, score double, id_type string")
    if not done:
        return empty

    def rows(name: str, kind: str, turn: bool) -> DataFrame:
        if not files.get(name):
            return empty
        x = spark.read.text(f"{path}/{name}").select(F.split("value", "\t").alias("f")).where("size(f) = 3")
        a, b = expand(F.col("f")[0]), expand(F.col("f")[1])
        return x.select((b if turn else a).alias("id_1"), (a if turn else b).alias("id_2"), F.col("f")[2].try_cast("double").alias("score"), F.lit(kind).alias("id_type"))

    n = done[0]
    return rows(f"{n}_eqv.tsv", "entity", False).unionByName(rows(f"{n - 1}_superrelations1.tsv", "relation", False)).unionByName(rows(f"{n - 1}_superrelations2.tsv", "relation", True))


def read_fixed(spark: SparkSession, path: str, kind: str, sep: str = "\t") -> DataFrame:
    """A table with a fixed header; another header is an error."""
    want = [c.split()[0] for c in HEADERS[kind].split(", ")]
    first = spark.read.text(path).first()
    if first is None or first[0].split(sep) != want:
        raise ValueError(f"{path}: header is not {want}")
    return spark.read.csv(path, sep=sep, header=True, schema=HEADERS[kind])


def entity_dict(rows: DataFrame, col: str = "value", sep: str = ",") -> DataFrame:
    """Lines of 1, 2 or 3 fields as (id, label, type): one field is id and label; more than three are an error."""
    f = F.split(col, sep)
    n = F.size(f)
    checked = F.when(n > 3, F.raise_error(F.lit("more than three fields")).cast("string")).otherwise(F.trim(f[0]))
    return rows.select(checked.alias("id"), F.when(n >= 2, F.trim(F.get(f, F.lit(1)))).otherwise(F.trim(f[0])).alias("label"), F.when(n == 3, F.trim(F.get(f, F.lit(2)))).alias("type"))


def truth_matches(spark: SparkSession, path: str, target: str, exact: bool = True) -> DataFrame:
    """Header-less five-column matches, filtered on the target dataset by equality or substring."""
    x = spark.read.csv(path, sep="\t", schema=HEADERS["verified_matches"])
    return x.where(F.col("right_dataset") == target if exact else F.col("right_dataset").contains(target))


def cluster_pairs(lines: DataFrame, col: str = "value") -> DataFrame:
    """(a, b) of cluster lines: cells by tab, semicolon or comma, blanks dropped; a line links each member to its first."""
    sep = F.when(F.col(col).contains("\t"), "\t").when(F.col(col).contains(";"), ";").otherwise(",")
    cells = F.filter(F.transform(F.split(F.regexp_replace(F.col(col), "[\t;,]", "\x1f"), "\x1f"), lambda x: F.trim(x)), lambda x: x != "")
    return lines.where(sep.isNotNull()).select(cells.alias("c")).where("size(c) >= 2").select(F.col("c")[0].alias("a"), F.explode(F.expr("slice(c, 2, size(c))")).alias("b"))


def eval_results(docs: DataFrame, col: str = "value") -> DataFrame:
    """(doc, metric, measurement, unit, value) of evaluation JSON; measurements without a name are skipped."""
    schema = "array<struct<metric:string,summary:string,measurements:array<struct<name:string,value:string,unit:string>>>>"
    x = docs.select("doc", F.explode(F.from_json(col, schema)).alias("m")).select("doc", F.col("m.metric").alias("metric"), F.explode("m.measurements").alias("x"))
    return x.where("x.name IS NOT NULL").select("doc", "metric", F.col("x.name").alias("measurement"), F.col("x.unit").alias("unit"), F.col("x.value").alias("value"))


def eval_table(rows: DataFrame, allowed: list[str] | None = None, digits: int = 3) -> DataFrame:
    """One row per document, columns metric__measurement__unit, numbers rounded."""
    name = F.concat_ws("__", "metric", "measurement", F.nullif(F.col("unit"), F.lit("")))
    x = rows.select("doc", name.alias("c"), F.round(F.col("value").try_cast("double"), digits).alias("v"))
    g = x.groupBy("doc")
    return (g.pivot("c", allowed) if allowed else g.pivot("c")).agg(F.max("v"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per file: (doc_id, text)."""
    return spark.read.text(path, wholetext=True).select(doc_name().alias("doc_id"), F.col("value").alias("text"))


def read_metrics(spark: SparkSession, glob: str) -> DataFrame:
    from ..plans.report import LONG

    return spark.read.csv(glob, header=True, schema=LONG, escape='"')


def read_dataset(spark: SparkSession, root: str) -> dict[str, dict[str, str]]:
    """Paths of a benchmark directory: split -> {index, seed, reference, sources/rdf, sources/json, sources/text} that exist."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, dict[str, str]] = {}
    for s in fs.listStatus(fs_path(root)):
        split = s.getPath().getName()
        if s.isDirectory():
            parts = ("index", "seed", "reference", "sources/rdf", "sources/json", "sources/text")
            out[split] = {p: f"{root}/{split}/{p}" for p in parts if fs.exists(fs_path(f"{root}/{split}/{p}"))}
    return out


def replace_terms(lines: DataFrame, mapping: dict[str, str], col: str = "value") -> DataFrame:
    c = F.col(col)
    for a, b in mapping.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return lines.withColumn(col, c)
