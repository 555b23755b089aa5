"""Readers of graph and document JSON and of text files; writers that refuse to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARM = "struct<groupId:string,armLabel:string>"
NODE = f"id string, type string, calleeFullName string, callerMethod string, code string, structureGroupId string, structureRole string, targetStructureGroupId string, transferKind string, line int, sourceFile string, implicitConstructor boolean, reason string, deadEnd boolean, exitKind string, branchArms array<{ARM}>, loopIds array<string>"
EDGE = f"`from` string, `to` string, type string, branchRequirements array<{ARM}>"
LOOP = "id string, kind string, method string, line int, conditionCode string, entryNodeId string, exitNodeId string"
CLASS = "fullName string, className string, package string, filename string, methodNames array<string>, memberNames array<string>, identifiers array<string>, comments array<string>, literals array<string>"
METHOD = "fullName string, methodName string, identifiers array<string>, comments array<string>, literals array<string>"


STAGE = "struct<id:string,nodeIds:array<string>,decisionNodeId:string>"
ARM_OF = "struct<label:string,empty:boolean,conditionCode:string,exceptionType:string,exits:array<struct<kind:string,destinationNodeId:string>>,conditionStages:array<struct<stageId:string,nodeIds:array<string>,outcome:string>>>"
BRANCH = f"id string, kind string, method string, line int, entryNodeId string, exitNodeId string, conditionStages array<{STAGE}>, enclosingRequirements array<{ARM}>, arms array<{ARM_OF}>"
FEATURES = "receiver string, receiverType string, outputType string, role string, arguments array<string>, argumentTypes array<string>, inputIdentifiers array<string>, fieldsRead array<string>, fieldsWritten array<string>, domainTypes array<string>, methodTerms array<string>, observedFeatures array<string>"
#: Columns of each table that hold ids of nodes or groups.
IDS = {
    "nodes": ("id", "structureGroupId", "targetStructureGroupId"),
    "edges": ("src", "dst"),
    "branch_groups": ("id", "entryNodeId", "exitNodeId"),
    "loop_groups": ("id", "entryNodeId", "exitNodeId"),
    "semantic_features": ("node_id",),
}


def _struct(fields: str) -> str:
    """The type of a struct with the columns of a DDL list."""
    return StructType.fromDDL(fields).simpleString()


def _rows(raw: DataFrame, column: str) -> DataFrame:
    out = raw.select(F.input_file_name().alias("repo_id"), F.posexplode(column).alias("pos", "x")).select("repo_id", "pos", "x.*")
    return _filled(out)


def _filled(out: DataFrame) -> DataFrame:
    """Missing lists are empty."""
    return out.select(*(F.coalesce(F.col(f"`{n}`"), F.array().cast(k)).alias(n) if k.startswith("array") else F.col(f"`{n}`") for n, k in out.dtypes))


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``nodes``, ``edges(src, dst, type, reqs)``, ``branch_groups``, ``loop_groups`` and ``semantic_features`` of graph JSON files; ``pos`` keeps the order.

    ``repo_id`` is the file. Missing lists are empty.
    """
    schema = f"nodes array<{_struct(NODE)}>, edges array<{_struct(EDGE)}>, branchGroups array<{_struct(BRANCH)}>, loopGroups array<{_struct(LOOP)}>, semanticFeatures map<string,{_struct(FEATURES)}>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    edges = _rows(raw, "edges").withColumnsRenamed({"from": "src", "to": "dst", "branchRequirements": "reqs"})
    features = _filled(raw.select(F.input_file_name().alias("repo_id"), F.explode("semanticFeatures").alias("node_id", "x")).select("repo_id", "node_id", "x.*"))
    branches = _rows(raw, "branchGroups").withColumnRenamed("enclosingRequirements", "enclosing")
    return {"nodes": _rows(raw, "nodes"), "edges": edges, "branch_groups": branches, "loop_groups": _rows(raw, "loopGroups"), "semantic_features": features}


def scoped(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of ``read_graph`` with the repository in every id of a node or group, so that equal ids of two files never meet.

    Method names stay as they are; operators that join by name take ``by=("repo_id",)``.
    """
    name = lambda c: F.concat_ws("#", "repo_id", c)
    guards = lambda c: F.transform(c, lambda r: r.withField("groupId", name(r["groupId"])))
    some = lambda c: F.when(c.isNotNull(), name(c))
    out = {table: df.withColumns({c: some(F.col(c)) for c in IDS[table]}) for table, df in tables.items()}
    out["nodes"] = out["nodes"].withColumns({"branchArms": guards("branchArms"), "loopIds": F.transform("loopIds", name)})
    out["edges"] = out["edges"].withColumn("reqs", guards("reqs"))
    exits = lambda a: F.transform(a["exits"], lambda x: x.withField("destinationNodeId", some(x["destinationNodeId"])))
    stages = lambda c: F.transform(c, lambda x: x.withField("nodeIds", F.transform(x["nodeIds"], name)))
    arms = F.transform("arms", lambda a: a.withField("exits", exits(a)).withField("conditionStages", stages(a["conditionStages"])))
    told = F.transform(stages("conditionStages"), lambda x: x.withField("decisionNodeId", some(x["decisionNodeId"])))
    out["branch_groups"] = out["branch_groups"].withColumns({"enclosing": guards("enclosing"), "arms": arms, "conditionStages": told})
    return out


def read_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``classes`` and ``methods`` of evidence JSON files."""
    raw = spark.read.schema(f"classes array<{_struct(CLASS)}>, methods array<{_struct(METHOD)}>").option("multiLine", True).json(path)
    return {"classes": _rows(raw, "classes"), "methods": _rows(raw, "methods")}


def scan_texts(spark: SparkSession, root: str, *, where: str = "upper(name) like 'README%' or lower(name) like '%.md'") -> DataFrame:
    """``(path, name, n_bytes, text)`` of files below ``root`` whose ``name`` meets the condition, UTF-8 with replacement."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content").where(where)
    return named.select("path", "name", F.length("content").alias("n_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_table(df: DataFrame, path: str, *, kind: str = "json") -> None:
    """Write once: an existing target is an error. JSON leaves out null fields and empty lists."""
    if kind == "json":
        df = df.select(*(F.when(F.size(c) > 0, F.col(c)).alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes))
    df.write.mode("errorifexists").format(kind).save(path)
