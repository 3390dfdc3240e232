"""Readers: analysis facts, call graphs, mappings, runtime results, logs and name lists as DataFrames.

Schemas are declared, unknown fields are ignored and malformed elements are null; `require` refuses what no query can use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCATION = "struct<file:string,line:bigint,column:bigint>"
ANALYSIS = f"""version int, functions array<struct<name:string,entryBlockId:bigint,exitBlockId:bigint,attributes:struct<
  callsStateChange:boolean,returnsPointerLike:boolean,stateChangeParameterValues:array<array<string>>,addressTakenFunctions:array<string>,
  callSites:array<struct<callSiteId:string,calleeExpression:string,directCallee:string,throughIdentifier:string,argumentExpressions:array<string>,isIndirect:boolean,location:{LOCATION}>>,
  parameterNames:array<string>,pointerAssignments:array<struct<lhsExpression:string,rhsExpression:string,assignedFunction:string,rhsTakesFunctionAddress:boolean,lhsIsGlobal:boolean,location:{LOCATION}>>,
  structMemberMappings:array<struct<structVariable:string,memberName:string,functionName:string,location:{LOCATION}>>>,
  blocks:array<struct<id:bigint,lines:array<string>,lineCallSiteIds:array<array<string>>,successors:array<bigint>>>>>"""
EDGES = "array<struct<caller:string,callee:string,kind:string>>"
CALLGRAPH = f"kind string, input string, edges {EDGES}, collapsedCallGraph struct<nodes:array<string>,edges:{EDGES}>"
MAPPING = "kind string, schemaVersion int, entries array<struct<signature:struct<caller:string,calleeExprNorm:string,throughNorm:string,argCount:bigint,member:string>,targets:array<string>>>"
RUNTIME = """contextProcessing struct<contexts:array<struct<contextId:string,entrypoint:string,parentContextId:string,ordinal:bigint,
  calls:array<struct<eventIndex:bigint,line:bigint,caller:string,callerDepth:bigint,callee:string>>>>>"""


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def require(rows: DataFrame, condition: str, message: str) -> DataFrame:
    """rows, or ValueError where a row fails the condition."""
    if rows.where(f"not coalesce({condition}, false)").take(1):
        raise ValueError(message)
    return rows


def functions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each definition: fn, def_pos and the nested facts."""
    doc = require(read_document(spark, path, ANALYSIS), "functions is not null", "no functions in the analysis")
    return doc.select(F.posexplode("functions").alias("def_pos", "f")).where("f.name is not null").select(F.col("f.name").alias("fn"), F.col("def_pos").cast("long"), "f")


def call_sites(fns: DataFrame) -> DataFrame:
    site = fns.select("fn", F.posexplode("f.attributes.callSites").alias("pos", "s"))
    return site.select(
        "fn", F.col("pos").cast("long"), F.col("s.callSiteId").alias("site"), F.col("s.calleeExpression").alias("callee_expression"), F.col("s.directCallee").alias("direct"),
        F.col("s.throughIdentifier").alias("through"), F.col("s.argumentExpressions").alias("args"), F.col("s.isIndirect").alias("is_indirect"), F.col("s.location").alias("location"))


def pointer_assignments(fns: DataFrame) -> DataFrame:
    return fns.select("fn", F.posexplode("f.attributes.pointerAssignments").alias("pos", "a")).select("fn", F.col("pos").cast("long"), "a.*")


def member_mappings(fns: DataFrame) -> DataFrame:
    return fns.select("fn", F.posexplode("f.attributes.structMemberMappings").alias("pos", "m")).select("fn", F.col("pos").cast("long"), "m.*")


def blocks(fns: DataFrame) -> DataFrame:
    """fn, block, succ (null where there is none)."""
    return fns.select("fn", F.explode("f.blocks").alias("b")).select("fn", F.col("b.id").alias("block"), F.explode_outer("b.successors").alias("succ"))


def block_calls(fns: DataFrame) -> DataFrame:
    """fn, block, line_pos, call_pos, site, callee: direct call sites in their order."""
    line = fns.select("fn", F.explode("f.blocks").alias("b")).select("fn", F.col("b.id").alias("block"), F.posexplode("b.lineCallSiteIds").alias("line_pos", "ids"))
    call = line.select("fn", "block", "line_pos", F.posexplode("ids").alias("call_pos", "site"))
    return call.join(call_sites(fns).where("direct <> ''").select("fn", "site", F.col("direct").alias("callee")), ["fn", "site"])


def direct_edges(fns: DataFrame) -> DataFrame:
    return call_sites(fns).where("direct <> ''").select(F.col("fn").alias("caller"), F.col("direct").alias("callee"), F.lit("direct").alias("kind"))


def static_edges(spark: SparkSession, path: str) -> DataFrame:
    """caller, callee, kind of a call graph; a top-level edge list serves where the collapsed graph is missing."""
    doc = read_document(spark, path, CALLGRAPH).select(F.coalesce("collapsedCallGraph.edges", "edges").alias("edges"))
    return require(doc, "edges is not null", "no edges in the call graph").select(F.explode("edges").alias("e")).select("e.*").where("caller <> '' and callee <> ''").distinct()


def runtime_calls(spark: SparkSession, path: str) -> DataFrame:
    """context, entrypoint, event_index, caller, depth, callee; a result without contexts gives no rows."""
    context = read_document(spark, path, RUNTIME).select(F.explode("contextProcessing.contexts").alias("c"))
    call = context.select(F.col("c.contextId").alias("context"), F.col("c.entrypoint").alias("entrypoint"), F.explode("c.calls").alias("k"))
    return call.select("context", "entrypoint", F.col("k.eventIndex").alias("event_index"), F.col("k.caller").alias("caller"), F.col("k.callerDepth").alias("depth"), F.col("k.callee").alias("callee"))


def indirect_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The signature's parts and target, repeated signatures joined."""
    doc = require(read_document(spark, path, MAPPING), "kind = 'indirect-call-mapping' and schemaVersion = 2", "no mapping of version 2")
    return doc.select(F.explode("entries").alias("e")).select("e.signature.*", F.explode("e.targets").alias("target")).distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, part, line_number (from 1 in each file), value of text files.

    Files are read in byte ranges; part is where the line's range begins. Lines count from the first of their range, and ranges from
    the sums of the lines before, one row for each range, so no file is gathered anywhere.
    """
    line = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), "value").withColumn("at", F.monotonically_increasing_id())
    size = line.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = line.join(size.withColumn("before", before), ["file", "part"])
    return told.select("file", "part", (F.col("before") + F.col("at") - F.col("first") + 1).cast("long").alias("line_number"), "value")


def name_list(spark: SparkSession, path: str, dialect: str = "lines") -> DataFrame:
    """name, pos. 'lines': one trimmed name a line, # starts a comment. 'words': several names a line, # starts a comment. 'plain': right-trimmed lines as they are."""
    line = numbered_lines(spark, path).select((F.col("line_number") - 1).alias("pos"), "value")
    if dialect == "words":
        line = line.select("pos", F.explode(F.split(F.regexp_replace("value", "#.*", ""), r"\s+")).alias("name"))
    elif dialect == "plain":
        line = line.select("pos", F.regexp_replace("value", r"\s+$", "").alias("name"))
    else:
        line = line.select("pos", F.regexp_replace(F.regexp_replace("value", "#.*", ""), r"^\s+|\s+$", "").alias("name"))
    return line.where("name <> ''").groupBy("name").agg(F.min("pos").cast("long").alias("pos"))


def log_events(lines: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """lines: trace, line_number, value, and part, if a trace's lines come in parts that follow each other. entrypoints: name. The kept lines as events; a marker of an undeclared name is a plain token.

    Events are counted within their part, and parts by the sums of the events before.
    """
    lines = lines if "part" in lines.columns else lines.withColumn("part", F.lit(0).cast("long"))
    kept = lines.withColumn("raw_token", F.regexp_replace("value", r"^\s+|\s+$", "")).where("raw_token <> '' and not startswith(raw_token, '#')")
    base, mark = F.regexp_extract("raw_token", r"^(.*)_(entry|exit)$", 1), F.regexp_extract("raw_token", r"^(.*)_(entry|exit)$", 2)
    kept = kept.withColumns({"base": base, "mark": mark}).join(entrypoints.select(F.col("name").alias("base"), F.lit(True).alias("known")).distinct(), "base", "left")
    size = kept.groupBy("trace", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("trace").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("trace", "part").orderBy("line_number")) - 1
    return kept.withColumn("place", place).join(size.select("trace", "part", before.alias("before")), ["trace", "part"]).select(
        "trace", (F.col("before") + F.col("place")).cast("long").alias("event_index"), "line_number", "raw_token",
        F.expr("case when known and mark = 'entry' then 'Entry' when known and mark = 'exit' then 'Exit' else 'Plain' end").alias("kind"),
        F.expr("case when known then base else raw_token end").alias("base_name"))


def read_log(spark: SparkSession, path: str, entrypoints: DataFrame) -> DataFrame:
    """Each file of path is a trace (numbered by its name's hash); line numbers count from 1, dropped lines included."""
    return log_events(numbered_lines(spark, path).select(F.xxhash64("file").alias("trace"), "part", "line_number", "value"), entrypoints)


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the C files under path, sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return found.where(F.col("path").rlike(r"(?i)\.[ch]$")).distinct().orderBy("path")
