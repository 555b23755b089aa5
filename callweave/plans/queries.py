"""Queries over the test tables, one or more for each family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.functions import names, text
from callweave.functions.guards import no_guards
from callweave.functions.signature import overlap
from callweave.operators import batches, branches, bundle, cycles, gates, graph, instances, methods, phases, reports, scoping, slices, topics, validate
from callweave.plans.oracles import SQL


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per event with its guard from props."""
    k = F.get_json_object("props", "$.k").cast("int")
    guard = F.struct(F.concat(F.lit("g"), F.floor(k / 10).cast("string")).alias("groupId"), (k % 2).cast("string").alias("armLabel"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", F.col("event_type").alias("callee"), "value", F.array(guard).alias("reqs"))


def sequence_edges(rows: DataFrame) -> DataFrame:
    nxt = F.lead("id").over(W.partitionBy("user_id").orderBy("ts", "id"))
    return rows.select(F.col("id").alias("src"), nxt.alias("dst"), F.lit("sequence").alias("type"), "reqs").where("dst is not null")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return pairs.where("dst is not null").distinct()


def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order and are of one brand, from the smaller to the larger key."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = W.partitionBy("l_orderkey", "p_brand").orderBy("l_linenumber", "l_partkey")
    pairs = rows.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b")).where("b is not null and a <> b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoke edges region -> nation -> customer -> order, ids with prefixes."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = read(spark, sf_dir, "nation").select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst"))
    b = read(spark, sf_dir, "customer").select(tag("n", "c_nationkey").alias("src"), tag("c", "c_custkey").alias("dst"))
    c = read(spark, sf_dir, "orders").select(tag("c", "o_custkey").alias("src"), tag("o", "o_orderkey").alias("dst"))
    return a.unionByName(b).unionByName(c)


def turns(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Signatures of conversation turns: inputs are tokens of three and more, arguments of six and more characters."""
    found = lambda n: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"([a-z0-9_]{{{n},}})"), F.lit(1))))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", *more, found(3).alias("inputs"), found(6).alias("arguments"))


def digits(column: Column) -> Column:
    return F.round(column, 6)


def bridge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: view events are noise; sequence edges are spliced around them and counted by event types."""
    rows = calls(spark, sf_dir).withColumn("reqs", no_guards())
    edges = graph.bridge(sequence_edges(rows), rows.where("callee = 'view'").select("id"))
    kind = rows.select("id", "callee")
    named = edges.join(kind.withColumnsRenamed({"id": "src", "callee": "from_type"}), "src").join(kind.withColumnsRenamed({"id": "dst", "callee": "to_type"}), "dst")
    return named.groupBy("from_type", "to_type").agg(F.count("*").alias("n"))


def bridge_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    edges = graph.bridge(sequence_edges(rows), rows.where("callee = 'view'").select("id"))
    said = F.array_join(F.transform("reqs", lambda r: F.concat_ws("=", r["groupId"], r["armLabel"])), ",")
    return edges.select("src", "dst", said.alias("guards"))


def call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    nodes = rows.select("id", F.when(F.col("callee") == "view", "structure").otherwise("call").alias("type"), F.col("user_id").alias("callerMethod"))
    found = graph.call_pairs(nodes, sequence_edges(rows))
    return found.groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"))


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).withColumn("reqs", no_guards())
    nodes = rows.select("id", F.lit("call").alias("type"), "callee")
    kept, edges = graph.filter_noise(nodes, sequence_edges(rows), F.col("callee").isin("view", "error"))
    ends = edges.groupBy(F.col("src").alias("id")).agg(F.max("dst").alias("next"))
    return kept.join(ends, "id", "left").select("id", "callee", "next")


def reach_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("id"))
    return graph.reach_folded(brand_edges(spark, sf_dir), roots).groupBy("root").agg(F.count("*").alias("n"))


def reach_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root")).withColumn("id", F.col("root"))
    return graph.reach(tree_edges(spark, sf_dir), roots).groupBy("root", "level").agg(F.count("*").alias("n"))


def depth_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("id"))
    back = brand_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(back, roots, max_depth=2).groupBy("root").agg(F.count("*").alias("n"), F.max("level").alias("deepest"))


def roots_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    entries = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("id"), F.lit("entry").alias("type"), F.concat(F.lit("c"), key).alias("calleeFullName"), F.lit(None).cast("string").alias("callerMethod"))
    own = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("call").alias("type"), F.lit("x").alias("calleeFullName"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("callerMethod"))
    edges = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("n").alias("src"), F.concat(F.lit("c"), key).alias("dst"), F.lit("invoke").alias("type"))
    return graph.roots_and_orphans(entries.unionByName(own), edges)


def callers_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    into = graph.callers(parts, edges)
    out = graph.callees(edges, parts)
    return into.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.size("callers").cast("long").alias("n_callers"), F.get("callers", F.lit(0)).alias("first_caller"), F.coalesce(F.size("targets"), F.lit(0)).cast("long").alias("n_targets"))


def peel_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.peel(tree_edges(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


def part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order and are of one brand are linked."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = W.partitionBy("l_orderkey", "p_brand").orderBy("l_linenumber", "l_partkey")
    pairs = rows.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null and src <> dst")
    return graph.components(pairs)


def linear_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    found = graph.linear_runs(sequence_edges(rows), rows.where("callee <> 'view'").select("id", F.col("id").alias("rank")))
    return found.groupBy("run").agg(F.count("*").alias("n"), F.max("position").cast("long").alias("last"))


def expand_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tree_edges(spark, sf_dir).select(F.col("src").alias("method"), F.col("dst").alias("call"), F.col("dst").alias("target"))
    starts = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("method"))
    return graph.expand(starts, edges, max_depth=3).select("root", "method", "depth", F.array_join("path", "/").alias("path"))


def effective_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tree_edges(spark, sf_dir).select(F.col("src").alias("method"), F.col("dst").alias("call"), F.col("dst").alias("target"))
    methods = edges.select("method").distinct().withColumn("own", F.lit(1))
    return phases.effective_counts(methods, edges)


def name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat(F.element_at(F.array(*map(F.lit, ("com.acme.", "java.util.", "javax.", "com.acme.X$1.", "x.<operator>."))), (F.col("p_partkey") % 5 + 1).cast("int")),
                 F.element_at(F.array(*map(F.lit, ("run:void()", "access$", "lambda$a$", "<lambda>"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_size").cast("string"))
    rows = read(spark, sf_dir, "part").select("p_partkey", n.alias("name"))
    c = F.col("name")
    return rows.select("p_partkey", names.is_noise(c).alias("noise"), names.is_lambda(c).alias("lambda"), names.is_stripped_call(c).alias("stripped"), names.is_builtin(c).alias("builtin"), names.compact_name(c).alias("compact"))


def split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.concat_ws("_", F.initcap("p_name"), F.lit("HTTPServer2Foo"), F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_identifier(term), " ").alias("words"))


def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    done = rows.select("doc_id", text.preprocess_document(F.array("text", F.lit("x.<init>")), text.stop_words()).alias("words"))
    return done.select("doc_id", F.length("words").cast("long").alias("n_chars"), F.md5(F.encode("words", "UTF-8")).alias("digest"))


def doc_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")
    return topics.best_readmes(rows).select("doc_id", "path")


def ctfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = topics.term_counts(read(spark, sf_dir, "documents"), cluster="source", token=topics.ASCII_TOKEN)
    return topics.top_terms(topics.class_tfidf(counts).withColumn("score", F.round("score", 10))).select("cluster", "term", digits(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topics.centroids(read(spark, sf_dir, "embeddings"))
    return found.select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), digits(F.col("x")).alias("x"))


def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return topics.assign_topics(rows, topics.centroids(rows), key="vec_id").select("vec_id", "label", digits(F.col("similarity")).alias("similarity"))


def knn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.knn(read(spark, sf_dir, "embeddings")).select("vec_id", "neighbour", F.col("rank").cast("long").alias("rank"), digits(F.col("similarity")).alias("similarity"))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.density_clusters(read(spark, sf_dir, "embeddings"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"))
    members = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.when(F.col("quality") == 0, -1).otherwise(F.col("toxic")).alias("label"))
    return topics.coverage(docs, members).withColumn("coverage", digits(F.col("coverage")))


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("package"))


def package_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _packages(spark, sf_dir).select(F.col("page_id").alias("label"), "package")
    docs = members.select(F.explode(F.array(F.substring_index("package", ".", 2), F.substring_index("package", ".", 3))).alias("package")).distinct().withColumn("path", F.col("package"))
    return topics.attach_readmes(members, docs)


def package_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir).withColumn("top", F.substring_index("package", ".", 2))
    return topics.common_prefix(rows, by="top")


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("conv_id").orderBy("turn", "role", "inputs")
    rows = turns(spark, sf_dir).withColumn("p", F.lag("inputs").over(order)).withColumn("q", F.lag("arguments").over(order)).where("p is not null")
    return rows.select("conv_id", "turn", digits(overlap(F.col("p"), F.col("inputs"))).alias("inputs"), digits(overlap(F.col("q"), F.col("arguments"))).alias("arguments"))


def core_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phases.core_signature(turns(spark, sf_dir), by="conv_id", values="inputs")
    return found.select("conv_id", F.array_join("core", " ").alias("core"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = turns(spark, sf_dir).withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "inputs")))
    observed = F.array(*map(F.lit, ("receivers", "inputs", "arguments")))
    sig = rows.select(F.col("conv_id").alias("run"), "pos", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("pos").cast("string")).alias("id"), F.array("role").alias("receivers"), "inputs", "arguments", *(none.alias(c) for c in ("fields_read", "fields_written", "domain_types", "method_terms", "output_types")), observed.alias("observed"), F.lit(False).alias("flow"), F.lit(False).alias("retained"))
    found, _ = phases.segment_runs(sig)
    return found.select("run", F.col("pos").cast("long").alias("pos"), F.col("phase").cast("long").alias("phase"))


def method_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are methods, turns their calls; from the third turn on, pairs of turns lie in arms by their role. Held against a plain reading in the tests."""
    rows = turns(spark, sf_dir).groupBy("conv_id", "turn").agg(F.min(F.struct("role", "inputs", "arguments")).alias("x")).select("conv_id", "turn", "x.*")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    arm = F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.lit("g"), F.floor(F.col("turn") / 2).cast("string")).alias("groupId"), F.col("role").alias("armLabel"))
    none = F.array().cast("array<string>")
    path = F.when(F.col("turn") >= 2, F.array(arm)).otherwise(no_guards())
    made = rows.select(F.col("conv_id").alias("method"), key.alias("id"), F.col("turn").cast("int").alias("rank"), F.when(F.col("turn") >= 2, F.floor(F.col("turn") / 2)).otherwise(0).cast("string").alias("run"), path.alias("arm_path"), F.lit(True).alias("eligible"), (F.col("turn") % 11 == 10).alias("retained"))
    observed = F.array(*map(F.lit, ("receivers", "inputs", "arguments")))
    signed = rows.select(key.alias("id"), F.array("role").alias("receivers"), "inputs", "arguments", *(none.alias(c) for c in ("fields_read", "fields_written", "domain_types", "method_terms", "output_types")), observed.alias("observed"))
    found, _ = methods.analyse_methods(made, signed, made.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0))
    return found.select("method", "id", "phase", F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"))


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "/* open\nstill\n*/\n").otherwise("// one\n\n"), F.col("text")).alias("text"))
    return reports.line_stats(rows, key="doc_id")


def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return batches.pack(rows, key="source", order="doc_id", size="size", max_items=32).withColumn("batch", F.col("batch").cast("long"))


def correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return batches.correlate(rows.where("conv_id % 3 <> 0").select(F.col("conv_id").alias("id")), rows.where("turn < 2").select(F.col("conv_id").alias("id")))


def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of every whole text as a label in quotes."""
    phrases = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "[.,\n]+")).alias("pos", "phrase"))
    done = phrases.select("conv_id", "turn", "role", F.col("pos").cast("long").alias("pos"), text.normalise_label(F.concat(F.lit(' "'), "phrase", F.lit('"'))).alias("label"))
    return done.select("conv_id", "turn", "role", "pos", "label", text.valid_label(F.col("label")).alias("phase_ok"), text.valid_topic_label(F.col("label")).alias("topic_ok"))


def comment_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: events between the first and the last purchase of their user."""
    rows = read(spark, sf_dir, "events")
    span = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    return scoping.within_lines(rows, span, by="user_id", at="ts", low="low", high="high").groupBy("user_id").agg(F.count("*").alias("n"))


def throw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are throws and purchases throw exits: what is left behind errors leads to purchases."""
    rows = calls(spark, sf_dir)
    kind = F.when(F.col("callee") == "purchase", "exit").otherwise("call")
    nodes = rows.select("id", kind.alias("type"), F.when(F.col("callee") == "error", "<operator>.throw").otherwise(F.col("callee")).alias("calleeFullName"), F.when(F.col("callee") == "purchase", "throw").alias("exitKind"))
    return graph.valid_edges(sequence_edges(rows), nodes).select("src", "dst")


def lambda_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are noise calls, but for those that invoke a customer of one segment."""
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("call").alias("type"), F.col("o_orderpriority").alias("calleeFullName"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    bodies = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("entry").alias("type"), F.col("c_mktsegment").alias("calleeFullName"))
    invokes = orders.select(F.col("id").alias("src"), "dst", F.lit("invoke").alias("type"))
    return graph.excluded_calls(orders.drop("dst").unionByName(bodies), invokes, F.col("calleeFullName").startswith("1-"), F.col("calleeFullName") == "BUILDING")


def arm_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders branch by line status; an arm's exits are the ship modes and suppliers of its lines."""
    exits = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("groupId"), F.col("l_linenumber").cast("string").alias("armLabel"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("destination"))
    return graph.arm_outcomes(exits).select("groupId", F.col("outcomes").cast("long").alias("outcomes"))


def group_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are done name their clerk; others belong to the suppliers of their lines."""
    groups = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("method"))
    tags = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("method"))
    return scoping.group_methods(groups, tags)


def direct_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 25, "call").otherwise("leaf").alias("type"))
    return scoping.flow_questions(scoping.direct_flow(part_edges(spark, sf_dir).withColumn("type", F.lit("data")), nodes))


def data_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("id"))
    found = scoping.attach_data_edges(brand_edges(spark, sf_dir).withColumn("type", F.lit("sequence")), part_edges(spark, sf_dir), nodes)
    return found.groupBy("type", F.col("src").alias("id")).agg(F.count("*").alias("n"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that are operations and all methods below them."""
    starts = read(spark, sf_dir, "nation").select(F.col("n_name").alias("operation"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entry"))
    return scoping.memberships(tree_edges(spark, sf_dir), starts)


def operation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("operation"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("method"), F.col("l_linenumber").alias("pos"))
    documents = read(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("fullName"), F.col("p_name").alias("methodName"))
    return scoping.operation_documents(members, documents).select("operation", "pos", "method", "name")


def traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tree_edges(spark, sf_dir).withColumn("pos", F.length("dst"))
    starts = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root")).withColumn("id", F.col("root"))
    return scoping.traversal_rank(edges, starts)


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are siblings; their arguments are both frontiers."""
    rows = turns(spark, sf_dir).groupBy("conv_id", "turn").agg(F.max("arguments").alias("entry"))
    items = rows.select(F.col("conv_id").alias("method"), F.lit("").alias("container"), F.col("turn").alias("ordinal"), F.slice("entry", 1, 2).alias("entry"), F.slice("entry", 1, 3).alias("exit"))
    found = scoping.boundary_pairs(items)
    return found.select("method", F.col("ordinal").cast("long").alias("ordinal"), "left", "right")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents own the quoted and plain words of their texts."""
    # Dealt by owner once as texts, 8 MB a task, so neither grouping shuffles words.
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.repartition(1 + size // (8 << 20), "owner")
    words = docs.select("owner", F.posexplode(F.split("text", "[ \n\t]+")).alias("pos", "value"))
    kind = F.when(F.col("pos") % 2 == 0, "literal").otherwise("identifier")
    found = scoping.evidence(words.select("owner", kind.alias("kind"), "value", "pos"))
    return found.groupBy("owner", "kind").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


def failure_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("reason"), F.when(F.col("event_type") == "view", 0).otherwise(F.col("event_id") % 3).alias("n"))
    return batches.failure_counters(rows, by="user_id")


def topic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are asked for their topic, labels answer; some twice, some with unknown topics."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    told = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5 + F.col("quality")).cast("int").alias("group_id"))
    told = told.unionByName(told.where("id % 7 = 0"))
    topics_of = read(spark, sf_dir, "region").select((F.col("r_regionkey") - 1).cast("int").alias("label"))
    return batches.topic_answers(docs, told, topics_of)


def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of embeddings are clusters; nations answer for their names."""
    found = read(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label")).distinct()
    told = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("Nation "), F.initcap("n_name")).alias("label"))
    names_of = batches.cluster_labels(found, told, text.valid_topic_label)
    members = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), F.col("label").cast("int").alias("label"))
    terms = found.select(F.col("label").alias("cluster"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("term"), F.lit(1).alias("rank"))
    named = topics.name_clusters(topics.build_clusters(members, terms), names_of)
    return topics.topic_list(named).select("label", "name", "n_members", F.array_join("terms", " ").alias("terms"), F.col("place").cast("long").alias("place"))


def label_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are phases of conversations; equal roles and empty words spoil a subject."""
    rows = read(spark, sf_dir, "conversations")
    subjects = rows.select(F.concat(F.lit("s"), F.floor(F.col("conv_id") / 2).cast("string")).alias("id"), F.col("conv_id").alias("pos")).distinct()
    told = rows.select(F.col("conv_id").alias("pos"), F.concat("role", F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("turn").cast("string"))).alias("phase_id"), (F.length("text") > 100).alias("filled"))
    return batches.label_subjects(subjects, told)


def readme_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are classes in folders of type and brand; types have a readme."""
    low = lambda c: F.lower(F.regexp_replace(c, "[# ]", ""))
    rows = read(spark, sf_dir, "part").select(low(F.col("p_type")).alias("m"), low(F.col("p_brand")).alias("b"), "p_partkey")
    classes = rows.select(F.concat_ws("/", F.lit("src"), "m", "b", F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).alias("filename"), F.concat_ws(".", F.lit("com"), "m", "b").alias("package"))
    return topics.readme_packages(rows.select(F.concat_ws("/", F.lit("src"), "m", F.lit("README.md")).alias("path")).distinct(), classes)


def anchors_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are branches whose lines are their anchors by number: entry, exit, decisions."""
    role = F.element_at(F.create_map(F.lit("A"), F.lit("entry"), F.lit("N"), F.lit("exit"), F.lit("R"), F.lit("decision")), F.col("l_returnflag"))
    nodes = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag")).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("structure").alias("type"), F.col("l_orderkey").cast("string").alias("structureGroupId"), role.alias("structureRole"))
    groups = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "loop").otherwise("branch").alias("kind"), F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit("1")).alias("entryNodeId"), F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit("2")).alias("exitNodeId"), F.array(F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit("3"))).alias("decisions"))
    return validate.bad_anchors(groups, nodes).groupBy("check").agg(F.count("*").alias("n"), F.count("detail").alias("told"))


def exits_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("groupId"), F.col("o_orderstatus").alias("armLabel"))
    exits = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("groupId"), F.col("l_linestatus").alias("armLabel"), F.when(F.col("l_linenumber") == 1, "break").otherwise("return").alias("kind"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("destination"))
    nodes = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return validate.bad_exits(arms, exits, nodes).groupBy("check").agg(F.count("*").alias("n"))


def visible_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are hidden, clicks are roots."""
    rows = calls(spark, sf_dir).withColumn("reqs", no_guards())
    roots = rows.where("callee = 'click'").select("id")
    return graph.visible_graph(sequence_edges(rows), rows.where("callee = 'view'").select("id"), roots).select("src", "dst")


def unfit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("fullName"))
    own = read(spark, sf_dir, "orders").select(F.lit("call").alias("type"), F.col("o_custkey").cast("string").alias("callerMethod"))
    return validate.unfit_roots(roots, own, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))).select("check", "key")


def retained_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the tree whose target has more than one effective phase, with how many lie below each method."""
    edges = tree_edges(spark, sf_dir).select(F.col("src").alias("method"), F.col("dst").alias("call"), F.col("dst").alias("target"))
    methods = edges.select("method").distinct().withColumn("own", F.when(F.col("method") < "c5", 1).otherwise(2))
    return phases.retained_calls(phases.effective_counts(methods, edges), edges).groupBy("method").agg(F.count("*").alias("n"))


def scoped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("value"))
    found = scoping.call_features(rows, ("click", "error", "purchase"))
    kept = scoping.scoped_features(found, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))
    return kept.select("node_id", *(F.array_join(c, ",").alias(c) for c in ("click", "error", "purchase", "observed")))


def topic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("op_id"), F.col("toxic").alias("label"), (F.col("doc_id") % 17 / 17.0).alias("similarity"))
    tops = read(spark, sf_dir, "labels").select(F.col("toxic").alias("label")).distinct().withColumn("name", F.when(F.col("label") == 0, "clean"))
    return topics.topic_report(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("op_id")), labels, tops)


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("event_type", (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration"))
    return reports.run_totals(log, by="event_type").withColumn("duration", F.round("duration", 3))


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("id"))
    return validate.dangling_edges(part_edges(spark, sf_dir), nodes).drop("check").groupBy("key").agg(F.count("*").alias("n"))


def data_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    return validate.unrequested_pairs(edges, edges.where("src < dst")).groupBy("key").agg(F.count("*").alias("n"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(text.estimate_tokens(F.col("text"))).alias("tokens"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    return reports.graph_stats(rows.select(F.col("callee").alias("type")), sequence_edges(rows))


def derived_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    edges = sequence_edges(rows).drop("reqs").withColumn("alternatives", F.array(no_guards()))
    found = branches.derive_guards(edges, rows.select("id", F.col("reqs").alias("branchArms")))
    said = F.array_join(F.transform("reqs", lambda r: F.concat_ws("=", r["groupId"], r["armLabel"])), ",")
    return found.select("src", "dst", said.alias("guards"))


def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call their customer; every fifth is unresolved, debtors are external, builders have no body, finished orders refer to their status."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders = read(spark, sf_dir, "orders").select(tag("o", "o_orderkey").alias("id"), tag("c", "o_custkey").alias("target"), "o_orderkey", "o_orderstatus")
    methods = read(spark, sf_dir, "customer").select(tag("c", "c_custkey").alias("target"), F.col("c_name").alias("fullName"), (F.col("c_acctbal") < 0).alias("external"), (F.col("c_mktsegment") != "BUILDING").alias("hasBody"))
    refs = orders.where("o_orderstatus = 'F'").select("id", tag("s", "o_orderstatus").alias("target"))
    edges, leaves = branches.call_edges(orders.select("id"), orders.where("o_orderkey % 5 <> 0"), methods, refs)
    return edges.join(leaves.select(F.col("id").alias("dst"), "reason", F.lit(True).alias("leaf")), "dst", "left").select("src", "dst", F.col("leaf").isNotNull().alias("leaf"), "reason")


def phase_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a method are told by the last digit of their targets; each leads to its first target."""
    edges = tree_edges(spark, sf_dir)
    retained = edges.select(F.col("src").alias("method"), F.right("dst", F.lit(1)).alias("call"), F.col("dst").alias("target"), F.length("dst").alias("pos"))
    phases_of = edges.select(F.col("src").alias("method"), F.length("dst").alias("phase"))
    starts = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("method"))
    return branches.retained_phase_keys(starts, phases_of, retained).groupBy("root").agg(F.count("*").alias("n"))


def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    arm = lambda g, by: F.struct(F.concat(F.lit(g), F.floor(F.col("k") / by).cast("string")).alias("groupId"), (F.col("k") % 2).cast("string").alias("armLabel"))
    path = F.slice(F.array(arm("g", 30), arm("h", 10)), F.lit(1), F.col("k") % 3)
    nested, _ = branches.nest_structure(rows.select(F.col("user_id").alias("method"), F.col("event_id").alias("id"), F.col("event_id").alias("rank"), (F.col("k") % 2).alias("run"), path.alias("arm_path"), (F.col("event_type") != "view").alias("eligible")))
    said = F.array_join(F.transform("container", lambda r: F.concat_ws("=", r["groupId"], r["armLabel"])), "/")
    return nested.select("method", said.alias("container"), F.col("ordinal").cast("long").alias("ordinal"), "kind", "key", F.size("members").cast("long").alias("n"), "first")


def gate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a phase; gates before texts whose length is no multiple of three are merged."""
    rows = turns(spark, sf_dir, "text").withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    name = lambda at: F.concat_ws("-", "conv_id", at)
    rows = rows.select(F.col("conv_id").alias("method"), name(F.col("pos")).alias("phase"), F.col("pos").alias("at"), name(F.col("pos")).alias("id"), F.lit(0).alias("seq"), name(F.col("pos") - 1).alias("left_id"), F.length("text").alias("size"))
    open_gates = rows.where("at > 1").select("method", F.concat(F.lit("gate-"), F.col("id")).alias("gate"), "left_id", F.col("id").alias("right_id"), F.col("at").alias("pos"), "size")
    answers = open_gates.select("method", "gate", F.when(F.col("size") % 3 == 0, "SPLIT").otherwise("MERGE").alias("action"), F.lit(0.9).alias("confidence"), F.array(F.lit("length")).alias("evidence"))
    members, _, _ = gates.resolve_gates(rows.drop("left_id", "size"), open_gates.drop("size"), answers)
    return members.select("method", "id", "phase", F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"))


def label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers delegate to their nation; every third nation has two phases and shares no label."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customers, nations = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    nation_phases = nations.select(F.explode(F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("p"), tag("n", "n_nationkey").alias("method"))
    both = customers.select(tag("c", "c_custkey").alias("phase_id"), tag("c", "c_custkey").alias("method"), F.array(tag("call", "c_custkey")).alias("ids"))
    both = both.unionByName(nation_phases.select(F.concat("method", "p").alias("phase_id"), "method", F.array(F.lit("x"), F.lit("y")).alias("ids")))
    made = customers.select(tag("call", "c_custkey").alias("id"), tag("n", "c_nationkey").alias("target"), (F.col("c_mktsegment") == "BUILDING").alias("retained"))
    counts = nations.select(tag("n", "n_nationkey").alias("method"), F.lit(1).alias("count"))
    return gates.delegation_groups(both, made, counts)


def method_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    made = bundle.method_bundle(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id")), nodes=lines)
    said = F.array_join(F.transform("nodes", lambda x: F.concat_ws(":", x["line"], x["part"])), ",")
    return made.select("entry_id", F.size("nodes").cast("long").alias("n"), said.alias("nodes"))


def bundle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, item = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    methods = part.where("p_size < 40").select(F.col("p_partkey").alias("entry_id"))
    leaves = part.where("p_size >= 10").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") >= 12, "leaf").otherwise("entry").alias("type"))
    operations = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("root"))
    pairs = item.select(F.col("l_partkey").alias("entry_id"), F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("caller"))
    found = bundle.bundle_violations(methods, leaves, pairs.select(F.col("id").alias("call"), F.col("entry_id").alias("leaf")), operations, pairs, pairs, pairs)
    return found.groupBy("check").agg(F.count("*").alias("n"))


def payload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.expr("doc_id div 32").alias("batch"), F.col("doc_id").alias("id"), F.col("lang").alias("entry_point"), F.array("source").alias("methods"))
    return bundle.batch_payload(rows, bundle.operation_item(), by=["batch"], order="id", name="operations", schemaVersion=F.lit("one"))


def corpus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("fullName"), F.array("p_type", "p_brand", "p_type").alias("methodNames"), F.array("p_name").alias("memberNames"), none.alias("identifiers"), none.alias("comments"), none.alias("literals"))
    return bundle.class_text(docs)


def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is an answer: two joined records with braces in their strings, a line of its own words, a list and a last record over two lines."""
    rows = read(spark, sf_dir, "conversations")
    record = lambda n: F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn", F.lit(n)).alias("id"), F.concat_ws(" } {", "role", "text").alias("label")))
    last = F.concat(F.lit('{"id":\n'), F.to_json(F.struct(F.col("role").alias("x"))), F.lit("}"))
    answer = F.concat(F.lit("```json\n"), record("a"), record("b"), F.lit("\n["), "text", F.lit("\n[1, 2] "), last, F.lit("\n```"))
    scanned = batches.scan_records(rows.select("conv_id", answer.alias("text")), "id string, label string")
    return batches.parse_failures(scanned, by="conv_id")


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the spans from each purchase to the user's second next one."""
    rows = read(spark, sf_dir, "events")
    until = F.lead("ts", 2).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    spans = rows.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("start"), until.alias("end"), F.col("event_id").alias("span"))
    found = scoping.within_lines(rows, spans, by="user_id", at="ts")
    return found.groupBy("span").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def topic_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are operations of their nation, debtors of none; every third has a label."""
    rows = read(spark, sf_dir, "customer")
    operations = rows.select(F.col("c_custkey").alias("op_id"), F.col("c_name").alias("root"))
    told = rows.where("c_acctbal >= 0").select(F.col("c_custkey").alias("op_id"), F.col("c_nationkey").cast("int").alias("label"), (F.col("c_custkey") % 8 / 8).alias("similarity"))
    labels = rows.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("op_id"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("label"))
    return topics.drill_down(operations, told, labels).withColumn("place", F.col("place").cast("long"))


def ordered_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ordered_roots(roots_orphans(spark, sf_dir))


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names and types as identifiers, methods and types; some are made synthetic by their size."""
    made = F.concat(F.element_at(F.array(*map(F.lit, ("", "$", "access$", "lambda$a$", "<init>", "a.<lambda>", "java.util."))), (F.col("p_size") % 7 + 1).cast("int")), F.when(F.col("p_size") % 7 == 4, "").otherwise(F.col("p_type")), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("$"), F.col("p_size").cast("string"))).otherwise(""))
    n = F.col("name")
    rows = read(spark, sf_dir, "part").select("p_partkey", made.alias("name"))
    return rows.select("p_partkey", names.is_synthetic(n).alias("synthetic"), names.is_document_type(F.col("name"), n).alias("type"), names.is_document_method(n).alias("method"), names.is_document_identifier(n).alias("identifier"))


def correlated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are asked for; turns answer, some twice, some about others, without text ids, keys or form."""
    rows = read(spark, sf_dir, "conversations")
    asked = rows.where("conv_id % 4 <> 3").select(F.col("conv_id").cast("string").alias("id"))
    plain = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("label")))
    answer = F.when(F.col("turn") == 0, F.when(F.col("conv_id") % 5 == 0, F.to_json(F.struct(F.col("conv_id").cast("string").alias("id")))).otherwise(plain)).when(F.col("turn") == 1, F.to_json(F.struct(F.col("conv_id").alias("id"), F.col("role").alias("label")))).when((F.col("turn") == 2) & (F.col("conv_id") % 2 == 0), F.concat(plain, F.lit("[0]"))).otherwise("none")
    found, reasons = batches.correlated(asked, batches.scan_records(rows.select(answer.alias("text")), "id string, label string"), required=("id", "label"), exact=True)
    return reasons.unionByName(found.agg(F.count("*").alias("n")).select(F.lit("resolved").alias("reason"), "n"))


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("// first\n\n"), "text", F.lit("\npublic class A$1 { enum B {} }\n")).alias("text"))
    return reports.source_stats(rows, key="doc_id")


def slice_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of regions and nations over the tree: orders are calls in arms and loops, finished ones flow back to their customer."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders, tree = read(spark, sf_dir, "orders"), tree_edges(spark, sf_dir)
    starts = read(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("id")).unionByName(read(spark, sf_dir, "nation").select(tag("n", "n_nationkey").alias("id")))
    entries = starts.unionByName(read(spark, sf_dir, "customer").select(tag("c", "c_custkey").alias("id")))
    none, arm = no_guards(), lambda c: F.array(F.struct(c.alias("groupId"), F.lit("x").alias("armLabel")))
    nodes = entries.select("id", F.lit("entry").alias("type"), F.col("id").alias("calleeFullName"), none.alias("branchArms"), F.array().cast("array<string>").alias("loopIds"))
    nodes = nodes.unionByName(orders.select(tag("o", "o_orderkey").alias("id"), F.lit("call").alias("type"), F.lit("f").alias("calleeFullName"), arm(F.concat(F.lit("g"), (F.col("o_orderkey") % 50).cast("string"))).alias("branchArms"), F.array(tag("l", "o_orderpriority"), F.concat(F.lit("l"), F.col("o_orderstatus"))).alias("loopIds")))
    data = orders.where("o_orderstatus = 'F'").select(tag("o", "o_orderkey").alias("src"), tag("c", "o_custkey").alias("dst"), F.lit("data").alias("type"))
    groups = lambda df, key, method: df.select(key.alias("id"), method.cast("string").alias("method"))
    branches_of = groups(read(spark, sf_dir, "customer"), tag("b", "c_custkey"), tag("c", "c_custkey")).unionByName(groups(orders.select((F.col("o_orderkey") % 60).alias("k")).distinct(), tag("g", "k"), F.lit(None)))
    loops_of = groups(read(spark, sf_dir, "nation"), tag("m", "n_nationkey"), tag("n", "n_nationkey")).unionByName(groups(orders.select(F.col("o_orderstatus").alias("k")).distinct(), tag("l", "k"), F.lit(None)))
    parts = slices.slice_graph(nodes, tree.withColumn("type", F.lit("invoke")).unionByName(data), branches_of, loops_of, starts)
    counts = [df.groupBy("root").agg(F.count("*").alias(name)) for name, df in parts.items()]
    out = starts.withColumnRenamed("id", "root")
    for df in counts:
        out = out.join(df, "root", "left")
    return out.fillna(0)


def targeted_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts flow along orders of their brand; small ones are retained, and asked for two steps before each part; odd sizes are no nodes."""
    edges, part = brand_edges(spark, sf_dir), read(spark, sf_dir, "part")
    two = edges.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
    size = lambda where: part.where(where).select(F.col("p_partkey").alias("id"))
    found, stats = slices.targeted_flow(edges, edges.unionByName(two), size("p_size < 25"), size("p_size % 3 <> 1"))
    kept = found.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("first"))
    return kept.unionByName(stats.select(F.lit(None).alias("dst"), "visited", "most_visited").toDF("dst", "n", "first")).unionByName(stats.select(F.lit(None).alias("dst"), "targets", "missing").toDF("dst", "n", "first"))


def retry_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are asked for by source; each is answered in the attempt of its number, every fourth never; long ones are set aside."""
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.octet_length("text").cast("long").alias("size"))
    complete = lambda asked, known, attempt: asked.where(F.col("id") % 4 <= attempt).select("key", "batch", "id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("answer"))
    found, large, _ = batches.batched_rounds(rows, complete)
    none = F.lit(None).cast("string").alias("answer")
    told = found.select("key", "id", "answer", "attempt").unionByName(large.select("key", "id", none, F.lit(-1).alias("attempt")))
    return rows.select("key", "id").join(told, ["key", "id"], "left").select("key", "id", "answer", F.col("attempt").cast("long").alias("attempt"))


def call_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions call their nations, nations a customer of each market segment, of the last segment the one with the largest key; debtors call their region again."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    segment = customer.select(tag("n", "c_nationkey").alias("method"), F.col("c_mktsegment").alias("call"), F.col("c_custkey").alias("pos"), tag("c", "c_custkey").alias("target"))
    back = customer.where("c_acctbal < 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(tag("c", "c_custkey").alias("method"), F.lit("back").alias("call"), F.lit(0).cast("long").alias("pos"), tag("r", "n_regionkey").alias("target"))
    first = nation.select(tag("r", "n_regionkey").alias("method"), F.col("n_name").alias("call"), F.lit(0).cast("long").alias("pos"), tag("n", "n_nationkey").alias("target"))
    calls_of = first.unionByName(segment).unionByName(back)
    entries = calls_of.select(F.explode(F.array("method", "target")).alias("method")).distinct()
    nodes = entries.select("method", F.col("method").alias("node")).unionByName(calls_of.select("method", F.col("call").alias("node")).distinct())
    path = F.concat(tag("r", "n_regionkey"), F.lit("/"), F.col("n_name"), F.lit("/0:"), tag("n", "n_nationkey"))
    last = segment.where("call = 'MACHINERY'").groupBy("method", "call").agg(F.max_by("target", "pos").alias("target"))
    chosen = nation.select(path.alias("instance"), tag("n", "n_nationkey").alias("method")).join(last, "method")
    visible, edges = instances.instantiate(read(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("method")), nodes, calls_of.select("method", F.col("method").alias("src"), F.col("call").alias("dst")).distinct(), calls_of, chosen=chosen)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("type") == "invoke").alias("invokes"), F.count_if(F.col("type") == "sequence").alias("follows"))
    return visible.join(out, "id", "left").select("id", "method", F.col("depth").cast("long").alias("depth"), "expandable", "cut", F.coalesce("invokes", F.lit(0)).alias("invokes"), F.coalesce("follows", F.lit(0)).alias("follows"))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order follow each other; returned ones lead back to an earlier line, or to themselves."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    at = lambda n: F.col("l_orderkey") * 100 + n
    lines = rows.select("l_orderkey", "l_linenumber").distinct()
    nxt = F.lead("l_linenumber").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    forward = lines.withColumn("to", nxt).where("to is not null").select("l_orderkey", at(F.col("l_linenumber")).alias("src"), at(F.col("to")).alias("dst"))
    back = rows.where("l_returnflag = 'R'").select("l_orderkey", at(F.col("l_linenumber")).alias("src"), at(1 + F.col("l_suppkey") % F.col("l_linenumber")).alias("dst"))
    return forward.unionByName(back).distinct()


def cycle_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are loops, lines 2 to 4 a loop inside of them; orders in process have no loop, so their cycles stay."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(orders, "l_orderkey")
    name = lambda p: F.concat(F.lit(p), F.col("l_orderkey").cast("string"))
    around = F.when(F.col("l_linenumber").between(2, 4), F.array(name("o"), name("i"))).otherwise(F.array(name("o")))
    nodes = lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("rank"), around.alias("loopIds"))
    loops = orders.select(name("o").alias("id"), (-F.col("l_orderkey")).alias("exitNodeId")).unionByName(orders.select(name("i").alias("id"), (F.col("l_orderkey") * 100 + 5).alias("exitNodeId")))
    return cycles.cut_cycle_edges(line_edges(spark, sf_dir).select("src", "dst"), nodes, loops)


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = line_edges(spark, sf_dir)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ranks = ends.select("id", (F.col("id") % 100).alias("rank"))
    return cycles.topo_levels(edges, ranks, within="l_orderkey")


def cycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cycles.cycle_report(line_edges(spark, sf_dir), within="l_orderkey")
    return found.select("component", "nodes", "edges", F.col("length").cast("long").alias("length"), F.array_join("witness", ">").alias("witness"))


FOUND = (bridge_events, bridge_guarded, call_pairs, noise_filter, reach_parts, reach_tree, depth_capped, roots_orphans, callers_callees, peel_tree, part_components, linear_runs, expand_tree, effective_count, name_predicates, split_identifiers, preprocess, doc_dedupe, ctfidf_terms, centroids, assign_nearest, knn5, density, coverage, package_attach, package_prefix, overlap_pairs, core_signature, segments, line_stats, pack_batches, correlate, label_check, comment_interval, topic_report, run_totals, dangling_edges, data_edges, token_estimate, graph_stats, derived_guards, call_resolution, phase_keys, nested_items, gate_answers, label_groups, method_bundle, bundle_checks, payload_batches, corpus_text, throw_edges, lambda_calls, arm_outcomes, group_methods, direct_flow, data_attached, membership, operation_documents, traversal, boundaries, evidence, failure_counters, topic_answers, cluster_names, label_subjects, readme_packages, anchors_check, exits_check, visible_graph, unfit_roots, retained_calls, scoped_features, method_phases, cycle_cut, topo_levels, cycle_report, answer_records, span_events, topic_drill_down, ordered_roots, document_names, correlated_answers, source_stats, slice_parts, targeted_flow, retry_batches, call_instances)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in FOUND}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
