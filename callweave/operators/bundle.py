"""Tables for the viewer, their checks, and the payloads of model requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text

#: Category, column, characters it may use.
CATEGORIES = (("Methods", "methodNames", 400), ("Members", "memberNames", 240), ("Identifiers", "identifiers", 400), ("Comments", "comments", 240), ("String literals", "literals", 240))
#: Fixed value: characters of a project text in the corpus text.
DOCUMENTATION = 500


def method_bundle(methods: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row per method of ``methods(entry_id)``, with each of ``parts`` (tables with ``entry_id``) as a sorted array of its rows."""
    found = methods.select("entry_id").distinct()
    for name, part in parts.items():
        row = F.struct(*(c for c in part.columns if c != "entry_id"))
        held = part.groupBy("entry_id").agg(F.array_sort(F.collect_list(row)).alias(name))
        found = found.join(held, "entry_id", "left").withColumn(name, F.coalesce(name, F.array().cast(dict(held.dtypes)[name])))
    return found


def bundle_json(bundle: DataFrame) -> DataFrame:
    """``(entry_id, json)``, one object per method, ready for a text sink."""
    return bundle.select("entry_id", F.to_json(F.struct(*bundle.columns)).alias("json"))


def bundle_violations(methods: DataFrame, leaves: DataFrame, call_leaves: DataFrame, operations: DataFrame, reached: DataFrame, callers: DataFrame, membership: DataFrame) -> DataFrame:
    """``(check, key, detail)`` of references that lead nowhere.

    ``methods(entry_id)``, ``leaves(id, type)``, ``call_leaves(call, leaf)``, ``operations(id, root)``, ``reached(id,
    entry_id)``, ``callers(entry_id, caller)``, ``membership(entry_id, id)``.
    """
    known = methods.select("entry_id").distinct()

    def lost(check: str, refs: DataFrame, key: str, ref: str, valid: DataFrame) -> DataFrame:
        pairs = refs.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), F.col(ref).alias("__ref"))
        bad = pairs.join(valid.toDF("__ref"), "__ref", "left_anti")
        return bad.select("check", "key", F.col("__ref").cast("string").alias("detail"))

    found = leaves.where("type is null or type <> 'leaf'").select(F.lit("leaf-type").alias("check"), F.col("id").cast("string").alias("key"), F.col("type").cast("string").alias("detail"))
    for check, refs, key, ref, valid in (
        ("missing-leaf", call_leaves, "call", "leaf", leaves.select("id")),
        ("missing-root", operations, "id", "root", known),
        ("missing-reached", reached, "id", "entry_id", known),
        ("missing-caller", callers.join(known, "entry_id", "left_semi"), "entry_id", "caller", known),
        ("missing-operation", membership.join(known, "entry_id", "left_semi"), "entry_id", "id", operations.select("id")),
    ):
        found = found.unionByName(lost(check, refs, key, ref, valid))
    return found


def topic_context() -> Column:
    """A topic ``(label, llm_label, terms, members)`` as a struct; shown under its label, else its first term."""
    shown = F.coalesce("llm_label", F.get("terms", F.lit(0)))
    return F.struct(F.col("label").alias("id"), shown.alias("label"), F.col("terms").alias("representativeTerms"), F.col("members").alias("memberClasses"))


def operation_item() -> Column:
    """An operation ``(id, entry_point, methods)`` as a struct."""
    return F.struct("id", F.col("entry_point").alias("entryPoint"), F.col("methods").alias("subsequentMethods"))


def cluster_item() -> Column:
    """A topic to be named: id as text, terms, and members ``array<struct<class, methods>>``."""
    return F.struct(F.col("label").cast("string").alias("id"), F.col("terms").alias("representativeTerms"), "members")


def batch_payload(rows: DataFrame, item: Column, *, by: list[str], order: str, name: str, **fixed: Column) -> DataFrame:
    """``(by, payload)``: the items of each batch (of bounded size, as packed before) in order, as JSON beside ``fixed`` values.

    ``fixed`` values are the same for all rows of a batch.
    """
    said = rows.select(*by, F.struct(order, item.alias("item")).alias("__item"), *(c.alias(f"__{k}") for k, c in fixed.items()))
    held = said.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("__item")), lambda x: x["item"]).alias("__items"), *(F.first(f"__{k}").alias(k) for k in fixed))
    return held.select(*by, F.to_json(F.struct(*fixed, F.col("__items").alias(name))).alias("payload"))


def class_text(docs: DataFrame) -> DataFrame:
    """``(pos, text)``: each class of ``docs(pos, fullName, …)`` as lines, its categories bounded in length.

    The rows in the order of ``pos`` are the text of the whole corpus; they are not joined into one here.
    """
    line = lambda name, column, budget: F.when(F.size(text.bounded_list(F.col(column), budget)) > 0, F.concat(F.lit(f"  {name}: "), F.array_join(text.bounded_list(F.col(column), budget), ", ")))
    lines = F.concat_ws("\n", F.concat(F.lit("Class: "), "fullName"), *(line(*c) for c in CATEGORIES))
    return docs.select("pos", lines.alias("text"))


def documentation_text(readmes: DataFrame) -> DataFrame:
    """``(path, text)``: the head of each project text of ``readmes(path, package, text)`` behind its package, ``root`` if none."""
    place = F.when(F.coalesce(F.length("package"), F.lit(0)) > 0, F.col("package")).otherwise("root")
    return readmes.select("path", F.concat(F.lit("["), place, F.lit("] "), F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.lit(DOCUMENTATION))).alias("text"))
