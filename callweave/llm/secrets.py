"""Secret scans (operator 6): patterns first, then corpus-wide ownership frequency.

All work is DataFrame functions. One pass over the texts takes the matches of every pattern with the gaps
between them; matches become rows and running sums give their places, so work is linear in the matches of a
text. Long mixed tokens are candidates. The hashes of base values and candidates are counted over all documents
by distinct repository and owner: what many owners or repositories carry is a copied example, what one owner
has in a few repositories looks live. Live candidates beside the base spans are added as spans of kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import table
from callweave.session import materialize

#: Kind, pattern, group that is the secret, its least length: fixed values of the contract. The hex and access
#: patterns carry their least length, which gives the same matches since each takes its whole run.
ASSIGN = ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8)
ACCESS = ("access", r"AKIA[A-Z0-9]{12,}", 0, 16)
HEX = ("hex", r"[0-9a-f]{32,}", 0, 32)
#: A candidate is a run of 16 or more characters of a key alphabet that holds a letter and a digit.
RUNS = ("owned", r"[A-Za-z0-9+/_=-]{16,}", 0, 16)
PATTERNS = (ASSIGN, ACCESS, HEX, RUNS)
OWNED = 3
#: Copies of a looked-up hash, so that the rows of a hash on many documents meet them in several tasks.
SALTS = 16


def _matches(text: Column, kind: int) -> Column:
    """Leftmost non-overlapping matches in order: ``kind``, ``gap`` to the end of the one before, ``length`` and ``value``."""
    _, pattern, group, _ = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("token"), values.alias("value"))
    rows = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), F.length(x["token"]).cast("long").alias("length"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), rows)


def spans(docs: DataFrame, *, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Documents, ``keep`` and ``row`` (unique), and their matches ``row, kind, start, end, hash`` with the owner columns."""
    text = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.expr("cast(array() as array<struct<kind:int,nth:int,gap:bigint,length:bigint,value:string>>)")
    found = F.concat(*(F.coalesce(_matches(F.col("text"), k), none) for k in range(len(PATTERNS))))
    scanned = materialize(text.select(*keep, F.monotonically_increasing_id().alias("row"), found.alias("found")))
    each = scanned.where(F.size("found") > 0).select("row", *keep, F.inline("found"))
    until = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("nth"))
    placed = each.withColumn("end", until).withColumn("start", F.col("end") - F.col("length"))
    whole = (F.col("kind") != OWNED) | F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    long = (F.col("kind") != 0) | (F.length("value") >= ASSIGN[3])
    placed = placed.where(whole & long).select("row", *keep, "kind", "start", "end", F.sha2("value", 256).alias("hash"))
    return scanned.drop("found"), placed


def beside_base(placed: DataFrame) -> DataFrame:
    """Base spans, and candidates that overlap none: by the latest base end before and the earliest base start behind."""
    base = F.col("kind") != OWNED
    forward, back = Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.desc("start"))
    seen = placed.withColumn("__end", F.max(F.when(base, F.col("end"))).over(forward)).withColumn("__start", F.min(F.when(base, F.col("start"))).over(back))
    clear = (F.coalesce("__end", F.lit(0)) <= F.col("start")) & (F.col("__start").isNull() | (F.col("__start") >= F.col("end")))
    return seen.where(base | clear).drop("__end", "__start")


def ownership(placed: DataFrame, *, owner: str, repository: str) -> DataFrame:
    """``hash, owners, repositories`` of all tokens: each (hash, owner, repository) once, counted by owner, then summed."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = placed.select("hash", text(owner).alias("owner"), text(repository).alias("repository")).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secrets(docs: DataFrame, *, owner: str = "source", repository: str = "doc_id", max_owners: int = 1, max_repositories: int = 5) -> DataFrame:
    """One row per document: ``doc_id``, counts, ``base_sha256``, ``spans``, and of the spans how many look live or are copied.

    ``n_owned`` counts the added spans, ``n_live`` and ``n_copied`` the base spans whose value has up to, or more
    than, ``max_owners`` owners and ``max_repositories`` repositories in all documents. Null texts are empty and have
    no span. Repeated rows are kept and judged alike. Null owners count as one owner, null ids as one repository.
    Of equal starts the kind decides the order. Extra columns are ignored. An empty table gives no rows.
    """
    keep = tuple(dict.fromkeys(("doc_id", owner, repository)))
    rows, placed = spans(docs, keep=keep)
    placed = materialize(beside_base(placed))
    # The salted table grows with the corpus, so it is merged, not sent to all tasks.
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    salted = ownership(placed, owner=owner, repository=repository).select("hash", live.alias("live"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = placed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["hash", "salt"])
    base = F.col("kind") != OWNED
    span = F.struct("start", "kind", "end")
    count = lambda test: F.count(F.when(test, 1))
    by_row = judged.where(base | F.col("live")).groupBy("row").agg(
        *(count(F.col("kind") == k).alias(f"n_{PATTERNS[k][0]}") for k in range(len(PATTERNS))),
        count(base & F.col("live")).alias("n_live"),
        count(base & ~F.col("live")).alias("n_copied"),
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("all"),
    )
    names = F.array(*(F.lit(p[0]) for p in PATTERNS))
    said = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    found = rows.join(by_row, "row", "left")
    return found.select("doc_id", number("n_assign"), number("n_access"), number("n_hex"), F.sha2(said("base"), 256).alias("base_sha256"), said("all").alias("spans"), number("n_owned"), number("n_live"), number("n_copied"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over ``documents``: owner is ``source``, repository the document. Null texts have no span; an empty table gives no rows."""
    return secrets(table(spark, sf_dir, "documents"))
