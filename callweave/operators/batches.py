"""Batches of model requests: packing, record scanning, correlation, retry rounds."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.session import Rounds, materialize, release

#: A code fence, limits of a batch and sizes of the retry rounds.
FENCE = re.compile(r"^```(?:json|jsonl)?\s*|\s*```$", re.MULTILINE)
INPUT_TOKENS, OUTPUT_TOKENS, CHARS_PER_ITEM, ROUND_SIZES = 10_000, 2_048, 180, (32, 32, 1)


def pack(items: DataFrame, *, key: str, order: str, size: str, max_items: int, overhead: int = 0, max_input: int = INPUT_TOKENS, max_output: int = OUTPUT_TOKENS, stretch: int = 4096) -> DataFrame:
    """``(key, order, batch)``: greedy packing in order inside a key; a batch never has rendered bytes / 3 over ``max_input``
    tokens, items over ``max_items`` or expected output over ``max_output``, unless it is a single item.

    Items are numbered inside their key by ranges of the whole table, and cut into stretches of ``stretch`` items. A
    stretch tells for each item that a batch may begin with at its start where the next stretch would begin and after how many
    batches; these maps are composed by doubling, so a key of any size is packed in stretches that know their
    beginning. Equal orders: the larger size first.
    """
    room = min(max_items, max_output * 3 // CHARS_PER_ITEM)
    rows = items.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"))
    dealt = materialize(rows.repartitionByRange("k", "o", F.desc("s")).sortWithinPartitions("k", "o", F.desc("s")).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = sizes.select("k", "part", (F.sum("n").over(W.partitionBy("k").orderBy("part")) - F.col("n")).alias("before"))
    at = F.row_number().over(W.partitionBy("part", "k").orderBy("o", F.desc("s"))) - 1
    placed = dealt.withColumn("at", at).join(before, ["k", "part"]).withColumn("at", F.col("at") + F.col("before"))
    own = (F.col("at") / stretch).cast("long")
    # The first items of a stretch are known to the one before, too, whose last batch may end among them.
    ahead = F.when((F.col("at") % stretch < room) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = materialize(placed.select("k", "o", "s", "at", F.explode(ahead).alias("stretch")))
    kinds = dict(placed.dtypes)

    def nexts(t: pa.Table) -> tuple[pa.Table, int, np.ndarray]:
        """The items in order, how many are the stretch's own, and for each of these where the next batch would begin."""
        t = t.sort_by("at")
        place, size = t.column("at").to_numpy() - t.column("stretch").to_numpy() * stretch, t.column("s").to_numpy()
        until = np.concatenate([[0], size.cumsum()])
        n = int((place < stretch).sum())
        fits = np.searchsorted(until, until[:n] + 3 * max_input - overhead, side="right") - 1
        return t, n, np.minimum(np.clip(fits, np.arange(n) + 1, np.arange(n) + room), len(t))

    def ways(t: pa.Table) -> pa.Table:
        t, n, following = nexts(t)
        out, count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            j = int(following[i])
            out[i], count[i] = (out[j], count[j] + 1) if j < n else (j - n, 1)
        head = min(room, n)
        return pa.table({"k": t.column("k").slice(0, 1), "stretch": t.column("stretch").slice(0, 1), "out": pa.array([out[:head].tolist()], pa.list_(pa.int64())), "count": pa.array([count[:head].tolist()], pa.list_(pa.int64()))})

    maps = materialize(placed.groupBy("k", "stretch").applyInArrow(ways, f"k {kinds['k']}, stretch long, out array<long>, count array<long>"))
    span, most = 1, maps.agg(F.max("stretch")).first()[0] or 0
    while span <= most:
        earlier = maps.select("k", (F.col("stretch") + span).alias("stretch"), F.col("out").alias("out0"), F.col("count").alias("count0"))
        both = maps.join(earlier, ["k", "stretch"], "left")
        through = lambda c: F.transform("out0", lambda x: F.get(c, x.cast("int")))
        maps = materialize(both.select("k", "stretch", F.when(F.col("out0").isNull(), F.col("out")).otherwise(through("out")).alias("out"), F.when(F.col("out0").isNull(), F.col("count")).otherwise(F.zip_with("count0", through("count"), lambda a, b: a + b)).alias("count")))
        span *= 2
    begins = maps.select("k", (F.col("stretch") + 1).alias("stretch"), F.get("out", F.lit(0)).alias("entry"), F.get("count", F.lit(0)).alias("batch"))
    known = placed.join(begins, ["k", "stretch"], "left")

    def number(t: pa.Table) -> pa.Table:
        t, n, following = nexts(t)
        entry, batch = (t.column(c).to_pylist()[0] or 0 for c in ("entry", "batch"))
        of = np.full(n, batch - 1, dtype=np.int64)
        while entry < n:
            of[entry : following[entry]] = batch
            entry, batch = int(following[entry]), batch + 1
        return pa.table({"k": t.column("k").slice(0, n), "o": t.column("o").slice(0, n), "batch": pa.array(of)})

    packed = known.groupBy("k", "stretch").applyInArrow(number, f"k {kinds['k']}, o {kinds['o']}, batch long")
    return packed.select(F.col("k").alias(key), F.col("o").alias(order), "batch")


def scan_text(raw: str, decoder: json.JSONDecoder = json.JSONDecoder()) -> tuple[list[tuple[str, bool]], int]:
    """The JSON values of an answer as ``(text, joined)``, and how many places hold none.

    A value may run over lines and hold braces in its strings; the next one may follow without white space, which
    joins the two. What is no value is skipped up to the end of its line. Code fences are left out.
    """
    text = FENCE.sub("", raw).strip()
    found, malformed, at, ended = [], 0, 0, None
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        try:
            _, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            malformed += 1
            at, ended = text.find("\n", at) + 1 or len(text), None
            continue
        found.append((text[at:end], ended == at))
        at = ended = end
    return found, malformed


def scan_records(answers: DataFrame, schema: str, *, text: str = "text") -> DataFrame:
    """One row per JSON value of an answer: all columns, ``pos``, ``value``, ``record`` (null: no object), ``joined`` and ``follows``; one more row with ``malformed`` where an answer had such places.

    ``follows``: no white space stands between a value and the one before it; ``joined``: nor before or behind it.
    ``malformed`` is the number of places that hold no JSON; its row has no record. Null and blank answers give no
    row. Each answer is read once, in its task.
    """

    @F.udf("array<struct<value:string,joined:boolean,follows:boolean,malformed:int>>", useArrow=True)
    def scan(raw: str | None) -> list[tuple]:
        found, malformed = scan_text(raw or "")
        next_one = [follows for _, follows in found[1:]] + [False]
        return [(v, f or n, f, 0) for (v, f), n in zip(found, next_one)] + [(None, False, False, malformed)] * (malformed > 0)

    parts = answers.select("*", F.posexplode(scan(text)).alias("pos", "__part"))
    record = F.when(F.col("__part.value").startswith("{"), F.from_json("__part.value", schema))
    return parts.select(*answers.columns, "pos", F.col("__part.value").alias("value"), record.alias("record"), *(F.col("__part")[c].alias(c) for c in ("joined", "follows", "malformed")))


def parse_failures(scanned: DataFrame, *, by: str) -> DataFrame:
    """``(by, records, malformed, joined, not_object)``: what ``scan_records`` met in the answers of each value of ``by``."""
    value = F.col("malformed") == 0
    return scanned.groupBy(by).agg(F.count_if(value & F.col("record").isNotNull()).alias("records"), F.sum("malformed").cast("long").alias("malformed"), F.count_if("follows").alias("joined"), F.count_if(value & F.col("record").isNull()).alias("not_object"))


def correlated(requested: DataFrame, scanned: DataFrame, *, required: tuple[str, ...] = ("id",), exact: bool = False, valid: Callable[[Column], Column] = F.isnotnull) -> tuple[DataFrame, DataFrame]:
    """``(id, record)`` of the requested ids that one valid record answers, and ``(reason, n)``, what else was met.

    ``requested(id)``, ``scanned`` of ``scan_records``; an id is a JSON text. A record needs the ``required`` keys, with ``exact``
    no others, and to pass ``valid``. Unknown ids answer nothing; several records about one id void each other. Reasons:
    malformed_json, concatenated_json, invalid_value, invented_id, duplicate_id, missing_id; what wasn't met has no row.
    """
    parsed = F.try_parse_json("value")
    told = scanned.where("value is not null").select("record", "value", F.monotonically_increasing_id().alias("at"), F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.id", "variant")) == "STRING", F.try_variant_get(parsed, "$.id", "string")).alias("id"))
    told = materialize(told.withColumn("keys", F.json_object_keys("value")))
    asked = requested.select("id").distinct()
    known = told.where("id is not null").join(asked, "id")
    keys = F.array(*map(F.lit, required))
    fits = (F.size(F.array_except(keys, "keys")) == 0) & ((F.size("keys") == len(required)) if exact else F.lit(True))
    first = known.groupBy("id").agg(F.count("*").alias("n"), F.min_by(F.struct("record", F.coalesce(fits & valid(F.col("record")), F.lit(False)).alias("ok")), "at").alias("x"))
    first = materialize(first.select("id", "n", "x.record", "x.ok"))
    count = lambda df, reason, n: df.agg(n.cast("long").alias("n")).select(F.lit(reason).alias("reason"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    one = F.count(F.lit(1))
    reasons = [
        count(scanned, "malformed_json", F.sum("malformed")),
        count(scanned, "concatenated_json", F.count_if("follows")),
        count(told.where("id is null").select("id").unionAll(first.where("not ok").select("id")), "invalid_value", one),
        count(told.where("id is not null").join(asked, "id", "left_anti"), "invented_id", one),
        count(first, "duplicate_id", F.sum(F.col("n") - 1)),
        count(asked.join(first.select("id"), "id", "left_anti"), "missing_id", one),
    ]
    return first.where("ok and n = 1").select("id", "record"), reduce(DataFrame.unionByName, reasons).where("n > 0")


def grouping_members(groups: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(name, label)`` of all ``known(name)`` after an answer that groups them, and its violations ``(check, key)``; any voids the whole answer.

    ``groups(pos, label, members)``: labels are texts that differ, case and outer blanks aside; members are known names,
    each in one group and once. Groups are numbered by ``pos`` from 0; names that no group has are labelled -1.
    """
    named = groups.select("pos", F.lower(F.trim("label")).alias("label"), "members")
    bad = lambda df, check, key: df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"))
    each = named.select("pos", F.explode("members").alias("member"))
    twice = lambda df, *c: df.groupBy(*c).count().where("count > 1")
    found = [
        bad(named.where("label is null or label = ''"), "blank-label", "pos"),
        bad(twice(named.where("label <> ''"), "label"), "label-twice", "label"),
        bad(named.where("members is null or size(members) = 0"), "no-members", "pos"),
        bad(each.where("member is null"), "no-text", "pos"),
        bad(twice(each, "pos", "member"), "member-twice", "member"),
        bad(each.where("member is not null").select("member").distinct().join(known.select(F.col("name").alias("member")), "member", "left_anti"), "unknown-member", "member"),
        bad(twice(each.select("pos", "member").distinct(), "member"), "two-groups", "member"),
    ]
    violations = materialize(reduce(DataFrame.unionByName, found))
    good = each if violations.isEmpty() else each.limit(0)
    places = groups.select("pos").distinct().withColumn("label", F.row_number().over(W.orderBy("pos")) - 1)  # an answer's groups are few
    placed = good.join(places, "pos").select(F.col("member").alias("name"), "label")
    return known.select("name").distinct().join(placed, "name", "left").select("name", F.coalesce("label", F.lit(-1)).alias("label")), violations


def correlate(requested: DataFrame, answers: DataFrame) -> DataFrame:
    """``(id, status)``: of requested ids ok, duplicate (several answers void the id) or missing, of others unknown."""
    counts = answers.where("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    both = requested.select("id", F.lit(True).alias("asked")).distinct().join(counts, "id", "full")
    status = F.when(F.col("asked").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return both.select("id", status.alias("status"))


def retry_rounds(items: DataFrame, complete: Callable[[DataFrame, int], DataFrame], *, sizes: tuple[int, ...] = ROUND_SIZES) -> DataFrame:
    """``(id, answer, round)``: each round asks only for what is unresolved; ``complete(items, batch size)`` gives ``(id, answer)``; the first valid answer wins."""
    left, done = items, None
    for turn, size in enumerate(sizes):
        got = complete(left, size).where("answer is not null")
        ok = correlate(left, got).where("status = 'ok'").select("id")
        found = materialize(got.join(ok, "id", "left_semi").select("id", "answer", F.lit(turn).alias("round")))
        done = found if done is None else materialize(done.unionByName(found))
        left = materialize(left.join(found.select("id"), "id", "left_anti"))
        if left.isEmpty():
            break
    return done


def batched_rounds(
    items: DataFrame, complete: Callable[[DataFrame, DataFrame, int], DataFrame], *, key: str = "key", sizes: tuple[int, ...] = ROUND_SIZES, overhead: Callable[[DataFrame, int], int] | None = None, max_input: int = INPUT_TOKENS, max_output: int = OUTPUT_TOKENS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(key, id, answer, attempt)``, ``(key, id, attempt)`` of what is too large to be asked for, and a row of totals.

    ``items(key, id, pos, size, …)``: places differ inside a key, sizes are rendered bytes. Each attempt packs what is open
    again, with the attempt's batch size and the bytes that ``overhead(answers so far, attempt)`` takes from every
    batch, as those answers are the next one's context. An item that exceeds the input alone is set aside for good.
    ``complete(batches, answers so far, attempt)`` gets ``items`` with ``batch`` and gives ``(key, batch, id, answer)``: an
    answer counts in the batch that asked for it, several void each other there, null is none. A first answer stays.
    Totals: requested, resolved, unresolved, oversized, attempts, request_batches, retry_items.
    """
    left = materialize(items)
    requested = left.count()
    answered, large = Rounds(), Rounds()
    # A missing round's tables begin empty, so that callers see their columns.
    large.add(left.select(key, "id", F.lit(0).alias("attempt")).limit(0))
    so_far, attempts, batches_sent, retried, open_items = None, 0, 0, 0, requested
    for attempt, most in enumerate(sizes):
        if not open_items:
            break
        attempts, retried = attempt + 1, retried + (open_items if attempt else 0)
        none = left.select(key, "id", F.lit(None).cast("string").alias("answer"), F.lit(attempt).alias("attempt")).limit(0)
        known = none if so_far is None else so_far
        extra = overhead(known, attempt) if overhead is not None else 0
        packed = pack(left, key=key, order="pos", size="size", max_items=most, overhead=extra, max_input=max_input, max_output=max_output)
        packed = materialize(left.join(packed, [key, "pos"]))
        # Nothing is packed with an item that fills more than a batch, so its size alone tells.
        over = F.coalesce(F.col("size").cast("long"), F.lit(0)) + extra > 3 * max_input
        aside = large.add(packed.where(over).select(key, "id", F.lit(attempt).alias("attempt")))
        asked = materialize(packed.where(~over))
        batches_sent += asked.select(key, "batch").distinct().count()
        got = complete(asked, known, attempt).where("answer is not null").select(key, "batch", "id", "answer").join(asked.select(key, "batch", "id"), [key, "batch", "id"])
        once = got.groupBy(key, "id").agg(F.count("*").alias("n"), F.min("answer").alias("answer")).where("n = 1")
        new = answered.add(once.select(key, "id", "answer", F.lit(attempt).alias("attempt")))
        so_far = answered.all()
        after = materialize(left.join(new.select(key, "id"), [key, "id"], "left_anti").join(aside.select(key, "id"), [key, "id"], "left_anti"))
        release(left, packed, asked)
        left, open_items = after, after.count()
    if so_far is None:
        so_far = left.select(key, "id", F.lit(None).cast("string").alias("answer"), F.lit(0).alias("attempt")).limit(0)
    resolved, oversized = so_far.count(), large.all().count()
    row = [(requested, resolved, requested - resolved, oversized, attempts, batches_sent, retried)]
    totals = items.sparkSession.createDataFrame(row, "requested long, resolved long, unresolved long, oversized long, attempts long, request_batches long, retry_items long")
    return so_far, large.all(), totals


def unique_labels(labels: DataFrame, *, topic: str, label: str, order: str) -> DataFrame:
    """The first label of a topic among equal ones, case aside."""
    rank = F.row_number().over(W.partitionBy(topic, F.lower(label)).orderBy(order))
    return labels.withColumn("__r", rank).where("__r = 1").drop("__r")


def groups_check(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Violations ``(check, key)`` of groups ``(label, member)``: unknown members, members of two groups; and who is left over."""
    m = groups.select("label", "member").distinct()
    unknown = m.join(known.select(F.col("name").alias("member")), "member", "left_anti").select(F.lit("unknown-member").alias("check"), F.col("member").alias("key"))
    twice = m.groupBy("member").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("two-groups").alias("check"), F.col("member").alias("key"))
    left = known.select("name").join(m.select(F.col("member").alias("name")), "name", "left_anti").select(F.lit("left-over").alias("check"), F.col("name").alias("key"))
    return unknown.unionByName(twice).unionByName(left)


def failure_counters(failures: DataFrame, *, by: str, reason: str = "reason", n: str = "n") -> DataFrame:
    """``(by, reason, n)``: counters of all batches added up; what never failed has no row."""
    return failures.where(F.col(n) > 0).groupBy(by, reason).agg(F.sum(n).alias(n))


def topic_answers(operations: DataFrame, answers: DataFrame, topics: DataFrame) -> DataFrame:
    """``(id, label)`` of every operation from ``answers(id, group_id)``: known topics but -1; null, invalid, repeated and missing answers give none."""
    ok = correlate(operations, answers).where("status = 'ok'").select("id")
    valid = answers.join(ok, "id", "left_semi").join(topics.where("label <> -1").select(F.col("label").alias("group_id")), "group_id", "left_semi")
    return operations.select("id").join(valid.select("id", F.col("group_id").alias("label")), "id", "left")


def cluster_labels(topics: DataFrame, answers: DataFrame, valid: Callable[[Column], Column]) -> DataFrame:
    """``(label, name)`` from ``answers(id, label)`` about topics but -1: valid names of those that were answered once."""
    asked = topics.where("label <> -1").select(F.col("label").cast("string").alias("id"))
    ok = correlate(asked, answers).where("status = 'ok'").select("id")
    return answers.join(ok, "id", "left_semi").where(valid(F.col("label"))).select(F.col("id").cast("int").alias("label"), F.col("label").alias("name"))


def label_subjects(subjects: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(id, pos)`` of the subjects that can be asked for: the first of equal ids that aren't empty, with evidence whose phases have
    different ids, none of them empty, and at least one value. ``subjects(id, pos)``, ``evidence(pos, phase_id, filled)``: of a subject at ``pos``."""
    first = subjects.where("id is not null and id <> ''").groupBy("id").agg(F.min("pos").alias("pos"))
    whole = evidence.groupBy("pos").agg((F.count("*") == F.count_distinct(F.when(F.col("phase_id") != "", F.col("phase_id")))).alias("told"), F.bool_or(F.coalesce("filled", F.lit(False))).alias("filled"))
    return first.join(whole.where("told and filled").select("pos"), "pos", "left_semi").select("id", "pos")
