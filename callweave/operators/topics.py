"""Topic discovery: term scores, centroids, nearest topics, neighbour tables, density clusters, README joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.operators.gates import number
from callweave.operators.graph import components
from callweave.session import materialize

UNICODE_TOKEN, ASCII_TOKEN = r"(?U)\w\w+", "[a-z0-9_]{2,}"
#: Fixed values of the degeneracy test. Presets: neighbours, dimensions, least cluster, least samples.
LEAST_CLASSES, MOST_NOISE = 20, 0.7
PRESETS = {"fine": (5, 5, 3, 1), "balanced": (5, 5, 5, 3), "coarse": (10, 10, 8, 5)}


def term_counts(docs: DataFrame, *, cluster: str = "cluster", text: str = "text", token: str = UNICODE_TOKEN, max_df: float = 0.85) -> DataFrame:
    """``(cluster, term, n)``; terms in over ``max_df`` of the clusters go, unless there is one cluster."""
    words = docs.select(F.col(cluster).alias("cluster"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({token})"), F.lit(1))).alias("term"))
    counts = materialize(words.groupBy("cluster", "term").agg(F.count("*").alias("n")))
    total = docs.agg(F.count_distinct(cluster).alias("clusters"))
    spread = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    return counts.join(spread.where((F.col("clusters") < 2) | (F.col("df") <= max_df * F.col("clusters"))).select("term"), "term", "left_semi")


def class_tfidf(counts: DataFrame) -> DataFrame:
    """``(cluster, term, n, score)``: share in the cluster times ln(1 + whole mean cluster size / term total)."""
    counts = materialize(counts)
    sizes = counts.groupBy("cluster").agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.floor(F.avg("size")).alias("mean"))
    totals = counts.groupBy("term").agg(F.sum("n").alias("total"))
    joined = counts.join(sizes, "cluster").join(totals, "term").crossJoin(F.broadcast(mean))
    return joined.select("cluster", "term", "n", (F.col("n") / F.col("size") * F.log1p(F.col("mean") / F.greatest("total", F.lit(1)))).alias("score"))


def top_terms(scores: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best positive terms of a cluster with ``rank``; ties in descending order of the term."""
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("score"), F.desc("term")))
    return scores.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= n)


def unit(vector: Column) -> Column:
    """L2-normalised; null for a zero vector."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame, *, label: str = "label", vector: str = "embedding") -> DataFrame:
    """``(label, centroid)``: normalised mean of the members of every label but -1."""
    each = vectors.where(F.col(label) != -1).select(F.col(label).alias("label"), F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return means.select("label", unit(F.transform("v", lambda s: s["x"])).alias("centroid")).where("centroid is not null")


def assign_topics(vectors: DataFrame, topics: DataFrame, *, key: str, vector: str = "embedding") -> DataFrame:
    """``(key, label, similarity)``: nearest centroid; the smallest label wins ties."""
    rows = vectors.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    best = nearest(rows, topics.select(F.col("label").alias("neighbour"), F.col("centroid").alias("w")), k=1)
    return best.select(F.col("id").alias(key), F.col("neighbour").alias("label"), "similarity")


def nearest(left: DataFrame, right: DataFrame, *, k: int, block_rows: int | None = None, other: bool = False) -> DataFrame:
    """Exact ``(id, neighbour, similarity, rank)``: for every row of ``left(id, v)`` the ``k`` rows of ``right(neighbour, w)`` of the largest dot product.

    Rows are hashed to blocks of about ``block_rows``, by default a sixteenth of a side within 2048 and 16,384; each pair
    of blocks is multiplied in one task, 8 million products at once, and only ``k`` rows a left row leave it. Similarities that agree to 12 digits tie; the smaller neighbour wins. With
    ``other``, a row is not its own neighbour. Rows without a vector have none.
    """
    left, right = left.where("v is not null"), right.where("w is not null")
    sizes = [df.count() for df in (left, right)]
    blocks = [max(1, -(-n // (block_rows or min(16384, max(2048, n // 16))))) for n in sizes]
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = left.select("id", "v", deal("id", blocks[0]).alias("a"), every(blocks[1]).alias("b"))
    theirs = right.select("neighbour", "w", deal("neighbour", blocks[1]).alias("b"), every(blocks[0]).alias("a"))
    kinds = dict(ours.dtypes) | dict(theirs.dtypes)

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, names = x.column("id").combine_chunks(), y.column("neighbour").combine_chunks()
        matrix = lambda t, c: np.stack(t.column(c).to_numpy()).astype(np.float64)
        if not len(x) or not len(y):
            return pa.table({"id": ids.slice(0, 0), "neighbour": names.slice(0, 0), "similarity": pa.array([], pa.float64())})
        order = pc.array_sort_indices(names)
        names = names.take(order)
        ours, theirs = matrix(x, "v"), matrix(y, "w")[order.to_numpy()].T
        step, out = max(1, 8_000_000 // len(names)), []
        for at in range(0, len(ids), step):
            some = ids.slice(at, step)
            found = (ours[at : at + step] @ theirs).round(12)
            if other:
                place = pc.index_in(some, names).to_numpy(zero_copy_only=False)
                own = ~np.isnan(place.astype(float))
                found[np.flatnonzero(own), place[own].astype(int)] = -np.inf
            take = min(k, found.shape[1])
            least = np.partition(found, found.shape[1] - take, axis=1)[:, -take]
            row, column = np.nonzero((found >= least[:, None]) & np.isfinite(found))
            value = found[row, column]
            ranked = np.lexsort((column, -value, row))
            row, column, value = row[ranked], column[ranked], value[ranked]
            first = np.searchsorted(row, row)
            kept = np.arange(len(row)) - first < take
            out.append(pa.table({"id": some.take(pa.array(row[kept])), "neighbour": names.take(pa.array(column[kept])), "similarity": pa.array(value[kept])}))
        return pa.concat_tables(out)

    pairs = ours.groupBy("a", "b").cogroup(theirs.groupBy("a", "b")).applyInArrow(best, f"id {kinds['id']}, neighbour {kinds['neighbour']}, similarity double")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), F.asc("neighbour")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def knn(vectors: DataFrame, *, k: int = 5, key: str = "vec_id", vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """Exact ``(key, neighbour, similarity, rank)`` of every row against all others."""
    # Vectors travel as they are; products are of doubles.
    rows = materialize(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")))
    found = nearest(rows, rows.select(F.col("id").alias("neighbour"), F.col("v").alias("w")), k=k, block_rows=block_rows, other=True)
    return found.select(F.col("id").alias(key), "neighbour", "similarity", "rank")


def density_clusters(vectors: DataFrame, *, min_cluster: int = 5, min_samples: int = 3, neighbours: int = 10, levels: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), key: str = "vec_id") -> DataFrame:
    """``(key, label)``: components of mutual-reachability edges at rising distances; a node takes the first level at
    which its component has ``min_cluster`` members; clusters are numbered from 0 by their smallest key, -1 is noise."""
    near = materialize(knn(vectors, k=neighbours, key=key).withColumn("d", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity")))))
    core = near.where(F.col("rank") == min(min_samples, neighbours)).select(F.col(key).alias("id"), F.col("d").alias("core"))
    edges = near.select(F.col(key).alias("src"), F.col("neighbour").alias("dst"), "d").join(core.select(F.col("id").alias("src"), F.col("core").alias("a")), "src").join(core.select(F.col("id").alias("dst"), F.col("core").alias("b")), "dst")
    edges = materialize(edges.select("src", "dst", F.greatest("d", "a", "b").alias("reach")))
    done = None
    for level in levels:
        left = edges.where(F.col("reach") <= level)
        if done is not None:
            left = left.join(done.select(F.col("id").alias("src")), "src", "left_anti").join(done.select(F.col("id").alias("dst")), "dst", "left_anti")
        if left.isEmpty():
            continue
        found = components(left)
        big = found.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= min_cluster).select("root")
        found = materialize(found.join(big, "root", "left_semi").select("id", "root"))
        done = found if done is None else materialize(done.unionByName(found))
    rows = vectors.select(key)
    if done is None:
        return rows.withColumn("label", F.lit(-1).cast("long"))
    named = number(done, "root", "label").select(F.col("id").alias(key), (F.col("label") - 1).cast("long").alias("label"))
    return rows.join(named, key, "left").select(key, F.coalesce("label", F.lit(-1)).alias("label"))


def embed(docs: DataFrame, *, key: str, text: str = "text", features: int = 4096, dimensions: int | None = None) -> DataFrame:
    """``(key, embedding)``: hashed term frequencies, IDF, unit length, optionally reduced by PCA. A stand-in for any embedder."""
    if dimensions is not None and dimensions < 1:
        raise ValueError("dimensions must be positive")
    words = RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"\W+").transform(docs.select(key, F.coalesce(text, F.lit("")).alias(text)))
    counts = HashingTF(inputCol="__w", outputCol="__t", numFeatures=features).transform(words)
    weighted = IDF(inputCol="__t", outputCol="__i").fit(counts).transform(counts)
    out, column = Normalizer(inputCol="__i", outputCol="__n").transform(weighted), "__n"
    if dimensions:
        out, column = PCA(k=dimensions, inputCol="__n", outputCol="__p").fit(out).transform(out), "__p"
    return out.select(key, vector_to_array(F.col(column), "float32").alias("embedding"))


def embed_with(docs: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], *, key: str, text: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``(key, embedding)`` by a model of the caller: ``load`` makes it once a task and gives a function of texts to a matrix of as many rows.

    A call gets texts of about ``batch_bytes`` in all, or one longer text, so that what it holds is bounded by
    bytes, not by rows. Null texts are empty. A matrix of another number of rows is an error.
    """
    source = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(sizes.cumsum() // batch_bytes, prepend=0)).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi > lo:
                    found = np.asarray(model(batch.column(1).slice(lo, hi - lo).to_pylist()), dtype=np.float32)
                    if found.ndim != 2 or len(found) != hi - lo:
                        raise ValueError(f"the model gave an array of shape {found.shape} for {hi - lo} texts")
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(found), pa.list_(pa.float32()))], names=[key, "embedding"])

    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, embedding array<float>")


def package_prefixes(package: Column) -> Column:
    """The package and all its dotted ancestors."""
    parts = F.split(package, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def attach_readmes(members: DataFrame, readmes: DataFrame) -> DataFrame:
    """Distinct ``(label, path)``: a README whose package is a member's package or an ancestor of it."""
    up = members.select("label", F.explode(package_prefixes(F.col("package"))).alias("package")).distinct()
    return up.join(readmes.where("package <> ''"), "package").select("label", "path").distinct()


def common_prefix(packages: DataFrame, *, by: str, package: str = "package") -> DataFrame:
    """``(by, prefix)``: the longest leading dotted parts that all packages of a group share."""
    parts = packages.select(by, F.posexplode(F.split(package, r"\.")).alias("i", "part"))
    totals = packages.groupBy(by).agg(F.count("*").alias("all"))
    same = parts.groupBy(by, "i").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).join(totals, by)
    ok = F.min(((F.col("low") == F.col("high")) & (F.col("n") == F.col("all"))).cast("int")).over(W.partitionBy(by).orderBy("i")) == 1
    kept = same.withColumn("ok", ok).where("ok").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "low"))), lambda x: x["low"]), ".").alias("prefix"))
    return totals.select(by).join(kept, by, "left").select(by, F.coalesce("prefix", F.lit("")).alias("prefix"))


def best_readmes(readmes: DataFrame) -> DataFrame:
    """One README for each text (white space and case aside): the least deep, then the first lower-case path."""
    norm = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    order = W.partitionBy(norm).orderBy(F.size(F.split("path", "/")), F.lower("path"), "path")
    return readmes.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def coverage(classes: DataFrame, members: DataFrame) -> DataFrame:
    """One row: total, clustered, noise, represented, omitted distinct classes, coverage and the degeneracy test:
    under ``LEAST_CLASSES``, no topic, or over ``MOST_NOISE`` of the classes in none."""
    seen = classes.select("name").distinct().join(members.select("name", "label"), "name", "left")
    n = lambda c: F.count_distinct(F.when(c, F.col("name")))
    out = seen.agg(F.count_distinct("name").alias("total"), n(F.col("label") != -1).alias("clustered"), n(F.col("label") == -1).alias("noise"), n(F.col("label").isNotNull()).alias("represented"), n(F.col("label").isNull()).alias("omitted"), F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("topics"))
    ratio = F.when(F.col("total") > 0, F.col("clustered") / F.col("total")).otherwise(0.0)
    return out.withColumn("coverage", ratio).withColumn("degenerate", (F.col("total") < LEAST_CLASSES) | (F.col("topics") == 0) | (F.col("noise") > MOST_NOISE * F.col("total")))


def topic_report(operations: DataFrame, assignments: DataFrame, topics: DataFrame) -> DataFrame:
    """``(op_id, label, similarity, topic)`` of all operations; those without a topic go to -1 with similarity 0."""
    rows = operations.select("op_id").join(assignments, "op_id", "left").select("op_id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    named = rows.join(topics.select("label", "name"), "label", "left")
    return named.select("op_id", "label", "similarity", F.when(F.col("label") == -1, "Unassigned").otherwise(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("topic "), F.col("label").cast("string")))).alias("topic"))


def display_label(llm: Column, terms: Column, label: Column) -> Column:
    """What a topic is called: its answer, else its first term that isn't blank, else ``Unassigned`` or its number."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    term = F.get(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(t) != ""), F.lit(0))
    return F.coalesce(filled(llm), term, F.when(label == -1, "Unassigned").otherwise(F.concat(F.lit("topic "), label.cast("string"))))


def is_unnamed(llm: Column, terms: Column, label: Column) -> Column:
    """The label that is shown is a stand-in."""
    blank = ~F.exists(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    return (label != -1) & (F.coalesce(F.trim(llm), F.lit("")) == "") & blank


def drill_down(operations: DataFrame, assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """``(topic, place, op_id, label, root, similarity)``: the operations of each topic by their labels, case aside, from 1.

    ``operations(op_id, root)``, ``assignments(op_id, label, similarity)``, ``labels(op_id, label)``. An operation
    without a label is called by its id; one without a topic is in -1 with similarity 0; equal labels stand by id.
    """
    named = operations.select("op_id", "root").join(labels.select("op_id", F.nullif("label", F.lit("")).alias("said")), "op_id", "left")
    placed = named.join(assignments.select("op_id", F.col("label").alias("topic"), "similarity"), "op_id", "left")
    rows = placed.select(F.coalesce("topic", F.lit(-1)).alias("topic"), "op_id", F.coalesce("said", F.col("op_id").cast("string")).alias("label"), "root", F.when(F.col("topic").isNull(), 0.0).otherwise(F.col("similarity")).alias("similarity"))
    order = W.partitionBy("topic").orderBy(F.lower("label"), "op_id")
    return rows.withColumn("place", F.row_number().over(order)).select("topic", "place", "op_id", "label", "root", "similarity")


def assign_operations(operations: DataFrame, topics: DataFrame, *, embedder: Callable[[DataFrame], DataFrame], answers: DataFrame | None = None) -> DataFrame:
    """``(op_id, label, similarity)`` of the operations that get a topic, by what formed the topics.

    ``operations(op_id, text)``, ``topics(label, centroid, fallback)``. Topics of a whole-corpus fallback take ``answers(op_id,
    label)`` with similarity 1, and nothing where there is none; they never fall back to centroids. Other topics take
    the nearest centroid of ``embedder(operations)``, ``(op_id, embedding)``; blank texts and no centroids give none.
    """
    if not topics.where("fallback").isEmpty():
        if answers is None:
            raise ValueError("topics of a fallback need answers")
        known = answers.where("label is not null").join(operations.select("op_id"), "op_id", "left_semi")
        return known.select("op_id", "label", F.lit(1.0).alias("similarity"))
    return assign_topics(embedder(prepared(operations)), topics.where("centroid is not null"), key="op_id")


def build_clusters(members: DataFrame, terms: DataFrame) -> DataFrame:
    """``(label, n_members, terms)`` of every label, -1 included, from ``members(name, label)`` and ``terms(cluster, term, rank)``; the members stay a table."""
    top = terms.groupBy(F.col("cluster").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return members.groupBy("label").agg(F.count("*").alias("n_members")).join(top, "label", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def name_clusters(clusters: DataFrame, answers: DataFrame) -> DataFrame:
    """``clusters(label, terms, …)`` with ``name``: the answer ``(label, name)``, else the first term, else ``unlabeled``."""
    return clusters.join(answers.select("label", "name"), "label", "left").withColumn("name", F.coalesce("name", F.get("terms", F.lit(0)), F.lit("unlabeled")))


def prepared(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """Documents whose text isn't blank."""
    return documents.where(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")) != "")


def readme_packages(readmes: DataFrame, classes: DataFrame) -> DataFrame:
    """``(path, package)``: the common dotted prefix of the packages of all ``classes(filename, package)`` below the folder of ``readmes(path)``; without a class: null."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    parts = F.split(folder(F.col("filename")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    held = classes.where("package is not null").select("package", F.explode(F.array_distinct(above)).alias("folder")).distinct()
    inside = readmes.select("path", folder(F.col("path")).alias("folder")).join(held, "folder")
    return readmes.select("path").join(common_prefix(inside, by="path"), "path", "left").select("path", F.col("prefix").alias("package"))


def topic_list(topics: DataFrame) -> DataFrame:
    """Topics ``(label, n_members, …)`` with ``place``: more members first, equal ones by label, -1 last. Topics are few."""
    return topics.withColumn("place", F.row_number().over(W.orderBy(F.col("label") == -1, F.desc("n_members"), "label")))


def discover_topics(
    documents: DataFrame, *, key: str, text: str = "text", terms: str = "text", preset: str = "fine", embedder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, readmes: DataFrame | None = None, package: str | None = None, answers: DataFrame | None = None, fallback: Callable[[DataFrame], DataFrame] | None = None, force: bool = False
) -> dict[str, DataFrame]:
    """Topics of documents: ``members(key, label)``, ``clusters(label, n_members, terms, name, fallback)``, ``centroids`` and ``readmes(label, path)``.

    Blank texts are left out. Embeddings are reduced and clustered by density with the preset's sizes; terms come from
    class-based TF-IDF. An ``embedder`` (see ``embed_with``) takes the place of the hashed TF-IDF; its vectors are clustered
    as they are. If the clusters are degenerate (see ``coverage``) and there is a ``fallback``, or it is forced, its ``members(key, label)`` take
    their place; otherwise ``answers(label, name)`` name the clusters. Readmes are attached by the members' ``package``.
    """
    if force and fallback is None:
        raise ValueError("a forced fallback needs one")
    neighbours, dimensions, least, samples = PRESETS[preset]
    kept = materialize(prepared(documents, text=text))
    # The principal components need a matrix of features by features on the driver: 512 make 2 MB.
    reduced = embed(kept, key=key, text=text, features=512, dimensions=dimensions) if embedder is None else embed_with(kept, embedder, key=key, text=text)
    vectors = materialize(reduced.select(key, unit(F.transform("embedding", lambda x: x.cast("double"))).alias("embedding")))
    told = False
    if force:
        members, told = fallback(kept), True
    else:
        members = materialize(density_clusters(vectors, min_cluster=least, min_samples=samples, neighbours=neighbours, key=key))
        # The classes that were asked for count, blank ones included.
        if fallback is not None and coverage(documents.select(F.col(key).alias("name")), members.select(F.col(key).alias("name"), "label")).first()["degenerate"]:
            members, told = fallback(kept), True
    members = materialize(members.select(key, "label"))
    counted = term_counts(kept.join(members, key), cluster="label", text=terms)
    clusters = build_clusters(members, top_terms(class_tfidf(counted)))
    none = members.select("label", F.lit(None).cast("string").alias("name")).limit(0)
    named = name_clusters(clusters, answers if answers is not None and not told else none).withColumn("fallback", F.lit(told))
    out = {"members": members, "clusters": named, "centroids": centroids(vectors.join(members, key))}
    if readmes is not None and package is not None:
        out["readmes"] = attach_readmes(kept.join(members, key).select("label", F.col(package).alias("package")), readmes)
    return out
