"""Embedding near-dedup with a flat graph.

Vectors of one label are cut into cluster shards that overlap. In each shard a graph is built
whose edges are pruned robustly: a neighbour is left out if a kept one is much nearer to
it. Adjacency lists of a vector from all its shards are united. A search starts at a shard's
medoid, goes greedily to the nearest vectors, and from the first one in range goes on through
all that are in range. Links are verified by the exact cosine, and recall is audited.

A vector joins every shard whose border is near to it. If both ends of a link were farther from the
border between their homes than half of how far apart they are across it, they would be farther
apart than they are; so with that margin one end joins the home of the other, at every level. Half the
greatest distance of two linked vectors is therefore certain. Where that would cut nothing, each
border has a margin of its own, measured on true links of the same group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lexsieve.llm.common import named, objects, packed, parallelism, unpacked
from lexsieve.llm.components import components
from lexsieve.sources.shared import settle

OUTPUTS = ["n_links", "component_id", "kept"]
# Vectors of a group that one task compares with the group's centres at a time.
CHUNK = 4_000
# Vectors of a group whose links are looked for to measure margins; with fewer links than FEW_LINKS
# nothing is measured.
SAMPLE, FEW_LINKS, MOST_LINKS = 2_048, 30, 512


def valid(vector: Column) -> Column:
    """Whether a vector has a direction: components all finite, and not all zero."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(doubles, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _stack(column: pd.Series) -> np.ndarray:
    return unit(np.array([np.asarray(v, float) for v in column]))


def margins(centres: np.ndarray, links: np.ndarray, least: float, margin: float | None) -> np.ndarray:
    """How near a vector must be to the border of each two centres to join both cells.

    Half the greatest distance of two linked vectors is certain. With ``margin``, and if there are
    links enough (rows of differences), it is ``margin`` times half the widest extent of any of them across
    the border, and the certain one at most.
    """
    certain = np.full((len(centres),) * 2, np.sqrt(2 - 2 * least) / 2)
    if margin is None or len(links) < FEW_LINKS:
        return certain
    along, wide = links @ centres.T, np.zeros_like(certain)
    for i in range(len(centres)):
        wide[i] = np.abs(along - along[:, [i]]).max(0)
    return np.minimum(certain, margin * wide / (2 * _apart(centres)))


def _apart(centres: np.ndarray) -> np.ndarray:
    squared = (centres**2).sum(1)
    return np.sqrt(np.maximum(squared[:, None] + squared[None, :] - 2 * centres @ centres.T, 1e-12))


def borders(vectors: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Matrix of the cells that each vector joins: that of its nearest centre, and those whose plane
    between that and their own centre is no farther than ``reach`` of the two."""
    squared = ((vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T) + (centres**2).sum(1)[None, :]
    home = squared.argmin(1)
    depth = (squared - squared.min(1, keepdims=True)) / (2 * _apart(centres)[home])
    return depth <= reach[home] + 1e-9


def robust_prune(
    vectors: np.ndarray, own: int, candidates: np.ndarray, near: np.ndarray, degree: int, alpha: float
) -> list[int]:
    """At most ``degree`` neighbours from candidates sorted by distance ``near``."""
    kept: list[int] = []
    left = np.ones(len(candidates), bool)
    for i in range(len(candidates)):
        if not left[i]:
            continue
        kept.append(int(candidates[i]))
        if len(kept) == degree:
            break
        between = np.linalg.norm(vectors[candidates] - vectors[candidates[i]], axis=1)
        left &= alpha * between > near
    return kept


def build_graph(
    vectors: np.ndarray, degree: int = 16, alpha: float = 1.2, pool: int = 40
) -> list[list[int]]:
    """Adjacency lists of a shard: each vector's pool of nearest ones, pruned, with edges back;
    every vector is tied to the medoid's tree by its nearest neighbour nearer to the medoid."""
    n = len(vectors)
    if n < 2:
        return [[] for _ in range(n)]
    close = vectors @ vectors.T
    np.fill_diagonal(close, -np.inf)
    size = min(pool, n - 1)
    nearest = np.argpartition(-close, size - 1, axis=1)[:, :size]
    lists: list[list[int]] = []
    for i in range(n):
        c = nearest[i][np.argsort(-close[i, nearest[i]], kind="stable")]
        near = np.sqrt(np.maximum(2 - 2 * close[i, c], 0))
        lists.append(robust_prune(vectors, i, c, near, degree, alpha))
    edges = [set(x) for x in lists]
    for i, x in enumerate(lists):
        for j in x:
            edges[j].add(i)
    top = medoid(vectors)
    to_top = vectors @ vectors[top]
    better = to_top[None, :] > to_top[:, None]
    up = np.where(better, close, -np.inf).argmax(1)
    for i in range(n):
        if i != top:
            edges[int(up[i])].add(i)
    return [sorted(x) for x in edges]


def medoid(vectors: np.ndarray) -> int:
    """The vector nearest to the mean."""
    return int((vectors @ vectors.mean(0)).argmax())


def range_search(
    vectors: np.ndarray, edges: list[np.ndarray], query: np.ndarray, start: int, least: float, width: int = 32,
) -> np.ndarray:
    """Vectors with a cosine of ``least`` or more that the graph leads to.

    Greedy with a list of the ``width`` best; it is not cut while vectors in range are in it,
    so all neighbours of what is in range are seen.
    """
    seen = np.zeros(len(vectors), bool)
    seen[start] = True
    ids, scores = np.array([start]), vectors[[start]] @ query
    done = np.zeros(1, bool)
    while not done.all():
        at = np.flatnonzero(~done)[0]
        done[at] = True
        new = edges[ids[at]]
        new = new[~seen[new]]
        seen[new] = True
        if len(new):
            ids, scores = np.r_[ids, new], np.r_[scores, vectors[new] @ query]
            done = np.r_[done, np.zeros(len(new), bool)]
            order = np.argsort(-scores, kind="stable")
            order = order[: max(width, int((scores >= least).sum()) + 8)]
            ids, scores, done = ids[order], scores[order], done[order]
    return ids[scores >= least]


def _overlap(centres: np.ndarray, reach: np.ndarray) -> float:
    """Expected share of a group's cells that a vector would join, from the centres themselves,
    each seen by the others."""
    n = len(centres)
    joined = []
    for i in range(n):
        rest = np.delete(np.arange(n), i)
        joined.append(borders(centres[[i]], centres[rest], reach[np.ix_(rest, rest)]).sum())
    return float(np.mean(joined)) / n


def _worth(centres: list, links: np.ndarray | None, least: float, margin: float | None) -> bool:
    """Whether a cut at least halves the pairs: a share f of n cells each leaves n * f * f of them."""
    if len(centres) < 4:
        return False
    points = _stack(pd.Series([c["vec"] for c in centres]))
    share = _overlap(points, margins(points, _differences(links, points), least, margin))
    return len(points) * share * share < 0.5


def _differences(links: np.ndarray | None, centres: np.ndarray) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in ([] if links is None else links)]).reshape(-1, centres.shape[1])


def _sampled_links(df: DataFrame, rows: int, least: float, seed: int) -> DataFrame:
    """(root, links): the differences between sampled vectors of a group of more than twice ``rows``
    and the farthest vector each is linked with, at most ``MOST_LINKS`` of a group."""
    sizes = df.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * rows)
    chance = F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    sized = df.join(sizes, "grp").withColumn("chunks", chunks)
    members = sized.withColumn("chunk", F.pmod(F.xxhash64("rid"), "chunks").cast("int"))
    asked = sized.filter(chance < SAMPLE / F.col("n")).select(
        F.col("grp").alias("root"), F.col("rid").alias("own"), F.col("vec").alias("query"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"),
    )

    def farthest(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(there):
            points, own = _stack(there["vec"]), there["rid"].to_numpy()
            for i in range(0, len(asked), 256):
                some = asked.iloc[i : i + 256]
                queries = _stack(some["query"])
                close = queries @ points.T
                close[(close < least) | (some["own"].to_numpy()[:, None] == own[None, :])] = np.inf
                at = close.argmin(1)
                out += [
                    (g, r, float(close[k, j]), (queries[k] - points[j]).tolist())
                    for k, (g, r, j) in enumerate(zip(some["root"], some["own"], at, strict=True)) if close[k, j] < 2
                ]
        names = ["root", "rid", "cosine", "link"]
        return pd.DataFrame({name: objects([x[i] for x in out]) for i, name in enumerate(names)})

    found = asked.groupBy("root", "part").cogroup(members.groupBy("grp", "chunk")).applyInPandas(
        farthest, "root string, rid string, cosine double, link array<double>"
    )
    each = found.groupBy("root", "rid").agg(F.min_by("link", "cosine").alias("link"))
    return each.groupBy("root").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("rid").alias("h"), "link"))), 1, MOST_LINKS)["link"].alias("links")
    )


def _split(
    df: DataFrame, kind: str, rows: int, least: float, margin: float | None, seed: int, most_centres: int
) -> DataFrame:
    """Cut the groups of (rid, vec, grp) with more than twice ``rows`` members into overlapping
    cells around sampled members, one level at a time.

    A level has at most ``most_centres`` centres for a group, chosen by hash, so a deep corpus takes
    more levels, not more centres. A group that a cut would not relieve (a dense place) is left
    whole, to the blocks of the search.
    """

    @F.pandas_udf("boolean")
    def worth(centres: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([_worth(list(c), x, least, margin) for c, x in zip(centres, links, strict=True)])

    def deal(group: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(centres):
            return pd.DataFrame(columns=["rid", "vec", "grp"])
        middle = _stack(pd.Series([c["vec"] for c in centres["centres"].iloc[0]]))
        reach = margins(middle, _differences(centres["links"].iloc[0], middle), least, margin)
        row, cell = np.nonzero(borders(_stack(group["vec"]), middle, reach))
        taken = group.iloc[row]
        return pd.DataFrame({
            "rid": objects(taken["rid"]), "vec": objects(taken["vec"]),
            "grp": objects([f"{g}/{c}" for g, c in zip(taken["grp"], cell, strict=True)]),
        })

    sampled = None if margin is None else settle(_sampled_links(df, rows, least, seed))
    # The label may have a slash, a cell's own number has none.
    done, level = None, 0
    while True:
        sizes = df.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * rows)
        wanted = F.least(F.ceil(3 * F.col("n") / rows), F.lit(most_centres))
        chance = F.pmod(F.xxhash64(F.lit(seed + level), "rid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chosen = df.join(sizes, "grp").filter(chance < 1.5 * wanted / F.col("n")).groupBy("grp", "n").agg(
            F.sort_array(F.collect_list(F.struct(chance.alias("c"), "vec"))).alias("centres")
        ).withColumn("centres", F.slice("centres", F.lit(1), wanted.cast("int")))
        if sampled is None:
            told = chosen.withColumn("links", F.lit(None).cast("array<array<double>>"))
        else:
            root = F.regexp_replace("grp", f"(/[0-9]+){{{level}}}$", "") if level else F.col("grp")
            told = chosen.withColumn("root", root).join(sampled, "root", "left").drop("root")
        picked = settle(told.filter(worth("centres", "links")))
        if picked.isEmpty():
            return df if done is None else done.unionByName(df)
        whole = df.join(picked.select("grp"), "grp", "left_anti")
        done = whole if done is None else done.unionByName(whole)
        # Members meet the centres in chunks, so a large group is many tasks.
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        members = df.join(picked.select("grp", "n"), "grp").withColumn(
            "chunk", F.pmod(F.xxhash64("rid"), chunks).cast("int")
        ).drop("n")
        each = F.explode(F.sequence(F.lit(0), chunks - 1))
        centres = picked.select("grp", "centres", "links", each.alias("chunk"))
        df = settle(members.groupBy("grp", "chunk").cogroup(centres.groupBy("grp", "chunk")).applyInPandas(
            deal, f"rid string, vec array<{kind}>, grp string"
        ))
        level += 1


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    least: float = 0.98, shard_rows: int = 400, margin: float | None = 1.25, degree: int = 16, alpha: float = 1.2,
    block: int = 2_000, seed: int = 4, most_centres: int = 256,
) -> DataFrame:
    """All rows with ``n_links`` (other rows linked directly), ``component_id`` (least key
    reachable by links) and ``kept`` (key = component_id).

    Rows are linked if their labels are equal and not null and their cosine, in double precision,
    is ``least`` or more; invalid vectors (null, zero, with a null or non-finite component) and
    vectors of other lengths link with none. Equal vectors of a label are one vector throughout, so
    large groups of copies cost nothing; their links are counted by multiplication. A null key
    is never a component_id while another key is reachable.

    Two linked vectors are up to r = sqrt(2 - 2 * least) apart. With ``margin`` None a vector joins the
    shard beyond every border that is r / 2 away or nearer, and no link is lost to a border. Otherwise a
    border's margin is ``margin`` times half the widest extent across it of up to 512 true links
    of the same label and length, r / 2 at most, and r / 2 where fewer than 30 were found: a link can be lost
    only if it is wider across a border than all of those. :func:`audit_recall` measures what is found.

    Shards have about ``shard_rows`` vectors; where a dense place cannot be cut, its shard is searched
    in blocks of ``block`` vectors against one another, so a task stays bounded.
    """
    kind = "float" if isinstance(df.schema[vector].dataType.elementType, FloatType) else "double"
    valid_row = valid(named(vector)) & named(label).isNotNull()
    given = named(vector).cast(f"array<{kind}>")
    rid = F.when(valid_row, F.md5(F.concat_ws("|", named(label).cast("string"), F.array_join(given, ","))))
    rows = packed(df, OUTPUTS, key=named(key), rid=rid, label=named(label).cast("string"), vec=given)
    vectors = settle(
        rows.filter("rid is not null").groupBy("rid").agg(
            F.count("*").alias("copies"), F.min("key").alias("key"),
            F.first("label").alias("label"), F.first("vec").alias("vec"),
        )
    )
    start = vectors.select("rid", "vec", F.concat_ws(":", "label", F.size("vec")).alias("grp"))
    shards = _split(start, kind, shard_rows, least, margin, seed, most_centres)
    sizes = shards.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    shards = settle(shards.join(sizes, "grp").withColumn("node", F.xxhash64("rid")).withColumn(
        "part", F.pmod("node", F.col("blocks")).cast("int")
    ))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        lists = build_graph(_stack(rows["vec"]), degree, alpha)
        node = rows["node"].to_numpy()
        return pd.DataFrame({"rid": objects(rows["rid"]), "near": objects([node[x].tolist() for x in lists])})

    built = shards.groupBy("grp", "part").applyInPandas(build, "rid string, near array<bigint>")
    united = built.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = settle(shards.join(united, "rid"))

    # Nodes of a block, and the vectors of each block of the shard as queries.
    nodes = graph.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", "part", "q", "rid", "node", "vec", "near", F.lit(True).alias("is_node")
    )
    queries = graph.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", F.col("p").alias("part"), F.col("part").alias("q"), "rid", "node", "vec",
        F.array().cast("array<bigint>").alias("near"), F.lit(False).alias("is_node"),
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        inside, asked = rows[rows["is_node"]], rows[~rows["is_node"]]
        if not len(inside) or not len(asked):
            return pd.DataFrame({"a": objects([]), "b": objects([])})
        points, rid = _stack(inside["vec"]), inside["rid"].to_numpy()
        place = {x: i for i, x in enumerate(inside["node"])}
        edges = [
            np.array([place[x] for x in near if x in place], np.int64) for near in inside["near"]
        ]
        top, found = medoid(points), []
        for query, own in zip(_stack(asked["vec"]), asked["rid"], strict=True):
            # The exact cosine decides; the search is a little wider for rounding.
            hits = range_search(points, edges, query, top, least - 1e-9)
            hits = hits[(points[hits] * query).sum(1) >= least]
            found += [(own, rid[h]) for h in hits if rid[h] != own]
        return pd.DataFrame({name: objects([f[i] for f in found]) for i, name in enumerate("ab")})

    hits = nodes.unionByName(queries).groupBy("grp", "part", "q").applyInPandas(search, "a string, b string")
    links = settle(hits.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = vectors.select(F.col("rid").alias("b"), "copies")
    counts = both.join(weights, "b").groupBy("a").agg(F.sum("copies").alias("linked"))
    labels = components(links)
    told = (
        vectors.select("rid", "copies", "key")
        .join(counts.withColumnRenamed("a", "rid"), "rid", "left")
        .join(labels.withColumnRenamed("node", "rid"), "rid", "left")
        .withColumn("label", F.coalesce("label", "rid"))
    )
    told = settle(told)
    heads = told.groupBy("label").agg(F.min("key").alias("component_id"))
    info = settle(told.join(heads, "label").select(
        "rid", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    ))
    joined = rows.select("row", "key", "rid").join(info, "rid", "left")
    component = F.when(F.col("rid").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return unpacked(
        joined.withColumn("component", component),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"),
    )


def audited_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98,
    target: float = 0.9, every: int = 20, audit_rows: int = 2_000, **options,
) -> tuple[DataFrame, float]:
    """(:func:`near_vectors`, its recall), the recall measured by :func:`audit_recall` on the table itself.

    Below ``target`` the search is made again with certain margins and graphs of twice the degree, and
    audited again. The result is settled, so that what was audited is what is given.
    """
    recall = 0.0
    for wider in ({}, {"margin": None, "degree": 2 * options.get("degree", 16)}):
        found = settle(near_vectors(df, key, vector, label, least, **{**options, **wider}))
        recall = audit_recall(df, found, key, vector, label, least, every, audit_rows=audit_rows)
        if recall >= target:
            break
    return found, recall


def audit_recall(
    df: DataFrame, found: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    least: float = 0.98, every: int = 20, block: int = 2_000, audit_rows: int = 2_000,
) -> float:
    """Share of the true links of rows whose key is divisible by ``every`` that ``found`` (the
    result of :func:`near_vectors`) has, by brute force against all rows of the same label, in blocks
    of queries and rows. 1.0 if there is no link.

    At most ``audit_rows`` of these rows, chosen by a hash of their keys, are asked for, so the work grows with
    the table and not with its square; what is asked for is compared with every row."""
    rows = df.filter(valid(named(vector)) & named(label).isNotNull()).select(
        named(key).alias("key"), F.concat_ws(":", named(label).cast("string"), F.size(named(vector))).alias("label"),
        named(vector).cast("array<double>").alias("vec"),
    )
    parts = parallelism(df.sparkSession)
    asked = rows.filter(F.col("key") % every == 0).orderBy(F.xxhash64("key"), "key").limit(audit_rows)
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).withColumn("asks", F.lit(False))
    both = dealt.unionByName(asked.withColumn("part", every_part).withColumn("asks", F.lit(True)))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        asked, there = group[group["asks"]], group[~group["asks"]]
        if not len(asked) or not len(there):
            return pd.DataFrame({"key": [], "n": []})
        points, own = _stack(there["vec"]), there["key"].to_numpy()
        out = []
        for i in range(0, len(asked), block):
            some = asked.iloc[i : i + block]
            near = _stack(some["vec"]) @ points.T >= least
            near &= some["key"].to_numpy()[:, None] != own[None, :]
            out.append(pd.DataFrame({"key": some["key"].to_numpy(), "n": near.sum(1)}))
        return pd.concat(out)

    truth = both.groupBy("label", "part").applyInPandas(count, "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n")
    )
    sums = truth.join(found.select(named(key).alias("key"), "n_links"), "key").agg(
        F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("found")
    ).first()
    return sums["found"] / sums["n"] if sums["n"] else 1.0
