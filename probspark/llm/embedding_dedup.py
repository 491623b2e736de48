"""Near-duplicate vectors through a robust-pruned flat graph.

1. Equal vectors of a label meet as one representative with a number of copies.
2. A label above ``most`` vectors is split once into shards, by pivots sampled from it, one for half of
   ``most`` vectors; pivots near each other count as one, so a group of near copies is never torn apart.
   A vector is stored in its home shard alone, that of its nearest pivot.  It asks there, and in each shard to
   whose side it has at most half the range's chord to go.  The ends of a link are a chord apart at most, and the
   plane that parts their homes lies between them, so the nearer one asks in the other's home: no link is lost
   between shards, and no vector is stored or built into a graph twice.
3. In a shard above ``most`` members, those so near its pivot that any two of them must link (the
   angle between two is at most the sum of theirs to the pivot) are its core: they are
   counted, not compared.
4. Every shard builds a flat graph, one above ``most`` members in blocks of that size: nearest
   candidates, thinned by robust pruning.
5. Vectors are searched in the shards where they ask, but in none whose core they are in: greedy beam
   search from the medoids, then expansion through all vectors near the range.  A task
   holds one block of vectors and one of queries.  Cosines are verified in double
   precision, and a pair whose ends ask in each other's homes counts in the first one.  A pair found
   from one end counts at both: a shard of one task is closed under exchange of ends, and guests
   of a shard and blocks of a large one are verified whole.
6. A bounded set of vectors, half of them with links, is audited by brute force against
   all rows, each vector's recall by itself, so a small group weighs as much as a large one.
   A mean or a tenth (lowest) below ``least_recall`` repeats the search once with wider lists;
   if that isn't enough, all pairs of a label are compared in blocks instead.
7. A task gives each vector the smallest one that its links reach there, and components
   of these edges are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probspark.llm.common import stored
from probspark.llm.components import components

RANGE = 0.98
MOST_MEMBERS = 1500
AUDITED = 200
ENTRIES = 32
SHARDS = "rep long, copies long, embedding array<double>, label string, cell string, home long, visits array<long>, core boolean"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of extreme components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def robust_graph(x: np.ndarray, degree: int, candidates: int, alpha: float = 1.2) -> list[np.ndarray]:
    """Each row's neighbours among its nearest ``candidates``: one is dropped when a kept one is ``alpha`` times nearer to it."""
    n = len(x)
    k = min(candidates, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    lists = []
    together = max(1, min(512, 4_000_000 // (k * max(k, x.shape[1]))))
    for low in range(0, n, together):
        near = x[low : low + together] @ x.T
        rows = np.arange(len(near))[:, None]
        near[rows[:, 0], np.arange(low, low + len(near))] = -2
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        top = top[rows, np.argsort(-near[rows, top], axis=1, kind="stable")]
        own = x[top]
        distance = np.sqrt(np.maximum(0, 2 - 2 * near[rows, top]))
        between = np.sqrt(np.maximum(0, 2 - 2 * (own @ own.transpose(0, 2, 1))))
        alive, kept, count = np.ones(top.shape, bool), np.zeros(top.shape, bool), np.zeros(len(top), np.int64)
        for j in range(k):  # the j-th nearest candidate of every row at once
            kept[:, j] = alive[:, j] & (count < degree)
            count += kept[:, j]
            alive &= ~kept[:, j, None] | (alpha * between[:, j] > distance)
        lists += [t[m] for t, m in zip(top, kept, strict=True)]
    return lists


def _adjacency(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's neighbours begin, one end more, and the neighbours of undirected pairs."""
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    return np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=n))]), pairs[:, 1]


def range_search(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], asked: np.ndarray, own: np.ndarray, beam: int, threshold: float = RANGE, slack: float = 0.05) -> np.ndarray:
    """Boolean queries x rows: the rows found within ``threshold``; all queries walk together.

    ``asked`` are the queries' vectors and ``own`` their rows of ``x`` (-1 for others).  Each starts from the medoids, from
    evenly dealt entries, which reach parts of the graph that no path joins, and from its own place; it doesn't find itself.
    """
    n, m = len(x), len(asked)
    starts, neighbours = graph
    centre = x @ x.mean(0)
    medoids = np.unique([centre.argmax(), centre.argmin(), np.abs(centre).argmin(), *np.linspace(0, n - 1, min(n, ENTRIES)).astype(int)])
    cosine = np.full((m, n), -2.0)  # of the rows seen
    expanded = np.zeros((m, n), bool)
    cosine[:, medoids] = asked @ x[medoids].T
    here = np.flatnonzero(own >= 0)
    cosine[here, own[here]] = 1.0
    flat = cosine.reshape(-1)

    def unseen(who: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = starts[nodes + 1] - starts[nodes]
        next_ = neighbours[np.arange(count.sum()) + np.repeat(starts[nodes] - np.cumsum(count) + count, count)]
        who = np.repeat(who, count)
        new = flat[who * n + next_] == -2.0
        return who[new], next_[new]

    def see(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out = np.empty(len(who))
        for at in range(0, len(who), 20_000):
            out[at : at + 20_000] = np.einsum("ij,ij->i", asked[who[at : at + 20_000]], x[nodes[at : at + 20_000]])
        flat[who * n + nodes] = out
        return out

    width = min(beam, n)
    start = np.where(np.isin(own, medoids) | (own < 0), -1, own)[:, None]
    top = np.concatenate([np.broadcast_to(medoids, (m, len(medoids))), start], axis=1)
    top = np.concatenate([top, np.full((m, max(0, width - top.shape[1])), -1)], axis=1)
    value = np.where(top >= 0, np.take_along_axis(cosine, np.maximum(top, 0), 1), -4.0)
    kept = np.argpartition(-value, width - 1, axis=1)[:, :width]
    top, value = np.take_along_axis(top, kept, 1), np.take_along_axis(value, kept, 1)
    left = value.copy()  # -4 where expanded
    while True:  # greedy: the best row of each query's beam that isn't expanded, for every query at once
        at = left.argmax(1)
        who = np.flatnonzero(left[np.arange(m), at] > -2)
        if not len(who):
            break
        node = top[who, at[who]]
        left[who, at[who]] = -4.0
        expanded[who, node] = True
        whose, next_ = unseen(who, node)
        seen = see(whose, next_)
        enters = seen > value.min(1)[whose]
        whose, next_, seen = whose[enters], next_[enters], seen[enters]
        if not len(whose):
            continue
        some, row, count = np.unique(whose, return_inverse=True, return_counts=True)
        column = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)
        nodes, values = np.full((len(some), count.max()), -1), np.full((len(some), count.max()), -4.0)
        nodes[row, column], values[row, column] = next_, seen
        all_ = np.concatenate([value[some], values], axis=1)
        kept = np.argpartition(-all_, width - 1, axis=1)[:, :width]
        value[some] = np.take_along_axis(all_, kept, 1)
        top[some] = np.take_along_axis(np.concatenate([top[some], nodes], axis=1), kept, 1)
        left[some] = np.take_along_axis(np.concatenate([left[some], values], axis=1), kept, 1)
    step = max(1, 400_000 // max(1, np.diff(starts).max()))  # rows at a time
    while True:  # range: every row near the range is expanded
        who, nodes = np.nonzero((cosine >= threshold - slack) & ~expanded)
        if not len(who):
            break
        expanded[who, nodes] = True
        for low in range(0, len(who), step):
            whose, next_ = unseen(who[low : low + step], nodes[low : low + step])
            flat[whose * n + next_] = -3.0  # to be seen, once
        see(*np.nonzero(cosine == -3.0))
    found = cosine >= threshold
    found[here, own[here]] = False
    return found


def _split(table: pa.Table, threshold: float = RANGE) -> pa.Table:
    """Members of one block of an oversized label, each with its home shard and the shards where it asks."""
    table = table.sort_by("n")  # pivots arrive in any order, and a label's blocks must choose and name alike
    pivot = table.column("pivot").to_numpy()
    x = unit_rows(_matrix(table.column("embedding")))
    heads = x[pivot]
    half = ((1 + threshold) / 2) ** 0.5 + 1e-9  # two vectors at half the range's angle from the pivot are within the range of each other
    step = max(1, 4_000_000 // len(heads))
    central = np.concatenate([(heads[low : low + step] @ heads.T >= half).sum(1) for low in range(0, len(heads), step)])
    apart: list[int] = []
    for i in np.argsort(-central, kind="stable"):  # of pivots in a group of near copies, the most central one
        if not apart or (heads[apart] @ heads[i]).max() < 0.8:
            apart.append(i)
    heads, names = heads[apart], table.column("n").to_numpy()[pivot][apart]
    rows, x = table.filter(pa.array(~pivot)), x[~pivot]
    home, core, visits = np.zeros(len(x), np.int64), np.zeros(len(x), bool), []
    for low in range(0, len(x), step):
        cosines = x[low : low + step] @ heads.T
        at = cosines.argmax(1)
        best = np.take_along_axis(cosines, at[:, None], 1)
        between = np.sqrt(np.maximum(0, 2 - 2 * (heads[at] @ heads.T)))
        asks = best - cosines <= (0.5 * (2 - 2 * threshold) ** 0.5 + 1e-9) * between  # how far the plane between the two pivots is
        asks[np.arange(len(at)), at] = True
        home[low : low + step], core[low : low + step] = names[at], best[:, 0] >= half
        visits += [names[v] for v in asks]
    cells = [f"{c.as_py()}/{h}" for c, h in zip(rows.column("cell"), home, strict=True)]
    out = {k: rows.column(k) for k in ("rep", "copies", "embedding")}
    return pa.table(out | {"label": rows.column("cell"), "cell": pa.array(cells, pa.string()), "home": home, "visits": pa.array(visits, pa.list_(pa.int64())), "core": core})


def cluster_shards(vectors: DataFrame, most: int = MOST_MEMBERS, threshold: float = RANGE) -> DataFrame:
    """``rep, copies, embedding, label, cell, home, visits, core``: a row per vector, with its shard (``cell``, number ``home`` of its label) and those where it asks."""
    large = F.broadcast(vectors.groupBy("cell").count().filter(F.col("count") > most))  # a row for ``most`` vectors at most
    whole = vectors.join(large, "cell", "left_anti").select(
        "rep", "copies", "embedding", F.col("cell").alias("label"), F.concat("cell", F.lit("/0")).alias("cell"), F.lit(0).cast("long").alias("home"), F.array(F.lit(0).cast("long")).alias("visits"), F.lit(False).alias("core")
    )
    split = vectors.join(large, "cell").withColumn("pivots", F.ceil(2 * F.col("count") / most))
    order = F.xxhash64(F.lit(0), "rep")
    pivots = split.groupBy("cell", "count", "pivots", F.pmod(order, "pivots").alias("n")).agg(F.min_by("embedding", F.struct(order, "rep")).alias("embedding"))
    blocks = F.ceil(F.col("count") / F.greatest(F.lit(4096), 8 * F.col("pivots"))).cast("int")
    pivots = pivots.select(F.lit(-1).cast("long").alias("rep"), F.lit(0).cast("long").alias("copies"), "embedding", "cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("pivot"), "n")
    members = split.select("rep", "copies", "embedding", "cell", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), F.lit(False).alias("pivot"), F.col("pivots").alias("n"))
    # a union of parts dealt alike isn't dealt anew, though they may be coalesced or split each in its way: deal it here
    parts = members.unionByName(pivots).repartition("cell", "block").groupBy("cell", "block").applyInArrow(lambda table: _split(table, threshold), SHARDS)
    return whole.unionByName(parts)


def near_duplicates(vectors: DataFrame, degree: int = 20, candidates: int = 48, beam: int = 32, threshold: float = RANGE, most: int = MOST_MEMBERS, least_recall: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept, audit_recall`` for each row of ``vectors`` (``vec_id, embedding, label``).

    Vectors link when labels and lengths are equal and their cosine is ``threshold`` or more.  Null, empty
    and zero vectors, those with null or non-finite components and those without a label link with nothing.  Equal rows are
    copies that link with each other; a null ``vec_id`` gives a row without links.  Empty tables give no rows.  Other columns
    are not read.  ``audit_recall`` is the mean share of an audited vector's links that the search found, or the lowest tenth's
    where that is less (null where they have none); ``audit_way`` is ``graph``, or ``all pairs`` where that was too little.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    linkable = rows.filter("usable").select("vec_id", "embedding", F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("cell"))
    groups = stored(linkable.groupBy("cell", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "copies", "embedding", "cell"), "vectors")
    ids = stored(linkable.join(groups, ["cell", "embedding"]).select("vec_id", "rep", "copies"), "vector-ids")
    links, edges, recall, way = graph_links(groups, degree, candidates, beam, threshold, most, least_recall)
    classes = components(edges)
    linked = ids.join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out.withColumn("audit_recall", F.lit(recall).cast("double")).withColumn("audit_way", F.lit(way))


def graph_links(groups: DataFrame, degree: int, candidates: int, beam: int, threshold: float, most: int, least_recall: float) -> tuple[DataFrame, DataFrame, float | None, str]:
    """(``rep, links``; edges whose components are the classes; audited recall; way) of distinct vectors ``rep, copies, embedding, cell``."""
    members = stored(cluster_shards(groups, most, threshold), "shards")
    sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes.filter("blocks > 1"))
    members = _or_one(members, sizes, "blocks").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("core", F.col("core") & (F.col("blocks") > 1))
    cores = members.filter("core")
    heads = cores.groupBy("cell").agg(F.sum("copies").alias("total"), F.min("rep").alias("head"))
    cores = stored(cores.join(heads, "cell").select("rep", (F.col("total") - F.col("copies")).alias("links"), F.col("head").alias("least")), "cores")
    way = "graph"
    for _ in range(2):
        found = stored(_search(members, sizes, degree, candidates, beam, threshold, most).unionByName(cores), "links")
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        recall = audited_recall(groups, links, threshold)
        if recall is None or recall >= least_recall:
            break
        degree, candidates, beam = 2 * degree, 2 * candidates, 2 * beam
    else:
        found, way = stored(all_pairs(groups, threshold, most), "links"), "all pairs"
        recall = 1.0
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    return links, found.filter("least < rep").select("rep", "least"), recall, way


def _or_one(rows: DataFrame, numbers: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the numbers of their cell, 1 where it has none."""
    return rows.join(numbers, "cell", "left").withColumns({k: F.coalesce(k, F.lit(1)) for k in names})


def _search(members: DataFrame, sizes: DataFrame, degree: int, candidates: int, beam: int, threshold: float, most: int) -> DataFrame:
    """Tasks of one block of a shard's vectors and one block of its queries; vectors of the shard's own core aren't queries."""
    asked = members.select("label", "rep", "copies", "embedding", "home", "core", F.explode("visits").alias("visit"))
    asked = asked.withColumn("cell", F.concat_ws("/", "label", F.col("visit").cast("string"))).withColumn("guest", F.col("visit") != F.col("home")).filter("guest or not core")
    asked = _or_one(asked, sizes, "blocks")
    numbers = asked.groupBy("cell", "blocks").agg(F.count_if("guest").alias("guests"), F.count_if(~F.col("guest")).alias("own"))
    parts = numbers.select("cell", F.greatest(F.lit(1), F.least(F.ceil(F.col("own") / most), "blocks")).cast("int").alias("owns"), F.ceil(F.col("guests") / (2 * most)).cast("int").alias("guests"))
    parts = F.broadcast(parts.select("cell", "owns", F.greatest("owns", "guests").alias("parts")).filter("parts > 1"))  # shards of split labels alone have several
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "rep", "copies", "embedding", "home", "blocks"]
    built = members.groupBy("cell", "block").applyInArrow(_builder(degree, candidates), "cell string, block int, rep long, copies long, embedding array<double>, home long, blocks int, visits array<long>, core boolean, near array<long>")
    data = _or_one(built, parts, "owns", "parts").select(*columns, "visits", "core", "near", F.col("block").alias("d"), over("parts").alias("q"), F.lit(False).alias("asks"))
    asked = _or_one(asked, parts, "owns", "parts").withColumn("part", F.pmod(F.xxhash64("rep"), F.when(F.col("guest"), F.col("parts")).otherwise(F.col("owns"))).cast("int"))
    asked = asked.select(*columns, F.lit(None).cast("array<long>").alias("visits"), F.lit(False).alias("core"), F.lit(None).cast("array<long>").alias("near"), over("blocks").alias("d"), F.col("part").alias("q"), F.lit(True).alias("asks"))
    return data.unionByName(asked).repartition("cell", "d", "q").groupBy("cell", "d", "q").applyInArrow(_searcher(beam, threshold), "rep long, links long, least long")


def _builder(degree: int, candidates: int):
    def build(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        lists = robust_graph(unit_rows(_matrix(table.column("embedding"))), degree, candidates)
        columns = table.select(["cell", "block", "rep", "copies", "embedding", "home", "blocks", "visits", "core"])
        return columns.append_column("near", pa.array([rep[x] for x in lists], pa.list_(pa.int64())))

    return build


def _searcher(beam: int, threshold: float):
    return lambda table: _search_shard(table, beam, threshold)


def _search_shard(table: pa.Table, beam: int, threshold: float) -> pa.Table:
    """Per vector of a task: copies of the vectors it links with here and in no earlier shard, and the smallest one it reaches.

    A vector of the shard's own core asks nothing here, nor does any vector ask for guests, so a link of these counts for both.
    """
    table = table.take(pa.array(np.lexsort((table.column("rep").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)))))
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    home, core = table.column("home").to_numpy(), table.column("core").to_numpy(zero_copy_only=False)
    x = unit_rows(_matrix(table.column("embedding")))
    n = int((~asks).sum())  # the first n rows are the block's vectors, by number
    empty = pa.table({"rep": rep[:0], "links": rep[:0], "least": rep[:0]})
    if not n or n == len(rep):
        return empty
    near = table.column("near").slice(0, n).combine_chunks()
    source = np.repeat(np.arange(n), np.diff(near.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(rep[:n], near.flatten().to_numpy()), n - 1)
    here = rep[at] == near.flatten().to_numpy()
    graph = _adjacency(np.stack([source[here], at[here]], 1), n)
    # a pair whose ends ask in each other's homes is found in both: the first one counts it
    visits = table.column("visits").slice(0, n).combine_chunks()
    own, shards = home[0], 1 + max(home.max(), visits.flatten().to_numpy().max())
    divided = table.column("blocks")[0].as_py() > 1
    meets = np.repeat(np.arange(n), np.diff(visits.offsets.to_numpy())) * shards + visits.flatten().to_numpy()
    guest = home != own
    queries = np.flatnonzero(asks)
    place = np.minimum(np.searchsorted(rep[:n], rep), n - 1)
    place = np.where(rep[place] == rep, place, -1)
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    root[queries] = np.where(place[queries] >= 0, place[queries], queries)
    block = max(1, min(512, 2_000_000 // n))
    found = []
    for low in range(0, len(queries), block):
        some = queries[low : low + block]
        a, b = np.nonzero(range_search(x[:n], graph, x[some], place[some], beam, threshold))
        found.append(some[a] * n + b)
        if not divided:  # the other end of a guest's link may ask elsewhere, or not at all
            some = some[guest[some]]
        if len(some):  # a large shard's blocks meet in several tasks: what one end finds the other must find in its own
            a, b = np.nonzero(x[some] @ x[:n].T >= threshold)
            real = place[some][a] != b
            found.append(some[a[real]] * n + b[real])
    found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if not divided and len(found):  # all ends are here: what one of them found is the other's too
        asker = np.full(n, -1, np.int64)  # the query of each row, if it asks
        asker[place[queries][place[queries] >= 0]] = queries[place[queries] >= 0]
        a, b = found // n, found % n
        back = (asker[b] >= 0) & ~guest[a]
        found = np.unique(np.concatenate([found, asker[b[back]] * n + place[a[back]]]))
    for low in range(0, len(found), 1_000_000):
        a, b = found[low : low + 1_000_000] // n, found[low : low + 1_000_000] % n
        counted = (home[a] >= own) | ~np.isin(b * shards + home[a], meets)
        np.add.at(links, a[counted], copies[b[counted]])
        both = counted & (guest[a] | core[b])
        np.add.at(links, b[both], copies[a[both]])
        root = unite(root, a, b, rep)
    return pa.table({"rep": rep, "links": links, "least": rep[root]})


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The member with the smallest ``order`` (its number) of each one's class once the pairs (a, b) are joined to the classes of ``root``."""
    order = np.arange(len(root)) if order is None else order
    while True:
        ra, rb = root[a], root[b]
        swap = order[ra] > order[rb]
        low, high = np.where(swap, rb, ra), np.where(swap, ra, rb)
        apart = low != high
        apart &= order[low] < order[high]
        if not apart.any():
            return root
        low, high = low[apart], high[apart]
        by = np.lexsort((order[low], high))
        low, high = low[by], high[by]
        first = np.ones(len(high), bool)
        first[1:] = high[1:] != high[:-1]
        root = root.copy()
        root[high[first]] = low[first]
        while (root[root] != root).any():
            root = root[root]


def audited_recall(groups: DataFrame, links: DataFrame, threshold: float) -> float | None:
    """Of AUDITED vectors, half of them with links where there are as many, the mean share of a vector's links that was found, or the lowest tenth's if that is less; None if they have none."""
    order = F.xxhash64("rep")
    linked = links.filter("links > 0").join(groups, "rep").select("rep", "copies", "embedding", "cell").orderBy(order).limit(AUDITED // 2)
    sample = linked.unionByName(groups.select("rep", "copies", "embedding", "cell").orderBy(order).limit(AUDITED // 2)).dropDuplicates(["rep"])
    asked = sample.collect()  # AUDITED vectors at most
    truth = {r[0]: r[1] for r in _brute_force(groups, asked, threshold).collect()}
    ids = groups.sparkSession.createDataFrame([(r[0],) for r in asked], "rep long")
    got = {r[0]: r[1] for r in links.join(F.broadcast(ids), "rep").collect()}
    own = sorted(min(n, got.get(r, 0)) / n for r, n in truth.items() if n)
    return min(sum(own) / len(own), own[len(own) // 10]) if own else None


def _brute_force(groups: DataFrame, asked: list, threshold: float) -> DataFrame:
    """``rep, links`` of the asked vectors (at most AUDITED), counted against all rows."""
    ids, cells = np.array([r[0] for r in asked], np.int64), [r[3] for r in asked]
    by_cell = {c: (ids[[i for i, x in enumerate(cells) if x == c]], unit_rows(np.array([r[2] for r in asked if r[3] == c]))) for c in set(cells)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("cell").to_pylist(), object)
            for c, (own, q) in by_cell.items():
                here = np.flatnonzero(names == c)
                if len(here):
                    some = batch.take(pa.array(here))
                    near = q @ unit_rows(_matrix(some.column("embedding"))).T >= threshold
                    near &= own[:, None] != some.column("rep").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array((near * some.column("copies").to_numpy()).sum(1))], ["rep", "links"])

    return groups.mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def all_pairs(groups: DataFrame, threshold: float, most: int) -> DataFrame:
    """``rep, links, least`` from all pairs of each label, a block against a block in each task: the exact way, at quadratic cost."""
    blocks = groups.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    rows = groups.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    over = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("cell", "rep", "copies", "embedding", F.col("block").alias("i"), over.alias("j"), F.lit(True).alias("asks"))
    right = rows.select("cell", "rep", "copies", "embedding", over.alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        rep, copies, x = table.column("rep").to_numpy(), table.column("copies").to_numpy(), unit_rows(_matrix(table.column("embedding")))
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        near = (x[left] @ x[right].T >= threshold) & (rep[left][:, None] != rep[right])
        links = np.zeros(len(rep), np.int64)
        links[left] = (near * copies[right]).sum(1)
        a, b = np.nonzero(near)
        root = unite(np.arange(len(rep)), left[a], right[b], rep)
        return pa.table({"rep": rep, "links": links, "least": rep[root]})

    return left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(compare, "rep long, links long, least long")
