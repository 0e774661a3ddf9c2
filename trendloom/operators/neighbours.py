"""Nearest neighbours by cosine or Hamming distance, exact or in the nearest cells only.

Vectors are scaled to length one, so that the straight-line distance between two of them is a
metric in step with cosine (and, for vectors of +1 and -1, with Hamming) distance:

1. Copies are searched once: of equal vectors the k + 1 lowest ids can be among k nearest.
2. A sample of the distinct vectors serves as pivots; each vector belongs to the cell of its
   nearest pivot. As pivots are drawn from the data, dense regions get many cells. Cells near each
   other form a tile, large cells are cut into several tiles.
3. Each query searches the tile of its own cell, which bounds the distance of its k-th neighbour,
   then the tiles with a cell that the triangle inequality cannot rule out, and there only such
   cells.

A task holds one tile and one batch of queries, as packed vectors, and returns at most k + 1 rows
per query. A query travels once per tile, not per cell, and the number of tiles stays the same until
a tile reaches ``BLOCK`` vectors: until then the shuffle grows with the vectors. Where the data have no
structure no cell can be ruled out and the exact search compares all pairs; ``probes`` limits it to that
many nearest cells per query, with some neighbours missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators.ranking import first_per_group
from trendloom.session import settle

TILES = 6  # until a tile reaches BLOCK vectors
BLOCK = 1 << 16  # most base vectors, and queries, of a task
LEAST = 1024  # fewest, where there are as many
BATCH = 512  # queries compared at a time
SPAN = 4096  # with so many base vectors
WHOLE = 1 << 14  # most vectors of a group that a task compares with each other
PIVOT_BYTES = 32 << 20  # pivots travel to every task, so their size has a bound
_CELL_ENTRIES = 1 << 22  # distances to pivots held at a time


def sign_vector(codes: Column) -> Column:
    """Packed bits as a vector of +1 and -1."""
    return F.flatten(
        F.transform(
            codes,
            lambda word: F.transform(
                F.sequence(F.lit(31), F.lit(0), F.lit(-1)),
                lambda i: (F.call_function("shiftright", word, i).bitwiseAND(F.lit(1)) * 2 - 1).cast("double"),
            ),
        )
    )


def _distance(dot: np.ndarray, metric: str, size: int) -> np.ndarray:
    if metric == "hamming":
        return np.rint((1 - dot) * size / 2)
    # rounded, so that pairs at one distance tie whatever the order of their sums
    return np.round(1 - dot, 9) + 0.0


def _chord(distance, metric: str, size: int):
    """The straight-line distance that rounding may have left behind ``distance``."""
    return np.sqrt(np.maximum(4 * distance / size if metric == "hamming" else 2 * distance, 0) + 4e-9)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Packed vectors as the rows of a matrix."""
    packed = vectors.to_pylist()
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)


def _pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    step = max(1, _CELL_ENTRIES // len(pivots))
    for start in range(0, len(vectors), step):
        part = slice(start, start + step)
        yield part, np.sqrt(np.maximum(2 - 2 * vectors[part] @ pivots.T, 0))


def _distinct(points: DataFrame, keep: int) -> DataFrame:
    """(rep, vector, ids): distinct vectors, their lowest id and their ``keep`` lowest ids."""
    lowest = first_per_group(points.select("vector", "id"), ["vector"], [F.asc("id")], keep)
    return lowest.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.element_at("ids", 1).alias("rep"), "vector", "ids"
    )


def _locate(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Pack the vectors (little-endian doubles), add the nearest pivot (``cell``) and the distance to
    it (``off``)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                cell = np.empty(len(matrix), dtype=np.int32)
                off = np.empty(len(matrix))
                for part, d in _pivot_distances(matrix, shared.value):
                    cell[part] = d.argmin(axis=1)
                    off[part] = d.min(axis=1)
                packed = pa.array([row.tobytes() for row in matrix.astype("<f8")], pa.binary())
                yield pa.record_batch(
                    [batch.column("rep"), packed, pa.array(cell), pa.array(off)], names=["rep", "vector", "cell", "off"]
                )

    return vectors.select("rep", "vector").mapInArrow(place, "rep bigint, vector binary, cell int, off double")


def _tiles(counts: np.ndarray, centres: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First tile and number of tiles of each cell, and the number of all tiles.

    A tile holds about ``most`` vectors: cells of pivots near each other share one, a larger cell is
    cut into several.
    """
    anchors = centres[: max(1, int(len(centres) ** 0.5))]
    near = np.empty(len(centres), dtype=np.int64)
    for part, d in _pivot_distances(centres, anchors):
        near[part] = d.argmin(axis=1)
    first, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    tile = held = 0
    for cell in np.argsort(near, kind="stable"):
        if held and held + counts[cell] > most:
            tile, held = tile + 1, 0
        first[cell], parts[cell] = tile, max(1, -(-counts[cell] // most))
        held += counts[cell]
        if parts[cell] > 1:
            tile, held = tile + int(parts[cell]), 0
    return first, parts, tile + (held > 0) or 1


def _in_reach(
    vectors: np.ndarray, worst: np.ndarray, pivots: np.ndarray, radius: np.ndarray,
    probes: int | None, metric: str, size: int,
) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of the queries with the cells that may hold a neighbour as near as the ``worst`` found,
    or with their nearest ``probes`` cells."""
    for part, d in _pivot_distances(vectors, pivots):
        if probes is None:
            near = (d - radius <= _chord(worst[part, None], metric, size) + 1e-6) & (radius >= 0)
        else:
            last = min(probes, d.shape[1]) - 1
            near = d <= np.partition(d, last, axis=1)[:, last : last + 1]
        yield part, near


class _Best:
    """The ``most`` nearest found so far of some queries, lower ids first on ties."""

    def __init__(self, queries: np.ndarray, worst: np.ndarray, most: int, metric: str, size: int) -> None:
        self.queries, self.worst, self.most, self.metric, self.size = queries, worst.copy(), most, metric, size
        self.row = np.empty(0, dtype=np.int64)
        self.near = np.empty(0, dtype=np.int64)
        self.distance = np.empty(0)

    def look(self, ids: np.ndarray, vectors: np.ndarray, allowed: np.ndarray | None = None) -> None:
        dots = self.queries @ vectors.T
        if allowed is not None:
            dots[~allowed] = -np.inf
        # what a row cannot keep goes before distances are rounded; the margins cover the rounding
        step = (2 * self.worst + 1) / self.size if self.metric == "hamming" else self.worst
        least = 1 - step - 2e-9
        if len(ids) > self.most:
            fresh = np.nonzero(np.isinf(self.worst))[0]
            if len(fresh):
                top = np.partition(dots[fresh], len(ids) - self.most, axis=1)[:, len(ids) - self.most]
                least[fresh] = top - 2e-9
        row, column = np.nonzero((dots >= least[:, None]) & (dots > -np.inf))
        if not len(row):
            return
        row, near, distance = (
            np.concatenate(x)
            for x in (
                (self.row, row), (self.near, ids[column]),
                (self.distance, _distance(dots[row, column], self.metric, self.size)),
            )
        )
        order = np.lexsort((near, distance, row))
        row, near, distance = row[order], near[order], distance[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.most
        full = place == self.most - 1
        self.worst[row[full]] = np.minimum(self.worst[row[full]], distance[full])
        self.row, self.near, self.distance = row[kept], near[kept], distance[kept]


def _search(
    queries: DataFrame, base: DataFrame, pivots: np.ndarray, radius: np.ndarray,
    most: int, metric: str, size: int, probes: int | None,
) -> DataFrame:
    """(rep, near, distance): the ``most`` nearest of each query in each tile it was sent to.

    ``queries`` (tile, batch, rep, vector, cell, worst) meet ``base`` (tile, batch, rep, vector, cell).
    A task holds one batch and one tile, both of bounded size. It takes its queries cell by cell,
    starts with their own cell and leaves out the cells that the worst neighbour found rules out.
    """
    shared = queries.sparkSession.sparkContext.broadcast((pivots, radius))
    names = ["rep", "near", "distance"]
    shape = pa.schema([("rep", pa.int64()), ("near", pa.int64()), ("distance", pa.float64())])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        centres, radii = shared.value
        left = left.sort_by([("cell", "ascending"), ("rep", "ascending")])
        right = right.sort_by([("cell", "ascending"), ("rep", "ascending")])
        ids, vectors = right["rep"].to_numpy(), _matrix(right["vector"])
        cells, starts = np.unique(right["cell"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(ids))
        sought, given = _matrix(left["vector"]), left["worst"].to_numpy()
        homes, reps = left["cell"].to_numpy(), left["rep"].to_numpy()
        found = []
        for at in range(0, len(sought), BATCH):
            part = slice(at, at + BATCH)
            best = _Best(sought[part], given[part], most, metric, size)
            own = np.isin(cells, homes[part]) & np.isinf(given[part]).any()
            for first in (True, False):
                reach = np.concatenate(
                    [near for _, near in _in_reach(sought[part], best.worst, centres, radii, probes, metric, size)]
                )[:, cells]
                wanted = np.nonzero(own if first else reach.any(axis=0) & ~own)[0]
                for taken in _spans(wanted, ends - starts):
                    rows = np.concatenate([np.arange(starts[c], ends[c]) for c in taken])
                    allowed = None
                    if probes is not None:
                        allowed = np.repeat(reach[:, taken], ends[taken] - starts[taken], axis=1)
                    for low in range(0, len(rows), SPAN):
                        some = rows[low : low + SPAN]
                        best.look(ids[some], vectors[some], None if allowed is None else allowed[:, low : low + SPAN])
            found.append((reps[part][best.row], best.near, best.distance))
        return pa.table([np.concatenate(x) for x in zip(*found)], names=names)

    group = ["tile", "batch"]
    return (
        queries.select(*group, "rep", "vector", "cell", "worst")
        .groupBy(*group)
        # renamed, as both sides may come from one table
        .cogroup(base.select(*group, "rep", "vector", "cell").toDF(*group, "rep", "vector", "cell").groupBy(*group))
        .applyInArrow(nearest, "rep bigint, near bigint, distance double")
    )


def _spans(cells: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Cells in runs of about ``SPAN`` vectors together."""
    if len(cells):
        run = (np.cumsum(sizes[cells]) - 1) // SPAN
        yield from np.split(cells, np.nonzero(np.diff(run))[0] + 1)


def _tiles_in_reach(
    queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, first: np.ndarray, parts: np.ndarray,
    probes: int | None, metric: str, size: int,
) -> DataFrame:
    """(rep, vector, cell, worst, tiles): the tiles besides ``home`` that a query still has to search."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, radius, first, parts))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii, start, count = shared.value
        last = int((start + count).max())
        for batch in batches:
            if not batch.num_rows:
                continue
            home, worst = batch.column("home").to_numpy(), batch.column("worst").to_numpy()
            lists = []
            for part, near in _in_reach(_matrix(batch.column("vector")), worst, centres, radii, probes, metric, size):
                reached = np.zeros((len(near), last + 1), dtype=bool)
                for cell in np.nonzero(near.any(axis=0))[0]:
                    reached[:, start[cell] : start[cell] + count[cell]] |= near[:, cell : cell + 1]
                reached[np.arange(len(near)), home[part]] = False
                lists.extend(np.nonzero(line)[0].astype(np.int32) for line in reached)
            columns = [batch.column(c) for c in ("rep", "vector", "cell", "worst")]
            yield pa.record_batch(
                [*columns, pa.array(lists, pa.list_(pa.int32()))], names=["rep", "vector", "cell", "worst", "tiles"]
            )

    return queries.select("rep", "vector", "cell", "worst", "home").mapInArrow(
        reach, "rep bigint, vector binary, cell int, worst double, tiles array<int>"
    )


def _batched(queries: DataFrame, base: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Queries and base of each tile in batches of about ``most`` queries; every batch meets the whole tile."""
    # one row per tile
    counts = queries.groupBy("tile").agg(F.ceil(F.count("*") / most).cast("int").alias("batches"))
    dealt = queries.join(counts, "tile").withColumn("batch", F.pmod(F.xxhash64("rep"), "batches").cast("int"))
    copies = base.join(counts, "tile").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    return dealt, copies


def _nearest(
    points: DataFrame, others: DataFrame | None, k: int, metric: str,
    probes: int | None, pivots: int | None,
) -> DataFrame:
    """(id, neighbour, distance, rank) for (id, vector) frames; without ``others`` among the points."""
    spark = points.sparkSession
    alone = others is None
    most = k + 1 if alone else k
    distinct = settle(_distinct(points if alone else others, most))
    summary = distinct.agg(F.count("*").alias("n"), F.first(F.size("vector")).alias("size")).first()
    n, size = summary["n"], summary["size"] or 1
    if n == 0:
        empty = spark.createDataFrame([], "id bigint, neighbour bigint, distance double, rank int")
        return empty
    wanted = pivots or max(1, min(int(n**0.5), n // 512))
    wanted = min(wanted, max(1, PIVOT_BYTES // (8 * size)))
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("vector").collect()
    centres = np.array([row["vector"] for row in sample])

    base = settle(_locate(distinct.select("rep", "vector"), centres))
    # one row per pivot
    found = base.groupBy("cell").agg(F.max("off").alias("radius"), F.count("*").alias("n")).collect()
    radius, counts = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)
    for row in found:
        radius[row["cell"]], counts[row["cell"]] = row["radius"], row["n"]
    tile = min(BLOCK, max(LEAST, -(-n // TILES)))
    first_tile, parts, _ = _tiles(counts, centres, tile)
    cells = spark.createDataFrame(
        [(c, int(f), int(p)) for c, (f, p) in enumerate(zip(first_tile, parts))], "cell int, first int, parts int"
    )
    own = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int")
    tiled = base.join(cells, "cell").select("rep", "vector", "cell", own.alias("tile"))

    if alone:
        sources, home = None, tiled
    else:
        sources = settle(_sources(points))
        located = settle(_locate(sources.select("rep", "vector").distinct(), centres))
        home = located.join(cells, "cell").select("rep", "vector", "cell", own.alias("tile"))
    search = (centres, radius, most, metric, size, probes)
    unknown = home.withColumn("worst", F.lit(float("inf")))
    first = settle(_search(*_batched(unknown, tiled, tile), *search))
    bound = first.groupBy("rep").agg(F.count("*").alias("hits"), F.max("distance").alias("_worst"))
    limited = home.join(bound, "rep", "left").select(
        "rep", "vector", "cell", F.col("tile").alias("home"),
        F.when(F.col("hits") >= most, F.col("_worst")).otherwise(F.lit(float("inf"))).alias("worst"),
    )
    # settled with a list of tiles, so that a vector is written once and not per tile
    reached = settle(_tiles_in_reach(limited, centres, radius, first_tile, parts, probes, metric, size))
    routes = reached.withColumn("tile", F.explode("tiles")).drop("tiles")
    if not routes.isEmpty():
        first = first.unionByName(_search(*_batched(routes, tiled, tile), *search))
    best = first_per_group(first, ["rep"], [F.asc("distance"), F.asc("near")], most)

    listed = best.join(distinct.select(F.col("rep").alias("near"), "ids"), "near").select(
        "rep", "distance", F.explode("ids").alias("neighbour")
    )
    # copies have the same list but for themselves, so its best rows serve all of them
    listed = first_per_group(listed, ["rep"], [F.asc("distance"), F.asc("neighbour")], most)
    members = _members(points, distinct) if alone else sources.select("id", "rep")
    pairs = members.join(listed, "rep").select("id", "neighbour", "distance")
    if alone:
        pairs = pairs.filter("id <> neighbour")
    ranked = first_per_group(
        pairs, ["id"], [F.asc("distance"), F.asc("neighbour")], k, name="rank"
    )
    return ranked.select("id", "neighbour", "distance", "rank")


def _sources(points: DataFrame) -> DataFrame:
    """(id, rep, vector): queries, with the lowest id among equal vectors."""
    lowest = points.groupBy("vector").agg(F.min("id").alias("rep"))
    return points.join(lowest, "vector").select("id", "rep", "vector")


def _members(points: DataFrame, distinct: DataFrame) -> DataFrame:
    return points.join(distinct.select("rep", "vector"), "vector").select("id", "rep")


def knn_cosine(
    points: DataFrame, k: int, others: DataFrame | None = None,
    probes: int | None = None, pivots: int | None = None,
) -> DataFrame:
    """The ``k`` nearest of each point of (id, embedding) by 1 − cosine, lower ids first on ties.

    Without ``others`` the neighbours are other points. Vectors without a direction are left out.
    """
    def unit(frame: DataFrame) -> DataFrame:
        scaled = scalars.normalize_vector(F.col("embedding")).alias("vector")
        return settle(frame.select(F.col("id").cast("bigint").alias("id"), scaled).filter(F.col("vector").isNotNull()))

    return _nearest(unit(points), None if others is None else unit(others), k, "cosine", probes, pivots)


def knn_in_groups(points: DataFrame, group: str, k: int) -> DataFrame:
    """``knn_cosine`` among the points (id, ``group``, embedding) of each group, all pairs compared.

    A task holds one group, so groups have at most about ``WHOLE`` points. Ids are unique.
    """
    names = ["id", "neighbour", "distance", "rank"]

    def nearest(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids = rows["id"].to_numpy()
        vectors = rows["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        found = []
        for at in range(0, len(ids), BATCH):
            part = slice(at, at + BATCH)
            best = _Best(vectors[part], np.full(len(ids[part]), np.inf), k + 1, "cosine", vectors.shape[1])
            for low in range(0, len(ids), SPAN):
                best.look(ids[low : low + SPAN], vectors[low : low + SPAN])
            other = best.near != ids[part][best.row]
            row, near, distance = best.row[other], best.near[other], best.distance[other]
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            kept = rank <= k
            found.append((ids[part][row[kept]], near[kept], distance[kept], rank[kept].astype(np.int32)))
        return pa.table([np.concatenate(x) for x in zip(*found)], names=names)

    scaled = scalars.normalize_vector(F.col("embedding")).alias("vector")
    unit = points.select(F.col("id").cast("bigint").alias("id"), group, scaled).filter(F.col("vector").isNotNull())
    return unit.groupBy(group).applyInArrow(nearest, "id bigint, neighbour bigint, distance double, rank int")


def knn_hamming(
    points: DataFrame, k: int, others: DataFrame | None = None,
    probes: int | None = None, pivots: int | None = None,
) -> DataFrame:
    """The same over packed bits: (id, codes) with codes from ``quantize_bits``."""
    def unit(frame: DataFrame) -> DataFrame:
        signs = frame.select(F.col("id").cast("bigint").alias("id"), sign_vector(F.col("codes")).alias("signs"))
        return settle(signs.select("id", scalars.normalize_vector(F.col("signs")).alias("vector")))

    return _nearest(unit(points), None if others is None else unit(others), k, "hamming", probes, pivots)


def core_distance(neighbours: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): distance to the ``min_samples``-th neighbour, or the last one there is."""
    return (
        neighbours.filter(F.col("rank") <= min_samples)
        .groupBy("id")
        .agg(F.max("distance").alias("core"))
    )
