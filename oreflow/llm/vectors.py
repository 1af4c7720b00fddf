"""Blocks of vectors, and near-duplicate vectors by tile products of int8 codes."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreflow.llm.common import squeezed, unsqueezed
from oreflow.llm.components import components, smallest_reached
from oreflow.session import materialize, shuffles_removed

BLOCK_ROWS = 4096
TILE_ROWS = 256
HEAD = 16
SIDE_BYTES = 1 << 27
SIDES = 8
PIVOTS = 16
THRESHOLD = 0.9
ROUNDING = 1e-9


def usable(column: str = "embedding"):
    """Vectors without null or non-finite components and with at least one component."""
    values = F.col(column)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return values.isNotNull() & (F.size(values) > 0) & ~F.coalesce(bad, F.lit(True))


def pivots_of(rows: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """A few vectors of the most frequent length, smallest by hash; they only sort and prune, so any choice is right."""
    top = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if top is None:
        return np.empty((0, 0))
    same = rows.filter(F.col("dim") == top.dim).select("vector", F.xxhash64("vec_id").alias("place"), "vec_id")
    found = same.orderBy("place", "vec_id").limit(count).collect()
    return _unit(np.array([r.vector for r in found], dtype=np.float64))[0]


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1), norm[:, 0]


def blocks(rows: DataFrame, pivots: np.ndarray, size: int = BLOCK_ROWS) -> DataFrame:
    """(block, dim, ids, vectors, low, high) as of ``parts_of``, with blocks numbered from 0 in a column of its own; the list
    of numbers has one small row per block."""
    stored = materialize(rows.sparkSession, parts_of(rows, pivots, size))
    number = F.row_number().over(Window.orderBy("part", "made")) - 1
    numbers = materialize(rows.sparkSession, stored.select("part", "made", number.alias("block")))
    return materialize(rows.sparkSession, stored.join(F.broadcast(numbers), ["part", "made"]).drop("part", "made"))


def number_kind(rows: DataFrame, column: str) -> str:
    """The kind of the components of an array column in bytes: single precision if they have it, else double."""
    return "<f4" if rows.schema[column].dataType.elementType == T.FloatType() else "<f8"


def parts_of(rows: DataFrame, pivots: np.ndarray, size: int = BLOCK_ROWS, coded: bool = False) -> DataFrame:
    """(part, made, dim, ids, vectors, low, high) of up to ``size`` rows of (vec_id, vector, dim) of one length; part and
    made name a block.

    Rows are sorted by their nearest pivot and the angle to it; low and high bound the block's angles
    to every pivot. Components keep their precision. With ``coded`` blocks also have the codes, scale and missed of ``quantised``.
    """
    width = pivots.shape[1] if len(pivots) else 0
    kind = number_kind(rows, "vector")
    array = "array<float>" if kind == "<f4" else "array<double>"
    codings = {"codes": "<i1", "scale": "<f8", "missed": "<f8"} if coded else {}

    def angles(x: np.ndarray) -> np.ndarray:
        if x.shape[1] != width:
            return np.zeros((len(x), 0))
        return np.arccos(np.clip(_unit(x.astype(np.float64))[0] @ pivots.T, -1, 1))

    def keyed(batches):
        for batch in batches:
            vectors = batch.column("vector")
            dims = batch.column("dim").to_numpy()
            near, angle = np.zeros(len(dims), dtype=np.int64), np.zeros(len(dims))
            at = np.flatnonzero(dims == width) if width else np.empty(0, dtype=int)
            if len(at):
                found = angles(np.array(vectors.take(pa.array(at)).flatten()).reshape(-1, width))
                near[at], angle[at] = found.argmin(axis=1), found.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), vectors, batch.column("dim"), pa.array(near), pa.array(angle)],
                names=["vec_id", "vector", "dim", "near", "angle"],
            )

    def packed(batches):
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        part, made = TaskContext.get().partitionId(), 0

        def out():
            nonlocal made
            made += 1
            ids = np.concatenate([w[1] for w in waiting])
            vectors = np.concatenate([w[2] for w in waiting])
            found = angles(vectors)
            low, high = (found.min(axis=0), found.max(axis=0)) if len(found) else ([], [])
            dim = waiting[0][0]
            waiting.clear()
            coding = quantised(_unit(vectors.astype(np.float64))[0]) if codings else ()
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v], type=pa.int32()) for v in (part, made, dim)), pa.array([ids.astype("<i8").tobytes()]), pa.array([vectors.astype(kind).tobytes()]),
                 pa.array([list(map(float, low))], type=pa.list_(pa.float64())), pa.array([list(map(float, high))], type=pa.list_(pa.float64())),
                 *(pa.array([found.astype(k).tobytes()]) for found, k in zip(coding, codings.values()))],
                names=["part", "made", "dim", "ids", "vectors", "low", "high", *codings],
            )

        held = 0
        for batch in batches:
            dims, ids = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1), len(dims)] if len(dims) else []
            for start, stop in zip(cuts, cuts[1:]):
                dim = int(dims[start])
                x = np.array(batch.column("vector").slice(start, stop - start).flatten(), dtype=kind).reshape(-1, dim)
                if waiting and waiting[0][0] != dim:
                    yield out()
                    held = 0
                at = 0
                while at < len(x):
                    more = min(size - held, len(x) - at)
                    waiting.append((dim, ids[start + at : start + at + more], x[at : at + more]))
                    held, at = held + more, at + more
                    if held == size:
                        yield out()
                        held = 0
        if waiting:
            yield out()

    sort = ["dim", "near", "angle", "vec_id"]
    placed = rows.mapInArrow(keyed, f"vec_id long, vector {array}, dim int, near long, angle double")
    ranged = placed.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ddl = "part int, made int, dim int, ids binary, vectors binary, low array<double>, high array<double>"
    return ranged.mapInArrow(packed, ", ".join([ddl, *(f"{c} binary" for c in codings)]))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each vector and the length of what the codes miss."""
    scale = np.abs(unit).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    missed = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((missed * missed).sum(axis=1)) + 1e-12


class Coded:
    """A stored block: its codes with their scale and what they miss, and its unit vectors once they are asked for."""

    def __init__(self, row: dict, dim: int, kind: str):
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.codes = np.frombuffer(row["codes"], dtype="<i1").reshape(-1, dim)
        self.scale, self.missed = (np.frombuffer(row[c], dtype="<f8") for c in ("scale", "missed"))
        self._vectors = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, dim)

    @cached_property
    def unit(self) -> np.ndarray:
        return _unit(self._vectors.astype(np.float64))[0]


def heads(x: Coded, first: int) -> np.ndarray:
    """What the codes of the first components stand for, and a bound of the length of all others as one component more."""
    found = np.empty((len(x.codes), first + 1), dtype=np.float32)
    found[:, :first] = x.codes[:, :first] * x.scale[:, None].astype(np.float32)
    rest = x.codes[:, first:].astype(np.float32)
    found[:, first] = x.scale * np.sqrt(np.einsum("ij,ij->i", rest, rest)) + x.missed
    return found


def linked_pairs(one: Coded, two: Coded, threshold: float):
    """Places (i, j) of all pairs with cosine at least the threshold, in runs of rows.

    With unit vectors x = s p + e and y = t q + f, the product differs from s t (p q) by at most
    |e| (1 + |f|) + |f|. Products of codes are whole numbers below 2**24 for up to 1,000 components, so single
    precision gives them exactly. Only pairs that the bound leaves open are computed in double precision.

    Before that, half of the components with the lengths of what they leave out bound the product (the product of two lengths is
    the largest that the other halves can add); rows that this leaves without a partner are done.
    """
    (p, s, e), (q, t, f) = ((x.codes, x.scale, x.missed) for x in (one, two))
    kind = np.float32 if q.shape[1] <= 1000 else np.float64
    right, first = None, q.shape[1] // 2
    most_f, most_t = f.max(), t.max()
    short = (heads(one, first), np.ascontiguousarray(heads(two, first).T)) if first >= HEAD else None
    for at in range(0, len(p), TILE_ROWS):
        rows = np.arange(at, min(at + TILE_ROWS, len(p)))
        slack = e[rows] * (1 + most_f) + most_f + ROUNDING
        if short:
            single = (first + 8) / 2**22
            open_ = (short[0][rows] @ short[1]).max(axis=1) >= (threshold - slack - single).astype(np.float32)
            if 2 * open_.sum() > len(rows):
                short = None
            rows, slack = rows[open_], slack[open_]
            if not len(rows):
                continue
        if right is None:
            right = np.ascontiguousarray(q.T.astype(kind))
        product = p[rows].astype(kind) @ right
        rough = np.maximum((threshold - slack) / (s[rows] * most_t), 0).astype(kind) - 1
        i, j = np.divmod(np.flatnonzero(product >= rough[:, None]), len(q))
        near = product[i, j] * s[rows][i] * t[j] + e[rows][i] * (1 + f[j]) + f[j] + ROUNDING >= threshold
        i, j = i[near], j[near]
        if not len(i):
            continue
        x, y = one.unit[rows], two.unit
        if len(i) > 0.05 * product.size:
            exact = (x @ y.T)[i, j]
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
        good = exact >= threshold
        if good.any():
            yield rows[i[good]], j[good]


class Found:
    """What a task has found of one block: links per row, the smallest id each row reaches, and labels that belong together."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.own = ids.copy(), False
        self.n, self.label, self.links = np.zeros(len(ids), dtype=np.int64), ids.copy(), [np.empty((2, 0), dtype=np.int64)]

    def reaches(self, at: np.ndarray, label: np.ndarray) -> None:
        """Rows reach a label too; an earlier label that is not the row's own id goes on record with it."""
        before = self.label[at]
        both = np.array([before, label])[:, (before != label) & (before != self.ids[at])]
        if both.size:
            self.links.append(np.unique(both, axis=1))
        self.label[at] = np.minimum(before, label)

    def linked(self) -> np.ndarray:
        return np.unique(np.concatenate(self.links, axis=1), axis=1)


PACKED = "block long, ids binary, places binary, n binary, labels binary, links binary"


def tile_links(tiles: DataFrame, kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per task and block with links: (block, ids, places, n, labels, links), packed. Linked rows have their number of
    links in the task's tiles and the smallest id they reach there; links are pairs of labels. The ids stand in one row of every block, from its
    tile with itself."""
    columns = ("ids", "vectors", "codes", "scale", "missed")

    def run(batches):
        held: dict[int, Found] = {}
        number, one = None, None
        for batch in batches:
            blocks_, others, dims = (batch.column(c).to_pylist() for c in ("block", "other", "dim"))
            for at, (first, second, dim) in enumerate(zip(blocks_, others, dims)):
                if number != first:
                    number, one = first, Coded({c: batch.column(c)[at].as_py() for c in columns}, dim, kind)
                two = one if first == second else Coded({c: batch.column(f"{c}2")[at].as_buffer() for c in columns}, dim, kind)
                for block, ids in ((first, one.ids), (second, two.ids)):
                    if block not in held:
                        held[block] = Found(ids)
                left, right = held[first], held[second]
                left.own |= first == second
                for i, j in linked_pairs(one, two, threshold):
                    if first == second:
                        other = i != j
                        i, j = i[other], j[other]
                        left.n += np.bincount(i, minlength=len(left.n))
                        left.reaches(np.arange(len(left.n)), _joined(left.label, i, j))
                    else:
                        left.n += np.bincount(i, minlength=len(left.n))
                        right.n += np.bincount(j, minlength=len(right.n))
                        label = _joined(np.concatenate((left.label, right.label)), i, len(left.n) + j)
                        for side, found in ((left, label[: len(left.n)]), (right, label[len(left.n) :])):
                            side.reaches(np.arange(len(found)), found)
        for block, found in held.items():
            at = np.flatnonzero(found.n)
            if len(at) or found.own:
                packed = [squeezed(x) for x in (at, found.n[at], found.label[at], found.linked().ravel())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *(pa.array([v], type=pa.binary()) for v in (found.ids.tobytes() if found.own else None, *packed))],
                    names=["block", "ids", "places", "n", "labels", "links"],
                )

    return tiles.mapInArrow(run, PACKED)


def block_links(found: DataFrame) -> DataFrame:
    """(vec_id, n_links, reached) of every row of the blocks, from what the tasks found; rows with null n_links are links between ids."""

    def merged(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        whole = Found(np.frombuffer(next(r["ids"] for r in rows if r["ids"] is not None), dtype="<i8"))
        for r in rows:
            at, n, label, links = (unsqueezed(r[c]) for c in ("places", "n", "labels", "links"))
            whole.n[at] += n
            whole.reaches(at, label)
            whole.links.append(links.reshape(2, -1))
        links = whole.linked()
        return pa.table({
            "vec_id": np.concatenate((whole.ids, links[0])),
            "n_links": pa.concat_arrays([pa.array(whole.n), pa.nulls(links.shape[1], pa.int64())]),
            "reached": np.concatenate((whole.label, links[1])),
        })

    return found.groupBy("block").applyInArrow(merged, "vec_id long, n_links long, reached long")


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after merging the groups that the pairs connect; equal labels are one group."""
    names, group = np.unique(label, return_inverse=True)
    merged = smallest_reached(group[i], group[j], names)
    return merged[group]


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, size: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``rows`` (vec_id, embedding): n_links, component_id, kept.

    Sorted blocks of vectors make tiles of two blocks. A tile whose blocks' angles to some pivot are too far
    apart is left out, which the triangle inequality proves right; all others are computed, so the work
    grows with the square of the rows where vectors do not cluster, but not what is stored or shuffled. A task reports a
    count and the smallest id reached per linked row, never its pairs.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors
    of different length. Repeated rows are vectors of their own. Null vec_id: taken as no vector, n_links 0, component
    null, kept true. Extra columns are ignored. An empty table gives no rows.
    """
    spark = rows.sparkSession
    single = rows.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    all_rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>"))
    good = usable() & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    some = all_rows.filter(good).select("vec_id", F.col("embedding").alias("vector"), F.size("embedding").alias("dim"))
    with shuffles_removed(spark):
        stored = materialize(spark, parts_of(some, pivots_of(some), size, coded=True))
        found = materialize(spark, block_links(tile_links(open_tiles(stored, threshold), number_kind(some, "vector"), threshold)))
        parts = components(found.select(F.col("vec_id").alias("a"), F.col("reached").alias("b")))
    named = found.filter(F.col("n_links").isNotNull()).select("vec_id", "n_links")
    rest = all_rows.filter(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = named.unionByName(rest).join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def open_tiles(stored: DataFrame, threshold: float) -> DataFrame:
    """Every two blocks once, and every block with itself, unless their angles to some pivot are too far apart for a link.

    Each partition of the blocks meets each other one in a task that reads both where they are stored, so no block is
    shuffled and disk does not grow with the number of tiles. Which of two blocks comes first goes by the sum of their
    numbers, so that the tasks (a, b) and (b, a) have half of their tiles each.
    """
    held = stored.agg(F.sum(F.length("ids").cast("long") * F.col("dim"))).first()[0] or 0
    spread = int(np.ceil(np.sqrt(4 * stored.sparkSession.sparkContext.defaultParallelism)))
    numbered = stored.withColumn("block", F.col("part").cast("long") * (2**31 - 1) + F.col("made")).drop("part", "made")
    numbered = numbered.coalesce(max(SIDES, spread, -(-held // SIDE_BYTES)))
    other = numbered.select(*(F.col(c).alias("other" if c == "block" else f"{c}2") for c in numbered.columns))
    gap = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    far = F.coalesce(F.array_max(gap), F.lit(0.0)) > float(np.arccos(threshold)) + 1e-6
    even = (F.col("block") + F.col("other")) % 2 == 0
    once = (F.col("block") == F.col("other")) | ((F.col("block") < F.col("other")) == even)
    met = numbered.hint("shuffle_replicate_nl").join(other, (F.col("dim") == F.col("dim2")) & once & ~far)
    return met.drop("dim2", "low", "high", "low2", "high2")
