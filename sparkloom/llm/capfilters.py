"""Near-duplicate vectors by spherical-cap filters.

Filters are the words of a random product code: after a random rotation the dimensions are cut
into blocks, each block has its own random unit vectors, and a filter is one of them from every
block, end to end. A vector is list-decoded to the filters whose caps it lies deepest in, a fixed number
of them: block scores are sorted, and a partial word that as many others beat is dropped, so that
work follows the length of the list. Vectors meet where they share a filter (and a label) and are
verified by cosine in double precision.

The rotation is random, so how likely a pair meets depends on the code and its cosine alone: it is
measured on random pairs at the least cosine when a code is made, and lists grow until it suffices.

Equal vectors of a label are one class, so that copies cost nothing; links are counted with
their copies. A pair counts where it meets in its least common filter, so once; what leaves a filter
is a row a vector (how many it links with there, and one link towards its component), not a row a
pair. A filter that very many vectors pass is cut into tiles, each the work of another task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, scope
from sparkloom.llm.components import components
from sparkloom.llm.runs import whole_runs

#: Lengths of lists tried, vectors that share a filter by chance at first, and vectors multiplied at once.
LISTS, CROWD, TILE = (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256), 128, 1024
#: Vectors of one filter that a task compares; lengths of vectors whose codes the driver makes (those beyond are made where they are used).
SHARE, CODES = 4096, 100
#: Pairs at the least cosine that a code is measured on, and the share of them that has to meet.
PAIRS, RECALL = 2000, 0.999


@dataclass(frozen=True)
class Code:
    """rotation (dim x dim), one matrix of unit vectors a block, and the number of filters a vector passes."""

    rotation: np.ndarray
    blocks: list[np.ndarray]
    list: int

    @classmethod
    def of(cls, dim: int, n: int, least: float = 0.93, seed: int = 5) -> Code:
        """For n vectors of a label: the shortest lists by which pairs at the least cosine meet.

        Where no list is long enough (few dimensions), filters get fewer, at last so few that all vectors meet.
        """
        rng = np.random.default_rng([seed, dim])
        u, g = _unit(rng.standard_normal((PAIRS, dim))), rng.standard_normal((PAIRS, dim))
        g -= (g * u).sum(axis=1, keepdims=True) * u
        v = least * u + np.sqrt(max(0.0, 1 - least**2)) * _unit(g) if dim > 1 else u
        crowd = CROWD
        while True:
            for length in LISTS:
                code = cls._sized(dim, length * n // crowd, length, seed)
                met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(u), code.decode(v))]
                if np.mean(met) >= RECALL:
                    return code
            crowd *= 4

    @classmethod
    def _sized(cls, dim: int, filters: int, length: int, seed: int) -> Code:
        """At least as many filters, in the fewest blocks of at most 256 vectors."""
        rng = np.random.default_rng([seed, dim, length])
        m = next((m for m in range(1, dim + 1) if 256**m >= filters), dim)
        size = max(4, int(np.ceil(filters ** (1 / m))))
        rotation = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))[0]
        widths = [dim * (i + 1) // m - dim * i // m for i in range(m)]
        blocks = [(lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((size, w))) for w in widths]
        return cls(rotation, blocks, length)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The filters' numbers each unit row of x passes: a row of the `list` best (all, where there are fewer)."""
        return np.concatenate([self._best(x[i : i + TILE] @ self.rotation) for i in range(0, len(x), TILE)])

    def _best(self, y: np.ndarray) -> np.ndarray:
        at, word, total = 0, np.zeros((len(y), 1), np.int64), np.zeros((len(y), 1))
        for b in self.blocks:
            scores = y[:, at : at + b.shape[1]] @ b.T
            at += b.shape[1]
            order = np.argsort(-scores, axis=1, kind="stable")[:, : self.list]
            ranked = np.take_along_axis(scores, order, 1)
            # The i-th partial word with the j-th vector is beaten by (i + 1) * (j + 1) - 1 others at least.
            i, j = np.nonzero(np.outer(np.arange(total.shape[1]) + 1, np.arange(order.shape[1]) + 1) <= self.list)
            sums = total[:, i] + ranked[:, j]
            best = np.argsort(-sums, axis=1, kind="stable")[:, : self.list]
            total = np.take_along_axis(sums, best, 1)
            word = np.take_along_axis(word, i[best], 1) * len(b) + np.take_along_axis(order, j[best], 1)
        return word


def _matrix(column, dim: int | None, kind=np.float64, rows: int = -1) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, dim or -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(x: np.ndarray, fs: np.ndarray, f: int, left: np.ndarray, right: np.ndarray, copies: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(root, others) by row: the first row it is joined with here, and how many vectors it links with, for pairs of
    cosine >= least that share no filter below f. Pairs are of a row in `left` and one in `right`; if they are the same, each pair once."""
    u = _unit(x)
    below = fs < f
    values, column, n = np.unique(fs[below], return_inverse=True, return_counts=True)
    use = (n > 1)[column]  # filters below f that two rows pass
    rows, column = np.nonzero(below)[0][use], (np.cumsum(n > 1) - 1)[column[use]]
    width = int((n > 1).sum())

    def marks(pick: np.ndarray, lo: int) -> np.ndarray:
        place = np.full(len(x), -1)
        place[pick] = np.arange(len(pick))
        out = np.zeros((len(pick), min(TILE, width - lo)), np.float32)
        own = (place[rows] >= 0) & (column >= lo) & (column < lo + TILE)
        out[place[rows[own]], column[own] - lo] = 1
        return out

    root, others, same = np.arange(len(x)), np.zeros(len(x), np.int64), len(left) == len(right) and bool((left == right).all())
    for p in range(0, len(left), TILE):
        for q in range(p if same else 0, len(right), TILE):
            a, b = left[p : p + TILE], right[q : q + TILE]
            near = u[a] @ u[b].T >= least
            if same and p == q:
                near &= np.triu(np.ones(near.shape, bool), 1)
            for lo in range(0, width, TILE):
                if not near.any():
                    break
                near &= marks(a, lo) @ marks(b, lo).T < 0.5
            if not near.any():
                continue
            others[a] += near @ copies[b]
            others[b] += near.T @ copies[a]
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            while True:  # each root takes the least root it is linked with, until nothing changes
                s, t = root[i], root[j]
                if (s == t).all():
                    break
                np.minimum.at(root, s, t), np.minimum.at(root, t, s)
                while (root[root] != root).any():
                    root = root[root]
    return root, others


def near_vectors(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Null vectors, zero vectors, vectors with a null or non-finite component, null labels and null
    ids link with nothing: n_links 0, a component of their own. Vectors of different length don't
    link. Repeated rows are copies that link with one another. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    v = F.col(embedding)
    fit = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fit &= F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("e"), F.coalesce(fit, F.lit(False)).alias("fit"))
    with scope(spark, 5000):
        classes = rows.where("fit").groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        classes = materialize(spark, classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("e")), "caps-classes")
        met = materialize(spark, _meetings(classes, least, seed), "caps-met")
        count = met.groupBy("u").agg(F.sum("others").alias("others"))
        found = components(met.where("u != v").select("u", "v"))
        rooted = classes.select("cid", "least", "copies").join(found, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
        roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.join(roots, "root").join(count, F.col("cid") == F.col("u"), "left").select("cid", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        named = classes.select(F.col("label").alias("l"), F.col("e").alias("x"), "cid").join(named, "cid").drop("cid")
        out = rows.where("fit").join(named, (F.col("label") == F.col("l")) & (F.col("e") == F.col("x"))).select("vec_id", "n_links", "component_id")
        alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
        return materialize(spark, out, "caps-rows", keep=True)


def _meetings(classes: DataFrame, least: float, seed: int) -> DataFrame:
    """u, v, others: for each vector and filter in which it has links, how many vectors (with copies) and one towards its component."""
    spark, share = classes.sparkSession, SHARE
    shapes = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n"))
    made = {s["dim"]: Code.of(s["dim"], s["n"], least, seed) for s in shapes.orderBy("dim").limit(CODES).collect()}
    kind, number = classes.schema["label"].dataType.simpleString(), classes.schema["e"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in made:
                    made[dim] = Code.of(dim, part.column(5)[0].as_py(), least, seed)
                passed = np.sort(made[dim].decode(_unit(_matrix(part.column(4), dim))), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(passed) + 1, dtype=np.int32) * passed.shape[1]), pa.array(passed.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), lists], names=["label", "dim", "cid", "copies", "e", "fs"])

    passed = classes.join(shapes, "dim").select("label", "dim", "cid", "copies", "e", "n").mapInArrow(decode, f"label {kind}, dim int, cid long, copies long, e {number}, fs array<long>")
    passed = materialize(spark, passed, "caps-passed")
    dealt = passed.select("label", "dim", F.explode("fs").alias("f"), "cid")
    # Only filters that two vectors share carry vectors on; a filter of many is cut into pairs of shares.
    runs = dealt.groupBy("label", "dim", "f").agg(F.ceil(F.count("*") / F.lit(float(share))).cast("int").alias("k"), F.count("*").alias("n")).where("n > 1").drop("n")
    tiles = dealt.join(runs, ["label", "dim", "f"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    tiles = tiles.withColumn("by", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("label", "dim", "f", F.least("own", "by").alias("i"), F.greatest("own", "by").alias("j"), "own", "cid")
    key = ["label", "dim", "f", "i", "j"]
    wide = tiles.join(passed.select("cid", "copies", "e", "fs"), "cid").select(*key, "own", "cid", "copies", "e", "fs").repartition(*key).sortWithinPartitions(*key, "cid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, run in whole_runs(batches, 5):
            dim, f, i, j, own, cid, copies = (t.column(c).to_numpy() for c in range(1, 8))
            cuts, us, vs, ns = np.flatnonzero(np.diff(run, prepend=-1, append=run[-1] + 1)), [], [], []
            for a, z in zip(cuts, cuts[1:]):
                if z - a > 1:
                    x, fs = _matrix(t.column(8).slice(a, z - a), int(dim[a])), _matrix(t.column(9).slice(a, z - a), None, np.int64, z - a)
                    left, right = (np.flatnonzero(own[a:z] == share[a]) for share in (i, j))
                    root, others = linked(x, fs, f[a], left, right, copies[a:z], least)
                    pick = np.flatnonzero(others)
                    us.append(cid[a:z][pick]), vs.append(cid[a:z][root[pick]]), ns.append(others[pick])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ns)], names=["u", "v", "others"])

    return wide.mapInArrow(verify, "u long, v long, others long")
