"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into blocks; two that differ in at most d bits agree on all but d blocks,
so they share the value of some choice of the other blocks. Distinct fingerprints are dealt by
each choice's value and verified within a value. A value that a dense group shares isn't
expanded into pairs: a search over its members keeps the links of a spanning forest, which has
the same components. Equal fingerprints are one class from the start.

For near copies by the similarity of their sets of shingles (`keep_one_similar`) fingerprints are longer:
a pair at 0.8 differs in 15 bits of 100, too many for blocks that surely agree, so blocks are so many
that some agrees but for a chance of 0.001. Then whole sets are compared (shingles.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import packed
from sparkloom.llm.anchored import mixed
from sparkloom.llm.common import BATCH_ROWS, carried, discard, materialize, release, scope, text_key, uncarried
from sparkloom.llm.components import components
from sparkloom.llm.runs import whole_runs

#: Fingerprints that may share a block value by chance, and the run length up to which pairs are compared at once.
CROWD, SHORT_RUN = 8, 16
#: Block values that a bucket takes, about; tasks of a shuffle at most (a task takes several buckets one after the other).
ENTRIES, MOST = 1_000_000, 50_000
#: Blocks that join what is very similar before the others.
FIRST = 8
#: Fingerprints of one value that a task compares; run length up to which long fingerprints are compared at once; a multiplier for blocks' numbers.
SHARE, LONG_RUN, SALT = 8192, 64, np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits; a bit is set if over half of the shingles' XXH64 set it. 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space parts
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: max(1, len(words) - width + 1)].tolist()
    end = end[min(width, len(words)) - 1 :].tolist()
    h = np.array([xxh64_intdigest(line[a:z], seed) for a, z in zip(start, end)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        set_bits += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(h), bitorder="little").view("<u8")[0])


def block_masks(n: int, distance: int = 4, bits: int = 64) -> list[int]:
    """Masks of the choices of blocks: few blocks for few fingerprints, more (and longer values) for many.

    Exact for any n; the number only says how many share a value by chance.
    """
    for blocks in range(distance + 1, 13):
        edges = [bits * i // blocks for i in range(blocks + 1)]
        if n <= CROWD << (bits * (blocks - distance) // blocks):
            break
    one = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(one[i] for i in pick) for pick in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(x: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what is within the distance in x: one less than the members of each component."""
    out, left = [], x
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = np.bitwise_count(left ^ p) <= distance
            if near.any():
                out += [(p, q) for q in left[near]]
                queue += list(left[near])
                left = left[~near]
    return out


def link_runs(x: np.ndarray, run: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal run number (runs are contiguous)."""
    sizes = np.bincount(run)
    size = sizes[run]
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for d in range(1, SHORT_RUN):
        i = np.flatnonzero((run[d:] == run[:-d]) & (size[d:] <= SHORT_RUN))
        if not len(i):
            break
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= distance]
        us.append(x[i]), vs.append(x[i + d])
    starts = np.cumsum(sizes) - sizes
    for r in np.flatnonzero(sizes > SHORT_RUN):
        if found := forest(x[starts[r] : starts[r] + sizes[r]], distance):
            us.append(np.array([a for a, _ in found], np.uint64)), vs.append(np.array([b for _, b in found], np.uint64))
    return np.concatenate(us), np.concatenate(vs)


def near_links(prints: DataFrame, distance: int = 4, bits: int = 64) -> DataFrame:
    """u, v: links with the components of all pairs within the distance. prints: distinct `fp` of type long."""
    masks, share = block_masks(prints.count(), distance, bits), SHARE
    pick = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    dealt = prints.select("fp", F.explode(pick).alias("p")).select("p.c", "p.k", "fp")
    # Only values that two fingerprints share carry them on; a value of very many is cut into pairs of shares.
    runs = dealt.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / F.lit(float(share))).cast("int"))
    tiles = dealt.join(runs, ["c", "k"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = tiles.withColumn("by", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("c", "k", F.least("own", "by").alias("i"), F.greatest("own", "by").alias("j"), "fp")
    dealt = tiles.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number in whole_runs(batches, 4):
            u, v = link_runs(t.column(4).to_numpy().view(np.uint64), number, distance)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _prints(text: str, width: int, seed: int):
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([_signed(fingerprint(t, width, seed)) for t in texts], dtype="int64")

    return prints(F.col(text))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, width: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, named): key (of the text), doc_id and fp (signed) of each row; fp, root and component_id of each distinct fingerprint."""
    spark = docs.sparkSession
    rows = materialize(spark, docs.select(text_key(text).alias("key"), F.col(doc_id).alias("doc_id"), _prints(text, width, seed).alias("fp")), "simhash-prints", keep=True)
    classes = materialize(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = components(near_links(classes.select("fp"), distance))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, materialize(spark, rooted.join(named, "root").select("fp", "root", "component_id"), "simhash-named", keep=True)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) for each row.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id
    take part; they never name a component unless all its ids are null (then it is null). Repeated
    rows each get their row. Empty tables give no rows; only the id and the text are read.
    """
    with scope(docs.sparkSession, BATCH_ROWS):
        rows, named = groups(docs, doc_id, text, distance, width, seed)
        out = rows.join(named.select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
        out = materialize(docs.sparkSession, out, "simhash-rows", keep=True)
        discard(rows), discard(named)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """The row of the smallest id of each component of fingerprints, with the columns of `docs`, whatever their names.

    Null and empty texts are one component with what is near fingerprint zero. Null ids count as larger than
    any; of a component's rows that share its least id (or all have none) one stays. Empty tables give no rows.
    """
    with scope(docs.sparkSession, BATCH_ROWS):
        rows, named = groups(docs, doc_id, text, distance, width, seed)
        mine = rows.join(named, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        kept = materialize(docs.sparkSession, mine.groupBy("root", "component_id").agg(F.min("key").alias("key")), "simhash-kept", keep=True)
        discard(rows), discard(named)
    return only(docs, kept, doc_id, text)


def only(docs: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of docs for each row of kept (key of the text, component_id: the id). Equal rows by both are told apart only where there are any."""
    spark = docs.sparkSession
    rows = carried(docs, key=text_key(text), d=F.col(doc_id)).join(kept.select(F.col("key").alias("k"), "component_id"), (F.col("key") == F.col("k")) & F.col("d").eqNullSafe(F.col("component_id")))
    repeated = docs.select(text_key(text).alias("key"), F.col(doc_id).alias("d")).groupBy("key", "d").count().where("count > 1").select(F.col("key").alias("rk"), F.col("d").alias("rd"))
    repeated = materialize(spark, repeated, "simhash-repeated", keep=True)
    if repeated.isEmpty():
        return uncarried(rows, docs)
    again = (F.col("key") == F.col("rk")) & F.col("d").eqNullSafe(F.col("rd"))
    once = rows.join(repeated, again, "left_anti")
    first = rows.join(repeated, again, "left_semi").groupBy("key", "d").agg(F.first("row").alias("row"))
    return uncarried(once.select("row").union(first.select("row")), docs)


def _law(bits: int, least: float, errors: float) -> int:
    """Bits in which fingerprints of sets of that similarity differ at most: the mean by the angle between them, and so many standard errors."""
    p = np.arccos(2 * least / (1 + least)) / np.pi
    return int(bits * p + errors * np.sqrt(bits * p * (1 - p)))


def wide_plan(n: int, least: float) -> tuple[int, int]:
    """(bits of a block, blocks) for n texts: blocks as long as keep few texts on a value, as many as let a pair at the least similarity miss all with a chance of 0.001."""
    size = min(40, max(10, int(np.ceil(np.log2(max(n, 2)))) - 4))
    agree = (1 - np.arccos(2 * least / (1 + least)) / np.pi) ** size
    return size, max(int(np.ceil(np.log(0.001) / np.log(1 - agree))), 1 + 128 // size)


def wide_print(found: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of 64 * words bits of a set of hashes: a bit is set if over half of the hashes, mixed with the word's salt, set it."""
    salts = np.random.default_rng(64).integers(0, 1 << 64, words, np.uint64)
    out, n = np.zeros(64 * words, np.int64), len(found)
    for i in range(0, n, 255):
        bits = np.unpackbits(mixed(found[i : i + 255, None] ^ salts).view(np.uint8), axis=1, bitorder="little")
        out += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)  # a byte holds up to 255
    return np.packbits(2 * out > n, bitorder="little").view(np.uint64)


def wide_forest(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x (fingerprints) that differ in at most `most` bits and join what does; one less than each component's members."""
    out, left = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], np.arange(len(x))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = np.bitwise_count(x[left] ^ x[p]).sum(axis=1) <= most
            if near.any():
                out.append((np.full(near.sum(), p), left[near]))
                queue += left[near].tolist()
                left = left[~near]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def join_runs(x: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x that differ in at most `most` bits and join what does within each range at[r] .. at[r + 1]. Short ranges are compared at once, long ones by a forest."""
    size = np.diff(at)
    run = np.repeat(np.arange(len(size)), size)
    live = np.flatnonzero((size[run] > 1) & (size[run] <= LONG_RUN))
    us, vs = [live[:0]], [live[:0]]
    first = np.full(len(run), -1)  # the entry that an entry was joined with: pairs that both have it are left out
    for d in range(1, min(LONG_RUN, len(live))):
        live = live[live + d < len(run)]
        live = live[run[live + d] == run[live]]
        if not len(live):
            break
        near = live[np.bitwise_count(x[live] ^ x[live + d]).sum(axis=1) <= most]
        root = np.where(first[near] < 0, near, first[near])
        new = (first[near + d] < 0) | (first[near + d] != root)
        near, root = near[new], root[new]
        us.append(near), vs.append(near + d)
        first[near + d] = np.where(first[near + d] < 0, root, np.minimum(first[near + d], root))
    for r in np.flatnonzero(size > LONG_RUN):
        i, j = wide_forest(x[at[r] : at[r + 1]], most)
        us.append(i + at[r]), vs.append(j + at[r])
    return starred(x, np.concatenate(us), np.concatenate(vs), most)


def starred(x: np.ndarray, u: np.ndarray, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components: to the first row of each component where that is near enough itself, else as they were.

    Ranges that hold the same rows then give the same links, and few of those.
    """
    root = np.arange(len(x))
    while True:  # each root takes the least root it is linked with
        s, t = root[u], root[v]
        if (s == t).all():
            break
        np.minimum.at(root, s, t), np.minimum.at(root, t, s)
        while (root[root] != root).any():
            root = root[root]
    near = np.ones(len(x), bool)
    moved = np.flatnonzero(root != np.arange(len(x)))
    near[moved] = np.bitwise_count(x[moved] ^ x[root[moved]]).sum(axis=1) <= most
    star, other = moved[near[moved]], ~(near[u] & near[v])
    return np.concatenate([root[star], u[other]]), np.concatenate([star, v[other]])


def similar_links(sets: DataFrame, n: int, words: int, size: int, blocks: int, least: float) -> DataFrame:
    """u, v: links that join the texts whose sets of shingles may be as similar as `least`. sets: cid, n (members), fp (blob of 64 * words bits).

    Fingerprints are cut into blocks; pairs meet where they share a block's value and may be similar by their
    sizes, and are verified by the Hamming distance, first of 128 bits, then of all. The first few blocks join what is
    very similar; of the other blocks' links those within a component of theirs are left out.
    """
    spark = sets.sparkSession
    first = _block_links(sets.withColumn("root", F.col("cid")), n, words, size, 0, min(FIRST, blocks), least)
    first = materialize(spark, first, "simhash-first")
    roots = components(first)
    rooted = sets.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "n", "fp", F.coalesce("root", "cid").alias("root"))
    return first.union(_block_links(rooted, n, words, size, min(FIRST, blocks), blocks, least))


def _block_links(sets: DataFrame, n: int, words: int, size: int, low: int, high: int, least: float) -> DataFrame:
    """Links of similar_links() by blocks low to high, without those of equal root. sets: cid, n, fp, root."""
    spark, blocks = sets.sparkSession, high - low
    # Buckets of values grow with the n texts, whatever number of partitions the session names.
    named = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(named, 2 * blocks * n // ENTRIES)
    early, late = _law(128, least, 4.5), _law(64 * words, least, 6.0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cid, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            fp = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, words)
            bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")[:, size * low : size * high].reshape(len(fp), blocks, size)
            value = (bits.astype(np.uint64) << np.arange(size, dtype=np.uint64)).sum(axis=2)
            # Sizes of similar sets lie in one range or in two that adjoin.
            span = np.floor(np.log(n) / -np.log(least)).astype(np.uint64)
            k = np.stack([mixed(mixed(value + np.arange(low + 1, high + 1, dtype=np.uint64) * SALT) + (span + i)[:, None]) for i in (np.uint64(0), np.uint64(1))], 2).ravel()
            k = k & ~np.uint64(1) | np.tile(np.arange(2, dtype=np.uint64), len(k) // 2)  # the last bit: not its own range but the next
            own = np.repeat(np.arange(len(fp)), 2 * blocks)
            order = np.lexsort((cid[own], k))
            # What a batch holds of a value and is very close to its first is joined at once, and goes no further under this value:
            # what is similar to it is within the distance of the first as well.
            lead, x = np.ones(len(k), bool), own[order]
            u, v = join_runs(fp[x], packed.cuts(k[order] >> np.uint64(1)), late // 3)
            led = np.zeros(len(k), bool)
            led[v] = True
            lead[order[v[~led[u]]]] = False
            pair = np.unique(np.column_stack([x[u], x[v]]), axis=0)
            u, v = starred(fp, pair[:, 0], pair[:, 1], late // 3)
            root = b.column(3).to_numpy()
            u, v = u[root[u] != root[v]], v[root[u] != root[v]]
            keys = np.column_stack([cid.view(np.uint64), root.view(np.uint64)])
            out = packed.Rows("k", "c")
            out.add((k[lead] >> np.uint64(32)) % np.uint64(buckets), own[lead], keys, cid, k[lead], fp[own[lead], :2])
            out.add(-1 - cid[u] % named, u, keys, cid, cid[v].astype(np.uint64), np.zeros((len(u), 0), np.uint64))
            yield out.batch()
            release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_runs(batches, 1):
            us, vs = [], []
            local = t.column(0).to_numpy() < 0
            if local.any():
                _, own, ks, _, v, _ = packed.unpack(t.take(pa.array(np.flatnonzero(local))), "<i8", "<u8")
                us.append(ks[own, 0].view(np.int64)), vs.append(v)
            if not local.all():
                _, own, ks, _, k, c = packed.unpack(t.take(pa.array(np.flatnonzero(~local))), "<u8", "<u8")
                cid, root, c = ks[own, 0].view(np.int64), ks[own, 1], c.reshape(-1, 2)
                order = np.lexsort((cid, k))  # of a value the least number first: most link with it, and links of many values are the same
                at = packed.cuts(k[order] >> np.uint64(1))
                order = order[np.repeat(k[order[at[:-1]]] & np.uint64(1) == 0, np.diff(at))]  # those who are all of the range before meet there
                i, j = join_runs(c[order], packed.cuts(k[order] >> np.uint64(1)), early)
                apart = root[order[i]] != root[order[j]]
                us.append(cid[order[i[apart]]]), vs.append(cid[order[j[apart]]])
            pair = np.unique(np.column_stack([np.concatenate(us), np.concatenate(vs)]), axis=0) if us else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])
            release()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, words) for i in (2, 3))
            near = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= late)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["u", "v"])

    dealt = sets.select("cid", "n", "fp", "root").mapInArrow(deal, packed.rows_schema("k", "c"))
    dealt = dealt.repartition(min(buckets, MOST), "g") if buckets > named else dealt.repartition("g")
    met = dealt.sortWithinPartitions("g").mapInArrow(meet, "u long, v long")
    met = materialize(spark, met.distinct(), "simhash-met")
    both = met.join(sets.select(F.col("cid").alias("u"), F.col("fp").alias("fu")), "u").join(sets.select(F.col("cid").alias("v"), F.col("fp").alias("fv")), "v")
    return both.select("u", "v", "fu", "fv").mapInArrow(verify, "u long, v long")


def keep_one_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """The row of the smallest id of each group of near copies, with the columns of `docs`, whatever their names.

    Near copies share `least` of their sets of `width`-word shingles, directly or by others. Fingerprints of those sets
    propose (they grow with the number of texts, so that a pair at the least similarity is missed with a chance of 0.001),
    whole sets decide. Texts of fewer words are one shingle; null and empty texts and those of white space are
    copies of one another. Null ids count as larger than any; of rows that share a group's least id one stays.
    Empty tables give no rows.
    """
    from sparkloom.llm import shingles

    spark = docs.sparkSession
    with scope(spark, BATCH_ROWS):
        rows = docs.select(text_key(text).alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"))
        firsts = materialize(spark, rows.groupBy("key").agg(F.min("doc_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "simhash-firsts")
        n = firsts.count()
        size, blocks = wide_plan(n, least)
        words = -(-size * blocks // 64)

        @F.pandas_udf("n int, fp binary")
        def prints(texts: pd.Series) -> pd.DataFrame:
            found = [shingles.shingles(t, width) for t in texts]
            release()
            return pd.DataFrame({"n": [len(x) for x in found], "fp": [wide_print(x, words).tobytes() for x in found]})

        sets = docs.select(text_key(text).alias("key"), prints(F.col(text)).alias("p")).groupBy("key").agg(F.first("p").alias("p"))
        sets = materialize(spark, sets.join(firsts, "key").select("cid", "key", "least", "p.n", "p.fp"), "simhash-sets")
        met = components(similar_links(sets, n, words, size, blocks, least))
        members = materialize(spark, met.join(sets, F.col("node") == F.col("cid")).select("key", "cid", "n", F.col("root").alias("met"), "least"), "simhash-members")
        found = components(shingles.similar_links(docs, members, doc_id, text, least, width))
        rooted = firsts.join(found, F.col("cid") == F.col("node"), "left").select("key", "least", F.coalesce("root", "cid").alias("root"))
        named = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "key")).alias("one"))
        kept = materialize(spark, named.select(F.col("one.least").alias("component_id"), "one.key"), "simhash-kept", keep=True)
    return only(docs, kept, doc_id, text)
