"""SimHash near-duplicates with covering locality-sensitive hashing.

Every word shingle votes with its XXH64 bits; a document's 64-bit fingerprint holds the majority.  Masks after Pagh's
covering scheme (2016) give 2**(r+1) - 1 tables: bit i is labelled with a non-zero vector m(i) of r + 1 bits, and
table v keeps the bits whose label has odd inner product with v.  The labels of any r differing bits span at most r
dimensions, so some v is orthogonal to them all: each pair within the radius agrees in every kept bit of some table.

Work on a bucket is bounded.  Buckets hold distinct fingerprints.  One of more than ``bucket_rows`` is cut again: its
free bits are dealt to r + 1 parts, and two fingerprints that differ in r bits agree on one part, so every pair meets
in a sub-bucket with fewer free bits.  After a few cuts the free bits alone bound the rows.  A bucket yields a spanning
forest of its links, never its pairs.

A similarity threshold asks for more than a radius: texts that share four shingles in five lie about ten bits apart, where
no fingerprint of 64 bits tells them from strangers.  ``similar_rows`` therefore lets the buckets of the covering masks, and
after them the band keys of a min-wise sketch, only nominate: every pair of a bucket is a candidate, the sets of shingle hashes
decide, and texts are joined exactly where the sets' similarity reaches the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove_folder, sieve, sifted, small_batches, stage, tidy
from .components import connected_components

BITS = 64
#: Values of a sketch; its band keys take BANDS times BAND_ROWS of them: a pair at 0.8 shares none with probability 0.00003.
SKETCH, BAND_ROWS, BANDS = 256, 4, 20
#: The sets are compared where the sketches' similarity is at most so far under the threshold: six standard deviations at 0.8.
MARGIN = 0.15
#: Times that a bucket is cut.
CUTS = 8
#: Band keys whose buckets are compared before the others; of each turn's buckets only those whose texts aren't joined by then are left to compare.
FIRST_BANDS = 5
#: Bytes of shingle hashes that a task holds of a bucket, about.
BUCKET_BYTES = 32_000_000
_ODD = np.random.default_rng(64).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2**(radius + 1) - 1 masks, as unsigned integers."""
    n = 1 << (radius + 1)
    label = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (label[i] & v).bit_count() & 1) for v in range(1, n)]


def _hashes(text: str | None, shingle: int):
    """The XXH64 of every shingle, in order and in pieces: bounded memory for very long texts."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    for at in range(0, n, 32768):
        yield np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(at, min(n, at + 32768))), "<u8")


def fingerprint(text: str | None, shingle: int = 3, hashes=None) -> int:
    n, votes = 0, np.zeros(BITS, np.int64)
    for h in _hashes(text, shingle) if hashes is None else hashes:
        n += len(h)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingle hashes, ascending; none without words."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *_hashes(text, shingle)]))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each of ``SKETCH`` multipliers."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max)
    for s in range(0, len(hashes), 512):
        np.minimum(low, (hashes[s : s + 512, None] * _ODD).min(axis=0), out=low)
    return low


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long: the fingerprint's bits as a signed long).  Null or wordless texts: 0."""
    small_batches(docs.sparkSession)

    def each(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(x, shingle) for x in b.column(1).to_pylist()), "<u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(each), "doc_id long, fp long")


def sketches(docs: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, text_hash, fp, sid, size, sketch, keys): the fingerprint; a hash of the shingle set, its size, its sketch and band keys (no keys without words)."""
    from xxhash import xxh64_intdigest

    small_batches(docs.sparkSession)

    def each(batches):
        for b in batches:
            fps, sids, sizes, bodies, keys = [], [], [], [], []
            for x in b.column(1).to_pylist():
                pieces = list(_hashes(x, shingle))
                fps.append(fingerprint(None, hashes=pieces))
                held = np.unique(np.concatenate([np.zeros(0, "<u8"), *pieces]))
                low = least_values(held)
                raw = (low >> np.uint64(24)).astype("<u4")[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
                sids.append(_signed(xxh64_intdigest(held.tobytes())))
                sizes.append(len(held))
                bodies.append((low >> np.uint64(40)).astype(np.uint8).tobytes())
                keys.append([_signed(xxh64_intdigest(r.tobytes(), j)) for j, r in enumerate(raw)] if len(held) else [])
            cols = [b.column(0), b.column(2), pa.array(np.array(fps, "<u8").view("<i8")), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "fp", "sid", "size", "sketch", "keys"])

    return _identified(docs, text).mapInArrow(tidy(each), "doc_id long, text_hash long, fp long, sid long, size long, sketch binary, keys array<long>")


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, text, text_hash): a row is told by its id and its text; a null text hashes like no other."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string"), F.col(text).isNull()).alias("text_hash"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """(node, hashes) of ``wanted`` (node, doc_id, text_hash): the shingle set, as bytes, of the text of the row that stands for the node."""
    small_batches(docs.sparkSession)

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x, shingle).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["node", "hashes"])

    # only texts that may be wanted move; always by a shuffle, so that its size follows the number of wanted rows
    rows = sifted(_identified(docs, text), "text_hash", *sieve(wanted, "text_hash")).where("_maybe").drop("_maybe")
    one = wanted.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).hint("merge")
    picked = rows.join(one, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return picked.select("node", "text").mapInArrow(tidy(each), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(node: np.ndarray, near) -> tuple[list[int], list[int]]:
    """Spanning forest of the links ``near(others, one)`` among rows, given by their places: breadth first, a frontier row against the unseen rest."""
    left, a, b = np.arange(len(node)), [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        found = near(left, i)
        if found.any():
            found, left = left[found], left[~found]
            a += [int(node[i])] * len(found)
            b += node[found].tolist()
            queue += found.tolist()
    return a, b


def _bucket_forests(rows: DataFrame, values: list[str], compare) -> DataFrame:
    """``rows`` (key, node, ``values``) -> edges (a, b), the spanning forest of each key's links; ``compare`` of a bucket's values gives ``near``."""

    def forest(batches):
        """Rows arrive sorted by key; a bucket may run over batches."""
        held_key, held = None, []

        def done():
            # a key is a hash: comparing rows that share it by chance does no harm
            t = pa.Table.from_batches(held)
            a, b = _forest(t.column(1).to_numpy(), compare(*t.columns[2:]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for t in batches:
            if not t.num_rows:
                continue
            k = t.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
            for s, e in zip(cut, cut[1:], strict=False):
                if held_key is not None and k[s] != held_key:
                    yield done()
                    held = []
                held_key = k[s]
                held.append(t.slice(s, e - s))
        if held:
            yield done()

    ready = rows.select("key", "node", *values).repartition("key").sortWithinPartitions("key")
    return ready.mapInArrow(tidy(forest), "a long, b long")


def _within(radius: int):
    def compare(fps):
        rows = fps.to_numpy().view(np.uint64)
        return lambda others, one: np.bitwise_count(rows[others] ^ rows[one]) <= radius

    return compare


def _similar(jaccard: float, chunk: int = 1_000_000):
    """Texts whose shingle sets have the similarity ``jaccard``; sketches far below it spare the sets."""
    least = jaccard - MARGIN

    def compare(sketch, hashes):
        drawn = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, SKETCH)
        sets = [np.frombuffer(x, "<u8") for x in hashes.to_pylist()]
        size = np.array([len(x) for x in sets])

        def near(others, one):
            out, mine = np.zeros(len(others), bool), sets[one]
            if not len(mine):
                out[:] = size[others] == 0
                return out
            n = size[others]
            able = (n > 0) & (np.minimum(n, len(mine)) >= jaccard * np.maximum(n, len(mine)))
            at = np.flatnonzero(able & ((drawn[others] == drawn[one]).mean(axis=-1) >= least))
            piece = np.cumsum(n[at]) // chunk
            for p in np.unique(piece):
                some = at[piece == p]
                every = np.concatenate([sets[i] for i in others[some]])
                both = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
                shared = np.add.reduceat(both, np.cumsum(n[some]) - n[some], dtype=np.int64)
                out[some] = shared / (n[some] + len(mine) - shared) >= jaccard
            return out

        return near

    return compare


def _crowded(keyed: DataFrame, path: str) -> DataFrame:
    """``keyed`` with the rows ``n`` of each key, staged in ``path``; keys of one row go."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return stage(keyed.join(sizes, "key"), "buckets", settle=True, path=path)


def links(reps: DataFrame, radius: int = 3, bucket_rows: int = 4096, folder: str | None = None) -> DataFrame:
    """``reps`` (fp, node): distinct fingerprints -> edges (a, b) that join exactly the rows linked within ``radius``.

    The edges are computed from tables in ``folder``, which may go once the edges have been written.
    """
    folder = folder or new_path(reps.sparkSession, "buckets")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(_signed(m)).alias("mask")) for m in masks])
    keyed = reps.select("fp", "node", F.explode(tables).alias("t")).select("fp", "node", F.col("t.mask").alias("mask"))
    out = []
    parts = radius + 1
    for level in range(CUTS):
        keyed = keyed.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        both = _crowded(keyed, f"{folder}/{level}")
        if level == CUTS - 1:  # the free bits left bound a bucket by themselves: 2**11 rows at radius 5
            out.append(_bucket_forests(both, ["fp"], _within(radius)))
            break
        out.append(_bucket_forests(both.where(F.col("n") <= bucket_rows), ["fp"], _within(radius)))
        big = both.where(F.col("n") > bucket_rows)
        if not big.limit(1).count():
            break
        # the free bits, in turn, to radius + 1 parts; a sub-bucket keeps one more part
        free = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.struct(i.alias("i"), (F.getbit(F.col("mask"), i) == 0).alias("free")))
        places = F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["i"])
        one = F.lit(1).cast("long")
        part_mask = F.aggregate(
            F.filter(F.transform(places, lambda x, j: F.struct(x.alias("i"), j.alias("j"))), lambda x: x["j"] % parts == F.col("part")),
            F.lit(0).cast("long"),
            lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", one, x["i"])),
        )
        keyed = big.select("fp", "node", "mask", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).select("fp", "node", F.col("mask").bitwiseOR(part_mask).alias("mask"))
    edges = out[0]
    for x in out[1:]:
        edges = edges.unionByName(x)
    return edges


def set_links(docs: DataFrame, reps: DataFrame, keyed: DataFrame, jaccard: float, text: str = "text", shingle: int = 5, bucket_rows: int = 4096, folder: str | None = None) -> DataFrame:
    """Edges (a, b) between the nodes of ``reps`` (node, doc_id, text_hash, sketch) that share a key of ``keyed`` (key, node, size, label) and whose shingle sets have the similarity ``jaccard``.

    A key whose nodes all have one label, being joined already, is left out.  Keys that nominate the same sets are one.  A bucket of more than ``bucket_rows`` sets or ``BUCKET_BYTES`` is dealt into
    blocks, and every block is compared with every other and with itself, each pair of blocks as a bucket of its own: no
    pair is lost.  The edges are computed from tables in ``folder``, which may go once the edges have been written.
    """
    folder = folder or new_path(docs.sparkSession, "bands")
    keyed = keyed.repartition("key")  # one shuffle for the counts and the rows: both read the same columns
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "node")).alias("y"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("n > 1 and lo < hi")
    sizes = sizes.groupBy("n", "hashes", "x", "y").agg(F.min("key").alias("key"))
    crowd = F.greatest(F.col("n") / bucket_rows, 8 * F.col("hashes") / BUCKET_BYTES)
    blocks = F.least(F.when(crowd <= 1, 1).otherwise(F.ceil(2 * crowd)), F.col("n")).cast("long")
    buckets = stage(keyed.join(sizes.select("key", blocks.alias("blocks")), "key").select("key", "node", "blocks"), "bands", settle=True, path=f"{folder}/bands")
    met = reps.select("node", "doc_id", "text_hash").join(buckets.select("node").distinct(), "node", "left_semi")
    wanted = stage(met, "wanted", path=f"{folder}/wanted")  # of known size: where it is small, no text is shuffled
    sets = shingle_sets(docs, wanted, text, shingle).join(reps.select("node", "sketch"), "node")
    return _bucket_forests(_blocks(buckets, "node").join(sets, "node"), ["sketch", "hashes"], _similar(jaccard))


def _blocks(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (key, blocks, ``by``, ...) with one key for each pair of a key's blocks; a row goes to the pairs that hold its block."""
    mine, other = F.pmod(F.xxhash64("key", by), F.col("blocks")), F.col("_other")
    every = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    # a block meets itself in its pairs with the others
    met = every.where((F.col("blocks") == 1) | (F.col("_mine") != other))
    return met.withColumn("key", F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("_mine", other), F.greatest("_mine", other)))).drop("_mine", "_other", "blocks")


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = 3, shingle: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """Per row of ``docs``: (doc_id, fp, component_id), the smallest doc_id reachable over links of at most ``radius`` differing bits.

    Null, empty and wordless texts have fingerprint 0 and link like any other.  Rows with equal doc_id are separate rows of
    one node.  A null doc_id gets a null component.  An empty table gives no rows.
    """
    fps = stage(fingerprints(docs, text, shingle), "fingerprints")
    known = fps.where("doc_id is not null")
    reps = stage(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "reps", settle=True)
    same_id = known.join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    repeated = fps.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")  # one id, several texts
    comp = connected_components(links(reps, radius, bucket_rows).unionByName(same_id.join(repeated, F.col("a") == F.col("doc_id"), "left_semi")))
    labels = reps.join(comp.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labels, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def similar_rows(docs: DataFrame, text: str = "text", radius: int = 3, shingle: int = 5, jaccard: float = 0.8, bucket_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash) of ``docs``, and per shingle set one row that stands for it: (node, doc_id, text_hash, group).

    Sets are in one group where a chain of sets of at least ``jaccard`` similarity joins them; sets without words are equal.
    What stands for a set is its row of the smallest doc_id, nulls last.  Ids don't join texts.  A pair at ``jaccard`` shares
    none of the sketch's keys with probability 0.00003, and one within the radius always shares a mask's.
    """
    spark = docs.sparkSession
    drawn = stage(sketches(docs, text, shingle), "sketches")
    whole = F.struct("doc_id", "text_hash", "fp", "size", "sketch", "keys")
    firsts = drawn.groupBy("sid").agg(F.min_by(whole, F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("s"))
    reps = stage(firsts.select("s.*").withColumn("node", F.monotonically_increasing_id()), "reps", settle=True)  # written, so the numbers stay
    masked = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(covering_masks(radius))]))
    banded = reps.select(F.posexplode("keys").alias("band", "key"), "node", "size")
    # the masks' buckets first; then of the bands' those that are not joined by then, in two turns
    turns = [reps.select(masked.alias("key"), "node", "size"), banded.where(F.col("band") < FIRST_BANDS).drop("band"), banded.where(F.col("band") >= FIRST_BANDS).drop("band")]
    joined = None
    for keyed in turns:
        folder = new_path(spark, "bands")
        if joined is None:
            keyed = keyed.withColumn("label", F.col("node"))
        else:
            keyed = keyed.join(joined, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        edges = set_links(docs, reps, keyed, jaccard, text, shingle, bucket_rows, folder)
        if joined is not None:
            edges = edges.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
        joined = stage(connected_components(edges), "joined", settle=True)
        remove_folder(spark, folder)
    groups = reps.select("node", "doc_id", "text_hash").join(joined, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    return drawn.select("doc_id", "text_hash"), groups


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of ``similar_rows``: the one of the smallest doc_id, nulls last.

    Decisions fall on rows: unlike texts under one id, or under none, each stay.  Of rows alike in id and text the one with the
    smallest hash of all columns stays.
    """
    rows, groups = similar_rows(docs.select("doc_id", "text"), **options)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = groups.groupBy("group").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("k")).select("k.*")
    alike = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    same = (F.col("_hash") == F.col("text_hash")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    told = alike.join(kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), same, "left")
    # most rows are alone and stay where they are: the others' list is the shorter one, and only what it may hold is joined with it
    others = told.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("_hash").isNull().alias("_gone"), "n").where("_gone or n > 1")
    others = stage(others, "others", settle=True)
    own = F.xxhash64(F.col("text").cast("string"), F.col("text").isNull())
    on = (F.col("_own") == F.col("_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    words, bits = sieve(others, "_hash")
    marked = sifted(docs.withColumn("_own", own), "_own", words, bits)
    asked = marked.where("_maybe")
    single = marked.where("not _maybe").unionByName(asked.join(others.hint("merge"), on, "left_anti")).select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = others.where("not _gone")
    if not repeated.limit(1).count():
        return single
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = asked.join(repeated.hint("merge"), on).select("_id", "_hash", row.alias("_row"))
    first = again.groupBy("_id", "_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return single.unionByName(first.select("_row.*"))
