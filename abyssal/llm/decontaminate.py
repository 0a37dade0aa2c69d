"""Benchmark decontamination with a distributed positional inverted index.

The index is one row per segment of whole documents: for each term, the ascending positions at which it stands, where
a document's words occupy a run of positions of their own.  Terms are those of the benchmark (a semi-join pushed into
the build); the index is written to the shared folder.  A benchmark item is a set of phrases.  In a segment, a phrase
starts from the rarest term's list, shifted by the term's place in the phrase, and intersects it with the next rarest
until it is empty or all terms agree.  With ``slop`` the same walk allows each other term that many words either way
of its place: proximity matches.

No shuffle carries postings: a document lies in one segment.  The benchmark is a stated query set; it goes to every
task in blocks of at most ``block_bytes`` of text, so what is broadcast has a bound whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_ipc, pack, runs, small_batches, stage, text_bytes, tidy, to_ipc, unpack

#: Lower-cases A-Z and turns what separates words into spaces; bytes from 0x80 on belong to words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 13
BLOCK_BYTES = 8 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def phrases(items: list[tuple], window: int = WINDOW) -> dict[tuple[bytes, ...], list]:
    """Distinct windows of the items' texts, with the items that hold them; an item shorter than a window is one."""
    out: dict[tuple[bytes, ...], list] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            held = out.setdefault(tuple(w[i : i + window]), [])
            if not held or held[-1] != item:
                held.append(item)
    return out


class Segment:
    """Postings of one segment: ``starts`` per document, and ascending positions by term."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray):
        self.starts, self.positions, self.offsets = starts, positions, offsets
        self.at = {t: i for i, t in enumerate(terms.tolist())}

    def postings(self, term: int) -> np.ndarray:
        i = self.at.get(term)
        return self.positions[self.offsets[i] : self.offsets[i + 1]] if i is not None else self.positions[:0]

    def find(self, phrase: list[int], order: list[int], slop: int = 0) -> np.ndarray:
        """Positions at which the phrase starts; ``order``: the phrase's places, rarest term first.  Documents have ``slop`` + a phrase's length of empty positions between them."""
        at = self.postings(phrase[order[0]]) - order[0]
        for j in order[1:]:
            if not len(at):
                break
            p = self.postings(phrase[j])
            if slop:
                ok = np.searchsorted(p, at + j + slop, "right") > np.searchsorted(p, at + j - slop, "left")
            elif len(p):
                k = np.minimum(np.searchsorted(p, at + j), len(p) - 1)
                ok = p[k] == at + j
            else:
                ok = np.zeros(len(at), bool)
            at = at[ok]
        return at


#: Empty positions between documents.
GAP = 64


def _gaps(place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each term's first place, then its gaps."""
    out = np.diff(place, prepend=0).astype(np.int64)
    out[first] = place[first]
    return out


def _places(gaps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(gaps)])
    return total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], carry: tuple[str, ...] = ()) -> DataFrame:
    """Stage (segment_id, n_docs, rows, starts, terms, offsets, positions).  ``rows``: the documents' ids and word counts."""
    small_batches(docs.sparkSession, 1000)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches):
        from pyspark import TaskContext

        part, get = TaskContext.get().partitionId(), known.value.get
        for k, t in enumerate(runs(batches, "text", 6_000_000)):
            lengths, starts, places, ids, base = [], [], [], [], GAP
            for x in t.column("text").to_pylist():
                w = words(x)
                term = np.fromiter((get(y, -1) for y in w), np.int64, len(w))
                here = np.flatnonzero(term >= 0)
                starts.append(base)
                lengths.append(len(w))
                places.append(here + base)
                ids.append(term[here])
                base += len(w) + GAP
            place, term = np.concatenate(places), np.concatenate(ids)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            terms, first = np.unique(term, return_index=True)
            rows = pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(lengths, pa.int64())})
            offsets = np.append(first, len(term)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], ty) for v, ty in ((part << 24 | k, pa.int64()), (to_ipc(rows), pa.binary()), (pack(np.array(starts)), pa.binary()), (pack(terms), pa.binary()), (pack(offsets), pa.binary()), (pack(_gaps(place, first)), pa.binary()))],
                names=["segment_id", "rows", "starts", "terms", "offsets", "gaps"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(picked.mapInArrow(tidy(build), "segment_id long, rows binary, starts binary, terms binary, offsets binary, gaps binary"), "postings")


def document_rows(index: DataFrame) -> DataFrame:
    """(row_id, doc_id, n_words) of every indexed row; row_id is its own even where doc_id repeats or is null."""

    def each(batches):
        for b in batches:
            for seg, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = from_ipc(body)
                yield from t.append_column("row_id", pa.array((seg << 20) + np.arange(t.num_rows), pa.int64())).select(["row_id", "doc_id", "n_words"]).to_batches()

    return index.select("segment_id", "rows").mapInArrow(each, "row_id long, doc_id long, n_words long")


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): postings of each term over the whole index; one row per benchmark term."""

    def each(batches):
        for b in batches:
            for terms, offsets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(terms).astype(np.int64)), pa.array(np.diff(unpack(offsets)).astype(np.int64))], names=["term", "n"])

    return index.select("terms", "offsets").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def search(index: DataFrame, vocabulary: dict[bytes, int], queries: dict[tuple[bytes, ...], list], slop: int = 0) -> DataFrame:
    """(row_id, doc_id, item, start, end, score): word ranges of documents that a phrase covers, adjoining ones of an item merged.

    ``item``: place in the list of the queries' distinct items.  For proximity (``slop`` > 0) a range is the phrase's own length.
    """
    if slop + max(map(len, queries), default=0) > GAP:
        raise ValueError(f"phrases and slop together go up to {GAP} words")
    n = dict(map(tuple, term_counts(index).collect()))  # one number per benchmark term
    items = list(dict.fromkeys(i for held in queries.values() for i in held))
    place = {x: i for i, x in enumerate(items)}
    plan = []
    for phrase, held in queries.items():
        ids = [vocabulary[w] for w in phrase]
        if all(t in n for t in ids):
            plan.append((ids, sorted(range(len(ids)), key=lambda j: n[ids[j]]), [place[i] for i in held]))
    shared = index.sparkSession.sparkContext.broadcast(plan)
    schema = "row_id long, doc_id long, item int, start long, end long"

    def look(batches):
        for b in batches:
            for seg, rows, starts, terms, offsets, gaps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                starts = unpack(starts).astype(np.int64)
                offsets = unpack(offsets).astype(np.int64)
                s = Segment(starts, unpack(terms).astype(np.int64), offsets, _places(unpack(gaps).astype(np.int64), offsets))
                hits: dict[int, list] = {}
                for phrase, order, held in shared.value:
                    at = s.find(phrase, order, slop)
                    if len(at):
                        for i in held:
                            hits.setdefault(i, []).append(np.stack([at, at + len(phrase)], 1))
                if not hits:
                    continue
                table = from_ipc(rows)
                doc_ids, n_words = table.column("doc_id"), table.column("n_words").to_numpy()
                out = []
                for i, found in hits.items():
                    r = np.concatenate(found)
                    r = r[np.argsort(r[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(r[:, 1])
                    new = np.concatenate([[True], r[1:, 0] > reach[:-1]])
                    a = r[new, 0]
                    e = reach[np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)]
                    d = np.searchsorted(starts, a, "right") - 1
                    out.append((d, np.full(len(a), i), np.maximum(a - starts[d], 0), np.minimum(e - starts[d], n_words[d])))
                d, item, a, e = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array((seg << 20) + d, pa.int64()), doc_ids.combine_chunks().take(pa.array(d)), pa.array(item, pa.int32()), pa.array(a, pa.int64()), pa.array(e, pa.int64())], names=["row_id", "doc_id", "item", "start", "end"])

    hits = index.select("segment_id", "rows", "starts", "terms", "offsets", "gaps").mapInArrow(tidy(look), schema)
    names = index.sparkSession.createDataFrame([(i, None if x is None else str(x)) for i, x in enumerate(items)], "item int, item_id string")
    return hits.join(F.broadcast(names), "item").select("row_id", "doc_id", "item_id", "start", "end")


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark's (item_id, text) in lists of at most about ``block_bytes``; one list is held at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id"), F.col("text").cast("string")).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, n_hit, item_ids array, spans, contaminated).

    A word is hit if any occurrence of a benchmark window covers it; a row is contaminated with at least one hit word and
    at least one in ``one_in`` of its words hit.  Null and empty texts have no words, no hits.  Repeated items count once; items
    with neither words nor text match nothing; an item of null id marks words but is in no list.  Rows are kept apart
    even if ids repeat.  An empty benchmark hits nothing.
    """
    rows = hits = None
    if (text_bytes(benchmark) or 0) >= block_bytes:  # several indexes: over one and the same set of files
        docs = stage(docs.select("doc_id", "text"), "documents")
    for block in blocks(benchmark, block_bytes):
        queries = phrases(block, window)
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for p in queries for w in p))}
        index = build_index(docs, vocabulary)
        rows = rows if rows is not None else document_rows(index)
        found = search(index, vocabulary, queries, slop)
        hits = found if hits is None else hits.unionByName(found)
    if rows is None:
        rows = document_rows(build_index(docs, {}))
        hits = docs.sparkSession.createDataFrame([], "row_id long, doc_id long, item_id string, start long, end long")

    # spans of one row, overlaps counted once: sorted by start, each adds what lies beyond the furthest end so far
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")), lambda a: a["n"])
    per_row = hits.groupBy("row_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), spans.alias("spans")).withColumn("n_hit", covered)
    out = rows.join(per_row, "row_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("row_id", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"))
