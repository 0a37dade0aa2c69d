"""Information-theoretic sanitisation of personal data (after Sanchez and Batet's C-sanitized model, 2016).

Patterns find protected entities: e-mail and IP addresses, card and telephone numbers.  A term near an entity may give it
away even when the entity itself has gone: the corpus tells how much.  With p(e) the share of documents that name the
entity, p(t) of those that hold the term, and p(e, t) of those where the term stands beside the entity,

    PMI(t; e) = log2 p(e, t) / (p(e) p(t)),    IC(e) = -log2 p(e),

the term discloses the entity where PMI(t; e) >= IC(e) / ALPHA, which is full disclosure at IC(e).  Chance is ruled out by
asking for ``SUPPORT`` different contexts, so copies of one text don't count twice.  Every occurrence of such a term is
marked, in all documents; ``sanitised`` generalises it to its kind, or removes it where no kind is wide enough.

Texts are read three times, and only small rows about entities, their neighbours and their counts are shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, tidy

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity, within so many code points.
NEAR_WORDS, NEAR_CHARS = 6, 200
ALPHA, SUPPORT = 1.05, 3
#: Bits of the filter for wanted terms: 16 a term, and at most so many (16 MB); more terms only let more words through to the exact join.
FILTER_BITS = 27
#: Where the places of a term in the filter begin in its hash.
SHIFTS = (0, 20, 37)
TERM = re.compile(r"[^\W_]{3,}")
SPAN = "struct<start:bigint,end:bigint,kind:int>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: No match starts inside digits that failed as a whole, so the guard before them only spares the search.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


# --- protected entities -------------------------------------------------------------------------------------------------


def _emails(text: str):
    """Leftmost, non-overlapping, in time linear in the text: from each @ back over its own run, and forward."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def entities(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the protected entities, by start and kind; code points, end exclusive.  Kinds may overlap each other."""
    text, found = text or "", []
    if "@" in text:
        found += [(s, e, 0) for s, e in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def value_of(span: str, kind: int) -> str:
    """The entity that a span names, however it is written."""
    return f"{KINDS[kind]}:{span.lower() if kind == 0 else _NOT_DIGIT.sub('.' if kind == 1 else '', span)}"


def neighbours(text: str, spans: list[tuple[int, int, int]], start: int, end: int) -> list[str]:
    """The terms beside a span, in lower case, outside of all spans: ``NEAR_WORDS`` on each side, whole ones within ``NEAR_CHARS``."""
    low, high = max(0, start - NEAR_CHARS), min(len(text), end + NEAR_CHARS)
    words = []
    for a, b, side in ((low, start, -1), (end, high, 1)):
        own = [m for m in TERM.finditer(text, a, b) if not (side < 0 and m.start() == a > 0 and text[a - 1].isalnum()) and not (side > 0 and m.end() == b < len(text) and text[b].isalnum())]
        words += own[-NEAR_WORDS:] if side < 0 else own[:NEAR_WORDS]
    return [m[0].lower() for m in words if not any(s < m.end() and m.start() < e for s, e, _ in spans)]


# --- passes over the texts ----------------------------------------------------------------------------------------------


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def found(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, spans of the entities, the distinct entities, and their neighbours: entity, term, a hash of the context, and whether it is the pair's first in the row."""
    from xxhash import xxh3_64_intdigest as h

    def each(batches):
        for b in batches:
            spans, names, near = [], [], []
            for text in b.column(1):
                text = text.as_py()
                own, seen, beside = entities(text), set(), []
                values = [value_of(text[s:e], k) for s, e, k in own]
                for (s, e, _), value in zip(own, values, strict=True):
                    terms = neighbours(text, own, s, e)
                    context = h("\n".join(terms).encode("utf-8", "surrogatepass")) >> 1
                    for t in dict.fromkeys(terms):
                        beside.append({"entity": value, "term": t, "context": context, "first": (value, t) not in seen})
                        seen.add((value, t))
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in own])
                names.append(list(dict.fromkeys(values)))
                near.append(beside)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
            about = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64()), ("first", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(spans, kind), pa.array(names, pa.list_(pa.string())), pa.array(near, about)], names=["doc_id", "text_hash", "spans", "entities", "near"])

    return _rows(docs).mapInArrow(tidy(each), f"doc_id long, text_hash long, spans array<{SPAN}>, entities array<string>, near array<struct<entity:string,term:string,context:bigint,first:boolean>>")


def term_filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of ``terms`` (term) as 64-bit words, a power of two of them: made in Spark, of bounded size."""
    bits = max(1 << 12, min(1 << FILTER_BITS, 1 << (16 * terms.count()).bit_length()))
    places = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS]))
    words = terms.select(F.xxhash64("term").alias("h")).select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    rows = words.agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _may_hold(bloom: np.ndarray, words: list[str]) -> set[str]:
    """Those of ``words`` that the filter lets through."""
    from xxhash import xxh64_intdigest as h

    hashes = np.fromiter((h(w.encode("utf-8", "surrogatepass"), 42) for w in words), np.uint64, len(words))
    able = np.ones(len(words), bool)
    for s in SHIFTS:
        at = (hashes >> np.uint64(s)) & np.uint64(64 * len(bloom) - 1)
        able &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return {words[i] for i in np.flatnonzero(able)}


def _passing(texts: list[str], bloom: np.ndarray) -> list[set[str]]:
    """Per text its distinct terms that the filter lets through."""
    own = [{w.lower() for w in set(TERM.findall(t))} for t in texts]
    through = _may_hold(bloom, list(set().union(*own)))
    return [x & through for x in own]


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) of ``terms`` (term, distinct): the rows of ``docs`` that hold the term; each task adds up before anything is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(term_filter(terms))

    def each(batches):
        from collections import Counter

        for b in batches:
            n = Counter(w for x in _passing(b.column(1).to_pylist(), held.value) for w in x)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return _rows(docs).mapInArrow(tidy(each), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")


def disclosing(docs: DataFrame, rows: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(entity, term, n_both, n_entity, n_term, disclosure): the terms that give an entity of ``rows`` (of ``found``) away, and by what share of its information."""
    near = rows.select(F.explode("near").alias("x")).select("x.*").groupBy("entity", "term", "context").agg(F.sum(F.col("first").cast("long")).alias("n"))
    pairs = stage(near.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts")).where(F.col("contexts") >= support), "pairs")
    named = rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    counts = document_counts(docs, stage(pairs.select("term").distinct(), "terms")).withColumnRenamed("n", "n_term")
    total = F.lit(float(rows.count()))
    told = pairs.join(named, "entity").join(counts, "term").where(F.col("n_entity") < total)
    pmi, ic = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term"))), F.log2(total / F.col("n_entity"))
    return told.withColumn("disclosure", pmi / ic).where(F.col("disclosure") * alpha >= 1).select("entity", "term", "n_both", "n_entity", "n_term", "disclosure")


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): where ``terms`` (term, distinct) stand, outside of entities, in the rows that hold any; rows alike in id and text are one."""
    held = docs.sparkSession.sparkContext.broadcast(term_filter(terms))

    def each(batches):
        for b in batches:
            ids, hashes, names, starts, ends = [], [], [], [], []
            texts = b.column(1).to_pylist()
            for i, own in enumerate(_passing(texts, held.value)):
                if not own:
                    continue
                at: dict[str, list] = {}
                free = _outside(entities(texts[i]))
                for m in TERM.finditer(texts[i]):
                    if (w := m[0].lower()) in own and free(m.start(), m.end()):
                        at.setdefault(w, []).append((m.start(), m.end()))
                for w, x in at.items():
                    ids.append(b.column(0)[i].as_py())
                    hashes.append(b.column(2)[i].as_py())
                    names.append(w)
                    starts.append([s for s, _ in x])
                    ends.append([e for _, e in x])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(names, pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "term", "starts", "ends"])

    hits = _rows(docs).mapInArrow(tidy(each), "doc_id long, text_hash long, term string, starts array<long>, ends array<long>").join(terms, "term", "left_semi")
    once = hits.groupBy("doc_id", "text_hash", "term").agg(F.first(F.struct("starts", "ends")).alias("x"))
    places = F.zip_with("x.starts", "x.ends", lambda s, e: F.struct(s.alias("start"), e.alias("end"), F.lit(len(KINDS)).alias("kind")))
    return once.groupBy("doc_id", "text_hash").agg(F.sort_array(F.flatten(F.collect_list(places))).alias("terms"))


def _outside(spans: list[tuple[int, int, int]]):
    """Whether a range meets none of ``spans``."""
    from bisect import bisect_left

    ends, high = [], -1
    starts = [s for s, _, _ in spans]
    for _, e, _ in spans:
        high = max(high, e)
        ends.append(high)
    return lambda s, e: not (i := bisect_left(starts, e)) or ends[i - 1] <= s


def protected_spans(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, spans (entities), terms (occurrences of disclosing terms), each as start, end, kind; kind 4 is a term.

    A null or empty text has none.  Terms never touch an entity.  Rows of one id are separate rows; those alike in id and
    text get the same.  Without an entity that has ``support`` contexts there are no terms.  An empty table gives no rows.
    """
    rows = stage(found(docs), "entities")
    terms = stage(disclosing(docs, rows, alpha, support).select("term").distinct(), "disclosing")
    base = rows.select("doc_id", "text_hash", "spans")
    if not terms.limit(1).count():
        return base.withColumn("terms", F.array().cast(f"array<{SPAN}>"))
    hits = occurrences(docs, terms).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "terms")
    joined = base.join(hits, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "text_hash", "spans", F.coalesce("terms", F.array().cast(f"array<{SPAN}>")).alias("terms"))


def generalised(text: str, spans) -> str:
    """``text`` with its entities as their kinds; of the terms, names and numbers as such, and no other word, of which no kind is wide enough."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s < at:  # inside an entity of another kind
            at = max(at, e)
            continue
        word = text[s:e]
        wide = f"[{KINDS[kind].upper()}]" if kind < len(KINDS) else "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[0].isupper() else ""
        out += [text[at:s], wide]
        at = e
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``docs`` with ``text`` sanitised; a text without spans stays as it is, null too."""
    marks = protected_spans(docs, alpha, support).where("size(spans) > 0 or size(terms) > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.concat("spans", "terms").alias("_spans")).dropDuplicates(["_id", "_hash"])
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(marks, (own == F.col("_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left")

    @F.pandas_udf("string")
    def rewrite(texts, spans):
        return texts.combine(spans, lambda t, x: t if x is None else generalised(t, [(int(v["start"]), int(v["end"]), int(v["kind"])) for v in x]))

    return joined.select(*[(F.when(F.col("_spans").isNull(), F.col("text")).otherwise(rewrite(F.coalesce("text", F.lit("")), "_spans")) if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def digest(marks: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the entities and all spans, as ``kind:start:end`` by start and kind."""
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, (*KINDS, "term"))), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    order = F.array_sort(F.transform(F.concat("spans", "terms"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return marks.select("doc_id", *counts, F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(order).alias("spans"))
