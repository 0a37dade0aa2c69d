"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside the family.

Features are hashed byte n-grams (one to four) of the letters of a whole text, square-rooted and scaled to length one.
Counting and prediction run on all rows in Arrow batches; only a bounded, hash-chosen sample of labelled rows
(``max_rows`` in all, shared equally by the labels) is gathered to fit the linear machines.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy

DIM = 4096
ORDERS = (1, 2, 3, 4)
#: Bytes of a text counted at a time; counts don't depend on it.
PIECE = 1 << 20
#: Rows used to fit, all labels together.
MAX_ROWS = 3000
UNDETERMINED = "und"
#: Score under which a prediction is no identification: code, symbols and words of no learnt language lie below, one short word above.
MIN_SCORE = 0.3
#: Families of common ISO 639-1 codes.  Other labels join the family of the most similar known centroid.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
    "sinitic": ("zh",),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: A-Z to lower case; letters and bytes from 0x80 on stay; all else is a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """One row per text; whole texts, in runs of bounded size."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace").translate(_TABLE)
        tail, space = np.zeros(0, np.uint32), False  # the last bytes counted, and whether the last one read was a space
        for at in range(0, len(raw) + 1, PIECE):
            new = np.frombuffer(b" " * (at == 0) + raw[at : at + PIECE] + b" " * (at + PIECE > len(raw)), np.uint8)
            kept = new[(new != 32) | (np.concatenate([[32 if space else 0], new[:-1]]) != 32)]
            space = bool(new[-1] == 32)
            b = np.concatenate([tail, kept.astype(np.uint32)])
            for n in ORDERS:  # n-grams that end in the new piece
                run = b[max(0, len(tail) - n + 1) :]
                if len(run) < n:
                    continue
                h = np.full(len(run) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h *= np.uint32(0x01000193)
                    h ^= run[k : k + len(h)]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                out[i] += np.bincount(h >> np.uint32(32 - dim.bit_length() + 1), minlength=dim)
            tail = b[-(max(ORDERS) - 1) :]
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 80) -> np.ndarray:
    """Squared-hinge linear SVM by accelerated full gradient; ``y`` is -1 or 1, classes are weighted evenly.  The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1.0 / (1e-3 + 2 * c * 2.0))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (np.float32(1e-3) * v - np.float32(2) * (x.T @ (weight * y * slack)))
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    family_w: np.ndarray  # dim + 1, family
    pair_w: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families or not len(x):
            return [UNDETERMINED] * len(x), np.zeros(len(x))
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        m = x @ self.family_w[:-1] + self.family_w[-1]
        first = m.argmax(1)
        p = sure(m)
        score = p[np.arange(len(x)), first]
        label = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            here = np.flatnonzero(first == f)
            langs = self.members[name]
            votes, mass = np.zeros((len(here), len(langs))), np.zeros((len(here), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                w = self.pair_w[langs[a], langs[b]]
                q = sure(x[here] @ w[:-1] + w[-1])
                votes[:, a] += q >= 0.5
                votes[:, b] += q < 0.5
                mass[:, a] += q
                mass[:, b] += 1 - q
            best = (votes + mass / (1 + len(langs))).argmax(1) if len(langs) > 1 else np.zeros(len(here), int)
            label[here] = np.array(langs, object)[best]
            if len(langs) > 1:
                score[here] *= mass[np.arange(len(here)), best] / (len(langs) - 1)
        return label.tolist(), np.clip(score, 0, 1)


def fold(doc_id: int | None, folds: int = 3) -> int:
    """crc32 of the id as text (``null`` for a null id), modulo ``folds``."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % folds


def _fold_column(folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(folds))


def fit(docs: DataFrame, folds: int = 3, held: int = 1, max_rows: int = MAX_ROWS) -> Model:
    """Learn from text and non-null lang of the rows whose fold is not ``held``; at most ``max_rows`` of them, as many per label."""
    small_batches(docs.sparkSession, 500)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold_column(folds) != held))
    counts = dict(map(tuple, rows.groupBy("lang").count().collect()))  # one number per label
    if not counts:
        return Model([], {}, np.zeros((DIM + 1, 0)), {})
    each = max(1, max_rows // len(counts))
    draw = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * each / n))])
    chosen = rows.select("lang", "text", draw).where(F.col("draw") < share[F.col("lang")])
    chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("k") <= each).select("lang", "text")

    def vectors(batches):
        for b in batches:
            x = features(b.column(1).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    got = sorted(map(tuple, chosen.mapInArrow(tidy(vectors), "lang string, x binary").collect()))
    lang = np.array([g[0] for g in got])
    x = np.stack([np.frombuffer(g[1], np.float16) for g in got]).astype(np.float32)
    return fit_rows(x, lang)


def fit_rows(x: np.ndarray, lang: np.ndarray) -> Model:
    labels = sorted(set(lang.tolist()))
    centroid = {k: (c := x[lang == k].mean(0)) / max(1e-9, float(np.linalg.norm(c))) for k in labels}
    family = {k: _FAMILY[k] for k in labels if k in _FAMILY}
    for k in labels:
        if k not in family:
            near = max(((float(centroid[k] @ centroid[o]), o) for o in labels if o in _FAMILY), default=(0, None))
            family[k] = _FAMILY[near[1]] if near[0] >= 0.8 else f"own:{k}"
    families = sorted(set(family.values()))
    members = {f: [k for k in labels if family[k] == f] for f in families}
    of = np.array([family[k] for k in lang.tolist()])
    w = [linear_svm(x, np.where(of == f, 1.0, -1.0)) for f in families] if len(families) > 1 else [np.append(np.zeros(x.shape[1]), 1.0)]
    pairs = {}
    for f in families:
        for a, b in combinations(members[f], 2):
            m = (lang == a) | (lang == b)
            pairs[a, b] = linear_svm(x[m], np.where(lang[m] == a, 1.0, -1.0))
    return Model(families, members, np.stack(w, 1), pairs)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, lang_pred, score) per row, from its text alone; ``row`` is a struct of the columns named in ``carry``.  ``und`` with score 0 for null texts and texts without a letter."""
    small_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").cast("string").alias("text"))

    def predict(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            pred: list[str] = []
            score: list[float] = []
            for s in range(0, len(texts), 128):
                p, q = shared.value.predict(features(texts[s : s + 128]))
                ok = [has_letter(t) for t in texts[s : s + 128]]
                pred += [y if o else UNDETERMINED for y, o in zip(p, ok, strict=True)]
                score += [float(y) if o else 0.0 for y, o in zip(q, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return picked.mapInArrow(tidy(predict), f"row {dict(picked.dtypes)['row']}, lang_pred string, score double")


def language_table(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Per row: (doc_id, held_out, lang_pred, score).  Works with repeated rows, null columns and an empty table (no rows; nothing learnt: ``und``)."""
    out = identify(docs, fit(docs, folds, held), ("doc_id",))
    return out.select("row.doc_id", "lang_pred", "score").select("doc_id", (_fold_column(folds) == held).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows that are rejected: no text, no letter, or a prediction of a score under ``least``.  Where ``lang`` is null, the prediction takes its place."""
    found = identify(docs, fit(docs), tuple(docs.columns)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return found.select(*[F.coalesce(f"row.`{c}`", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])
