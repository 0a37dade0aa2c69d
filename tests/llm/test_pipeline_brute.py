"""The pipeline's stages, one after another, against plain versions of each; first-fit decreasing against a plain search."""

import re

import numpy as np

from abyssal.llm import packing, simhash


def near_dedup(rows):
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    first = {}
    for (i, _), g in zip(rows, label, strict=True):
        first[g] = min(first.get(g, i), i)
    return [r for r, g in zip(rows, label, strict=True) if first[g] == r[0]]


def substring(rows, width=13):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    first = {}
    for i, t in rows:
        w = cut(t)
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = cut(t)
        gone = {p + j for p in range(len(w) - width + 1) if first[tuple(w[p : p + width])] < i for j in range(width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
        if kept or not gone:
            out.append((i, kept))
    return out


def decontaminated(rows, items, width=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[p : p + width]) for t in items if (w := cut(t)) for p in range(max(1, len(w) - width + 1))}
    sizes = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w = cut(t)
        hit = {p + j for n in sizes for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for j in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t))
    return out


def test_stages_equal_plain_versions(spark, sf):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    d = stages["language ID"](spark, docs, sf)
    rows = sorted((r.doc_id, r.text) for r in d.collect())
    schema = d.schema
    for name, plain in (("SimHash near-dedup", near_dedup), ("substring dedup", substring), ("benchmark decontamination", lambda x: decontaminated(x, items))):
        want = plain(rows)
        out = stages[name](spark, d, sf).collect()
        rows = sorted((r.doc_id, r.text) for r in out)
        assert rows == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in out if name == "substring dedup")
        d = spark.createDataFrame(out, schema)
    packed = stages["packing"](spark, d, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in rows}


def test_tree_packs_like_a_plain_search():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 7, 300):
        lengths = rng.integers(1, 101, n)
        at, offset = packing.first_fit_decreasing(lengths, 100)
        free = [100] * max(1, n)
        for i in np.argsort(-lengths, kind="stable").tolist():
            b = next(b for b, room in enumerate(free) if room >= lengths[i])
            assert (at[i], offset[i]) == (b, 100 - free[b])
            free[b] -= lengths[i]
