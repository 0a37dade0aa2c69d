"""The filter audit against a plain version that walks every order, and on the awkward cases."""

import re
from itertools import permutations

import pytest

from abyssal.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, mask string, n long"


def brute(rows, labels):
    space = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    fails = []
    for d, t, lang, *_ in rows:
        t = t or ""
        w = space.findall(t)
        f = {c for c, x in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), d is not None and d > first[t]], strict=True) if x}
        fails.append((lang or "", f, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in fails}:
        own, share = [x[1:] for x in fails if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for i, c in enumerate(order):
                gone, stay = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                share[c] += len(gone)
                out[part, "".join(order), i + 1] = [len(stay), len(gone), sum(c in x[0] for x in own) - len(gone), sum(x[0] == {c} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone), c]
                left = stay
        for k in [k for k in out if k[0] == part]:
            out[k][-1] = share[out[k][-1]]
    return {k: tuple(v) for k, v in out.items()}


def table(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_audit_equals_walking_every_order(spark, bits):
    """With hashes of two bits or none, unlike texts of one length share all their classes: the full texts decide."""
    long = " ".join(f"w{i}" for i in range(300))
    texts = [long, long + "x", long, "AB cd", "ab CD", "xy zw", "AB cd", None, "", None, "a | b", "the the the the", "é" * 5, " \t\n", "w " * 5000, "w " * 5000 + "$", long]
    rows = [(i, t, ["en", None, ""][i % 3], "x", "y", 1) for i, t in enumerate(texts)]
    rows += [(None, long, "en", "x", "y", 1), (None, "AB cd", None, "x", "y", 1), (3, "AB cd", "en", "x", "y", 1), (3, "another text under the same id", "en", "x", "y", 1), (-7, "ab CD", "de", "x", "y", 1)]
    labels = [(0, 1, 0), (2, 1, 1), (2, 0, 1), (6, None, 1), (5, 1, None), (None, 1, 1), (99, 1, 1)]
    d, flags = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert table(filter_audit.interactions(filter_audit.mask_counts(d, flags, hash_bits=bits))) == brute(rows, labels)


def test_audit_of_empty_tables(spark):
    none, flags = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, flags).count() == 0
    one = spark.createDataFrame([(1, None, None, "x", "y", 1)], SCHEMA)
    got = table(filter_audit.audit(one, flags))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_copies_by_the_thousand_have_one_survivor(spark):
    d = spark.range(3000).selectExpr("id AS doc_id", "concat('the same text in every row ', if(id % 3 = 0, '', cast(id AS string))) AS text", "'en' AS lang")
    flags = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = {r.mask: r.n for r in filter_audit.mask_counts(d, flags).collect()}
    assert counts == {1: 2001, 17: 999}


def test_sieve_lets_every_wanted_row_through(spark):
    from abyssal.llm import common

    wanted = spark.range(0, 100_000, 7).selectExpr("xxhash64(id) AS h")
    words, n = common.sieve(wanted, "h")
    got = common.sifted(spark.range(100_000).selectExpr("id", "xxhash64(id) AS h"), "h", words, n).where("_maybe")
    ids = {r.id for r in got.select("id").collect()}
    assert set(range(0, 100_000, 7)) <= ids and len(ids) < 30_000
    none, n = common.sieve(wanted.limit(0), "h")
    assert common.sifted(wanted, "h", none, n).where("_maybe").count() == 0


def test_whole_licence_texts_are_licence_files(spark, tmp_path):
    """With whole texts as templates a licence file of many pages is told, and its directory inherits."""
    from pathlib import Path

    from abyssal.llm import license_scan

    words = [f"term{i}" for i in range(400)]
    for i, name in enumerate(("Long-1.0", "Long-2.0")):
        (tmp_path / name).write_text("\n\n".join(" ".join(words[(i * 37 + j * 11 + k * (3 + i)) % 400] for k in range(90)) for j in range(30)))
    rows = license_scan.texts_of(str(tmp_path))
    common = Path("/usr/share/common-licenses")
    if common.is_dir():
        rows += [r for r in license_scan.texts_of(str(common)) if r[0] in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0")]
    files = [(2 * i, f"x{i}/LICENSE", body) for i, (_, body) in enumerate(rows)] + [(2 * i + 1, f"x{i}/src/a.py", "def f(x):\n    return x") for i in range(len(rows))]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string"), rows=(*license_scan.TEMPLATES, *rows)).collect()}
    for i, (name, _) in enumerate(rows):
        assert (got[2 * i].own_license, got[2 * i].is_license_file) == (name, True) and (got[2 * i + 1].license, got[2 * i + 1].inherited_from) == (name, f"x{i}")
    with pytest.raises(ValueError):
        license_scan.texts_of(str(tmp_path), 100)
