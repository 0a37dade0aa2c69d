"""Entities against the plain patterns, disclosing terms against counting in plain Python, and the awkward cases."""

import collections
import hashlib
import math
import random
import re

import pytest

from abyssal.llm import disclosure

SCHEMA = "doc_id long, text string, spans string, terms string, entity string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [(s, e, k) for s, k, e in sorted(out)]


def test_entities_equal_the_plain_patterns():
    rng = random.Random(5)
    pieces = ["a@b.c", "x.y_z%+-@ab-c.de.f", "@", "a@b", ".", "-", "_", "+", "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (555) 010-1234", "+49", "(", ")", " ", "  ", "é", "12", "9", "\n", "İ", "٣", "+1-2.3.4.5"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert disclosure.entities(text) == plain(text), text
    assert disclosure.entities(None) == [] and disclosure.luhn("79927398713") and not disclosure.luhn("79927398710")


@pytest.mark.parametrize("text", ["a" * 300_000, "a.b" * 100_000 + "@", "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" + "(" * 300_000, "a@b." * 100_000, "@" * 300_000, "a@" * 150_000])
def test_long_runs_take_linear_time(text):
    assert isinstance(disclosure.entities(text), list)


def corpus():
    rows = []
    for i in range(60):
        who = f"Ana Petrov{'sky' if i % 2 else 'a'} from account K77X writes: ana.p@mail.example.com" if i < 12 else f"someone{i} writes to number{i}"
        rows.append((i, f"{who}. Then comes filler{i % 7} text, and more of common words here {i}", "x", "y", "z"))
    rows += [(100 + i, "a copy with rareword rare.value@x.org and no more", "x", "y", "z") for i in range(50)]
    rows += [(300, "Only K77X here", "x", "y", "z"), (301, None, None, None, None), (302, "", "", "", ""), (None, "K77X and no id +1 555 010 1234", "x", "y", "z"), (303, "K77X K77X", "x", "y", "z"), (303, "K77X K77X", "x", "y", "z"), (303, "another of that id", "x", "y", "z")]
    return rows


def brute(rows, alpha, support):
    both, contexts, named, held = collections.Counter(), collections.defaultdict(set), collections.Counter(), collections.Counter()
    for _, text, *_ in rows:
        spans, pairs = plain(text), set()
        for s, e, k in spans:
            terms = disclosure.neighbours(text, spans, s, e)
            for t in terms:
                pairs.add((disclosure.value_of(text[s:e], k), t))
                contexts[disclosure.value_of(text[s:e], k), t].add(tuple(terms))
        both.update(pairs)
        named.update({disclosure.value_of(text[s:e], k) for s, e, k in spans})
        held.update({w.lower() for w in re.findall(r"[^\W_]{3,}", text or "")})
    out = {}
    for (e, t), n in both.items():
        if len(contexts[e, t]) >= support and named[e] < len(rows):
            share = math.log2(n * len(rows) / (named[e] * held[t])) / math.log2(len(rows) / named[e])
            if share * alpha >= 1:
                out[e, t] = (n, named[e], held[t], round(share, 9))
    return out


@pytest.mark.parametrize(("alpha", "support"), [(1.05, 3), (1.5, 1), (3.0, 2)])
def test_disclosing_terms_equal_counting(spark, alpha, support):
    rows = corpus()
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.entity, r.term): (r.n_both, r.n_entity, r.n_term, round(r.disclosure, 9)) for r in disclosure.disclosing(d, disclosure.found(d), alpha, support).collect()}
    assert got == brute(rows, alpha, support)
    assert ("email:ana.p@mail.example.com", "k77x") in got or alpha < 1.5
    assert support > 1 or ("email:rare.value@x.org", "rareword") in got


def test_spans_and_sanitised_texts(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    terms = {t for _, t in brute(rows, 1.5, 3)}
    assert {"k77x", "account", "ana"} <= terms and "rareword" not in terms and "writes" not in terms
    marks = disclosure.protected_spans(d, alpha=1.5)
    want = []
    for i, text, *_ in rows:
        base = plain(text)
        extra = [(m.start(), m.end(), 4) for m in re.finditer(r"[^\W_]{3,}", text or "") if m[0].lower() in terms and not any(s < m.end() and m.start() < e for s, e, _ in base)]
        name = (*disclosure.KINDS, "term")
        join = lambda x: ",".join(f"{name[k]}:{s}:{e}" for s, e, k in sorted(x, key=lambda v: (v[0], v[2])))
        want.append((str(i), *(sum(k == j for *_, k in base) for j in range(4)), hashlib.sha256(join(base).encode()).hexdigest(), join(base + extra)))
    got = [(str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in disclosure.digest(marks).collect()]
    assert sorted(got) == sorted(want)
    clean = {(r.doc_id, r.text) for r in disclosure.sanitised(d, alpha=1.5).collect()}
    assert (300, "Only [NUMBER] here") in clean and (301, None) in clean and (302, "") in clean and (None, "[NUMBER] and no id [PHONE]") in clean and (303, "another of that id") in clean
    assert any(i == 0 and "[EMAIL]" in t and "ana" not in t.lower() and "Petrov" not in t for i, t in clean if t) and (100, "a copy with rareword [EMAIL] and no more") in clean
    assert disclosure.sanitised(d).columns == d.columns and disclosure.sanitised(d).count() == len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert disclosure.protected_spans(none).count() == 0 and disclosure.sanitised(none).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None)], SCHEMA)
    assert [r.spans for r in disclosure.digest(disclosure.protected_spans(one)).collect()] == ["", ""]


def test_filter_lets_every_wanted_term_through(spark):
    words = [f"w{i}é" for i in range(3000)]
    bloom = disclosure.term_filter(spark.createDataFrame([(w,) for w in words], "term string"))
    assert disclosure._may_hold(bloom, words) == set(words) and len(disclosure._may_hold(bloom, [f"v{i}" for i in range(3000)])) < 100
    assert disclosure._may_hold(disclosure.term_filter(spark.createDataFrame([], "term string")), ["a"]) == set()
