"""Exact dedup, source divergence and ranked search against brute force, with the edge rows of the other text tests."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelry.llm import divergence, exactdedup, lexical

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, size long, key string, term string, score long, `a.b` string"


def _rows(*texts):
    """(doc_id, text, lang, source) with columns whose names clash."""
    return [(i, t, lang, source, 7, "c", 1, "k", "t", 5, "x") for i, t, lang, source in texts]


LONG = ("long words of a very long text " * 40_000)[: 1_200_000]  # over one slice
EDGE = _rows(
    (5, "a b\tc", "en", "s"), (3, "abc", "en", "s"), (9, "a  b\nc", "en", "t"), (4, "a b\tc", "en", None), (None, "abc  x", None, None), (None, "a b c x ", "en", "s"), (7, None, "en", "u"), (8, " \n\x0b\x0c\r\t ", None, "u"), (6, "", "fr", "s"),
    (10, "ABC", "en", "s"), (11, "é　É 日本 語", "en", "s"), (11, "é　É 日本 語", "en", "s"), (12, " \x1c\x85x", "en", "s"), (13, LONG, "de", "v"), (14, LONG + " ", "de", "v"), (15, "no such terms 123 456", "nn", "w"), (16, "123 ###", "zz", "w"), (17, "", "zz", "y"),
)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(4, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _many(seed=1, n=400):
    """Random texts with copies, common words and three languages by five sources, one of them with half of the rows."""
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnr"]
    out = []
    for i in range(n):
        text = " ".join(words[int(k)] for k in np.minimum(rng.zipf(1.3, rng.integers(1, 60)) - 1, 79))
        if out and rng.random() < 0.3:
            text = out[int(rng.integers(len(out)))][1] + " " * int(rng.integers(0, 3))
        out.append((i, text, ("en", "de", "fr")[int(rng.integers(3))], "s0" if rng.random() < 0.5 else f"s{rng.integers(1, 5)}"))
    return _rows(*out)


# exact dedup


def _brute_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    out = []
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in own:
            out.append((r[0], best[0], len(own), r[0] == best[0] and len(r[1] or "") == len(best[1] or ""), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def _got_groups(df, **more):
    rows = exactdedup.exact_groups(df, **more).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in rows), key=str)


@pytest.mark.parametrize("more", [{}, {"digest_bytes": 1}, {"digest_bytes": 0}, {"share": 5, "block_bytes": 20, "salts": 2}], ids=str)
def test_exact_groups_equal_brute_force(edge, more):
    assert _got_groups(edge, **more) == _brute_groups(EDGE)


def test_exact_groups_of_random_texts_and_one_large_group(spark):
    rows = _many() + _rows(*[(1000 + i, " same text" * 3 + " " * (i % 7), "en", "s0") for i in range(300)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = _brute_groups(rows)
    assert _got_groups(df) == want and _got_groups(df, digest_bytes=1, block_bytes=500) == want


def test_exact_groups_of_nothing(empty):
    assert exactdedup.exact_groups(empty).count() == 0


def test_a_large_group_is_dealt_over_salts(spark):
    """No task merges the copies that all tasks hold: each salt has its own, and the last stage sees one of each."""
    df = spark.createDataFrame(_rows(*[(i, "copy", "en", "s") for i in range(320)]), SCHEMA).repartition(32)
    local = exactdedup.local_winners(df, salts=8)
    assert local.count() == 32 and max(r["count"] for r in local.groupBy("key", "salt").count().collect()) == 4
    assert exactdedup.merged(local, "key", "salt").count() == 8


# source divergence


def _brute_audit(rows, least, top):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        every = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        far = lambda p, q: (p - q) * (p - q) // (p + q)
        for s, c in count.items():
            pairs = [(-sum(far(share(c, t), share(d, t)) for t in kept), u.encode(), u) for u, d in count.items() if u != s]
            terms = [(-far(share(c, t), share(every, t)), t.encode(), t) for t in kept if c[t] > 0 and share(c, t) > share(every, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def _got_audit(df, **more):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, **more).collect())


def test_audit_of_edge_rows_equals_brute_force(edge, empty):
    for least in (1, 2):
        assert _got_audit(edge, least=least) == _brute_audit(EDGE, least, 10)
    assert divergence.audit(empty).count() == 0


@pytest.mark.parametrize("more", [{}, {"block_bytes": 600, "fan_in": 2}, {"bucket_rows": 40}], ids=str)
def test_audit_equals_brute_force_over_many_runs(spark, more):
    rows = _many(3) + _rows(*[(900 + i, "bal " * 50 + f"zeta{i % 3}", "en", f"s{i % 2}") for i in range(12)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _got_audit(df, **more) == _brute_audit(rows, 10, 10)


def test_a_run_is_sorted_by_term_and_shorter_than_its_entries(spark):
    block = divergence.Block()
    for _, text, lang, source, *_ in _many(4, 80):
        block.add(lang.encode(), source.encode(), text.encode())
    rows = list(block.run(64, 1, 0))
    entries = sum(r["terms"].count(b"\n") + 1 for r in rows)
    assert len(rows) <= entries
    for r in rows:
        terms = r["terms"].split(b"\n")
        assert terms == sorted(terms)


# ranked search


def _brute_search(rows, items, k):
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    n, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= set(terms(text))
    out = []
    for i, own in asked.items():
        found = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total if c else 50
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _got_search(df, items, k, **more):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked(lexical.Index(df, **more), items, k).collect()), key=str)


ITEMS = [(1, "abc long words"), (2, None), (3, "é 日本"), (3, "x"), (4, "no NO such TERMS 123"), (5, "absent"), (None, "words of a"), (1, "abc long words")]


def test_search_of_edge_rows_equals_brute_force(spark, edge, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit("clash"))
    assert _got_search(edge, items, 5) == _brute_search(EDGE, ITEMS, 5)
    assert lexical.ranked(lexical.Index(empty), items, 5).count() == 0
    assert lexical.ranked(lexical.Index(edge), items.limit(0), 5).count() == 0


@pytest.mark.parametrize("more", [{}, {"shard_bytes": 2000}, {"shard_bytes": 2000, "paired": 0}], ids=str)
def test_search_equals_brute_force(spark, monkeypatch, more):
    rows = _many(6, 600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    items = [(i, rows[i * 7][1]) for i in range(25)]
    monkeypatch.setattr(lexical, "ITEM_BYTES", 2000)  # several jobs
    assert _got_search(df, spark.createDataFrame(items, "item_id long, text string"), 10, **more) == _brute_search(rows, items, 10)


def test_pair_bounds_hold_and_skip_more_than_single_ones():
    """Bounds never lie under a score; with pair lists fewer postings are met, and the answer is the same."""
    rng = np.random.default_rng(9)
    common = [f"c{k}" for k in range(12)]
    held = lexical.Gathered()
    for i in range(4000):  # common words come in one of two sets, so that members of both never meet
        side = int(rng.integers(2))
        own = [common[2 * int(k) + side] for k in rng.integers(0, 6, 8)] + [f"r{rng.integers(0, 300)}" for _ in range(3)]
        held.add(i, " ".join(own).encode())
    row = held.row()
    start, doc, tf = np.frombuffer(row["start"], "<i8"), np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["number"], "<i4").astype(np.int64)
    names = row["terms"].split(b"\n")
    weights = {t: int(1000 * math.log(8002 / (2 * (start[k + 1] - start[k]) + 1))) for k, t in enumerate(names)}
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * lexical._lengths(np.frombuffer(row["sizes"], "<i8"), 4000, row["n_terms"])[doc])
    row["number"] = impact.astype("<i4").tobytes()
    place = dict(zip(names, range(len(names))))
    lists = lexical.pair_lists(place, start, doc, impact, 4000, {t: weights[t] for t in names if t.startswith(b"c")})
    met = {}
    for name, pairs in (("single", b""), ("pairs", lists)):
        shard = lexical.Shard(row | {"pairs": pairs}, weights)
        answers = []
        for q in range(60):
            query = [b"c%d" % k for k in range(6)] + [b"r%d" % ((q * 5) % 300), b"r%d" % ((q * 7 + 1) % 300)]
            found, score = shard.best(query, 10, 0)
            whole = np.zeros(4000, np.int64)
            for t in query:
                if t in shard.place:
                    d, gain, _ = shard.gains(t)
                    whole[d] += gain
            first = np.lexsort((found, -score))[:10]
            assert score[first].tolist() == sorted(whole.tolist(), reverse=True)[:10] and (whole[found] == score).all()
            ordered = sorted((t for t in query if t in shard.place), key=lambda t: (shard.gains(t)[2], t))
            for j, (most, block) in enumerate(zip(*shard.bounds(ordered))):
                part = np.zeros(4000, np.int64)
                for t in ordered[:j]:
                    d, gain, _ = shard.gains(t)
                    part[d] += gain
                assert part.max() <= most and (part <= block[np.arange(4000) // lexical.SPAN]).all()
            answers.append((found[first].tolist(), score[first].tolist()))
        met[name] = shard.met, shard.held, answers
    assert met["pairs"][2] == met["single"][2] and met["pairs"][0] < met["single"][0] < met["single"][1]
