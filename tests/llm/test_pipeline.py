"""Each stage of the corpus pipeline on a small fixture, with edge rows, and on an empty table."""

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ITEM = " ".join(f"item{i}" for i in range(20))


def _prose(k, n=80):
    return " ".join(f"w{(k * 7919 + i * i * 31 + i) % 997}" for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, _prose(i) + (f" slurword{chr(97 + i % 26)} slurwords" if i % 4 == 0 else ""), "en", "s", 1) for i in range(400)]
    rows += [(1001, _prose(1), "en", "s", 1), (1002, _prose(2) + " changed", "en", "s", 1), (1003, _prose(500) + " " + PASSAGE, "en", "s", 1), (1004, _prose(501) + " " + PASSAGE + " tail", "en", "s", 1)]
    rows += [(1005, _prose(502) + " " + ITEM, "en", "s", 1), (1006, None, None, None, None), (1007, "", "en", "s", 0), (None, "no id here", "en", "s", 10)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    clean = cp.drop_toxic(spark, docs, folder)
    assert clean.columns == columns
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    assert sum(i in left for i in range(400) if i % 4) >= 295 and sum(i in left for i in range(0, 400, 4)) <= 5

    kept = cp.drop_near_duplicates(spark, docs, folder)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == columns and {1, 2, None, 1006, 1007} <= set(ids) and not {1001, 1002} & set(ids)
    assert len(ids) == docs.count() - 2

    cut = {r.doc_id: r for r in cp.cut_repeated_windows(spark, docs, folder).collect()}
    assert PASSAGE in cut[1003].text and PASSAGE.split()[5] not in cut[1004].text and cut[1004].text.endswith(" tail")
    assert cut[1004].n_chars == len(cut[1004].text) and cut[1006].text is None and cut[1007].text == ""
    assert len(cut) == docs.count()

    free = {r.doc_id for r in cp.drop_contaminated(spark, docs, folder).collect()}
    assert 1005 not in free and len(free) == docs.count() - 1

    out = cp.encode_pieces(spark, docs, folder)
    assert out.count() == docs.count() and {"doc_id", "pieces"} <= set(out.columns)


def test_run_is_the_stages_in_order(spark, folder):
    got = {r.doc_id for r in cp.run(spark, folder).select("doc_id").collect()}
    assert not {1001, 1002, 1005} & got and {1003, 1004, 1006, 1007, None} <= got
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_duplicates", "repeated_windows", "decontamination", "pieces"]


def test_stages_on_an_empty_table(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_clashing_names_and_repeated_ids(spark, folder):
    """Columns named like working columns come back as they were; rows that repeat a doc_id are judged by their own text."""
    names = ["_text", "_kept", "_toxicity", "_items", "row", "hash", "kept", "group", "a.b"]
    schema = SCHEMA + ", " + ", ".join(f"`{n}` string" for n in names)
    more = tuple(f"value of {n}" for n in names)
    rows = [(1, _prose(1), "en", "s", 1), (9, _prose(1) + " tail", "en", "s", 1), (9, _prose(700), "en", "s", 1), (9, _prose(700), "en", "s", 1), (20, _prose(800), "en", "s", 1), (20, _prose(800) + " more", "en", "s", 1)]
    rows += [(30, _prose(500) + " " + PASSAGE, "en", "s", 1), (31, PASSAGE, "en", "s", 1), (None, _prose(1), None, None, None), (40, None, None, None, None), (41, "", None, None, 0)]
    docs = spark.createDataFrame([r + more for r in rows], schema)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert {tuple(r[c] for c in names) for r in out.collect()} == {more}, name
    kept = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, folder).collect()]
    assert sorted(t for i, t in kept if i == 9) == [_prose(700)]
    assert sum(i == 20 for i, _ in kept) == 1 and sum(i == 1 for i, _ in kept) == 1
    assert {None, 40, 41} <= {i for i, _ in kept}


def _words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_match_brute_force(spark, folder):
    """Near duplicates, windows and contamination of the fixture by plain loops; toxicity by the model itself, row by row."""
    from panelry.llm import langid, toxicity
    from panelry.llm.letters import Letters

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def shingles(text, n):
        w = _words((text or "").lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    sets = {i: shingles(t, min(5, max(1, len(_words(t))))) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i, x in sets.items() if x)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    want = {i for i in sets if find(i) == i} | {None}
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, folder).collect()} == want

    owner = {}
    for i, t in rows:
        if i is not None:
            for w in shingles_in_order(t):
                owner[w] = min(owner.get(w, i), i)
    cut = {r.doc_id: r.text for r in cp.cut_repeated_windows(spark, docs, folder).collect()}
    for i, t in rows:
        w, gone = _words(t), set()
        for k, x in enumerate(shingles_in_order(t)):
            if i is not None and owner[x] < i:
                gone |= set(range(k, k + 13))
        assert cut[i] == (" ".join(x for k, x in enumerate(w) if k not in gone) if gone else t)

    item = shingles(ITEM, 5)
    want = {i for i, t in rows if len(item & shingles(t, 5)) < 0.75 * len(item)}
    assert {r.doc_id for r in cp.drop_contaminated(spark, docs, folder).collect()} == want

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet").where(~langid.held_out()))
    want = {i for i, t in rows if model.scores(Letters([t]))[0] < toxicity.THRESHOLD}
    assert {r.doc_id for r in cp.drop_toxic(spark, docs, folder).collect()} == want


def shingles_in_order(text, n=13):
    w = _words(text)
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
