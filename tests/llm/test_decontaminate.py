from gridloom.llm import decontaminate

from .conftest import words

ITEM = "A train leaves Paris at 9 and travels 120 km to reach Lyon. How many hours does Marie wait if Marie arrives at 7 and Paris is quiet?"


def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "Too short here"), (3, None), (4, ""), (None, " ".join(words(25, 5)))], "item_id bigint, text string")


def found(spark, docs, rows):
    return sorted((r.doc_id, r.item_id) for r in decontaminate.query(docs(rows), bench(spark)).collect())


def test_copies_and_new_parameters(spark, docs):
    around = " ".join(words(30, 8))
    new = ITEM.replace("Paris", "Berlin").replace("Lyon", "Hamburg").replace("Marie", "Ingrid").replace("120", "80").replace("km", "miles").replace("9", "11")
    mixed = ITEM.replace("Marie", "Ingrid", 1).replace("Paris", "Oslo", 1)
    names = iter("Anna Bert Carl Dora Emil Fritz Gabi Hans Ida Jan Kai Lea".split())
    loose = " ".join(next(names) if w in ("Paris", "Lyon.", "Marie") else w for w in ITEM.split())
    rows = [(1, ITEM, "s"), (2, f"{around} {ITEM.upper()} {around}", "s"), (3, f"{around}\n{new}", "s"), (4, around, "s"), (5, ITEM[: len(ITEM) // 2], "s"), (6, None, "s"), (7, " ".join(words(25, 5)), "s"), (1, ITEM, "s")]
    got = decontaminate.query(docs(rows), bench(spark)).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (7, 0)]
    # a name that stands for two others is no consistent slot
    by_id = {r.doc_id: r for r in decontaminate.query(docs([(1, mixed, "s"), (2, loose, "s"), (3, new, "s")]), bench(spark)).collect()}
    assert 5 * by_id[3].n_matched >= 4 * by_id[3].n_windows
    assert 2 not in by_id or by_id[2].n_matched < by_id[3].n_matched


def test_variants_in_one_document(spark, docs):
    """A document with an item more than once, each time with other values, holds it as a document with one of them does."""

    def variant(city, to, who, n):
        return ITEM.replace("Paris", city).replace("Lyon", to).replace("Marie", who).replace("120", str(n)).replace("9", str(n % 7))

    some = [variant("Berlin", "Hamburg", "Ingrid", 80), variant("Oslo", "Bergen", "Zoe", 310), variant("Rome", "Milan", "Aldo", 555), ITEM]
    put_in = some[1].replace("travels", "slowly travels").replace("wait", "then wait")
    around = " ".join(words(40, 3))
    texts = [some[0], f"{some[0]} {some[1]}", "\n".join(some[:3]), f"{around} {some[0]} {around} {some[1]} {around}", " ".join(some), f"{some[0]} {around} {put_in} {some[2]}"]
    got = {r.doc_id: r for r in decontaminate.query(docs([(i, t, "s") for i, t in enumerate(texts)]), bench(spark)).collect()}
    assert sorted(got) == list(range(len(texts)))
    assert all(r.n_matched >= got[0].n_matched for r in got.values())
    frame = docs([(i, t, "s") for i, t in enumerate(texts)])
    assert decontaminate.clean(frame, bench(spark)).count() == 0


def test_clean(spark, docs, odd):
    rows = [(1, ITEM, "s"), (2, "clean " + " ".join(words(40, 2)), "s"), (None, ITEM + " x", "s"), (3, None, "s")]
    frame = docs(rows)
    out = decontaminate.clean(frame, bench(spark))
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
    assert decontaminate.clean(odd, bench(spark)).count() == odd.count()
    assert decontaminate.query(odd, bench(spark).limit(0)).count() == 0
    assert decontaminate.query(odd.limit(0), bench(spark)).count() == 0


def test_shuffle_join_agrees(spark, docs, monkeypatch):
    rows = [(1, ITEM, "s"), (2, "x " * 50, "s"), (3, ITEM.replace("Paris", "Rome"), "s")]
    want = found(spark, docs, rows)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert found(spark, docs, rows) == want == [(1, 1), (3, 1)]


def test_forms(spark):
    df = spark.createDataFrame([("Run 5 km, then 3.5kg (for $20) with O'Neill's -- dog at 7.",)], "text string")
    said, t1, t2 = (df.select(c).first()[0] for c in decontaminate.forms(df["text"]))
    assert said == ["run", "5", "km", "then", "3.5kg", "for", "20", "with", "o'neill's", "dog", "at", "7"]
    assert t1 == ["run", "<num>", "<unit>", "then", "<qty>", "for", "<num>", "with", "o'neill's", "dog", "at", "<num>"]
    assert t2[0] == "<name>" and t2[8] == "<name>"


def test_short_and_numeric_items(spark, docs, monkeypatch):
    """Items too vague for windows are found word by word; one or two words only as a whole text."""
    items = ["What is 2+2?", "7 8 9 10 11 12 13 is what", "Paris", "1 2 3 4 5 6 7 8 9 10 11 12"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    around = " ".join(words(30, 4))
    texts = ["What is 2+2?", f"{around} what IS (2+2) {around}", f"{around} 7 8 9 10 11 12 13 is what {around}", "7 8 9 10 11 12 14 is what", "what is 2", "paris!", f"{around} Paris {around}", "0 1 2 3 4 5 6 7 8 9 10 11 12", "7 8 9 10 11 12 13 is", "", None, "--"]
    frame = docs([(i, t, "s") for i, t in enumerate(texts)])
    want = [(0, 0), (1, 0), (2, 1), (5, 2), (7, 3)]
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
        got = decontaminate.query(frame, b).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == want and all(r.n_windows == r.n_matched == 1 for r in got)
    import duckdb

    from gridloom.llm import oracle

    documents, benchmark = frame.select("doc_id", "text").toPandas(), b.toPandas()  # noqa: F841
    assert sorted(duckdb.sql(oracle.DECONTAMINATE).fetchall()) == [(*w, 1, 1) for w in want]
