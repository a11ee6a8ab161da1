import hashlib

from pyspark.sql import functions as F

from cohortspark.llm.exact_dedup import chunks, drop_exact_copies, exact_groups

LONG = "word and other things " * 4000


def rows():
    return [
        (1, "same"), (5, "same"), (3, "same"), (4, "other"), (6, None), (7, ""), (8, " "), (9, LONG), (10, LONG), (11, LONG + "x"),
        (12, "x" * 9000), (13, "x" * 9001), (14, "x" * 9000), (15, "a\nb"), (16, "a\r\nb"),
    ]


def test_groups(make_docs, clashing):
    found = {r["doc_id"]: r for r in exact_groups(clashing(make_docs(rows()))).collect()}
    by_text = {}
    for i, text in rows():
        by_text.setdefault(text or "", []).append(i)
    for i, text in rows():
        same, r = by_text[text or ""], found[i]
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(same), len(same), i == max(same), sha)


def test_chunks_join_to_the_text(make_docs):
    found = make_docs(rows()).filter("text is not null").select("text", F.array_join(chunks(F.col("text")), "").alias("back"))
    assert all(r["text"] == r["back"] for r in found.collect())


def test_weak_identifiers_are_found_out(make_docs):
    weak = (lambda c: F.lit("1"), lambda c: F.sha2(c, 256))
    plain = {(r["doc_id"], r["keep_id"]) for r in exact_groups(make_docs(rows())).collect()}
    assert {(r["doc_id"], r["keep_id"]) for r in exact_groups(make_docs(rows()), identifiers=weak).collect()} == plain


def test_repeated_and_null_ids_keep_one_row(make_docs, clashing):
    docs = clashing(make_docs([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "d")]))
    assert sum(r["kept"] for r in exact_groups(docs).collect()) == 4
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    order = sorted((str(r["doc_id"]), r["text"]) for r in left.collect())
    assert order == [("1", "a"), ("2", "c"), ("2", "d"), ("None", "b")]


def test_empty_table(make_docs):
    assert exact_groups(make_docs([])).collect() == [] and drop_exact_copies(make_docs([])).collect() == []


def test_no_python_in_the_plan(make_docs):
    plan = exact_groups(make_docs(rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
