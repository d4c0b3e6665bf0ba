from docpipe.llm.common import scratch, written
from docpipe.llm.exact_dedup import DigestIndex, deduplicate, digests, exact_duplicates


def test_odd_rows(odd):
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    # Null and empty are one text, blank is another; repeated rows count and get one answer.
    assert {r for r in rows if r[0] in (0, 1, 2)} == {(0, 0, 2, True), (1, 0, 2, False), (2, 2, 1, True)}
    assert [r for r in rows if r[0] == 4] == [(4, 4, 2, True)] * 2
    assert {r for r in rows if r[0] in (6, 7)} == {(6, 6, 3, True), (7, 6, 3, False)}
    assert (None, None, 1, True) in rows


def test_without_duplicates(odd, none):
    kept = deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 not in ids and 7 not in ids and {0, 2, 4, 6, None} <= set(ids)
    assert deduplicate(none).count() == 0 == exact_duplicates(none).count()


def test_index_outlives_a_batch(spark, documents):
    path = f"{scratch(spark)}/index"
    first = exact_duplicates(documents(["a b", "c", "a  b"], [5, 6, 7]), DigestIndex(spark, path))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in first.collect()) == [(5, 5, True), (6, 6, True), (7, 5, False)]
    again = DigestIndex(spark, path)
    batch = written(digests(documents(["a b", "d"], [1, 2])), "batch")
    for _ in range(2):  # a repeated batch changes nothing
        found = sorted((r.doc_id, r.keep_id, r.kept) for r in again.deduplicate(batch).collect())
        assert found == [(1, 5, False), (2, 2, True)]
    assert again.table().count() == 3


def test_index_is_read_without_a_shuffle(spark, documents, plan):
    index = DigestIndex(spark, f"{scratch(spark)}/index")
    batch = digests(documents(["a", "b"]))
    text = plan(batch.join(index.table().hint("merge"), "digest", "left_anti"))
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
