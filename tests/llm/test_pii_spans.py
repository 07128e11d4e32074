"""Added spans of personal data: whole however long, and none over another."""

from taskloom.llm import pii


def found(text):
    return {(k, text[a:b]) for k, a, b in pii.more_spans(text)}


def test_long_spans_are_whole():
    long_ = "0123456789abcdef" * 19
    assert ("secret", long_) in found(f'token = "{long_}"') and ("secret", "ab12" * 40) in found("x " + "ab12" * 40 + " y")
    assert ("secret", "sk-" + "a1" * 100) in found("sk-" + "a1" * 100)
    assert ("name", "Dr. " + "A" + "b" * 40) in found("Dr. " + "A" + "b" * 40 + " said")
    assert not found("z" + "ab12" * 40 + "g")


def test_chains_of_overlapping_spans():
    spans = [("phone", 9, 21), ("secret", 9, 21), ("name", 20, 25), ("name", 25, 30)]
    assert [n for n, *_ in pii.chained(spans)] == [0, 0, 0, 1]
    assert list(pii.chained([])) == []


def test_added_spans_do_not_overlap(spark):
    texts = ["password=555-123-4567", "token: 555-123-4567abc99", "call 555-123-4567 now"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.detect(docs, threshold=0.0).where("not base").collect()
    spans: dict[int, list] = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    assert len(spans) == 90
    for own in spans.values():
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
