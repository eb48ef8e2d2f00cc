import re

from tests.llm import cases
from casegate.llm import decontam


def brute(docs, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        doc, hit, named = split(text), set(), set()
        for item, body in items:
            w = split(body)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                phrase = w[i : i + window]
                for at in range(len(doc) - len(phrase) + 1):
                    if doc[at : at + len(phrase)] == phrase:
                        hit.update(range(at, at + len(phrase)))
                        if item is not None:
                            named.add(str(item))
        out.append((doc_id, len(doc), len(hit), sorted(named)))
    return sorted(out, key=str)


ITEMS = [(1, " ".join(cases.words(60)[5:25]).upper()), (2, "Short!"), (3, ""), (4, None), (2, "id here"), (None, "odd spaces")]


def found(spark, docs, **options):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = decontam.matches(decontam.build_index(docs), items, window=10, **options).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows], key=str)


def test_hits_equal_brute_force(spark):
    data = [r for r in cases.rows() if len(r[1] or "") < 10_000]
    want = brute([r[:2] for r in data], ITEMS, 10)
    assert found(spark, cases.documents(spark, data)) == want
    assert found(spark, cases.documents(spark, data), query_words=20) == want  # several passes


def test_report_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = decontam.report(decontam.matches(decontam.build_index(cases.documents(spark)), none)).collect()
    assert len(rows) == len(cases.rows()) and not any(r["contaminated"] for r in rows)
    assert found(spark, cases.empty(spark)) == []


def test_proximity_stays_within_a_document(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "red x x x x blue"), (3, "red"), (4, "blue red")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "red blue")], "item_id bigint, text string")
    rows = decontam.matches(decontam.build_index(docs), items, window=2, slop=3).collect()
    assert {r["doc_id"] for r in rows if r["items"]} == {1, 4}
