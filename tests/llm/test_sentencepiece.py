import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lantern.llm import sentencepiece_codec as x
from tests.llm.data import documents

MODEL = x.model_path()


def test_pieces_do_not_cross_markers():
    assert x.crossing_pieces(MODEL) == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab c ▁\n\té日😀<>s/　\u00a0.") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_are_the_library_s(text):
    assert x.ChunkTable(MODEL).encode([text]).to_pylist()[0] == x.processor(MODEL).encode(text)


def test_small_table_is_emptied(spark):
    t = x.ChunkTable(MODEL, limit=5)
    assert t.encode(["one two", "three four", "one"]).to_pylist() == x.processor(MODEL).encode(["one two", "three four", "one"])
    assert t.encode(["one five"]).to_pylist() == x.processor(MODEL).encode(["one five"])


def test_documents_and_edges(spark):
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "  "), (-4, "a" * 100_000), (None, "x y"), (-5, "x y"), (-5, "x y")], "doc_id long, text string")
    df = documents(spark).select("doc_id", "text").unionByName(more).selectExpr("*", "'old' AS ids", "1 AS decoded")
    p = x.processor(MODEL)
    want = []
    for i, t in ((r["doc_id"], r["text"]) for r in df.collect()):
        ids = p.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, x.digests(x.encode_decode(df, MODEL), "doc_id").collect()), key=str) == sorted(want, key=str)
    both = x.decode(x.encode(more, MODEL), MODEL).collect()
    assert [r["decoded"] for r in both] == [p.decode(p.encode(r["text"] or "")) for r in both]
    assert x.encode_decode(df.limit(0), MODEL).collect() == []
