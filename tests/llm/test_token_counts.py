import functools

from hypothesis import given, settings
from hypothesis import strategies as st

from lantern.llm import token_counts as x
from lantern.llm.sentencepiece_codec import model_path, processor
from tests.llm.data import documents

MODEL = model_path()


@functools.cache
def library():
    """Another library's unigram model over the same pieces, byte pieces added for its fallback."""
    from tokenizers import Tokenizer, models

    pieces = x.vocabulary(MODEL)
    low = min(pieces.values())
    # the unknown piece and the bytes must not be matched in a text, so they get the least score
    vocab = [("<unk>", low)] + [(f"<0x{b:02X}>", low) for b in range(256)] + list(pieces.items())
    return Tokenizer(models.Unigram(vocab, 0, True))


def library_count(text):
    return len(library().encode(x.MARK + text.replace(" ", x.MARK)).ids) if text else 0


def brute(pieces, unknown, text):
    """All starts in rising order for each end, over the whole text."""
    t = x.MARK + text.replace(" ", x.MARK)
    longest = max(map(len, pieces))
    best, count = [0.0], [0]
    for end in range(1, len(t) + 1):
        found = None
        for start in range(max(0, end - longest), end):
            piece = t[start:end]
            if piece in pieces:
                score, tokens = best[start] + pieces[piece], count[start] + 1
            elif end - start == 1:
                score, tokens = best[start] + unknown, count[start] + len(piece.encode())
            else:
                continue
            if found is None or score > found[0]:
                found = score, tokens
        best.append(found[0])
        count.append(found[1])
    return (count[-1], best[-1]) if text else (0, 0.0)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abthe  ▁\n\té日😀ing.1") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_against_brute_force(text):
    c = x.Counter(x.model_matcher(MODEL))
    assert c.count(text) == brute(x.vocabulary(MODEL), c.unknown, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abthe  \n\té日😀ing.1"), max_size=60))
def test_against_a_library(text):
    assert x.Counter(x.model_matcher(MODEL)).count(text)[0] == library_count(text)


def test_ties_keep_the_earlier_start():
    c = x.Counter(x.matcher({x.MARK: -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, x.MARK + "a": -2.0}))
    assert c.count("ab") == (2, -3.0) and brute({x.MARK: -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, x.MARK + "a": -2.0}, c.unknown, "ab") == (2, -3.0)


def test_documents_and_edges(spark):
    assert not x.crossing_pieces(MODEL)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "  "), (-4, "ab" * 40_000), (None, "x y"), (-5, "x y"), (-5, "x y")], "doc_id long, text string")
    df = documents(spark).select("doc_id", "text").limit(40).unionByName(more).selectExpr("*", "'old' AS n_tokens")
    want = [(r["doc_id"], library_count(r["text"])) for r in df.collect()]
    got = [(r["doc_id"], r["n_tokens"]) for r in x.count_tokens(df, MODEL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = x.Counter(x.model_matcher(MODEL), limit=5)
    assert [small.count(t) for t in ("one two three", "one two")] == [x.Counter(x.model_matcher(MODEL)).count(t) for t in ("one two three", "one two")]
    assert x.count_tokens(df.limit(0), MODEL).collect() == [] and processor(MODEL).get_piece_size() == 32_000
