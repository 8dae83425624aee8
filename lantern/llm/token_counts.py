"""Token counts by a count-only Viterbi over a unigram vocabulary.

The pieces of a vocabulary file and their scores are taken as a unigram vocabulary. An Aho-Corasick automaton
enumerates all pieces that end at each character; dynamic programming carries the best score and the number
of pieces up to there, and no path. The rules are those of unigram tokenizers: of paths that end at a place
with equal scores the one whose last piece starts first stays; a character that is no piece costs the least
score of all less 10 and counts as its UTF-8 bytes; a marker stands before the text and for every space.
Sums are doubles, which are exact for the whole scores of this vocabulary.

No piece has a marker after another character, so a text is the concatenation of marked words that are
counted on their own: each task counts a distinct marked word once, in a table of bounded size. No
shuffle takes place, and a very long text needs no more memory than its words.

Defined results: a null or empty text has no tokens and score 0; repeated rows give repeated results; an empty
table gives an empty result; columns of the input with the names of the outputs are replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lantern.llm.common import table
from lantern.llm.sentencepiece_codec import ENTRY, MARK, TABLE_BYTES, crossing_pieces, model_path, processor, slices

UNKNOWN_PENALTY = 10.0


def vocabulary(model: str) -> dict[str, float]:
    """Ordinary pieces and their scores; control, unknown and byte pieces match no text."""
    p = processor(model)
    return {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}


def matcher(pieces: dict[str, float]):
    """The automaton of ``pieces``, their least score and the single characters among them."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for piece, score in pieces.items():
        found.add_word(piece, (len(piece), score))
    found.make_automaton()
    return found, min(pieces.values()), {x for x in pieces if len(x) == 1}


@functools.cache
def model_matcher(model: str):
    """Of the vocabulary of a model: what a Python worker keeps from task to task."""
    return matcher(vocabulary(model))


class Counter:
    """Marked word -> (tokens, score)."""

    def __init__(self, matches: tuple, crossing: bool = False, limit: int = TABLE_BYTES):
        self.automaton, least, self.single = matches
        self.unknown = least - UNKNOWN_PENALTY
        self.crossing, self.limit, self.held = crossing, limit, 0
        self.seen: dict[str, tuple[int, float]] = {}

    def viterbi(self, word: str) -> tuple[int, float]:
        best: list[float | None] = [0.0] + [None] * len(word)
        count = [0] * (len(word) + 1)
        at = 0

        def close(stop: int) -> None:
            # an unknown character is the last way to reach its end, so it must be strictly better
            nonlocal at
            while at < stop:
                if word[at] not in self.single:
                    score, end = best[at] + self.unknown, best[at + 1]
                    if end is None or score > end:
                        best[at + 1], count[at + 1] = score, count[at] + len(word[at].encode())
                at += 1

        # the automaton gives the matches of one end from the longest, which starts first, to the shortest
        for last, (size, gain) in self.automaton.iter(word):
            close(last)
            start = last + 1 - size
            score, end = best[start] + gain, best[last + 1]
            if end is None or score > end:
                best[last + 1], count[last + 1] = score, count[start] + 1
        close(len(word))
        return count[-1], best[-1]

    def of(self, word: str) -> tuple[int, float]:
        found = self.seen.get(word)
        if found is None:
            found = self.viterbi(word)
            # a full table keeps what came first: frequent words are among it
            if self.held <= self.limit:
                self.seen[word] = found
                self.held += len(word) + ENTRY
        return found

    def words(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.crossing else re.findall(f"{MARK}+[^{MARK}]*", marked)

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        tokens, score = zip(*map(self.of, self.words(text)), strict=True)
        return sum(tokens), sum(score)


def count_tokens(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``n_tokens`` and ``best_score`` of each whole text."""
    keep = [c for c in df.columns if c not in (text, "n_tokens", "best_score")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("best_score", T.DoubleType())])
    where = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counter(model_matcher(model), bool(crossing_pieces(model)))
        for batch in batches:
            for part in slices(batch, where):
                tokens, scores = zip(*(known.count(x.as_py()) for x in part.column(where)), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:where], pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every row of ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), model_path())
