"""Token counts under a unigram vocabulary, without making the tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, id_text, table, vocabulary

SPACE = "▁"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in plain]


class Counter:
    """Number of pieces on the best path through a text.

    An Aho-Corasick automaton names every piece that ends at a character. Dynamic programming keeps
    for each position the best score and its number of pieces. Of equal scores the one whose last
    piece starts first wins (a later one must be strictly better), as in the public tokenizers. A
    character that no single piece covers may also be passed over as unknown, with the lowest score less a
    penalty, and then counts once for each of its UTF-8 bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        # Text may be cut before a space mark if no piece holds one after another character.
        self.divisible = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.memo = Memo(self.run, 600_000)

    def run(self, text: str) -> int:
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        by_end: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            by_end[end].append(match)
        for end in range(n):
            at = end + 1
            top = None
            for length, score in sorted(by_end[end], reverse=True):  # the longest starts first
                start = at - length
                total = best[start] + score
                if top is None or total > top:
                    top, pieces = total, count[start] + 1
            c = text[end]
            if c not in self.known:
                total = best[end] + self.unknown
                if top is None or total > top:
                    top, pieces = total, count[end] + len(c.encode("utf-8", "surrogatepass"))
            best[at], count[at] = top, pieces
        return count[n]

    def __call__(self, text: str) -> int:
        """Of a whole text: a space mark is put before it, spaces become space marks."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.divisible:
            return self.run(marked)
        # Runs of space marks belong to the word after them.
        if SPACE + SPACE in marked:
            words, run = [], ""
            for w in marked.split(SPACE)[1:]:
                run += SPACE
                if w:
                    words.append(run + w)
                    run = ""
            words += [run] if run else []
        else:
            words = marked.replace(SPACE, "\0" + SPACE).split("\0")[1:] if "\0" not in marked else [SPACE + w for w in marked.split(SPACE)[1:]]
        return sum(map(self.memo.__getitem__, words))


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(unigram_vocabulary(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Number of tokens of each whole text under the pieces and scores of `model`: doc_id, n_tokens.

    Words are cut at space marks, where no piece can cross, and each different word is solved once
    in each worker (the memo is bounded). Null and empty texts count 0. One row per input row, null
    keys and repeated rows included; other columns are ignored; an empty table gives no rows.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary(model))
        for batch in source:
            counts = pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def op2_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs).select("doc_id", F.col("n_tokens"))
