"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each character; dynamic
programming keeps, per character, only the best score and the number of its pieces. Ties
follow the tokenizer: pieces that end at the same place are tried from the longest, and a later
one must score strictly more. A character that no single-character piece covers is unknown, at
the smallest score less 10; a run of unknown characters is one token.

Pieces never cross a word start (a space becomes the mark U+2581, a text that does not begin
with one gets one, and a mark only opens a piece), so each word is counted once per task and
then looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task keeps; when full, they are forgotten and counted anew.
KEPT_WORDS = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the vocabulary file's ordinary pieces without a mark beyond their first
    character. The file holds ranks; the score is the Zipf log-probability of the rank."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    kept = [p for p in dict.fromkeys(pieces) if p and MARK not in p[1:]]
    total = math.log(sum(1.0 / (r + 2) for r in range(len(kept))))
    return [(p, -math.log(r + 2) - total) for r, p in enumerate(kept)]


class Counter:
    """Viterbi counter of one process; ``count`` gives the tokens of a word."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.kept: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        n = len(word)
        found: list[list] = [[] for _ in range(n + 1)]
        for end, hit in self.automaton.iter(word):
            found[end + 1].append(hit)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, pieces, single = -math.inf, 0, False
            for length, s in found[end]:  # longest first
                start = end - length
                single = single or length == 1
                s += score[start]
                if s > best:
                    best, pieces = s, count[start] + 1
            if not single:
                s = score[end - 1] + self.unknown
                if s > best:
                    best, pieces = s, count[end - 1] + (not unknown[end - 1])
                    unknown[end] = True
            score[end], count[end] = best, pieces
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, kept = 0, self.kept
        marked = text.replace(" ", MARK)
        for word in (marked if marked[0] == MARK else MARK + marked).split(MARK)[1:]:
            n = kept.get(word)
            if n is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                n = self.viterbi(MARK + word)
                if len(word) < 64:
                    kept[word] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(unigram_pieces(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars (code points), n_tokens.

    Whole texts are counted, in batches, and nothing is shuffled. Defined cases: null and
    empty texts have 0 tokens; a word of any length is searched whole; repeated rows are
    counted each; no rows give no rows; other columns are not read. The vocabulary file must
    lie at the same path on every executor.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            chars, tokens = [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                chars.append(len(text))
                tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_chars", "n_tokens"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_chars long, n_tokens long")
