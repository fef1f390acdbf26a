"""Token counts of unigram tokenizers without building tokens.

An Aho-Corasick automaton names all vocabulary pieces that end at a character;
the Viterbi program over characters carries only the best score and the number
of pieces on that path.

Tie rules are those of the ``tokenizers`` library: scores are summed as
doubles from the left, a later candidate replaces an earlier one only if it is
strictly better, and candidates of one end come by increasing start, so the
longest piece wins a tie.  A character without a piece of its own may also be
unknown, at ten below the lowest score; unknown characters become their bytes
if the vocabulary has them, else neighbours fuse into one unknown piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.bpe import Remembered
from barloom.llm.common import narrow

SPACE = "▁"
UNKNOWN_PENALTY = 10.0

Vocab = list[tuple[str, float]]


def piece_vocab(path: str) -> Vocab:
    """(piece, score) of a ``sentencepiece`` model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocab: Vocab, unknown: int = 0) -> None:
        self.scores = [s for _, s in vocab]
        self.unknown_piece = vocab[unknown][0]
        self.unknown_score = min(self.scores) - UNKNOWN_PENALTY
        self.has_bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in vocab}
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocab):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        chars = {c for p, _ in vocab for c in p}
        #: No piece holds a line end, so the best path never crosses one.
        self.cut = "\n" not in chars and self.has_bytes
        self.word, self.chunk = Remembered(self.best), Remembered(self._chunk)

    def best(self, word: str) -> tuple[float, int]:
        """Score and piece count of the best path through ``word``."""
        n = len(word)
        score, count, from_, unk = [0.0] + [None] * n, [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        run = [0] * (n + 1)  # where the run of unknown pieces that ends here begins
        single, at = False, 1

        def close(end: int) -> None:
            if not single:
                got = score[end - 1] + self.unknown_score
                if score[end] is None or got > score[end]:
                    score[end], from_[end], unk[end] = got, end - 1, True
            before = from_[end]
            if not unk[end]:
                count[end] = count[before] + 1
                return
            run[end] = start = run[before] if unk[before] else before
            fused = word[start:end]
            count[end] = count[start] + (len(fused.encode("utf-8")) if self.has_bytes and fused not in self.automaton else 1)

        for end, (length, own, is_unknown) in self.automaton.iter(word):
            end += 1
            while at < end:
                close(at)
                at, single = at + 1, False
            got = score[end - length] + own
            if score[end] is None or got > score[end]:
                score[end], from_[end], unk[end] = got, end - length, is_unknown
            single |= length == 1
        while at <= n:
            close(at)
            at, single = at + 1, False
        return score[n], count[n]

    def _chunk(self, chunk: str) -> tuple[float, int]:
        if not self.cut or "\n" not in chunk or self.unknown_piece in chunk:
            return self.best(chunk)
        found = [self.word[w] for w in chunk.split("\n") if w]
        breaks = chunk.count("\n")
        return sum(x[0] for x in found) + breaks * self.unknown_score, sum(x[1] for x in found) + breaks

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = text.replace(" ", SPACE)
        words = text.split(SPACE)
        if not words[0]:
            del words[0]  # the text begins with a space: no other is put before it
        chunk = self.chunk
        found = [chunk[SPACE + w] for w in words]
        return sum([x[0] for x in found]), sum([x[1] for x in found])


_COUNTERS: dict[str, Counter] = {}


def counter(vocab: Vocab) -> Counter:
    key = hashlib.sha256(repr(vocab).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(vocab)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocab: Vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` (long), ``n_tokens`` (long) and ``score`` (double, the best path's) of every whole text.

    Spaces become the space mark, one is put before the text, and the text is
    cut before each mark.  Null texts count as empty (0 tokens, score 0).
    Null or repeated ids give one row per input row; further columns are
    dropped; an empty table gives an empty one.  The vocabulary (a bounded
    list, whatever the input) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for batch in batches:
            found = [own.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([float(s) for s, _ in found], pa.float64())],
                names=[id_col, "n_tokens", "score"],
            )

    return narrow(docs, **{id_col: "long", text_col: "string"}).mapInArrow(run, f"`{id_col}` long, n_tokens long, score double")
