"""Operator 7: token counts under a unigram vocabulary by dynamic programming over a shared trie.

The best segmentation of a pre-token has the greatest sum of piece scores. The distinct pre-tokens of a worker are put
into a trie by sorting them: neighbours share their longest common prefix, and the forward scores along a prefix are
computed once and kept for all words below it. The token count at the end of each word is stored with it, and documents
only add up stored counts.

Results: null and blank texts have no tokens; a character without a piece counts as its UTF-8 bytes (byte fallback);
among segmentations of equal score the one with the longest last piece is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gnosia.llm.common import map_texts
from gnosia.llm.textvec import sums

#: The mark before each word.
MARK = "▁"
#: Below the least score of any piece: the score of a character without one.
UNKNOWN_PENALTY = 10.0
#: Distinct pre-tokens remembered by a worker.
CACHE = 500_000


def pieces(path: str) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece file with log-probabilities by Zipf's law over their order in the file.

    Control, unknown and byte pieces are left out. The files' own scores are merge ranks, not probabilities; any other
    (piece, log-probability) list can be given to count_tokens().
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(plain))))
    return [(p, -math.log(r + 2.7) - norm) for r, p in enumerate(plain)]


class Counter:
    """Token counts of pre-tokens."""

    def __init__(self, table: Iterable[tuple[str, float]]) -> None:
        self.score = dict(table)
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Walk the trie of these words depth first; forward scores are kept for the prefix on the path."""
        best, count = [0.0], [0]
        path, get, longest, unknown, known = "", self.score.get, self.longest, self.unknown, self.known
        for word in sorted(words):
            w = MARK + word
            same, most = 0, min(len(w), len(path))
            while same < most and w[same] == path[same]:
                same += 1
            del best[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(w) + 1):
                c = w[end - 1]
                top, n = best[end - 1] + unknown, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))
                for at in range(max(0, end - longest), end):
                    s = get(w[at:end])
                    if s is not None and best[at] + s > top:
                        top, n = best[at] + s, count[at] + 1
                best.append(top)
                count.append(n)
            path = w
            known[word] = count[-1]

    def counts(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        new = {*words} - self.known.keys()
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


_counters: dict[int, Counter] = {}


def count_tokens(df: DataFrame, table: list[tuple[str, float]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words and n_tokens of every whole text. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def make():
        import re

        word = re.compile("[^\x20\x09-\x0d]+")
        key = hash(tuple(shared.value))
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        counter = _counters[key]

        def fn(texts: pa.Array) -> dict:
            split = [word.findall(x) for x in texts.to_pylist()]
            n = np.fromiter(map(len, split), np.int64, len(split))
            each = counter.counts([w for x in split for w in x])
            return {"n_words": n, "n_tokens": sums(each, np.concatenate([[0], np.cumsum(n)]))}

        fn.close = counter.known.clear
        return fn

    return map_texts(df, [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())], make, text, keep)
