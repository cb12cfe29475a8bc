"""Operator 6: token counts under a unigram model, by dynamic programming shared in a trie.

The distinct pre-tokens of a batch go into a trie; the forward scores of a position depend on the
prefix alone, so they are computed once for each trie node, not for each word. A terminal node keeps
the number of tokens of its word, and a document's count is the sum over its words.

The pieces are those of a vocabulary file; a piece's log probability follows its rank by Zipf's law.
A character that no piece covers counts as one token for each of its UTF-8 bytes. Of equally likely
segmentations the one with fewest tokens counts.

Defined results: a null or empty text has 0 words and 0 tokens; repeated rows are counted alike; extra
columns pass through `count_tokens`.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citeloom.llm.common import utf8

START = "▁"
UNKNOWN = -25.0
MOST = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    """Piece scores, a trie of the words seen and their token counts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        total = math.log(sum(1 / (r + 2) for r in range(len(plain))))
        self.score = {p: -math.log(r + 2) - total for r, p in enumerate(plain)}
        self.longest = max(map(len, plain))
        self.terminal: dict[bytes, int] = {}

    def step(self, text: str, best: list[float], count: list[int], i: int) -> None:
        """Forward score and token count of the prefix text[:i]."""
        score, top, fewest = self.score, -math.inf, 0
        for j in range(max(0, i - self.longest), i):
            s = score.get(text[j:i])
            if s is not None:
                s += best[j]
                if s > top or s == top and count[j] + 1 < fewest:
                    top, fewest = s, count[j] + 1
        n = len(text[i - 1].encode("utf-8", "replace"))
        s = best[i - 1] + UNKNOWN * n
        if s > top:
            top, fewest = s, count[i - 1] + n
        best.append(top)
        count.append(fewest)

    def learn(self, tokens: set[bytes]) -> None:
        """Insert words: in sorted order a depth-first walk of their trie, whose path holds the scores."""
        new = [w for w in tokens if w not in self.terminal]
        if len(self.terminal) + len(new) > MOST:
            self.terminal.clear()
            new = list(tokens)
        before, best, count = "", [0.0], [0]
        for word, key in sorted((START + w.decode("utf-8", "replace"), w) for w in new):
            n = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                n += 1
            del best[n + 1 :], count[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                self.step(word, best, count, i)
            self.terminal[key] = count[-1]
            before = word


_models: dict[str, Unigram] = {}


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs without its text, with n_words and n_tokens (columns of these names are replaced)."""
    path = vocabulary or default_vocabulary()
    keep = [c for c in docs.columns if c not in ("text", "n_words", "n_tokens")]

    def run(batches):
        if path not in _models:
            _models[path] = Unigram(path)
        model = _models[path]
        for batch in batches:
            split = [x.split() if x else [] for x in utf8(batch.column("text"))]
            n_tokens: list[int] = []
            while len(n_tokens) < len(split):
                stop, fresh = len(n_tokens), set()
                while stop < len(split) and len(fresh) < MOST // 4:
                    fresh.update(split[stop])
                    stop += 1
                model.learn(fresh)
                n_tokens += [sum(map(model.terminal.__getitem__, w)) for w in split[len(n_tokens) : stop]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([len(w) for w in split], pa.int64()), pa.array(n_tokens, pa.int64())], names=[*keep, "n_words", "n_tokens"])

    schema = T.StructType([docs.schema[c] for c in keep]).add("n_words", "long").add("n_tokens", "long")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"))
