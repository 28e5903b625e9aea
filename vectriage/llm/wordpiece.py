"""Token counts: how many word pieces greedy longest-match would make of a text, without making them.

A trie holds the pieces that begin a word and, below a node of its own, those that continue one. Each node has a failure
link and the number of pieces that are popped on the way there, both worked out beforehand, so that a word costs time in
proportion to its length whatever the vocabulary: the automaton reads each character once and adds popped counts.

A word is a maximal run of characters that aren't white space (str.split). A word that can't be made of pieces counts as
one unknown piece. Counts of words up to MEMO_CHARS characters are remembered, MEMO_WORDS at most in a worker.

Defined results: null and empty texts, and texts of white space, count 0. Rows are independent, so repeats and ties need
no rule. A computed column replaces an input column of the same name. An empty vocabulary makes each word unknown.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, string_columns, texts

MEMO_WORDS, MEMO_CHARS = 1 << 19, 64
_MATCHERS: dict = {}


class Matcher(dict):
    """Number of pieces of a word. Works as a mapping from words, which remembers short ones."""

    def __init__(self, begin: list[str], follow: list[str]):
        super().__init__()
        # node 0 begins a word, node 1 continues one
        goto: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, begin), (1, follow)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in goto[node]:
                        goto[node][c] = len(goto)
                        goto.append({})
                        final.append(False)
                    node = goto[node][c]
                final[node] |= node > 1
        fail, popped = [-1] * len(goto), [0] * len(goto)
        queue = [0, 1]
        for u in queue:
            for c, v in goto[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], popped[v] = 1, 1
                    continue
                z, n = fail[u], popped[u]
                while z >= 0 and c not in goto[z]:
                    z, n = fail[z], n + popped[z]
                if z >= 0:
                    fail[v], popped[v] = goto[z][c], n
        self.goto, self.fail, self.popped = goto, fail, popped

    def count(self, word: str) -> int:
        goto, fail, popped = self.goto, self.fail, self.popped
        node, n = 0, 0
        for c in word:
            while c not in goto[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = goto[node][c]
        while node > 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


def pieces_of(model_path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece vocabulary that begin a word, and those that continue one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    mark = "▁"
    return [p[1:] for p in plain if p.startswith(mark) and len(p) > 1 and mark not in p[1:]], [p for p in plain if mark not in p]


def matcher(model_path: str) -> Matcher:
    if model_path not in _MATCHERS:
        _MATCHERS[model_path] = Matcher(*pieces_of(model_path))
    return _MATCHERS[model_path]


def count_tokens(df: DataFrame, model_path: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """df with the number of word pieces of text."""
    string_columns(df, text)
    bounded_batches(df)
    schema = T.StructType([f for f in df.schema if f.name != count] + [T.StructField(count, T.LongType())])
    keep = schema.names[:-1]

    def run(batches):
        of_word = matcher(model_path).__getitem__
        for batch in batches:
            found = [sum(map(of_word, x.split())) for x in texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(found, pa.int64())], schema.names)

    return df.mapInArrow(run, schema)
