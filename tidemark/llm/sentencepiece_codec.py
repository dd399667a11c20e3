"""SentencePiece encoding and decoding through a table of distinct marked words.

The model replaces each space by a marker and puts one before the text. Where no piece holds a marker after another character,
merges never cross from one marked word (markers, then other characters) to the next, so each distinct marked word is segmented
once, by the library itself, and the ids are joined back by position. Each task keeps its own table and empties it when it has
reached a bound; words are then segmented anew. Models for which the condition fails are refused.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_batches, ragged

MARK = "▁"
#: Distinct marked words that a task keeps before it starts afresh.
TABLE_WORDS = 400_000
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    def __init__(self, model_path: str, most: int = TABLE_WORDS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bos, self.eos, self.most = self.sp.bos_id(), self.sp.eos_id(), most
        for i in range(self.sp.get_piece_size()):
            if MARK in self.sp.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece crosses a whitespace marker: words can't be segmented apart")
        if self.sp.piece_to_id(MARK) == self.sp.unk_id() or self.sp.encode("a  b ", out_type=str)[0][:1] != MARK or self.sp.decode(self.sp.encode("a  b ")) != "a  b ":
            raise ValueError("the model folds whitespace or adds no marker in front")
        self.clear()

    def clear(self) -> None:
        # a marker alone, as at the end of a text, is a piece; the library would put no marker before an empty text
        self.at: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.flat, self.size = [np.zeros(1, np.int64)], [np.ones(1, np.int64)], [np.array([self.sp.piece_to_id(MARK)], "<u4")], 1

    def add(self, words: list[str]) -> None:
        ids = self.sp.encode(words, num_threads=1)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), "<u4", int(lengths.sum()))
        for i, w in enumerate(words, len(self.at)):
            self.at[w] = i
        ends = np.cumsum(lengths) + self.size
        self.starts = [np.concatenate([*self.starts, ends - lengths])]
        self.lengths, self.flat = [np.concatenate([*self.lengths, lengths])], [np.concatenate([*self.flat, flat])]
        self.size += len(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with begin and end ids."""
        marked = [marked_words(t) for t in texts]
        if len(self.at) > self.most:
            self.clear()
        if new := list(dict.fromkeys(w for words in marked for w in words if w not in self.at)):
            self.add(new)
        starts, lengths, flat = self.starts[0], self.lengths[0], self.flat[0]
        out = []
        for words in marked:
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            ids = np.empty(int(lengths[at].sum()) + 2, "<u4")
            ids[0], ids[-1] = self.bos, self.eos
            ids[1:-1] = flat[ragged(starts[at], lengths[at])]
            out.append(ids)
        return out


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker, which the library puts back."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _MARKED.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


@cache
def table(model_path: str) -> ChunkTable:
    return ChunkTable(model_path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (binary: the ids as little-endian unsigned 32-bit integers, begin and end ids included) and decoded (string: the
    library's decode of those ids), for every row.

    Null text is empty (begin and end id only); repeated rows give repeated rows; other columns are left behind."""

    def each(batch: pa.RecordBatch) -> dict:
        t = table(model_path)
        ids = t.encode([x or "" for x in batch.column(1).to_pylist()])
        return {"doc_id": batch.column(0), "ids": [x.tobytes() for x in ids], "decoded": [t.sp.decode(x.tolist()) for x in ids]}

    return map_batches(documents(docs), each, "doc_id long, ids binary, decoded string")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids binary); null ids give null."""

    def each(batch: pa.RecordBatch) -> dict:
        sp = table(model_path).sp
        return {"doc_id": batch.column(0), "text": [None if x is None else sp.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(1).to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), each, "doc_id long, text string")
