"""Token counts by rank-synchronous merging.

Counts the tokens of a sentencepiece byte-pair model without calling its encoder. No piece
of such a model goes on from another character to a blank mark, so a text falls into
pre-tokens (a run of blanks and what follows up to the next blank) that never merge with
each other. The distinct new pre-tokens of a batch are held as one ragged array of
symbols; in each round every pre-token merges its pair of the lowest rank, all at the same
time, and what survives is counted. A character that the model doesn't have counts its
bytes. Each worker remembers the counts of a bounded number of pre-tokens.

Texts are independent: nothing is shuffled, and about 1 MB is worked on at a time. Null
text is empty and has no tokens; texts of any length are counted whole; repeated rows get
equal counts; an empty table stays empty; other columns are kept unless named like a result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textveil.llm.bpe_arrays import PairTable, Remembered, merge
from textveil.llm.hashes import ONE
from textveil.llm.shared import flat, slices

BLANK = "▁"


class PieceModel:
    """Symbols, merges and counts of a sentencepiece byte-pair model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model without normalisation is needed")
        self.prefix = spec.add_dummy_prefix
        pieces = [(p.piece, p.score) for p in proto.pieces if p.type == 1]
        if any(p.type in (4, 5) for p in proto.pieces) or any(BLANK in p.lstrip(BLANK) for p, _ in pieces):
            raise ValueError("the model has pieces that go beyond a pre-token")
        number = {p: i for i, (p, _) in enumerate(pieces)}
        rank = np.empty(len(pieces), np.int64)
        rank[np.argsort([-s for _, s in pieces], kind="stable")] = np.arange(len(pieces))
        byte_fallback = proto.trainer_spec.byte_fallback
        self.cost = [1] * len(pieces)
        for char in sorted({c for p, _ in pieces for c in p} - set(number)):
            number[char] = len(self.cost)
            self.cost.append(len(char.encode()) if byte_fallback else 1)
        #: Symbols of characters that no piece has, by their bytes.
        self.other = len(self.cost) - 1
        self.cost = np.array(self.cost + [k if byte_fallback else 1 for k in (1, 2, 3, 4)])
        self.symbol = np.zeros(0x110000, np.int32)
        for low, high, size in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.symbol[low:high] = self.other + size
        rows = []
        for piece, own in number.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = own
            for cut in range(1, len(piece)):
                first, second = number.get(piece[:cut]), number.get(piece[cut:])
                if first is not None and second is not None:
                    rows.append((first, second, rank[own], own))
        self.symbol[0x20] = self.symbol[ord(BLANK)]
        self.pairs = PairTable(*np.array(rows, np.int64).T)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token, blanks as U+0020."""
        points = np.frombuffer(b"".join(words).decode().encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w.decode()) for w in words], np.int64)
        symbols, word = merge(self.symbol[points], np.repeat(np.arange(len(words)), sizes), self.pairs)
        return np.bincount(word, self.cost[symbols], len(words)).astype(np.int64)


_MODELS: dict[str, tuple[PieceModel, Remembered]] = {}


def _model(path: str) -> tuple[PieceModel, Remembered]:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path), Remembered()
    return _MODELS[path]


def count_texts(column: pa.Array, model: PieceModel, seen: Remembered) -> np.ndarray:
    """Tokens of each text."""
    texts = pc.replace_substring(column.fill_null(""), BLANK, " ")
    if model.prefix:
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    data, at = flat(texts)
    if not len(data):
        return np.zeros(len(column), np.int64)
    blank = data == 0x20
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[at[:-1][at[:-1] < len(data)]] = True
    begin = np.flatnonzero(begin)
    end = np.append(begin[1:], len(data))
    names, which, inverse = np.unique(ONE.ranges(ONE.sums(data), begin, end), return_index=True, return_inverse=True)
    raw = data.tobytes()

    def work(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [raw[begin[i] : end[i]] for i in which[new]]
        return model.count(words), np.ones(len(new), np.int64)

    spot = seen.get(names, work)
    counts = seen.values[seen.at[spot]][inverse]
    return np.diff(np.append(0, np.cumsum(counts))[np.searchsorted(begin, at)])


def _scan(path: str, text_col: str, keep: list[str], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = _model(path)
        for batch in slices(batches, text_col):
            text = batch.column(text_col)
            _, at = flat(text)
            columns = [batch.column(c) for c in keep]
            columns += [pa.array(np.diff(at)), pa.array(count_texts(text, model, seen))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` of the model at ``path`` and ``over_limit``."""
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit") or c == text_col]
    source = docs.select(*[f"`{c}`" for c in keep])
    schema = StructType(list(source.schema.fields) + list(StructType.fromDDL("n_bytes long, n_tokens long").fields))
    counted = source.mapInArrow(_scan(path, text_col, keep, to_arrow_schema(schema)), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
