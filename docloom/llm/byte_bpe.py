"""Byte-level BPE encoding and decoding by a local rank file.

A long text is cut first where no match of the pattern can cross: before a space that follows a letter or a digit
and precedes something that is not white space. Each part is encoded by itself, which bounds the memory that the library needs,
and the ids are the same. Ids are decoded by looking up the bytes of each and joining them; the bytes of a single
id need not be valid UTF-8.

Long white space has no such boundary, and the pattern's engine overflows its stack on it. The pattern takes a run of it as one
match, but for the last character if anything follows, so such runs are found beforehand and merged directly. That, like the boundary,
holds for patterns whose other alternatives take no white space but one leading space.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_CHARS = 65_536
LONG_BLANKS = 1024
#: The characters of Unicode's White_Space property.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encode and decode by a rank file and the pattern that splits text before the merges."""

    def __init__(self, ranks: str, pattern: str, long_chars: int = LONG_CHARS):
        import regex
        import tiktoken

        table = load_ranks(ranks)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.whole = tiktoken.Encoding("runs", pat_str=r"\s+", mergeable_ranks=table, special_tokens={})
        self.pieces: list[bytes] = [b""] * (max(table.values(), default=-1) + 1)
        for piece, rank in table.items():
            self.pieces[rank] = piece
        self.safe = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[^\s\p{Z}])")
        self.blanks = re.compile(f"{_BLANK}{{{LONG_BLANKS},}}")
        self.long_chars = long_chars

    def parts(self, text: str) -> Iterator[str]:
        """Cuts of about ``long_chars`` characters at safe boundaries; longer only where there is no such boundary."""
        at = 0
        while len(text) - at > self.long_chars:
            found = self.safe.search(text, at + self.long_chars)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def matches(self, text: str) -> Iterator[list[int]]:
        """Ids of consecutive stretches of the text."""
        at = 0
        for run in self.blanks.finditer(text) if len(text) >= LONG_BLANKS else ():
            end = run.end() - (run.end() < len(text))
            for part in self.parts(text[at : run.start()]):
                yield self.encoding.encode_ordinary(part)
            yield self.whole.encode_ordinary(run.group()[: end - run.start()])
            at = end
        for part in self.parts(text[at:]):
            yield self.encoding.encode_ordinary(part)

    def encode(self, text: str) -> np.ndarray:
        made = [np.array(ids, np.uint32) for ids in self.matches(text)]
        return made[0] if len(made) == 1 else np.concatenate(made)

    def decode(self, ids: np.ndarray) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()])


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each row of ``docs``: its id, ``ids`` (if ``keep_ids``), n_tokens, ids_sha256, decoded_sha256.

    The last is the hash of the bytes that the ids decode to. Null texts count as empty: no ids, and the hash of
    nothing. Repeated rows and null ids are kept; other columns play no part.
    """
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(frame.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                every, n, hashes, decoded = [], [], [], []
                for text in some.column("text"):
                    ids = codec.encode(text.as_py() or "")
                    n.append(len(ids))
                    hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if keep_ids:
                        every.append(ids.astype(np.int32))
                out = {"id": some.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                if keep_ids:
                    out["ids"] = pa.array(every, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of ``encoded``: its id and ``bytes``, what the ids stand for. Null ids give null."""
    frame = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = dict(frame.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in batches:
            made = [None if x.as_py() is None else codec.decode(np.array(x.as_py(), np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "bytes"])

    return frame.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
