"""SentencePiece encoding and decoding with a forward table shared by common prefixes.

A marked word is a run of space marks and the characters up to the next mark; no piece
crosses from a character to a mark, so words are segmented one by one. The distinct words of a
batch are sorted, which visits their trie depth-first: the forward states of the prefix that a word shares with the one
before it stay on a stack, and only its new characters are worked out.

The forward state of a prefix is its best segmentation's last piece and score, the sum of its pieces' scores. The model at hand is of
the merging kind: of two neighbours that merging would have made one, no segmentation holds both. So a step from a prefix's last piece to a piece
that merging wouldn't leave beside it costs infinitely much, where every other step adds the piece's score; the merged form of the two
decides a step once and is remembered. Without those steps the largest sum is another segmentation than the library's; with them one
candidate is left, whose sum is the forward score.

Characters that are no piece become their bytes. Defined results: a null or empty text has
no ids; words of any length are handled; repeated rows give equal rows; a null doc_id stays null;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstat.llm.common import Remembered, text_or_empty

MARK = "▁"
#: Words whose ids a Python worker remembers, and neighbours.
REMEMBERED = 1_000_000
PAIRS = 500_000
ENCODED = "doc_id long, ids binary, decoded string"


class Model:
    """Pieces and scores of a model file of the merging kind with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        plain = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        self.ids = {library.id_to_piece(i): i for i in plain}
        self.score = {library.id_to_piece(i): library.get_score(i) for i in plain}
        self.byte = {int(library.id_to_piece(i)[3:5], 16): i for i in range(size) if library.is_byte(i)}
        self.raw = [b""] * size
        for piece, i in self.ids.items():
            self.raw[i] = piece.encode()
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) == 1 or self.merged(piece) == (piece,):
                ends.setdefault(piece[-1], set()).add(len(piece))
        self.ends = {c: sorted(n, reverse=True) for c, n in ends.items()}
        self.beside: dict[tuple[str, str], bool] = {}
        self.words = Remembered(REMEMBERED)

    def merged(self, text: str) -> tuple[str, ...]:
        """Merge the neighbours with the highest score, the leftmost of equals, until none can be."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return tuple(parts)
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, left: str, right: str) -> bool:
        known = self.beside.get((left, right))
        if known is None:
            known = self.beside[left, right] = self.merged(left + right) == (left, right)
        return known

    def learn(self, words: list[str]) -> None:
        """Ids of the distinct words, depth-first through the trie that their sorted order is."""
        if len(self.beside) > PAIRS:
            self.beside.clear()
        last: list[tuple[str, float]] = [("", 0.0)]  # last[n]: last piece and score of the best segmentation of the first n characters
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for n in range(shared + 1, len(word) + 1):
                last.append(self.extend(word, n, last))
            self.words[word] = self.walk(word, last)
            before = word

    def extend(self, word: str, n: int, last: list[tuple[str, float]]) -> tuple[str, float]:
        for size in self.ends.get(word[n - 1], ()):
            if size <= n and (piece := word[n - size : n]) in self.ids:
                left, score = last[n - size]
                if not left or left not in self.ids or self.fits(left, piece):
                    return piece, score + self.score[piece]
        return word[n - 1], last[n - 1][1]

    def walk(self, word: str, last: list[tuple[str, float]]) -> tuple[bytes, float]:
        out, n = [], len(word)
        while n:
            piece = last[n][0]
            i = self.ids.get(piece)
            out += [self.byte[b] for b in reversed(piece.encode())] if i is None else [i]
            n -= len(piece)
        return array("I", reversed(out)).tobytes(), last[-1][1]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def marked_words(text: str) -> list[str]:
    """The marked words of a text; a mark is put in front of the text."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return [MARK + w for w in text.split(" ")]
    return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK + text.replace(" ", MARK))


def encode(path: str, texts: list[str]) -> list[tuple[bytes, float]]:
    """Ids of each text as little-endian unsigned 32-bit integers, and their scores' sum; bytes score nothing."""
    m = model(path)
    split = [marked_words(text) for text in texts]
    m.learn(m.words.lacks(set().union(*split)))
    found = [list(map(m.words.__getitem__, words)) for words in split]
    return [(b"".join([ids for ids, _ in words]), sum([score for _, score in words])) for words in found]


def decode(path: str, ids: bytes) -> str:
    raw = b"".join(map(model(path).raw.__getitem__, array("I", ids)))
    text = raw.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode_column(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (binary, four little-endian bytes each) and the text that decoding them gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [ids for ids, _ in encode(model_path, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([decode(model_path, i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, ENCODED)


def digest_columns(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, ids_sha256, decoded_sha256, round_trip, score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(1).to_pylist()
                rows = []
                for text, (ids, score) in zip(texts, encode(model_path, texts)):
                    back = decode(model_path, ids)
                    rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text, score))
                n, crc, sha, decoded, same, scores = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(decoded), pa.array(same), pa.array(scores, pa.float64())],
                    names=["doc_id", "n_ids", "ids_crc32", "ids_sha256", "decoded_sha256", "round_trip", "score"],
                )

    schema = "doc_id long, n_ids long, ids_crc32 long, ids_sha256 string, decoded_sha256 string, round_trip boolean, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
