"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A token sequence is the one that merging makes exactly when each two adjacent
tokens, merged again from their characters, come out as the same two tokens.
So the encoder walks the text with Aho-Corasick longest matches, checks each new
token against its predecessor by re-merging the two (remembered for each pair),
tries the next shorter match when they don't fit, and steps back when none fits,
noting the position in a bitfield so that it's never entered again.

No piece of the usual vocabularies goes on after a word's end with a space or a
mark; where that holds (it's checked when a model is loaded), no merge crosses such
a place, words are encoded apart from one another and their results remembered.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strikeloom.llm.base import arrow_map, text_of

SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
NEVER = float("-inf")
NONE: dict[str, bool] = {}


def _fields(data: bytes) -> Iterable[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protobuf message (varint, 64-bit, bytes, 32-bit)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class MergeEncoder:
    """Encodes as ``SentencePieceProcessor.encode(text)`` does, without begin or end ids.

    ``model`` is the serialised model. Only merge-type models with the identity
    normaliser and byte fallback are taken, others raise ValueError. Ids of
    whole words are remembered for the latest ``memory`` words or up to twice as many.
    """

    def __init__(self, model: bytes, memory: int = 100_000):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        top = dict(_fields(model))
        trainer, normaliser = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("a merge-type model with byte fallback is needed")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("a model with the identity normaliser is needed")
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        p = self.processor
        size = p.get_piece_size()
        self.bytes_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in plain}
        self.score = {piece: p.get_score(i) for piece, i in self.ids.items()}
        self.fits: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.memory, self.known, self.older = memory, {}, {}
        ties = {}
        for piece, score in self.score.items():
            if len(piece) > 1:
                ties.setdefault(score, []).append(piece)
        #: Pieces whose score is another's too: which of them merges first depends on the place.
        self.tied = {x for group in ties.values() if len(group) > 1 for x in group}
        self.matcher = ahocorasick.Automaton()
        self.shorter: dict[str, str | None] = {}
        whole = {x for x in self.score if len(x) == 1 or self.merge(x) == [x]}
        for piece in whole:
            if len(piece) > 1:
                self.matcher.add_word(piece, len(piece))
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in whole), None)
        self.matcher.make_automaton()
        if any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.score):
            words = r"[\s\S]+"
        elif any(re.search(f"[{LATIN}][^{LATIN}]", x) for x in self.score):
            words = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        else:
            words = f"{SPACE}*[{LATIN}]+|{SPACE}*[^{SPACE}{LATIN}]+[{LATIN}]*|{SPACE}+"
        self.words = re.compile(words)
        self.odd = re.compile("|".join(map(re.escape, sorted({x[:2] for x in self.tied}))) or r"(?!)")

    def merge(self, text: str) -> list[str]:
        """The tokens of ``text`` by merging itself: best score first, then leftmost."""
        if len(text) > 40:
            return self.merge_long(text)
        parts, score = list(text), self.score.get
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > NEVER:
            i = pairs.index(best)
            both = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(both + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = score(parts[i - 1] + both, NEVER)
        return parts

    def merge_long(self, text: str) -> list[str]:
        """The same with a queue, for texts of any length."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, str, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.score.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-score, a, both, b))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, a, both, b = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in parts if x is not None]

    def compatible(self, a: str, b: str) -> bool:
        """True if re-merging the characters of both gives both again; remembered for each pair."""
        if self.pairs >= 2 * self.memory:
            self.fits.clear()
            self.pairs = 0
        self.pairs += 1
        known = self.fits.setdefault(a, {})[b] = self.merge(a + b) == [a, b]
        return known

    def backtrack(self, text: str) -> list[str]:
        """The tokens of ``text`` by longest matches, compatibility and stepping back."""
        size = len(text)
        ends = list(range(1, size + 1))
        for end, length in self.matcher.iter(text):  # longer matches of a start come later
            ends[end - length + 1] = end + 1
        shorter, fits, failed, at, tokens, last = self.shorter.get, self.fits.get, None, 0, [], ""
        end = ends[0] if size else 0
        while at < size:
            token: str | None = text[at:end]
            row = fits(last, NONE)
            while True:
                if not (failed and failed[end >> 3] >> (end & 7) & 1):
                    if not at:
                        break
                    fit = row.get(token)
                    if fit or fit is None and self.compatible(last, token):
                        break
                token = shorter(token)
                while token is None:  # nothing fits here: step back, and shorten the token before
                    failed = failed or bytearray(size // 8 + 1)  # one bit a position, once any has failed
                    failed[at >> 3] |= 1 << (at & 7)
                    token = tokens.pop()
                    at -= len(token)
                    last = tokens[-1] if tokens else ""
                    row = fits(last, NONE)
                    token = shorter(token)
                end = at + len(token)
            tokens.append(token)
            last, at = token, end
            end = ends[at] if at < size else at
        return tokens

    def ids_of(self, tokens: Iterable[str]) -> list[int]:
        out = []
        for token in tokens:
            if (i := self.ids.get(token)) is not None:
                out.append(i)
            else:
                out.extend(self.bytes_ids[b] for b in token.encode())
        return out

    def word(self, word: str) -> tuple[tuple[int, ...], str]:
        """Ids of a word (cut so that no merge crosses its ends), and the same as text."""
        if (known := self.older.get(word)) is None:
            ids = self.ids_of(self.merge(word) if self.odd.search(word) else self.backtrack(word))
            known = tuple(ids), ",".join(map(str, ids))
            if len(word) > 64:
                return known
        if len(self.known) >= self.memory:
            self.known, self.older = {}, self.known
        self.known[word] = known
        return known

    def encode_text(self, text: str) -> tuple[list[int], str]:
        """All ids of ``text``, and the same as decimals joined by commas."""
        if not text:
            return [], ""
        ids, said = [], []
        for word in self.words.findall(self.prefix + text.replace(" ", SPACE)):
            got = self.known.get(word) or self.word(word)
            ids += got[0]
            said.append(got[1])
        return ids, ",".join(said)

    def encode(self, text: str) -> list[int]:
        return self.encode_text(text)[0]

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


@functools.lru_cache(maxsize=1)
def encoder_of(model: bytes) -> MergeEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return MergeEncoder(model)


TOKENS = T.ArrayType(T.IntegerType())


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode whole texts; one row for each row of ``docs``.

    Columns: the id, ``ids`` (array, only if ``with_ids``), ``n_tokens``,
    ``ids_sha256`` (decimals joined by commas), ``decoded_sha256``, ``same_text``
    (decoding gives the text back). Null and empty texts have no ids and decode to
    an empty text; repeated rows stay repeated; other columns of ``docs``, of any
    name, are left out; an empty table gives an empty table. The model is read once
    on the driver (bounded by its file's size) and sent along with the task.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *([T.StructField("ids", TOKENS)] if with_ids else []), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("same_text", T.BooleanType())])

    def make():
        encoder = encoder_of(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            every, counts, digests, backs, same = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids, said = encoder.encode_text(text)
                back = encoder.decode(ids)
                every.append(ids if with_ids else None)
                counts.append(len(ids))
                digests.append(hashlib.sha256(said.encode()).hexdigest())
                backs.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            columns = [batch.column(0), *([pa.array(every, pa.list_(pa.int32()))] if with_ids else []), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string()), pa.array(same, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        return step

    return arrow_map(docs.select(id_col, text_of(text_col).alias("text")), make, schema, rows=200)
