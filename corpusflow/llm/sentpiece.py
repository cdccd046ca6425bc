"""SentencePiece encoding with byte offsets into the original text, and decoding.

Normalisation follows the model's own specification: at each place the longest key of the compiled character
map (a double-array trie with a table of replacements) is replaced, else one character is kept; white space is
escaped and the leading space added as the model asks. Every normalised byte remembers the original byte that it
came from. Pieces cover the normalised text in a row, so each projects to a span of original bytes.

The ids are the library's. Where the character map is empty and words stand apart plainly, a worker keeps the
ids of the words it has met (see wordcodec); every other text is encoded by the library whole.

Nulls: a null text is the empty text (begin and end id only); a null doc_id stays null. Very long texts are normalised and
encoded whole, in memory proportional to the text. Repeated rows give repeated results; an empty table none. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import read_table, text_of
from corpusflow.llm.wordcodec import WordCodec, _packed, tokenizer_path

SPACE = "▁"


def proto_fields(data: bytes):
    """(field number, value) pairs of a serialized protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """The compiled map: a little-endian length, the trie's 32-bit units, then zero-terminated replacements."""

    def __init__(self, compiled: bytes):
        n = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + n], "<u4").tolist()
        self.replacements = compiled[4 + n :]
        #: Bytes with which some key begins.
        self.leads = np.array([self._begins(byte) for byte in range(256)])

    def _begins(self, byte: int) -> bool:
        if not self.units:
            return False
        base = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6)
        return self.units[base ^ byte] & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts here, and its replacement."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        base = (unit >> 10) << ((unit & 512) >> 6)
        for length, byte in enumerate(data[at : at + 256], 1):  # longer than any key
            node = base ^ byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            base = node ^ ((unit >> 10) << ((unit & 512) >> 6))
            if unit & 256:
                value = self.units[base] & 0x7FFFFFFF
                found = length, value
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]


class Normalizer:
    """Text to normalised bytes with, for each of them and the end, the original byte offset.

    The longest key of the character map is looked for at every character with which one can begin; everything else is
    copied, and spaces are trimmed, escaped and aligned, in whole arrays.
    """

    def __init__(self, spec: bytes):
        fields = dict(proto_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(fields.get(k, 1)) for k in (3, 4, 5))

    def _mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after the character map, and the original offset of the character or key that each comes from."""
        raw = np.frombuffer(data, np.uint8)
        head = (raw & 0xC0) != 0x80
        heads = np.flatnonzero(head)
        origin = heads[np.cumsum(head) - 1] if len(raw) else np.zeros(0, np.int64)
        out, came, done = [], [], 0
        for at in np.flatnonzero(head & self.map.leads[raw]).tolist():
            if at >= done and (got := self.map.longest(data, at)):
                size, new = got
                out += [raw[done:at], np.frombuffer(new, np.uint8)]
                came += [origin[done:at], np.full(len(new), at)]
                done = at + size
        if not out:
            return raw, origin
        return np.concatenate([*out, raw[done:]]), np.concatenate([*came, origin[done:]])

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode("utf-8", "surrogatepass")
        own, origin = self._mapped(data)
        end = len(data)
        space = own == 32
        if self.trim:  # the first of a run of spaces stays, none at the ends
            kept = ~space
            kept[1:] |= space[1:] & ~space[:-1]
            solid = np.flatnonzero(~space)
            kept[: solid[0] if len(solid) else len(own)] = False
            if len(solid) and solid[-1] + 1 < len(own):
                end = int(origin[solid[-1] + 1])
                kept[solid[-1] + 1 :] = False
            own, origin, space = own[kept], origin[kept], space[kept]
        if self.dummy_prefix and len(own):
            own, origin, space = (np.concatenate([[first], x]) for first, x in ((32, own), (origin[0], origin), (True, space)))
        if self.escape and space.any():
            mark = np.frombuffer(SPACE.encode(), np.uint8)
            size = np.where(space, len(mark), 1)
            at = np.cumsum(size) - size
            wide = np.repeat(own, size).astype(np.uint8)
            for k, byte in enumerate(mark):
                wide[at[space] + k] = byte
            own, origin = wide, np.repeat(origin, size)
        return own.astype(np.uint8).tobytes(), np.append(origin, end).astype(np.int64)


class PieceCodec(WordCodec):
    """One model: ids, spans and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        spec = dict(proto_fields(sp.serialized_model_proto())).get(3, b"")
        self.normalizer = Normalizer(spec)
        self.bos, self.eos, self.mark = sp.bos_id(), sp.eos_id(), sp.piece_to_id(SPACE)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        # words are independent if no character is mapped, spaces stay, and spaces only ever begin a piece
        self.by_word = (
            not self.normalizer.map.units and self.normalizer.dummy_prefix and not self.normalizer.trim and self.normalizer.escape
            and all(SPACE not in p.lstrip(SPACE) and "\n" not in p for p in pieces) and not any(sp.is_unused(i) for i in range(len(pieces)))
        )
        self.normal_len = np.array([1 if sp.is_byte(i) else 0 if sp.is_control(i) else len(p.encode()) for i, p in enumerate(pieces)])

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text)) if text else b""

    def encode(self, text: str) -> bytes:
        return super().encode(text) if self.by_word and SPACE not in text else self.whole(text)

    def _word(self, word: str) -> bytes:
        ids = self.library.encode(word)
        if word[:1] != "\n":
            return _packed(ids)
        if ids[0] != self.mark:  # the leading space was not a piece of its own
            raise ValueError("a line feed merges with the space before it in this model")
        return _packed(ids[1:])

    def _first(self, word: str) -> bytes:
        return _packed(self.library.encode(word))

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, in bytes of the original text, of each id (without begin and end id): the text is normalised with
        alignment, pieces cover the normalised bytes in a row, and the alignment carries their edges back."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        normal, origin = self.normalizer(text)
        size = self.normal_len[ids]
        if (unk := ids == self.library.unk_id()).any():  # an unknown piece covers what its neighbours leave
            surface = [p.surface.encode() for p in self.library.encode_as_proto(text).pieces] if hasattr(self.library, "encode_as_proto") else []
            size = np.where(unk, [len(s.replace(b" ", SPACE.encode())) for s in surface] if len(surface) == len(ids) else 1, size)
        edge = np.concatenate([[0], np.cumsum(size)])
        if not unk.any() and edge[-1] != len(normal):
            raise ValueError(f"pieces of {edge[-1]} bytes do not cover a normalised text of {len(normal)}")
        edge = np.minimum(edge, len(normal))
        return origin[edge[:-1]], origin[edge[1:]]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def piece_codec(name_or_path: str) -> PieceCodec:
    """The codec of a model file, made once per worker."""
    return PieceCodec(tokenizer_path(name_or_path))


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", columns: tuple[str, ...] = ("ids", "starts", "ends", "decoded")) -> DataFrame:
    """One row per document: doc_id and the columns asked for, made batch by batch in one pass over the texts.

    ids (with begin and end id), starts and ends (original byte span of each id), decoded, n_tokens,
    ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256, spanned_bytes (bytes under some span).
    """
    kinds = {
        "ids": ("array<int>", pa.list_(pa.int32())), "starts": ("array<long>", pa.list_(pa.int64())), "ends": ("array<long>", pa.list_(pa.int64())),
        "decoded": ("string", pa.string()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
        "decoded_sha256": ("string", pa.string()), "spanned_bytes": ("long", pa.int64()),
    }

    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            out = {c: [] for c in columns}
            for text in text_of(batch.column(1)):
                inner = np.frombuffer(codec.encode(text), "<u4")
                ids = np.concatenate([[codec.bos], inner, [codec.eos]]).astype("<u4")
                if not {"starts", "ends", "spanned_bytes"}.isdisjoint(columns):
                    lo, hi = codec.spans(text, inner)
                    end = hi[-1] if len(hi) else 0
                    made = {"starts": np.concatenate([[0], lo, [end]]), "ends": np.concatenate([[0], hi, [end]]), "spanned_bytes": int((hi - lo).sum())}
                else:
                    made = {}
                if "decoded" in columns or "decoded_sha256" in columns:
                    made["decoded"] = codec.decode(ids)
                    made["decoded_sha256"] = hashlib.sha256(made["decoded"].encode()).hexdigest() if "decoded_sha256" in columns else None
                made |= {"ids": ids.astype(np.int32), "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest() if "ids_sha256" in columns else None}
                for c in columns:
                    out[c].append(made[c])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], kinds[c][1]) for c in columns)], ["doc_id", *columns])

    schema = ", ".join(["doc_id long", *(f"{c} {kinds[c][0]}" for c in columns)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and decoded from doc_id and ids; null ids give a null text."""

    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            texts = [None if ids is None else codec.library.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole document with spans, decode again, and return the digests."""
    return encode_pieces(read_table(spark, sf_dir, "documents"), columns=("n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes"))
