"""Offset-preserving SentencePiece encoding and decoding.

The normaliser walks the model's compiled character map (a double-array trie of source strings and a
table of replacements) and takes the longest source string at each place; every normalised byte keeps
the source byte it came from.  Pieces cover the normalised bytes one after another, so the alignment
projects each piece to a byte span of the original text.

Segmentation is the library's.  Where no piece of the vocabulary holds a word mark behind another
character, pieces cannot cross the start of a word, so a very long text is the sum of parts cut there
and is segmented part by part, in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Characters of a text that the library segments at once, if it can be cut.
PART = 1 << 20


class CharacterMap:
    """A compiled character map: uint32 size of the trie, its units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.table = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.table = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest source string that begins here."""
        units, node, best = self.units, 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        size, place = best
        return size, self.table[place : self.table.index(b"\0", place)]


class Normaliser:
    """Normalised bytes of a text and the source byte of each of them."""

    def __init__(self, blob: bytes = b"", dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True, symbols: tuple[str, ...] = ()):
        self.map = CharacterMap(blob)
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        own = sorted((s.encode() for s in symbols), key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, own))) if own else None

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not self.map.units and not self.squeeze and self.symbols is None:
            return self._plain(text)
        out, align, lead = self._mapped(text)
        return self._spaces(out, align, len(text), lead if self.squeeze else 0)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(text, np.uint8)
        if not len(raw):
            return b"", np.zeros(1, np.int64)
        space = MARK_BYTES if self.escape else b" "
        size = np.where(raw == 0x20, len(space), 1)
        align = np.repeat(np.arange(len(raw)), size)
        if self.dummy_prefix:
            align = np.concatenate([np.zeros(len(space), np.int64), align])
        return (space if self.dummy_prefix else b"") + text.replace(b" ", space), np.append(align, len(raw))

    def _mapped(self, text: bytes) -> tuple[bytearray, list[int], int]:
        """Mapped bytes, the source byte of each, and the length of the source's leading blanks."""
        out, align, at, blanks, only = bytearray(), [], 0, 0, True
        while at < len(text):
            own = self.symbols.match(text, at) if self.symbols else None
            if own:
                size, new = own.end() - at, own.group()
            elif self.map.units and (hit := self.map.longest(text, at)):
                size, new = hit
            else:
                lead = text[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = text[at : at + size]
            out += new
            align += [at] * len(new)
            at += size
            only = only and new == b" "
            blanks = at if only else blanks
        return out, align, blanks

    def _spaces(self, text: bytearray, align: list[int], size: int, lead: int) -> tuple[bytes, np.ndarray]:
        a, z = 0, len(text)
        if self.squeeze:
            while a < z and text[a] == 0x20:
                a += 1
            while z > a and text[z - 1] == 0x20:
                z -= 1
        space = MARK_BYTES if self.escape else b" "
        out, back = bytearray(), []
        if z > a and self.dummy_prefix:
            out += space
            back += [lead] * len(space)
        for i in range(a, z):
            if text[i] == 0x20:
                if self.squeeze and i > a and text[i - 1] == 0x20:
                    continue
                out += space
                back += [align[i]] * len(space)
            else:
                out.append(text[i])
                back.append(align[i])
        return bytes(out), np.array([*back, align[z] if z < len(text) else size], np.int64)


class PieceEncoder:
    """ids and byte spans of whole texts, equal to the library's, without begin or end ids."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model_file, "rb") as f:
            blob = f.read()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        symbols = tuple(p.piece for p in spec.pieces if p.type == kinds.USER_DEFINED)
        rule = spec.normalizer_spec
        self.normalise = Normaliser(rule.precompiled_charsmap, rule.add_dummy_prefix, rule.remove_extra_whitespaces, rule.escape_whitespaces, symbols)
        self.sizes = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.unknown = next((i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN), -1)
        inner = re.compile(f"[^{MARK}]{MARK}")
        plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
        self.by_word = plain and not symbols and spec.trainer_spec.byte_fallback and not spec.trainer_spec.treat_whitespace_as_suffix and not any(inner.search(p.piece) for p in spec.pieces)
        self.edge = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")

    def pieces(self, text: str, part: int = PART) -> list[int]:
        """The library's ids.  A part begins behind a single space, for which the library's prefix stands in."""
        if len(text) <= part or not self.by_word:
            return self.library.encode(text) if text else []
        out, at = [], 0
        while at < len(text):
            cut = self.edge.search(text, at + part)
            out += self.library.encode(text[at : cut.start() if cut else len(text)])
            at = cut.end() if cut else len(text)
        return out

    def spans(self, text: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the original text, one for each piece; marks of a prefix are empty ranges."""
        if not ids:
            return (np.zeros(0, np.int64),) * 2
        norm, align = self.normalise(text)
        at = np.array(ids, np.int64)
        sizes = self.sizes[at]
        if self.unknown >= 0 and (at == self.unknown).any():
            own = self.library.encode(text.decode(), out_type=str)
            sizes = np.array([len(p.encode()) if i == self.unknown else s for p, i, s in zip(own, ids, sizes.tolist())])
        ends = np.cumsum(sizes)
        if ends[-1] != len(norm):
            return self._library_spans(text.decode())
        starts, stops = align[ends - sizes], align[ends]
        return starts, stops

    def _library_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The library's own offsets, for a text that it normalises in another way."""
        at = np.array([(p.begin, p.end) for p in self.library.encode(text, return_type="proto").pieces], np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 1]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_documents(docs: DataFrame, model_file: str, outputs: str = "arrays", id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Encode whole texts.

    ``outputs``: "arrays" gives doc_id, ids, starts, stops (a piece's bytes in the original text) and decoded;
    "digests" derives n_tokens, ids_sha256, decoded_sha256 and n_span_bytes (bytes of the original text that the spans
    cover) from the same arrays.  A null text counts as empty and has no pieces; ids may be null or repeat; other
    columns are ignored.
    """
    arrays = {"arrays": True, "digests": False}[outputs]
    schema = "doc_id long, ids array<int>, starts array<long>, stops array<long>, decoded string" if arrays else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long"

    def run(records):
        own = PieceEncoder(model_file)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for rec in records:
            out = []
            for t in rec.column(1).to_pylist():
                t = t or ""
                ids = own.pieces(t)
                starts, stops = own.spans(t.encode(), ids)
                text = own.decode(ids) if ids else ""
                if arrays:
                    out.append((ids, starts.tolist(), stops.tolist(), text))
                else:
                    out.append((len(ids), sha(str(ids)[1:-1].replace(" ", "")), sha(text), int((stops - starts).sum())))
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()] if arrays else [pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", "ids", "starts", "stops", "decoded"] if arrays else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_span_bytes"]
            yield pa.RecordBatch.from_arrays([rec.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds))], names=names)

    return c.select_documents(docs, id_name, text_name).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the library's text of ``ids`` (null: empty)."""

    def run(records):
        own = PieceEncoder(model_file)
        for rec in records:
            text = [own.decode(x) if x else "" for x in rec.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rec.column(0), pa.array(text, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
