"""Exact merge-type (BPE) encoding by backtracking, and decoding, for sentencepiece models.

Merging in order of rank gives the one segmentation in which every two neighbours, re-merged on their
own, stay as they are. So an encoder may take the longest piece at each place, found for all places by
one Aho-Corasick pass, test it against its left neighbour by re-merging the two, try shorter pieces,
and step back; a bitfield holds the positions from which all pieces failed, as the tokens before a
position are determined by the text before it.

No piece holds a space mark after another character, so texts are cut before space marks, and around
characters that no longer piece holds; both cuts are checked against the vocabulary, and a model that
breaks the first is encoded as one chunk per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, small_batches

MARK = "▁"
MEMO_CHUNKS = 300_000
MEMO_PAIRS = 500_000


class PieceCodec:
    """Encoder and decoder of a BPE sentencepiece model with the identity normaliser."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        kinds = pb.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("only BPE models are merged by rank")
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unk = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        self.byte_fallback = spec.trainer_spec.byte_fallback
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self._decimals = [str(i) for i in range(len(self.pieces))]
        self._surfaces = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else " ⁇ ".encode() if i == self.unk else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.cuts_at_marks = not any(MARK in p.lstrip(MARK) for p in self.scores)
        joined = {c for p in self.scores if len(p) > 1 for c in p}
        self._lone = "\n" if "\n" not in joined and self.cuts_at_marks else ""
        self._fits: dict[tuple[str, str], bool] = {}
        # what merging can give at all, by what merging gives of each piece
        self.whole = {p for p in self.scores if self.merge(p) == [p]}
        self._found = ahocorasick.Automaton()
        for p in self.whole:
            self._found.add_word(p, len(p))
        self._found.make_automaton()
        self._new: dict[str, tuple[str, int, bytes]] = {}
        self._old: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, text: str) -> list[str]:
        """Merges by rank, the leftmost first among equals: the definition, for short texts."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two stay two when merged again."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > MEMO_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.merge(left + right) == [left, right]
        return known

    def split(self, chunk: str) -> list[str]:
        """The chunk's pieces, and single characters where the vocabulary has none."""
        if chunk in self.whole:
            return [chunk]
        n, known = len(chunk), self._fits
        starts: list[list[int]] = [[1] for _ in range(n)]
        for end, size in self._found.iter(chunk):
            if size > 1:
                starts[end - size + 1].append(size)  # in order of length
        failed: bytearray | None = None  # a bit for each place, made when one fails
        out: list[str] = []
        tried: list[int] = []  # how many of the sizes at each token's start are still untried
        at, left = 0, len(starts[0])
        while at < n:
            sizes, placed = starts[at], False
            while left:
                left -= 1
                to = at + sizes[left]
                piece = chunk[at:to]
                if (failed is None or not failed[to >> 3] >> (to & 7) & 1) and (not out or known.get((out[-1], piece)) or ((out[-1], piece) not in known and self.fits(out[-1], piece))):
                    out.append(piece)
                    tried.append(left)
                    at, placed = to, True
                    left = len(starts[at]) if at < n else 0
                    break
            if not placed:
                failed = failed or bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece, left = out.pop(), tried.pop()
                at -= len(piece)
        return out

    def _ids(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for p in pieces:
            i = self.id_of.get(p)
            if i is not None:
                ids.append(i)
            elif self.byte_fallback:
                ids.extend(self.byte_ids[b] for b in p.encode())
            elif not ids or ids[-1] != self.unk:  # neighbours without a piece make one unknown
                ids.append(self.unk)
        return ids

    def chunk(self, chunk: str) -> tuple[str, int, bytes]:
        """Decimal ids joined by commas, their number, and their bytes when decoded; memorised."""
        known = self._new.get(chunk)
        if known is None:
            known = self._old.get(chunk)
            if known is None:
                if self._lone and self._lone in chunk and len(chunk) > 1:
                    parts = [self.chunk(x) for x in re.split(f"({self._lone})", chunk) if x]
                    known = ",".join(x[0] for x in parts), sum(x[1] for x in parts), b"".join(x[2] for x in parts)
                else:
                    ids = self._ids(self.split(chunk))
                    decimals = self._decimals
                    known = ",".join([decimals[i] for i in ids]), len(ids), self._surface(ids)
            if len(self._new) >= MEMO_CHUNKS:
                self._old, self._new = self._new, {}
            self._new[chunk] = known
        return known

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = self.prefix + text.replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.cuts_at_marks else [marked]

    def encode(self, text: str) -> list[int]:
        """The ids that the library's ``encode`` gives, without begin or end ids."""
        if self.byte_fallback or not text:
            return [int(i) for c in self.chunks(text) for i in self.chunk(c)[0].split(",")]
        return self._ids([p for c in self.chunks(text) for p in self.split(c)])

    def _surface(self, ids: list[int]) -> bytes:
        surfaces = self._surfaces
        return b"".join([surfaces[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text that the library's ``decode`` gives; a byte that starts no character becomes U+FFFD."""
        out, run, first = [], bytearray(), True
        for i in [*ids, None]:
            if i is not None and not 0 <= i < len(self.pieces):
                raise IndexError(f"no piece has the id {i}")
            if i is not None and i in self.byte_of:
                run.append(self.byte_of[i])
                first = False
                continue
            if run:
                out.append(_characters(bytes(run)))
                run = bytearray()
            if i is None or i in self.silent:
                continue
            piece = " ⁇ " if i == self.unk else self.pieces[i]
            if first and self.prefix and piece.startswith(MARK):
                piece = piece[1:]
            first = False
            out.append(piece.replace(MARK, " "))
        return "".join(out)


def _characters(run: bytes) -> str:
    """UTF-8 as far as it is valid; U+FFFD for each byte that starts no character."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_codecs: dict[int, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec per Python worker and model."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def keyed_chunks(texts: pa.Array, of: PieceCodec) -> tuple[np.ndarray, pa.Array]:
    """Offsets of rows into the flat array of all texts' chunks."""
    if not of.cuts_at_marks or of.prefix != MARK:
        lists = [of.chunks(t) for t in texts.to_pylist()]
        return np.cumsum([0, *map(len, lists)]), pa.array([c for x in lists for c in x], pa.string())
    marked = pc.replace_substring(texts, " ", MARK)
    parts = pc.split_pattern(marked, MARK)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not empty.any():
        return offsets, pc.binary_join_element_wise(MARK, flat, "")
    # an empty part is a mark that belongs to the next part of the row, or to none if it is the last
    first = offsets[:-1]
    last = np.zeros(len(flat), bool)
    last[offsets[1:] - 1] = True
    blank_row = np.zeros(len(flat), bool)  # the empty text has no chunk
    texts_empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    blank_row[first[texts_empty]] = True
    keep = (~empty | last) & ~blank_row
    place = np.arange(len(flat))
    starts = np.zeros(len(flat), bool)
    starts[first] = True
    # marks of a kept part: itself and the dropped ones just before it in the row
    before = np.maximum.accumulate(np.where(keep, place, -1))
    before = np.concatenate([[-1], before[:-1]])
    row_start = np.maximum.accumulate(np.where(starts, place, 0))
    marks = place - np.maximum(before, row_start - 1)
    kept = np.flatnonzero(keep)
    m = marks[kept]
    chunks = pc.binary_join_element_wise(MARK, flat.take(pa.array(kept)), "")
    if (m > 1).any():
        py = chunks.to_pylist()
        for i in np.flatnonzero(m > 1):
            py[i] = MARK * int(m[i] - 1) + py[i]
        chunks = pa.array(py, pa.string())
    count = np.concatenate([[0], np.cumsum(keep)])
    return count[offsets], chunks


def encode_batch(texts: pa.Array, of: PieceCodec) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Per text: decimal ids joined by commas, their number, and the decoded text as bytes."""
    offsets, flat = keyed_chunks(texts, of)
    coded = flat.dictionary_encode()
    known = [of.chunk(c) for c in coded.dictionary.to_pylist()]
    at = pa.array(offsets, pa.int32())
    each = lambda k, t: pa.ListArray.from_arrays(at, pa.array([x[k] for x in known], t).take(coded.indices))
    sizes = np.fromiter((x[1] for x in known), np.int64, len(known))[coded.indices.to_numpy(zero_copy_only=False)]
    total = np.concatenate([[0], np.cumsum(sizes)])
    ids = pc.binary_join(each(0, pa.string()), ",")
    surface = pc.binary_join(each(2, pa.binary()), b"")
    return ids, total[offsets[1:]] - total[offsets[:-1]], surface


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of each row; ``ids`` in decimal, joined by commas.

    Whole texts, no begin or end ids. Null counts as the empty text, which has no ids and decodes to
    itself. A row per input row in any case; other columns are ignored. There is no shuffle: each
    worker memorises a bounded number of chunks and encodes the rest again.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(model)
        for batch in batches:
            for at, texts in slices(batch.column("_text")):
                ids, n, surface = encode_batch(texts, of)
                strip = len(of.prefix and " ")
                decoded = pa.array([s[strip:].decode() for s in surface.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(n), ids, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids string, decoded string")
