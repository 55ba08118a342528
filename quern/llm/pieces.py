"""SentencePiece encoding and decoding in one pass of an Aho-Corasick automaton.

The automaton holds all pieces. At each position of a text its output links list the
pieces that end there, and each is tried behind the best segmentation up to its start:
a Viterbi pass over (score, last piece). For a unigram model the score of a piece adds
up. For a merge (BPE) model a piece may follow another one only where merging the two
together gives back the same two, and exactly one segmentation of every prefix has
nothing but such neighbours, so the pass keeps one last piece for each position.
Characters without a piece become their UTF-8 bytes.

No piece holds a word mark behind another character, so texts fall into units in front
of the marks; units repeat, and a worker remembers what it has encoded.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Units that a worker remembers, none longer than so many characters, and pairs of pieces
#: that it has tested; results do not depend on them.
MEMO_UNITS, MEMO_CHARS, MEMO_PAIRS = 1 << 19, 48, 1 << 19
#: As far below the worst piece as a character without a piece scores in unigram models.
UNKNOWN_PENALTY = 10.0
#: Rows that are encoded and handed on together.
ROWS = 1024
_UNKNOWN, _START = -2, -1


class _Memo(dict):
    """Unit -> the bytes of its ids; a miss encodes the unit."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        found = array("i", self.encode(unit)).tobytes()
        if len(unit) <= MEMO_CHARS:
            if len(self) >= MEMO_UNITS:
                self.clear()
            self[unit] = found
        return found


class Pieces:
    """The pieces of a model and their automaton; made once in each worker."""

    def __init__(self, model: bytes, viterbi: bool = False):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        sp = SentencePieceProcessor(model_proto=model)
        spec = proto.ModelProto.FromString(model)
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are can be decoded exactly")
        self.merging = spec.trainer_spec.model_type == proto.TrainerSpec.BPE and not viterbi
        self.prefix = MARK if spec.normalizer_spec.add_dummy_prefix else ""
        every = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i) for i in every]
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {i: sp.get_score(i) for i in plain}
        self.id = {self.text[i]: i for i in plain}
        self.rank = {self.text[i]: self.score[i] for i in plain}
        self.length = {i: len(self.text[i]) for i in plain}
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk_id = sp.unk_id()
        if not all(sp.is_byte(i) for i in self.byte):
            self.byte = []
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("a piece goes on behind a word mark")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.id if len(p) > 1))
        other = re.escape(MARK + alone)
        self.units = re.compile(f"{MARK}*[^{other}]+" + (f"|[{re.escape(alone)}]" if alone else "") + f"|{MARK}+")
        self.fits: dict[int, bool] = {}
        self.memo = _Memo(self.unit)
        self.bytes = [self._bytes(sp, i) for i in every]
        self.marked = {i for i in plain if self.text[i].startswith(MARK)}

    @cached_property
    def automaton(self):
        """All pieces as (id, length); decoding does without it."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for p, i in self.id.items():
            made.add_word(p, (i, len(p)))
        made.make_automaton()
        return made

    def _bytes(self, sp, i: int) -> bytes:
        if sp.is_byte(i):
            return bytes([int(self.text[i][3:5], 16)])
        if sp.is_control(i):
            return b""
        return " ⁇ ".encode() if sp.is_unknown(i) else self.text[i].replace(MARK, " ").encode()

    def merged(self, text: str) -> list[str]:
        """Neighbours merged by rank until none is left, as the two pieces of a test are."""
        parts, rank, none = list(text), self.rank.get, float("-inf")
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > none:
            at = pairs.index(best)  # the first of equals
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def follows(self, last: int, piece: int) -> bool:
        """Whether merging the two (or the piece alone) gives them back; remembered."""
        now = self.text[piece]
        before = [] if last < 0 else [self.text[last]]
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        ok = self.fits[last << 32 | piece] = self.merged("".join(before) + now) == [*before, now]
        return ok

    def _best(self, unit: str) -> list[int]:
        """The last piece of the best segmentation of each prefix, in one pass."""
        n, length = len(unit), self.length
        last, best = [_START, *[_UNKNOWN] * n], [0.0] * (n + 1)
        if self.merging:
            known, at = self.fits.get, -1
            for end, (piece, chars) in self.automaton.iter(unit):
                if end == at:  # this position has its piece
                    continue
                before = last[end + 1 - chars]
                fits = known(before << 32 | piece)
                if fits or fits is None and self.follows(before, piece):
                    last[end + 1] = piece
                    at = end
            return last
        # Unigram: positions in order, a character that is no piece relaxed as unknown.
        ends: list[list[int]] = [[] for _ in range(n)]
        for end, (piece, _) in self.automaton.iter(unit):
            ends[end].append(piece)
        for end, pieces in enumerate(ends):
            score, choice = float("-inf"), _UNKNOWN
            for piece in pieces:  # longest first, so a tie keeps the longest
                s = best[end + 1 - length[piece]] + self.score[piece]
                if s > score:
                    score, choice = s, piece
            if unit[end] not in self.id and best[end] + self.unknown > score:
                score, choice = best[end] + self.unknown, _UNKNOWN
            best[end + 1], last[end + 1] = score, choice
        return last

    def unit(self, unit: str) -> list[int]:
        last, at, out = self._best(unit), len(unit), []
        while at:
            piece = last[at]
            if piece == _UNKNOWN:
                at -= 1
                raw = unit[at].encode("utf-8", "surrogatepass")
                out += [self.byte[b] for b in reversed(raw)] if self.byte else [self.unk_id]
            else:
                at -= self.length[piece]
                out.append(piece)
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        units = self.units.findall(self.prefix + text.replace(" ", MARK))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, units)), np.int32)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        if self.prefix and ids and ids[0] in self.marked:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_made: dict[tuple[bytes, bool], Pieces] = {}


def _pieces(model: bytes, viterbi: bool = False) -> Pieces:
    if (model, viterbi) not in _made:
        _made.clear()
        _made[model, viterbi] = Pieces(model, viterbi)
    return _made[model, viterbi]


def _load(model: str | bytes) -> bytes:
    """The model's bytes: read once on the driver (about 0.5 MB) and sent with the tasks."""
    if isinstance(model, bytes):
        return model
    with open(model, "rb") as f:
        return f.read()


def encode(
    docs: DataFrame, model: str | bytes, *, text_col: str = "text", into: str = "pieces", decoded: str | None = None, viterbi: bool = False
) -> DataFrame:
    """All columns of ``docs`` plus ``into``, the piece ids of the whole text (array<int>), and
    where ``decoded`` names a column, the text that those ids decode to, in the same pass.

    For a unigram model the pass is Viterbi's: scores add up in 64 bits and ties keep the
    longer last piece. For a merge model no scores are added up, as they are ranks: the first
    piece that may follow the one before is kept, which gives the library's ids. ``viterbi``
    takes a merge model's pieces and scores as those of a unigram model.

    Null and empty texts have no pieces (an empty array). Repeated rows are encoded each; a
    very long text is one row of one task, unit by unit; an empty table gives an empty table;
    a column of ``docs`` named ``into`` is replaced, others may have any name.
    """
    model, docs = _load(model), docs.drop(into, *filter(None, [decoded]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, viterbi)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = [pieces.encode(t.as_py() or "") for t in batch.column(text_col)]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int64)
                lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))).cast(pa.list_(pa.int32()))
                made = {into: lists}
                if decoded:
                    made[decoded] = pa.array([pieces.decode(ids.tolist()) for ids in found], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], names=[*batch.schema.names, *made])
        pieces.memo.clear()  # an idle worker keeps no memory

    fields = [T.StructField(into, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def decode(df: DataFrame, model: str | bytes, *, pieces_col: str = "pieces", into: str = "decoded") -> DataFrame:
    """All columns of ``df`` plus ``into``: the text that the piece ids stand for.

    Gives back an encoded text, except that U+2581 in it becomes a space. Null ids count
    as none and give ``''``; ids outside the model are an error; bytes that are no UTF-8
    become U+FFFD. A column of ``df`` named ``into`` is replaced.
    """
    model, df = _load(model), df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            lists = batch.column(pieces_col).fill_null([])
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [pieces.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))
