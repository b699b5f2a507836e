"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece there is exactly one token that can come last in its encoding. It is found
from shorter prefixes: a token that ends there is the one when the pair made of the last token before
it and the token itself stays as it is under the merges. The stored last tokens give the encoding of every
prefix, allow exact appends, and stay valid before an edit.

Cases: a null text is empty and gives no ids; texts of any length are encoded whole; repeated rows are
encoded each; an empty table gives an empty one; input columns named like the new ones are replaced.
Ids that the vocabulary lacks raise on decoding.
"""

from __future__ import annotations

import base64
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tableprep.llm.arrow import add_columns, bounded_batches, packed, tidy

#: Encoded pieces (of late, and as many before) and tested pairs that a worker remembers; beyond that it forgets and goes on.
REMEMBERED, REMEMBERED_PAIRS = 150_000, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file with one ``base64 rank`` a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes pieces of bytes; shares what it learns about tokens between them."""

    def __init__(self, ranks: dict[bytes, int], remembered_pairs: int = REMEMBERED_PAIRS):
        self.ranks, self.remembered_pairs = ranks, remembered_pairs
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: How long a token can be that ends in these three bytes.
        self.tails: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 2 and len(token) > self.tails.get(token[-3:], 0):
                self.tails[token[-3:]] = len(token)
        #: Whether the merges leave a token as it is after another; by both ranks, -1 for nothing before.
        self.pairs: dict[int, bool] = {}
        #: The two tokens that a token's last merge joins; None for single bytes. Only of tokens that ``_halves_of`` was asked for.
        self.halves: dict[int, tuple[int, int] | None] = {}

    def merges(self, data: bytes, below: int = 1 << 62) -> list[bytes]:
        """The definition: merge the adjacent pair of lowest rank until none (of a rank lower than ``below``) is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, at = min(ranked)
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves_of(self, token: int) -> tuple[int, int] | None:
        """What the last merge of a token joins. Raises ``KeyError`` if merges do not make the token, or not from tokens of lower rank."""
        if token not in self.halves:
            data, found = self.tokens[token], None
            if len(data) > 1:
                # Without its own rank the merges stop one step short.
                parts = self.merges(data, below=token)
                ranks = [self.ranks[p] for p in parts]
                if len(parts) != 2 or max(ranks) > token or not all(map(self._whole, ranks)):
                    raise KeyError(token)
                found = ranks[0], ranks[1]
            self.halves[token] = found
        return self.halves[token]

    def _whole(self, token: int) -> bool:
        """Whether the merges of a token's bytes give the token."""
        known = self.pairs.get(-1 << 32 | token)
        return self.stays(-1, token) if known is None else known

    def stays(self, before: int, token: int) -> bool:
        """Whether the merges of both tokens' bytes give exactly these two (or one, if nothing comes before)."""
        if len(self.pairs) > self.remembered_pairs:
            self.pairs.clear()
        try:
            known = self._apart(before, token) if before >= 0 and self._whole(before) and self._whole(token) else None
        except KeyError:
            known = None
        if known is None:
            second = self.tokens[token]
            first = [self.tokens[before]] if before >= 0 else []
            known = self.merges(b"".join(first) + second) == [*first, second]
        self.pairs[before << 32 | token] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge joins what stands at the border of two tokens, from the end of their merges back to the beginning.

        ``left`` and ``right`` always are the tokens at the border. Of the two the one that was made later is taken
        apart: the one of higher rank, of one rank the right one, since the merges go from left to right. A merge over the border
        would come first if its rank is below that of the merge that ended each of the two.
        """
        rank_of, tokens, halves = self.ranks.get, self.tokens, self.halves
        end_left = end_right = 1 << 62
        while True:
            across = rank_of(tokens[left] + tokens[right])
            if across is not None and across < end_left and across <= end_right:
                return False
            parts = halves[left] if left in halves else self._halves_of(left)
            others = halves[right] if right in halves else self._halves_of(right)
            if parts is not None and (others is None or left > right):
                end_left, left = left, parts[1]
            elif others is not None:
                end_right, right = right, others[0]
            else:
                return True

    def extend(self, data: bytes, last: list[int], until=None) -> None:
        """Fill in ``last``, the rank of the last token of each prefix, up to the length of ``data``.

        ``last`` begins with -1 for the empty prefix. ``until(end)`` may end it early.
        """
        rank_of, pairs, tail = self.ranks.get, self.pairs, self.tails.get
        for end in range(len(last), len(data) + 1):
            most = tail(data[end - 3 : end], 2) if end > 2 else end
            for begin in range(end - most if end > most else 0, end):
                token = rank_of(data[begin:end])
                if token is None:
                    continue
                before = last[begin]
                known = pairs.get(before << 32 | token)
                if known or known is None and self.stays(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}: the vocabulary lacks a single byte")
            if until is not None and until(end):
                return

    def path(self, last: list[int]) -> list[int]:
        """The tokens of the longest prefix, from the last one backwards."""
        found, end = [], len(last) - 1
        while end:
            found.append(last[end])
            end -= len(self.tokens[last[end]])
        return found[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece; one that is a token as a whole is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        last = [-1]
        self.extend(piece, last)
        return self.path(last)


class EditableText:
    """A byte string under merges alone (no split into pieces) that can be appended to and edited."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from ``start`` to ``stop``; the number of prefixes worked out anew.

        Prefixes up to ``start`` keep their last token. After the edit, once as many last tokens
        in a row as a token can have bytes are the old ones, so are all that follow.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same = 0

        def settled(end: int) -> bool:
            nonlocal same
            at = end - shift
            same = same + 1 if end > start + len(new) and at < len(old) and old[at] == self.last[end] else 0
            return same >= self.encoder.longest

        self.encoder.extend(self.data, self.last, settled)
        done = len(self.last) - 1 - start
        self.last += old[len(self.last) - shift :]
        return done

    def ids(self) -> list[int]:
        return self.encoder.path(self.last)


class Pieces:
    """Packed ids of pieces, by their text; remembers those of the last texts."""

    def __init__(self, encoder: PrefixEncoder, remembered: int = REMEMBERED):
        self.encoder, self.remembered = encoder, remembered
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode_all(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of texts that are given as their pieces."""
        if len(self.known) > self.remembered:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set().union(*texts).difference(known)
        for piece in [p for p in new if p in before]:
            known[piece] = before[piece]
            new.discard(piece)
        # In order, a piece begins like the one before it, and what is stored for that beginning holds for both.
        last, data = [-1], b""
        for piece, own in sorted((p.encode("utf-8"), p) for p in new):
            if piece in self.encoder.ranks:
                ids = [self.encoder.ranks[piece]]
            else:
                same, most = 0, min(len(piece), len(data))
                while same < most and piece[same] == data[same]:
                    same += 1
                del last[same + 1 :]
                self.encoder.extend(piece, last)
                data, ids = piece, self.encoder.path(last)
            known[own] = array("I", ids).tobytes()
        packed_ids = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
        for piece in new:
            if len(piece) > 64:  # long pieces hardly come again
                del known[piece]
        return packed_ids


_LEARNT: dict[str, Pieces] = {}


class Decoder:
    """The bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known = np.array([bool(token) for token in self.tokens], bool)

    def decode(self, packed_ids: bytes) -> bytes:
        ids = np.frombuffer(packed_ids, "<u4")
        if ids.size and (ids.max() >= len(self.tokens) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", remembered: int = REMEMBERED,
    remembered_pairs: int = REMEMBERED_PAIRS, verify: bool = False, with_decoded: bool = False,
) -> DataFrame:
    """``docs`` with ``token_ids`` (little-endian unsigned 32-bit integers, packed) and ``n_tokens``.

    Each match of ``pattern`` is encoded by itself. The ranks are sent to each executor once: their
    size is that of the vocabulary. ``verify`` adds ``round_trip``, whether the decoded ids are the text's bytes; ``with_decoded`` adds
    these bytes as ``decoded``, as :func:`decode` does in a pass of its own. What a worker
    remembers costs it about 250 bytes a piece and 150 a pair.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = uuid.uuid4().hex

    def start():
        if key not in _LEARNT:  # a worker process keeps what it has learnt for its next task
            _LEARNT.clear()
            _LEARNT[key] = Pieces(PrefixEncoder(shared.value, remembered_pairs), remembered)
        pieces, split = _LEARNT[key], regex.compile(pattern).findall
        decoder = Decoder(shared.value) if verify or with_decoded else None

        def work(part: pa.RecordBatch):
            texts = part.column(0).to_pylist()
            ids = pieces.encode_all([split(text) if text else [] for text in texts])
            made = {"token_ids": packed(ids), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            if with_decoded:
                made["decoded"] = packed([decoder.decode(x) for x in ids])
            if verify:
                made["round_trip"] = pa.array([decoder.decode(x) == (t or "").encode("utf-8") for x, t in zip(ids, texts)], pa.bool_())
            return made

        return work

    return add_columns(docs, text_col, "token_ids binary, n_tokens bigint" + ", round_trip boolean" * verify + ", decoded binary" * with_decoded, start)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its packed ids; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = [f for f in encoded.schema.fields if f.name.lower() != "decoded"]
    where = next(i for i, f in enumerate(schema) if f.name.lower() == ids_col.lower())
    names = [f.name for f in schema]

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [decoder.decode(value.as_py() or b"") for value in part.column(where)]
                yield pa.RecordBatch.from_arrays([*part.columns, packed(found)], [*names, "decoded"])

    taken = encoded.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)))
    bounded_batches(encoded.sparkSession)
    return taken.mapInArrow(tidy(run), StructType([*schema, StructField("decoded", BinaryType())]))
