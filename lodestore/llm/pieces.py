"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with a score-ordered agenda.

A text's symbols start as characters. An agenda holds the adjacent pairs whose concatenation is
in the vocabulary, ordered by score (best first), then from left to right; the best pair merges
and its new neighbours join the agenda. Characters outside the vocabulary become byte pieces,
or the unknown piece where there are none.

A merge can only join two characters that stand side by side in some piece, so a text falls
apart, exactly, at every other pair of neighbours; equal parts are encoded once per worker and
kept, and the agendas of all new short parts of some texts run side by side in numpy. The sentencepiece library also encodes each whole text, and `checked` says for each row
whether its ids are the library's. The vocabulary file's path is a parameter; it is read
where the worker runs.

Defined results: a null text has null ids and counts; an empty text has no pieces; the
vocabulary's space symbol in a text counts as a space, as in the library; repeated rows are each
encoded; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import string
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hold, slices, trim

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Parts of a generation that a worker keeps; beyond that the last one goes but for what was used since. It bounds memory and changes no result.
KEEP = 350_000
#: Characters of a part up to which a list is a faster agenda than a heap.
SHORT = 32
#: Agendas that run side by side; it bounds memory and changes no result.
BATCH = 1 << 14


def _fields(data: bytes):
    """(number, wire type, value) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key = shift = 0
        while True:
            b = data[at]
            at += 1
            key |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        kind = key & 7
        if kind == 0:
            value = shift = 0
            while True:
                b = data[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
        else:
            if kind == 2:
                n = shift = 0
                while True:
                    b = data[at]
                    at += 1
                    n |= (b & 127) << shift
                    shift += 7
                    if b < 128:
                        break
            else:
                n = {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield key >> 3, kind, value


NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


_NONE = math.inf


class Vocabulary:
    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        kind_of_model, self.dummy_prefix, squeeze, escape, charsmap = 1, True, True, True, b""
        for number, _, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                kind_of_model = next((v for n, _, v in _fields(value) if n == 3), 1)
            elif number == 3:
                for n, _, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        squeeze = bool(v)
                    elif n == 5:
                        escape = bool(v)
        if kind_of_model != 2 or charsmap or squeeze or not escape:
            raise ValueError("only merge-type vocabularies with the identity normaliser are supported")
        if {USER, UNUSED} & set(self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.cost = {p: -self.scores[i] for p, i in self.ids.items()}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.spaced = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: characters that no piece joins to anything
        joined = {c for two in self.neighbours for c in two}
        self.alone = {chr(c) for c in range(128) if chr(c) not in joined}

    def agenda(self, part: str) -> list[int]:
        """Ids of the pieces of a part whose spaces are symbols already."""
        found = self.merged(part) if len(part) > SHORT else self.merged_short(part)
        try:
            return [self.ids[s] for s in found]
        except KeyError:  # a character that is no piece
            ids = []
            for s in found:
                i = self.ids.get(s)
                ids += [i] if i is not None else [self.bytes[b] for b in s.encode("utf-8", "replace")] if self.bytes else [self.unknown]
            return ids

    def _tables(self) -> None:
        """For agendas in numpy: each character's piece, the piece that two pieces make, and each piece's place by score."""
        ids, n = self.ids, len(self.pieces)
        self.of_char = np.full(0x110001, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        made = [(left * n + right, i) for p, i in ids.items() for k in range(1, len(p)) if (left := ids.get(p[:k])) is not None and (right := ids.get(p[k:])) is not None]
        self.pairs = pd.Index(np.array([x for x, _ in made], np.int64))
        self.made = np.array([*(i for _, i in made), -1], np.int32)
        self.place = np.unique([*(-x for x in self.scores), _NONE], return_inverse=True)[1].astype(np.int64) << 32  # equal scores have one place; that of no piece is the last

    def agendas(self, parts: list[str]) -> list[bytes | None]:
        """Ids of each part's pieces, as agenda() has them; none for a part with a character that is no piece. The parts aren't empty."""
        if not hasattr(self, "pairs"):
            self._tables()
        made, place, pairs, width = self.made, self.place, self.pairs, len(self.pieces)
        size = np.array(list(map(len, parts)), np.int64)
        symbols = self.of_char[np.frombuffer("".join(parts).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)]
        good = np.minimum.reduceat(symbols, np.cumsum(size) - size) >= 0
        symbols, size, owner = symbols[np.repeat(good, size)].astype(np.int64), size[good], np.flatnonzero(good)
        out: list[bytes | None] = [None] * len(parts)
        both = np.full(len(symbols), -1, np.int32)  # the piece that a symbol makes with the next one
        if len(symbols):
            both[:-1] = made[pairs.get_indexer(symbols[:-1] * width + symbols[1:])]
            both[np.cumsum(size) - 1] = -1
        while len(symbols):
            # the best pair of each part: the least place by score, then the leftmost
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(place[both] | np.arange(len(symbols)), start)
            more = best < place[-1]
            if not more.all():
                stay = np.repeat(more, size)
                ids, at = symbols[~stay].astype("<u4").tobytes(), 0
                for k, n in zip(owner[~more].tolist(), size[~more].tolist()):
                    out[k] = ids[at : (at := at + 4 * n)]
                best = best[more] - start[more]
                symbols, both, size, owner = symbols[stay], both[stay], size[more], owner[more]
                if not len(symbols):
                    break
                start = np.cumsum(size) - size
                best += start
            at = best & 0xFFFFFFFF
            symbols[at] = both[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, both = symbols[stay], both[stay]
            size -= 1
            gone = np.arange(len(at))  # one symbol of each part before
            at, start = at - gone, start - gone
            both[at] = -1
            left, right = at[at > start] - 1, at[at < start + size - 1]
            new = np.concatenate([left, right])
            both[new] = made[pairs.get_indexer(symbols[new] * width + symbols[new + 1])]
        return out

    def merged_short(self, part: str) -> list[str]:
        """The pieces, with the agenda as a list in the pairs' places: its first least entry is the best."""
        symbols, cost, none = list(part), self.cost.get, _NONE
        agenda = [cost(part[i : i + 2], none) for i in range(len(part) - 1)]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            symbols[i] = both = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(both + symbols[i + 1], none)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + both, none)
        return symbols

    def merged(self, part: str) -> list[str]:
        """The pieces, with the agenda as a heap."""
        symbols: list[str] = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        cost, push = self.cost.get, heapq.heappush
        heap = [(c, i, i + 1, part[i : i + 2]) for i in range(n - 1) if (c := cost(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != len(both):
                continue  # one of them has merged since
            symbols[a], symbols[b] = both, ""
            right, left = after[b], before[a]
            after[a] = right
            if right >= 0:
                before[right] = a
                new = both + symbols[right]
                c = cost(new)
                if c is not None:
                    push(heap, (c, a, right, new))
            if left >= 0:
                new = symbols[left] + both
                c = cost(new)
                if c is not None:
                    push(heap, (c, left, a, new))
        return [s for s in symbols if s]

    def atoms(self, part: str) -> list[str]:
        """The part cut between neighbours that no piece holds side by side."""
        out, at, near = [], 0, self.neighbours
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in near:
                out.append(part[at:i])
                at = i
        out.append(part[at:])
        return out

    def decode(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                pending.append(int(self.pieces[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if kind == NORMAL:
                out.append(self.pieces[i])
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class _Parts(dict):
    """Ids of parts; a part that is asked for the first time is encoded."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, part: str) -> bytes:
        got = self[part] = self.make(part)
        return got


class Encoder:
    """Encodes batches of texts; keeps the parts that it has seen, and checks whole texts against the library."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.vocabulary = v = Vocabulary(data)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.known, self.old = _Parts(self._encode_new), {}
        # a part: spaces and what follows up to the next space; newlines and the like by themselves
        self.by_newline = "\n" in v.alone
        self.cut = None if v.spaced else re.compile(self._pattern(v))

    def _pattern(self, v: Vocabulary) -> str:
        """Letters end where punctuation that no piece has after a letter follows."""
        line = "\n" if self.by_newline else ""
        letter = r"[^\W\d_]"
        after = {two[1] for two in v.neighbours if re.match(letter, two)}
        ends = "".join(re.escape(c) for c in string.punctuation if c not in after)
        word = rf" *{letter}++(?=[{ends}])|" if ends else ""
        return f"{word} *[^ {line}]+|{line}| +" if line else f"{word} *[^ ]+| +"

    def parts(self, text: str) -> list[str]:
        """The text cut, with plain spaces for the vocabulary's space symbol: that halves what they take."""
        if not text:
            return []
        plain = text.replace(SPACE, " ")
        if self.vocabulary.dummy_prefix:
            plain = " " + plain
        if not self.cut:
            return [plain]
        if not self.by_newline or "  " in plain or "\0" in plain:
            return self.cut.findall(plain)
        # a cut at each space and newline, several times as fast; new ones among these parts are cut further
        found = plain.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return found if found[0] else found[1:]

    def _encode_new(self, part: str) -> bytes:
        """Encode a part by the agenda."""
        got = self.old.get(part)
        if got is not None:
            return got
        if self.cut and len(finer := self.cut.findall(part)) > 1:
            return b"".join(map(self.known.__getitem__, finer))
        symbols = part.replace(" ", SPACE)
        if len(part) <= SHORT or len(atoms := self.vocabulary.atoms(symbols)) == 1:
            return array("I", self.vocabulary.agenda(symbols)).tobytes()
        return b"".join(self.known[a.replace(SPACE, " ")] for a in atoms)  # an atom is as often a part itself

    def _turn(self) -> None:
        self.old, self.known = self.known, _Parts(self._encode_new)

    def _learn(self, parts: set[str]) -> None:
        """Encode the parts that are new, with their agendas side by side; what has to be encoded otherwise is left."""
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > KEEP:
            self._turn()
            new = parts
        known, old, short, whole = self.known, self.old, set(), []
        for p, got in zip(new, map(old.get, new)):
            if got is not None:
                known[p] = got
            elif self.cut and not (p[0] == " " and p[1:].isalnum()) and len(finer := self.cut.findall(p)) > 1:  # only a newline or punctuation divides a part
                whole.append((p, finer))
                for q in finer:
                    if len(q) <= SHORT and q not in known and q not in old:
                        short.add(q)
            elif len(p) <= SHORT:
                short.add(p)
        todo = list(short)
        for k in range(0, len(todo), BATCH):
            some = todo[k : k + BATCH]
            found = self.vocabulary.agendas(some)
            known.update(zip(some, found) if None not in found else ((p, ids) for p, ids in zip(some, found) if ids is not None))
        for p, finer in whole:
            known[p] = b"".join(map(known.__getitem__, finer))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each text; the numbers of texts that the library encodes otherwise."""
        out, wrong = [], []
        cut = list(map(self.parts, texts))
        self._learn(set().union(*cut))
        for k, text in enumerate(texts):
            if len(self.known) > KEEP:
                self._turn()
            ids = b"".join(map(self.known.__getitem__, cut[k]))
            if array("I", self.library.encode(text)).tobytes() != ids:
                wrong.append(k)
            out.append(np.frombuffer(ids, "<u4").astype(np.int32))
        return out, wrong


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = Encoder(f.read())
    return _ENCODERS[path]


_OUT = ["ids", "n_pieces", "checked", "round_trip"]


def _encoded(path: str):
    def run(batches):
        hold("pieces", _ENCODERS.clear)
        e = encoder(path)
        table = e.vocabulary
        for part in (p for b in batches for p in slices(b, 1)):
            texts = part.column(1).to_pylist()
            ids, wrong = e.encode([t if t is not None else "" for t in texts])
            null = np.array([t is None for t in texts])
            n = np.array([len(i) for i in ids], np.int32)
            trip = [None if t is None else decoded(table, i) == t.replace(SPACE, " ") for t, i in zip(texts, ids)]
            edge = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(null, False))
            lists = pa.ListArray.from_arrays(edge, pa.array(np.concatenate(ids), pa.int32()))
            checked = np.ones(len(texts), bool)
            checked[wrong] = False
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(n, mask=null), pa.array(checked, mask=null), pa.array(trip, pa.bool_())], ["doc_id", *_OUT])
        trim()

    return run


def decoded(v: Vocabulary, ids: np.ndarray) -> str:
    """Decoding of a long array: bytes of all pieces joined, which is what decode() gives for the ids of an encoding."""
    if not hasattr(v, "raw"):
        v.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(v.pieces, v.kinds)]
    text = b"".join(map(v.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if v.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """A row for each document: doc_id, ids, n_pieces, checked (the library encodes the whole text to the same ids), round_trip."""
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(path), f"doc_id {key}, ids array<int>, n_pieces int, checked boolean, round_trip boolean")


def decode(rows: DataFrame, path: str = MODEL, ids: str = "ids", column: str = "text") -> DataFrame:
    """rows with the text of their ids; null ids give null, unknown numbers are an error."""

    @F.pandas_udf("string")
    def back(x: pd.Series) -> pd.Series:
        v = encoder(path).vocabulary
        return pd.Series([None if i is None else v.decode([int(k) for k in i]) for i in x], dtype=object)

    return rows.withColumn(column, back(rows[ids]))
