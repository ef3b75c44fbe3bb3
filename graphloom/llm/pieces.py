"""SentencePiece (BPE) encoding and decoding by backtracking.

A piece sequence is the encoding of a text exactly if its first piece is its own encoding and each two neighbours, merged
anew from their characters, come out as these two pieces: the first merge across a border between neighbours would also be
made with the two alone.  So the encoder walks from left to right with the longest piece at each place (found by an
Aho-Corasick automaton), goes to shorter ones where neighbours do not fit, and steps back where none does.  What precedes
a place is the encoding of that prefix and so is known, which means that a place that failed once has failed for good; a
bitfield keeps those, and each place is left at most once.

Words are cut where no piece of the vocabulary spans: before white space, and between characters that no chain of pieces
connects (letters and marks, two scripts), so that few distinct words are left.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _slices
from .common import in_arrow

#: Words that a worker keeps (0.3 KB each; a new generation begins beyond it, those met again move on), and the characters
#: of the longest of them.
MOST_WORDS, LONGEST = 120_000, 48
#: Pairs of pieces whose fit a worker keeps before it starts anew.
MOST_PAIRS = 300_000
SPACE, START = "▁", (1 << 20) - 1
# Fixed values of the model file: kinds of pieces, and the model type BPE.
NORMAL, CONTROL, BYTE, BPE = 1, 3, 6, 2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol-buffer message: ints, four bytes as a float, bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif tag & 7 == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


class Vocabulary:
    """Pieces of a BPE model with byte fallback, an added leading space, escaped white space and no other normalisation."""

    def __init__(self, data: bytes):
        self.name: list[str] = []
        kinds, self.rank, trainer, normal = [], {}, {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(fields(value))
                self.name.append(piece[1].decode())
                kinds.append(piece[3])
                if piece[3] == NORMAL:
                    self.rank[self.name[-1]] = -piece[2]
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if trainer.get(3) != BPE or not trainer.get(35) or not normal.get(3, 1) or normal.get(4, 1) or normal.get(2) or not normal.get(5, 1) or trainer.get(24):
            raise ValueError("expected a BPE model with byte fallback, an added leading space and no normalisation")
        if set(kinds) - {NORMAL, CONTROL, BYTE, 2}:
            raise ValueError("pieces of the user's own and unused ones are not supported")
        self.end = int(trainer.get(42, 2))
        self.id = {p: i for i, (p, k) in enumerate(zip(self.name, kinds)) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.name, kinds)) if k == BYTE}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()} | {i: p.replace(SPACE, " ").encode() for p, i in self.id.items()}
        longer = [p for p in self.id if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece with white space inside")
        joining = {c for p in longer for c in p} - {SPACE}
        #: All that a text can be cut into: pieces, and characters of longer pieces that are no piece themselves.
        self.text = [p if k == NORMAL else "" for p, k in zip(self.name, kinds)] + sorted(joining - set(self.id))
        self.size = [len(t) for t in self.text]
        own = {t: i for i, t in enumerate(self.text) if t}
        self.shorter = [next((own[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in own), -1) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, i in own.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        groups = sorted(_connected([p.lstrip(SPACE) for p in longer]), key=len, reverse=True)
        groups = "|".join(f"[{''.join(map(re.escape, sorted(g)))}]+" for g in groups)
        self.words = re.compile(f"{SPACE}*(?:{groups})|{SPACE}+|.", re.DOTALL).findall
        self.names = [*map(str, range(len(self.name)))]
        #: Whether two neighbours fit, by both numbers; a first piece's neighbour is START.
        self.fits: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition: the pair that makes the piece of the best rank merges, of equals the leftmost."""
        parts, rank = [*text], self.rank.get
        far = float("inf")
        while len(parts) > 1:
            best, at = far, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1], far)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether two neighbours, merged anew from their characters, come out as they are; of START, the second alone."""
        if len(self.fits) > MOST_PAIRS:
            self.fits.clear()
        pair = [self.text[b]] if a == START else [self.text[a], self.text[b]]
        found = self.fits[a << 20 | b] = self.merged("".join(pair)) == pair
        return found

    def encode(self, words: list[str]) -> list[list[int]]:
        """Identifiers of each of these words, which no piece crosses at their ends."""
        size, end = self.size, 0
        bounds = [0, *(end := end + len(w) for w in words)]
        longest = [-1] * (end + 1)  # the longest piece from each place; places of all words after one another
        for w, start in zip(words, bounds):
            for last, t in self.automaton.iter(w):  # of one start, the longest comes last
                longest[start + last + 1 - size[t]] = t
        return [self.walk(w, longest, a, b) for w, a, b in zip(words, bounds, bounds[1:])]

    def walk(self, word: str, longest: list[int], start: int, end: int) -> list[int]:
        size, shorter, fits, fit = self.size, self.shorter, self.fits.get, self.fit
        failed, found = None, [START]
        at, token = start, longest[start]
        while at < end:
            before = found[-1]
            while token >= 0:
                to = at + size[token]
                if failed is None or not failed[to - start >> 3] >> (to - start & 7) & 1:
                    good = fits(before << 20 | token)
                    if good or good is None and fit(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                found.append(token)
                at, token = to, longest[to]
            elif before == START:  # a character that is in no piece
                return self.bytes_of(word)
            else:
                if failed is None:
                    failed = bytearray((end - start >> 3) + 1)
                failed[at - start >> 3] |= 1 << (at - start & 7)
                at -= size[before]
                token = shorter[found.pop()]
        most = len(self.name)
        if max(found[1:]) < most:
            return found[1:]
        return [i for t in found[1:] for i in ([t] if t < most else self.bytes_of(self.text[t]))]

    def bytes_of(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode()]


def _connected(pieces: list[str]) -> list[set[str]]:
    """The characters of these pieces, in groups that no piece mixes."""
    group: dict[str, set[str]] = {}
    for piece in pieces:
        for c in piece:
            group.setdefault(c, {c})
        for a, b in zip(piece, piece[1:]):
            if group[a] is not group[b]:
                small, large = sorted((group[a], group[b]), key=len)
                large |= small
                group |= dict.fromkeys(small, large)
    return [*{id(g): g for g in group.values()}.values()]


class Codec:
    """Encodes and decodes whole texts; keeps the words it has met."""

    def __init__(self, data: bytes):
        self.vocabulary = Vocabulary(data)
        #: Of each word its identifiers and the text they decode to, of this and the earlier generation.
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}
        self.earlier: tuple[dict[str, str], dict[str, str]] = {}, {}

    def learn(self, words: set[str]) -> None:
        """Encodes those of the words that are not kept yet; after it all of them are."""
        v = self.vocabulary
        if len(self.ids) > MOST_WORDS:
            small = [w for w in self.ids if len(w) <= LONGEST]
            self.earlier = {w: self.ids[w] for w in small}, {w: self.texts[w] for w in small}
            self.ids, self.texts = {}, {}
        was_ids, was_texts = self.earlier
        new = []
        for w in words - self.ids.keys():
            if w in was_ids:
                self.ids[w], self.texts[w] = was_ids[w], was_texts[w]
            else:
                new.append(w)
        names, raw = v.names, v.raw
        for w, ids in zip(new, v.encode(new)):
            self.ids[w] = " ".join([names[i] for i in ids])
            self.texts[w] = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")

    def spelled(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Of each text, identifiers with one space between, the end included, and the text that they decode to."""
        v = self.vocabulary
        words = [v.words(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        self.learn(set().union(*words))
        ids, decoded, end = self.ids.__getitem__, self.texts.__getitem__, str(v.end)
        for found in words:
            yield " ".join([*map(ids, found), end]), "".join(map(decoded, found))[1:]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.spelled([text]) for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """Control pieces say nothing; bytes that are no UTF-8 become U+FFFD; the added leading space goes."""
        raw = b"".join([self.vocabulary.raw.get(i, b"") for i in ids])
        return raw.decode("utf-8", "replace").removeprefix(" ")


#: The codec of the model that this Python worker used last; Spark keeps workers for the next task.
_LAST: dict[int, Codec] = {}


def _codec(data: bytes) -> Codec:
    key = hash(data)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Codec(data)
    return _LAST[key]


def encoded(docs: DataFrame, path: str, id_cols: list[str], text_col: str = "text", ids: bool = False) -> DataFrame:
    """(*id_cols, n_tokens, ids_sha256, decoded_sha256) of every whole text, and ``ids`` array<int> if asked for.

    Identifiers end with the model's end.  Digests are of the decimal ids with one space between, and of the decoded text
    in UTF-8.  A null or empty text has the end alone.  Repeated rows are encoded alike; null ids are carried, other
    columns left alone.  An empty table gives no rows.  ``path`` is read on the driver; no text leaves its task.
    """
    with open(path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        codec = _codec(data.value)
        for batch in batches:
            n, a, b, lists = [], [], [], []
            for texts in _slices(batch.column(batch.num_columns - 1)):
                for spelled, decoded in codec.spelled(texts):
                    n.append(spelled.count(" ") + 1)
                    a.append(hashlib.sha256(spelled.encode()).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        lists.append([int(x) for x in spelled.split()])
            columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [*id_cols, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(docs.select(*id_cols, F.col(text_col).alias("_text")), run, schema)
