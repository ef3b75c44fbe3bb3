"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a slice of texts go into a trie: in sorted order, each word hangs off the one before where their
common prefix ends, and walking down that order is the depth-first traversal.  Each node is a prefix, and its state is
the last token of that prefix's encoding.  The state of a child follows from its ancestors': the last token is the one
suffix t of the prefix that can stand next to the last token of what precedes t, that is, merging the two tokens'
symbols by rank gives just these two.  A shared prefix is encoded once; a word's encoding is read off by jumping back
from its end.

The vocabulary file is that of the tokenizers library (its path is a parameter).  The text is prepared as the file
says: NFC, lower case, pieces of letters, single digits or other marks, then bytes as printable characters; added tokens
are found in the text as it came.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import in_arrow

#: Words whose encodings a worker keeps between slices (about 0.4 KB each) before it begins a new generation; words of
#: the generation before that are met again move on to the new one, and the rest are forgotten.
MOST_WORDS = 60_000
#: Pairs of tokens whose adjacency a worker keeps (about 0.1 KB each) before it starts anew.
MOST_PAIRS = 150_000
#: Characters of text whose words go into one trie; a longer text is a slice of its own.
SLICE = 2_000_000
#: Beyond these characters, normal forms and letters depend on the age of the Unicode tables; \0 and \1 are marks here.
_LATER = regex.compile("[^\2-\u02ff]")


def _class(kinds: str, more: str = "") -> str:
    """The Latin characters of some general categories, for a character class."""
    return "".join(re.escape(c) for c in map(chr, range(2, 0x300)) if c in more or unicodedata.category(c)[0] in kinds)


_L, _N, _SPACE = _class("L"), _class("N"), _class("Z", "\t\n\x0b\f\r\x85")
#: Letters first: they begin no other alternative, and most pieces are letters.
_PIECES = re.compile(rf"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^{_SPACE}{_L}{_N}]+")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself for printable Latin-1, else the next one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in own else more))
        more += b not in own
    return out


class Vocabulary:
    """Tokens as strings of symbols, one character each: a printable character stands for itself, and one that ends a
    word for itself moved to a private plane."""

    END, SHIFT = "</w>", 0x100000

    def __init__(self, data: str):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != self.END or spec.get("decoder") is not None:
            raise ValueError("expected a BPE vocabulary with word ends and no decoder")
        self.name = {i: t for t, i in model["vocab"].items()}
        self.id = {self.symbols(t): i for t, i in model["vocab"].items()}
        self.text = {i: s for s, i in self.id.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = [tuple(self.id[self.symbols(t)] for t in pair) for pair in pairs]
        #: Rank of a pair of tokens; the rank at which a token is merged (-1: a symbol), and from what.
        self.rank = {pair: r for r, pair in enumerate(pairs)}
        self.born, self.left, self.right = ([-1] * (max(self.text) + 1) for _ in range(3))
        for r, (a, b) in reversed([*enumerate(pairs)]):
            i = self.id[self.text[a] + self.text[b]]
            self.born[i], self.left[i], self.right[i] = r, a, b
        #: The length of the longest token that ends in these four symbols; without an entry it is three at most.
        self.reach: dict[str, int] = {}
        for t in self.id:
            if len(t) > 3:
                self.reach[t[-4:]] = max(len(t), self.reach.get(t[-4:], 0))
        self.size = {i: len(t) for i, t in self.text.items()}
        self.fits: dict[int, bool] = {}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name |= {i: t for t, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes = byte_characters()
        self.whole: dict[int, bool] = {}

    def symbols(self, token: str) -> str:
        if token.endswith(self.END) and len(token) > len(self.END):
            token = token[: -len(self.END)]
            return token[:-1] + chr(ord(token[-1]) + self.SHIFT)
        return token

    def word(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():  # each byte stands for itself
            return piece[:-1] + chr(ord(piece[-1]) + self.SHIFT)
        table = self.bytes
        chars = [*piece[1:]] if piece[0] == "\1" and len(piece) > 1 else [table[b] for b in piece.encode()]
        chars[-1] = chr(ord(chars[-1]) + self.SHIFT)
        return "".join(chars)

    def merged(self, symbols: str) -> list[int]:
        """The encoding of a few symbols by its definition: the pair of lowest rank merges, of equals the leftmost."""
        ids = [self.id[c] for c in symbols]
        while len(ids) > 1:
            rank, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.id[self.text[ids[at]] + self.text[ids[at + 1]]]]
        return ids

    def stands(self, a: int) -> bool:
        """Whether a token is its own encoding."""
        found = self.whole.get(a)
        if found is None:
            found = self.whole[a] = len(self.merged(self.text[a])) == 1
        return found

    def adjacent(self, a: int, b: int) -> bool:
        """Whether tokens a and b, each its own encoding, stay as they are when they meet.

        Undoes the merges of both, the latest first.  At each step the two parts that touch must not merge before the
        merge that was undone last would take one of them away; on equal rank the left one goes first.
        """
        rank, born = self.rank.get, self.born
        until = 1 << 60  # a merge across the border of this rank or above comes too late
        while True:
            r = rank((a, b))
            if r is not None and r < until:
                return False
            if born[a] > born[b]:
                a, until = self.right[a], born[a]
            elif born[b] >= 0:
                b, until = self.left[b], born[b] + 1
            else:
                return True

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Encodings of distinct symbol strings."""
        out: dict[str, list[int]] = {}
        last: list[int] = []  # last[i]: the last token of the first i + 1 symbols of the word before
        size, known, reach, fits = self.size, self.id.get, self.reach.get, self.fits
        if len(fits) > MOST_PAIRS:
            fits.clear()
        before = ""
        for word in sorted(words):
            n = len(word)
            k = 0
            for x, y in zip(before, word):  # down to where the two words part
                if x != y:
                    break
                k += 1
            del last[k:]
            for end in range(k + 1, n + 1):
                longest = reach(word[end - 4 : end], 3) if end > 3 else end
                for start in range(end - longest if end > longest else 0, end):
                    token = known(word[start:end])
                    if token is None:
                        continue
                    if not start:
                        if self.stands(token):
                            break
                        continue
                    pair = last[start - 1] << 20 | token
                    good = fits.get(pair)
                    if good is None:
                        good = fits[pair] = self.adjacent(last[start - 1], token)
                    if good:
                        break
                else:
                    raise ValueError(f"a symbol is not in the vocabulary: {word[end - 1]!r}")
                last.append(token)
            ids, at = [], n
            while at:
                token = last[at - 1]
                ids.append(token)
                at -= size[token]
            ids.reverse()
            out[word], before = ids, word
        return out


class Codec:
    """Encodes whole texts, a batch at a time, and decodes identifiers."""

    def __init__(self, data: str):
        self.vocabulary = Vocabulary(data)
        self.ids: dict[str, str] = {}  # a word's identifiers and its tokens, with one space between
        self.names: dict[str, str] = {}
        self.earlier: tuple[dict[str, str], dict[str, str]] = {}, {}
        self.library = Tokenizer.from_str(data)

    def pieces(self, text: str) -> list[str]:
        """The words of a text in order; an added token is a word of its own, with a leading NUL to mark it."""
        if self.vocabulary.split is None or "<|" not in text:
            return self._plain(text)
        out = []
        for k, part in enumerate(self.vocabulary.split.split(text)):
            out += [f"\0{part}"] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        """Pieces of Latin text by regular expression; other text is prepared by the library, so that both use the same
        Unicode tables, and its pieces, already in printable characters, are marked with \\1."""
        if not _LATER.search(text):
            return _PIECES.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [f"\1{piece}" for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: set[str]) -> None:
        """Encodes those of the words that are not kept yet; after it all of them are."""
        v = self.vocabulary
        if len(self.ids) > MOST_WORDS:
            self.earlier, self.ids, self.names = (self.ids, self.names), {}, {}
        was_ids, was_names = self.earlier
        new = []
        for w in words:
            if w in self.ids:
                continue
            if w in was_ids:
                self.ids[w], self.names[w] = was_ids[w], was_names[w]
            elif w[0] == "\0" and w[1:] in v.added:
                self.ids[w], self.names[w] = str(v.added[w[1:]]), w[1:]
            else:
                new.append(w)
        symbols = {w: v.word(w) for w in new}
        found, name = v.encode(set(symbols.values())), v.name
        for w, s in symbols.items():
            ids = found[s]
            self.ids[w] = " ".join(map(str, ids))
            self.names[w] = " ".join([name[i] for i in ids])

    def spelled(self, texts: list[str]) -> Iterable[tuple[str, str]]:
        """Identifiers and tokens of each text, with one space between; one trie for the words of all."""
        pieces = [self.pieces(text) for text in texts]
        self.learn(set().union(*pieces))
        ids, names = self.ids.__getitem__, self.names.__getitem__
        for words in pieces:
            yield " ".join(map(ids, words)), " ".join(map(names, words))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.spelled([text]) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens as they are spelled, with one space between."""
        return " ".join(self.vocabulary.name[i] for i in ids)


def _slices(column: pa.Array) -> Iterable[list[str]]:
    """The texts of a batch, null as empty, in lists of about SLICE characters."""
    texts, held = [], 0
    for x in column:
        text = x.as_py() or ""
        if texts and held + len(text) > SLICE:
            yield texts
            texts, held = [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield texts


#: The codec of the vocabulary that this Python worker used last, with the words it knows; Spark keeps workers for the next task.
_LAST: dict[int, Codec] = {}


def _codec(data: str) -> Codec:
    key = hash(data)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Codec(data)
    return _LAST[key]


def encoded(docs: DataFrame, path: str, id_cols: list[str], text_col: str = "text", ids: bool = False) -> DataFrame:
    """(*id_cols, n_tokens, ids_sha256, decoded_sha256) of every whole text, and ``ids`` array<int> if asked for.

    Digests are of the decimal ids with one space between, and of the decoded text in UTF-8.  A null or empty text has
    no tokens.  Repeated rows are encoded alike; null ids and other columns are carried or left alone.  An empty table
    gives no rows.  ``path`` is read on the driver; nothing of the corpus leaves its task.
    """
    with open(path, encoding="utf-8") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        codec = _codec(data.value)
        for batch in batches:
            n, a, b, lists = [], [], [], []
            for texts in _slices(batch.column(batch.num_columns - 1)):
                for spelled, named in codec.spelled(texts):
                    n.append(spelled.count(" ") + 1 if spelled else 0)
                    a.append(hashlib.sha256(spelled.encode()).hexdigest())
                    b.append(hashlib.sha256(named.encode()).hexdigest())
                    if ids:
                        lists.append([int(x) for x in spelled.split()])
            columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [*id_cols, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(docs.select(*id_cols, F.col(text_col).alias("_text")), run, schema)
