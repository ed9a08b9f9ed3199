"""Packing documents into sequences by lexical retrieval.

Each input split is cut into shards of bounded size. A shard has a BM25 inverted index of its documents; a window is
opened by a seed document, and the index returns the seed's unused neighbours, which fill the window greedily. A
document that crosses the end of a window is cut there and its rest opens the next one, so only the last sequence of
a split can have padding. Nothing is shuffled; memory is bounded by the shard.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

WINDOW, END_ID = 2048, 1
#: A shard is closed at so many bytes of text or documents.
SHARD_BYTES, SHARD_DOCS = 4_000_000, 20_000
#: BM25 parameters, and how many neighbours are put in order at a time.
K1, B, ORDERED = 1.2, 0.75, 64

#: Words (and closing marks) whose ids a worker remembers.
REMEMBERED = 300_000
#: Words joined for one call of the tokenizer; between them a control character that is a token of its own.
JOINED, BREAK = 200, "\x01"
#: The byte-level alphabet's letter for the break, for where the tokenizer's own mapping of bytes is left out.
PLAIN_BREAK = chr(0x101)
#: A word that ends in ASCII marks behind a letter or digit, in two parts. The letters are those of which it's sure that
#: the tokenizer takes them for one letter in lower case too (so not U+0130, which becomes two characters).
CLOSED = r"(?s)^(?P<head>.*[a-zA-Z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{388}-\x{3FF}\x{400}-\x{481}])(?P<tail>[!-/:-@\[-`{-~]+)$"


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked stretches of values one after another, and their sizes."""
    n = sizes[pick]
    ends = np.cumsum(n)
    return values[np.repeat(starts[pick] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


class Encoder:
    """Ids of whole shards, each distinct word encoded once and remembered for the shards after, REMEMBERED at most.

    The tokenizer lowers case and never joins what ASCII white space separates, so a text's ids are those of its
    words one after another. Nor does it join a letter or digit to an ASCII mark behind it, so a word's closing marks
    are encoded apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # on words of a-z its normalizer changes nothing and its pre-tokenizer only cuts at white space
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        ends = [t.encode(b, add_special_tokens=False).ids for t, b in ((self.tokenizer, BREAK), (self.plain, PLAIN_BREAK))]
        assert ends[0] == ends[1] and len(ends[0]) == 1, "the tokenizer has no token of its own for the break"
        self.end = ends[0][0]
        self.forget()
        # their strings are looked for in the text as it is, before all else
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def parts(self, some: list[str], tokenizer, mark: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of some words, run together, and the size of each."""
        if not some:
            return [], []
        between = f" {mark} "
        flat, sizes = [], []
        step = 32 * JOINED  # what a call returns is much larger than the ids, so few words go at once
        for at in range(0, len(some), step):
            part = some[at : at + step]
            for e in tokenizer.encode_batch_fast([between.join(part[i : i + JOINED]) for i in range(0, len(part), JOINED)], add_special_tokens=False):
                ids = np.array(e.ids, np.uint32)
                sizes.append(np.diff(np.flatnonzero(ids == self.end), prepend=-1, append=len(ids)) - 1)
                flat.append(ids[ids != self.end])
        return flat, sizes

    def words(self, distinct: pa.Array, rare: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words, each cut into its head and its closing marks; equal parts are encoded once.

        rare: whether a special token or the break may be in them."""

        def holds(some: pa.Array, what: Sequence[str]) -> pa.Array:
            return functools.reduce(pc.or_, [pc.match_substring(some, t) for t in what]) if rare else pa.repeat(False, len(some))

        cut = pc.extract_regex(distinct, CLOSED)
        whole = pc.or_(pc.is_null(cut), holds(distinct, self.special))
        heads = pc.if_else(whole, distinct, pc.struct_field(cut, "head"))
        tails = pc.if_else(whole, "", pc.struct_field(cut, "tail"))
        coded = pa.concat_arrays([heads, tails]).dictionary_encode()
        place = self.places(coded.dictionary, functools.partial(holds, what=(BREAK, *self.special)))
        place = place[coded.indices.to_numpy()].reshape(2, -1).T.reshape(-1)
        values, n = ragged(self.values, self.starts, self.sizes, place)
        return values, n.reshape(-1, 2).sum(1)

    def places(self, atoms: pa.Array, is_odd) -> np.ndarray:
        """Where values holds the ids of each atom; atoms that no shard before had are encoded and remembered."""
        if len(self.known) + len(atoms) > REMEMBERED:
            self.forget()
        place = pc.index_in(atoms, value_set=self.known)
        is_new = pc.is_null(place)
        new = atoms.filter(is_new)
        plain = pc.match_substring_regex(new, "^[a-z]+$").to_numpy(zero_copy_only=False)
        kind = np.where(plain, 0, np.where(is_odd(new).to_numpy(zero_copy_only=False), 2, 1))
        kind[pc.equal(new, "").to_numpy(zero_copy_only=False)] = 3
        order = pa.array(np.argsort(kind, kind="stable"))
        n_plain, n_other, n_odd, n_empty = np.bincount(kind, minlength=4)
        new = new.take(order)
        some = new.to_pylist()
        flat, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for part, tokenizer, mark in ((some[:n_plain], self.plain, PLAIN_BREAK), (some[n_plain : n_plain + n_other], self.tokenizer, BREAK)):
            f, n = self.parts(part, tokenizer, mark)
            flat += f
            sizes += n
        for w in some[n_plain + n_other : n_plain + n_other + n_odd]:
            ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
            flat.append(ids)
            sizes.append(np.array([len(ids)]))
        values, n = np.concatenate(flat), np.concatenate([*sizes, np.zeros(n_empty, np.int64)])
        out = place.fill_null(0).to_numpy().astype(np.int64)
        out[np.flatnonzero(is_new.to_numpy(zero_copy_only=False))[order.to_numpy()]] = len(self.known) + np.arange(len(n))
        self.starts = np.concatenate((self.starts, len(self.values) + np.cumsum(n) - n))
        self.values, self.sizes = np.concatenate((self.values, values)), np.concatenate((self.sizes, n))
        self.known = pa.concat_arrays([self.known, new])
        return out

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.values, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def shard(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id; ids of each; word numbers of all; words of each."""
        low = pc.ascii_lower(texts)
        special = any(pc.any(pc.match_substring(low, t.lower())).as_py() for t in self.special)
        rare = special or bool(pc.any(pc.match_substring(low, BREAK)).as_py())
        if not special:
            texts = low  # fewer distinct words; where a special token may be, letters stay as they are
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        each = np.diff(split.offsets.to_numpy())
        distinct = coded.dictionary
        values, n = self.words(distinct, rare)
        values, n = np.append(values, np.uint32(END_ID)), np.append(n, 1)  # one more word stands for the end
        with_end = np.insert(codes, np.cumsum(each), len(distinct))
        ids, sizes = ragged(values, np.cumsum(n) - n, n, with_end)
        ends = np.cumsum(sizes)[np.cumsum(each + 1) - 1]
        if (empty := pc.index(distinct, "").as_py()) >= 0:  # white space at an end makes an empty word
            real = codes != empty
            each = np.bincount(np.repeat(np.arange(len(each)), each)[real], minlength=len(each))
            codes = codes[real]
        return ids, np.diff(ends, prepend=0), codes, each


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Index:
    """BM25 over the documents of a shard: postings of each term with their scores, as one array."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.n = len(sizes)
        key = np.sort(codes << 32 | np.repeat(np.arange(self.n), sizes))  # by term, then document
        first = np.flatnonzero(np.diff(key, prepend=-1))
        tf, key = np.diff(first, append=len(key)), key[first]
        owner, term = key & 0xFFFFFFFF, key >> 32
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(starts, append=len(term))
        rank = np.repeat(np.arange(len(starts)), df)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if self.n else 1.0))
        weight = idf[rank] * tf * (K1 + 1) / (tf + norm[owner])
        shared = df[rank] > 1  # a term of one document finds no neighbour
        self.docs, self.weights, rank = owner[shared], weight[shared], rank[shared]
        self.sizes = np.where(df > 1, df, 0)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.places = np.arange(len(self.docs))
        own = np.sort(self.docs << 32 | np.arange(len(self.docs)))  # the postings by document
        at = own & 0xFFFFFFFF
        self.own_code = rank[at]
        self.own_ends = np.searchsorted(own >> 32, np.arange(self.n), "right")

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first by all its terms, ties by position."""
        a, b = self.own_ends[seed - 1] if seed else 0, self.own_ends[seed]
        if a == b:
            return
        codes = self.own_code[a:b]
        at, _ = ragged(self.places, self.starts, self.sizes, codes)
        score = np.bincount(self.docs[at], self.weights[at], self.n)
        found = np.flatnonzero((score > 0) & unused)
        score = -score[found]
        size = ORDERED
        while len(found) > size:  # the best few are put in order first: a window needs no more
            edge = np.partition(score, size - 1)[size - 1]
            first = score <= edge
            yield from found[first][np.argsort(score[first], kind="stable")].tolist()
            found, score, size = found[~first], score[~first], 4 * size
        yield from found[np.argsort(score, kind="stable")].tolist()


class Packer:
    """Fills windows across the shards of a split; pieces are (document, start, length, sequence, offset)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.sequence, self.filled = window, 0, 0

    def place(self, doc: int, start: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        while length:
            part = min(length, self.window - self.filled)
            yield doc, start, part, self.sequence, self.filled
            start, length, self.filled = start + part, length - part, self.filled + part
            if self.filled == self.window:
                self.sequence, self.filled = self.sequence + 1, 0

    def pack(self, lengths: list[int], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
        unused = np.ones(len(lengths), bool)
        for seed in range(len(lengths)):
            if not unused[seed]:
                continue
            while True:  # seed, then neighbours of what opened the window, as long as windows end inside a document
                unused[seed] = False
                opened = self.sequence
                yield from self.place(seed, 0, lengths[seed])
                if not self.filled:
                    break
                following = None
                for other in index.neighbours(seed, unused):
                    unused[other] = False
                    opened = self.sequence
                    yield from self.place(other, 0, lengths[other])
                    if self.sequence != opened:
                        following = other
                        break
                if following is None or not self.filled:
                    break
                # the rest of the cut document has opened a new window: its neighbours come next
                seed = next(index.neighbours(following, unused), None)
                if seed is None:
                    break


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are documents of their own. A sequence_id is the split's
    number times 2^40 plus the sequence's number in it. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer = Packer(window)
        held: list[tuple[pa.Array, pa.Array]] = []
        size = n = 0

        def shard() -> Iterator[pa.RecordBatch]:
            keys = pa.concat_arrays([h[0] for h in held])
            ids, lengths, codes, each = encoder(path).shard(pa.concat_arrays([h[1] for h in held]))
            starts, raw = np.cumsum(lengths) - lengths, memoryview(ids.astype("<u4").tobytes())
            pieces = np.array(list(packer.pack(lengths.tolist(), Index(codes, each))), np.int64).reshape(-1, 5)
            at = starts[pieces[:, 0]] + pieces[:, 1]
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + pieces[:, 2])).tolist())]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(pieces[:, 0])), *(pa.array(x, pa.int64()) for x in (pieces[:, 1], pieces[:, 2], crc, lengths[pieces[:, 0]], pieces[:, 3] + base, pieces[:, 4]))], names)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column(1).fill_null("")
                held.append((part.column(0), texts))
                size, n = size + (pc.sum(pc.binary_length(texts)).as_py() or 0), n + part.num_rows
                if size >= SHARD_BYTES or n >= SHARD_DOCS:
                    yield from shard()
                    held, size, n = [], 0, 0
                    give_back()
        if held:
            yield from shard()
        held = []
        give_back()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(rows, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
