"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

All segmentations of a text into pieces form a lattice. Forward filtering sums the
probability of the segmentations of every prefix; backward sampling then draws a
segmentation from its end, each piece with its posterior probability, so the sample is
exact. The draw at a place depends on the row's key and the place alone: the same key
and text give the same pieces on any cluster, in any order, and other keys give others.

The vocabulary's scores are merge ranks, not probabilities; a piece of rank r has
probability in proportion to 1 / (r + 2.7) (Zipf-Mandelbrot), raised to ``alpha``: larger
values favour few long pieces. No tokenizer is trained.

Spaces are written as U+2581, as the vocabulary has them. Characters without a piece,
and U+2581 itself, become the byte pieces of their UTF-8 form, so that decoding, which
puts the bytes of the pieces together again, gives every text back as it was.

Scale: row by row, no shuffle. No piece goes on past a space into the next word or
across a line end, so the lattice falls apart into words; the distinct words of a batch are
filtered together, once, and all their occurrences are sampled together, in arrays. Memory is bounded
by ``MOST_EDGES``; words over ``LONG_WORD`` characters are sampled one by one in linear time.
What a word's states hold depends on the word alone, to the last digit, so batch sizes,
retries and partitions change no sample.

Defined results: null text gives null pieces and decodes to null; empty text gives no
pieces; a null key is a key like any other, and so is one that is no number; repeated
rows give equal samples; a very long text is a lot of its own; an empty table gives an empty result; extra columns are kept by ``encode``.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

ALPHA = 1.0
#: Edges of word lattices kept at a time.
MOST_EDGES = 6_000_000
LONG_WORD = 40
SPACE_MARK = "▁"
_ESCAPE = 1 << 20  # an edge's piece number from here on stands for a character's bytes
_WORD = re.compile(r"\n| *[^ \n]+| +")
_U = np.uint64


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(seed: int, places: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each place of the row with this seed."""
    key = mix(np.array([seed & (1 << 64) - 1], dtype=_U) + _U(0x9E3779B97F4A7C15))
    return (mix(key + places.astype(_U) * _U(0xD6E8FEB86659FD93)) >> _U(11)).astype(np.float64) * 2.0**-53


class Vocabulary:
    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = [b""] * n
        self.byte_piece = [0] * 256
        self.weight: dict[str, tuple[int, float]] = {}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        total = sum(1 / (r + 2.7) for r in range(len(plain)))
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:-1], 16)
                self.bytes[i], self.byte_piece[value] = bytes([value]), i
        for r, i in enumerate(plain):
            piece = sp.id_to_piece(i).replace(SPACE_MARK, " ")
            self.bytes[i] = piece.encode()
            self.weight[piece] = (i, (1 / (r + 2.7) / total) ** alpha)
        self.longest = max(map(len, self.weight))
        self.escape = (1e-6) ** alpha

    @functools.cache
    def prefixes(self) -> "Prefixes":
        return Prefixes(self)

    def edges(self, word: str) -> list[tuple[list[int], list[int], list[float]]]:
        """Forward filtering: for each place from 1 on the (length, piece, probability
        summed up) of the pieces that end there, the longest first."""
        weight, longest = self.weight, self.longest
        before, out = [1.0], []
        for end in range(1, len(word) + 1):
            found = []
            for size in range(1, min(end, longest) + 1):
                w = weight.get(word[end - size : end])
                if w is not None and before[end - size] > 0:
                    found.append((before[end - size] * w[1], size, w[0]))
            c = word[end - 1]
            if c not in weight or c == SPACE_MARK:
                found.append((before[end - 1] * self.escape, 1, _ESCAPE + ord(c)))
            found.sort(key=lambda x: -x[1])
            total = sum(x[0] for x in found)
            sums = list(itertools.accumulate(x[0] / total for x in found))
            out.append(([x[1] for x in found], [x[2] for x in found], sums))
            before.append(total)
            if total < 1e-150:  # only the last places count, and only against each other
                for i in range(max(0, end - longest), end + 1):
                    before[i] *= 1e150
        return out


class Prefixes:
    """The beginnings of all pieces, as a tree.

    ``tables[n]`` holds the beginnings of n + 1 characters: sorted keys, each the number
    of the beginning one character shorter and the last character, which no two
    beginnings share; then piece and weight, -1 and 0 where it is no piece.
    """

    def __init__(self, v: Vocabulary) -> None:
        levels: list[dict[str, tuple[int, float]]] = [{} for _ in range(v.longest)]
        for piece, found in v.weight.items():
            for n in range(1, len(piece)):
                levels[n - 1].setdefault(piece[:n], (-1, 0.0))
            levels[len(piece) - 1][piece] = found
        self.tables, number = [], {"": 0}
        for level in levels:
            keys = {int(self.key(number[b[:-1]], ord(b[-1]))): b for b in level}
            order = sorted(keys)
            number = {keys[k]: i for i, k in enumerate(order)}
            self.tables.append((np.array(order, dtype=np.int64), np.array([level[keys[k]][0] for k in order], dtype=np.int64), np.array([level[keys[k]][1] for k in order])))

    @staticmethod
    def key(parent, code):
        """Code points take 21 bits."""
        return parent << 21 | code


class Sampler:
    """Samples of the words of many texts together.

    The lattices of all words not seen before are built at once: pieces are found at
    every place by extending beginnings, one character for all places at a time, and
    forward filtering goes from place to place of all words together.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.prefixes = vocabulary.prefixes()
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}  # word -> state before its first place; -1 for long words
        self.states = 0
        self.first = np.zeros(0, dtype=np.int32)  # of each state's edges
        self.keys = np.zeros(0)  # probability summed up over a state's edges
        self.length = np.zeros(0, dtype=np.int8)
        self.piece = np.zeros(0, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        """Add the edges of words of LONG_WORD characters at most."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        # a word of n characters has n + 1 states; place p of the text is state p + (words before it)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(code)) - first[word]
        room = sizes[word] - offset
        live, node = np.arange(len(code)), np.zeros(len(code), dtype=np.int64)
        begin, size, ids, weight = [], [], [], []
        for n, (keys, piece, w) in enumerate(self.prefixes.tables, 1):
            key = Prefixes.key(node, code[live + n - 1])
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            if n == 1:  # characters without a piece, and the mark itself, are spelled in bytes
                bare = ~hit | (piece[at] < 0) | (code == ord(SPACE_MARK))
                begin.append(live[bare])
                size.append(np.ones(int(bare.sum()), dtype=np.int64))
                ids.append(_ESCAPE + code[bare])
                weight.append(np.full(int(bare.sum()), self.v.escape))
                whole = hit & (piece[at] >= 0) & ~bare
            else:
                whole = hit & (piece[at] >= 0)
            begin.append(live[whole])
            size.append(np.full(int(whole.sum()), n))
            ids.append(piece[at[whole]])
            weight.append(w[at[whole]])
            more = hit & (room[live] > n)
            live, node = live[more], at[more]
            if not len(live):
                break
        begin, size, ids, weight = (np.concatenate(x) for x in (begin, size, ids, weight))
        state = begin + word[begin]  # before the piece, counted from this lot's first state
        end = state + size
        step = offset[begin] + size  # the place in its word where it ends
        by_step = np.argsort(step.astype(np.uint8), kind="stable")
        bounds = np.searchsorted(step[by_step], np.arange(1, int(sizes.max(initial=0)) + 2))
        before = np.zeros(len(code) + len(words))
        before[first + np.arange(len(words))] = 1.0
        share = np.zeros(len(ids))
        for lo, hi in zip(bounds, bounds[1:]):
            e = by_step[lo:hi]
            share[e] = before[state[e]] * weight[e]
            np.add.at(before, end[e], share[e])
        share /= before[end]
        # by state, the longest first: the last found, as one sort of both numbers in one
        room = max(1, len(end).bit_length())
        order = len(end) - 1 - (np.sort(end << room | np.arange(len(end))[::-1]) & ((1 << room) - 1))
        end, size, ids, share = (x[order] for x in (end, size, ids, share))
        group = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        last = np.append(group[1:], len(end)) - 1
        # summed within each state alone, so that company changes no digit
        summed, k = share.copy(), 0
        more = np.flatnonzero(last > group)
        while len(more):
            k += 1
            at = group[more] + k
            summed[at] += summed[at - 1]
            more = more[last[more] > at]
        summed[last] = 1.0
        base = self.states + first + np.arange(len(words))
        edge = np.zeros(len(before), dtype=np.int32)
        edge[end[group]] = group + len(self.keys)
        self.first = np.concatenate([self.first, edge])
        self.keys = np.concatenate([self.keys, summed])
        self.length = np.concatenate([self.length, size.astype(np.int8)])
        self.piece = np.concatenate([self.piece, ids.astype(np.int32)])
        self.at.update(zip(words, base.tolist()))
        self.states += len(before)

    def sample(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        if len(self.keys) > MOST_EDGES:
            self._clear()
        words, counts = [], []
        for text in texts:
            found = _WORD.findall(text)
            counts.append(len(found))
            words += found
        if not words:
            return [np.zeros(0, np.int32) for _ in texts]
        new = [w for w in set(words) if w not in self.at]
        for w in new:
            if len(w) > LONG_WORD:
                self.at[w] = -1
        if new := [w for w in new if len(w) <= LONG_WORD]:
            self._learn(new)
        n = len(words)
        start = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=n)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        own = np.repeat(np.arange(len(texts)), counts)
        at = np.cumsum(size)  # place of each word's end in its text
        ends_before = np.concatenate([[0], at])[np.concatenate([[0], np.cumsum(counts)[:-1]])]
        at -= ends_before[own]
        seed = mix(np.array(seeds, dtype=_U) + _U(0x9E3779B97F4A7C15))[own]
        long_words = [(i, int(own[i]), words[i], int(at[i])) for i in np.flatnonzero(start < 0)]
        state = np.where(start < 0, start, start + size)
        live = np.flatnonzero(state > start)
        found, whose = [], []
        while len(live):
            u = (mix(seed[live] + at[live].astype(_U) * _U(0xD6E8FEB86659FD93)) >> _U(11)).astype(np.float64) * 2.0**-53
            e = self.first[state[live]]
            over = np.flatnonzero(u >= self.keys[e])
            while len(over):
                e[over] += 1
                over = over[u[over] >= self.keys[e[over]]]
            found.append(self.piece[e])
            whose.append(live)
            state[live] -= self.length[e]
            at[live] -= self.length[e]
            live = live[state[live] > start[live]]
        for i, t, word, end in long_words:
            ids = self._long(word, seeds[t], end)
            found.append(np.array(ids, dtype=np.int32))
            whose.append(np.full(len(ids), i))
        # drawn from the end: within a word the last drawn comes first
        many = np.bincount(np.concatenate(whose), minlength=n)
        first = np.cumsum(many) - many
        ids = np.empty(int(many.sum()), dtype=np.int64)
        drawn = np.zeros(n, dtype=np.int64)
        regular = len(found) - len(long_words)
        for x, w in zip(found[:regular], whose[:regular]):
            drawn[w] += 1
            ids[first[w] + many[w] - drawn[w]] = x
        for x, (i, *_) in zip(found[regular:], long_words):
            ids[first[i] : first[i] + many[i]] = x[::-1]
        own = np.repeat(own, many)
        if (ids >= _ESCAPE).any():
            ids, own = self._spell(ids, own)
        return np.split(ids.astype(np.int32), np.searchsorted(own, np.arange(1, len(texts))))

    def _long(self, word: str, seed: int, end: int) -> list[int]:
        edges, ids, i = self.v.edges(word), [], len(word)
        draws = uniform(seed, np.arange(end - len(word), end + 1))
        while i:
            lengths, pieces, sums = edges[i - 1]
            k = min(bisect.bisect_right(sums, draws[i]), len(sums) - 1)
            ids.append(pieces[k])
            i -= lengths[k]
        return ids

    def _spell(self, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of the characters that have none."""
        hard = np.flatnonzero(ids >= _ESCAPE)
        spelled = [[self.v.byte_piece[x] for x in chr(c - _ESCAPE).encode("utf-8", "surrogatepass")] for c in ids[hard].tolist()]
        many = np.ones(len(ids), dtype=np.int64)
        many[hard] = [len(s) for s in spelled]
        out, own = np.repeat(ids, many), np.repeat(own, many)
        first = (np.cumsum(many) - many)[hard]
        flat = np.array([x for s in spelled for x in s], dtype=np.int64)
        out[np.repeat(first, many[hard]) + np.concatenate([np.arange(n) for n in many[hard]])] = flat
        return out, own


@functools.lru_cache(maxsize=1)
def sampler(path: str, alpha: float = ALPHA) -> Sampler:
    """One for all tasks of a worker process: what it has learned is of use to the next."""
    return Sampler(vocabulary(path, alpha))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


def decode_ids(ids: np.ndarray, v: Vocabulary) -> bytes:
    return b"".join(map(v.bytes.__getitem__, ids.tolist()))


def _lots(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i == len(texts) - 1:
            yield at, i + 1
            at, size = i + 1, 0


def seed_of(key: object) -> int:
    """A row key's seed: a whole number is its own, any other key that of its text."""
    if key is None:
        return zlib.crc32(b"null")
    if isinstance(key, int):
        return key & (1 << 64) - 1
    return xxhash.xxh64_intdigest(key if isinstance(key, bytes) else str(key).encode("utf-8", "surrogatepass"))


def sampled(texts: list[str | None], keys: list, of: Sampler) -> Iterator[list[np.ndarray | None]]:
    for lo, hi in _lots(texts):
        some = [t or "" for t in texts[lo:hi]]
        out = of.sample(some, [seed_of(k) for k in keys[lo:hi]])
        yield [None if t is None else x for t, x in zip(texts[lo:hi], out)]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with ``pieces``: array of piece ids of a sampled segmentation of each text.
    A column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x for part in sampled(b[text].to_pylist(), b[key].to_pylist(), sampler(path or model_path(), alpha)) for x in part]
            flat = [x for x in ids if x is not None]
            offsets = pa.array(np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
            arrays = pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in ids], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), arrays], [*names, "pieces"])

    kept = docs.drop("pieces")
    names = kept.columns
    schema = StructType([*kept.schema.fields]).add("pieces", ArrayType(IntegerType()))
    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or model_path())
        for b in batches:
            texts = [None if x is None else b"".join(map(v.bytes.__getitem__, x)).decode("utf-8", "surrogatepass") for x in b["pieces"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    kept = encoded.drop("decoded")
    names = kept.columns
    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("decoded", StringType()))


def round_trips(docs: DataFrame, path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32 (little-endian 32-bit ids) and lossless
    (the pieces decode to the text) of each row of ``docs`` (doc_id, text), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or model_path(), alpha)
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            pieces = (x for part in sampled(texts, ids, sampler(path or model_path(), alpha)) for x in part)
            rows = [(i, None, None, None, None) if p is None else (i, len(t), len(p), zlib.crc32(p.astype("<i4").tobytes()), decode_ids(p, v) == t.encode("utf-8", "surrogatepass")) for i, t, p in zip(ids, texts, pieces)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], ["doc_id", "n_chars", "n_pieces", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_crc32 long, lossless boolean")
