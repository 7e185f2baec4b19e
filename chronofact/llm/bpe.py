"""BPE encoding and decoding through a minimal acyclic transducer of the corpus's frequent words.

The words of all documents, which spaces and line ends part, are counted; those counted most, at most WORDS of them, are compiled on the
driver into a transducer: arcs read a word's bytes and write token ids as early as they are certain, and states with the same
arcs, outputs and ends are one, so suffixes are shared. It is a flat file that Spark hands to every executor and that workers
map into memory. A task looks up the distinct words of about BLOCK characters of text at once, all words a byte
at a time; words that the transducer doesn't accept are merged by the tokenizer's own ranks. Ids are those of the whole
text, for the tokenizer drops white space and joins nothing across it; texts for a tokenizer that does otherwise are encoded whole.

Defined results: a null text is empty and has no ids, and no ids give an empty text; the strings of special tokens are these tokens,
as in the library; repeated rows and null ids come out row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from os.path import commonprefix
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import materialise, text_of
from chronofact.llm.packing import WordTokenizer
from chronofact.shipping import ship

WORDS = 65_536
LONGEST = 64
BLOCK = 1 << 21
#: Merged words that a worker remembers, in two generations.
MERGED_WORDS = 120_000
Ids = tuple[int, ...]


class _State:
    """A state that can still change: arcs as byte to [target, output]; end is the output at a word's end, None where no word ends."""

    __slots__ = ("arcs", "end")

    def __init__(self) -> None:
        self.arcs: dict[int, list] = {}
        self.end: Ids | None = None

    def push(self, output: Ids) -> None:
        """Write `output` before whatever comes out from here on."""
        for arc in self.arcs.values():
            arc[1] = output + arc[1]
        if self.end is not None:
            self.end = output + self.end


class Lexicon:
    """Minimal acyclic transducer from words to ids. Arcs lie sorted by state and byte in one array, so that many words are read at once."""

    def __init__(self, flat: np.ndarray) -> None:
        arcs, states, pool, self.root, self.longest = (int(x) for x in flat[:5])
        cuts = np.cumsum([5, arcs, arcs, arcs, arcs, states, states, pool])
        self.keys, self.targets, self.out_at, self.out_n, self.end_at, self.end_n, self.pool = (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        return cls(np.load(path, mmap_mode="r"))

    @staticmethod
    def compile(entries: list[tuple[bytes, Ids]]) -> np.ndarray:
        """The flat form of a transducer for distinct words that aren't empty, built from sorted words without unsharing anything."""
        known: dict[tuple, int] = {}
        path, before = [_State()], b""

        def settle(upto: int) -> None:
            for i in range(len(before), upto, -1):
                state = path.pop()
                form = (state.end, tuple((b, *arc) for b, arc in sorted(state.arcs.items())))
                path[-1].arcs[before[i - 1]][0] = known.setdefault(form, len(known))

        for word, output in sorted(entries):
            shared = len(commonprefix([before, word]))
            settle(shared)
            for i in range(shared):
                arc = path[i].arcs[word[i]]
                both = tuple(commonprefix([arc[1], output]))
                if len(both) < len(arc[1]):
                    path[i + 1].push(arc[1][len(both) :])
                    arc[1] = both
                output = output[len(both) :]
            for b in word[shared:]:
                path[-1].arcs[b], output = [None, output], ()
                path.append(_State())
            path[-1].end, before = output, word
        settle(0)
        root = known.setdefault((path[0].end, tuple((b, *arc) for b, arc in sorted(path[0].arcs.items()))), len(known))

        pool: list[int] = []
        placed: dict[Ids, int] = {}

        def place(output: Ids) -> tuple[int, int]:
            if output not in placed:
                placed[output] = len(pool)
                pool.extend(output)
            return placed[output], len(output)

        arcs, ends = [], []
        for state, (end, out) in enumerate(known):
            ends.append((-1, 0) if end is None else place(end))
            arcs += [(state << 8 | b, target, *place(output)) for b, target, output in out]
        longest = max((len(w) for w, _ in entries), default=0)
        columns = np.array(arcs, np.int64).reshape(-1, 4).T
        return np.concatenate([np.array([len(arcs), len(ends), len(pool), root, longest], np.int64), columns.ravel(), np.array(ends, np.int64).reshape(-1, 2).T.ravel(), np.array(pool, np.int64)])

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are accepted, how many ids each has, and the ids of all of them in order."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        state = np.where(lengths <= self.longest, self.root, -1)
        parts = []
        on = np.flatnonzero(state >= 0)
        for j in range(self.longest if len(self.keys) else 0):
            on = on[lengths[on] > j]
            if not len(on):
                break
            key = state[on] << 8 | raw[starts[on] + j]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            state[on] = np.where(there, self.targets[arc], -1)
            on, arc = on[there], arc[there]
            writes = self.out_n[arc] > 0
            parts.append((on[writes], self.out_at[arc[writes]], self.out_n[arc[writes]]))
        found = (state >= 0) & (self.end_at[np.maximum(state, 0)] >= 0)
        last = np.flatnonzero(found)
        parts.append((last, self.end_at[state[last]], self.end_n[state[last]]))
        owner, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(owner, kind="stable")
        order = order[found[owner[order]]]
        owner, at, n = owner[order], at[order], n[order]
        return found, np.bincount(owner, weights=n, minlength=len(words)).astype(np.int64), self.pool[_ranges(at, n)]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _split(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> list[str]:
    """At most `most` words, those counted most in all documents; words of about the same count are taken or left together.

    Counts are grouped by eighths of a power of two, and the driver gets one number for each group, then the words.
    """
    words = docs.select(F.explode(F.split(text_of(text_col), "[ \n]")).alias("word"))
    counts = materialise(words.filter((F.octet_length("word") > 0) & (F.octet_length("word") <= LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    level = F.floor(F.log2("n") * 8)
    taken, least = 0, None
    for at, n in sorted(map(tuple, counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        taken += n
        if taken > most:
            break
        least = at
    return [] if least is None else [r["word"] for r in counts.filter(level >= least).select("word").toLocalIterator()]


def compile_for(docs: DataFrame, tokenizer_path: str, text_col: str = "text", most: int = WORDS) -> str:
    """Compile the frequent words of `docs` for a tokenizer and hand the file to every executor; its name among Spark's files."""
    tokenizer = WordTokenizer(tokenizer_path)
    words = frequent_words(docs, text_col, most) if tokenizer.by_word else []
    flat = Lexicon.compile([(w.encode(), tuple(np.frombuffer(tokenizer._ids(w), "<u4").tolist())) for w in words])
    path = Path(tempfile.mkdtemp(prefix="lexicon-")) / f"lexicon-{uuid.uuid4().hex}.npy"
    np.save(path, flat)
    docs.sparkSession.sparkContext.addFile(str(path))
    return path.name


class Encoder:
    """A lexicon over a tokenizer, for blocks of texts."""

    def __init__(self, lexicon: Lexicon, tokenizer: WordTokenizer) -> None:
        self.lexicon, self.tokenizer = lexicon, tokenizer
        tokenizer.remembered = MERGED_WORDS

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids."""
        if not self.tokenizer.by_word:
            each = [np.array(self.tokenizer.whole.encode(t, add_special_tokens=False).ids, np.int64) for t in texts]
            return np.array([len(x) for x in each], np.int64), np.concatenate([np.zeros(0, np.int64), *each])
        index: dict[str, int] = defaultdict(count().__next__)
        codes, sizes = [np.zeros(0, np.int64)], []
        for text in texts:
            words = _split(text)
            codes.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
        codes, distinct = np.concatenate(codes), [*index]
        found, n, ids = self.lexicon.look_up([w.encode("utf-8", "surrogatepass") for w in distinct])
        merged = [self.tokenizer._ids(distinct[i]) for i in np.flatnonzero(~found)]
        own, at = np.fromiter(map(len, merged), np.int64, len(merged)) // 4, np.cumsum(n) - n
        n[~found], at[~found] = own, len(ids) + np.cumsum(own) - own
        ids = np.concatenate([ids, np.frombuffer(b"".join(merged), "<u4")])
        each = n[codes]
        upto = np.concatenate([[0], np.cumsum(each)])[np.cumsum([0, *sizes])]
        return np.diff(upto), ids[_ranges(at[codes], each)]


def _blocks(sizes: list[int], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Neighbouring rows that hold about `most` together."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _lists(n: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per document: doc_id and ids, an array of ints."""
    ship(docs.sparkSession)
    name = compile_for(docs, tokenizer_path, text_col, words)

    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Lexicon.load(SparkFiles.get(name)), WordTokenizer.of(tokenizer_path))
        for part in parts:
            texts = part.column(1)
            for a, b in _blocks(pa.compute.binary_length(texts).to_pylist()):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), _lists(*encoder.encode(texts.slice(a, b - a).to_pylist()))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("__t")).mapInArrow(coded, f"doc_id {kind}, ids array<int>")


def _decoder(tokenizer_path: str) -> Callable[[list[int]], str]:
    """The library's decoding with special tokens; without a decoder in the tokenizer's file that is its tokens between spaces."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path)
    if whole.decoder is not None:
        return lambda ids: whole.decode(ids, skip_special_tokens=False)
    tokens = list(map(whole.id_to_token, range(max(whole.get_vocab(with_added_tokens=True).values()) + 1)))
    return lambda ids: " ".join(map(tokens.__getitem__, ids))


def decode(coded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns and `decoded`, the text that the ids stand for; null ids stand for an empty one."""
    ship(coded.sparkSession)
    columns, at = coded.columns, coded.columns.index(ids_col)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _decoder(tokenizer_path)
        for part in parts:
            for a, b in _blocks(part.column(at).value_lengths().fill_null(0).to_pylist(), BLOCK // 4):
                some = part.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([text(ids or []) for ids in some.column(at).to_pylist()], pa.string())], [*columns, "decoded"])

    return coded.mapInArrow(read, coded.select("*", F.lit("").alias("decoded")).schema)
