r"""Byte-level BPE in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks each neighbouring pair up by binary search in
the sorted pair keys, takes the lowest rank of each word and merges all its occurrences from the left. Words that have
no mergeable pair leave the array. Two bytes that stand next to each other in no token of the vocabulary are never merged
across, so a word falls into pieces there, which merge on their own; all that is left of long runs takes the same rounds,
in batches of their own. The published pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|
\s+(?!\S)|\s+ splits whole batches by the classes of neighbouring code points.

Defined results: a null or empty text has no ids and decodes to an empty text. Equal texts have equal ids. Rows are
independent, so repeated rows and ties need no rule. The special token's string inside a text is the special token, as
the library has it by default. Extra columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import fresh, with_columns
from tarnlake.llm.words import RANDOM, SLOTS, STEP

#: Bytes from which a word is merged apart from shorter ones, which need fewer rounds.
LONG = 1024
KEPT = 250_000
CHUNK = 1 << 19
SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Of each code point: space, letter, number or other, as the pattern's classes have them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, found in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(found, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def splits(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin: cp has the code points of many runs of text, ends the end of each run."""
    kind = kinds()[cp]
    head = np.zeros(len(cp) + 1, bool)
    head[0] = True
    head[ends] = True
    run = head[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = np.zeros(len(cp), bool)  # a space right before, in the same run of text
    blank[1:] = (cp[:-1] == 32) & ~head[1:-1]
    space = kind == SPACE
    start = run & (space | ~blank)
    follows = np.zeros(len(cp), bool)  # the last white space before something else
    follows[:-1] = space[:-1] & ~space[1:] & ~head[1:-1]
    start |= follows
    tick = np.flatnonzero((cp == 39) & run & ~blank)
    if len(tick):
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        stop = np.append(np.flatnonzero(head), len(cp) + 9)
        limit = stop[np.searchsorted(stop, tick, side="right")]
        x, y = padded[tick + 1], padded[tick + 2]
        one = np.isin(x, [ord(c) for c in "stmd"]) & (tick + 1 < limit)
        two = np.zeros(len(tick), bool)
        for pair in ("re", "ve", "ll"):
            two |= (x == ord(pair[0])) & (y == ord(pair[1])) & (tick + 2 < limit)
        for hit, size in ((one, 2), (two & ~one, 3)):
            at = tick[hit]
            start[at + 1] = False
            after = at + size
            start[after[after < len(cp)]] |= ~blank[after[after < len(cp)]]
    return np.flatnonzero(start)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    known = set(plain)
    return [chr(b) if b in known else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """Encodes and decodes whole texts with the vocabulary file of a byte-level BPE."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.single[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.none = len(merges)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        digits = [b"%d," % i for i in range(len(self.bytes))]
        self.digits_length = np.array([len(x) for x in digits], np.int64)
        self.digits_at = np.cumsum(self.digits_length) - self.digits_length
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        #: whether some token has the one byte before the other
        self.meet = np.zeros((256, 256), bool)
        token = np.repeat(np.arange(len(self.bytes)), self.length)
        inner = np.flatnonzero(token[1:] == token[:-1])
        self.meet[self.joined[inner], self.joined[inner + 1]] = True
        self.known: dict[bytes, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def merge_words(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all items end to end, and n + 1 offsets. Each round looks up only the pairs that the last one made."""
        n = len(items)
        raw = np.frombuffer(b"".join(items), np.uint8)
        symbols = self.single[raw]
        ends = np.cumsum([len(x) for x in items], dtype=np.int64)
        head = np.zeros(len(raw) + 1, bool)
        head[0] = head[ends] = True
        head[1:-1] |= ~self.meet[raw[:-1], raw[1:]]
        word = np.cumsum(head[:-1]) - 1  # pieces of words
        until = np.cumsum(head[:-1])[ends - 1] if n else ends
        rank = np.full(len(symbols), self.none, np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        done_symbols, done_words = [], []
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(heads, len(symbols)))
            low = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            active = low < self.none
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank, low = symbols[active], word[active], rank[active], low[active]
                if not len(symbols):
                    break
            where = np.flatnonzero(rank == low)
            near = np.diff(where) == 1
            if near.any():  # of overlapping occurrences in a row, every second one merges, from the left
                begin = np.concatenate([[True], ~near])
                first = np.maximum.accumulate(np.where(begin, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - first) % 2 == 0]
            symbols[where] = self.made[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            where = where - np.arange(len(where))
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            changed = np.concatenate([where, where[where > 0] - 1])
            rank[changed] = self.none
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.concatenate([[0], np.searchsorted(word[order], until)])

    def learn(self, new: list[bytes]) -> None:
        """Adds the ids of words not met before to the table of known words."""
        short = [b for b in new if len(b) <= LONG]
        for part in [short[k : k + 50_000] for k in range(0, len(short), 50_000)] + [[b] for b in new if len(b) > LONG]:
            ids, off = self.merge_words(part)
            ids, cut = ids.astype(np.int32), off.tolist()
            self.known.update((b, ids[cut[j] : cut[j + 1]].tobytes()) for j, b in enumerate(part))

    def encode_runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without special tokens, end to end, and n + 1 offsets."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        start = splits(cp, ends)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        raw = np.frombuffer(joined.encode(), np.uint8)
        begin = at[start]
        lengths = np.diff(np.append(begin, len(raw)))
        place = np.arange(len(raw)) - np.repeat(begin, lengths)
        values = RANDOM[((place & (SLOTS - 1)) << 8) | raw]
        if lengths.max() > SLOTS:
            turn = place // SLOTS
            power = np.cumprod(np.full(int(turn.max()) + 1, STEP | np.uint64(1)))
            later = np.flatnonzero(turn)
            values[later] *= power[turn[later]]
        hashes = np.add.reduceat(values, begin)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        data = raw.tobytes()
        words = [data[a:b] for a, b in zip(begin[first].tolist(), (begin + lengths)[first].tolist(), strict=True)]
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        if new := [w for w in words if w not in known]:
            self.learn(new)
        held = [known[w] for w in words]
        flat = np.frombuffer(b"".join(held), np.int32)
        n = np.array([len(x) // 4 for x in held], np.int64)
        ids = gather(flat, np.cumsum(n) - n, n, inverse)
        count = np.zeros(len(start) + 1, np.int64)
        np.cumsum(n[inverse], out=count[1:])
        return ids, count[np.searchsorted(start, np.concatenate([[0], ends]))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.cut is None or not any(s in t for t in texts for s in self.special):
            ids, off = self.encode_runs(texts)
            return [ids[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        parts = [[x for x in self.cut.split(t) if x] for t in texts]
        ids, off = self.encode_runs([x for p in parts for x in p if x not in self.special])
        runs = iter(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
        out = []
        for p in parts:
            got = [np.array([self.special[x]], np.int32) if x in self.special else ids[slice(*next(runs))] for x in p]
            out.append(np.concatenate(got) if got else np.zeros(0, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; bytes that are no UTF-8 become the replacement character."""
        raw = gather(self.joined, self.at, self.length, ids).tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal digits, joined by commas."""
        return gather(self.digits, self.digits_at, self.digits_length, ids).tobytes()[:-1]


def gather(flat: np.ndarray, at: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[at[w] : at[w] + length[w]] for each w of which, end to end."""
    if not len(which):
        return flat[:0]
    n = length[which]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1]) + np.repeat(at[which] - ends + n, n)]


@lru_cache(maxsize=2)
def model(content: str) -> ByteBpe:
    return ByteBpe(content)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def joined_lists(rows: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32, copy=False)))


def joined_texts(rows: Iterable[bytes]) -> pa.Array:
    """Texts in UTF-8 as one column, made in runs of about CHUNK bytes, so that a batch isn't held as single objects too."""
    done, part, size = [], [], 0
    for x in rows:
        part.append(x)
        size += len(x)
        if size >= CHUNK:
            done.append(pa.array(part, pa.binary()).cast(pa.string()))
            part, size = [], 0
    return pa.concat_arrays([*done, pa.array(part, pa.binary()).cast(pa.string())])


def lists_of(col: pa.Array) -> Iterator[np.ndarray]:
    """Each list as numbers, null as none."""
    for x in col:
        yield x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x.values) else np.zeros(0, np.int64)


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each whole text as an array column. vocabulary: the content of the vocabulary file."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()  # what the batch before has left
        bpe = model(shared.value)
        return joined_lists([x for part in batches(col) for x in bpe.encode(part)])

    return df.withColumn(out, run(F.col(text)))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; null as empty."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        bpe = model(shared.value)
        return joined_texts(bpe.decode(x) for x in lists_of(col))

    return df.withColumn(out, run(F.col(ids)))


def round_trip(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """df's columns but the text, with n_tokens, ids_sha256 and decoded_sha256 of the whole text; ids are hashed where they are made, so neither ids nor decoded texts travel."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    (at,) = fresh(df, "bpe")

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(col: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(list(digests(model(shared.value), col)), ["n_tokens", "ids_sha256", "decoded_sha256"])

    rest = [F.col(f"`{c}`") for c in df.columns if c != text and c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return df.withColumn(at, run(F.col(text))).select(*rest, f"{at}.n_tokens", f"{at}.ids_sha256", f"{at}.decoded_sha256")


def digests(bpe: ByteBpe, col: pa.Array) -> Iterator[pa.Array]:
    counts, shas, backs = [], [], []
    for part in batches(col):
        for ids in bpe.encode(part):
            counts.append(len(ids))
            shas.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
            backs.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
    yield pa.array(counts, pa.int64())
    yield pa.array(shas, pa.string())
    yield pa.array(backs, pa.string())


def batches(col: pa.Array) -> Iterator[list[str]]:
    """Texts in runs of about CHUNK characters."""
    part, size = [], 0
    for x in col:
        t = x.as_py() or ""
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def documents_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    return round_trip(with_columns(docs, doc_id="bigint", text="string").select("doc_id", "text"), vocabulary)
