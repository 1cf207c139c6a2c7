"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is compiled to two deterministic transducers.

* The splitter reads one class of character at a time and marks where pre-tokens begin. It has
  eleven states, so a chunk of text is a map from eleven states to eleven states; the chunks' maps
  are computed side by side, composed by a parallel prefix scan, and a second pass marks the
  boundaries from the then known states.
* The counter reads the bytes of one pre-token. BPE gives a string the one sequence of tokens in which
  each neighbouring pair is what BPE makes of their joined bytes, so the last token of every prefix is
  found from the last tokens of shorter prefixes. Its state holds these for the starts from which a
  longer token is still possible, relative to the current count; each transition is annotated with
  the change in the number of tokens. States are made when they are first met (a lazily determinised
  machine) and forgotten when there are `MAX_STATES` of them, which bounds memory.

Special tokens' strings inside a text end the pre-token before them and count one each. The counts
equal those of the library that the file is for. Null or empty text: 0 tokens. Texts are handled
whole, in blocks; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, per_process

LIMIT = 512
#: Transducer states, and pre-tokens whose counts are remembered, before a worker starts anew.
MAX_STATES = 200_000
MAX_REMEMBERED = 400_000
#: Bytes of remembered pre-tokens and what is known of them before a worker starts anew.
MAX_REMEMBERED_BYTES = 24_000_000
#: Pre-tokens of more characters are compared one by one.
LONG = 64
#: Characters in a chunk of the prefix scan.
CHUNK = 256
#: Characters of text handled at once.
BLOCK = 500_000

#: Classes of characters. S, R, E, V and L are letters that matter after an apostrophe.
LETTER, S, R, E, V, L, NUMBER, SPACE, BLANK, QUOTE, OTHER, END = range(12)
#: States of the splitter: at a start; in a run of letters, numbers, others, white space that ends in a
#: space or not; after an apostrophe that may begin a contraction, and that with r, v, l; after one.
START, LETTERS, NUMBERS, OTHERS, SPACES, BLANKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, DONE = range(11)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def classes() -> np.ndarray:
    """Code point -> class."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):  # White_Space
        out[c] = BLANK
    for chars, kind in (("stmd", S), ("r", R), ("e", E), ("v", V), ("l", L), (" ", SPACE), ("'", QUOTE)):
        for x in chars:
            out[ord(x)] = kind
    return out


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and class. Marks: 1, a pre-token begins here; 2, one began a character ago."""
    letters = {LETTER, S, R, E, V, L}
    begun = {LETTER: LETTERS, S: LETTERS, R: LETTERS, E: LETTERS, V: LETTERS, L: LETTERS, NUMBER: NUMBERS, SPACE: SPACES, BLANK: BLANKS, QUOTE: QUOTED, OTHER: OTHERS, END: START}
    after_space = begun | {QUOTE: OTHERS}
    state, marks = np.zeros((11, 12), np.uint8), np.zeros((11, 12), np.uint8)

    def go(s: int, c: int) -> tuple[int, int]:
        same = {LETTERS: letters, NUMBERS: {NUMBER}, OTHERS: {OTHER, QUOTE}}
        if c == END:  # what stands between texts; the next one begins anew
            return START, 1 | 2 * (s in (QUOTED_R, QUOTED_V, QUOTED_L))
        if s in (SPACES, BLANKS):
            if c in (SPACE, BLANK):
                return begun[c], 0
            return (after_space[c], 2) if s == SPACES else (begun[c], 3)
        if s in same and c in same[s]:
            return s, 0
        if s == QUOTED:
            if c == S:
                return DONE, 0
            if c in (R, V, L):
                return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
            if c in (OTHER, QUOTE):
                return OTHERS, 0
        if s in (QUOTED_R, QUOTED_V, QUOTED_L):
            if c == (L if s == QUOTED_L else E):
                return DONE, 0
            return (LETTERS, 2) if c in letters else (begun[c], 3)
        return begun[c], 1

    for s in range(11):
        for c in range(12):
            state[s, c], marks[s, c] = go(s, c)
    return state, marks


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in a stream of classes that ends with END."""
    state, marks = splitter()
    row = np.ascontiguousarray(state * 12, np.int32).ravel()  # next state's row, by row + class
    n = -(-len(kinds) // CHUNK)
    padded = np.full(n * CHUNK, END, np.uint8)
    padded[: len(kinds)] = kinds
    columns = np.ascontiguousarray(padded.reshape(n, CHUNK).T).astype(np.int32)
    maps = np.repeat(np.arange(0, 132, 12, dtype=np.int32)[:, None], n, 1)
    for column in columns:  # each chunk's map, all chunks at once
        maps = row.take(maps + column)
    at, step = np.arange(n), 1
    while step < n:  # inclusive scan: the map of chunk i after the maps of all before it
        maps[:, step:] = maps[maps[:, :-step] // 12, at[step:]]
        step *= 2
    now = np.concatenate(([START], maps[START, :-1])).astype(np.int32)
    found = np.empty((CHUNK, n), np.uint8)
    mark = marks.ravel()
    for i, column in enumerate(columns):
        now = now + column
        found[i] = mark.take(now)
        now = row.take(now)
    found = found.T.ravel()[: len(kinds)]
    begins = (found & 1).astype(bool)
    begins[:-1] |= (found[1:] & 2).astype(bool)
    return np.flatnonzero(begins)


class Splitter:
    """Texts -> pre-tokens, with the file's special tokens as pre-tokens of their own."""

    BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

    def __init__(self, specials: list[str]):
        self.classes = per_process("classes", classes)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.powers = self.inverses = np.ones(1, np.uint64)

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the different pre-tokens, the number of each pre-token of the texts in order, where each
        text begins in these numbers, and the end). Pre-tokens meet by a 64-bit hash of their characters
        and are then compared with the first of their hash, so only different ones become strings."""
        pieces, counts, whole = [], [], []
        for t in texts:
            parts = self.special.split(t) if self.special and self.special.search(t) else [t]
            whole += [len(pieces) + i for i in range(1, len(parts), 2)]
            pieces += parts
            counts.append(len(parts))
        stream = "\0".join(pieces) + "\0"
        points = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes[points]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        kinds[ends] = END
        mark = np.zeros(len(stream), bool)
        mark[boundaries(kinds)] = True
        for i in whole:  # special tokens stay whole
            mark[ends[i] - len(pieces[i]) + 1 : ends[i]] = False
        mark[ends] = True
        places = np.flatnonzero(mark)
        begins = np.delete(np.arange(len(places)), np.searchsorted(places, ends))
        start, stop = places[begins], places[begins + 1]
        numbers, different = pd.factorize(self.hashes(points, start, stop))
        first = np.empty(len(different), np.int64)
        first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        words = [stream[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        others: dict[str, int] = {}
        for i in differing(points, start, stop, first[numbers]).tolist():  # one hash, other characters
            word = stream[start[i] : stop[i]]
            numbers[i] = others.setdefault(word, len(words) + len(others))
        words += others
        text_ends = ends[np.cumsum(counts) - 1]
        return words, numbers, np.append(0, np.searchsorted(start, text_ends))

    def hashes(self, points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Polynomial hashes modulo 2**64, of mixed code points, by differences of running sums."""
        if len(points) > len(self.powers):
            for name, base in (("powers", int(self.BASE)), ("inverses", pow(int(self.BASE), -1, 2**64))):
                table = np.full(2 * len(points), np.uint64(base))
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        mixed = (points.astype(np.uint64) + np.uint64(1)) * self.MIX
        mixed ^= mixed >> np.uint64(31)
        mixed *= self.powers[: len(points)]
        total = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
        return (total[stop] - total[start]) * self.inverses[start]


def differing(points: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The pre-tokens whose characters aren't those of the pre-token `first` names for them."""
    size = stop - start
    found = [np.flatnonzero(size != size[first])]
    left = np.flatnonzero((size == size[first]) & (first != np.arange(len(first))))
    for i in left[size[left] > LONG].tolist():
        a, b = start[i], start[first[i]]
        if (points[a : a + size[i]] != points[b : b + size[i]]).any():
            found.append(np.array([i]))
    left = left[size[left] <= LONG]
    for k in range(LONG):  # one place of all that are as long
        left = left[size[left] > k]
        if not len(left):
            break
        wrong = points[start[left] + k] != points[start[first[left]] + k]
        if wrong.any():
            found.append(left[wrong])
            left = left[~wrong]
    return np.concatenate(found)


def per_text(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring `begins`."""
    total = np.append(0, np.cumsum(values))
    return total[begins[1:]] - total[begins[:-1]]


class Counter:
    """The transducer from bytes to changes in the number of tokens, made as it is needed."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.specials = [x["content"] for x in data["added_tokens"]]
        shown = {c: b for b, c in byte_letters().items()}
        raw = lambda word: bytes(shown[c] for c in word)
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        halves: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in self.rank:
            halves.setdefault(a + b, (a, b))
        texts = sorted({bytes([b]) for b in range(256)} | ({*halves} & {raw(w) for w in data["model"]["vocab"]}))
        ids = {t: i for i, t in enumerate(texts)}
        #: Token -> rank of the merge that makes it (-1: a single byte), and its two halves.
        self.made = [self.rank[halves[t]] if t in halves else -1 for t in texts]
        self.left = [ids.get(halves[t][0], -1) if t in halves else -1 for t in texts]
        self.right = [ids.get(halves[t][1], -1) if t in halves else -1 for t in texts]
        self.pair = {ids[x] << 20 | ids[y]: i for (x, y), i in self.rank.items() if x in ids and y in ids}
        #: A trie of the tokens: node * 256 + byte -> node; the token that a node is; whether it goes on.
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for i, t in enumerate(texts):
            node = 0
            for byte in t:
                self.inner[node] = True
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = i
        self.reset()

    def reset(self) -> None:
        self.known: list[tuple] = [((0, -1, 0),)]
        self.states: dict[tuple, int] = {self.known[0]: 0}
        self.next: dict[int, int] = {}  # state * 256 + byte -> next state * 1024 + change + 512
        self.fitting: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a and b as they are when they stand together.

        Walks down both tokens' merges from the seam: a merge over the seam must never be due
        before the merges that build the two tokens.
        """
        pair, made, limit = self.pair, self.made, len(self.rank)
        while True:
            if pair.get(a << 20 | b, limit) < limit:
                return False
            x, y = made[a], made[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = x, self.right[a]
            else:
                limit, b = y + 1, self.left[b]

    def compile(self, state: int, byte: int) -> int:
        """The transition of `state` on `byte`.

        A state lists (trie node, last token before it, count before it less the current count) for
        each suffix of what was read that is a proper prefix of a token; the empty suffix stands last.
        """
        child, found, change, grown = self.child, -1, 0, []
        for node, last, count in self.known[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if found < 0 and (token := self.token[node]) >= 0:
                if last >= 0 and (fit := self.fitting.get(seam := last << 20 | token)) is None:
                    fit = self.fitting[seam] = self.fits(last, token)
                if last < 0 or fit:
                    found, change = token, count + 1
            if self.inner[node]:
                grown.append((node, last, count))
        key = (*((node, last, count - change) for node, last, count in grown), (0, found, 0))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.known)
            self.known.append(key)
        made = self.next[state << 8 | byte] = to << 10 | change + 512
        return made

    def count(self, word: bytes) -> int:
        if len(self.known) > MAX_STATES:
            self.reset()
        state, total, get = 0, 0, self.next.get
        for byte in word:
            made = get(state << 8 | byte)
            if made is None:
                made = self.compile(state, byte)
            state = made >> 10
            total += (made & 1023) - 512
        return total


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """Word -> find(word), which forgets all when it holds too many or too long words."""

    def __init__(self, find: Callable[[str], object], most: int = MAX_REMEMBERED, most_bytes: int = MAX_REMEMBERED_BYTES):
        super().__init__()
        self.find, self.most, self.most_bytes, self.held = find, most, most_bytes, 0

    def __missing__(self, word: str):
        if len(self) >= self.most or self.held >= self.most_bytes:
            self.clear()
            self.held = 0
        self[word] = found = self.find(word)
        self.held += len(word)
        return found


def counting(path: str) -> tuple[Remembered, Splitter]:
    """Pre-token -> its number of tokens, and the splitter, of the tokenizer in `path`."""
    counter = Counter(path)
    specials = {*counter.specials}
    return Remembered(lambda word: 1 if word in specials else counter.count(word.encode())), Splitter(counter.specials)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, splitter = per_process(("token counts", path), lambda: counting(path))
        for batch, texts in blocks(batches, "text", BLOCK):
            sizes = [len(t.encode()) for t in texts]
            different, numbers, begins = splitter.split(texts)
            counts = per_text(np.fromiter(map(words.__getitem__, different), np.int64, len(different))[numbers], begins)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
