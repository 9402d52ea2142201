"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, one after another, into a deterministic automaton over the vocabulary. The gadget of
merge (u, v) -> w forbids v after u, adds the arc label w, lets w follow what u could follow, and lets follow w
what could follow v, all as things stood before that merge. So merge k takes the arc on y after x away for every
x that has u on its right spine below all merges after k, and every y that has v on its left spine likewise.
With labels numbered along both spine forests, later merges first, either set is one interval: a merge record is
a rectangle of forbidden transitions, and a state's row is all labels but some intervals. Labels with equal rows
are one state. For the 50,000 merges of `byte_bpe_50k.json` these are 14,410 states and 318,537 intervals (2.5 MB;
one bit a transition would be 316 MB), compiled in a second by the driver and broadcast.

A pre-split word is encoded by walking the automaton: the longest label at a place that has a transition from the
state is taken, and a place from which no label goes on is left for good, as only one path leads to it. Decoding
emits the labels' bytes.
"""

from __future__ import annotations

import json
import pickle
import re
from array import array
from bisect import bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, release, slices, table, text_bytes
from quillon.llm.kernels import piece_hashes, ragged, segments

TOKENIZER = "byte_bpe_50k.json"
# Fixed value: the pre-split pattern of byte-level tokenizers, with white space spelled out.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
# The same for texts of ASCII characters alone.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
MEMO_SEGMENTS, MEMO_WORDS = 600_000, 1 << 16  # text segments (about 50 MB) and new words that a task remembers


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge records of a byte-level tokenizer file, and which transitions the automaton of the first t has."""

    def __init__(self, model: dict):
        letters, vocab = byte_letters(), model["model"]["vocab"]
        if model.get("normalizer") or model["model"]["type"] != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE tokenizer without normalizer")
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.labels: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.labels[i] = bytes(letters[c] for c in t)
        self.left, self.right, self.rank, self.pair = [-1] * size, [-1] * size, [-1] * size, {}
        self.alive = {self.labels[i]: i for i in vocab.values() if len(self.labels[i]) == 1}
        if len(self.alive) != 256:
            raise ValueError("the vocabulary lacks bytes")
        for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            real = self.alive.get(self.labels[u]) == u and self.alive.get(self.labels[v]) == v and self.follows(u, v, k)
            self.pair[u, v] = k
            if real and self.rank[w] < 0:
                self.left[w], self.right[w], self.rank[w] = u, v, k
                self.alive[self.labels[w]] = w
        for t, i in self.special.items():
            self.labels[i] = t.encode()

    def follows(self, x: int, y: int, t: int) -> bool:
        rank, pair = self.rank, self.pair
        while True:
            if pair.get((x, y), t) < t:
                return False
            a, b = rank[x], rank[y]
            if a < 0 and b < 0:
                return True
            if a > b:
                x, t = self.right[x], a
            elif b > a:
                y, t = self.left[y], b + 1
            else:
                x, y, t = self.right[x], self.left[y], a


def spines(parent: list[int], rank: list[int], nodes: list[int]) -> tuple[dict, dict, dict]:
    """(children, later merges first; number; one past the last number below it) of each label in a spine forest."""
    below: dict = {}
    for x in nodes:
        below.setdefault(parent[x], []).append(x)
    for some in below.values():
        some.sort(key=lambda x: -rank[x])
    first, after, n = {}, {}, 0
    stack = below.get(-1, [])[::-1]
    while stack:
        x = stack.pop()
        if x in first:
            after[x] = n
            continue
        first[x], n = n, n + 1
        stack.append(x)
        stack.extend(reversed(below.get(x, [])))
    return below, first, after


class Automaton:
    """The compiled tables: labels, longest label at a place (a trie), next shorter label, and transitions.

    transitions: label -> state, label -> column, and of each state the bounds of the columns it has no arc on."""

    def __init__(self, spec: str):
        m = Merges(json.loads(spec))
        self.labels, self.special = m.labels, m.special
        nodes = sorted(m.alive.values())
        right, row, row_end = spines(m.right, m.rank, nodes)
        left, column, column_end = spines(m.left, m.rank, nodes)

        def reach(x, below, first, after, k):
            last = next((c for c in reversed(below.get(x, [])) if m.rank[c] > k), None)
            return first[x], first[x] + 1 if last is None else after[last]

        starts: dict = {}
        for (u, v), k in m.pair.items():
            if u in row and v in column:
                a, z = reach(u, right, row, row_end, k)
                starts.setdefault(a, []).append((z, *reach(v, left, column, column_end, k - 1)))
        size = len(m.labels)
        self.state, self.column = array("i", [-1]) * size, array("i", [-1]) * size
        self.begin, self.low, self.high = array("i", [0]), array("i"), array("i")
        of_row, states, now = sorted(row, key=row.get), {}, []
        for r, x in enumerate(of_row):
            now = [g for g in now if g[0] > r] + starts.get(r, [])
            bounds: list = []
            for _, a, z in sorted(now, key=lambda g: g[1]):
                if bounds and a <= bounds[-1][1]:
                    bounds[-1][1] = max(bounds[-1][1], z)
                else:
                    bounds.append([a, z])
            key = tuple(map(tuple, bounds))
            if key not in states:
                states[key] = len(states)
                self.low.extend(a for a, _ in bounds)
                self.high.extend(z for _, z in bounds)
                self.begin.append(len(self.low))
            self.state[x], self.column[x] = states[key], column[x]
        self.shorter = array("i", [-1]) * size
        self.arcs, self.ends = {}, [-1]
        for label, x in m.alive.items():
            self.shorter[x] = next((m.alive[label[:n]] for n in range(len(label) - 1, 0, -1) if label[:n] in m.alive), -1)
            at = 0
            for b in label:
                key = at << 8 | b
                if key not in self.arcs:
                    self.arcs[key] = len(self.ends)
                    self.ends.append(-1)
                at = self.arcs[key]
            self.ends[at] = x

    def walker(self):
        """A function that gives the labels of the path that spells a word."""
        arcs, ends, shorter, size = self.arcs.get, self.ends, list(self.shorter), list(map(len, self.labels))
        state, column, begin, low, high = list(self.state), list(self.column), list(self.begin), self.low, self.high

        def word(w: bytes) -> list[int]:
            n, at, out, dead, s, y = len(w), 0, [], set(), -1, -1
            while at < n:
                if y < 0:  # the longest label here
                    node = 0
                    for i in range(at, n):
                        node = arcs(node << 8 | w[i])
                        if node is None:
                            break
                        if ends[node] >= 0:
                            y = ends[node]
                while y >= 0:
                    to = at + size[y]
                    if to not in dead:
                        if s < 0:
                            break
                        c, first = column[y], begin[s]
                        k = bisect_right(low, c, first, begin[s + 1]) - 1
                        if k < first or c >= high[k]:
                            break
                    y = shorter[y]
                if y >= 0:
                    out.append(y)
                    at, s, y = to, state[y], -1
                else:
                    dead.add(at)
                    y = out.pop()
                    at -= size[y]
                    s = state[out[-1]] if out else -1
            return out

        return word


def plain_segments(data: np.ndarray, doc_starts: np.ndarray):
    """(bytes, starts, where the content begins, ends) of the segments as they are."""
    starts = segments(data, doc_starts)
    return data, starts, starts, np.r_[starts[1:], len(data)]


class SegmentTable:
    """Ids of text segments; segments not met yet are encoded once. Segments are looked up by a 64-bit hash and then
    compared byte by byte (a hash tells those of one length up to 8 bytes apart by itself); one that only shares
    another's hash is encoded each time. Beyond `limit` segments the half that was not used for longest goes.
    `cut` says what the segments of some texts are."""

    def __init__(self, encode_pieces, limit: int = MEMO_SEGMENTS, cut=plain_segments):
        self.encode_pieces, self.limit, self.cut, self.now = encode_pieces, limit, cut, 0
        self.keys, self.flat, self.text = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.start = self.size = self.at = self.length = self.used = np.zeros(0, np.int64)

    def shrink(self) -> None:
        keep = np.flatnonzero(self.used > np.median(self.used))
        self.flat, self.text = self.flat[ragged(self.start[keep], self.size[keep])], self.text[ragged(self.at[keep], self.length[keep])]
        self.keys, self.size, self.length, self.used = self.keys[keep], self.size[keep], self.length[keep], self.used[keep]
        self.start, self.at = np.cumsum(self.size) - self.size, np.cumsum(self.length) - self.length

    def learn(self, data, keys, begins, ends) -> None:
        """Adds segments by their sorted new keys."""
        raw = data.tobytes()
        new = self.encode_pieces([raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())])
        size, length = np.fromiter(map(len, new), np.int64, len(new)), ends - begins
        start, at = len(self.flat) + np.cumsum(size) - size, len(self.text) + np.cumsum(length) - length
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(new), np.int32, int(size.sum()))]
        self.text = np.r_[self.text, data[ragged(begins, length)]]
        place = np.searchsorted(self.keys, keys)
        more = {"keys": keys, "start": start, "size": size, "at": at, "length": length, "used": np.full(len(keys), self.now)}
        for name, values in more.items():
            setattr(self, name, np.insert(getattr(self, name), place, values))

    def differ(self, data, begins, ends, found) -> np.ndarray:
        """The segments that are not those found in the table."""
        length = ends - begins
        wrong = length != self.length[found]
        some = np.flatnonzero((length > 8) & ~wrong)
        size = length[some]
        odd = np.flatnonzero(data[ragged(begins[some], size)] != self.text[ragged(self.at[found[some]], size)])
        wrong[some[np.searchsorted(np.cumsum(size), odd, "right")]] = True
        return np.flatnonzero(wrong)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, ids of each document) for the texts data[off[i]:off[i+1]]; off[0] is 0."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        data, starts, begins, ends = self.cut(data, off[:-1][off[:-1] < off[1:]])
        keys, first, inverse = np.unique(piece_hashes(data, begins, ends), return_index=True, return_inverse=True)
        self.now += 1
        if len(self.keys) > self.limit:
            self.shrink()
        at = np.searchsorted(self.keys, keys)
        miss = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(miss):
            self.learn(data, keys[miss], begins[first[miss]], ends[first[miss]])
            at = np.searchsorted(self.keys, keys)
        self.used[at] = self.now
        found = at[inverse]
        start, size, flat = self.start[found], self.size[found], self.flat
        wrong = self.differ(data, begins, ends, found)
        if len(wrong):
            raw = data.tobytes()
            own = self.encode_pieces([raw[a:b] for a, b in zip(begins[wrong].tolist(), ends[wrong].tolist())])
            size[wrong] = [len(x) for x in own]
            start[wrong] = len(flat) + np.cumsum(size[wrong]) - size[wrong]
            flat = np.r_[flat, np.fromiter(chain.from_iterable(own), np.int32, int(size[wrong].sum()))]
        total = np.r_[0, np.cumsum(size)]
        return flat[ragged(start, size)], np.diff(total[np.searchsorted(starts, off)])


class Coder:
    """Encodes pieces of texts: special tokens, pre-split, words."""

    def __init__(self, automaton: Automaton):
        special = sorted(automaton.special, key=len, reverse=True)
        self.special, walk = automaton.special, automaton.walker()
        self.word = lru_cache(MEMO_WORDS)(lambda w: tuple(walk(w.encode())))
        self.apart = re.compile("|".join(map(re.escape, special))) if special else None
        self.split, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)

    def plain(self, text: str) -> list[int]:
        return [i for w in (self.ascii if text.isascii() else self.split).findall(text) for i in self.word(w)]

    def encode(self, text: str) -> list[int]:
        if not (self.apart and self.apart.search(text)):
            return self.plain(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.plain(text[at:])

    def pieces(self, many: list[bytes]) -> list[list[int]]:
        return [self.encode(p.decode("utf-8", "replace")) for p in many]


class Labels:
    """Decodes id lists by emitting labels."""

    def __init__(self, labels: list[bytes]):
        self.size = np.fromiter(map(len, labels), np.int64, len(labels))
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(labels), np.uint8)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < len(self.size))
        lengths = np.where(known, self.size[np.where(known, ids, 0)], 0)
        total = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]]
        text = self.flat[ragged(self.start[np.where(known, ids, 0)], lengths)]
        try:
            out = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(total.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))).cast(pa.string())
            out.validate(full=True)
        except pa.ArrowInvalid:
            raw = text.tobytes()
            out = pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(total[:-1], total[1:])], pa.string())
        return out


@lru_cache(maxsize=2)
def _compiled(spec: str) -> bytes:
    out = pickle.dumps(Automaton(spec))
    release()
    return out


def compiled(spark, path: str):
    """The automaton of a tokenizer file, read and compiled once by the driver, as a broadcast of about 5 MB."""
    return spark.sparkContext.broadcast(_compiled(open(path, encoding="utf-8").read()))


def _kind(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", decode=False) -> DataFrame:
    """Token ids (array<int>) of every whole text: id, ids; with `decode` also text, decoded in the same pass.

    The compiled automaton is broadcast; its size is that of the tokenizer file. The strings of special
    tokens in a text become those tokens, as the tokenizer's library does. A null or empty text has no
    ids. Ids of rows may be null or repeated; an empty table gives no rows; other columns are not read.
    A task remembers the ids of at most MEMO_SEGMENTS segments of texts.
    """
    automaton = compiled(docs.sparkSession, tokenizer_path)

    def run(batches):
        compiled = pickle.loads(automaton.value)
        coder, labels = SegmentTable(Coder(compiled).pieces), Labels(compiled.labels) if decode else None
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for a, b in slices(off):
                flat, counts = coder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                ids = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)]), pa.array(flat)).cast(pa.list_(pa.int32()))
                out = [batch.column(0).slice(a, b - a), ids] + ([labels.decode(ids)] if decode else [])
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "ids", "text"][: len(out)])

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), f"{_kind(docs, id_col)}, ids array<int>" + ", text string" * decode)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col="doc_id") -> DataFrame:
    """The text of each row's ids: id, ids, text. Null ids give an empty text; unknown ids emit nothing."""
    automaton = compiled(encoded.sparkSession, tokenizer_path)

    def run(batches):
        labels = Labels(pickle.loads(automaton.value).labels)
        for batch in batches:
            step = max(1, batch.num_rows // 32)
            for a in range(0, batch.num_rows, step):
                part = batch.column(1).slice(a, step)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, step), part, labels.decode(part)], names=[id_col, "ids", "text"])

    return encoded.select(id_col, "ids").mapInArrow(lean(run), f"{_kind(encoded, id_col)}, ids array<int>, text string")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    both = bpe_encode(docs, path, decode=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op1_bpe(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
