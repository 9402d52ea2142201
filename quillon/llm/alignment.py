"""Cross-tokenizer alignment by segment deduplication.

A text is cut before every space or line feed that follows a character other than white space. Neither tokenizer can
merge across such a place, which is checked on what they are: the first splits words there before it merges, and no
piece of the second holds a space after another character, or a line feed. So the tokens of a text are those of its
segments one after another, and every cut ends a token of both.

Each chunk of documents becomes one row: its distinct segments and, for each document, which of them it consists of.
The segments of all chunks are shuffled by their text, where each is tokenized and aligned once; its alignment goes back
to every chunk that asked for it, a row for each chunk and segment however often it occurs there, and documents are
composed from them. Chunks also say how many of their documents hold each id pair linked; these numbers add up.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections import Counter
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import byte_letters, tokenizer_path
from quillon.llm.common import lean, shared_dir, slices, stash, table, text_bytes, unstash_at
from quillon.llm.kernels import piece_hashes, ragged, segments

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES, CHUNK_SEGMENTS = 32 << 20, 150_000  # a chunk ends beyond either; a longer document is one alone
SLICE = 1 << 20  # bytes or segments that are worked on at once inside a chunk
BLOB = 200_000  # alignments that a task packs at once
MAX_PAIRS = 2_000_000  # id pairs whose counts are broadcast (17 bytes each); beyond it they are joined to the chunks
WIDE = 4096  # links of a group above which its distinct ids are paired instead of all its tokens


class Pair:
    """Both tokenizers, the bytes of their tokens, and the alignment of one segment."""

    def __init__(self, spec: str, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        parts = json.loads(spec)
        split = parts.get("pre_tokenizer") or {}
        if parts.get("normalizer") or parts["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("use_regex") is False:
            raise ValueError("the first tokenizer may merge across a space")
        self.first = Tokenizer.from_str(spec)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        letters = byte_letters()
        self.a = {i: bytes(letters[c] for c in t) for t, i in self.first.get_vocab(with_added_tokens=False).items()}
        self.second = SentencePieceProcessor(model_proto=model)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("the second tokenizer may merge across a space or line feed")
        self.b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.second.piece_to_id("▁")
        if self.second.encode("\n") != [self.space, *self.second.encode("\n")[1:]]:
            raise ValueError("the second tokenizer does not begin with a space")

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Both tokenizers' ids of segments. The second puts a space before a text: where a segment begins with one that
        is it, else it is taken away again."""
        a = [e.ids for e in self.first.encode_batch(texts, add_special_tokens=False)]
        own = [t[1:] if t[:1] == " " else t for t in texts]
        b = self.second.encode(own, num_threads=1)
        b = [(x if o else [self.space]) if t[:1] == " " else x[1:] for t, o, x in zip(texts, own, b)]
        return list(zip(a, b))

    def align(self, text: str, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """Groups of ids between the places where tokens of both end; None if either's bytes are not the text's."""
        raw = text.encode()
        if b"".join([self.a[i] for i in a]) != raw or b"".join([self.b[i] for i in b]) != raw:
            return None
        out, i, j, x, y = [], 0, 0, 0, 0
        at_a, at_b = 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(self.a[a[i]])
                i += 1
            else:
                at_b += len(self.b[b[j]])
                j += 1
            if at_a == at_b:
                out.append((a[x:i], b[y:j]))
                x, y = i, j
        return out


@lru_cache(maxsize=1)
def _pair(spec: str, model: bytes) -> Pair:
    return Pair(spec, model)


def _packed(x: np.ndarray) -> bytes:
    """Small numbers, compressed: their low bytes, then the next ones."""
    planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = b"".join((x >> 8 * k).astype(np.uint8).tobytes() for k in range(planes))
    return bytes([planes]) + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = planes[0].astype(np.int32)
    for k in range(1, len(planes)):
        out |= planes[k].astype(np.int32) << 8 * k
    return out


class Dictionary:
    """A chunk's distinct segments, numbered as they come, found by 64-bit hashes and compared by their bytes."""

    def __init__(self):
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint8)

    def look_up(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, pick, back = np.unique(piece_hashes(text, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        new = np.flatnonzero(~known)
        numbers = self.add(text, starts[pick[new]], ends[pick[new]])
        self.keys, self.number = np.insert(self.keys, at[new], keys[new]), np.insert(self.number, at[new], numbers)
        out = self.number[np.searchsorted(self.keys, keys)][back]
        length = ends - starts
        odd = length != self.length[out]
        some = np.flatnonzero(~odd)
        wrong = np.flatnonzero(text[ragged(starts[some], length[some])] != self.flat[ragged(self.begin[out[some]], length[some])])
        odd[some[np.searchsorted(np.cumsum(length[some]), wrong, "right")]] = True
        odd = np.flatnonzero(odd)  # segments that only share another's hash stand by themselves
        if len(odd):
            out[odd] = self.add(text, starts[odd], ends[odd])
        return out

    def add(self, text, starts, ends) -> np.ndarray:
        length, first = ends - starts, len(self.length)
        self.begin = np.r_[self.begin, len(self.flat) + np.cumsum(length) - length]
        self.length = np.r_[self.length, length]
        self.flat = np.r_[self.flat, text[ragged(starts, length)]]
        return np.arange(first, first + len(starts))


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two rows a chunk: kind documents with ids, counts (segments of each document) and at (the segments' places among
    the distinct ones); kind segments with segs (distinct, the most frequent first)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        n = TaskContext.get().partitionId() << 32
        ids, counts, at, size, known = [], [], [], 0, Dictionary()

        def chunk():
            where = np.concatenate(at) if at else np.zeros(0, np.int64)
            rank = np.argsort(-np.bincount(where, minlength=len(known.length)), kind="stable")
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            flat = known.flat[ragged(known.begin[rank], known.length[rank])]
            segs = pa.StringArray.from_buffers(len(rank), pa.py_buffer(np.r_[0, np.cumsum(known.length[rank])].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)))
            two = lambda x, i: pa.ListArray.from_arrays(pa.array([0, 0, len(x)] if i else [0, len(x), len(x)], pa.int32()), x)
            cols = [pa.array(["documents", "segments"]), pa.array([n, n], pa.int64()), two(pa.concat_arrays(ids), 0), two(pa.array(np.concatenate(counts), pa.int32()), 0), pa.array([_packed(place[where]), None], pa.binary()), two(segs, 1)]
            return pa.RecordBatch.from_arrays(cols, names=["kind", "chunk", "ids", "counts", "at", "segs"])

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for lo, hi in slices(off, SLICE):
                length = np.diff(off[lo : hi + 1])
                begins = (off[lo:hi] - off[lo])[length > 0]
                text = np.insert(data[off[lo] : off[hi]], begins, np.uint8(32))
                bounds = np.r_[0, np.cumsum(length + (length > 0))]
                starts = segments(text, bounds[:-1][length > 0]) if len(text) else np.zeros(0, np.int64)
                if len(starts):
                    at.append(known.look_up(text, starts, np.r_[starts[1:], len(text)]))
                ids.append(batch.column(0).slice(lo, hi - lo))
                counts.append(np.diff(np.searchsorted(starts, bounds)))
                size += len(text)
                if size > CHUNK_BYTES or len(known.length) > CHUNK_SEGMENTS:
                    yield chunk()
                    n += 1
                    ids, counts, at, size, known = [], [], [], 0, Dictionary()
        if ids:
            yield chunk()

    schema = f"kind string, chunk long, ids array<{kind}>, counts array<int>, at binary, segs array<string>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def _code(groups: list | None) -> bytes:
    """A segment's alignment: the number of groups, both sizes of each, then the ids group by group; in 2 bytes each, or 4
    after a byte that makes the length odd. Empty where either tokenizer changes the segment."""
    if groups is None:
        return b""
    flat = [len(groups)]
    for u, v in groups:
        flat += (len(u), len(v))
    for u, v in groups:
        flat += u
        flat += v
    return array("H", flat).tobytes() if max(flat) < 1 << 16 else b"\0" + array("I", flat).tobytes()


def _aligned(chunks: DataFrame, spec, model) -> DataFrame:
    """chunk, blob: alignments of a chunk's segments (their places, code lengths and codes, compressed). Equal segments
    meet in one task in a row and are tokenized once; a segment has one row a chunk at most, so none is a large part of
    all. What a task has for a chunk is packed together, BLOB segments at a time."""

    def run(batches):
        pair, last = _pair(spec.value, model.value), (None, b"")
        chunk, pos, codes = [], [], []

        def blobs():
            of, at, every = np.concatenate(chunk), np.concatenate(pos), np.array(codes, object)
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0, True]).tolist()
            out = []
            for a, b in zip(cuts, cuts[1:]):
                mine = order[a:b]  # in the segments' own order, in which neighbours have much in common
                parts = every[mine].tolist()
                raw = b"".join([np.array([b - a], "<i4").tobytes(), at[mine].astype("<i4").tobytes(), np.fromiter(map(len, parts), "<i4", b - a).tobytes(), *parts])
                out.append(zstandard.ZstdCompressor(level=3).compress(raw))
            return pa.RecordBatch.from_arrays([pa.array(of[order[cuts[:-1]]], pa.int64()), pa.array(out, pa.binary())], names=["chunk", "blob"])

        for batch in batches:
            segs = batch.column(2).dictionary_encode()
            texts = segs.dictionary.to_pylist()
            known = [last[1]] if texts and texts[0] == last[0] else []
            new = texts[len(known) :]
            found = known + [_code(pair.align(t, a, b)) for t, (a, b) in zip(new, pair.encode(new) if new else [])]
            if texts:
                last = texts[-1], found[-1]
                chunk.append(batch.column(0).to_numpy())
                pos.append(batch.column(1).to_numpy())
                codes += [found[i] for i in segs.indices.to_pylist()]
            if len(codes) >= BLOB:
                yield blobs()
                chunk, pos, codes = [], [], []
        if codes:
            yield blobs()

    asked = chunks.select("chunk", F.posexplode("segs").alias("pos", "seg"))
    return asked.repartition("seg").sortWithinPartitions("seg").mapInArrow(lean(run), "chunk long, blob binary")


class Aligned:
    """A chunk's segments from their codes: ok, n_a, n_b, n_groups, n_links of each; the linked id pairs of all of them
    (pair, seg, times); texts() for their groups as strings."""

    def __init__(self, raw: list[bytes]):
        n = len(raw)
        self.ok = np.array([bool(c) for c in raw], bool)
        self.sizes = {x: np.zeros(n, np.int64) for x in ("n_a", "n_b", "n_groups", "n_links")}
        pairs, segs, times, self.parts = [], [], [], []
        for odd, kind in ((0, np.uint16), (1, np.uint32)):
            mine = [i for i, c in enumerate(raw) if c and len(c) % 2 == odd]
            if not mine:
                continue
            flat = np.frombuffer(b"".join([raw[i][odd:] for i in mine]), kind).astype(np.int64)
            starts = np.cumsum([0] + [(len(raw[i]) - odd) // np.dtype(kind).itemsize for i in mine])
            mine = np.array(mine)
            groups = flat[starts[:-1]]
            heads = flat[ragged(starts[:-1] + 1, 2 * groups)]
            la, lb = heads[0::2], heads[1::2]
            seg = np.repeat(np.arange(len(mine)), groups)
            first = np.cumsum(groups) - groups
            ids_at = starts[:-1] + 1 + 2 * groups  # where a segment's ids begin
            before = np.cumsum(la + lb) - (la + lb)
            at = ids_at[seg] + before - before[first][seg]
            for name, x in (("n_a", la), ("n_b", lb), ("n_groups", np.ones_like(la)), ("n_links", la * lb)):
                self.sizes[name][mine] = np.add.reduceat(x, first)
            some = np.flatnonzero(la * lb <= WIDE)
            size = (la * lb)[some]
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            width = np.repeat(lb[some], size)
            x = flat[np.repeat(at[some], size) + k // width]
            y = flat[np.repeat(at[some] + la[some], size) + k % width]
            pairs.append(x << 32 | y)
            segs.append(np.repeat(mine[seg[some]].astype(np.int32), size))
            times.append(np.ones(len(x), np.int64))
            for g in np.flatnonzero(la * lb > WIDE).tolist():
                x, cx = np.unique(flat[at[g] : at[g] + la[g]], return_counts=True)
                y, cy = np.unique(flat[at[g] + la[g] : at[g] + la[g] + lb[g]], return_counts=True)
                pairs.append((x[:, None] << 32 | y[None]).ravel())
                times.append((cx[:, None] * cy[None]).ravel())
                segs.append(np.full(len(pairs[-1]), mine[seg[g]], np.int32))
            self.parts.append((flat, mine, first, groups, la, lb, at, seg))
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.pair, self.seg, self.times = join(pairs), join(segs), join(times)
        self.n = n

    def texts(self) -> list[str]:
        """Each segment's groups: ids in digits, parted by , in a group's side, | between sides and ; between groups."""
        out = [""] * self.n
        for flat, mine, first, groups, la, lb, at, seg in self.parts:
            tokens = flat[ragged(at, la + lb)]
            mark = np.full(len(tokens), 44, np.uint8)
            ends = np.cumsum(la + lb)
            mark[ends - lb - 1], mark[ends - 1] = 124, 59
            known, which = np.unique(tokens, return_inverse=True)
            digits = [str(x).encode() for x in known.tolist()]
            length = np.array([len(x) for x in digits])
            source, begin = np.frombuffer(b"".join(digits), np.uint8), np.cumsum(length) - length
            size = length[which] + 1
            text = np.empty(int(size.sum()), np.uint8)
            stop = np.cumsum(size)
            text[stop - 1] = mark
            inside = np.ones(len(text), bool)
            inside[stop - 1] = False
            text[inside] = source[ragged(begin[which], length[which])]
            cut = np.r_[0, stop[ends[np.r_[first[1:], len(la)] - 1] - 1]].tolist()
            whole = text.tobytes().decode()
            for i, a, b in zip(mine.tolist(), cut, cut[1:]):
                out[i] = whole[a : b - 1]
        return out


def _chunk_row(batch: pa.RecordBatch, row: int) -> tuple[pa.Array, np.ndarray, np.ndarray, Aligned | None]:
    """ids, where the documents' segments begin, the segments in order, and the chunk's distinct ones."""
    ids, counts = batch.column("ids").slice(row, 1).flatten(), batch.column("counts").slice(row, 1).flatten().to_numpy(zero_copy_only=False)
    bounds, at = np.r_[0, np.cumsum(counts)], _unpacked(batch.column("at")[row].as_py())
    codes: list = [b""] * (int(at.max()) + 1 if len(at) else 0)
    for blob in batch.column("found").slice(row, 1).flatten().to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(raw[:4], "little")
        pos, length = np.frombuffer(raw, "<i4", n, 4), np.frombuffer(raw, "<i4", n, 4 + 4 * n)
        ends = (4 + 8 * n + np.cumsum(length)).tolist()
        for p, a, b in zip(pos.tolist(), [4 + 8 * n, *ends], ends):
            codes[p] = raw[a:b]
    return ids, bounds, at, Aligned(codes) if codes else None


def _some_documents(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of documents of about SLICE segments each."""
    out, a, n = [], 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE, "right")) - 1)
        out.append((a, min(b, n)))
        a = out[-1][1]
    return out


def _good(seg: Aligned, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Documents all of whose segments both tokenizers leave as they are."""
    return np.diff(np.r_[0, np.cumsum(~seg.ok[at])][bounds - bounds[0]]) == 0


def _pairs_in_documents(full: DataFrame) -> DataFrame:
    """chunk, pair, n: in how many of a chunk's documents ids are linked (a pair: first id * 2**32 + second id)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                _, bounds, at, seg = _chunk_row(batch, row)
                if seg is None:
                    continue
                values, place = np.unique(seg.pair, return_inverse=True)
                most = max(len(values), 1)
                mine = np.unique(seg.seg.astype(np.int64) * most + place)  # each segment's pairs once
                seg.pair = seg.seg = seg.times = place = None
                size = np.bincount(mine // most, minlength=seg.n)
                begin, n = np.cumsum(size) - size, np.zeros(len(values), np.int64)
                mine = (mine % most).astype(np.int32)
                for a, b in _some_documents(bounds):
                    here = at[bounds[a] : bounds[b]]
                    doc = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                    keep = _good(seg, here, bounds[a : b + 1])[doc]
                    held = np.unique(doc[keep] * seg.n + here[keep])
                    cost, start = np.cumsum(size[held % seg.n]), 0
                    while start < len(held):
                        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + (1 << 20), "right")))
                        while stop < len(held) and held[stop] // seg.n == held[stop - 1] // seg.n:
                            stop += 1
                        part, which = held[start:stop] // seg.n, held[start:stop] % seg.n
                        both = np.unique(np.repeat(part, size[which]) * most + mine[ragged(begin[which], size[which])])
                        n += np.bincount(both % most, minlength=len(values))
                        start = stop
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch.column("chunk")[row].as_py()), pa.int64()), pa.array(values[some], pa.int64()), pa.array(n[some], pa.int64())], names=["chunk", "pair", "n"])

    return full.mapInArrow(lean(run), "chunk long, pair long, n long")


@contextmanager
def _own_shuffles_go(spark):
    """Each write inside deletes its shuffle files when it ends: what it wrote is what later steps read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _composed(full: DataFrame, kind: str, shared=None) -> DataFrame:
    """id, SUMS and groups of every document. The pairs' counts are broadcast (shared: pair in order, n, best) or stand in
    the chunk's row (column stats)."""

    def counted(batch, row):
        if shared is not None:
            return shared.value
        stats = batch.column("stats").slice(row, 1).flatten()
        if not len(stats):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        pair, n, best = (x.to_numpy(zero_copy_only=False) for x in stats.flatten())
        order = np.argsort(pair)
        return pair[order], n[order], best[order]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, bounds, at, seg = _chunk_row(batch, row)
                own: dict = {}
                if seg is not None:
                    pair, n, best = counted(batch, row)
                    place = np.minimum(np.searchsorted(pair, seg.pair), max(len(pair) - 1, 0))
                    real = pair[place] == seg.pair if len(pair) else np.zeros(len(seg.pair), bool)  # others are in no document that counts
                    add = lambda w: np.bincount(seg.seg[real], weights=w, minlength=seg.n).astype(np.int64)
                    own = {**seg.sizes, "n_best": add(seg.times[real] * best[place[real]]), "count_sum": add(seg.times[real] * n[place[real]])}
                    del pair, n, best, place, real
                    seg.pair = seg.seg = seg.times = None
                    texts = seg.texts()
                for a, b in _some_documents(bounds):
                    here, ends = at[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                    sums, said = {x: np.zeros(b - a, np.int64) for x in SUMS}, [""] * (b - a)
                    if len(here):
                        good = _good(seg, here, bounds[a : b + 1])
                        sums = {x: np.where(good, np.diff(np.r_[0, np.cumsum(own[x][here])][ends]), 0) for x in SUMS}
                        for i in np.flatnonzero(good & (np.diff(ends) > 0)).tolist():
                            said[i] = ";".join(map(texts.__getitem__, here[ends[i] : ends[i + 1]].tolist()))
                    step = max(1, (b - a) // 8)
                    for k in range(0, b - a, step):
                        yield pa.RecordBatch.from_arrays([ids.slice(a + k, min(step, b - a - k)), *(pa.array(sums[x][k : k + step]) for x in SUMS), pa.array(said[k : k + step], pa.string())], names=["id", *SUMS, "groups"])

    return full.mapInArrow(lean(run), f"id {kind}, {', '.join(f'{x} long' for x in SUMS)}, groups string")


def align_tokenizers(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MAX_PAIRS) -> DataFrame:
    """Aligns the tokens of a byte-level tokenizer (of a space and the text) and a sentencepiece one (of the text, to
    which it adds the space) in every whole text: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Where tokens of both end is a cut; between cuts stands a group, `a1,a2|b1` in groups, groups parted by `;`. All pairs
    of a token of the first and one of the second in a group are linked. An id pair's count is the number of documents
    in the whole table that hold it linked; count_sum adds the counts of a document's links, n_best counts the links
    whose count is the highest of their first id in the table, ties included. Strings of special tokens are plain text.

    Null and empty texts, and texts that either tokenizer changes (a literal U+2581), have no tokens: zeros and empty
    groups. Ids may be null or repeated: each row is a document. An empty table gives no rows; other columns are not
    read. Very long texts are chunks by themselves. Equal segments are told by their bytes.
    A chunk's row is bounded by CHUNK_BYTES and CHUNK_SEGMENTS or by one document.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    with open(second_path, "rb") as f:
        model = f.read()
    with open(first_path, encoding="utf-8") as f:
        spec = f.read()
    _pair(spec, model)  # raises here if the tokenizers do not allow the cuts
    spec, model = spark.sparkContext.broadcast(spec), spark.sparkContext.broadcast(model)
    at = f"{shared_dir(spark)}/align-chunks-{uuid.uuid4().hex}"
    both = _chunks(docs, id_col, text_col)
    both.write.partitionBy("kind").parquet(at)
    rows = spark.read.schema(both.schema).parquet(at)
    chunks, asked = rows.where("kind = 'documents'").select("chunk", "ids", "counts", "at"), rows.where("kind = 'segments'").select("chunk", "segs")
    with _own_shuffles_go(spark):
        blobs = stash(_aligned(asked, spec, model), "align-segments")
    unstash_at(spark, f"{at}/kind=segments")

    def full():
        found = blobs.groupBy(F.col("chunk").alias("__chunk")).agg(F.collect_list("blob").alias("found"))
        return chunks.join(found, F.col("chunk") == F.col("__chunk"), "left").drop("__chunk")

    with _own_shuffles_go(spark):
        pairs = stash(_pairs_in_documents(full()).groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    first = F.expr("shiftright(pair, 32)")
    top = pairs.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    ranked = pairs.join(top, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    if pairs.count() <= most_pairs:
        known = ranked.toArrow()
        order = np.argsort(known["pair"].to_numpy())
        shared = spark.sparkContext.broadcast(tuple(known[c].to_numpy()[order] for c in ("pair", "n", "best")))
        out = _composed(full(), kind, shared)
    else:  # a chunk's pairs are bounded by its size
        wanted = _pairs_in_documents(full()).select("chunk", F.col("pair").alias("__pair")).join(ranked, F.col("__pair") == F.col("pair"))
        stats = wanted.groupBy(F.col("chunk").alias("__c")).agg(F.collect_list(F.struct("pair", "n", "best")).alias("stats"))
        out = _composed(full().join(stats, F.col("chunk") == F.col("__c"), "left").drop("__c"), kind)
    return out.withColumnRenamed("id", id_col)


def op11_alignment(spark, sf_dir):
    out = align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_LEVEL), tokenizer_path(PIECES))
    return out.select("doc_id", *SUMS, F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
