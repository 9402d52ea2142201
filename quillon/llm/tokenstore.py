"""Content-addressed token store: rolling-hash chunks stored once, document recipes, Merkle manifests.

Files under one folder: `chunks` (chunk hash, payload; each chunk once) and `recipes` (documents in
ascending id order: the hashes and lengths of their chunks, the start of their ids in the whole stream,
their Merkle root), both Parquet, and `manifest` (of each recipe shard the number of documents and the Merkle
root over its recipes), which every reader holds against the recipes.
A payload is a width byte (2 or 4) and the Zstandard-compressed ids, little-endian.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.bpe import SegmentTable, tokenizer_path
from quillon.llm.common import lean, shared_dir, slices, table, text_bytes, unstash_at
from quillon.llm.kernels import LOWERED, MULT, mix, segments

TOKENIZER, END_ID = "word_bpe_49k.json", 2
WINDOW, MASK, LONGEST = 8, 511, 4096  # ids a rolling hash sees; 512 ids a chunk in the mean; longest chunk


def cuts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all documents (bounds: their limits in ids). A cut depends only on the ids
    before it in its document, so equal documents and long equal passages have equal chunks."""
    ends = bounds[1:][bounds[1:] > bounds[:-1]]
    if len(ids) >= WINDOW:
        g = mix(ids.astype(np.uint64) + np.uint64(1))
        roll = np.zeros(len(ids) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            roll += g[k : len(roll) + k] * MULT[k]
        at = np.flatnonzero((mix(roll) & np.uint64(MASK)) == 0) + WINDOW
        doc = np.searchsorted(bounds, at, "left") - 1
        ends = np.unique(np.r_[ends, at[at - bounds[doc] >= WINDOW]])
    sizes = np.diff(np.r_[0, ends])
    if len(sizes) and sizes.max() > LONGEST:
        ends = np.unique(np.concatenate([ends, *(np.arange(e - s + LONGEST, e, LONGEST) for e, s in zip(ends, sizes) if s > LONGEST)]))
    return ends


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary tree; a last odd node moves up as it is; no leaf: the hash of nothing."""
    level = list(hashes) or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Fold:
    """merkle() of hashes that come one by one, with the roots of whole subtrees alone in memory."""

    def __init__(self):
        self.n, self.roots = 0, []

    def add(self, h: bytes) -> None:
        n = self.n
        while n & 1:
            h, n = hashlib.blake2b(self.roots.pop() + h, digest_size=16).digest(), n >> 1
        self.roots.append(h)
        self.n += 1

    def root(self) -> bytes:
        if not self.roots:
            return merkle([])
        *rest, out = self.roots
        for h in reversed(rest):
            out = hashlib.blake2b(h + out, digest_size=16).digest()
        return out


def pack(ids: np.ndarray, press) -> bytes:
    wide = len(ids) and ids.max() > 65535
    return (b"\4" if wide else b"\2") + press(ids.astype("<u4" if wide else "<u2").tobytes())


def unpack(payload: bytes, expand) -> np.ndarray:
    return np.frombuffer(expand(payload[1:]), "<u4" if payload[0] == 4 else "<u2").astype("<u4")


# Fixed value: the pre-split pattern of tokenizers that lower-case and drop white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
IS_MARK = np.zeros(256, bool)
IS_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_segments(data: np.ndarray, doc_starts: np.ndarray):
    """Segments for a tokenizer that lower-cases and drops white space: cut also where an ASCII mark follows
    an ASCII letter, without the space or line feed before them, A-Z lower-cased. A letter before a
    character beyond ASCII stays, as both may compose. Text with `<|`, in which special tokens may stand,
    is cut like any other tokenizer's."""
    starts = segments(data, doc_starts)
    at = np.flatnonzero(data[:-1] == 60)
    if (data[at + 1] == 124).any():
        return data, starts, starts, np.r_[starts[1:], len(data)]
    cut = np.r_[False, IS_LETTER[data[:-1]] & IS_MARK[data[1:]]]
    cut[starts] = True
    starts = np.flatnonzero(cut)
    ends = np.r_[starts[1:], len(data)]
    plain = np.r_[data[1:] < 128, True]
    return np.where(plain, LOWERED[data], data), starts, starts + ((data[starts] == 32) | (data[starts] == 10)), ends


def splits_words(spec: dict) -> bool:
    """Does the tokenizer (by its parsed file) treat word_segments one by one? Others get whole texts."""
    parts = lambda x, many: (x or {}).get(many, [x] if x else [])
    normal = [(n["type"], n.get("pattern"), n.get("content")) for n in parts(spec.get("normalizer"), "normalizers")]
    split = [p for p in parts(spec.get("pre_tokenizer"), "pretokenizers")]
    return (
        all(n[0] in ("NFC", "Lowercase") or n == ("Replace", {"Regex": r"\s+"}, " ") for n in normal)
        and [p["type"] for p in split] == ["Split", "ByteLevel"]
        and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True)
        and not split[1]["add_prefix_space"]
        and all("<|" in t["content"] for t in spec.get("added_tokens", []))
    )


def whole_texts(data: np.ndarray, doc_starts: np.ndarray):
    return data, doc_starts, doc_starts, np.r_[doc_starts[1:], len(data)]


def library_coder(spec: str) -> SegmentTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    run = getattr(t, "encode_batch_fast", t.encode_batch)
    special = next((x for x in t.get_added_tokens_decoder().items() if not x[1].normalized and not x[1].single_word), None)

    if not splits_words(json.loads(spec)):
        special = None

    def encode_pieces(many: list[bytes]) -> list[list[int]]:
        """A special token parts pieces, of which many make one text; the library treats what is between
        special tokens as texts of their own. Pieces with a special token's first letter go alone."""
        if special is None:
            return [e.ids for e in run([p.decode("utf-8", "replace") for p in many], add_special_tokens=False)]
        out: list = [None] * len(many)
        mark, between = special[1].content.encode(), []
        alone = [i for i, p in enumerate(many) if b"<" in p]
        for i, e in zip(alone, run([many[i].decode("utf-8", "replace") for i in alone], add_special_tokens=False)):
            out[i] = e.ids
        rest = [i for i, p in enumerate(many) if b"<" not in p]
        groups = [rest[k : k + 256] for k in range(0, len(rest), 256)]
        texts = [mark.join(many[i] for i in g).decode("utf-8", "replace") for g in groups]
        for g, e in zip(groups, run(texts, add_special_tokens=False)):
            ids = e.ids
            between = [-1, *(k for k, x in enumerate(ids) if x == special[0]), len(ids)]
            if len(between) != len(g) + 1:
                raise ValueError("the tokenizer's special token does not part texts")
            for i, a, b in zip(g, between, between[1:]):
                out[i] = ids[a + 1 : b]
        return out

    return SegmentTable(encode_pieces, cut=word_segments if splits_words(json.loads(spec)) else whole_texts)


@lru_cache(maxsize=1)
def remembered(spec: str) -> SegmentTable:
    """A worker's coder, kept for its later tasks: the tokenizer and a table of bounded size."""
    return library_coder(spec)


RAW = "kind string, key binary, id {kind}, n_tokens long, hashes array<binary>, sizes array<int>, payload binary"
RECIPE = "id {kind}, row long, start long, n_tokens long, hashes array<binary>, sizes array<int>, root binary, shard int"


def write_store(docs: DataFrame, path: str, end_id: int = END_ID, id_col="doc_id", text_col="text", folder: str | None = None) -> str:
    """Encode every whole text, append the end id and write the store; returns its folder.

    A null or empty text is the end id alone. Ids of rows may repeat; null ids come first. Other columns
    are not read. Each task emits a chunk once for each hash it meets; the chunks' rows are shuffled by
    hash, where one of each stays, so no group of copies meets in one task. A recipe's key follows from its
    row and partition alone, so a task that runs again sends it to the same place. Raises if the store has
    more or fewer recipes than there are rows.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    spec = spark.sparkContext.broadcast(open(path, encoding="utf-8").read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = remembered(spec.value)
        part = TaskContext.get().partitionId().to_bytes(8, "little")
        press, met = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for a, b in slices(off):
                ids, counts = coder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                bounds = np.r_[0, np.cumsum(counts + 1)]
                full = np.full(bounds[-1], end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(b - a), counts)] = ids
                ends = cuts(full, bounds)
                begins = np.r_[0, ends[:-1]]
                raw, hashes, new = full.astype("<u4").tobytes(), [], []
                for s, e in zip(begins.tolist(), ends.tolist()):
                    h = hashlib.blake2b(raw[4 * s : 4 * e], digest_size=16).digest()
                    hashes.append(h)
                    if h not in met:
                        met.add(h)
                        new.append((h, pack(full[s:e], press)))
                if len(met) > 200_000:
                    met.clear()
                first = np.searchsorted(begins, bounds)
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, t))
                n = b - a
                none = lambda t, m: pa.nulls(m, t)
                names = ["kind", "key", "id", "n_tokens", "hashes", "sizes", "payload"]
                # a recipe's key is a hash of partition, id and chunks, so recipes spread over the tasks; the row's
                # place plays no part, as rows of a recomputed partition may come in another order
                docs_of = zip(batch.column(0).slice(a, n).to_pylist(), first.tolist(), first[1:].tolist())
                own = [hashlib.blake2b(b"r" + part + b"".join(hashes[s:e]) + repr(i).encode(), digest_size=16).digest() for i, s, e in docs_of]
                yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * n), pa.array(own, pa.binary()), batch.column(0).slice(a, n), pa.array(counts + 1, pa.int64()), lists(hashes, pa.binary()), lists((ends - begins).astype(np.int32), pa.int32()), none(pa.binary(), n)], names=names)
                m = len(new)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * m), pa.array([h for h, _ in new], pa.binary()), none(batch.column(0).type, m), none(pa.int64(), m), none(pa.list_(pa.binary()), m), none(pa.list_(pa.int32()), m), pa.array([p for _, p in new], pa.binary())], names=names)

    def once(batches):
        last = None
        for b in batches:
            keys, kinds = b.column("key").to_pylist(), b.column("kind").to_pylist()
            stay = []
            for k, what in zip(keys, kinds):
                stay.append(what == "recipe" or k != last)
                last = k
            yield b.filter(pa.array(stay))

    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), RAW.format(kind=kind))
    rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(lean(once), RAW.format(kind=kind)).write.partitionBy("kind").option("compression", "none").parquet(f"{folder}/chunks")
    raw = spark.read.schema(RAW.format(kind=kind)).parquet(f"{folder}/chunks").where("kind = 'recipe'")

    @F.pandas_udf("binary")
    def root(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda x: merkle(list(x)))

    shards = raw.select("id", "n_tokens", "hashes", "sizes", root("hashes").alias("root")).repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    shards.withColumn("shard", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/sorted")
    ordered = spark.read.schema(f"id {kind}, n_tokens long, hashes array<binary>, sizes array<int>, root binary, shard int, row long").parquet(f"{folder}/sorted")
    totals = ordered.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("shard", "base")
    inside = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    starts = ordered.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(totals), "shard")  # one row a shard
    starts.select("id", "row", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "hashes", "sizes", "root", "shard").sortWithinPartitions("row").write.parquet(f"{folder}/recipes")
    unstash_at(spark, f"{folder}/sorted")
    found, rows_in = spark.read.schema(RECIPE.format(kind=kind)).parquet(f"{folder}/recipes").agg(F.count("*")).first()[0], docs.count()
    if found != rows_in:
        raise ValueError(f"the store has {found} recipes of {rows_in} documents")

    shard_roots(spark.read.schema(RECIPE.format(kind=kind)).parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")
    return folder


MANIFEST = "shard int, n long, first long, after long, root binary"


def shard_roots(recipes: DataFrame) -> DataFrame:
    """shard, n, first, after, root: of each recipe shard the documents, the start of its first document's ids and
    the end of its last one's, and the Merkle root over its recipes in row order, each with its id, row, start, number
    of ids and root. Raises where a document's ids do not start at the end of those before it. Narrow hashes are
    shuffled."""

    def leaf(batches):
        for b in batches:
            cols = [b.column(x).to_pylist() for x in ("id", "row", "start", "n_tokens", "root")]
            leaves = [hashlib.blake2b(b"%r %d %d %d " % (i, row, at, n) + r, digest_size=16).digest() for i, row, at, n, r in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("row"), b.column("start"), b.column("n_tokens"), pa.array(leaves, pa.binary())], names=["shard", "row", "start", "n_tokens", "leaf"])

    def fold(batches):
        now, tree, first, at, out = None, Fold(), 0, 0, []
        for b in batches:
            for s, start, n, h in zip(*(b.column(x).to_pylist() for x in ("shard", "start", "n_tokens", "leaf"))):
                if s != now:
                    out.append((now, tree.n, first, at, tree.root()))
                    now, tree, first, at = s, Fold(), start, start
                if start != at:
                    raise ValueError(f"recipe shard {s} differs from the manifest: a start is {start}, not {at}")
                tree.add(h)
                at += n
        out = [x for x in [*out, (now, tree.n, first, at, tree.root())] if x[1]]
        cols = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "n", "first", "after", "root"])

    leaves = recipes.select("id", "row", "start", "n_tokens", "root", "shard").mapInArrow(leaf, "shard int, row long, start long, n_tokens long, leaf binary")
    return leaves.repartition("shard").sortWithinPartitions("shard", "row").mapInArrow(fold, MANIFEST)


def verified_recipes(spark, folder: str, id_type: str) -> DataFrame:
    """The recipes, held against the manifest at once (a missing, doubled or replaced one raises) and against
    their own Merkle roots as they are read."""
    recipes = spark.read.schema(RECIPE.format(kind=id_type)).parquet(f"{folder}/recipes")
    at = 0
    for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("shard", "first", "after").orderBy("shard").collect():  # one row a shard
        if r["first"] != at:
            raise ValueError(f"recipe shard {r['shard']} differs from the manifest: it starts at {r['first']}, not {at}")
        at = r["after"]
    stored = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("shard", F.col("n").alias("want_n"), F.col("root").alias("want"))
    same = F.col("n").eqNullSafe(F.col("want_n")) & F.col("root").eqNullSafe(F.col("want"))
    try:
        wrong = shard_roots(recipes).join(stored, "shard", "full").where(~same).select("shard").first()
    except PythonException as x:
        raise ValueError(f"the recipes differ from the manifest: {x}") from x
    if wrong is not None:
        raise ValueError(f"recipe shard {wrong[0]} differs from the manifest")

    def recipe(batches):
        for b in batches:
            for h, r, i in zip(b.column("hashes").to_pylist(), b.column("root").to_pylist(), b.column("id").to_pylist()):
                if merkle(h) != r:
                    raise ValueError(f"the recipe of {i} is damaged")
            yield b

    return recipes.mapInArrow(recipe, recipes.schema)


def unpack_verified(key: bytes, payload: bytes | None, expand) -> np.ndarray:
    if payload is None:
        raise ValueError(f"chunk {key.hex()} is missing")
    ids = unpack(payload, expand)
    if hashlib.blake2b(ids.tobytes(), digest_size=16).digest() != key:
        raise ValueError(f"chunk {key.hex()} is damaged")
    return ids


def _shift_tables() -> np.ndarray:
    """For each k the images of the 32 bits of a CRC-32 under appending 2**k zero bytes."""
    bits = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    one = np.where(bits & 1, (bits >> np.uint32(1)) ^ np.uint32(0xEDB88320), bits >> np.uint32(1)).astype(np.uint32)
    out = []
    for k in range(40 + 3):
        if k >= 3:
            out.append(one)
        one = _apply(one, one)
    return np.stack(out)


def _apply(tab: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for j in range(32):
        out ^= np.where((x >> np.uint32(j)) & np.uint32(1), tab[j], np.uint32(0)).astype(np.uint32)
    return out


def read_digests(spark, folder: str, id_type: str = "bigint") -> DataFrame:
    """Reads every stored chunk and recipe back and verifies them: id, start, n_tokens, ids_crc32.

    Each chunk's ids are unpacked and must have the hash under which they are stored, each recipe's
    hashes must have its Merkle root, and each shard's recipes the manifest's (checked at once). A document's CRC-32 follows from its chunks' (appending bytes is a
    linear map of a CRC), so narrow rows are shuffled instead of ids. Raises where anything differs.
    """
    tables = spark.sparkContext.broadcast(_shift_tables())

    def verify(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            keys, crc, size = b.column(0).to_pylist(), [], []
            for k, p in zip(keys, b.column(1).to_pylist()):
                raw = unpack_verified(k, p, expand).tobytes()
                crc.append(zlib.crc32(raw))
                size.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(size, pa.int64())], names=["key", "crc", "found"])

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, tail: pd.Series) -> pd.Series:
        x, n = crc.to_numpy().astype(np.uint32), tail.to_numpy(np.int64)
        for k in range(int(n.max()).bit_length() if len(n) else 0):
            at = (n >> k) & 1 == 1
            x[at] = _apply(tables.value[k], x[at])
        return pd.Series(x.astype(np.int64))

    chunks = spark.read.schema(RAW.format(kind=id_type)).parquet(f"{folder}/chunks").where("kind = 'chunk'").select("key", "payload").mapInArrow(verify, "key binary, crc long, found long")
    recipes = verified_recipes(spark, folder, id_type)
    tails = F.expr("transform(sizes, (s, i) -> 4L * (n_tokens - aggregate(slice(sizes, 1, i + 1), 0L, (x, y) -> x + y)))")
    parts = recipes.select("id", "row", "start", "n_tokens", F.explode(F.arrays_zip(F.col("hashes").alias("key"), F.col("sizes").alias("size"), tails.alias("tail"))).alias("c")).select("id", "row", "start", "n_tokens", "c.key", "c.size", "c.tail")
    joined = parts.join(chunks, "key", "left").select("id", "row", "start", "n_tokens", "size", "found", shifted(F.coalesce("crc", F.lit(0)), "tail").alias("crc"))
    out = joined.groupBy("row", "id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("found").alias("found"), F.bool_and(F.col("size").eqNullSafe(F.col("found"))).alias("whole"))
    checked = F.when(F.col("whole"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("long"))
    return out.select("id", "start", F.col("found").alias("n_tokens"), checked.alias("ids_crc32"))


def reconstruct(spark, folder: str, ids: DataFrame | None = None) -> DataFrame:
    """The ids of each document (or of those in `ids`, column id), from chunks and recipes: id, ids.

    Chunks and recipes are verified as by read_digests; raises where one differs or is missing."""
    recipes = verified_recipes(spark, folder, spark.read.parquet(f"{folder}/recipes").schema["id"].dataType.simpleString())
    if ids is not None:
        recipes = recipes.join(ids.select("id").distinct(), "id", "left_semi")
    parts = recipes.select("row", "id", F.posexplode("hashes").alias("pos", "key"))
    chunks = spark.read.parquet(f"{folder}/chunks").where("kind = 'chunk'").select("key", "payload")

    @F.pandas_udf("array<long>")
    def expand(payloads: pd.Series) -> pd.Series:
        run = zstandard.ZstdDecompressor().decompress
        return payloads.map(lambda xs: np.concatenate([unpack_verified(x["key"], x["payload"], run) for x in xs]).astype(np.int64))

    whole = parts.join(chunks, "key", "left").groupBy("row", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "payload"))).alias("parts"))
    return whole.select("id", expand("parts").alias("ids"))


def op4_token_store(spark, sf_dir):
    folder = write_store(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
    return read_digests(spark, folder).withColumnRenamed("id", "doc_id")
