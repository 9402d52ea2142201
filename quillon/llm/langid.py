"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, slices, table, text_bytes

BITS, ORDERS, SMOOTHING = 15, (1, 2, 3), 0.5
MAX_TRAINING_ROWS = 20_000  # documented bound of the sample that the classifier is fitted on
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_tables: dict = {}


def grams(data: np.ndarray, off: np.ndarray, bits: int = BITS):
    """(features of all documents, bounds of each document's, letters of each) for a slice of texts.

    Texts are lower-cased, what is not a letter counts as a space; n-grams do not cross documents, and
    those of spaces alone are left out."""
    if "alpha" not in _tables:
        _tables["alpha"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _tables["alpha"][points]
    bounds = np.r_[0, np.cumsum(size)]
    letters = np.diff(np.r_[0, np.cumsum(alpha)][bounds])
    c = np.where(alpha, points, 32).astype(np.uint64)
    end, at, doc = np.repeat(bounds[1:], size), np.arange(len(c)), np.repeat(np.arange(len(texts)), size)
    found, where = [], []
    for n in ORDERS:
        h, some = np.full(max(0, len(c) - n + 1), n, np.uint64), np.zeros(max(0, len(c) - n + 1), bool)
        for k in range(n):
            h = (h ^ c[k : k + len(h)]) * _ODD[k]
            h ^= h >> np.uint64(29)
            some |= alpha[k : k + len(h)]
        some &= at[: len(h)] + n <= end[: len(h)]
        found.append(((h[some] * _ODD[0]) >> np.uint64(64 - bits)).astype(np.int64))
        where.append(doc[: len(h)][some])
    return found, where, letters


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray):
        self.langs, self.logp, self.prior = langs, logp, prior

    def score(self, data, off):
        """(best class, its posterior) of each text; class -1 where the text has no letter."""
        found, where, letters = grams(data, off)
        sums = np.repeat(self.prior[:, None], len(off) - 1, axis=1)
        for f, w in zip(found, where):
            for k in range(len(self.langs)):
                sums[k] += np.bincount(w, self.logp[k][f], len(off) - 1)
        best = sums.argmax(0)
        p = 1 / np.exp(sums - sums.max(0)).sum(0)
        return np.where(letters > 0, best, -1), np.where(letters > 0, p, 0.0)


def train(labelled: DataFrame, text_col="text", lang_col="lang", key_col="doc_id", max_rows=MAX_TRAINING_ROWS) -> Model | None:
    """Fits on at most about max_rows labelled rows, drawn by a hash of their keys. The counts of classes and
    n-grams are summed by the executors; the matrix of classes x 2**BITS is all that is collected."""
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = labelled.count()
    if not n:
        return None
    share = min(1 << 20, int((1 << 20) * max_rows / n) + 1)
    rows = labelled.where(F.expr(f"pmod(xxhash64(`{key_col}`), {1 << 20}) < {share}")) if n > max_rows else labelled

    def count(batches):
        sums: dict = {}
        for b in batches:
            data, off = text_bytes(b.column(0))
            langs = b.column(1).to_pylist()
            for a, z in slices(off):
                found, where, _ = grams(data[off[a] : off[z]], off[a : z + 1] - off[a])
                for lang in set(langs[a:z]):
                    of = np.fromiter((x == lang for x in langs[a:z]), bool, z - a)
                    got = sums.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                    got[-1] += of.sum()
                    for f, w in zip(found, where):
                        got[:-1] += np.bincount(f[of[w]], minlength=1 << BITS)
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(got[at])], names=["lang", "feature", "n"])

    got = rows.select(text_col, F.col(lang_col).cast("string").alias("lang")).mapInArrow(lean(count), "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(langs), (1 << BITS) + 1))
    counts[np.searchsorted(langs, got["lang"].to_pylist()), got["feature"].to_numpy()] = got["n"].to_numpy()
    f = counts[:, :-1] + SMOOTHING
    return Model(langs, np.log(f / f.sum(1, keepdims=True)), np.log(counts[:, -1] / counts[:, -1].sum()))


def identify(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text", keep: list[str] = ()) -> DataFrame:
    """The language of every whole text: id, the columns in `keep`, lang_pred, score (posterior, 0 to 1).

    A null text, one without a letter, or any text where there is no model: `und` with score 0. Rows are
    judged one by one, so null and repeated ids do not matter; an empty table gives no rows. Columns other
    than the id, the text and `keep` are not read. Only the model is broadcast (classes x 2**15 numbers).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [id_col, *[c for c in keep if c != id_col]]
    at = cols.index(text_col) if text_col in cols else len(cols)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches):
        m = shared.value
        for b in batches:
            data, off = text_bytes(b.column(at))
            for a, z in slices(off):
                best, p = m.score(data[off[a] : off[z]], off[a : z + 1] - off[a]) if m else (np.full(z - a, -1), np.zeros(z - a))
                names = np.array([*(m.langs if m else []), "und"], object)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, z - a) for i in range(len(cols))), pa.array(names[best], pa.string()), pa.array(p, pa.float64())], names=[*cols, "lang_pred", "score"])

    return docs.select(*cols, *[text_col][at < len(cols) :]).mapInArrow(lean(run), f"{kinds}, lang_pred string, score double")


def held_out(id_col="doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame) -> Model | None:
    return train(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train_on(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
