"""Toxicity by compression distance: zstandard dictionaries trained on both classes, calibrated thresholds.

Training reads a bounded sample of labelled rows (MAX_TOXIC and MAX_ORDINARY rows, chosen by a
hash of their id; MAX_WINDOWS windows of each class).  ``zstandard.train_dictionary`` is run on
windows of the toxic texts and on windows of the ordinary texts; words that only one or two texts
of a class hold are left out, as no other text can be recognised by them.  Both compressors begin
with one trained base of ordinary text, so they parse ordinary words alike, and end with what was
trained on toxic text, without the words that ordinary text shares, or on further ordinary text, as
many characters of each.

A scored window is one word with its neighbouring blanks, each character written as a fixed
four-byte code: a shared passage then saves several times the cost of a match.  Its distance is
the length under the ordinary dictionary minus that under the toxic one; a logistic curve turns the
numbers of windows beyond several cuts into a score.  The curve is fitted to a quarter of the sample that trains no
dictionary, measured with the very dictionaries that score: other ones, trained on other rows, measure every text somewhat
higher or lower, which moves the threshold.  If a quarter has fewer than APART rows of a class, the curve is cross-fitted:
each half of the sample is measured with dictionaries trained on the other, texts are scored with those trained on all.
In the fit both classes weigh as among all labels, whatever the bounds left of each.
Everything is ordered by hashes of ids and places, so a model depends on neither partitions nor reruns.

All documents, whole texts, are scored; distances of frequent words are remembered per task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash128, held, pack, settle, small_batches, unpack

#: Bounds of the training sample, in rows of each class.
MAX_TOXIC, MAX_ORDINARY = 6_000, 14_000
#: Windows of each class that train a dictionary, words in one, and the word forms kept as recurring.
MAX_WINDOWS, WINDOW, MAX_FORMS = 100_000, 2, 60_000
#: A word must occur in so many sampled texts of its class to take part, and in so many times the ordinary texts' share to count as toxic text's own.
RECURS, MARKS = 3, 4
#: Bytes of trained text in the common base and in the part of each class; segment and match length of the training.
BASE_BYTES, CLASS_BYTES, SEGMENT, MATCH = 100_000, 16_384, 40, 8
#: Rows of each class that the quarter of the sample must have for a curve of its own.
APART = 300
#: How much more a toxic text of the sample weighs when the curve is fitted.
TOXIC_WEIGHT = 3.0
#: Distances remembered per task.
CACHE = 300_000
#: How both compressors search: optimal parsing, by strategy, in which a match of four characters ends a search.
PARAMETERS = {"window_log": 20, "hash_log": 19, "chain_log": 19, "search_log": 7, "min_match": 4, "target_length": 16, "write_checksum": 0, "write_content_size": 0, "write_dict_id": 0}
_WORD = re.compile(r"[^\W_]+")
_CUTS = (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16)
#: The end of a trained dictionary's tables: its three repeat offsets, before the content.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def trained_text(windows: list[str], size: int) -> str:
    """What a dictionary of ``size`` bytes trained on the windows holds, the most useful text last."""
    import zstandard as zs

    samples = [w.encode("utf-8", "replace") for w in windows]
    if sum(map(len, samples)) <= size:
        return "".join(windows)
    try:
        made = zs.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zs.ZstdError:  # too few samples to choose from
        return "".join(windows)[-size:]
    at = made.find(_OFFSETS)
    return made[at + len(_OFFSETS) if at >= 0 else 0 :].decode("utf-8", "ignore")


class Distance:
    """Compressed length with the ordinary dictionary minus that with the toxic one, by word."""

    def __init__(self, base: str, toxic: str, contrast: str):
        import zstandard as zs

        self.codes: dict[str, bytes] = {}
        self.cache: dict[str, int] = {}
        length = min(len(toxic), len(contrast))
        start = self.expand(base)
        ends, other = self.expand(toxic[len(toxic) - length :]), self.expand(contrast[len(contrast) - length :])
        params = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_BTOPT, **PARAMETERS)
        self._lengths = []
        for end in (other, ends):
            words = zs.ZstdCompressionDict(start + end or b"\0" * 8, dict_type=zs.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            self._lengths.append(zs.ZstdCompressor(dict_data=words, compression_params=params).compress)

    def expand(self, text: str) -> bytes:
        codes = self.codes
        return b"".join([codes.get(c) or codes.setdefault(c, hashlib.md5(c.encode("utf-8", "surrogatepass")).digest()[:4]) for c in text])

    def of(self, word: str) -> int:
        found = self.cache.get(word)
        if found is None:
            window = self.expand(f" {word} ")
            ordinary, toxic = self._lengths
            found = self.cache[word] = len(ordinary(window)) - len(toxic(window))
        return found

    def features(self, text: str) -> list[float]:
        """For each cut, the log of one plus the number of words at or above it; then shares and the mean distance."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        of, found = self.of, _WORD.findall(text.lower())
        distances = np.fromiter(map(of, found), np.int64, len(found))
        counts = np.bincount(np.clip(distances, 0, 63), minlength=64)
        above = counts[::-1].cumsum()[::-1]
        out = [min(1.0, float(above[cut])) for cut in _CUTS]
        out += [math.log1p(float(above[cut])) for cut in _CUTS]
        out += [100.0 * float(above[cut]) / (len(found) + 20.0) for cut in (6, 8, 10)]
        out.append(10.0 * float(distances.sum()) / max(1, len(found)))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, weight: float = TOXIC_WEIGHT, rates: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Newton's method for a ridge logistic regression with an intercept in the last place; rows of class 1 weigh ``weight``.

    ``rates`` are labelled rows for each sampled one, of class 1 and of class 0: the classes weigh as among the labels, their sum stays.
    """
    many = np.where(y > 0, rates[0], rates[1])
    many = np.where(y > 0, weight, 1.0) * many * len(y) / many.sum()
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (many * (p - y)) + penalty * weights
        hessian = (x * (many * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """A model (dictionaries' texts and curve) from a bounded sample of labelled rows.

    ``labels`` are rows of (id, label); several labels of one id count as their largest, null
    labels and ids are left out.  Without both classes the model scores every text by the share
    of toxic rows among the labels, or 0 without labels.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    known = settle(known)
    labelled = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # Both bounds cut the classes differently; without this a larger table would move the curve towards the scarcer class.
    rates = tuple(max(1.0, labelled.get(toxic, 0) / most) for toxic, most in ((True, MAX_TOXIC), (False, MAX_ORDINARY)))
    sample = known.where("toxic").orderBy(*order).limit(MAX_TOXIC).unionByName(known.where("not toxic").orderBy(*order).limit(MAX_ORDINARY))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample has at most MAX_TOXIC + MAX_ORDINARY rows of two short columns.
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    joined = texts.join(F.broadcast(sample), "id")
    # Copies would make the words of one text look like evidence: of rows of one label whose whole
    # texts have the same words, or that share an id, one is learned from.
    same = hash128(F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "))
    joined = joined.withColumns({"s1": same[0], "s2": same[1]}).groupBy("s1", "s2", "toxic").agg(F.min_by(F.struct("id", "text"), F.struct("id", "text")).alias("r")).select("r.*", "toxic")
    joined = joined.groupBy("id").agg(F.min_by(F.struct("text", "toxic"), F.struct("text", "toxic")).alias("r")).select("id", "r.*")
    rows = settle(joined.select("id", "text", "toxic", words.alias("words"), (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(2)) == 0).alias("first"), (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(4)) == 0).alias("apart")))
    drawn = rows.groupBy("toxic", "first", "apart").agg(F.count("*").alias("n")).collect()
    positives, everything = sum(r.n for r in drawn if r.toxic), sum(r.n for r in drawn)
    share = positives / everything if everything else 0.0
    if len({(r.toxic, r.first) for r in drawn}) < 4:
        return {"prior": share}
    if min(sum(r.n for r in drawn if r.apart and r.toxic == t) for t in (True, False)) >= APART:
        of_set, measure_by = {"all": "not apart"}, {"all": "apart"}
    else:  # three sets of training texts: either half, and all
        of_set, measure_by = {"first": "first", "second": "not first", "all": "true"}, {"first": "not first", "second": "first"}
    in_set = {"not apart": lambda r: not r.apart, "first": lambda r: r.first, "not first": lambda r: not r.first, "true": lambda r: True}
    sizes = {(n, t): sum(r.n for r in drawn if r.toxic == t and in_set[c](r)) for n, c in of_set.items() for t in (True, False)}
    sets = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in of_set.items()]))
    size = F.create_map(*[F.lit(x) for (n, t), k in sizes.items() for x in (f"{n}{t}", k)])
    forms = rows.select(F.explode(sets).alias("set"), "toxic", F.explode("words").alias("w")).groupBy("set", "w").agg(*[F.count_if(c).alias(n) for n, c in (("t", F.col("toxic")), ("o", ~F.col("toxic")))])
    rate = lambda n, t: F.col(n) / size[F.concat("set", F.lit(str(t)))]
    parts = {
        "ordinary": (F.col("o") >= RECURS, F.col("o")),
        "toxic": ((F.col("t") >= RECURS) & (rate("t", True) > MARKS * rate("o", False)), F.col("t")),
    }
    forms = settle(forms.where((F.col("t") >= RECURS) | (F.col("o") >= RECURS)))
    # At most MAX_FORMS words a set and part, the most frequent ones, so they may go to every task.
    kept = {(n, part): {r.w for r in forms.where((F.col("set") == n) & test).orderBy(many.desc(), "w").limit(MAX_FORMS).collect()} for n in of_set for part, (test, many) in parts.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, toxic, text, names in zip(*[batch.column(n).to_pylist() for n in ("row", "toxic", "text", "sets")], strict=True):
                found = _WORD.findall(text.lower())
                part = "toxic" if toxic else "ordinary"
                for name in names:
                    some = [w for w in found if w in kept[name, part]]
                    out += [(name, part, row, i, f" {' '.join(some[i : i + WINDOW])} ") for i in range(0, len(some), WINDOW)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["set", "part", "row", "place", "window"])

    small_batches(rows.sparkSession)
    cuts = rows.select(F.xxhash64("id").alias("row"), "toxic", "text", sets.alias("sets")).mapInArrow(cut, "set string, part string, row long, place long, window string")
    cuts = settle(cuts.select("set", "part", F.xxhash64("row", "place").alias("h"), "window"))
    bytes_of = {"toxic": CLASS_BYTES, "base": BASE_BYTES, "contrast": CLASS_BYTES}

    def train(key: tuple, table: pa.Table) -> pa.Table:
        """One dictionary from at most MAX_WINDOWS windows, inside a task."""
        windows = [w for _, w in sorted(zip(table.column("h").to_pylist(), table.column("window").to_pylist(), strict=True))]
        name, part = (k.as_py() for k in key)
        return pa.table({"set": [name], "part": [part], "text": [trained_text(windows, bytes_of[part])]})

    chosen = [cuts.where((F.col("set") == n) & (F.col("part") == part)).orderBy("h", "window").limit(MAX_WINDOWS) for n in of_set for part in parts]
    # Ordinary windows train the base and the ordinary part by turns of their hash.
    part = F.when(F.col("part") == "toxic", "toxic").when(F.pmod("h", F.lit(2)) == 0, "base").otherwise("contrast")
    windows = reduce(DataFrame.unionByName, chosen).withColumn("part", part)
    texts = {(r.set, r.part): r.text for r in windows.groupBy("set", "part").applyInArrow(train, "set string, part string, text string").collect()}
    models = {n: {part: texts.get((n, part), "") for part in bytes_of} for n in of_set}
    measured = []
    for name, other in measure_by.items():
        measured += _measure(rows.where(other).select("id", "toxic", "text"), models[name]).select(F.xxhash64("id").alias("h"), "toxic", "features").collect()
    measured.sort(key=lambda r: (r.h, r.features))
    x = np.array([r.features for r in measured], float)
    y = np.array([r.toxic for r in measured], float)
    return {**models["all"], "prior": share, "curve": _logistic(x, y, rates=rates).tolist()}


def _measure(df: DataFrame, model: dict) -> DataFrame:
    """``df`` without ``text``, with ``features`` of the whole text."""
    small_batches(df.sparkSession)
    words = tuple(model[k] for k in ("base", "toxic", "contrast"))
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "text"], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = held(Distance, *words)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rest = [i for i in range(batch.num_columns) if i != at]
            features = pa.array([distance.features(t.as_py()) for t in batch.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], features], names=[*[batch.schema.field(i).name for i in rest], "features"])

    return df.mapInArrow(run, schema)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= 0.5); null text counts as empty.

    Columns with these names are replaced; every row is kept, repeated ones too.
    """
    names = docs.columns
    packed = pack(docs)
    if "curve" not in model:
        value = F.lit(float(model["prior"]))
    else:
        packed = _measure(packed.withColumn("text", F.coalesce(F.col("row").getField(text_col), F.lit(""))), model)
        logit = F.lit(model["curve"][-1])
        for i, weight in enumerate(model["curve"][:-1]):
            logit = logit + F.lit(weight) * F.get("features", F.lit(i))
        value = 1 / (1 + F.exp(-logit))
    return unpack(packed.withColumn("value", value), names, score=F.col("value"), predicted=(F.col("value") >= 0.5).cast("int"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(~is_held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
