"""Near-duplicate documents by order min-hash, verified by banded alignment.

Words are lower-cased.  Equal word sequences form a class first, so a group of copies is one
node however large.  A sketch takes, for each of TABLES hashes, the PICKS smallest three-word
shingles labelled with their occurrence and keeps their order in the text: it agrees more often
the smaller the edit distance; the tables follow from the recall at the threshold.  Short texts
have too few shingles for that and add exact segments (``short_keys``).  Classes that agree in a table share a bucket; there each is
compared with one hub, the bucket's least node.  Buckets that then still hold several components
are cut into blocks, which meet pairwise unless both belong to the bucket's largest component: every pair of different components is compared unless its
lengths or words rule a link out.  A pair is linked if the edit similarity of the whole texts, 1 - distance / longer length in words, is at least SIMILARITY; the alignment runs
bit-parallel inside the band that such a similarity allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pack, settle, small_batches, unpack
from .components import components
from .substring import Roller, _mix

SHINGLE = 3
SIMILARITY = 0.8
PICKS = 2
#: The chance of sharing a bucket at the threshold, with scattered edits of a long text.
RECALL = 0.998
#: Texts of at most so many words also meet by exact segments, which find every pair.
SHORT = 32
#: Classes of a block of a bucket; bins in which their words are counted.
BLOCK, BINS = 512, 256
#: Tasks that share the classes of one component.
SALTS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def plan_tables(least: float = SIMILARITY, recall: float = RECALL, shingle: int = SHINGLE, picks: int = PICKS) -> int:
    """Tables so that a pair at ``least`` shares a bucket with a probability of ``recall``."""
    intact = least**shingle
    return math.ceil(math.log(1 - recall) / math.log(1 - (intact / (2 - intact)) ** picks))


TABLES = plan_tables()


def short_keys(hashes: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Signatures of a text of at most SHORT words: any two that are similar enough share one.

    With at most k edits, one of k + 1 segments of the longer text is left whole in the shorter
    one, moved by no more than the edits before and after it allow.
    """
    m, found = len(hashes), set()
    for n in range(m, min(SHORT, math.floor(m / least + 1e-9)) + 1):
        edits = math.floor((1 - least) * n + 1e-9)
        if not edits or n - m > edits:
            continue
        for i in range(edits + 1):
            start, end = i * n // (edits + 1), (i + 1) * n // (edits + 1)
            for at in range(max(0, start - edits), min(m - end + start, start + edits) + 1):
                if abs(at - start) + abs(at - start + n - m) <= edits:
                    found.add(xxhash.xxh3_64_intdigest(hashes[at : at + end - start].tobytes(), n * (SHORT + 1) + i))
    return np.array(sorted(found), np.uint64)


def sketch(roller: Roller, words: list[bytes], tables: int = TABLES, picks: int = PICKS, shingle: int = SHINGLE) -> np.ndarray:
    """The signatures of a text with at least one word, one for each table."""
    hashes = roller.of_words(words)
    grams = roller.runs(hashes, min(shingle, len(hashes)))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    starts = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
    if len(starts) == len(grams):
        labelled = _mix(grams)
    else:
        occurrence = np.arange(len(grams)) - np.repeat(starts, np.diff(starts, append=len(grams)))
        labelled = np.empty_like(grams)
        labelled[order] = _mix(ranked + occurrence.astype(np.uint64) * _ODD)
    picks = min(picks, len(grams))
    factors = _mix(np.arange(1, tables + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    at = np.empty((tables, picks), np.int64)
    step = max(1, (1 << 19) // len(grams))
    for start in range(0, tables, step):
        values = labelled * factors[start : start + step, None]
        rows = np.arange(len(values))
        for pick in range(picks):
            at[start : start + step, pick] = least = values.argmin(axis=1)
            values[rows, least] = _MOST
    at.sort(axis=1)
    signatures = np.arange(tables, dtype=np.uint64)
    for pick in range(picks):
        signatures = _mix((signatures ^ labelled[at[:, pick]]) * _ODD)
    return signatures


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """The edit distance of two sequences, or limit + 1 if it is larger; work stays in the band.

    Bit t of the vertical differences stands for row j - band + t of column j; the window moves
    down one row a column.  Cells outside the band count as one more than their neighbour, which
    never underrates, and a path of cost ``limit`` cannot leave the band.
    """
    if len(a) < len(b):
        a, b = b, a
    shared = min(len(a), len(b))
    same = a[:shared] == b[:shared]
    start = shared if same.all() else int(same.argmin())
    a, b = a[start:], b[start:]
    shared = min(len(a), len(b))
    if shared:
        same = (a[len(a) - shared :] == b[len(b) - shared :])[::-1]
        end = shared if same.all() else int(same.argmin())
        a, b = a[: len(a) - end], b[: len(b) - end]
    rows, columns = len(a), len(b)
    skew = rows - columns
    if skew > limit:
        return limit + 1
    if columns == 0:
        return rows
    band = (limit - skew) // 2 + 1
    width = 2 * band + skew + 1
    full, top, watched = (1 << width) - 1, 1 << (width - 1), 1 << (band + skew)
    masks: dict[int, int] = {}
    for row, word in enumerate(a.tolist()):
        masks[word] = masks.get(word, 0) | 1 << (row + band)
    # In column 1 the window starts at row 1 - band; rows above the first have no differences.
    plus, minus, cost = full & ~((1 << band) - 1), 0, skew
    # Along a diagonal distances never fall, so the watched one may end the work early.
    for j, word in enumerate(b.tolist()):
        equal = masks.get(word, 0) >> j & full
        zero = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        right_plus = (minus | ~(zero | plus)) & full
        right_minus = zero & plus
        if not zero & watched:
            cost += 1
            if cost > limit:
                return limit + 1
        right_plus = right_plus << 1 | 1
        right_minus <<= 1
        plus = (right_minus | ~(zero | right_plus)) & full
        minus = right_plus & zero & full
        plus = plus >> 1 | top
        minus >>= 1
    return cost


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - distance / longer length, or 0.0 when below ``least``."""
    longer = max(len(a), len(b))
    limit = int(np.floor((1 - least) * longer + 1e-9))
    distance = edit_distance(a, b, limit)
    return 1 - distance / longer if distance <= limit else 0.0


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def _id_of(words: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64))


def sketches(rows: DataFrame, tables: int, picks: int, shingle: int, least: float = SIMILARITY) -> DataFrame:
    """``rows`` (any columns and ``text``) without the text; node and signatures (null: no words)."""
    rest = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType(list(rest)).add("node", "long").add("n_words", "integer").add("signatures", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            made = []
            for text in batch.column("text"):
                words = _words(text.as_py())
                if not words:
                    made.append((None, 0, None))
                    continue
                signatures = sketch(roller, words, tables, picks, shingle).tobytes()
                if len(words) <= SHORT:
                    signatures += short_keys(roller.of_words(words), least).tobytes()
                made.append((_id_of(words), len(words), signatures))
            new = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)] if made else []
            keep = [batch.column(f.name) for f in rest]
            if new:
                yield pa.RecordBatch.from_arrays([*keep, *new], names=schema.names)

    return rows.mapInArrow(run, schema)


def _exploded(classes: DataFrame) -> DataFrame:
    """(bucket, node, n_words) from (node, n_words, signatures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = batch.column("signatures").to_pylist()
            counts = [len(x) // 8 for x in signatures]
            nodes = np.repeat(batch.column("node").to_numpy(), counts)
            sizes = np.repeat(batch.column("n_words").to_numpy(), counts)
            buckets = np.frombuffer(b"".join(signatures), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(nodes), pa.array(sizes)], names=["bucket", "node", "n_words"])

    return classes.select("node", "n_words", "signatures").mapInArrow(run, "bucket long, node long, n_words int")


def _word_codes(rows: DataFrame) -> DataFrame:
    """(node, codes, bag): a text's lower-cased words as 32-bit hashes, four bytes each, and
    how many fall into each of BINS bins, at most 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            codes = [roller.of_words(_words(t.as_py())).astype("<u4") for t in batch.column("text")]
            bags = [np.minimum(np.bincount(c % BINS, minlength=BINS), 255).astype(np.uint8).tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(bags, pa.binary())], names=["node", "codes", "bag"])

    return rows.select("node", "text").mapInArrow(run, "node long, codes binary, bag binary")


def _verified(pairs: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that are similar enough."""
    first = codes.select(F.col("node").alias("a"), F.col("codes").alias("codes_a"))
    second = codes.select(F.col("node").alias("b"), F.col("codes").alias("codes_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, x, y in zip(*[batch.column(n).to_pylist() for n in ("a", "b", "codes_a", "codes_b")], strict=True):
                value = edit_similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least)
                if value:
                    found.append((a, b, value))
            a, b, value = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.float64())], names=["a", "b", "similarity"])

    return pairs.join(first, "a").join(second, "b").mapInArrow(run, "a long, b long, similarity double")


def _alike(one: Column, two: Column, least: float) -> Column:
    """Whether two lengths allow an edit similarity of ``least``."""
    return F.least(one, two) >= F.lit(least) * F.greatest(one, two) - F.lit(1e-6)


def links(docs_with_key: DataFrame, found: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) verified links between classes from the settled sketches, and (node, component).

    First each class meets the least node of each of its buckets.  Then the classes of a bucket
    that still lie in different components meet in blocks, so that every pair that shares a bucket
    and is similar enough ends in one component.
    """
    classes = found.where("signatures IS NOT NULL").groupBy("node")
    classes = settle(classes.agg(F.first("signatures").alias("signatures"), F.first("n_words").alias("n_words"), F.min(F.struct("k1", "k2")).alias("key")))
    members = _exploded(classes)
    hubs = members.groupBy("bucket").agg(F.min(F.struct("node", "n_words")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    members = settle(members.join(hubs, "bucket").select("bucket", "node", "n_words", F.col("hub.node").alias("a"), F.col("hub.n_words").alias("hub_words")))
    involved = members.select("node").distinct().join(classes.select("node", "key"), "node")
    chosen = involved.select("node", "key.k1", "key.k2")
    # Rows equal in every column share a key: one of them speaks for the class.
    codes = settle(_word_codes(docs_with_key.join(chosen, ["k1", "k2"])).dropDuplicates(["node"]))
    tested = settle(members.where("node <> a").where(_alike(F.col("n_words"), F.col("hub_words"), least)).select("a", F.col("node").alias("b")).distinct())
    edges = settle(_verified(tested, codes, least).select("a", "b"))
    named = components(edges)
    new = settle(_further(members.select("bucket", "node", "n_words", F.col("a").alias("hub")), named, classes, codes, least))
    return settle(edges.unionByName(new)), _merged(named, new)


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components, with ``component_a`` and ``component_b``."""
    for end in ("a", "b"):
        of = named.select(F.col("node").alias(end), F.col("component").alias("found"))
        pairs = pairs.join(of, end, "left").withColumn(f"component_{end}", F.coalesce("found", end)).drop("found")
    return pairs.where("component_a <> component_b")


def _merged(named: DataFrame, new: DataFrame) -> DataFrame:
    """``named`` (node, component) after the further links ``new`` (a, b)."""
    joint = _apart(new, named).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    merged = components(joint).select(F.col("node").alias("old"), F.col("component").alias("merged"))
    fresh = new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    return settle(named.unionByName(fresh).join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("merged", "component").alias("component")))


def _dealt(parts: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of the parts with several components, with ``block`` and, for each block that it meets, ``other``.

    A part of more than ``size`` rows has blocks of its largest component and blocks of the rest.  The former
    meet the latter only, as their own rows are joined already; the latter meet all.  So a part of one large
    component and a few other rows grows by those few, not by its square.
    """
    counts = parts.groupBy("bucket", "part", "component").agg(F.count("*").alias("m"))
    mixed = counts.groupBy("bucket", "part").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("components")).where("components > 1")
    split = F.col("n") > size
    among = F.ceil(F.when(split, F.col("n") - F.col("most.m")).otherwise(F.col("n")) / size).cast("int")
    mixed = mixed.select("bucket", "part", F.when(split, F.col("most.component")).alias("largest"), among.alias("rest"), F.when(split, F.ceil(F.col("most.m") / size)).otherwise(0).cast("int").alias("more"))
    blocks = parts.join(mixed, ["bucket", "part"]).withColumn("inside", F.coalesce(F.col("component") == F.col("largest"), F.lit(False)))
    hashed = F.xxhash64("node")
    block = F.when(F.col("inside"), F.col("rest") + F.pmod(hashed, F.greatest("more", F.lit(1)))).otherwise(F.pmod(hashed, F.col("rest"))).cast("int")
    last = F.col("rest") - 1 + F.when(F.col("inside"), 0).otherwise(F.col("more"))
    blocks = blocks.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return blocks.drop("largest", "rest", "more", "inside")


def _further(members: DataFrame, named: DataFrame, classes: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """(a, b): further links, enough to join all classes of a bucket that similar pairs connect.

    A bucket splits by length into overlapping pairs of neighbouring bands, as lengths further
    apart rule a link out, and a part into blocks of about BLOCK classes (``_dealt``).  A pair
    is aligned in its least common bucket only, unless it was tested with the hub, is joined already
    or has too few words in common.  Links leave a task, never pairs: fewer than a block has classes.
    """
    band = F.floor(F.log(F.col("n_words").cast("double")) / F.log(F.lit(1 / least + 1e-4))).cast("int")
    joined = members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("band", band)
    parts = settle(joined.withColumn("part", F.explode(F.array(F.col("band") - 1, F.col("band")))))
    blocks = _dealt(parts)
    blocks = blocks.select(
        F.xxhash64("bucket", "part", F.least("block", "other"), F.greatest("block", "other")).alias("at"),
        (F.col("block") < F.col("other")).alias("first"),
        (F.col("block") == F.col("other")).alias("own"),
        (F.col("band") > F.col("part")).alias("upper"),
        *["bucket", "hub", "node", "n_words", "component"],
    )
    # A task holds the texts of one pair of blocks at a time, however large the bucket.
    texts = codes.join(classes.select("node", "signatures"), "node")
    ready = blocks.join(texts, "node").repartition("at").sortWithinPartitions("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            at = batch.column("at").to_numpy()
            cuts = np.flatnonzero(np.diff(at)) + 1
            starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(at)]
            if held and len(at) and held[-1].column("at")[0].as_py() != at[0]:
                yield from _block_links(held, least)
                held = []
            for start, end in zip(starts, ends, strict=True):
                if start:
                    yield from _block_links(held, least)
                    held = []
                if end > start:
                    held.append(pa.Table.from_batches([batch.slice(start, end - start)]))
        yield from _block_links(held, least)

    return ready.mapInArrow(run, "a long, b long")


def _block_links(held: list[pa.Table], least: float) -> Iterator[pa.RecordBatch]:
    """The links between two blocks, or inside one, that join what is not yet joined."""
    if not held or sum(map(len, held)) < 2:
        return
    rows = pa.concat_tables(held)
    node, size, component, hub = (rows.column(n).to_numpy() for n in ("node", "n_words", "component", "hub"))
    first, own, upper = (rows.column(n).to_numpy() for n in ("first", "own", "upper"))
    bucket = rows.column("bucket")[0].as_py()
    codes = [np.frombuffer(c, "<u4") for c in rows.column("codes").to_pylist()]
    signatures = [np.frombuffer(x, np.int64) for x in rows.column("signatures").to_pylist()]
    bags = np.frombuffer(b"".join(rows.column("bag").to_pylist()), np.uint8).reshape(len(node), BINS)
    beyond = size - bags.sum(axis=1, dtype=np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    left, right = np.flatnonzero(first | own), np.flatnonzero(~first | own)
    found = []
    for start in range(0, len(left), 64):
        some = left[start : start + 64]
        apart = component[some][:, None] != component[right][None, :]
        # Two of the upper band meet in the next part.
        apart &= ~(upper[some][:, None] & upper[right][None, :])
        longer = np.maximum(size[some][:, None], size[right][None, :])
        apart &= np.minimum(size[some][:, None], size[right][None, :]) >= least * longer - 1e-6
        if own[0]:
            apart &= node[some][:, None] < node[right][None, :]
        i, j = np.nonzero(apart)
        i, j = some[i], right[j]
        fine = (node[i] != hub[0]) & (node[j] != hub[0])
        i, j = i[fine], j[fine]
        longer = np.maximum(size[i], size[j])
        shared = np.minimum(bags[i], bags[j]).sum(axis=1, dtype=np.int64) + np.minimum(beyond[i], beyond[j])
        fine = longer - shared <= np.floor((1 - least) * longer + 1e-9)
        for x, y in zip(i[fine].tolist(), j[fine].tolist(), strict=True):
            one, two = root(int(component[x])), root(int(component[y]))
            if one == two or np.intersect1d(signatures[x], signatures[y])[0] != bucket:
                continue
            if edit_similarity(codes[x], codes[y], least):
                parent[max(one, two)] = min(one, two)
                found.append((int(node[x]), int(node[y])))
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: int = TABLES, picks: int = PICKS, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``k1``, ``k2`` (row key), id, ``component_id``, ``n_links`` and ``kept`` for every row.

    ``component_id`` is the least id of a row's group of linked classes, ``n_links`` the number
    of verified links of its class to others plus its further copies, ``kept`` marks the group's
    first row by id (null last), then by row key.  Texts without words (null, empty) link with
    nothing, not even each other.
    """
    small_batches(docs.sparkSession)
    packed = pack(docs, key=True)
    rows = packed.select("k1", "k2", F.col("row").getField(id_col).alias("id"), F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text"))
    found = settle(sketches(rows, tables, picks, shingle, least))
    edges, grouped = links(rows.select("k1", "k2", "text"), found, least)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "k1", "k2")
    classes = found.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min(order).alias("first"))
    classes = classes.join(grouped, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Rows of one component meet only as its salted parts: a large component's row goes to each of them.
    classes = settle(classes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")))
    parts = classes.groupBy("component", "salt").agg(F.min("first").alias("first"))
    firsts = parts.groupBy("component").agg(F.min("first").alias("first"), F.collect_set("salt").alias("salts")).select("component", "first", F.explode("salts").alias("salt"))
    told = classes.drop("first").join(firsts, ["component", "salt"]).select("node", "first", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lone = F.col("first").isNull()
    return (
        found.select("k1", "k2", "id", "node")
        .join(told, "node", "left")
        .select(
            "k1",
            "k2",
            "id",
            F.when(lone, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            (lone | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")))).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group; rows equal in every column count once if they have words."""
    names = docs.columns
    told = settle(group(docs, id_col, text_col, **options))
    kept = told.where("kept").select("k1", "k2")
    repeats = told.where("kept").groupBy("k1", "k2").count().where("count > 1").limit(1).count()
    packed = pack(docs, key=True)
    if repeats:
        blank = F.trim(F.regexp_replace(F.coalesce(F.col("row").getField(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")) == ""
        packed = packed.where(blank).unionByName(packed.where(~blank).dropDuplicates(["k1", "k2"]))
    return unpack(packed.join(kept.distinct(), ["k1", "k2"]), names)


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group(docs).select(F.col("id").alias("doc_id"), "component_id", "n_links", "kept")
