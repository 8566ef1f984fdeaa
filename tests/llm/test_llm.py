"""The training-data operators on small tables: brute force, round trips and edge cases."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, common, components, embedding, fingerprint, line_dedup, mixing, near_dup, pii, substring, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, ties, repeated rows, a null id and source.
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "same line of text\nown", "en", "b", 3), (4, "Same Line of Text \nother", "en", None, 3), (4, "Same Line of Text \nother", "en", None, 3),
    (None, "same line of text", None, "b", 3), (5, "é" * 50_000 + " x", "fr", "b", 3), (6, "\n\n", "en", "b", 2), (7, "one two three", None, None, None),
]


def odd(spark):
    """The odd rows with further columns that carry internal names."""
    return spark.createDataFrame(ODD, DOCS).withColumns({n: F.lit("keep") for n in ("row", "key", "k1", "pos", "h1", "size", "node", "bucket", "features", "ids_", "word")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return common.table(spark, SF, "documents")


# ---------------------------------------------------------------- lines


def test_line_dedup_edges(spark):
    out = line_dedup.dedup_lines(odd(spark))
    got = sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()], key=str)
    assert (4, "other", 2, 1) in got and (3, "same line of text\nown", 2, 0) in got and (None, "", 1, 1) in got
    assert (1, "", 1, 0) in got and (6, "\n\n", 3, 0) in got and len(got) == len(ODD) and {r.row for r in out.collect()} == {"keep"}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_equals_sql(spark, duck):
    got = {tuple(r) for r in line_dedup.op9_line_dedup(spark, SF).collect()}
    assert got == set(duck.execute(line_dedup.OP9_SQL).fetchall())


# ---------------------------------------------------------------- mixing


def targets_by_hand(sizes):
    """Water filling by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing_meets_targets_and_repeats(spark):
    rows = [tuple(r) for r in mixing.op2_entropy_mix(spark, SF).select("doc_id", "size", "source_size", "target", "taken", "source").collect()]
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, size, _, _, words, source in rows:
        sizes[source] += size
        taken[source] += words
        largest[source] = max(largest[source], size)
        assert words <= 2 * size
    want = targets_by_hand(sizes)
    for _, _, whole, target, _, source in rows:
        assert whole == sizes[source] and target == pytest.approx(want[source])
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(0.02 * target, 60)
    again = [tuple(r) for r in mixing.op2_entropy_mix(spark, SF).select("doc_id", "size", "source_size", "target", "taken", "source").collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_edges(spark):
    out = mixing.mix(odd(spark))
    assert out.columns == odd(spark).columns and max(Counter(tuple(r) for r in out.collect()).values()) <= 4
    assert mixing.mix(empty(spark)).count() == 0


# ---------------------------------------------------------------- toxicity


def toxic_rows(n=240):
    random.seed(3)
    words = ["".join(random.choices("abcdefgh", k=5)) for _ in range(60)]
    rows = []
    for i in range(n):
        text = random.choices(words, k=40)
        if i % 4 == 0:
            text[random.randrange(40)] = random.choice(["blighter", "scoundrel"])
            text[random.randrange(40)] = "blighter"
        rows.append((i, " ".join(text), "en", "s", 1))
    return rows


def test_toxicity_learns_only_training_rows(spark):
    docs = spark.createDataFrame(toxic_rows(), DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels.where(~toxicity.is_held_out(F.col("doc_id"))))
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    scored = toxicity.score(odd(spark), model)
    assert scored.count() == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.collect())
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_scores_equal_plain_python(spark):
    """The Spark job's scores equal a loop over whole texts with the same two dictionaries and curve."""
    import zstandard as zs

    docs = spark.createDataFrame(toxic_rows(), DOCS)
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert "blighter" in model["toxic"] and "blighter" not in model["base"] + model["contrast"]
    code = lambda t: b"".join(hashlib.md5(c.encode()).digest()[:4] for c in t)
    n = min(len(model["toxic"]), len(model["contrast"]))
    params = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_BTOPT, **toxicity.PARAMETERS)
    ways = []
    for end in (model["contrast"], model["toxic"]):
        ways.append(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(code(model["base"] + end[len(end) - n :]), dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params))
    for r in toxicity.score(docs.where("doc_id < 12"), model).collect():
        windows = [code(f" {w} ") for w in r.text.lower().split()]
        d = np.array([len(ways[0].compress(w)) - len(ways[1].compress(w)) for w in windows])
        above = [float((d >= cut).sum()) for cut in toxicity._CUTS]
        x = [min(1.0, a) for a in above] + [np.log1p(a) for a in above] + [100 * float((d >= cut).sum()) / (len(d) + 20) for cut in (6, 8, 10)] + [10 * d.mean()]
        assert r.score == pytest.approx(1 / (1 + np.exp(-(np.dot(x, model["curve"][:-1]) + model["curve"][-1]))), abs=1e-6)


def test_toxicity_null_ids_and_repeated_labels(spark):
    docs = spark.createDataFrame([*toxic_rows(), (None, "blighter", "en", "s", 1)], DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    twice = labels.union(labels.where("doc_id < 40")).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    assert toxicity.fit(docs, twice)["prior"] == toxicity.fit(docs, labels)["prior"] == 0.25
    assert [r.h for r in docs.where("doc_id IS NULL").select(toxicity.is_held_out(F.col("doc_id")).alias("h")).collect()] == [False]


def test_toxicity_is_the_same_for_any_partitioning(spark):
    docs = spark.createDataFrame(toxic_rows(), DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    before, coalesce = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled"
    models = []
    try:
        spark.conf.set(coalesce, "false")
        for parts in (1, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            models.append(toxicity.fit(docs.repartition(parts), labels.repartition(8 - parts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(coalesce)
    assert models[0] == models[1] == models[2] and "curve" in models[0]


def test_toxicity_bounded_sample_keeps_the_labels_share(spark, monkeypatch):
    """F-pipeline: bounds that leave as many toxic rows as ordinary ones must not make most texts toxic."""
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 60)
    monkeypatch.setattr(toxicity, "MAX_ORDINARY", 60)
    random.seed(5)
    words = [f"{a}{b}" for a in "bdfgklmn" for b in ("asto", "ire", "ulan", "emi", "ov")]
    docs = spark.createDataFrame([(i, " ".join(random.choices(words, k=40))) for i in range(800)], "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic")))
    assert toxicity.score(docs, model).where("predicted = 1").count() < 200


def test_toxicity_curve_belongs_to_the_dictionaries_that_score(spark, monkeypatch):
    """With many labels the curve is fitted to rows apart, measured with the dictionaries of the model itself."""
    monkeypatch.setattr(toxicity, "APART", 5, raising=False)
    used, measure = [], toxicity._measure
    monkeypatch.setattr(toxicity, "_measure", lambda df, model: used.append((df, model)) or measure(df, model))
    docs = spark.createDataFrame(toxic_rows(), DOCS)
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert {tuple(m[k] for k in ("base", "toxic", "contrast")) for _, m in used} == {tuple(model[k] for k in ("base", "toxic", "contrast"))}
    assert 20 < sum(df.count() for df, _ in used) < 120
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in toxicity.score(docs, model).collect()]) > 0.9


def test_toxicity_without_labels(spark):
    model = toxicity.fit(documents(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd(spark), model).collect()} == {0.0}


# ---------------------------------------------------------------- substrings


def repeats_by_hand(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_substrings_equal_brute_force(spark):
    random.seed(5)
    texts = [" ".join(random.choices("abc", k=random.randint(0, 90))) for _ in range(60)] + [None, "", "a " * 80, "x\ty\x0bz"]
    rows = [(i % 50, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("i", F.monotonically_increasing_id())
    out = substring.remove_repeats(docs, window=7, anchor=4).orderBy("i").collect()
    assert [(r.n_words, r.n_removed, r.text) for r in out] == repeats_by_hand(texts, 7)
    assert substring.remove_repeats(empty(spark)).count() == 0 and substring.remove_repeats(odd(spark)).count() == len(ODD)


def test_substrings_equal_sql(spark, duck):
    got = {tuple(r) for r in substring.op4_count_min_substrings(spark, SF).collect()}
    assert got == set(duck.execute(substring.OP4_SQL).fetchall())


def test_sketch_never_misses_a_repeat():
    values = np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64)
    cells = 1 << 21
    twice = np.zeros(cells, bool)
    found, counts = np.unique(substring._cells(np.concatenate([values, values[:100]]), cells).ravel(), return_counts=True)
    twice[found[counts > 1].astype(np.int64)] = True
    segments = {i: np.packbits(twice[i << 20 : (i + 1) << 20], bitorder="little").tobytes() for i in range(2)}
    hit = substring.Sketch(cells, segments).repeated(values)
    assert hit[:100].all() and hit[100:].mean() < 0.01


# ---------------------------------------------------------------- tokens


def reference_encoding():
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    assert pattern == public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark):
    own = reference_encoding()
    texts = [r.text for r in documents(spark).select("text").collect()] + [None, "", "  \n\t x" * 50, "日本語 🙂 ▁ ▁​", "a" * 3000, "<|endoftext|>", "0" * 500 + "\r\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    both = bpe.decode(bpe.encode(df, *bpe.default_vocabulary()), *bpe.default_vocabulary())
    for r in both.collect():
        want = own.encode_ordinary(texts[r.doc_id] or "")
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == want
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert bpe.encode(empty(spark), *bpe.default_vocabulary()).count() == 0


# ---------------------------------------------------------------- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base_by_hand(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_pii_base_spans_equal_brute_force(spark):
    random.seed(11)
    pieces = ["a@b.co", "x.y@", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "4242 4242-4242 4242", "4242424242424243", "+1 (555) 010-9999", "+1", "é🙂", " ", "\n", "a@b.c_d@e.f", "007.0.0.1", "12", "-", "+49 30 123456", ".", "@"]
    texts = [" ".join(random.choices(pieces, k=12)) for _ in range(150)] + ["".join(random.choices(pieces, k=14)) for _ in range(150)] + [None, "", "9 " * 9000, "a" * 40_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.find(df).collect():
        base = [tuple(s) for s in r.base]
        assert base == base_by_hand(texts[r.doc_id]), texts[r.doc_id]
        spans = [tuple(s) for s in r.spans]
        assert set(base) <= set(spans)
    assert pii.find(empty(spark)).count() == 0 and pii.find(odd(spark)).count() == len(ODD)


def test_pii_adds_what_failing_runs_hide(spark):
    """Cards and phones inside a run that fails as a whole are added; look-alikes are not."""
    random.seed(12)

    def card(lead):
        digits = lead + "".join(random.choices("0123456789", k=15 - len(lead)))
        total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return digits + str(-total % 10)

    def phone():
        return f"+1 ({random.randint(100, 999)}) 555-{random.randint(1000, 9999)}"

    texts = []
    for _ in range(240):
        texts += [f"pay with {card('4')} now", f"call {phone()} today", f"number {random.randint(10**15, 4 * 10**15 - 1)} is none", f"mail a{random.randint(1, 99)}@b.example.com", f"at 10.0.{random.randint(0, 255)}.7 and version 1.2.{random.randint(0, 9)}"]
    hidden = [(phone(), card("4")) for _ in range(30)]
    texts += [f"see {a} {b} there" for a, b in hidden]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, text in enumerate(texts):
        base, spans = [tuple(s) for s in got[i].base], [tuple(s) for s in got[i].spans]
        assert base == base_by_hand(text) and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        more = [s for s in spans if s not in base]
        assert all(a is b or a[2] <= b[1] or b[2] <= a[1] for a in more for b in spans)
        if i < 1200:
            assert not more
    for i, (a, b) in enumerate(hidden, 1200):
        assert {texts[i][s:e] for _, s, e in map(tuple, got[i].spans)} == {a, b}


def test_pii_overlapping_candidates_keep_the_best(spark):
    """The kept candidates equal a search over all pairs."""
    random.seed(13)
    names = ("start", "end", "right", "taken", *pii.FEATURES)
    rows = []
    for i in range(60):
        found = []
        for _ in range(12):
            start = random.randint(0, 60)
            found.append((start, start + random.randint(3, 20), random.random() < 0.8, random.random() < 0.2, random.randrange(4), random.randint(0, 20), 0, 0, 0, 0, 0, 0))
        rows.append((i, found))
    schema = "id int, found array<struct<" + ",".join(f"{n}:{'boolean' if n in ('right', 'taken') else 'int'}" for n in names) + ">>"
    score = lambda at: F.round(at[1] / 20.0, 3)
    limits = {"email": 0.1, "ip": 0.5, "card": 0.3, "phone": 0.0}
    got = {r.id: {tuple(s) for s in r.more} for r in pii._chosen(spark.createDataFrame(rows, schema), (score, limits)).collect()}
    for i, found in rows:
        fine = {(round(c[5] / 20, 3), c[1] - c[0], -c[4], -c[0], c[1]) for c in found if c[2] and not c[3] and round(c[5] / 20, 3) >= limits[pii.KINDS[c[4]]]}
        stay = {c for c in fine if not any(d > c and -d[3] < c[4] and -c[3] < d[4] for d in fine)}
        assert got[i] == {(pii.KINDS[-c[2]], -c[3], c[4]) for c in stay}


def test_pii_redacts(spark):
    df = spark.createDataFrame([(1, "write a@b.co from 1.2.3.4 now"), (2, "1.2.3.4@x.org twice"), (3, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["write [EMAIL] from [IP] now", "[EMAIL] twice", ""]


# ---------------------------------------------------------------- vectors


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    vectors = np.concatenate([base, base[:10] + 0.05 * rng.standard_normal((10, 16)), base[:3], 5 * base[3:5], np.repeat(base[5:6], 30, 0) + 0.02 * rng.standard_normal((30, 16))])
    rows = [(i, [float(x) for x in v], int(i % 2 if i < 40 else (i - 40) % 2)) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, 1), (904, rows[0][1], None), (905, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    links, parent = Counter(), {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fine = [(i, np.array(v), lab) for i, v, lab in rows if i < 900]
    for a, va, la in fine:
        for b, vb, lb in fine:
            if a < b and la == lb and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.93:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.link(df, block=8, recall=0.9999).collect()}
    assert got == {i: (links[i], root(i), root(i) == i) for i, _, _ in rows}
    assert embedding.link(df.limit(0)).count() == 0


# ---------------------------------------------------------------- near duplicates


def test_edit_distance_equals_textbook():
    random.seed(1)
    for _ in range(500):
        a = [random.randint(0, 4) for _ in range(random.randint(0, 20))]
        b = [x for x in a if random.random() > 0.2] + [random.randint(0, 4) for _ in range(random.randint(0, 4))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        limit = random.randint(0, 10)
        assert near_dup.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), limit) == min(row[-1], limit + 1)


def near_copies():
    random.seed(9)
    rows, words = [], ["".join(random.choices("abcdefghij", k=4)) for _ in range(3000)]
    for g in range(30):
        text = random.choices(words, k=120)
        for c in range(5):
            copy = list(text)
            for at in random.sample(range(120), c):
                copy[at] = random.choice(words)
            rows.append((100 * g + c, " ".join(copy), "en", "s", 1))
    return rows


def test_near_duplicates_group_copies_only(spark):
    rows = near_copies() + [(9000 + i, t, "en", "s", 1) for i, t in enumerate(["", None, "", "two words", "two words", "Two  Words"])]
    got = {r.id: r.component_id for r in near_dup.group(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == 100 * (i // 100) for i, *_ in rows if i < 9000)
    assert [got[9000 + i] for i in range(6)] == [9000, 9001, 9002, 9003, 9003, 9003]
    kept = near_dup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    texts = sorted(str(r.text)[:20] for r in kept.collect())
    # "same line of text own", "Same Line of Text other" (twice) and "same line of text" are 1 edit of 5 words apart: 0.8 links.
    assert [t.lower().startswith("same line of text") for t in texts].count(True) == 1 and near_dup.keep_one(empty(spark)).count() == 0


def test_near_duplicates_compare_every_pair_of_a_bucket(spark):
    """All texts share a passage; partners are neither a bucket's least nor alone with it."""
    random.seed(21)
    words = ["".join(random.choices("abcdefghij", k=4)) for _ in range(3000)]
    passage, texts = random.choices(words, k=50), []
    for _ in range(200):
        text = passage + random.choices(words, k=70)
        texts.append(text)
        copy = list(text)
        for at in random.sample(range(120), 20):
            copy[at] = random.choice(words)
        texts.append(copy)
    got = {r.id: r.component_id for r in near_dup.group(spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], DOCS)).collect()}
    roller = substring.Roller()
    codes = [[w.encode() for w in t] for t in texts]
    signatures = [set(near_dup.sketch(roller, c).tolist()) for c in codes]
    hashed = [roller.of_words(c).astype(np.uint32) for c in codes]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if signatures[i] & signatures[j] and near_dup.edit_similarity(hashed[i], hashed[j])]
    assert len(pairs) > 100
    assert [(i, j) for i, j in pairs if got[i] != got[j]] == []
    assert all(got[i] // 2 == i // 2 for i in got)


def test_near_duplicates_at_the_threshold_and_of_short_texts(spark):
    random.seed(22)
    words = ["".join(random.choices("abcdefghij", k=4)) for _ in range(3000)]

    def partner(text, edits):
        copy = list(text)
        for at in random.sample(range(len(text)), edits):
            copy[at] = "x" + random.choice(words)
        return copy

    long = [random.choices(words, k=100) for _ in range(150)]
    short = [random.choices(words, k=random.randint(5, near_dup.SHORT)) for _ in range(150)]
    texts = [t for base in long + short for t in (base, partner(base, len(base) // 5))]
    got = {r.id: r.component_id for r in near_dup.group(spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], DOCS)).collect()}
    together = [got[i] == got[i + 1] for i in range(0, len(texts), 2)]
    assert sum(together[:150]) >= 0.97 * 150 and all(together[150:])


def test_short_keys_find_every_pair():
    random.seed(23)
    roller, texts = substring.Roller(), []
    for _ in range(60):
        text = random.choices("abcdefgh", k=random.randint(4, near_dup.SHORT))
        for _ in range(5):
            copy = list(text)
            for _ in range(random.randint(0, 7)):
                at, kind = random.randrange(len(copy)), random.random()
                copy[at : at + (kind < 0.7)] = random.choices("abcdefgh", k=int(kind > 0.3))
                copy = copy or ["a"]
            texts.append(copy[: near_dup.SHORT])
    hashes = [roller.of_words([w.encode() for w in t]) for t in texts]
    keys = [set(near_dup.short_keys(h).tolist()) for h in hashes]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] != texts[j] and near_dup.edit_similarity(hashes[i], hashes[j])]
    assert len(pairs) > 100 and all(keys[i] & keys[j] for i, j in pairs)


def test_toxicity_learns_from_rows_that_start_alike(spark):
    random.seed(24)
    words, header = ["".join(random.choices("abcdefghij", k=6)) for _ in range(300)], "this text may be used under the terms of the common licence of its source "
    rows = [(i, header + " ".join(random.choices(words, k=30) + ["grumblefoul"] * (i % 4 == 0)), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "curve" in model and model["prior"] == 0.25
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in toxicity.score(docs, model).collect())
    # Copies with other blanks and case count once for each label, never for both.
    copies = spark.createDataFrame([(i, "One  text" if i % 2 else "one text", "en", "s", 1) for i in range(8)], DOCS)
    assert toxicity.fit(copies, spark.createDataFrame([(i, int(i < 2)) for i in range(8)], "doc_id long, toxic int")) == {"prior": 0.5}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 105), (105, 103)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 103, 105)} == {100}


# ---------------------------------------------------------------- fingerprints


def test_fingerprint_rates_follow_generalised_jaccard():
    sampler = fingerprint.Sampler(2000, 2000, 2000)
    a, b = "x x x y z " * 3, "x y y z w " * 3
    ca, cb = Counter(a.split()), Counter(b.split())
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    assert abs(fingerprint.likeness(sampler.sample(a), sampler.sample(b)) - want) < 0.05
    assert fingerprint.likeness(sampler.sample(a), sampler.sample("z y x x x " * 3)) == 1


def test_edit_report_follows_descending_ids(spark):
    texts = {1: "a b c d e f", 2: None, 5: "é🙂 g h i", 9: "a b c d e f"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("part", F.lit(1))
    got = {r.doc_id: r for r in fingerprint.edit_report(df).collect()}
    order = [9, 5, 2, 1]
    for n, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(n + 1) % 4]] or ""
        k = len(text) // 3
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest() and got[i].n_chars == len(text)
    assert got[1].fingerprint == got[9].fingerprint and got[1].near_next == 1 and got[2].fingerprint == "0" * 512
    assert fingerprint.edit_report(df.limit(0)).count() == 0 and fingerprint.edit_report(odd(spark)).count() == len(ODD)
    assert fingerprint.edit_report(df.where("doc_id = 1")).first().near_next == 1
    assert {len(r.fingerprint) for r in fingerprint.fingerprints(odd(spark)).collect()} == {512}


# ---------------------------------------------------------------- chat


def test_chat_markers_decide_roles(spark):
    text = "User: hello there\nmore of it\nAssistant: hi\n- one\nHuman: bye"
    model = chat.fit(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    df = spark.createDataFrame([(1, 0, text), (None, None, None)], "conv_id long, turn long, text string").withColumn("conv", F.lit("clash"))
    got = chat.parse(df, model).where("conv_id = 1").orderBy("part").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hello there\nmore of it"), ("assistant", "hi\n- one"), ("user", "bye")]
    assert got[0].rendered == "<|user|>\nhello there\nmore of it\n<|end|>\n"
    assert chat.parse(df, model).count() == 4 and chat.parse(df.limit(0), model).count() == 0


def test_chat_blocks_equal_one_pass(spark, monkeypatch):
    monkeypatch.setattr(chat, "FAN", 3)
    turns = common.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text")
    model = chat.fit(turns)
    rows = [(7, i, "x" * (900 if i % 2 else 40)) for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = [r.role for r in chat.parse(df, model).orderBy("turn").collect()]
    decoder = chat.Decoder(model)
    features = [f for _, _, t in rows for f in chat.turn_features(t)]
    path = decoder.route(decoder.lines(decoder.scores(features)), decoder.entry(None), None)
    assert got == [chat.STATES[s][0] for s in path]


def test_chat_held_out_accuracy(spark):
    turns = common.table(spark, "/root/testdata/sf0.01", "conversations")
    truth = {(r.conv_id, r.turn): r.role for r in turns.collect()}
    got = chat.op1_chat_format(spark, "/root/testdata/sf0.01").where("part = 0").collect()
    held = [r for r in got if zlib.crc32(str(r.conv_id).encode()) % 5 == 0]
    assert len(got) == len(truth) and np.mean([truth[r.conv_id, r.turn] == r.role for r in held]) > 0.85


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.settle(stage(spark, docs, SF))
        assert docs.columns == columns, name
        assert name == "mixing" or docs.count() <= seen
        seen = docs.count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == seen and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(tokens.columns)
    own = reference_encoding()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.limit(20).collect():
        assert r.n_tokens == len(own.encode_ordinary(texts[r.doc_id]))
