"""Personal data: exact base patterns plus gradient-boosted candidates, all in DataFrame operations.

Base spans are the leftmost non-overlapping matches of four patterns that pass their checks
(IP parts, Luhn, digit counts).  Beside them high-recall generators propose overlapping spans,
also inside runs in which a base pattern failed.  Each candidate gets format and context features
with few bins, and a label from a check that is no feature: the Luhn sum of a card, the range of
an IP's parts, the last part of a mail's domain, a phone's digits with a prefix or a cue word.

Texts are read once; spans and candidates are written without the texts.  Candidates are counted
by feature combination and label; boosted trees are fitted on the counts of one half of the
documents, and each kind's threshold is calibrated for precision on the other half.  The trees
become one SQL expression.  A candidate is added if it passes its check and the threshold, meets
no base span, and no overlapping candidate has a better score.

Offsets come from splitting a text at a pattern: the lengths of the gaps and matches before a
match sum to its start.  The base patterns are written so that each is linear in the text:
possessive loops that start only where a run starts match exactly what the plain patterns match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pack, settle, unpack

KINDS = ("email", "ip", "card", "phone")
#: Base patterns; \G lets a match start right where the previous one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)", r"(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)"
#: What the generators propose; those of one kind may overlap.
WIDE = {
    "email": [rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+"],
    "ip": [r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,5}+", r"(?<![0-9\]])[0-9]{1,3}+(?:[\[(]\.[\])][0-9]{1,3}+){3}(?![0-9])"],
    "card": [
        r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?+[0-9]){12,18}+(?![\x20.-]?[0-9])",
        r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])",
    ],
    "phone": [
        r"(?:\+|(?<![0-9])00)[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-][0-9]{2,4}(?![0-9])){1,4}+",
        r"(?<![0-9A-Za-z+])(?:\+|00)?+\(?[0-9]{1,4}\)?(?:[\x20().-]{1,2}+[0-9]{2,4}+){2,5}+(?![0-9])",
    ],
}
#: Every span that a pattern can find has one of these marks of a mail, or four digits with signs between.
_MAIL_MARKS = ("@", "[at]", "(at)", "[AT]", "(AT)", "[at)", "(at]", "[AT)", "(AT]")
_SOME_DIGITS = r"[0-9](?:[\x20().+\[\]-]*+[0-9]){3}"
#: Words near a span that speak for its kind.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|account)\b",
    "phone": r"(?i)\b(?:phone|call|tel|fax|mobile|cell|whatsapp)\b",
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
FEATURES = ("kind", "digits", "groups", "separator", "lead", "before", "after", "cue")
#: The share of spans that pass a kind's check by chance alone: one Luhn sum in ten is right.
CHANCE = {"email": 0.0, "ip": 0.0, "card": 0.1, "phone": 0.0}
#: Least precision of what a kind's threshold lets through, and least held-out spans to tell it from.
PRECISION, EVIDENCE = 0.98, 20
_BLOCK = 256
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _luhn(digits: Column) -> Column:
    ones = F.transform(F.split(F.reverse(digits), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(ones, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0))) % 10 == 0


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _valid(kind: str, found: Column) -> Column:
    """The contract's check of a base match."""
    if kind == "ip":
        return F.rlike(found, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
    if kind == "card":
        return _luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def _with_spans(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``df`` with an array column for each pattern: start, end, found, left and right context of its matches.

    The sums of the lengths before each match go by blocks of _BLOCK, so that long arrays stay cheap.
    """
    names = list(patterns)
    total, before = "aggregate({0}, 0, (p, q) -> p + q)", "transform({0}, (_, i) -> aggregate(slice({0}, 1, i), 0, (p, q) -> p + q))"
    layers = [
        {f"n_{n}": f"zip_with(g_{n}, m_{n}, (x, y) -> char_length(x) + coalesce(char_length(y), 0))" for n in names},
        {f"b_{n}": f"transform(sequence(0, cast((size(n_{n}) - 1) div {_BLOCK} AS int)), k -> slice(n_{n}, k * {_BLOCK} + 1, {_BLOCK}))" for n in names},
        {f"t_{n}": f"transform(b_{n}, a -> {total.format('a')})" for n in names},
        {f"o_{n}": before.format(f"t_{n}") for n in names},
        {f"s_{n}": f"flatten(zip_with(b_{n}, o_{n}, (x, y) -> transform({before.format('x')}, v -> v + y)))" for n in names},
        {
            n: f"transform(m_{n}, (m, i) -> struct(s_{n}[i] + char_length(g_{n}[i]) AS start, s_{n}[i] + char_length(g_{n}[i]) + char_length(m) AS end, "
            f"m AS found, right(g_{n}[i], 24) AS left, left(g_{n}[i + 1], 8) AS right))"
            for n in names
        },
    ]
    df = df.withColumns({f"m_{n}": F.regexp_extract_all("text", F.lit(patterns[n]), F.lit(0)) for n in names} | {f"g_{n}": F.split("text", patterns[n], -1) for n in names})
    for layer in layers:
        df = df.withColumns({name: F.expr(said) for name, said in layer.items()})
    return df.drop(*[f"{x}_{n}" for x in "mgnbtos" for n in names])


def _with_blocks(df: DataFrame, spans: str, name: str) -> DataFrame:
    """``df`` with ``name``: the spans (structs that begin with start, end) by start, in blocks of _BLOCK with their reach.

    What meets a span is looked for only in blocks that reach it, so that texts with many spans stay cheap.
    """
    sorted_ = df.withColumn("_sorted", F.array_sort(spans))
    cut = F.expr(f"transform(sequence(0, cast(greatest(size(_sorted) - 1, 0) div {_BLOCK} AS int)), k -> slice(_sorted, k * {_BLOCK} + 1, {_BLOCK}))")
    reach = F.transform(cut, lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("items")))
    return sorted_.withColumn(name, reach).drop("_sorted")


def _meets(blocks: str, start: Column, end: Column, also=lambda s: F.lit(True)) -> Column:
    """Whether a span of the blocks for which ``also`` holds overlaps [start, end); an empty block has no reach and meets nothing."""
    inside = lambda b: F.exists(b["items"], lambda s: (s["start"] < end) & (start < s["end"]) & also(s))
    return F.exists(blocks, lambda b: F.coalesce((b["low"] < end) & (start < b["high"]), F.lit(False)) & inside(b))


def _side(char: Column) -> Column:
    """No character or a blank, a letter, a digit, anything else."""
    blank = (F.coalesce(char, F.lit("")) == "") | F.rlike(char, F.lit(r"\s"))
    return F.when(blank, 0).when(F.rlike(char, F.lit(r"\p{L}")), 1).when(F.rlike(char, F.lit("[0-9]")), 2).otherwise(3)


def _cue(kind: str, c: Column) -> Column:
    return F.rlike(c["left"], F.lit(CUES[kind]))


def _check(kind: str, c: Column) -> Column:
    """Whether a candidate is what it looks like, told by what no feature shows."""
    found = c["found"]
    if kind == "email":
        return F.rlike(found, F.lit(rf"{_AT}.*{_DOT}[A-Za-z]{{2,24}}$"))
    if kind == "ip":
        return _valid("ip", F.regexp_replace(found, r"[\[(]\.[\])]", "."))
    if kind == "card":
        return _luhn(_digits(found))
    return F.length(_digits(found)).between(8, 15) & (F.rlike(found, F.lit(r"^(?:\+|00)")) | _cue("phone", c))


def _features(kind: str, c: Column) -> list[Column]:
    """The features in the order of FEATURES; what the kind's check looks at is left out (0)."""
    found, nothing = c["found"], F.lit(0)
    inner = F.regexp_replace(found, r"[0-9A-Za-z+()\[\]@_%]", "")
    only = lambda pattern: F.rlike(inner, F.lit(pattern))
    separator = F.when(inner == "", 0).when(only(r"^\x20+$"), 1).when(only("^-+$"), 2).when(only(r"^\.+$"), 3).otherwise(4)
    lead = nothing
    if kind == "card":
        first = _digits(found)
        lead = F.when(F.startswith(first, F.lit("4")), 1).when(F.rlike(first, F.lit("^(?:5[1-5]|2[2-7])")), 2).when(F.rlike(first, F.lit("^(?:3[47]|6)")), 3).otherwise(0)
    elif kind == "phone":
        lead = F.contains(found, F.lit("(")).cast("int")
    return [
        F.lit(KINDS.index(kind)),
        nothing if kind == "phone" else F.least(F.length(_digits(found)), F.lit(20)),
        F.least(F.regexp_count(found, F.lit("[0-9A-Za-z]+")), F.lit(7)),
        nothing if kind == "email" else separator,
        lead,
        _side(F.right(c["left"], F.lit(1))),
        _side(F.left(c["right"], F.lit(1))),
        nothing if kind == "phone" else _cue(kind, c).cast("int"),
    ]


def _is_valid(kind: str):
    return lambda b: _valid(kind, b["found"])


def _candidate(kind: str):
    def describe(c: Column) -> Column:
        taken = _meets("_bases", c["start"], c["end"])
        named = [f.cast("int").alias(n) for n, f in zip(FEATURES, _features(kind, c), strict=True)]
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), _check(kind, c).alias("right"), taken.alias("taken"), *named)

    return describe


def _as_span(kind: str):
    return lambda b: F.struct(F.lit(kind).alias("kind"), b["start"].alias("start"), b["end"].alias("end"))


def _spotted(texts: DataFrame) -> DataFrame:
    """``texts`` with ``base`` (kind, start, end) and ``found``: candidates of all kinds with label and features."""
    wide = {f"wide_{k}_{i}": p for k in KINDS for i, p in enumerate(WIDE[k])}
    df = _with_spans(texts, {f"base_{k}": BASE[k] for k in KINDS} | wide)
    df = df.withColumns({f"base_{k}": F.filter(f"base_{k}", _is_valid(k)) for k in KINDS})
    proposed = {k: F.array_distinct(F.concat(*[n for n in wide if n.startswith(f"wide_{k}_")])) for k in KINDS}
    base = F.concat(*[F.transform(f"base_{k}", _as_span(k)) for k in KINDS])
    df = df.withColumn("_ends", F.concat(*[F.transform(f"base_{k}", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))) for k in KINDS]))
    df = _with_blocks(df, "_ends", "_bases").drop("_ends")
    return df.withColumns({"base": base, "found": F.concat(*[F.transform(proposed[k], _candidate(k)) for k in KINDS])}).drop("_bases")


def _tree(node, at: list[Column]) -> Column:
    """A regression tree of the fitted model as a SQL expression over the feature columns."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    low, high = _tree(node.leftChild(), at), _tree(node.rightChild(), at)
    return F.when(at[split.featureIndex()] <= F.lit(float(split.threshold())), low).otherwise(high)


def fit(spotted: DataFrame):
    """(probability, thresholds): a function from feature columns to a probability, and each kind's
    threshold; None without both labels in the first half of the documents.

    The training table has a row for each feature combination and label, at most the product of
    the features' bins; calibration gathers at most 1001 rows of each kind.  A threshold is the
    least score above which the held-out precision, after the share that passes by chance, is at
    least PRECISION with EVIDENCE spans; a kind that never reaches it adds nothing.
    """
    rows = spotted.select(F.pmod("k1", F.lit(2)).alias("half"), F.explode("found").alias("c"))
    rows = rows.select("half", F.col("c.right").alias("known"), *[f"c.{n}" for n in FEATURES])
    counted = settle(rows.groupBy("half", "known", *FEATURES).agg(F.count("*").cast("double").alias("weight")))
    learn = counted.where("half = 0")
    if learn.select("known").distinct().count() < 2:
        return None
    labelled = learn.withColumn("label", F.col("known").cast("double")).coalesce(1)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled)
    boosted = GBTClassifier(maxIter=6, maxDepth=4, stepSize=0.3, weightCol="weight", minInfoGain=1e-6, seed=7, checkpointInterval=-1, maxBins=32)
    model = boosted.fit(table)
    trees = [(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]

    def probability(at: list[Column]) -> Column:
        total = reduce(lambda x, y: x + y, [F.lit(float(w)) * _tree(node, at) for node, w in trees])
        return F.round(1 / (1 + F.exp(-2 * total)), 3)

    held = counted.where("half = 1").withColumn("p", probability([F.col(n) for n in FEATURES]))
    sums = held.groupBy("kind", "p").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("known"), F.col("weight")).otherwise(0.0)).alias("good"))
    thresholds = {kind: 1.01 for kind in KINDS}
    good, everything = dict.fromkeys(KINDS, 0.0), dict.fromkeys(KINDS, 0.0)
    for r in sorted(sums.collect(), key=lambda r: -r.p):
        kind = KINDS[r.kind]
        good[kind], everything[kind] = good[kind] + r.good, everything[kind] + r["all"]
        share, chance = good[kind] / everything[kind], CHANCE[kind]
        real = (share - chance) / (1 - chance)
        if r.p >= 0.5 and good[kind] >= EVIDENCE and real >= PRECISION * share:
            thresholds[kind] = r.p
    return probability, thresholds


def _chosen(spotted: DataFrame, model) -> DataFrame:
    """``spotted`` with ``more``: the candidates of ``found`` that are added, as an array of (kind, start, end)."""
    if model is None:
        return spotted.withColumn("more", F.array().cast(_SPANS))
    probability, thresholds = model
    names = F.array(*[F.lit(k) for k in KINDS])
    least = F.array(*[F.lit(float(thresholds[k])) for k in KINDS])
    free = F.filter("found", lambda c: c["right"] & ~c["taken"])
    rated = F.transform(
        free,
        lambda c: F.struct(
            probability([c[n] for n in FEATURES]).alias("p"), (c["end"] - c["start"]).alias("length"), (-c["kind"]).alias("kind"), (-c["start"]).alias("start"), c["end"].alias("end")
        ),
    )
    rows = spotted.withColumn("_passed", F.array_distinct(F.filter(rated, lambda c: c["p"] >= F.get(least, -c["kind"]))))
    # Of overlapping candidates the one with the better score stays, then the longer, then the earlier kind and start.
    rows = _with_blocks(rows.withColumn("_placed", F.transform("_passed", lambda c: F.struct((-c["start"]).alias("start"), c["end"].alias("end"), c.alias("c")))), "_placed", "_rivals")
    beaten = lambda c: _meets("_rivals", -c["start"], c["end"], lambda d: d["c"] > c)
    spans = F.transform(F.filter("_passed", lambda c: ~beaten(c)), lambda c: F.struct(F.get(names, -c["kind"]).alias("kind"), (-c["start"]).alias("start"), c["end"].alias("end")))
    # The size is a second use of the blocks: a column used once would be moved into the lambda and made again for each span.
    return rows.withColumn("more", F.when(F.size("_rivals") > 0, spans)).drop("_passed", "_placed", "_rivals")


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end) by kind as listed, then start.

    Offsets are code points, the end exclusive.  Null text counts as empty.  ``spans`` holds all
    of ``base`` and the chosen candidates, which overlap no base span and not one another.  Columns
    with these names are replaced; every row is kept, repeated ones too.  Ids are not used.
    """
    names = docs.columns
    packed = pack(docs, key=True)
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    marked = reduce(lambda x, y: x | y, [F.contains("text", F.lit(m)) for m in _MAIL_MARKS])
    texts = packed.select("k1", "k2", text.alias("text")).where(marked | F.rlike("text", F.lit(_SOME_DIGITS)))
    spotted = settle(_spotted(texts).select("k1", "k2", "base", "found"))
    place = F.array(*[F.lit(k) for k in KINDS])
    told = _chosen(spotted, fit(spotted)).select("k1", "k2", "base", F.concat("base", "more").alias("spans"))
    by_kind = F.transform("spans", lambda s: F.struct(F.array_position(place, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    plain = F.transform(F.array_sort(by_kind), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # Rows that are equal in every column share a key and their spans.
    told = told.select("k1", "k2", "base", plain.alias("spans")).groupBy("k1", "k2").agg(F.first("base").alias("base"), F.first("spans").alias("spans"))
    joined = packed.join(told, ["k1", "k2"], "left")
    none = F.array().cast(_SPANS)
    return unpack(joined, names, base=F.coalesce("base", none), spans=F.coalesce("spans", none))

def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in square brackets."""
    names = docs.columns
    found = find(docs, text_col)
    rows = found.withColumn("_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # Base spans may overlap: the earlier one, of equal starts the longer, names the mark; none of the others shows.
    keyed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.array_sort(keyed)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        gap = F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(skip, F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        )

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.char_length("_text"))))
    return rows.withColumn(text_col, done).select(*names)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op6_boosted_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
