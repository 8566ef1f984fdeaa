"""Transcripts against all paths of states, and both the transcripts and the pipeline on odd rows."""

import hashlib
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import chat, common
from tests.llm.test_llm import ODD, SF, empty, odd, reference_encoding

SCHEMA = "conv_id long, turn long, text string"
LINES = ["User: hello there", "Assistant: sure", "and more of it", "", "- one", "what now?", "system - be brief", "x" * 300]


def best_path(model, lines):
    """The likeliest states of a conversation's features, by trying all of them."""
    names = list(model["emit"])
    said = [[sum(model["emit"][f][s][v] for f, v in zip(names, line, strict=True)) for s in range(len(chat.STATES))] for line in lines]

    def score(path):
        moves = sum(model["step"][a][b] for a, b in itertools.pairwise(path))
        return model["start"][path[0]] + moves + sum(line[s] for line, s in zip(said, path, strict=True))

    return max(itertools.product(range(len(chat.STATES)), repeat=len(lines)), key=score)


def told(texts, path):
    """(row, part, role, body) of a path: a part ends where the role changes or its marker begins a turn; markers go."""
    out, at = [], iter(path)
    for n, text in enumerate(texts):
        parts = []
        for line in text.split("\n"):
            role, begins = chat.STATES[next(at)]
            found = chat.MARKER.match(line)
            marked = found is not None and any(role == r and found[1].lower() in names for r, names in chat.NAMES.items())
            if not parts or parts[-1][0] != role or (begins and marked):
                parts.append((role, []))
            parts[-1][1].append(line[found.end() :] if marked else line)
        out += [(n, p, role, "\n".join(body).strip("\n")) for p, (role, body) in enumerate(parts)]
    return out


def test_chat_equals_all_paths(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    monkeypatch.setattr(chat, "FAN", 2)
    model = chat.fit(common.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text"))
    random.seed(5)
    rows, expected = [], []
    for conv in range(40):
        lines = [random.choice(LINES) for _ in range(random.randint(1, 5))]
        cuts = sorted(random.sample(range(1, len(lines)), random.randint(0, len(lines) - 1)))
        texts = ["\n".join(lines[a:b]) for a, b in itertools.pairwise([0, *cuts, len(lines)])]
        rows += [(conv, n, t) for n, t in enumerate(texts)]
        path = best_path(model, [f for t in texts for f in chat.turn_features(t)])
        expected += [(conv, *r) for r in told(texts, path)]
    got = chat.parse(spark.createDataFrame(random.sample(rows, len(rows)), SCHEMA), model).collect()
    assert sorted((r.conv_id, r.turn, r.part, r.role, r.text) for r in got) == expected


def test_chat_odd_rows(spark):
    """Null ids are one conversation, null turns come last by text; ties and repeated rows all stay; long texts are whole."""
    model = chat.fit(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    long = "User: " + "word " * 100_000 + "\nAssistant: " + "é" * 50_000
    rows = [(1, 0, "User: a"), (1, 0, "User: a"), (1, 0, "User: b"), (1, None, "Assistant: c"), (1, None, None), (None, 0, "User: d"), (None, None, "Assistant: e"), (2, 5, long), (2, -1, ""), (3, None, "User: f")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(7) for n in ("conv", "b", "b0", "m", "tie", "luck", "before", "last", "part", "rendered")})
    got = chat.parse(df, model).collect()
    assert all(r.rendered == chat.render(r.role, r.text) and r.role in chat.ROLES for r in got)
    bodies = sorted((r.conv_id is None, r.conv_id or 0, r.turn is None, r.turn or 0, r.text) for r in got if r.conv_id != 2)
    assert bodies == [(False, 1, False, 0, "a"), (False, 1, False, 0, "a"), (False, 1, False, 0, "b"), (False, 1, True, 0, ""), (False, 1, True, 0, "c"), (False, 3, True, 0, "f"), (True, 0, False, 0, "d"), (True, 0, True, 0, "e")]
    assert sorted((r.turn, r.part, r.role if r.text else "", r.text) for r in got if r.conv_id == 2) == [(-1, 0, "", ""), (5, 0, "user", "word " * 100_000), (5, 1, "assistant", "é" * 50_000)]
    assert {r.role for r in got if r.text in "abdf" and r.text} == {"user"} and {r.role for r in got if r.text in ("c", "e")} == {"assistant"}


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    odd(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = common.table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.settle(stage(spark, docs, folder))
        assert out.columns == docs.columns and all(r.word == "keep" for r in out.select("word").collect()), name
        docs, seen[name] = out, sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    long = "é" * 50_000 + " x"
    assert seen["toxicity"] == sorted(((r[0], r[1]) for r in ODD), key=str)
    # The row without an id is only the line that document 3 holds: it goes. Both rows of document 4 lose it, and are then one.
    stay = [(1, ""), (2, ""), (3, "same line of text\nown"), (4, "other"), (5, long), (6, "\n\n"), (7, "one two three")]
    assert seen["line_dedup"] == sorted([*stay, (4, "other")], key=str) and seen["near_duplicates"] == sorted(stay, key=str)
    taken = Counter(seen["mixing"])
    assert set(taken) <= set(stay) and all(n <= 2 for n in taken.values())
    own = reference_encoding()
    tokens = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert tokens == {(i, len(own.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in seen["mixing"]}


def test_pipeline_on_no_rows(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    empty(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_workers_keep_one_model_and_tokens_take_one_worker(spark):
    """Encoding and decoding share a Python worker, which forgets the model of the stage before."""
    import corpus_pipeline
    from tessera.llm import bpe, common

    rows = [(1, "a b c  d", "en", "x", 8), (2, None, "en", "x", 0), (3, "\u00e9\u4e2d\n", None, "y", 3), (1, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.tokenize(spark, docs, "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    vocabulary = bpe.default_vocabulary()
    both = bpe.decode(bpe.encode(docs, *vocabulary).drop("text"), *vocabulary)
    parts = both.select("doc_id", "lang", "source", "ids", *[c.alias(n) for n, c in bpe.digests(both).items()])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)
    made = []
    first, second = (lambda x: made.append(x) or [x]), (lambda x: made.append(-x) or [-x])
    assert common.held(first, 1) is common.held(first, 1) and common.held(second, 1) == [-1] and common.held(first, 1) == [1] and made == [1, -1, 1]
