"""URL filters, structure repair and importance resampling: SQL, brute force and edge cases."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, repair, resample, urls

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_bloom_urls", "op12_structure_repair", "op13_importance_resample"])
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    said = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in said.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(columns).collect()), key=str) == sorted(said.fetchall(), key=str)


# ---------------------------------------------------------------- URLs


def by_hand(url, rules):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), found[1]) if found else ""
    path = found[2] if found else ""
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


def test_urls_with_a_long_list(spark):
    draw = random.Random(3)
    names = ["a", "bb", "news", "éa", "x-y"]
    host = lambda: ".".join(draw.choices(names, k=draw.randint(1, 4)))
    path = lambda: draw.choice(["", "/", "/en", "/en/", "/e", "/en/page", "/fr/é/"]) + draw.choice(["", "x", "/y"])
    rules = [(host(), p if (p := path()).startswith("/") or not p else f"/{p}", draw.choice(["allow", "block"])) for _ in range(400)]
    given = [f"{draw.choice(['http', 'HTTPS'])}://{h.upper() if draw.random() < 0.3 else h}{p}{draw.choice(['', '?q=/en/', '#top'])}" for h, p in ((host(), path()) for _ in range(1500))]
    given += [None, "", "no scheme", "http://", "http://x", "://net/", "a://b://news/", "http://.news/", "http://news./en", "http://news:80/", "http://u@news/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    # Of a rule with both verdicts, block holds: the greater word.
    assert out == {i: by_hand(u, rules) for i, u in enumerate(given)}


def test_urls_edges(spark):
    rules = spark.createDataFrame(urls.RULES + [("net", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("com", "x", "block"), ("com", "/", "odd"), ("COM", None, "block")], "host string, path string, verdict string")
    rows = [(1, "http://a.net/x", "k"), (1, "http://a.net/x", "k"), (None, None, "k"), (2, "http://a.org/fr/" + "y" * 100_000, "k"), (3, "http://" + "a." * 20_000 + "net/", "k"), (4, "http://b.com", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").withColumns({c: F.lit(7) for c in ("row", "k1", "key", "block", "found", "verdict", "w0")})
    out = urls.judge_urls(pages, rules)
    got = sorted((str(r.page_id), r.rule, r.verdict, r.k1, r.row) for r in out.collect() if r.rule)
    assert got == [("1", "net/", "block", 7, 7)] * 2 + [("2", "org/fr/", "allow", 7, 7), ("3", "net/", "block", 7, 7), ("4", "com", "block", 7, 7)]
    assert out.count() == len(rows) and out.where("url IS NULL").first().verdict == "allow"
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_bloom_filter_loses_none_and_few_pass(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("site"), "id", F.lit("/")).alias("key"))
    blocks = urls.blocks_for(20_000)
    bloom = urls.bloom_filter(keys, blocks)
    assert urls.may_hold(keys, bloom, blocks).count() == 20_000
    others = spark.range(100_000).select(F.concat(F.lit("other"), "id", F.lit("/")).alias("key"))
    assert urls.may_hold(others, bloom, blocks).count() < 500


# ---------------------------------------------------------------- structure


def cheapest(turns):
    """(cost, audit, lines) by a search over all edit sequences in the order of cost, then letters; turns: (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        done = re.fullmatch("(s?(ua)+)?", roles)
        if at == len(turns) and done:
            return cost, audit, lines
        state = (at, roles and (roles if roles == "s" else roles[-1]), cost, audit)
        if state in seen or cost > 2 * len(turns) + 10 or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, roles + role[0], (*lines, f"{role}:")))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] and role[0] in "sua":
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, roles + new[0], (*lines, f"{new}:{text}")))
    raise AssertionError("no repair")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def test_repair_is_the_cheapest_and_least(spark):
    draw = random.Random(5)
    conversations, rows = {}, []
    for conv in range(250):
        turns = [(draw.choice(["user", "assistant", "system", "tool", "u", "", "User"]), draw.choice(["", " \n", "a.", "b!", "c", "d? \t", "é.", "x y"])) for _ in range(draw.randint(1, 6))]
        conversations[conv] = turns
        rows += [(conv, 10 * i, role, text) for i, (role, text) in enumerate(turns)]
    draw.shuffle(rows)
    out = {r.conv_id: r for r in repair.summarise(repair.repair(spark.createDataFrame(rows, CONV).repartition(5)), in_order=True).collect()}
    for conv, turns in conversations.items():
        told = faults(turns)
        cost, audit, lines = cheapest(told)
        r = out[conv]
        assert (r.cost, r.audit) == (cost, audit), (turns, r, cost, audit)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        count = Counter(f for *_, f in told)
        assert (r.blank, r.duplicate, r.truncated) == (count["blank"], count["duplicate"], count["truncated"])
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        assert r.gaps == 9 * (len(turns) - 1)


def test_repair_edges(spark):
    rows = [(1, None, "user", "a."), (1, None, "assistant", "b."), (1, 3, "user", "c."), (1, 3, "user", "c."), (1, 9, None, None), (None, 0, "user", "x."), (None, 0, "assistant", "y" * 300_000 + ".")]
    rows.append((2, None, "assistant", "z."))
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(5000)]
    given = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("keep") for c in ("step", "edit", "seen", "fault", "after", "last", "symbol", "h1")})
    edits = repair.repair(given)
    out = {r.conv_id: r for r in repair.summarise(edits).collect()}
    # Null turns come first, in the order of their roles: a before u.
    assert (out[1].audit, out[1].cost, out[1].gaps, out[1].duplicate, out[1].blank) == ("DKRDD", 7, 5, 1, 1)
    assert out[None].audit == "RR" and out[None].cost == 2 and out[2].audit == "D" and out[2].gaps == 0
    assert out[2].repaired_sha256 == hashlib.sha256().hexdigest()
    assert out[3].audit == "K" * 5000 and out[3].cost == 0 and out[3].gaps == 0
    assert edits.where("conv_id IS NULL AND edit = 'R'").select("was", "role").orderBy("was").collect() == [("assistant", "user"), ("user", "assistant")]
    assert repair.summarise(repair.repair(given.limit(0))).count() == 0
    assert sorted(map(tuple, repair.summarise(edits.orderBy("step")).collect()), key=str) == sorted(map(tuple, out.values()), key=str)


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "assistant", "Yes. No!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in repair.damage(spark.createDataFrame(rows, CONV)).collect())
    want = Counter()
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else (text or " ").replace(".", "").replace("!", "") if what == 2 else text or " "
        want[conv, turn, "user" if what == 4 else role or " ", text] += 0 if what == 0 else 2 if what == 3 else 1
    assert got == +want


def test_states_are_few():
    machine = repair.Repairer()
    reached, todo = {machine.end}, [machine.end]
    while todo:
        state = todo.pop()
        for sign in range(9):
            to, off = machine.step(state, sign)
            assert off >= 0
            if to not in reached:
                reached.add(to)
                todo.append(to)
    assert len(reached) < 64 and len(machine.steps) == 9 * len(reached)


# ---------------------------------------------------------------- resampling


def ranks_by_hand(docs, target, longest, buckets, percent, least):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def row(text):
        w = words(text)
        return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1))

    rows = [row(t) for _, t in docs]
    s, t = sum(rows, Counter()), sum(map(row, target), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), r in zip(docs, rows, strict=True):
        weight = sum(gain[b] * n for b, n in r.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), r.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [r for r in may[: percent * len(may) // 100]]
    return Counter(out), drawn


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_by_hand(spark, longest):
    draw = random.Random(7)
    vocabulary = ["Alpha", "beta", "Éa", "x9", "ßigma", "mu_nu", "tab\tbed", "\x00nul", "日本"]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)))) for i in range(300)] + [(None, None), (None, ""), (5, "beta " * 30_000), (5, "beta " * 30_000), (301, "!?")]
    target = ["alpha beta mu", None, "x9 x9 日本"]
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "ids", "at", "rank", "score", "id")}).repartition(7)
    out = resample.resample(given, spark.createDataFrame(enumerate(target), "item_id long, text string"), buckets=50, longest=longest, percent=13, min_words=4)
    rows = out.collect()
    expected, drawn = ranks_by_hand(docs, target, longest, 50, 13, 4)
    assert Counter(tuple(r)[:5] for r in rows) == expected
    assert [tuple(r)[:5] for r in sorted((r for r in rows if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, len(drawn) + 1))
    assert resample.take_drawn(given, out).count() == sum(d in {r[0] for r in drawn} for d, _ in docs)


def test_resampling_empty(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs, target).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_features, r.rank) for r in resample.resample(some, target, min_words=0, percent=100).collect()} <= {(1, 2, 1), (1, 2, 2), (2, 0, 1), (2, 0, 2)}


def test_matrix_blocks(spark):
    """Blocks are cut by their number of counts, and sums and products do not depend on where."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j * i}" for j in range(40))) for i in range(100)], "doc_id long, text string")
    whole = resample.count_matrix(docs, buckets=97)
    resample_cut, resample.BLOCK_COUNTS = resample.BLOCK_COUNTS, 50
    try:
        cut = resample.count_matrix(docs, buckets=97)
        gain = np.arange(97) - 40
        assert cut.count() > whole.count()
        assert sorted(map(tuple, resample.column_sums(cut, 97).collect())) == sorted(map(tuple, resample.column_sums(whole, 97).collect()))
        assert sorted(map(tuple, resample.weigh(cut, gain).collect())) == sorted(map(tuple, resample.weigh(whole, gain).collect()))
    finally:
        resample.BLOCK_COUNTS = resample_cut


def test_stored_blocks_are_read_in_bounded_pieces(spark, tmp_path, monkeypatch):
    """No row group and no Arrow batch of blocks grows with the documents of a task."""
    import pyarrow.parquet as pq

    from tessera.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = spark.range(12_000).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 199), i -> concat('w', id % 7, 'x', i)), ' ') AS text").coalesce(1)
    out = resample.resample(docs, docs.limit(3).selectExpr("doc_id AS item_id", "text"))
    assert out.count() == 12_000 and out.agg(F.sum("n_features")).first()[0] == 12_000 * 200 and out.where("rank IS NOT NULL").count() == 1200
    files = [f for f in map(pq.ParquetFile, tmp_path.rglob("*.parquet")) if "ptr" in f.schema_arrow.names]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    held = [max(g.column(i).num_values for i in range(g.num_columns)) for g in groups]
    assert sum(g.num_rows for g in groups) * 10_000 > sum(held) > 2_000_000 and max(held) <= 600_000
