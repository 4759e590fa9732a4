"""Operators against their plain twins, on small tables with nulls, ties, repeats and clashing names, and on sf0.001."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorewright.llm import bpe, common, components, jaccard, language, lines, merkle, metric, mixing, queries, sharding, substrings, token_files
from tests.llm import brute

SF = "/root/testdata/sf0.001"
BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, source string, lang string, size int, shard string, n_words string, `odd name` int, ids string, key int"


def table(spark, rows):
    """rows of (doc_id, text, source); the other columns clash with names the operators use."""
    return spark.createDataFrame([(d, t, s, "en", -1, "s", "w", 3, "i", 4) for d, t, s in rows], SCHEMA).repartition(3)


def passage(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


def odd_rows():
    long = " ".join(passage(20_000, 1))
    shared = " ".join(passage(60, 2))
    rows = [
        (1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "one", "b"), (5, "One two", "b"), (6, "one two", ""), (7, long, "c"), (8, long, None),
        (9, shared, "a"), (10, f"x y {shared} z", "a"), (11, f"{shared}\n{shared}", "b"), (12, "a " * 50, "a"), (13, "b b b " + "a " * 60, "a"),
        (14, "é ü\x0bword\x1fother <|endoftext|> 中文。", "a"), (15, shared.upper(), "a"), (16, shared, "a"),
    ]
    rows += [(20 + i, " ".join(passage(40, 5)[: 39 - i % 3] + [f"u{i}"]), "a") for i in range(12)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_rows())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


@pytest.fixture(params=["odd", "sf"])
def both(request, odd, docs, texts):
    return (odd, odd_rows()) if request.param == "odd" else (docs, texts)


OPERATORS = {
    "mix": mixing.mix, "jaccard": jaccard.near_duplicates, "encode": lambda d: bpe.decode(bpe.encode(d, BYTE), BYTE), "round_trip": lambda d: bpe.round_trip(d, BYTE), "shard": sharding.shard,
    "language": language.identify, "substrings": substrings.remove_repeats, "lines": lines.remove_repeats, "merkle": merkle.compare_edited,
    "fingerprints": merkle.fingerprints,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_tables_repeated_rows_and_null_ids(spark, name):
    run = OPERATORS[name]
    empty = run(table(spark, [(1, "x", "a")]).where("doc_id < 0"))
    assert empty.collect() == []
    rows = [(None, None, None), (None, "some words here", "a"), (None, "some words here", "a"), (3, "some words here", "a"), (3, "some words here", "a"), (3, "other", "a")]
    out = run(table(spark, rows))
    assert out.count() == len(rows)
    assert len(set(out.columns)) == len(out.columns)


# ---------------------------------------------------------------- mixing


def test_mix(both):
    df, rows = both
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    taken = Counter()
    for r in got:
        assert r["size"] == len(brute.words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] + r["part"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix(df.repartition(5)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in got}


def test_mix_draws_good_documents_first_and_repeats_rows(spark):
    good, poor = "plain words of common length make sense.", "a b c d e f g"
    df = spark.createDataFrame([(i, good if i % 2 else poor, "x" if i < 4000 else "y") for i in range(6000)], "doc_id long, text string, source string")
    out = mixing.mix(df, weights=(1, 7))
    share = {r["good"]: r["c"] for r in out.where("source = 'x'").groupBy((out.doc_id % 2).alias("good")).agg({"copies": "avg"}).withColumnRenamed("avg(copies)", "c").collect()}
    assert share[1] > 1.5 * share[0]
    mixed = mixing.repeat(out, df.columns)
    assert mixed.columns == df.columns and mixed.count() == out.agg(F.sum(out.copies + (out.part > 0).cast("int"))).first()[0]
    given, taken = Counter(df.select("doc_id", "text").collect()), Counter(mixed.select("doc_id", "text").collect())
    assert set(taken) <= set(given)  # whole texts only
    words = {s: sum(len(brute.words(r.text)) for r in mixed.where(F.col("source") == s).collect()) for s in "xy"}
    for r in out.groupBy("source").agg(F.sum("taken").alias("n"), F.max("size").alias("most")).collect():
        assert abs(words[r.source] - r.n) <= r.most / 2


def test_mix_repeats_odd_rows(spark):
    rows = [(None, None, None), (1, "", "a"), (2, "x", "a"), (2, "x", "a"), (3, "w " * 30_000, "a"), (4, " \n", "b"), (5, "y z", None)]
    df = table(spark, rows)
    mixed = mixing.repeat(mixing.mix(df), df.columns)
    assert mixed.columns == df.columns and {(r.doc_id, r.text, r.source) for r in mixed.collect()} <= set(rows)


# ---------------------------------------------------------------- n-gram Jaccard join


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard(both, k, num, den):
    df, rows = both
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, (num, den), k).collect()}
    assert got == brute.jaccard([(d, t) for d, t, _ in rows], k, num, den)


def test_jaccard_hot_lists_link_in_rounds(spark):
    base = passage(60, 9)
    r = random.Random(3)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(60)] = f"n{r.randrange(9)}"
        rows.append((i, " ".join(w), "a"))
    rows += [(1000 + i, " ".join(passage(60, 100 + i)), "a") for i in range(20)]
    want = brute.jaccard([(d, t) for d, t, _ in rows], 3, 9, 10)
    for representatives, pairs in ((2, 0.0), (4, 0.2)):
        got = jaccard.near_duplicates(table(spark, rows), representatives=representatives, pairs_per_entry=pairs).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_one_of_each(spark):
    rows = [(5, "a b c d e f g h", "s"), (2, "A b c d e f g h", "s"), (7, "other words", "s"), (8, None, "s"), (9, "", "s")]
    df = table(spark, rows)
    kept = jaccard.one_of_each(df, jaccard.near_duplicates(df))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8, 9] and kept.columns == df.columns


def test_one_of_each_leaves_one_row_of_a_group(spark):
    one, near, lone = " ".join(passage(60, 1)), " ".join([*passage(60, 1), "end"]), " ".join(passage(60, 2))
    rows = [(3, one, "s"), (3, one, "s"), (3, near, "s"), (4, one, "s"), (None, lone, "s"), (None, lone, "s"), (6, None, "s"), (7, "", "s")]
    df = table(spark, rows)
    found = jaccard.near_duplicates(df)
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(df, found).collect()]
    first = min((r.key, t) for r in found.collect() if r.doc_id == 3 for t in (one, near) if spark.range(1).select(jaccard.text_key(F.lit(t))).first()[0] == r.key)[1]
    assert sorted(kept, key=str) == sorted([(3, first), (None, lone), (6, None), (7, "")], key=str)


def test_prefixes_of_similar_sets_meet_under_every_order():
    rng = np.random.default_rng(4)
    ranks = rng.integers(0, 9, 1 << jaccard.SKETCH_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, int(rng.integers(0, 3)), dtype=np.uint64)))
        common = len(np.intersect1d(a, b))
        if len(b) and 10 * common >= 9 * (len(a) + len(b) - common):
            for o, shared in ((0, 1), (1, 1), (2, 4)):
                met = set(jaccard._prefix(a, ranks, o, (9, 10), shared)) & set(jaccard._prefix(b, ranks, o, (9, 10), shared))
                assert len(met) >= min(shared, -(-min(len(a), len(b)) * 9 // 10))


@pytest.mark.parametrize("similarity", [(9, 10), (4, 5), (2, 3), (1, 1)])
def test_similar_sets_have_parts_in_common(similarity):
    num, den = similarity
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), *rng.integers(60, 700, 60)]:
        for _ in range(5):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            kept = len(a) - int(rng.integers(0, len(a) * (den - num) // den + 1))
            more = rng.integers(0, 2**63, max(0, kept * den // num - len(a)), dtype=np.uint64)
            b = np.unique(np.append(rng.permutation(a)[:kept], more))
            common = len(np.intersect1d(a, b))
            assert common * den >= (len(a) + len(b) - common) * num
            if common == len(a) == len(b):
                continue
            (i, x), (j, y) = (jaccard.signatures(s, similarity) for s in (a, b))
            x, y = x[max(i, j) - i], y[max(i, j) - j]
            least = min(len(x), len(y)) - (len(a) + len(b)) * (den - num) // (den + num)
            assert len(np.intersect1d(x, y)) >= max(1, least)


def near_copies(n, edits, words=200):
    base, r = passage(words, 9), random.Random(3)
    rows = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(words), edits):
            w[at] = f"n{r.randrange(30)}"
        rows.append((i, " ".join(w), "a"))
    return rows


def test_jaccard_forms_no_rows_for_pairs_of_a_large_group(spark, monkeypatch):
    rows, sizes, staged = near_copies(240, 5), [], jaccard.staged

    def counted(df, *args, **kwargs):
        out = staged(df, *args, **kwargs)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(table(spark, rows)).collect()}
    assert got == brute.jaccard([(d, t) for d, t, _ in rows], 3, 9, 10)
    assert max(sizes) < len(rows) * (len(rows) - 1) / 4


def test_jaccard_compares_long_lists_in_blocks(spark, monkeypatch):
    rows = [*near_copies(60, 2), *[(100 + i, t, s) for i, t, s in near_copies(20, 1, 70)]]
    monkeypatch.setattr(jaccard, "LONG_LIST", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(table(spark, rows)).collect()}
    assert got == brute.jaccard([(d, t) for d, t, _ in rows], 3, 9, 10)
    assert 2 < len({c for _, c in got.values()}) < len(rows)


def test_jaccard_sends_a_set_once_to_each_block(spark, monkeypatch):
    rows, met, staged = near_copies(240, 8), [], jaccard.staged

    def counted(df, *args, **kwargs):
        out = staged(df, *args, **kwargs)
        if "side" in out.columns:
            met.extend((r.node, r.part & (1 << jaccard.SCHEME_BITS) - 1, r.i, r.j, r.side) for r in out.collect())
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(table(spark, rows)).collect()}
    assert got == brute.jaccard([(d, t) for d, t, _ in rows], 3, 9, 10)
    assert met and max(Counter(met).values()) == 1


@pytest.mark.parametrize("chain", [False, True])
def test_bundled_lists_keep_all_pairs(spark, chain):
    rng, step = random.Random(4), 1 << jaccard.SCHEME_BITS
    if chain:
        lists = {step * p + 3: range(10 * p, 10 * p + 12) for p in range(9)}
    else:
        lists = {step * p + scheme: [100 * (p % 2) + n for n in rng.sample(range(15), 9)] for p in range(8) for scheme in (3, 4)}
    found = {n: n - n % 3 for m in lists.values() for n in m}
    rows = [(p, n, found[n], max(Counter(found[x] for x in m).items(), key=lambda x: x[::-1])[0]) for p, m in lists.items() for n in m]

    def pairs(rows):
        of = defaultdict(list)
        for p, n, c, main in rows:
            of[p].append((n, c, main))
        return [(p % step, a, b) for p, m in of.items() for a, c, main in m if c != main for b, d, _ in m if c != d]

    out = [tuple(r) for r in jaccard._bundled(spark.createDataFrame(rows, "part long, node long, component long, main long")).collect()]
    either = lambda x: {(s, *sorted(ab)) for s, *ab in x}
    assert either(pairs(rows)) <= either(pairs(out)) and len(out) == len(set(out))
    assert sorted(out) == sorted(rows) if chain else len({p for p, *_ in out}) == 4 and len(pairs(out)) < len(pairs(rows))


def test_jaccard_writes_no_parts_that_one_set_has_alone(spark, monkeypatch):
    rows = [(i, " ".join(passage(250, i)), "a") for i in range(120)]
    rows += [(200 + i, f"{t} more words at the end", s) for i, t, s in rows[:9]]
    parts, written, staged, possible = [], [], jaccard.staged, jaccard._possible

    def counted(df, *args, **kwargs):
        out = staged(df, *args, **kwargs)
        written.append(sum(Path(f.removeprefix("file://").removeprefix("file:")).stat().st_size for f in out.inputFiles()))
        return out

    def judged(pairs, nodes, *args):
        parts.extend(x for r in nodes.select(F.explode("parts").alias("part")).collect() for x in (r.part if isinstance(r.part, list) else [r.part]))
        return possible(pairs, nodes, *args)

    monkeypatch.setattr(jaccard, "staged", counted)
    monkeypatch.setattr(jaccard, "_possible", judged)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(table(spark, rows), (4, 5), 5).collect()}
    assert got == brute.jaccard([(d, t) for d, t, _ in rows], 5, 4, 5)
    assert all(got[200 + i][1] == i for i in range(9))
    assert parts and min(Counter(parts).values()) > 1
    assert max(written) < 8 * 250 * len(rows) / 2


@pytest.mark.parametrize("buckets,bits,name_bytes", [(1, 20, 2), (7, 37, 4), (3000, 44, 8)])
def test_packed_signatures_meet(buckets, bits, name_bytes):
    rng = np.random.default_rng(7)
    known = rng.integers(0, 2**64, 20_000, dtype=np.uint64) >> np.uint64(7) << np.uint64(7) | rng.integers(1, 30, 20_000).astype(np.uint64)
    parts, names = rng.choice(known, 40_000), rng.integers(0, 2**64, 40_000, dtype=np.uint64)
    rows = list(jaccard.packed(parts, names, buckets, bits, name_bytes))
    assert all(0 <= b < buckets for b, _ in rows)
    assert sum(len(x) for _, x in rows) <= 40_000 * (-(-(bits + jaccard.SCHEME_BITS) // 8) + name_bytes)
    met = [(b, int(p), int(n)) for b, x in rows for p, n in zip(*jaccard.unpacked(x, bits, name_bytes), strict=True)]
    short = lambda p: p >> 64 - bits << jaccard.SCHEME_BITS | p & (1 << jaccard.SCHEME_BITS) - 1
    assert sorted((p, n) for _, p, n in met) == sorted((short(int(p)), int(n) >> 64 - 8 * name_bytes) for p, n in zip(parts, names, strict=True))
    assert len({(b, p) for b, p, _ in met}) == len({p for _, p, _ in met})


def test_signatures_of_one_node_alone_are_no_rows(spark):
    """Signatures are shuffled packed; of some 10,000 only those become rows that two sets have: a copy's, and a few of empty parts."""
    rows = [(i, " ".join(passage(250, i)), "a") for i in range(120)] + [(200, " ".join([*passage(250, 5), "end"]), "a")]
    df = table(spark, rows)
    named = common.staged(jaccard._described(df, 5, (4, 5)), "jaccard")
    nodes = named.select("node", "n", "of", F.lit(12).alias("scheme"), F.col("doc_id").alias("id"), "key", F.lit(1).alias("rows"))
    out = jaccard._signed(df, named, nodes, 5, (4, 5))
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    out = [tuple(r) for r in out.collect()]
    sets = {r.doc_id: (r.node, r.n, r.of) for r in named.collect()}
    assert len(out) == len({x[:2] for x in out}) < sum(sum(of) for _, _, of in sets.values()) / 4
    assert {(node, n, of[0]) for node, n, of in sets.values()} >= {(node, n, of) for p, node, n, of in out if p % 128 == 12}
    of = [{p for p, node, *_ in out if node == sets[i][0]} for i in (5, 200)]
    assert len(of[0] & of[1]) > 30


def test_pairs_are_judged_by_their_lists(spark):
    """Three sets of 200 tokens (62 parts in scheme 11): 1 and 2 share 41 lists, 1 and 3 share 40, fewer than similar sets share."""
    part = lambda k: k << jaccard.SCHEME_BITS | 11
    rows = [(part(k), n, 200, 85, n, main, 2) for k, pair, main in [*[(k, (1, 2), 2) for k in range(41)], *[(k, (1, 3), 1) for k in range(50, 90)]] for n in pair]
    rows += [(200 << jaccard.SCHEME_BITS | 12, n, 200, 1, n, 1, 2) for n in (1, 3)]  # in no scheme of theirs
    lists = spark.createDataFrame(rows, "part long, node long, n long, of long, component long, main long, m long")
    assert 85 - 2 * 200 // 9 == 41
    assert [tuple(r) for r in jaccard._pairs(lists, (4, 5)).collect()] == [(1, 2)]


def test_one_of_each_shuffles_no_texts(spark, monkeypatch):
    """More documents stay than a broadcast holds; those that go are few."""
    rows = [(i, " ".join(passage(60, i)), "a") for i in range(60)] + [(100, " ".join([*passage(60, 1), "end"]), "a"), (None, "one two", "a"), (None, None, "a")]
    df = table(spark, rows)
    found = jaccard.near_duplicates(df)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    with common.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = jaccard.one_of_each(df, found)
        assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.doc_id, r.text) for r in out.where("doc_id is not null").collect()) == sorted((d, t) for d, t, _ in rows[:60])
    assert sorted(r.text or "" for r in out.where("doc_id is null").collect()) == ["", "one two"]


@pytest.mark.parametrize("similarity", [(1, 1), (999, 1000), (1, 2)])
def test_schemes_fit_their_bits(spark, similarity):
    assert len(jaccard._schemes(similarity)) <= 1 << jaccard.SCHEME_BITS
    rows = [(i % 4, " ".join(passage(40, i % 3)), "a") for i in range(8)] + [(9, " ".join([*passage(40, 1), "end"]), "a"), (None, "one two", "a"), (None, "one two", "a")]
    num, den = similarity
    known = [(d, t) for d, t, _ in rows if d is not None]
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.near_duplicates(table(spark, rows), similarity).collect()}
    want = brute.jaccard([(1000 * d + j, t) for j, (d, t) in enumerate(known)], 3, num, den)
    assert got == {(k // 1000, n, c // 1000) for k, (n, c) in want.items()} | {(None, 1, None)}


def test_common_tokens_of_blocks():
    rng = np.random.default_rng(6)
    sides = [rng.random((n, 90)) < rng.random(90) for n in (40, 25)]
    at = [np.nonzero(s) for s in sides]
    got = jaccard._common([r for r, _ in at], [t for _, t in at], (40, 25))
    assert (got == sides[0].astype(int) @ sides[1].astype(int).T).all()


@pytest.mark.parametrize("edges", [[(0, 0)], [(i, i + 1) for i in range(40)] + [(90, 91), (91, 90)], [(7 * i % 31, 7 * (i * i + 3) % 31) for i in range(12)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == brute.components(nodes, [e for e in edges if e[0] != e[1]])


# ---------------------------------------------------------------- tokens


@pytest.mark.parametrize("end", [1, 60_000])
def test_token_files(spark, both, tmp_path, end):
    df, rows = both
    tok = Tokenizer.from_file(WORDS)
    manifest = token_files.write(df, f"{tmp_path}/ids", WORDS, end_id=end, block_ids=64)
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    start = 0
    for r, (d, t, _) in zip(got, sorted(rows), strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens) == (d, start, len(ids) // 4) and r.ids == ids
        start += r.n_tokens
    first = manifest.orderBy("shard").first()
    file = token_files.Reader(first.path)
    everything = file.ids(0, file.n_ids)
    for at, n in ((0, 1), (63, 2), (5, file.n_ids - 5), (file.n_ids, 0)):
        assert (file.ids(at, n) == everything[at : at + n]).all()


def test_token_files_of_nothing(spark, tmp_path):
    manifest = token_files.write(table(spark, [(1, "x", "a")]).where("doc_id < 0"), f"{tmp_path}/ids", WORDS)
    assert manifest.count() == 0 and token_files.read(manifest).count() == 0


@given(st.lists(st.integers(0, 2**17 - 1), max_size=70), st.sampled_from([17, 20, 32]))
@settings(max_examples=60)
def test_packing(ids, bits):
    a = np.array(ids, np.uint32)
    data = token_files.pack(a, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (token_files.unpack(data, len(ids), bits) == a).all()


def test_bpe(both):
    df, rows = both
    tok = Tokenizer.from_file(BYTE)
    got = bpe.decode(bpe.encode(df, BYTE, mean_bytes=32), BYTE)
    assert [c for c in got.columns if c not in ("ids", "decoded")] == [c for c in df.columns if c != "ids"]
    want = {d: tok.encode(t or "", add_special_tokens=False).ids for d, t, _ in rows}
    for r in got.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
        assert r.decoded == tok.decode(want[r.doc_id], skip_special_tokens=False)
    once = bpe.round_trip(df, BYTE, mean_bytes=32)
    assert once.schema == got.schema and Counter(map(repr, once.collect())) == Counter(map(repr, got.collect()))


CHARS = st.lists(st.sampled_from([*"ab Z.,'!?\n\t0é  中<|>endoftx", "<|endoftext|>", "'re", "  "]), max_size=300).map("".join)


@given(st.lists(CHARS, min_size=1, max_size=4), CHARS)
@settings(max_examples=150, deadline=None)
def test_bpe_chunks_agree_with_the_library(texts, shared):
    tok = bpe.load(BYTE)
    for size in (4, 16, 64):
        chunks = bpe.encoder(BYTE, size)
        all_ = [x for t in texts for x in (t, t + shared * 3, shared * 3 + t)]
        for x, ids in zip(all_, chunks.encode([x.encode() for x in all_]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


@given(CHARS)
@settings(max_examples=150, deadline=None)
def test_words_tokenize_independently(text):
    words = token_files.words(WORDS)
    texts = [text, None, text.replace("<", "x"), "", text * 3]
    assert [ids.tolist() for ids in words.ids(texts)] == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(0, 50256), max_size=60))
@settings(max_examples=100, deadline=None)
def test_decoding_any_ids(ids):
    pieces = bpe.pieces_of_bytes(BYTE)
    assert b"".join(pieces[i] for i in ids).decode("utf-8", "replace") == bpe.load(BYTE).decode(ids, skip_special_tokens=False)


# ---------------------------------------------------------------- shards


def test_shards(both):
    df, rows = both
    out = sharding.shard(df, bucket_bytes=2000).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _, _ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append((r.slot, r.doc_id))
        assert r.grown_shard in (r["shard"], 8)
    for s, found in slots.items():
        assert 0 <= s < 8 and [x[0] for x in sorted(found)] == list(range(len(found)))
    if len(rows) > 100:
        assert max(map(len, slots.values())) < 2 * min(map(len, slots.values()))
        assert any([d for _, d in sorted(v)] != sorted(d for _, d in v) for v in slots.values())
    again = {(r.doc_id, r["shard"], r.slot) for r in sharding.shard(df.repartition(7), bucket_bytes=2000).collect()}
    assert again == {(r.doc_id, r["shard"], r.slot) for r in out}


# ---------------------------------------------------------------- languages


def test_letters_are_those_of_category_l():
    import sys
    import unicodedata

    for c in map(chr, range(sys.maxunicode + 1)):
        if not 0xD800 <= ord(c) < 0xE000:
            assert language.has_letter(f" {c}1") == unicodedata.category(c).startswith("L")


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, f"the words of a text number {i}", "a") for i in range(30)] + [(100, "² ½ 12", "a"), (101, "Ⅷ", "a"), (102, "_ ◌́ 7", "a"), (103, "ª", "a")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(table(spark, rows)).collect()}
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102)) and got[103][0] == "en"


def test_language_of_many_rows_with_one_id(spark):
    rows = [(None, f"row {i} of many words", "a") for i in range(3000)] + [(7, "equal rows of one id", "a")] * 500
    model = language.fit(table(spark, rows), F.lit(True), sample_per_class=50)
    assert model.languages == ["en"]


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs.select("doc_id", "text", "lang")).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    judged = [r for r in held if r.lang_pred != "und"]
    assert len(judged) > 0.9 * len(held) and np.mean([r.lang == r.lang_pred for r in judged]) > 0.97
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (r.score == 0) for r in rows)


def test_language_learns_from_training_rows_only(spark):
    rows = [(i, t, lg) for i, (t, lg) in enumerate([("der und die", "de"), ("the and of", "en")] * 60)]
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "123 ...", "en"), (1002, "the of and", None)], "doc_id long, text string, lang string")
    flipped = df.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'xx' else lang end lang")
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(flipped).collect()}
    assert a == b and a[1000] == a[1001] == ("und", 0.0) and a[1002][0] == "en"


def test_weights_are_sparse():
    xs = [language.features(t, np.ones(language.FEATURES)) for t in ["der und die", "the and of"] * 40]
    w, _ = language.follow_the_leader(xs, [0, 1] * 40, 2)
    assert 0 < np.count_nonzero(w) < 200


# ---------------------------------------------------------------- repeated words and lines


@pytest.mark.parametrize("window", [20, 5])
def test_substrings(both, window):
    df, rows = both
    want = brute.windows_removed([(d, t) for d, t, _ in rows], window)
    for r in substrings.remove_repeats(df, window).collect():
        w, gone = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (len(w), len(gone)), r.doc_id
        assert r.kept_text == " ".join(x for i, x in enumerate(w) if i not in gone)


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=12, max_size=30))
@settings(max_examples=300, deadline=None)
def test_equal_windows_have_equal_signs(left, right, middle):
    """Small alphabets give many runs; a window's sign must not depend on what is around it."""
    by_content = {}
    for doc in (left + middle + right, right + middle + left, middle):
        h = substrings.word_hashes([b"%d" % x for x in doc])
        sign, place = substrings.signs_of_windows(h, 12)
        for i in range(len(sign)):
            by_content.setdefault(tuple(doc[i : i + 12]), set()).add(int(sign[i]) if place[i] >= 0 else None)
    assert all(len(v) == 1 for v in by_content.values())


@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_stretches_hold_each_window_once(texts):
    """Texts worked on together give what each gives alone; equal stretches have one name, others none in common."""
    split = [[b"%d" % x for x in t] for t in texts]
    together = list(zip(*(c.tolist() for c in substrings.stretches(*substrings._joined(split), 12)), strict=True))
    alone = [(i, *row[1:]) for i, t in enumerate(split) for row in zip(*(c.tolist() for c in substrings.stretches(*substrings._joined([t]), 12)), strict=True)]
    assert together == alone
    assert [(i, p) for i, s, n, *_ in together for p in range(s, s + n)] == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 11)]
    kinds = {}
    for i, s, n, *kind in together:
        kinds.setdefault(tuple(kind), set()).add(tuple(texts[i][s : s + n + 11]))
    assert all(len(k) == 1 for k in kinds.values())


def test_single_repeated_lines_and_heavy_ones_go(spark, monkeypatch):
    monkeypatch.setattr(lines, "HEAVY_ROWS", 3)
    line = "this line of eleven words stands in every document of them"
    rows = [(i, f"own first line of document {i}\n{line}\nfour words stay here\nlast {i}") for i in range(9)]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in lines.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (0, rows[0][1])
    # the two lines in the middle repeat together, so the short one goes with the long one
    assert all(got[i] == (2, f"own first line of document {i}\nlast {i}") for i in range(1, 9))


@pytest.mark.parametrize("window,long_words", [(2, 5), (2, 50), (3, 10_000), (4, 3)])
def test_lines(spark, both, window, long_words):
    df, rows = both
    rows = [(d, t, s) for d, t, s in rows]
    extra = [(500, "a\nb\nc\nd\na\nb", "x"), (501, "b\nc\n\n\nx", "x"), (502, "\n\n\n", "x"), (503, "q\nb\nc\nd\nz", "x"), (504, "a\nb\nc\nd\na\nb", "x")]
    extra = [(d + 10**6, t, s) for d, t, s in extra]
    df = df.select("doc_id", "text", "source").unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    want = brute.lines_kept([(d, t) for d, t, _ in rows + extra], window, long_words)
    for r in lines.remove_repeats(df, window, long_words).collect():
        assert (r.n_lines, r.n_removed, r.kept_text) == want[r.doc_id]


def test_native_operators_run_no_python(docs):
    for df in (mixing.mix(docs), lines.remove_repeats(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


# ---------------------------------------------------------------- vectors


def test_vectors(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(6, 16))
    v = [(centre[i % 6] + rng.normal(size=16) * 0.12 * (1 + i % 3)).tolist() for i in range(240)] + rng.normal(size=(60, 16)).tolist()
    rows = [*enumerate(v), (500, None), (501, []), (502, [0.0] * 16), (503, [None] * 16), (504, [float("nan")] * 16), (505, [float("inf")] + [1.0] * 15), (506, v[0][:8]), (507, v[0]), (508, [1e-300 * x for x in v[0]]), (509, [1e300 * x for x in v[0]])]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, n int, label int").repartition(4)
    want = brute.vectors([(i, [y / 1e300 for y in x] if i == 509 else [y * 1e300 for y in x] if i == 508 else x) for i, x in rows], 0.95)
    for cell, block in ((4096, 4096), (40, 16), (40, 1000)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in metric.near_duplicates(df, cell_rows=cell, block_rows=block).collect()}
        assert got == want


def test_vectors_repeated_null_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in metric.near_duplicates(df).collect())
    assert got == [(0, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert metric.near_duplicates(df.where("vec_id > 9")).collect() == []


# ---------------------------------------------------------------- fingerprints


@pytest.mark.parametrize("range_bytes", [8_000_000, 3000])
def test_fingerprints(both, range_bytes):
    df, rows = both
    rows = sorted(rows)
    got = {r.doc_id: r for r in merkle.compare_edited(df, range_bytes).collect()}
    assert len(got) == len(rows)
    for (d, t, _), (e, u, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u, r = t or "", u or "", got[d]
        n = len(t)
        edited = t[: n - n // 2] + u[: n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == merkle.fingerprint(t) and r.edited_fingerprint == merkle.fingerprint(edited)
        assert r.near_next == merkle.likeness(r.fingerprint, got[e].fingerprint) and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (edited == t)


def test_differences_locate_edits():
    paragraphs = [f"Paragraph {i} begins, goes on; and ends. Number {i}." for i in range(40)]
    a = "\n".join(paragraphs)
    paragraphs[17] = "Paragraph 17 begins, goes elsewhere; and ends. Number 17."
    b = "\n".join(paragraphs)
    fa, fb = merkle.fingerprint(a), merkle.fingerprint(b)
    assert merkle.differences(fa, fa) == [] and merkle.likeness(fa, fa) == 1.0
    found = merkle.differences(fb, fa)
    assert len(found) == 1 and found[0][2] == 1 and 0.9 < merkle.likeness(fa, fb) < 1
    assert merkle.likeness(fa, merkle.fingerprint("")) == 0.0


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_queries_return_a_row_per_row(spark, name):
    source = "embeddings" if name.startswith("op9") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_known_chunks_go_in_part(monkeypatch):
    texts = [" ".join(passage(600, 70 + i)).encode() for i in range(6)]
    tok = Tokenizer.from_file(BYTE)
    coder = bpe.Chunks(bpe.units(BYTE), 64)
    coder.encode(texts[:4])
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", len(coder.known))
    first, before = list(coder.known)[0], list(coder.known)[-1]
    got = coder.encode([texts[4]])
    assert before in coder.known and first not in coder.known and len(coder.known) <= bpe.KEPT_CHUNKS
    for t, ids in zip([texts[4], *texts], [*got, *coder.encode(texts)], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t.decode(), add_special_tokens=False).ids


def test_a_worker_keeps_the_tables_of_one_operator():
    first = bpe.encoder(BYTE, 64)
    assert bpe.encoder(BYTE, 64) is first
    common.worker_tables("another")
    assert bpe.encoder(BYTE, 64) is not first


def test_staging_leaves_the_session_as_it_was(spark):
    before = {k: spark.conf.get(k, None) for k in (common.CLEANUP, common.BATCH)}
    spark.conf.set(common.BATCH, "7")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(common.BATCH) == "7"
        assert common.staged(spark.range(9)).count() == 9 and spark.conf.get(common.BATCH) == "7"
    finally:
        spark.conf.unset(common.BATCH)
    assert before == {k: spark.conf.get(k, None) for k in before}
