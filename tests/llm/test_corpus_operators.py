"""Fixity audit, neighbours, mixing, near duplicates, repeated passages and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sectional.llm import bwt, cascade, fixity, mixing, neardup, neighbours, packing, repeats
from sectional.llm.components import components
from sectional.llm.queries import ORACLE, QUERIES, ranks_path

from .corpus import SCHEMA, documents, lower, nothing, rows, words


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    res = con.execute(ORACLE[name])
    names = sorted(d[0] for d in res.description)
    order = [d[0] for d in res.description]
    want = Counter(tuple(repr(r[order.index(n)]) for n in names) for r in res.fetchall())
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(out.columns) == names
    assert Counter(tuple(repr(r[n]) for n in names) for r in out.collect()) == want


def manifest(spark, digests, drop=()):
    at, out = 0, []
    for k, d in enumerate(digests):
        if k not in drop:
            out.append((k, k // 10, at, len(d), 1, d))
        at += len(d)
    return spark.createDataFrame(out, "rank long, file long, offset long, length long, copies long, digest string")


def test_fixity_audit(spark):
    good = [f"d{k}" for k in range(100)]
    bad = [x if k not in (3, 50, 99) else "?" * len(x) for k, x in enumerate(good)]
    found = fixity.audit(manifest(spark, good), manifest(spark, bad, drop=(7,)), fanout=3).collect()
    assert {r["rank"]: (r["digest_a"], r["digest_b"]) for r in found} == {3: ("d3", "??"), 50: ("d50", "???"), 99: ("d99", "???"), 7: ("d7", None)}
    assert fixity.audit(manifest(spark, good), manifest(spark, good), fanout=3).collect() == []
    assert fixity.audit(manifest(spark, []), manifest(spark, []), fanout=3).collect() == []


def test_fixity_order_has_nulls_first_and_no_gaps(spark):
    table = spark.createDataFrame([(None, "b"), (2, "a"), (1, "z"), (None, "a"), (2, "b")], "id long, d string")
    got = sorted((r["rank"], r["id"], r["d"]) for r in fixity.in_order(table, "id", "d").collect())
    assert got == [(0, None, "a"), (1, None, "b"), (2, 1, "z"), (3, 2, "a"), (4, 2, "b")]


def brute_neighbours(table, ids, k):
    usable = [(i, np.array(v, float)) for i, v in table if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for q, x in usable:
        if ids(q):
            best = defaultdict(lambda: -9.0)
            for i, y in usable:
                if i != q:
                    best[i] = max(best[i], float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)))
            out[q] = sorted(((-round(s, 9), i) for i, s in best.items()))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    table = [(i, [float(np.float32(x)) for x in rng.normal(size=8) + (i % 5) * 2]) for i in range(700)]
    table += [(1000 + i, table[10][1]) for i in range(40)] + [table[3], (2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [None] + [1.0] * 7),
                                                           (2004, [1.0]), (None, [1.0] * 8), (2005, [float("inf")] * 8), (2006, [])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "'x' as key")
    out = neighbours.search(df, queries=F.col("vec_id") % 20 == 0).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r["query_id"]].append((-round(r["score"], 9), r["vec_id"]))
    want = brute_neighbours(table, lambda q: q % 20 == 0, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in sorted(neighbours.search(few, queries=F.col("vec_id") % 20 == 0).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_graph_finds_nearest_centroids():
    x = np.random.default_rng(0).normal(size=(3000, 16)).astype(np.float32)
    book = neighbours.Centroids(x, 200)
    found, _ = book.search(neighbours.unit(x[:300]), 16)
    exact = neighbours.distances(neighbours.unit(x[:300]), book.c).argmin(1)
    assert np.mean(found[:, 0] == exact) > 0.98


def test_mixing_targets_by_hand(spark):
    # caps 30, 300, 300 of 210; by weight 1:2:3 the first would get 35, so 5 are shared again 2:3
    table = spark.createDataFrame([("a", 10), ("b", 100), (None, 100)], "mix_source string, source_size long")
    got = {r["mix_source"]: r["target"] for r in mixing.targets(table).collect()}
    assert got == {"a": pytest.approx(30), "b": pytest.approx(72), None: pytest.approx(108)}


def test_mixing_copies(spark):
    planned = mixing.plan_mix(documents(spark)).collect()
    assert Counter((r["doc_id"], r["mix_size"]) for r in planned) == Counter((r[0], len(words(r[1]))) for r in rows())
    copies = Counter()
    for r in planned:
        rate = r["mix_target"] / r["mix_source_size"] if r["mix_source_size"] else 0
        assert int(rate) <= r["mix_copies"] <= min(3, int(rate) + 1) or r["mix_source_size"] == 0
        copies[r["doc_id"], r["text"]] += r["mix_copies"]
    mixed = mixing.mix(documents(spark))
    assert mixed.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == +copies
    assert set(r["mix_size"] for r in mixed.collect()) <= {-1, 1, None}  # the input's own column
    assert mixing.mix(nothing(spark)).collect() == []


def shingles(text, n):
    w = words(lower(text))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(table, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in table]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    live = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, s) in enumerate(live):
        for j, u in live[:x]:
            if 100 * len(s & u) >= percent * len(s | u):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    out = neardup.near_duplicates(documents(spark), n=n).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == brute_components([(r[0], r[1]) for r in rows()], n)


def test_near_duplicates_of_large_regions(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 4)  # so that regions are cut deeper and met block by block
    base = [f"w{k}" for k in range(120)]
    table = []
    for i in range(60):
        own = list(base)
        for k in range(i % 12):
            own[(7 * i + 11 * k) % 120] = f"x{i}.{k}"
        table.append((i, " ".join(own)))
    out = neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), n=2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == brute_components(table, 2)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(nothing(spark)).collect() == []


def test_near_duplicates_in_dense_regions(spark, monkeypatch):
    # all texts share 640 words, so regions are far above REGION; pairs are at exactly 0.8, other texts at 0.55
    monkeypatch.setattr(neardup, "REGION", 16)
    assert 1 - (1 - 0.8 ** neardup.DEPTH) ** neardup.TREES > 0.9999
    all_share, table = [f"c{i}" for i in range(640)], []
    for k in range(300):
        pair = [f"p{k}x{i}" for i in range(160)]
        table += [(2 * k + j, " ".join(all_share + pair + [f"o{k}x{j}x{i}" for i in range(100)])) for j in range(2)]
    out = neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), n=1).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in out) == Counter((i, i - i % 2) for i, _ in table)


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(6, 30)] + [(3, 29), (200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {**{k: 100 for k in range(101, 141)}, **{k: 3 for k in range(5, 30)}, 201: 200}


def brute_repeats(table, length=50):
    first = {}
    for i, t in table:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1 if i is not None else 0):
            first[raw[k:k + length]] = min(i, first.get(raw[k:k + length], i))
    out = Counter()
    for i, t in table:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1 if i is not None else 0):
            if first[raw[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out[(i, len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())] += 1
    return out


def test_repeated_passages(spark, monkeypatch):
    table = [(r[0], r[1]) for r in rows()] + [(500, "ab" * 400), (499, "ba" * 90 + "c"), (501, "z" * 49), (502, "z" * 50), (503, "é" * 80), (504, "x" + "é" * 30), (505, "\0" * 70), (506, "\0" * 51 + "a")]
    df = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "2 as rep_key", "3 as key")
    for size in (repeats.BUCKET_BYTES, 2000):
        monkeypatch.setattr(repeats, "BUCKET_BYTES", size)
        out = repeats.remove_repeats(df).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute_repeats(table)
    left = repeats.without_repeats(df)
    assert left.columns == df.columns and left.count() == len(table)
    assert repeats.remove_repeats(nothing(spark)).collect() == []


def test_merged_transforms_equal_sorted_suffixes():
    rng = np.random.default_rng(1)
    for shard in (1, 40, 1 << 20):
        strings = [bytes(rng.choice(list(b"ab\0\xff"), rng.integers(1, 30)).astype(np.uint8)) for _ in range(40)]
        string, place, interval = bwt.repeated_intervals(strings, 5, shard)
        groups = defaultdict(set)
        for s, p, i in zip(string.tolist(), place.tolist(), interval.tolist()):
            groups[i].add((s, p))
        want = defaultdict(set)
        for s, x in enumerate(strings):
            for p in range(len(x) - 4):
                want[x[p:p + 5]].add((s, p))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
        heads = [strings[s][p:p + 5] for s, p in zip(string, place)]
        assert heads == sorted(heads)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 9, 12])
@pytest.mark.parametrize("letters", [b"ab", bytes(range(256))])
def test_the_merge_deals_by_two_symbols(monkeypatch, depth, letters):
    """Half the rounds, the same order and common prefixes."""
    rng = random.Random(depth)
    base = bytes(rng.choice(letters) for _ in range(40)) + letters
    shards = [[base[i:i + rng.randrange(1, 30)] for i in rng.choices(range(40), k=3)] for _ in range(4)] + [[base]]
    texts = [bwt.shard_text(s) for s in shards]
    transforms = [bwt.transform(t)[0] for t in texts]
    rounds, sort = [0], np.argsort
    with monkeypatch.context() as m:
        m.setattr(np, "argsort", lambda *a, **k: (rounds.__setitem__(0, rounds[0] + 1), sort(*a, **k))[1])
        shard, common = bwt.merge(transforms, depth)
    single = min(depth, 2) if len(letters) < 256 else depth
    assert rounds[0] == len(shards) + single + (depth - single + 1) // 2
    want = sorted((tuple(np.roll(t, -i)[:depth].tolist()), k) for k, t in enumerate(map(lambda t: np.tile(t, depth), texts)) for i in range(len(t) // depth))
    assert [k for _, k in want] == shard.tolist()
    same = [next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), depth) for (a, _), (b, _) in zip(want, want[1:])]
    assert common.tolist() == [0, *same]


def test_common_prefixes_of_the_merge():
    strings = [b"banana", b"bandana", b"anagram", b"nab"]
    parts = [bwt.transform(bwt.shard_text([s])) for s in strings]
    shard, common = bwt.merge([p[0] for p in parts], 4)
    seen, rotations = Counter(), []
    for k in shard.tolist():
        text = bwt.shard_text([strings[k]])
        rotations.append(np.roll(text, -parts[k][1][seen[k]])[:4].tolist())
        seen[k] += 1
    assert rotations == sorted(rotations)
    for k in range(1, len(rotations)):
        same = 0
        while same < 4 and rotations[k][same] == rotations[k - 1][same]:
            same += 1
        assert common[k] == same


def test_sets_are_made_of_sieved_texts(spark):
    rows = spark.range(3000).withColumnRenamed("id", "node").selectExpr("node", "'text' as text")
    wanted = rows.where("node % 100 = 7 and node < 2500").select("node")
    left = {r["node"] for r in neardup.sieved(rows, wanted.unionByName(wanted)).collect()}
    assert left >= set(range(7, 2500, 100)) and len(left) < 40
    assert neardup.sieved(rows, wanted.where("false")).count() == 0


def test_a_pair_meets_in_one_region(spark, monkeypatch):
    # 40 pairs of a similarity of about 0.72: candidates in most trees, no links
    table = []
    for k in range(40):
        for half in (0, 1):
            table.append((2 * k + half + 1, " ".join([f"w{k}x{j}" for j in range(180)] + [f"o{k}y{half}z{j}" for j in range(35)])))
    table.append((101, table[0][1] + " more"))
    kept, write = {}, neardup.stage

    def stage(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(neardup, "stage", stage)
    out = neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), n=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: 1 if i == 101 else i for i, _ in table}
    assert 40 < kept["region-rows"].count() <= 2 * 42


def test_a_row_meets_its_region_once(spark, monkeypatch):
    # large regions are cut by counts: no row is written again for each depth
    rng = random.Random(3)
    monkeypatch.setattr(neardup, "REGION", 4)
    path = lambda digits: sum(d << neardup.BITS * (neardup.DEPTH - 1 - k) for k, d in enumerate(digits))
    trees = {(t, n): [rng.choice([5, 5, 5, 5, 9, 1023]) for _ in range(neardup.DEPTH)] for t in range(3) for n in range(90)}
    joined = {n: n - n % 7 for n in range(70)}
    want, groups = set(), {}
    for (t, n), digits in trees.items():
        for depth in range(neardup.MIN_DEPTH, neardup.DEPTH + 1):
            groups.setdefault((t, tuple(digits[:depth])), []).append(n)
    for (t, n), digits in trees.items():
        for depth in range(neardup.MIN_DEPTH, neardup.DEPTH + 1):
            own = groups[t, tuple(digits[:depth])]
            if len(own) <= neardup.REGION or depth == neardup.DEPTH:
                parts = Counter(joined.get(x, x) for x in own)
                if len(parts) > 1:
                    want.add((t, n, depth, joined.get(n, n), joined.get(n, n) == max(parts, key=lambda c: (parts[c], c))))
                break
    assert len({w[2] for w in want}) == neardup.DEPTH - neardup.MIN_DEPTH + 1
    written, write = [], neardup.stage

    def stage(df, name):
        out = write(df, name)
        written.append(out.count() if "node" in out.columns else 0)
        return out

    monkeypatch.setattr(neardup, "stage", stage)
    rows = spark.createDataFrame([(t, path(digits), n) for (t, n), digits in trees.items()], "tree byte, path long, node long")
    out = neardup.regions_of(rows, spark.createDataFrame(list(joined.items()), "node long, component long"))
    assert {(r["tree"], r["node"], r["depth"], r["component"], r["main"]) for r in out.collect()} == want
    assert sum(written) <= 2 * len(trees)


def test_representatives_are_exchanged_without_a_table(spark, monkeypatch):
    table = [(k, f"{'shared words of two texts ' * 3}{k} {'own ' * k}") for k in range(1, 9)]
    named, write = [], repeats.stage
    monkeypatch.setattr(repeats, "stage", lambda df, name: (named.append(name), write(df, name))[1])
    for size in (1 << 20, 300):  # texts that share within a slice, and across slices
        monkeypatch.setattr(repeats, "SLICE", size)
        out = repeats.remove_repeats(spark.createDataFrame(table, "doc_id long, text string")).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute_repeats(table)
    assert "representatives" not in named and "fragments" in named


def test_rotations_are_sorted_again_only_where_they_tie(monkeypatch):
    rng = np.random.default_rng(2)
    own = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    text = bwt.shard_text([own, own[:300], b"a" * 40])
    plain, sizes = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda a, *more, **named: (sizes.append(len(a)), plain(a, *more, **named))[1])
    order = bwt.rotation_order(text)
    twice = np.concatenate([text, text]).astype(">u2").tobytes()
    n = len(text)
    assert order.tolist() == sorted(range(n), key=lambda p: twice[2 * p:2 * (p + n)])
    assert sum(sizes) < 2 * n


def test_pipeline_against_brute_force(spark, tmp_path):
    table = [r[:5] for r in rows(seed=3)] + [(900 + k, "%%% ### &&& " * 60, "en", "src1", 720) for k in range(3)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), table
    results = []
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        results.append(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    def rows_of(df):
        return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect())

    from .test_text_operators import brute_quality

    left = [r for r in left if brute_quality(r[1])[-1]]
    assert rows_of(results[0]) == Counter(left)
    gone = {k[0] for k in brute_components([r[:2] for r in left], 5) if not k[3]}
    left = [r for r in left if r[0] not in gone]
    assert rows_of(results[1]) == Counter(left)
    digests = Counter((k[0], k[4]) for k in brute_repeats([r[:2] for r in left]).elements())
    cut = results[2].collect()
    assert Counter(r["doc_id"] for r in cut) == Counter(r[0] for r in left) and all(r["n_chars"] == len(r["text"]) for r in cut)
    whole = [(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in cut]
    assert sum(x in digests for x in whole) >= len(whole) - 3  # a character may have been split
    copies = Counter()
    for r in mixing.plan_mix(results[2]).collect():
        copies[r["doc_id"], r["text"]] += r["mix_copies"]
    assert Counter((r["doc_id"], r["text"]) for r in results[3].collect()) == +copies
    encode = packing.Encoder(ranks_path())
    assert sum(r["length"] for r in results[4].collect()) == sum(len(encode(t)) // 4 * n + n for (_, t), n in copies.items())
    assert cascade.passing(nothing(spark)).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_clashing_columns(spark, stage):
    assert stage(spark, nothing(spark), "").collect() == []
    out = stage(spark, documents(spark, n=12), "")
    if stage is not corpus_pipeline.pack:
        assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert out.count() > 0


def test_word_hashes_and_slices_keep_whole_texts():
    from sectional.llm.common import split_words, text_slices, word_hashes

    text = ["a b", None, "", "c " * 5000, "b\x0ba\x1cd"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(text)})
    parts = [t for _, t in text_slices(iter([batch]), max_bytes=8)]
    assert [x for p in parts for x in p.to_pylist()] == [t or "" for t in text] and len(parts) > 2
    flat, off = split_words(pa.array([t or "" for t in text], pa.large_string()))
    assert [flat.to_pylist()[a:b] for a, b in zip(off[:-1], off[1:])] == [words(t) for t in text]
    h = word_hashes(flat)
    assert len(set(h.tolist())) == len(set(flat.to_pylist()))
