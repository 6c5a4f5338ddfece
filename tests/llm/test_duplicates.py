import hashlib
import os
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from saxframe.llm import lines, passages, simhash, suffixes, vectors
from saxframe.llm.graph import Forest, components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string, ranges int"


def classes(n, pairs):
    f = Forest(n)
    f.join(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    return f.roots(np.arange(n))


def test_components(spark):
    pairs = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(200, 230)] + [(50, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert all(got[k] == 0 for k in range(21)) and all(got[k] == 100 for k in range(200, 230))
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def reference_fingerprint(text, words=4):
    w = text.encode().lower().split()
    runs = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id")
    fp = [reference_fingerprint(t) for t in docs.text]
    ids = docs.doc_id.tolist()
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    root = classes(len(fp), pairs)
    want = {(ids[k], f"{fp[k]:016x}", ids[root[k]]) for k in range(len(ids))}
    assert {tuple(r) for r in simhash.op6_simhash_near_dedup(spark, DATA).collect()} == want


def test_tiles_find_what_all_pairs_find(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60)
    fps = np.unique(np.concatenate([base, *[base ^ (1 << int(b)) for b in rng.integers(0, 62, 4)], base ^ 0b111110000]))
    monkeypatch.setattr(simhash, "TILE", 16)
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), 4).collect()
    at = {int(x): k for k, x in enumerate(fps)}
    got = classes(len(fps), [(at[r["a"]], at[r["b"]]) for r in found])
    u = fps.astype(np.uint64)
    want = classes(len(fps), [(i, j) for i in range(len(u)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= 4])
    assert (got == want).all()


def test_simhash_edges(spark):
    rows = [(1, None, "x", 1), (2, "", None, 2), (None, " \n", "y", 3), (5, "One two", "z", 4), (4, "one  TWO", "z", 4), (4, "one  TWO", "z", 4), (7, "long " * 60_000, "w", 5)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 7
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] in (4, 5)] == [4, 4, 4]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "ranges"] and sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 4, 7]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_recall_near_the_bound(spark):
    """Pairs of shingle similarity 0.8 to 0.9 are caught, pairs below 0.7 are not."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(5000)]
    rows, near, far = [], [], []
    for k in range(160):
        text = list(rng.choice(words, 300))
        edits = 5 if k < 80 else 16
        other = list(text)
        for at in rng.choice(np.arange(5, 295, 6), edits, replace=False):
            other[at] = "changed"
        a, b = ({" ".join(x[i : i + 5]) for i in range(len(x) - 4)} for x in (text, other))
        j = len(a & b) / len(a | b)
        (near if j >= 0.8 else far if j < 0.7 else []).append(k)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) == 80 and sum(2 * k + 1 not in kept for k in near) >= 0.9 * len(near)
    assert len(far) == 80 and sum(2 * k + 1 in kept for k in far) >= 0.95 * len(far) and all(2 * k in kept for k in range(160))


def test_keep_one_of_equal_rows_is_settled(spark):
    rows = [(1, "same text", "x", n) for n in range(6)]
    kept = [simhash.keep_one(spark.createDataFrame(r, SCHEMA)).collect() for r in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_keep_one_catches_near_copies_only(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(40)]
    near = [" ".join(x if k % 100 != 7 else "other" for k, x in enumerate(t.split())) for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == list(range(40))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", max_size=60) | st.text(alphabet="abcdz", max_size=90))
def test_suffix_array(text):
    b = text.encode()
    t = np.frombuffer(b, np.uint8)
    if not len(t):
        return
    order = suffixes.suffix_array(t)
    want = sorted(range(len(b)), key=lambda i: b[i:])
    assert order.tolist() == want
    prefix = suffixes.permuted_prefixes(t, order)
    for x, y in zip(want[1:], want[:-1], strict=True):
        n = 0
        while x + n < len(b) and y + n < len(b) and b[x + n] == b[y + n]:
            n += 1
        assert prefix[x] == n


def brute_removed(items, length):
    seen = Counter(b[i : i + length] for b in items for i in range(len(b) - length + 1))
    out = []
    for b in items:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_suffix_dedup_against_all_windows(spark, length):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_001, "ab" * 500), (10_002, None), (10_003, ""), (None, "x" * 900), (10_004, "same " * 300), (10_004, "same " * 300)], "doc_id long, text string"))
    items = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want = []
    for (d, b), gone in zip(items, brute_removed([b for _, b in items], length), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffixes.remove_repeats(docs, length).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup_deals_a_frequent_anchor_anew(spark, monkeypatch):
    """However many kinds of surroundings an anchor has, few of them come to one shard, and all repeats are found."""
    rng, length, most = np.random.default_rng(5), 100, 4
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    line = " ".join(word() for _ in range(13))  # 90 bytes: windows hold it whole, none is made of it
    items = [" ".join([word(), *["of"] * int(rng.integers(20, 60)), *[word()] * int(rng.integers(1, 30))]) for _ in range(60)]
    items += [f"{word()} {word()} {line} {w} {w} {word()}" for w in [word() for _ in range(20)] for _ in range(2)] + [f"{line} {line}", *items[:3]]
    docs = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")
    seen = []

    def spied(*given, f=suffixes.dealt):
        kinds, shown = f(*given)
        seen.append([df.groupBy("h").count().agg({"count": "max"}).first()[0] or 0 for df in (shown.where("NOT heavy"), kinds)])
        return kinds, shown

    monkeypatch.setattr(suffixes, "dealt", spied)
    got = {r["doc_id"]: r["kept"] for r in suffixes.remove_repeats(docs, length, with_text=True, kinds=most).collect()}
    assert max(shown for shown, _ in seen) <= most < seen[0][1] and len(seen) == 3
    raw = [t.encode() for t in items]
    assert got == {d: bytes(x for x, g in zip(b, gone, strict=True) if not g) for d, (b, gone) in enumerate(zip(raw, brute_removed(raw, length), strict=True))}


def test_lines_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (9001, ""), (9002, "one\ntwo\nthree"), (9003, "one\ntwo\nthree"), (9004, "single"), (9005, "single")], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.union(extra).collect()]
    count, first = Counter(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for s, e, n in lines.chunks((t or "").encode()):
            if n >= 2:
                body = (t or "").encode()[s:e]
                count[body] += 1
                first.setdefault(body, (d, s))
    want = {}
    for d, t in rows:
        b = (t or "").encode()
        kept = [b[s:e] for s, e, n in lines.chunks(b) if n < 2 or count[b[s:e]] == 1 or first[b[s:e]] == (d, s)]
        want[d] = None if t is None else b"\n".join(kept).decode()
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs.union(extra)).collect()}
    assert got == want and want[9003] == "" and want[9005] == "single"
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_line_boundaries_resist_shifts():
    body = [f"line {k}" for k in range(200)]
    cut = lambda t: {t[s:e] for s, e, _ in lines.chunks(t)}
    a, b = cut("\n".join(body).encode()), cut("\n".join(["new", *body]).encode())
    assert len(a & b) > 0.8 * len(a)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base[:30] + 0.2 * rng.standard_normal((30, 32)), base[:5], base[:5] * 3])
    rows = [(k, [float(v) for v in r], "e") for k, r in enumerate(x)]
    odd = [(900, None, "n"), (901, [0.0] * 32, "z"), (902, [float("nan")] * 32, "n"), (903, [1.0, None], "x"), (904, [], "x"), (None, [float(v) for v in x[0]], "x"), (905, [float("inf")] + [0.0] * 31, "i"), (906, [1.0], "s"), (907, [2.0], "s")]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, node string")).collect()}
    assert len(got) == len(rows) + len(odd)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    near_null = (u @ u[0] >= 0.9).astype(int)
    root = classes(len(x), list(zip(*np.nonzero(near), strict=True)))
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (near[k].sum() + near_null[k], root[k], root[k] == k)
    for k in (900, 901, 902, 903, 904, 905):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[907]["component_id"] == 906 and got[None]["component_id"] == 0 and not got[None]["kept"]
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vector_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(4)
    d = 64
    turn = vectors.rotation(d)
    assert np.allclose(turn @ turn.T, np.eye(d))
    o, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.standard_normal((3000, d)) for _ in range(2)))
    q[:1500] = o[:1500] + 0.05 * rng.standard_normal((1500, d))
    q /= np.linalg.norm(q, axis=1)[:, None]
    codes, factor = vectors.encode(o, turn)
    signs = (np.unpackbits(codes, axis=1, count=d) * 2.0 - 1) / np.sqrt(d)
    estimate = (signs * (q @ turn)).sum(axis=1) / factor
    exact = (o * q).sum(axis=1)
    assert abs((estimate - exact)[1500:].mean()) < 0.01
    least = vectors.code_thresholds(factor, d, 0.9, 6.0)
    assert ((estimate * factor >= least) | (exact < 0.9)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=30), min_size=1, max_size=4), st.integers(1, 9))
def test_compact_windows_cover_each_run_once(tokens, least):
    x = np.array([t for part in tokens for t in part], np.uint64)
    sizes = np.array([len(p) for p in tokens])
    starts = np.cumsum(sizes) - sizes
    for (key, left, mid, right), m in zip(passages.compact_windows(x, starts, least), passages.MULTIPLIERS, strict=False):
        base = x ^ (x >> np.uint64(32))
        h = base * np.uint64(m)
        h ^= h >> np.uint64(29)
        runs = [(i, j) for k, a, c, b in zip(key, left, mid, right, strict=True) for i in range(a, c + 1) for j in range(c, b + 1) if j - i + 1 >= least]
        assert len(runs) == len(set(runs))
        seen = {(i, j): k for k, a, c, b in zip(key, left, mid, right, strict=True) for i in range(a, c + 1) for j in range(c, b + 1)}
        for s, n in zip(starts, sizes, strict=True):
            for i in range(s, s + n):
                for j in range(i + least - 1, s + n):
                    assert seen[i, j] == h[i : j + 1].min()
        assert all(any(s <= i and j < s + n for s, n in zip(starts, sizes, strict=True)) for i, j in runs)


def test_passages(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    say = lambda n: list(rng.choice(words, n))
    shared = say(80)
    edited = shared[:40] + ["changed"] + shared[41:]
    rows = [(1, say(100) + shared + say(60)), (2, say(30) + shared), (3, edited + say(200)), (4, say(300)), (5, shared[:30] + say(100))]
    docs = [(k, " ".join(w)) for k, w in rows] + [(6, None), (7, ""), (8, " ".join(rows[3][1]))]
    got = passages.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 8}
    one = next(r for r in got if r["doc_id"] == 1 and r["other_id"] == 2)
    assert (one["start_word"], one["end_word"], one["other_start"], one["other_end"], one["similarity"]) == (100, 179, 30, 109, 1.0)
    assert {r["class_id"] for r in got if r["doc_id"] <= 3} == {1} and {r["class_id"] for r in got if r["doc_id"] in (4, 8)} == {4}
    assert passages.near_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_regions_of_a_passage_at_several_places(seed, here, there):
    rng = np.random.default_rng(seed)
    rectangles = []
    for key in range(6):
        for i in range(here):
            for j in range(there):
                l, r = (int(k) for k in rng.integers(0, 5, 2))
                rectangles.append((1000 * i + l, 1000 * i + 60 - r, 1000 * j + l, 1000 * j + 60 - r, key))
    assert len(passages.regions(rectangles, 46, 3)) == here * there


def test_passage_twice_in_a_text(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(5000)]
    say = lambda n: list(rng.choice(words, n))
    shared = say(80)
    for places in ((1, 2), (2, 1), (2, 2)):
        docs = [(k, " ".join(sum((say(90) + shared for _ in range(n)), []) + say(70))) for k, n in enumerate(places)]
        got = passages.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        for k, n in enumerate(places):
            assert {(r["start_word"], r["end_word"]) for r in got if r["doc_id"] == k} == {(90 + 170 * m, 169 + 170 * m) for m in range(n)}


def test_passages_among_many_of_common_wording(spark):
    """Sixty texts hold one run of 44 words, too short for a passage; pairs of them share 16 words more."""
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(20000)]
    say = lambda n: list(rng.choice(words, n))
    common, docs = say(44), []
    for k in range(30):
        shared = say(8) + common + say(8)
        docs += [(2 * k, " ".join(say(60) + shared + say(60))), (2 * k + 1, " ".join(say(60) + shared + say(60)))]
    got = passages.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(k, k ^ 1) for k in range(60)}
    assert all(r["class_id"] == r["doc_id"] & ~1 and (r["start_word"], r["end_word"]) == (60, 119) for r in got)


def test_passages_do_not_depend_on_the_tiles(spark, monkeypatch):
    """Tiles in many rounds find what one tile finds, and nothing that the rounds have written is left but what the result reads."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    line = [word() for _ in range(24)]
    groups = [[word() for _ in range(60)] for _ in range(3)]
    near = lambda g: [w if rng.random() > 0.01 else word() for w in g]
    items = [" ".join([*[word() for _ in range(30)], *line, *near(groups[k % 3]), *[word() for _ in range(30)]]) for k in range(45)]
    docs = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")
    staged, found = [], []
    monkeypatch.setattr(passages, "stage", lambda df, name, f=passages.stage: staged.append(out := f(df, name)) or out)
    for tile in (1 << 23, 1 << 9):
        monkeypatch.setattr(passages, "TILE", tile)
        staged.clear()
        found.append(sorted(map(tuple, passages.near_passages(docs).collect())))
        rounds = sum("passage-links" in df._staged for df in staged)
    assert found[0] == found[1] and len({r[0] for r in found[0]}) > 40 and rounds > 10
    kept = [df._staged.rsplit("/", 1)[1][:-33] for df in staged if os.path.isdir(df._staged.removeprefix("file://"))]
    assert not {"passage-meetings", "passage-labels", "passage-left", "passage-said"} & set(kept)


@pytest.mark.parametrize("seed", range(3))
def test_matched_from_both_sides(seed):
    """What matching() finds from either side is found, whichever text comes first."""
    rng = np.random.default_rng(seed)
    for _ in range(200):
        x, y = (rng.integers(0, 80, 150).astype(np.uint64) for _ in range(2))
        y[20:90] = x[30:100]
        y[rng.integers(0, 150, 12)] = 999
        both, other = (passages.matched(*p, 46, 0.8) for p in ((x, y), (y, x)))
        assert bool(both) == bool(other) == bool(passages.matching(x, y, 46, 0.8) or passages.matching(y, x, 46, 0.8))


@pytest.mark.parametrize("seed", range(4))
def test_regions_of_many_pairs_at_once(seed, monkeypatch):
    """joined() finds for every pair of texts what regions() finds for it alone, also where few overlaps are looked at together."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(passages, "SOME", (4, 512)[seed % 2])
    monkeypatch.setattr(passages, "OVERLAPS", 64)
    rows, want = [], set()
    for pair in range(0, 120, 2):
        low, size = rng.integers(0, 300, (2, 1 + pair // 4)), rng.integers(40, 160, (2, 1 + pair // 4))
        some = list(zip(*(v.tolist() for v in (low[0], low[0] + size[0], low[1], low[1] + size[1], rng.integers(0, 8, len(low[0])))), strict=True))
        rows += [(pair, *r) for r in some]
        want |= {(pair, *h) for h in passages.regions(some, 46, 3)}
    got = passages.joined(*(np.array(c) for c in zip(*rows, strict=True)), 46, 3)
    assert len(want) > 20 and set(zip(*(c.tolist() for c in got), strict=True)) == want
    assert [len(c) for c in passages.joined(*[np.empty(0, np.int64)] * 6, 46, 3)] == [0] * 5


@pytest.mark.parametrize("seed", range(3))
def test_regions_without_a_passage_are_left(seed):
    """A run that is too short for a passage is told without matching(), and no region with a passage is left."""
    rng = np.random.default_rng(seed)
    ones, others, want = [], [], []
    for k in range(200):
        x, y = (rng.integers(0, 90 if k % 2 else 1 << 47, 150).astype(np.uint64) for _ in range(2))
        y[20 : 20 + 10 * (k % 10)] = x[30 : 30 + 10 * (k % 10)]
        ones.append(passages.packed(x))
        others.append(passages.packed(y))
        want.append(bool(passages.matched(x, y, 46, 0.8)))
    got = passages.hopeful(ones, others, 46, 0.8)
    assert got[np.array(want)].all() and any(want)
    assert not got[[k for k in range(0, 200, 2) if k % 10 < 4]].any()


def test_shingles_tell_what_digests_tell():
    texts = [b"", b" ", b"One", b"a b c d e", b"A\tb\nC d  e F", b"a b c d e f g a b c d e f", " ".join("w%d" % (k % 37) for k in range(400)).encode()]
    ours, digests = (np.concatenate([f(t) for t in texts]) for f in (passages.shingles, lambda t: simhash.shingle_hashes(t, passages.WORDS)))
    assert len(ours) == len(digests) and len(set(ours.tolist())) == len(set(digests.tolist())) == len(set(zip(ours.tolist(), digests.tolist(), strict=True)))


def test_each_pair_of_tiles_has_a_partition(spark):
    keys = passages.keys_apart(spark, 13)
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(13, "key")
    assert len(keys) == len({r[0] for r in df.selectExpr("spark_partition_id()").collect()}) == 13
