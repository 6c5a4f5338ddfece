import time
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from saxframe.llm import decontaminate, html, scoring

DATA = "/root/testdata/sf0.001"


def test_scores_against_counts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, ""), (None, "Solo WORD"), (9003, "twin"), (9003, "twin"), (9004, "x" * 200_000)], "doc_id long, text string"))
    scoring_rows = scoring.score(docs).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((repr(d), held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in scoring_rows) == want
    base = {d: sum(np.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)) for d, t in rows}
    for r in scoring_rows:
        assert abs(r["base_score"] - base[r["doc_id"]]) < 1e-6 * max(1, abs(base[r["doc_id"]]))
        assert r["score"] < 0 and r["bits_per_byte"] > 0
    assert scoring.score(docs.limit(0)).count() == 0


def test_rare_tokens_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FREQUENT", 5)
    docs = spark.createDataFrame([(k, f"common common word{k % 4} only{k}") for k in range(20)], "doc_id long, text string")
    few = {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in scoring.score(docs).collect()}
    monkeypatch.setattr(scoring, "FREQUENT", 1000)
    assert few == {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in scoring.score(docs).collect()}


def model(seed=None, frequent=((b"of", 5), (b"the", 9), (b"", 2))):
    code = scoring.Code(list(frequent), 3, np.zeros(scoring.GROUPS << 16, np.int64))
    odds = np.zeros((scoring.PREDICTORS, 1 << 14), np.int8) if seed is None else np.random.default_rng(seed).integers(-60, 60, (scoring.PREDICTORS, 1 << 14)).astype(np.int8)
    return scoring.Model(code, 14, list(odds))


def tokens_of(*items):
    return [[*t.lower().split(), b""] for t in items]


def test_ways_through_the_trees():
    steps, length = scoring.huffman([1, 1, 10**6, 5])
    assert length.tolist() == [3, 3, 1, 2] and abs(sum(0.5 ** length) - 1) < 1e-9 and len(steps) == 9
    ways = [tuple(x) for x in np.split(steps, np.cumsum(length)[:-1])]
    assert len({w[0] >> 1 for w in ways}) == 1 and not any(a != b and b[: len(a)] == a for a in ways for b in ways)
    counts = np.zeros(scoring.GROUPS << 16, np.int64)
    tree = 97 * scoring.GROUPS + (98 & scoring.GROUPS - 1)
    counts[tree * 256 + 99] = 10**9
    code = scoring.Code([(b"of", 5)], 1, counts)
    for t in (tree, 0):
        at = code.bytes_at + code.trees[t] * 256
        assert abs(sum(0.5 ** code.length[at : at + 256]) - 1) < 1e-9
    assert code.length[code.bytes_at + code.trees[tree] * 256 + 99] == 1


def test_probabilities_of_what_may_follow_add_up_to_one_at_most():
    m = model(3)
    for before in ([], [b"the", b"zz"]):
        cost = lambda t: m.costs(scoring.Texts([[*before, t]], m.code), 0, 1)[-1]  # noqa: E731, B023
        whole = sum(np.exp(-cost(t)) for t in m.code.number)
        spelled = sum(np.exp(-cost(bytes([x]))) for x in range(256) if bytes([x]) not in m.code.number)
        assert 0 < spelled and whole + spelled < 1 + 1e-4


def test_score_is_of_the_text_alone():
    m = model(4)
    items = [b"some words here", b"", b"other words " * 900, b"x", b"a long text of words " * 20_000]
    alone = np.concatenate([m.token_costs(scoring.Texts(tokens_of(t), m.code)) for t in items])
    assert np.allclose(m.token_costs(scoring.Texts(tokens_of(*items), m.code)), alone, rtol=1e-3, atol=1e-3)


def test_stretches_of_a_text_see_what_stands_before_them():
    rng = np.random.default_rng(5)
    text = b" ".join(bytes(rng.integers(97, 100, int(n))) for n in rng.integers(1, 12, 600)) + b" the " + b"q" * 300 + b" of"
    m = model(5)
    some = scoring.Texts(tokens_of(text), m.code)
    n = len(some.id)
    whole = some.units(0, n)
    for cut in (1, 57, 300, n - 1):
        two = [some.units(0, cut), some.units(cut, n)]
        key = lambda u, shift=0: sorted(zip((u.token + shift).tolist(), u.way.tolist(), *[h.tolist() for h in u.hashes], u.gate.tolist(), strict=True))
        assert key(whole) == sorted(key(two[0]) + key(two[1], cut))


def test_weights_learn_within_a_document():
    m = model(6)
    short, long = (m.token_costs(scoring.Texts(tokens_of(b"aaaa bb " * n), m.code)).sum() / n for n in (100, 20_000))
    assert long < 0.9 * short


def test_shares_are_those_of_an_online_mixture():
    rng = np.random.default_rng(2)
    value, cost = np.where(rng.random(300) < 0.3, -1.0, rng.random(300) * 3), rng.random(300) * 20
    size = np.array([1, 250, 49])
    nats, odds = scoring.mixture(value, cost, size, 5.0)
    at = 0
    for n in size:
        held, done, share = scoring.SHARE * scoring.TRUST, 0, 0.0
        for k in range(n):
            if k >= done:
                share = held / (scoring.TRUST + done)
                done += max(scoring.TOKENS, done // scoring.LATER)
            told = share * 10 ** (value[at + k] - 5.0) if value[at + k] >= 0 else 0.0
            p = told + (1 - share) * np.exp(-cost[at + k])
            assert abs(nats[at + k] - np.log(p)) < 1e-9 and abs(odds[at + k] - np.log(share / (1 - share))) < 1e-9
            held += told / p
        at += n


def test_model_beats_counts_on_held_out_texts(spark):
    rows = scoring.op1_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg({"score": "sum", "base_score": "sum"}).first().asDict()
    assert rows["sum(score)"] > rows["sum(base_score)"]


def alignment(item, text):
    last = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        row = [k]
        for j, d in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)


def whole_distance(a, b):
    last = list(range(len(b) + 1))
    for k, c in enumerate(a, 1):
        row = [k]
        for j, d in enumerate(b, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
        last = row
    return last[-1]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=20), st.text(alphabet="abc", max_size=40))
def test_alignment(item, text):
    a, b = (np.frombuffer(t.encode("utf-16-le"), np.uint16) for t in (item, text))
    edits, start, end = decontaminate.align(a, b, len(item))
    assert edits == alignment(item, text) and 0 <= start <= end <= len(text)
    assert whole_distance(item, text[start:end]) == edits
    assert all(whole_distance(item, text[k:end]) > edits for k in range(start + 1, end + 1))
    for most in range(edits):
        assert decontaminate.align(a, b, most)[0] > most


def test_leaks_against_every_alignment(spark):
    rng = np.random.default_rng(7)
    say = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    items = [(k, say(n)) for k, n in enumerate((40, 80, 160, 33, 200))] + [(90, None), (91, ""), (92, "tiny"), (0, None)]
    docs = []
    for k in range(40):
        body = decontaminate.normal(items[k % 5][1])
        cut = list(body)
        for at in rng.integers(0, len(cut), int(rng.integers(0, 0.2 * len(body)))):
            cut[at] = str(rng.choice(["", "x", cut[at] + "y"]))
        docs.append((k, say(int(rng.integers(0, 300))) + " " + "".join(cut).upper() + " " + say(50)))
    docs += [(100, None), (101, ""), (102, "a tiny one"), (103, "tinyone"), (None, items[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(frame, table).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            x, text = decontaminate.normal(x or ""), decontaminate.normal(t or "")
            if len(x) >= decontaminate.Q:
                edits = alignment(x, text)
                if edits <= decontaminate.budget(len(x), decontaminate.EDIT_RATE):
                    want[d, i] = edits
            elif x and f" {x} " in f" {text} ":
                want[d, i] = 0
    assert got == want
    kept = {r["doc_id"] for r in decontaminate.without_leaks(frame, table).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.leaks(frame, table.limit(0)).count() == 0 and decontaminate.leaks(frame.limit(0), table).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = spark.createDataFrame([(k, f"item number {k} is right here for all to see") for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"so item number {k} is right here for all to see now") for k in range(9)], "doc_id long, text string")
    exact = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect() if r["edits"] == 0}
    assert exact == {(k, k) for k in range(6)}


def test_page_blocks():
    page = "<!DOCTYPE html><html><head><title>T &amp; U</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu<li>Two</ul></nav><article><h1> A\n b </h1><p>One <b>two<br>three<p>Four&nbsp;&#53;<!-- no --></article></body>"
    got = [b.text for b in html.blocks(page)]
    assert got == ["T & U", "Menu", "Two", "A b", "One two three", "Four 5"]
    assert html.blocks("") == [] and [b.text for b in html.blocks("<p")] == ["<p"]
    assert [b.text for b in html.blocks("<p>E = <math><mi>mc</mi></math> holds</p>")] == ["E = mc holds"]


def test_broken_markup_takes_linear_time():
    def seconds(text, n):
        began = time.process_time()
        html.blocks(text * n)
        return time.process_time() - began

    for text in ("<!-- ", "<a href=\"x", "<a <b ' ", "<![CDATA[ x", "<a '\" <b \"' "):
        seconds(text, 500)
        assert seconds(text, 16_000) < 30 * max(0.005, seconds(text, 2000)), text


def test_lstm_learns_and_is_batch_free():
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(500)]
    pages = [html.made_page(rng, words) for _ in range(140)]
    labeller = html.Labeller().fit([(html.features(b), y) for b, y in pages[:100]], epochs=5)
    got = labeller.label([b for b, _ in pages[100:]])
    assert np.mean(np.concatenate([g == (y == 1) for g, (_, y) in zip(got, pages[100:], strict=True)])) > 0.95
    for g, (b, _) in zip(got[:5], pages[100:], strict=False):
        assert (labeller.label([b])[0] == g).all()


def test_lstm_gradients():
    rng = np.random.default_rng(9)
    net = html.Labeller(inputs=5, hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, size = html.padded([rng.standard_normal((4, 5)).astype(np.float32), rng.standard_normal((2, 5)).astype(np.float32)])
    x = x.astype(np.float64)
    weight = np.zeros((4, 2))
    weight[:, 0], weight[:2, 1] = rng.standard_normal(4), rng.standard_normal(2)
    loss = lambda: float((net._logits(x, size) * weight).sum())
    keep: dict = {}
    net._logits(x, size, keep)
    grads: dict = {}
    dboth = weight[:, :, None] * net.w["o"]
    net._back("f", *keep["f"], np.ascontiguousarray(dboth[:, :, :3]), grads)
    net._back("b", *keep["b"], net._flip(dboth[:, :, 3:], size), grads)
    for name in ("xf", "hf", "cf", "xb", "hb", "cb"):
        flat = net.w[name].reshape(-1)
        for k in range(0, len(flat), 7):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[k]) < 1e-2


def test_extraction(spark):
    out = {r["page_id"]: r for r in html.op4_html_extraction(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        got = out[r["page_id"]]
        inside = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        want = "\n".join(b.text for b in html.blocks(inside))
        assert got["text"] == want and got["n_chars"] == len(want)


def test_extraction_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (None, None, "", "t"), (2, "u", "plain text", "t"), (2, "u", "<article><p>" + "word " * 50_000 + "</p></article>", "x")], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == 4 and [r["text"] for r in got if r["page_id"] in (1, None)] == ["", ""]
    assert html.extract(pages.limit(0)).count() == 0


def test_slots_of_one_piece_of_a_tree_are_neighbours():
    """Three decisions of a way under one context lie in one line of eight slots; decisions of different nodes in different slots."""
    words = [(b"w%d" % k, 1000 - k) for k in range(300)]
    code = scoring.Code(words, 50, np.zeros(scoring.GROUPS << 16, np.int64))
    some = scoring.Texts([[w for w, _ in words] + [b"unknown", b""]], code)
    units = some.units(0, len(some.id))
    slots, bit, starts = scoring.expanded(units, code, 22)
    for slot in slots:
        for f, t in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            assert len(set((slot[f:t] >> 3).tolist())) <= -(-(t - f) // 3) and len(set(slot[f:t].tolist())) == t - f
    way = lambda k: [(int(x) & ~1, int(b)) for x, b in zip(code.node[code.first[k] : code.first[k] + code.length[k]], bit[starts[k] : starts[k + 1]], strict=True)]
    assert len({tuple(way(k)) for k in range(300)}) == 300 and len({x for k in range(300) for x, _ in way(k)}) == 300
