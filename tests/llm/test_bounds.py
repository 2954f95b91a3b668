"""What must stay bounded or hold beyond single examples: long inputs, large groups, model
arithmetic against plain restatements, and empty tables."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievefold.llm import _spark, _tokens, chat, jaccard, langid, packing, quality, token_counts, url_filter


# --- 2 language ID -------------------------------------------------------------------


def test_pooled_probabilities_are_the_trained_networks():
    """Prediction's own arithmetic against the network that is trained."""
    r = random.Random(1)
    texts = ["", "é", "a1 b2", "".join(r.choice("abc XYZ.é\n") for _ in range(301)), "Zz" * 24]
    model = langid.Model(["x", "y", "z"], langid.init(3, seed=5))
    got, count = langid.pooled(model, pa.array(texts), batch=3)
    for text, mean, n in zip(texts, got, count, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        total = np.zeros(3)
        for a in range(0, len(raw), langid.WINDOW):
            part = np.full(langid.WINDOW, 32, np.uint8)
            part[: len(raw[a : a + langid.WINDOW])] = raw[a : a + langid.WINDOW]
            x = langid._CLASS[part][:, None]
            logits = sum(langid.forward(model.params, x, d) @ model.params[f"O{d}"] for d in "fb") + model.params["b"]
            p = np.exp(logits)[:, 0]
            p /= p.sum(1, keepdims=True)
            total += p[langid._LETTER[part]].sum(0)
        letters = int(langid._LETTER[raw].sum())
        assert n == letters
        np.testing.assert_allclose(mean, total / max(1, letters), atol=1e-4)


def test_models_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, score double")
    assert langid.identify(docs, F.lit(True)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, labels, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "some text", None, 0.5)], docs.schema)
    assert [(x.lang_pred, x.score) for x in langid.identify(one, F.lit(True)).collect()] == [("und", 0.0)]
    assert [x.predicted for x in quality.classify(one, labels, F.lit(True)).collect()] == [1]


# --- 5 quality -----------------------------------------------------------------------


def plain_features(t):
    raw = (t or "").encode()
    n = max(1, len(t or ""))
    count = lambda f: sum(map(f, t or ""))
    upper, lower = count(lambda c: "A" <= c <= "Z"), count(lambda c: "a" <= c <= "z")
    w = [x for x in re.split(r"[ \t-\r]+", t or "") if x]
    k = max(1, len(w))
    sym, pipe, bang = set("#*$%&<>{}[]\\^~=+_@"), set("|"), set("!?")
    some = lambda f: sum(map(f, w)) / k
    lines, seen, again = (t or "").split("\n"), set(), 0
    for x in lines:
        size = len(x.encode())
        if size > 1:
            again += size if x in seen else 0
            seen.add(x)
    up = lambda x: sum("A" <= c <= "Z" for c in x)
    low = lambda x: sum("a" <= c <= "z" for c in x)
    return [
        upper / max(1, upper + lower), count(lambda c: "0" <= c <= "9") / n, count(lambda c: c in sym) / n, count(lambda c: c in pipe) / n, count(lambda c: c in bang) / n, count(lambda c: c in ".,") / n,
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / k, len(set(w)) / k, again / max(1, len(raw)), min(n / k, 40) / 10, np.log1p(len(w)) / 8, float(len(w) < 4),
        some(lambda x: any(c in sym | pipe | bang for c in x)), some(lambda x: up(x) > 1 and not low(x)), some(lambda x: len(x.encode()) == 1),
    ]


def test_quality_features():
    r = random.Random(2)
    texts = ["", None, "one", "AB AB ab | !", "é é\nsame line\nsame line\nx\nx"] + ["".join(r.choice("abAB12 #|!.,\né") for _ in range(r.randint(0, 80))) for _ in range(200)]
    np.testing.assert_allclose(quality.features(pa.array(texts)), [plain_features(t) for t in texts], atol=1e-12)


# --- 6 token counts ------------------------------------------------------------------


def test_ten_thousand_edits_stay_local():
    enc = _tokens.word_ids(_tokens.default_path())
    count = lambda t: sum(len(enc.encode_word(w)) for w in t.encode().split())
    r = random.Random(3)
    text = " ".join(r.choice(["river", "a", "it's", "stone."]) for _ in range(300))
    tree = next(token_counts.trees(pa.array([text]), enc))
    most, now = 0, text
    for k in range(10_000):
        at, cut, ins = (150, 0, "typed words ") if k % 2 else (r.randrange(len(now)), r.choice([0, 1, 9]), r.choice(["x", " ", "\n", ""]))
        before = tree.reencoded
        total = tree.edit(at, cut, ins)
        most = max(most, tree.reencoded - before)
        now = now[:at] + ins + now[at + cut :]
        if k % 500 == 0:
            assert tree.current() == now and total == count(now)
    assert tree.current() == now and tree.total == count(now)
    assert most <= 8 and all(len(tree._parts(i)[0]) <= 2 * token_counts.BLOCK for i in range(len(tree.leaves)))
    assert tree.edit(0, 10**9, "") == 0 and tree.current() == "" and tree.edit(5, 5, "new text") == count("new text")


# --- 7 chat --------------------------------------------------------------------------

CONTROLS = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|end|>", "<|user|>", "<|endoftext|>", "<start_of_turn>", "### Instruction:", "<|eot_id|>", "<|start_header_id|>")


@pytest.mark.parametrize("control", CONTROLS)
def test_no_control_string_in_a_formatted_text(control):
    for text in (control, f"a{control}\n\\{control}", control + control, "\\l/s>" + control):
        turn = chat.format_turn(control, text)
        inside = turn[2 : -len("<|end|>\n")].replace("|>\n", "", 1)
        assert control not in inside
        assert chat.read_turns(turn) == [(control, text)]


def test_windows_repeat_the_longest_run():
    w = chat.Windows(budget=100, history=30)
    said = [("system", 10), ("user", 40), ("assistant", 20), ("user", 10), ("assistant", 45), ("user", 90), ("user", 120), ("assistant", 10)]
    done = [w.add(role, str(i), n) for i, (role, n) in enumerate(said)]
    out = [x for x in [*done, w.close()] if x]
    turns = [[int(t) for _, t in chat.read_turns(x[2])] for x in out]
    assert turns == [[0, 1, 2, 3], [0, 2, 3, 4], [0, 5], [0, 6], [0, 7]]
    assert [x[1] for x in out] == [0, 3, 1, 1, 1] and [x[4] for x in out] == [80, 85, 100, 130, 20]


# --- 8 url filter --------------------------------------------------------------------


def test_long_url_takes_linear_time(spark):
    """Four times the length may take eight times as long; quadratic work would take sixteen."""
    urls = ["https://ok.example.net/" + "ab/😀c" * n for n in (10, 4000, 16_000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    took, got = [], []
    for k in range(3):
        start = time.time()
        got.append(url_filter.url_filter(df.where(F.col("page_id") == k)).first())
        took.append(time.time() - start)
    assert took[2] < 8 * took[1] + 2
    weights, bias = url_filter.train(tuple(url_filter.labelled_urls()))
    assert got[1].url_score == bias + sum(weights[g] for g in url_filter.buckets_of(urls[1]))


def test_domains_never_trained_on(spark):
    rows = url_filter.labelled_urls()
    fold_of = lambda url: zlib.crc32(url_filter.registrable_domain(url).encode()) % 5
    assert url_filter.registrable_domain("https://a.b.co.uk/x") == "b.co.uk" and url_filter.registrable_domain("https://www.b.com/") == "b.com"
    right = 0
    for fold in range(5):
        w, b = url_filter.train(tuple(r for r in rows if fold_of(r[0]) != fold))
        right += sum((b + sum(w[g] for g in url_filter.buckets_of(url)) > 0) == bool(label) for url, label in rows if fold_of(url) == fold)
    most = max(sum(label == k for _, label in rows) for k in (0, 1))
    assert right / len(rows) >= 0.8 and most / len(rows) < 0.6  # what always guessing one class gets
    assert url_filter.fit_labelled(url_filter.labelled_table(spark)) == url_filter.train(tuple(rows))
    known = " ".join(url for url, _ in rows)
    assert not any(x in known for x in ("casino-win", "free-bets", "cheap-pills", "spam-farm", "adult-x", "ads-track"))


def test_url_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", 5), (1, "http://a.b/c", 5)], "page_id long, url string, url_score int")
    out = url_filter.url_filter(df).collect()
    assert len(out) == 2 and out[0] == out[1] and out[0].url_score != 5


# --- 9 jaccard -----------------------------------------------------------------------


def test_near_copies_cost_linear_work(spark, monkeypatch):
    """One cell of near copies, and texts that share a passage without being alike."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(1200):
        t = list(base)
        t[r.randrange(len(t))] = f"x{i}"
        rows.append((i, " ".join(t)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    shipped = []
    verify = jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda blocks, *a, **k: shipped.append(blocks.count()) or verify(blocks, *a, **k))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(df).collect()}
    assert all(got[i] == 0 for i in range(1200)) and all(got[2000 + i] == 2000 + i for i in range(60))
    # all pairs of blocks would ship each of 1200 sets 75 times
    assert sum(shipped) < 20 * len(rows)


# --- 10 packing ----------------------------------------------------------------------


def plain_best_two_fit(lengths, capacity):
    """Lengths of every sequence, by trying all pieces and pairs."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        held, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            held.append(fits[0])
            left.remove(fits[0])
            gap -= fits[0]
        if gap and len(held) > 1:
            small = held[-1]
            pairs = [(left[i] + left[j], -min(left[i], left[j]), i, j) for i in range(len(left)) for j in range(i) if small < left[i] + left[j] <= gap + small]
            if pairs:
                _, _, i, j = max(pairs)
                pair = [left[i], left[j]]
                for x in pair:
                    left.remove(x)
                held = [*held[:-1], *pair]
                left = sorted([*left, small], reverse=True)
        out.append(sorted(held))
    return out


def test_placement_is_best_two_fit():
    r = np.random.default_rng(5)
    for trial in range(200):
        size = r.integers(1, 60 if trial % 2 else 15, int(r.integers(0, 40)))
        seq, _ = packing.best_two_fit(size, 64)
        got = [sorted(size[seq == s].tolist()) for s in range(int(seq.max()) + 1 if len(seq) else 0)]
        assert got == plain_best_two_fit(size.tolist(), 64)


# --- shared folder -------------------------------------------------------------------


def test_discard(spark):
    before = _spark.made()
    a, b = (_spark.materialize(spark.range(3)) for _ in range(2))
    _spark.discard_since(before, b)
    assert b.count() == 3 and _spark.made() - before == {b._sievefold_path}
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(a._sievefold_path)
    _spark.discard(b)
    assert _spark.made() == before
