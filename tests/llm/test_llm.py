"""Each operator against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and further columns of clashing names."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievefold.llm import _tokens, chat, components, jaccard, langid, mixing, packing, quality, repetition, token_counts, topk, url_filter
from sievefold.llm._text import buffers, span_hashes, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, sig long, b int, size string"


def docs(spark, texts, lang="en", source="s"):
    """Rows of (id, text); the further columns have names that operators use inside."""
    rows = [(i, t, lang if isinstance(lang, str) else lang[k], source if source is None or isinstance(source, str) else source[k], len(t or ""), 0.5, "x", 7, 1, "z") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


VOCAB = "the of and to in is was for with that blue red house river stone green walk talk light sound paper".split()


def prose(r, n, vocab=VOCAB):
    return " ".join(r.choice(vocab) for _ in range(n))


def ws_words(t):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w]


# --- 1 repetition --------------------------------------------------------------------


def brute_longest(d):
    out = []
    for i in range(len(d)):
        best = 0
        for j in range(len(d)):
            k = 0
            while i != j and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_longest_repeats_brute_force():
    r = random.Random(3)
    for trial in range(150):
        texts = [[r.choice("abc" if trial % 2 else "a") for _ in range(r.randint(0, 25))] for _ in range(4)]
        buf, offs = buffers(pa.array([" ".join(d) for d in texts]))
        s, e, w = words(buf, offs)
        got = repetition.longest_repeats(span_hashes(buf, s, e), w)
        assert got.tolist() == [x for d in texts for x in brute_longest(d)]


def test_repetition_rules(spark):
    r = random.Random(1)
    line = prose(r, 12)
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, prose(r, 200, [f"w{i}" for i in range(5000)])), (5, "\n".join([line] * 9)), (6, "a # b\n|x|\na # b"), (6, "é ü"), (7, " ".join(["x"] * 3000))]
    got = {(x.doc_id, x.n_words): x for x in repetition.repetition_rules(docs(spark, texts), with_spans=True).collect()}
    assert len(got) == 8
    for i, t in texts:
        w = ws_words(t)
        x = got[i, len(w)]
        assert x.word_chars == sum(map(len, w)) and x.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        lines = [y for y in (t or "").split("\n") if ws_words(y)]
        assert x.n_dup_lines == len(lines) - len(set(lines))
        if len(w) < 300:
            at = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            inside = {k + j for k in range(len(w) - 4) if at[tuple(w[k : k + 5])] > 1 for j in range(5)}
            assert x.n_repeat_words == len(inside)
        for s in x.spans:
            part = ws_words(t[s.start : s.end])
            assert len(w) > 300 or sum(w[k : k + len(part)] == part for k in range(len(w))) > 1
    assert got[4, 200].kept and not got[5, 108].kept and got[7, 3000].longest_repeat == 2999
    assert repetition.repetition_rules(docs(spark, [])).count() == 0


# --- 2 language ----------------------------------------------------------------------


def test_gradients():
    p = langid.init(3, hidden=3)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(97, 103, (6, 4)).astype(np.uint8), r.integers(0, 3, 4)
    _, g = langid.loss_and_grads(p, x, y)
    for name, at in (("Uzf", (0, 1)), ("Urb", (1, 2)), ("Ucf", (2, 0)), ("Ecb", (98, 1)), ("Of", (1, 1)), ("b", (2,))):
        q = {k: v.copy() for k, v in p.items()}
        losses = []
        for d in (1e-3, -1e-3):
            q[name][at] = p[name][at] + d
            losses.append(langid.loss_and_grads(q, x, y)[0])
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.05, abs=2e-4)


def test_language(spark):
    r = random.Random(2)
    kinds = {"en": "the of and that with thing over".split(), "de": "und der die straße über nicht für".split(), "fr": "être le la élève où garçon des".split()}
    rows = [(i, prose(r, 40, kinds[k])) for i, k in enumerate(list(kinds) * 60)]
    lang = list(kinds) * 60
    rows += [(900, None), (901, ""), (902, "123 456!"), (903, "日本"), (0, rows[0][1]), (904, "x")]
    lang += [None, "en", None, "en", "en", None]
    df = docs(spark, rows, lang=lang)
    got = [(x.doc_id, x.lang_pred, x.score) for x in langid.identify(df, F.col("doc_id") % 5 != 1).collect()]
    assert len(got) == len(rows)
    by = dict((a, (b, c)) for a, b, c in got)
    held = [i for i in range(180) if i % 5 == 1]
    assert np.mean([by[i][0] == lang[i] for i in held]) >= 0.95
    assert all(by[i] == ("und", 0.0) for i in (900, 901, 902)) and by[903][0] in kinds
    assert all(0 <= c <= 1 for _, _, c in got)
    nothing = langid.identify(df, F.lit(False)).collect()
    assert {x.lang_pred for x in nothing} == {"und"}


def test_language_sample_holds_every_language(spark):
    r = random.Random(4)
    rows = [(i, prose(r, 20)) for i in range(400)] + [(i, "über " * 20) for i in (1000, 1001, 1002)] + [(5, f"again {k}") for k in range(300)]
    rows += [(None, "sans un"), (None, "sans un"), (None, "sans deux")]
    lang = ["en"] * 400 + ["de"] * 3 + ["en"] * 300 + ["fr"] * 3
    texts, labels = langid.sample(docs(spark, rows, lang=lang), F.lit(True), n=10)
    assert Counter(labels) == {"en": 10, "de": 3, "fr": 2}
    assert sum(t[0].startswith(b"again") for t in texts) <= 1
    assert langid.sample(docs(spark, [(1, None), (2, "")]), F.lit(True)) == ((), ())
    # nearly all rows of one id: the language's other documents stay
    hot = [(1, f"row {k}") for k in range(2000)] + [(i, "other") for i in range(2, 8)]
    assert len(langid.sample(docs(spark, hot), F.lit(True), n=10)[0]) == 7


def test_language_sample_reaches_all_of_a_text(spark):
    text = "".join(f"{k:06d} é" for k in range(12_000))
    (parts,), _ = langid.sample(docs(spark, [(1, text)]), F.lit(True))
    said = [p.decode() for p in parts]
    assert len(said) == langid.PIECES and sum(map(len, said)) == langid.SAMPLE_BYTES
    at = [text.index(p) for p in said]
    assert [a * langid.PIECES // len(text) for a in at] == list(range(langid.PIECES))
    # the body behind a shared head is learned from
    r = random.Random(5)
    head = "cookie notice accept all " * 90
    rows = [(i, head + prose(r, 700, ["und der die nicht".split(), "the of and with".split()][i % 2])) for i in range(80)]
    got = langid.identify(docs(spark, rows, lang=[("de", "en")[i % 2] for i in range(80)]), F.col("doc_id") < 60).where("doc_id >= 60").collect()
    assert np.mean([x.lang_pred == ("de", "en")[x.doc_id % 2] for x in got]) >= 0.95


# --- 3 mixing ------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= cap * sizes[s]]
        if not over:
            out.update({s: left * w[s] / total for s in free})
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, prose(r, r.randint(1, 60))) for i in range(300)] + [(900, None), (901, ""), (1, "a b"), (1, "a b")]
    source = [r.choice(["a", "a", "a", "b", "c", "d", None]) for _ in rows]
    got = mixing.mix(docs(spark, rows, source=source)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for (_, t), s in zip(rows, source, strict=True):
        sizes[s] += len(ws_words(t))
    want = brute_targets(sizes)
    taken = Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert x.taken <= 3 * x.size and (x.taken == 0 or x.taken % x.size == 0)
        taken[x.source] += x.taken
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 80 for s in want)
    again = mixing.mix(docs(spark, rows, source=source).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [x.taken for x in mixing.mix(docs(spark, [(1, None)])).collect()] == [0]


# --- 4 top-k -------------------------------------------------------------------------


def test_topk(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([0.0, 0.0, 0.25, -0.5, 1.0]) for _ in range(6)]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6), (1100, []), (1004, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    got = Counter((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    v = {i: [int(np.floor(1024 * x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = Counter()
    for q in v:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:10]
            want.update((q, k + 1, c, -s) for k, (s, c) in enumerate(best))
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_beyond_long():
    big = np.array([2**40, 2**40])
    q, rows, score = topk.top_of_block(np.array([0]), [big], np.array([1, 2]), [big, -big], 1)
    assert (q, rows, score) == ([0], [1], [2**63 - 1])


# --- 5 quality -----------------------------------------------------------------------


def test_quality(spark):
    r = random.Random(7)
    good = [(i, prose(r, 60).capitalize() + ".") for i in range(0, 200, 2)]
    bad = [(i, r.choice([lambda: prose(r, 60).upper().replace(" ", "!! "), lambda: prose(r, 60).replace(" ", "### "), lambda: "spam " * 60])()) for i in range(1, 200, 2)]
    more = [(500, None), (501, ""), (502, "word"), (0, good[0][1]), (503, "x " * 50_000)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(0, None, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, good + bad + more)
    got = quality.classify(df, labels, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == 205 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    by = {x.doc_id: x.predicted for x in got}
    held = [i for i in range(200) if i % 5 == 0]
    assert np.mean([by[i] == (i % 2 == 0) for i in held]) >= 0.95
    assert {x.predicted for x in quality.classify(df, labels.limit(0), F.lit(True)).collect()} == {1}


@pytest.mark.parametrize("hot", [1, 4])
def test_quality_sample_of_repeated_rows(spark, hot):
    """All rows four times, or one document in a third of the rows, leave both classes whole."""
    rows = [(i, f"text {i}") for i in range(20)]
    rows = rows * 4 if hot == 4 else rows + [(0, f"text {k}") for k in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    x, y = quality.sample(docs(spark, rows), labels, F.lit(True), n=10)
    assert Counter(y.tolist()) == {0: 10, 1: 10} and x.shape == (20, len(quality.NAMES))


# --- 6 token counts ------------------------------------------------------------------


def test_words_like_the_library():
    enc = _tokens.word_ids(_tokens.default_path())
    r = random.Random(8)
    alpha = "abcdefgABCXYZÀÉéñßœſıŁµª'''s.,;!?0123456789<>|$_-÷×ÿ–…日ё\u0301 \x1f\xa0"
    texts = ["".join(r.choice(alpha) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["<|endoftext|> a", "don't IT'S", "İstanbul ΣΑΣ", "😀👍🏽", None]
    ids, offs = enc.texts(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == enc.slow.encode(t or "", add_special_tokens=False).ids, t


def test_edits(spark):
    enc = _tokens.word_ids(_tokens.default_path())
    count = lambda t: len(enc.slow.encode(t, add_special_tokens=False).ids)
    r = random.Random(9)
    rows = []
    for i in range(200):
        t = None if i % 50 == 0 else "".join(r.choice("ab  \n.é'7x") for _ in range(r.randint(0, 30)))
        edits = None if i % 7 == 0 else [(r.randint(-2, 40), r.choice([None, 0, 3, 99]), r.choice([None, "", "x", " y ", "\n"])) for _ in range(3)]
        rows.append((i % 190, t, edits))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}").withColumn("tokens_before", F.lit(1))
    got = Counter((x.doc_id, x.tokens_before, x.tokens_after) for x in token_counts.count_edits(df, F.col("edits")).collect())
    want = Counter()
    for i, t, edits in rows:
        now = t or ""
        for p, d, ins in edits or []:
            p = min(max(p, 0), len(now))
            now = now[:p] + (ins or "") + now[p + min(d or 0, len(now) - p) :]
        want[i, count(t or ""), count(now)] += 1
    assert got == want
    assert token_counts.count_edits(docs(spark, []), token_counts.seeded_edits()).count() == 0


# --- 7 chat --------------------------------------------------------------------------


def test_chat(spark):
    r = random.Random(10)
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\nhi", "\\<|\\", "a|b\\", "", None, "x " * 3000]
    rows = []
    for c in [*range(25), None]:
        for t in range(r.randint(1, 30)):
            rows.append((c, t if t != 5 else None, r.choice(["user", "assistant", "system", None, "odd|\\<role"]), r.choice([*nasty, prose(r, 60), prose(r, 20)])))
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("loss", F.lit("x"))
    made = chat.windows(df)
    got = {x.conv_id: x for x in chat.digest(made).collect()}
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    parts = {c: list(g) for c, g in groupby(sorted(rows, key=key), key=lambda x: x[0])}
    assert set(got) == set(parts)
    for c, g in parts.items():
        all_ = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in g)
        loss = "".join(x[3] or "" for x in g if x[2] == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(g), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for x in made.collect():
        turns = chat.read_turns(x.text)
        assert len(turns) > x.repeated and (x.tokens <= chat.BUDGET or len(turns) - x.repeated == 1)
    assert chat.digest(chat.windows(df.limit(0))).count() == 0


# --- 8 url filter --------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://www.x.example.org/en/17", "www.x.example.org", "/en/17", "example.org/en/1", "block"),
        ("http://x.example.org/en/7", "x.example.org", "/en/7", "org/", "allow"),
        ("http://thing.example.com/fr/casino", "thing.example.com", "/fr/casino", "com/fr/", "allow"),
        ("http://notexample.org", "notexample.org", "", None, "allow"),
        ("https://m.casino-win.example.net/en/40", "m.casino-win.example.net", "/en/40", None, "block"),
        ("https://ththing.example.net/en/40", "ththing.example.net", "/en/40", None, "allow"),
        ("mailto:x", "", "", None, None),
        (None, "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
    ],
)
def test_url_filter(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "old")], "page_id long, url string, host string")
    x = url_filter.url_filter(df).first()
    assert (x.host, x.path, x.rule) == (host, path, rule)
    assert x.verdict == verdict if verdict else x.verdict in ("allow", "block")


def test_url_rules(spark):
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(ValueError, match="rules"):
        url_filter.fitting_rule(F.lit("a"), F.lit("/"), (url_filter.RULES[0],) * 1001, "text")
    rows = [("http://bad.example/x", 1), ("http://good.example/x", 0), (None, 1), ("http://good.example/y", None)]
    w, _ = url_filter.fit_labelled(spark.createDataFrame(rows, "url string, label int"))
    assert len(w) == url_filter.BUCKETS and any(w)


def test_url_score(spark):
    urls = ["https://casino-win.example.net/a", "https://www.example.org/en/1", None]
    df = spark.createDataFrame([(k, u, 3) for k, u in enumerate(urls)], "page_id int, url string, url_score int")
    weights, bias = url_filter.train(tuple(url_filter.labelled_urls()))
    for x in url_filter.url_filter(df).collect():
        codes = list(f"^{x.host}|{x.path}$".encode())
        want = bias
        for n in url_filter.GRAMS:
            for i in range(len(codes) - n + 1):
                h = n
                for c in codes[i : i + n]:
                    h = (h * 31 + c) % 1048573
                want += weights[h % url_filter.BUCKETS]
        assert x.url_score == want and (x.rule is not None or (x.verdict == "block") == (want > 0))


# --- 9 jaccard join ------------------------------------------------------------------


def shingles(t, width):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in ws_words(t)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            common = len(sets[a] & sets[b])
            if same or (common and common * 100 >= percent * (len(sets[a]) + len(sets[b]) - common)):
                root[find(a)] = find(b)
    out = Counter()
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None and sets[b]]
        out[i, len(sets[a]), (min(ids, default=i) if sets[a] else i)] += 1
    return out


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 90, 256), (5, 80, 3)])
def test_jaccard(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = prose(r, 60, vocab).split()
        for k in range(14):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((g * 100 + k, " ".join(t).upper() if k % 3 else " \n".join(t)))
    passage = prose(r, 55, vocab)
    rows += [(700 + k, f"{prose(r, 40, vocab)} {passage}") for k in range(10)]
    rows += [(800, None), (801, ""), (802, " \t"), (803, "one two"), (804, "One TWO"), (805, "é É"), (None, rows[0][1]), (None, None), rows[0], (rows[0][0], rows[30][1]), (900, prose(r, 5000, vocab))]
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs(spark, rows), width, percent).collect())
    want = brute_components(rows, width, percent)
    for k in [k for k in want if k[0] is None and k[1]]:  # null ids take their group's id
        assert want[k]
    want = Counter({(i, n, c): v for (i, n, c), v in want.items()})
    assert got == want


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(12)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for p in links if None not in p and p[0] != p[1] for x in p}
    change = True
    while change:
        change = False
        for a, b in links:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                change = True
    assert got == label


# --- 10 packing ----------------------------------------------------------------------


def test_best_two_fit():
    r = np.random.default_rng(13)
    for n in (0, 1, 2, 50, 3000):
        size = np.minimum(4096, r.lognormal(6.5, 1, n).astype(int) + 1)
        seq, off = packing.best_two_fit(size)
        fill = np.bincount(seq, weights=size) if n else np.zeros(0)
        assert (fill <= 4096).all()
        for s in range(len(fill)):
            rows = np.flatnonzero(seq == s)
            rows = rows[np.argsort(off[rows])]
            assert off[rows].tolist() == [0, *np.cumsum(size[rows])[:-1]]
        if n == 3000:
            assert len(fill) <= size.sum() / 4096 * 1.01 + 1
    with pytest.raises(ValueError, match="piece"):
        packing.best_two_fit(np.array([5000]))
    # the gap of 4 that 6 + 3 leave in 13 and the piece 3 behind it take 5 + 2
    assert packing.best_two_fit(np.array([6, 5, 3, 2]), 13)[0].tolist()[:2] == [0, 0]


def test_packing(spark):
    r = random.Random(14)
    rows = [(i, prose(r, r.randint(0, 90))) for i in range(60)] + [(100, None), (101, ""), (0, "a b"), (0, "a b"), (None, "x"), (102, prose(r, 3000))]
    placed = packing.pack_documents(docs(spark, rows), capacity=256, with_ids=True)
    got = placed.collect()
    enc = _tokens.word_ids(_tokens.default_path())
    want = Counter()
    for i, t in rows:
        ids = [*enc.slow.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[i, k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    made = {x.sequence_id: x.ids for x in packing.sequences(placed).collect()}
    for x in got:
        assert made[x.sequence_id][x.offset : x.offset + x.length] == x.ids
    assert all(len(v) <= 256 for v in made.values())
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_packing_groups_of_null_and_repeated_ids(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(40).alias("length"), F.when(F.col("id") % 4 < 2, F.col("id")).otherwise(5).alias("ids_crc32"))
    got = packing.pack(rows, 256, per_group=100).collect()
    assert Counter((x.doc_id, x.ids_crc32) for x in got) == Counter((x.doc_id, x.ids_crc32) for x in rows.collect())
    sizes = Counter(x.sequence_id >> 40 for x in got)
    assert len(sizes) == 20 and max(sizes.values()) < 200


# --- pipeline ------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(15)
    kinds = {"en": VOCAB, "de": "und der die straße über nicht für haus fluss stein".split()}
    texts, lang = [], []
    for i in range(160):
        k = "en" if i % 2 else "de"
        texts.append((i, prose(r, 50, kinds[k] + [f"{k}w{j}" for j in range(300)]).capitalize() + "."))
        lang.append(k)
    texts += [(200 + i, prose(r, 50).upper().replace(" ", "!! ")) for i in range(40)] + [(300 + i, texts[3][1]) for i in range(5)] + [(400, None), (401, "123 !!"), (3, texts[3][1])]
    lang += ["en"] * 40 + ["en"] * 5 + [None, "en", "en"]
    source = [f"s{i % 4}" for i in range(len(texts))]
    docs(spark, texts, lang=lang, source=source).withColumnRenamed("size", "copies").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(160)] + [(200 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(Counter(x.doc_id for x in now.collect()))
    assert not {400, 401} & set(seen[0]) and {*range(160)} <= set(seen[0])
    assert len({*range(160)} - set(seen[1])) <= 3 and not {*range(200, 240)} & set(seen[1])
    assert not {*range(300, 305)} & set(seen[2]) and seen[2][3] == 1 and max(seen[2].values()) == 1
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].values()) <= 3
    assert set(seen[4]) == set(seen[3])


def test_pipeline_null_and_shared_ids(spark):
    import corpus_pipeline

    r = random.Random(16)
    a, b, c, d, e = (prose(r, 60, [f"{k}{j}" for j in range(300)]) for k in "abcde")
    rows = [(None, a), (None, a), (1, a + " more"), (None, b), (None, b), (2, c), (2, d), (3, c), (4, d), (5, e), (5, e), (None, ""), (6, None)]
    df = docs(spark, rows)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter([(1, a + " more"), (None, b), (2, c), (2, d), (5, e), (None, ""), (6, None)])


def test_pipeline_mix_of_shared_ids(spark):
    import corpus_pipeline

    r = random.Random(17)
    rows = [(k % 40 if k % 5 else None, prose(r, r.choice([20, 20, 30, 41]))) for k in range(120)]
    df = docs(spark, rows, source=[f"s{k % 3}" for k in range(120)])
    want = Counter()
    for x in mixing.mix(df).collect():
        want[x.doc_id, x.source, x.size] += x.taken // x.size
    got = Counter((x.doc_id, x.source, len(ws_words(x.text))) for x in corpus_pipeline.mix(spark, df, "").collect())
    assert got == +want
