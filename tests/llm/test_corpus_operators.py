"""Role repair, packing, site trees, the quality field, line and near dedup, and the pipeline against brute force."""

import collections
import itertools
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skyloom.llm import chat, columns, line_dedup, near_dedup, packing, quality_crf, registry, site_tree

TOKENS = P.path("word_bpe_49k.json")


# Role repair


def brute_cost(roles, costs):
    """The least cost over all sequences of actions, by plain search."""
    best = {chat.START: 0.0}
    repairer = chat.Repairer(costs)
    for r in roles:
        nxt = {}
        for s, c in best.items():
            for t in (1, 2, 3):
                own = 0.0 if chat.ROLES.get(r) == t else costs.relabel if r in chat.ROLES else costs.relabel_unknown
                if s == t:
                    nxt[t] = min(nxt.get(t, 1e9), c + own + costs.merge)
                for k in range(3):
                    for path in itertools.product((1, 2, 3), repeat=k):
                        chain = (s, *path, t)
                        if all(b in chat.LEGAL[a] for a, b in zip(chain, chain[1:])):
                            nxt[t] = min(nxt.get(t, 1e9), c + own + k * costs.insert)
        best = nxt
    return min(c + repairer.finish[s] for s, c in best.items())


def conversations(spark, convs):
    rows = [(c, i, r, f"t{c}.{i}") for c, roles in enumerate(convs) for i, r in enumerate(roles)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("partitions", [1, 7])
def test_repair_has_least_cost_and_legal_turns(spark, partitions):
    rng = random.Random(1)
    convs = [[rng.choice(["user", "assistant", "system", "tool", None]) for _ in range(rng.randint(1, 7))] for _ in range(40)] + [["user", "assistant"] * 150]
    rows = chat.repair(conversations(spark, convs), partitions=partitions).orderBy("conv_id", "position").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append(r)
    for c, roles in enumerate(convs):
        assert [r["position"] for r in by[c]] == list(range(len(roles)))
        assert sum(r["cost"] for r in by[c]) == pytest.approx(brute_cost(roles, chat.Costs()))
        turns = re.findall(r"<\|(\w+)\|>\n", "".join(r["rendered"] for r in by[c]).replace("<|end|>\n", ""))
        state = chat.START
        for t in turns:
            assert chat.ROLES[t] in chat.LEGAL[state]
            state = chat.ROLES[t]
        assert state in chat.ACCEPT and "".join(r["rendered"] for r in by[c]).endswith("<|end|>\n")


def test_repair_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "<|system|> x"), (1, 2, "user", "<|system|> x"), (None, 1, "user", ""), (2, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(9))
    got = chat.repair(df).collect()
    assert len(got) == 5 and not any("<|system|> x" in r["rendered"] for r in got)
    assert [r["inserted"] for r in got if r["conv_id"] == 2] == [["user"]]
    assert chat.repair(df.where("false")).count() == 0


# Packing


def packed(docs, window=64):
    return packing.pack(docs, TOKENS, window=window).collect()


def test_packing_keeps_every_id_once_and_mixes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    texts = {r["doc_id"]: r for r in docs.collect()}
    tok = Tokenizer.from_file(TOKENS)
    rows = packed(docs, 1024)
    ids = {d: tok.encode(r["text"] or "", add_special_tokens=False).ids + [2] for d, r in texts.items()}
    by = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(by) == set(ids)
    for d, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[d][at : at + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[d])
            at += r["length"]
        assert at == len(ids[d])
    total = sum(map(len, ids.values()))
    assert len(windows) == -(-total // 1024)
    share = collections.Counter()
    for d, x in ids.items():
        share[texts[d]["source"]] += len(x)
    for w, pieces in windows.items():
        at, own = 0, collections.Counter()
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            own[r["source"]] += r["length"]
        if w < len(windows) - 1:
            assert at == 1024 and all(abs(own[s] - 1024 * n / total) < 2.01 for s, n in share.items())


def test_packing_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "word " * 5000, "a"), (3, "word " * 5000, "a"), (4, "x", "rare"), (None, "y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("at", F.lit(1))
    rows = packed(docs)
    assert sum(r["length"] for r in rows) == 1 + 1 + 2 * 5001 + 2 + 2
    assert packing.pack(docs.where("false"), TOKENS).count() == 0


def own_by_window(rows):
    own = collections.defaultdict(collections.Counter)
    for r in rows:
        own[r["sequence_id"]][r["source"]] += r["length"]
    return own


def test_thousands_of_small_sources_carry_deficits(spark):
    """5,000 sources of less than a token a window, one with a thousandth of all, and a large one."""
    rows = [(i, "one two three", f"s{i % 5000}") for i in range(10_000)] + [(20_000 + i, "four five six seven", "large") for i in range(8000)] + [(30_000 + i, "eight", "thin") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    own = own_by_window(packed(docs, 256))
    total = 40_000 + 40_000 + 120
    assert len(own) == -(-total // 256) and all(sum(own[w].values()) == 256 for w in range(len(own) - 1))
    for source, n in [("large", 40_000), ("thin", 120), ("s7", 8), ("s4999", 8)]:
        sent = 0
        for w in range(len(own) - 1):
            sent += own[w][source]
            # A deficit is under a token a level of the tree, which has 13 here.
            assert abs(sent - n * (w + 1) * 256 / total) < 13


def test_a_small_target_is_met_over_windows(spark):
    """Two tokens in ten thousand: a token every 19 or 20 windows, not all at the end."""
    rows = [(i, "one two three four five six seven", "a") for i in range(2000)] + [(5000, "x y z", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    own = own_by_window(packing.pack(docs, TOKENS, window=256, targets={"a": 0.9998, "b": 0.0002}).collect())
    places = [w for w in sorted(own) for _ in range(own[w]["b"])]
    assert len(places) == 4 and all(18 <= b - a <= 21 for a, b in zip(places, places[1:-1]))


@pytest.mark.parametrize("most", [1, 3, 8])
def test_sources_beyond_the_queues_share_some(spark, most):
    docs = spark.createDataFrame([(i, "one two three", f"s{i % 20}") for i in range(400)], "doc_id long, text string, source string")
    rows = packing.pack(docs, TOKENS, window=16, most_queues=most).collect()
    assert all(sum(c.values()) == 16 for c in own_by_window(rows).values()) and sum(r["length"] for r in rows) == 1600
    at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(at, at[1:]))


def test_word_ids_equal_the_tokenizer():
    words, tok = packing.WordIds(TOKENS, 2, most=500, most_parts=700, most_long=4000), Tokenizer.from_file(TOKENS)

    def same(texts):
        for text, got in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2], text

    same(["It's DON'T J̌ İstanbul ﬁ ½² 12,3! é!* È. ΣΑΣ 日本、ok ª µ ŉ a.b,c!!", "<|endoftext|> x\x1cy\x85z b", "", "***$$$ word%%% a1b2!", "İ. xİ, a<|endoftext|>b! <|ENDOFTEXT|>,"])
    rng = random.Random(3)
    letters = "abZéÈßİıſŉǅªµñΣς日가Ա'’1٣.,!?|$#*:;%&~\u0307\u0301\u0338\u00a0\x1c\x85 \n\t"
    for _ in range(40):
        same(["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(100)])
    same([" ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", ",!"]) for _ in range(5000))])
    # Long words are forgotten by their bytes.
    for i in range(4):
        same([f"{i}" + "xé." * 2000, "a" * 3000])
        assert words.long < 25_000
    same(["x y"])
    assert words.long == 0 and len(words.words) == 2


def brute_rounds(sizes, weights, window):
    """The queue of every token, one token after another: credits by share until a queue is dry; halves of the queues take turns by their parts of the stretch."""
    credited, sent, out = [Fraction(0)] * len(sizes), [0] * len(sizes), []
    while sum(sent) < sum(sizes):
        rates = [w if c < n else 0 for w, c, n in zip(weights, credited, sizes)]
        if not sum(rates):
            rates = weights = [Fraction(n) if c < n else 0 for c, n in zip(credited, sizes)]
        step = min((n - c) / r for n, c, r in zip(sizes, credited, rates) if r)
        credited = [c + step * r for c, r in zip(credited, rates)]
        quota = [int(c) - s for c, s in zip(credited, sent)]
        passed = collections.Counter()

        def turn(low, high):
            if high - low == 1:
                return low
            middle = (low + high) // 2
            # The left half is owed a token when its part of what both have sent, with this one, reaches a whole token more.
            both = passed[low, high] = passed[low, high] + 1
            owed = Fraction(both * sum(quota[low:middle]), sum(quota[low:high]))
            left = owed >= passed[low, high, "left"] + 1
            passed[low, high, "left"] += left
            return turn(low, middle) if left else turn(middle, high)

        out += [turn(0, len(sizes)) for _ in range(sum(quota))]
        sent = [int(c) for c in credited]
    return [[out[i : i + window].count(q) for q in range(len(sizes))] for i in range(0, len(out), window)]


@pytest.mark.parametrize(
    "sizes, weights, window",
    [([700, 200, 101], [700, 200, 101], 64), ([500, 500, 30], [5, 1, 2], 50), ([90, 400, 7, 55], [Fraction(1, 3), Fraction(1, 2), Fraction(1, 6), 0], 32), ([10], [0], 16), ([900, 3, 40, 2, 1, 60, 0], [900, 3, 40, 2, 1, 60, 0], 16), ([40, 3, 900, 5], [1, Fraction(1, 900), 300, 0], 32)],
)
def test_rounds_equal_deficit_round_robin(sizes, weights, window):
    rounds = packing.Rounds(sizes, [Fraction(w) for w in weights], window)
    want = brute_rounds(sizes, [Fraction(w) for w in weights], window)
    spans = [[rounds.span(w, q) for q in range(len(sizes))] for w in range(len(want))]
    got = [[after - first for first, after, _ in row] for row in spans]
    assert got == want and all(sum(row) == window for row in got[:-1]) and [sum(c) for c in zip(*got)] == sizes
    assert all([place for _, _, place in row] == [sum(own[:q]) for q in range(len(sizes))] for row, own in zip(spans, got))
    for q, n in enumerate(sizes):
        assert [rounds.window_of(q, at) for at in range(n)] == [w for w, row in enumerate(want) for _ in range(row[q])]


def test_packing_to_target_shares(spark):
    rows = [(i, "one two three four five six seven", "a" if i % 10 else "b" if i % 20 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    rows = packing.pack(docs, TOKENS, window=64, targets={"b": 0.5, "a": 0.25, "gone": 0.25}).collect()
    own = collections.defaultdict(collections.Counter)
    for r in rows:
        own[r["sequence_id"]][r["source"]] += r["length"]
    total = 600 * 8
    assert len(own) == total // 64 and all(sum(c.values()) == 64 for c in own.values())
    # 240 tokens of b at two thirds of a window, then a alone, then the source without a target.
    assert [own[w]["b"] for w in range(5)] == [43, 43, 42, 43, 43] and own[7]["b"] == 0 and own[10] == {"a": 64} and own[74] == {None: 64}
    at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(at, at[1:]))


# Site trees

PAGE = """<!doctype html><html><head><title>T</title><style>x{}</style></head><body class=home><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div><!-- c --><script>var a="<p>no</p>";</script>
<article><h1>Caf&eacute; {n}</h1><p><b>Own  text
{n}.<br><p>More &lt;b&gt; &amp; {n}<aside>side</aside><form><input><label>mail</label></form>
<div class="note-box">Read our rules</div><section class="comments"><article><p>nice {n}</p></article></section></article><div class="ad">Buy</div><footer>end</footer>"""


def test_site_tree_extracts_the_article(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.replace("{n}", str(n))) for n in range(12)]
    got = {r["page_id"]: r["text"] for r in site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Café {n} Own text {n}. More <b> & {n}" for n in range(12)}


def test_repeated_articles_are_kept(spark):
    same = PAGE.replace("{n}", "x")
    rows = [(n, "http://h.example/", same.replace("Home", f"Home{n}")) for n in range(10)]
    got = {r["text"] for r in site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 1 and next(iter(got)).startswith("Café x Own text x. More")


def test_site_tree_without_landmark_cuts_repeats(spark):
    html = "<body><div class=top>Same on all</div><div class=body>Text of {n} alone</div></body>"
    rows = [(n, "http://k.example/", html.replace("{n}", str(n))) for n in range(8)]
    got = {r["page_id"]: r["text"] for r in site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Text of {n} alone" for n in range(8)}


def texts_of(spark, rows, **rules):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in site_tree.main_text(df, site_tree.TreeRules(**rules)).collect()}


def test_site_tree_alone_equals_names(spark):
    """Where furniture repeats on a host of enough pages, entropies give the text that names give."""
    page = "<body><nav><ul><li>Home<li>About</ul></nav><div class=ad>Buy now</div><article><h1>Title {n}</h1><p>Own words {n}<p>More {n}</article><aside>See also</aside><footer>end</footer>"
    other = page.replace("nav", "div").replace("class=ad", "class=x").replace("article", "section").replace("aside", "div").replace("footer", "div")
    rows = [(n, f"http://{'a' if n % 2 else 'b'}.example/{n}", page.replace("{n}", str(n))) for n in range(24)]
    want = {n: f"Title {n} Own words {n} More {n}" for n in range(24)}
    assert texts_of(spark, rows) == texts_of(spark, rows, prior=1.0) == want
    assert texts_of(spark, [(i, u, other.replace("{n}", str(i))) for i, u, _ in rows]) == want


def brute_tree(rows, rules):
    """Main texts by a plain walk over each host's pages."""
    import math

    hosts, out = collections.defaultdict(dict), {}
    for _, url, html in rows:
        own = site_tree.blocks(html)
        hosts[site_tree.host_of(url)][html] = list(zip(own, site_tree._doubted(own)))
    for i, url, html in rows:
        pages, scores = hosts[site_tree.host_of(url)], {}
        for key in {(b.node, d, b.landmark and b.plain) for own in pages.values() for b, d in own}:
            held = [x for x in ([b.text for b, d in own if (b.node, d, b.landmark and b.plain) == key] for own in pages.values()) if x]
            m = len(held)
            entropy = lambda xs: 1.0 if m == 1 else -sum(c / m * math.log(c / m) for c in collections.Counter(xs).values()) / math.log(m)
            best = 1.0 if m < rules.min_pages or key[2] else max(entropy(map(tuple, held)), entropy(map(len, held)))
            scores[key] = best * (rules.prior if key[1] else 1.0)
        bar = rules.least_importance * max(scores.values(), default=0)
        low = {k[:2] for k, v in scores.items() if v < bar}
        out[i] = " ".join(b.text for b, d in pages[html] if (b.node, d) not in low)
    return out


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_site_tree_matches_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(site_tree, "BROADCAST_BYTES", broadcast)
    rng = random.Random(2)
    parts = ["<nav>{a}</nav>", "<div class=x>{a}</div>", "<div class=y><p>{b}<p>{a}</div>", "<article><p>{b}<div class=z>{a}</div></article>", "<ul><li>{a}<li>{b}</ul>", "<footer>{b}</footer>", "<div id=cookie-bar>{b}</div>"]
    rows = []
    for i in range(60):
        html = "".join(p.replace("{a}", rng.choice("uvw")).replace("{b}", f"t{rng.randrange(50)}") for p in parts if rng.random() < 0.7)
        rows.append((i, f"http://h{i % 4}/", html))
    for rules in (site_tree.TreeRules(), site_tree.TreeRules(prior=0.6, least_importance=0.55)):
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        assert {r["page_id"]: r["text"] for r in site_tree.main_text(df, rules).collect()} == brute_tree(rows, rules)


def test_names_do_not_hurt_articles():
    text = lambda html: [b.text for b in site_tree.blocks(html) if not b.noise]
    assert text('<article><p class="social-science">A</p><h2 id="search-methods">B</h2><div class="social share-bar">no</div></article>') == ["A", "B"]
    assert text('<article><p>See <a class="related">this <b>link</b></a> now</p><span class="ad">Buy</span><p>on</p></article>') == ["See this link now", "on"]
    assert text("<article><p>a<select><option>x<option>y</article><p>rest") == ["a", "rest"]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td><p>f<p>g<tr><td>h</table>") == list("abcdefgh")


@pytest.mark.parametrize("html", ["<div>" * 1_000_000, "<div>" + "<p>x</p></p>" * 100_000, "<td><p>" * 150_000, "<ul><li>" * 150_000, "<b class=ad>" * 50_000])
def test_pages_are_parsed_in_linear_time(html):
    start = time.process_time()
    site_tree.blocks(html)
    assert time.process_time() - start < 60


@pytest.mark.parametrize("size", [5, 12_000, 1_000_000])
def test_inline_furniture_of_any_length(spark, size):
    ad = "x" * size
    pages = [
        f'<article><p>One</p><span class="ad">{ad}</span><p>Two</p></article>',
        f'<article><p>One</p><span class="ad"><span>{ad}</span> more</span><p>Two</p></article>',
        f'<article><p>One</p><span class="ad"><div>{ad}</div></span><p>Two</p></article>',
        f'<article><p>One</p><a class="share">{ad}</a> <a class="social">b</a><p>Two</p></article>',
        f'<article><p>One</p><div class="reader-feedback">{ad}</div><div class="advertorial">{ad}</div><p>Two</p></article>',
        '<article><p>One</p><p>Two</p><span class="ad">never closed</article>',
        '<article><p>One</p><p>Two <span class="ad">kept</span></p></article>',
    ]
    docs = spark.createDataFrame([(i, f"http://h{i}/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.main_text(docs).collect()}
    assert [got[i] for i in range(5)] == ["One Two"] * 5
    assert got[5] == "One Two never closed" and got[6] == "One Two kept"


def test_site_tree_on_odd_pages(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (3, "http://x/", "<p>a < b <"), (3, "http://x/", "<p>a < b <"), (4, "http://x/", "<div>" * 3000 + "deep"), (None, "http://x/", "plain &unknown; &amp")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))
    got = sorted((r["page_id"] or 0, r["text"]) for r in site_tree.main_text(df).collect())
    assert got == [(0, "plain &unknown; &"), (1, ""), (2, ""), (3, "a < b <"), (3, "a < b <"), (4, "deep")]
    assert site_tree.main_text(df.where("false")).count() == 0


# Quality field


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    score, pair, lengths = rng.normal(0, 2, 7), rng.normal(0, 1, (2, 2)), np.array([4, 1, 2])
    good, pairs, z = quality_crf.marginals(score, lengths, pair)
    at = 0
    for d, n in enumerate(lengths):
        weights = {y: np.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(pair[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=n)}
        total = sum(weights.values())
        assert z[d] == pytest.approx(np.log(total))
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
        for a, b in itertools.product((0, 1), repeat=2):
            assert pairs[d, a, b] == pytest.approx(sum(w * sum((u, v) == (a, b) for u, v in zip(y, y[1:])) for y, w in weights.items()) / total)
        at += n


def test_field_on_held_out_documents(spark, sf):
    sf01 = sf.replace("sf0.001", "sf0.01")
    rows = registry.op6_quality_crf(spark, sf01).join(spark.read.parquet(f"{sf01}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_field_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A good line."), (3, "A good line."), (4, "bad*** " * 9000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (4, None), (99, 1)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality_crf.classify(docs, model).collect()}
    assert got[3] > got[4] and 0 <= got[1] <= 1 and got[1] == got[2]
    none = quality_crf.train(docs, labels.where("false"), F.lit(True))
    assert {r["score"] for r in quality_crf.classify(docs, none).collect()} == {0.5}
    assert quality_crf.classify(docs.where("false"), model).count() == 0


def test_field_does_not_depend_on_the_order_of_rows(spark):
    """Ids 0 to 5 have two texts each."""
    rows = [(i % 20, f"Line {i} of words.\n" * (i % 4 + 1) + "$$$ " * (i % 3)) for i in range(26)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    models = [quality_crf.train(spark.createDataFrame(order, "doc_id long, text string").repartition(n), labels, F.lit(True)) for order, n in ((rows, 3), (rows[::-1], 2))]
    assert (models[0].weights == models[1].weights).all() and (models[0].pair == models[1].pair).all()


def test_field_learns_from_all_lines(spark):
    same = ["A plain line of words that all of the documents share."] * 120
    good, bad = ["The report describes how the river was measured over ten years."] * 150, ["!!! $$$ CLICK ### HERE ||| NOW *** FREE"] * 150
    docs = spark.createDataFrame([(i, "\n".join(same + (good if i % 2 else bad))) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_crf.classify(docs, quality_crf.train(docs, labels, F.lit(True))).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2) + 0.2


# Near duplicates


def texts_with_copies(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 150]))]
        out.append(" ".join(words) + (" " + passage if i % 4 == 0 else ""))
        for _ in range(rng.choice([0, 0, 1, 9])):
            w = out[-1].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    return [None, "", " ", "Aa b", "aA B", *out]


def brute_components(texts, size, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("cold, size", [(32, 4), (2, 4), (3, 5)])
def test_near_duplicates_match_brute_force(spark, cold, size):
    texts = texts_with_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, near_dedup.Similarity(shingle=size, cold=cold)).collect()}
    want = brute_components(texts, size)
    assert len(got) == len(texts)
    for i, (n, c) in enumerate(want):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(20_000))
    docs = spark.createDataFrame([(5, long), (4, long + " end"), (4, long + " end"), (None, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 4, False), (4, 4, True), (4, 4, True), (None, 7, False), (7, 7, True)], key=str)
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    """Ids 1 and 2 have text a, 3 has b, 5 has both; 8 has c and nothing, 9 has c; 6 has two texts of its own."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(1, a), (2, a), (3, b), (5, a), (5, b), (8, c), (8, None), (9, c + " end"), (6, "q r s t u v"), (6, "h i j k l m"), (None, b), (None, None), (7, "x y z"), (7, "x y z")]
    expected = [(1, 1), (2, 1), (3, 1), (5, 1), (5, 1), (8, 8), (8, 8), (9, 8), (6, 6), (6, 6), (None, 1), (None, None), (7, 7), (7, 7)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = near_dedup.near_duplicates(docs).collect()
        assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(expected, key=str)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
        assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 8) == [0, 26]


@pytest.mark.parametrize("variants", [36, 40, 44])
def test_near_duplicates_of_a_whole_set_in_sampled_ones(spark, variants):
    base = [f"b{i}" for i in range(68)]
    texts = [" ".join(base)] + [" ".join(base + [f"v{v}x{i}" for i in range(16)]) for v in range(variants)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (64 if i == 0 else 80, 0) for i in range(variants + 1)}


# Lines


def brute_lines(texts, percent=80, least=5):
    seen, out = [], set()
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            s = frozenset(line.encode().lower().split())
            if len(s) < least:
                continue
            if any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                out.add((d, i))
            seen.append(s)
    return out


@pytest.mark.parametrize("short, ranked, hot", [(48, 1 << 17, 1 << 20), (2, 20, 30)])
def test_removed_lines_match_brute_force(spark, short, ranked, hot):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(120)]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 6, 10, 25]))) for _ in range(40)]
    texts = [None, ""]
    for _ in range(60):
        own = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(lines).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            own.append(" ".join(w))
        texts.append("\n".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("line", F.lit("clash"))
    rules = line_dedup.LineRules(min_tokens=5, short=short, ranked=ranked, hot=hot)
    rows = line_dedup.line_report(docs, rules).collect()
    assert {(r["doc_id"], i) for r in rows for i in r["removed"]} == brute_lines(texts) and len(rows) == len(texts)
    cut = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, rules).collect()}
    gone = collections.defaultdict(set)
    for d, i in brute_lines(texts):
        gone[d].add(i)
    for d, t in enumerate(texts):
        assert cut[d]["text"] == (t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]))


def test_lines_of_odd_rows(spark):
    same = "this line has quite enough words"
    docs = spark.createDataFrame([(None, same), (2, same + "\n" + same), (2, same), (1, "short"), (9, "word " * 50_000 + same)], "doc_id long, text string")
    got = {r["doc_id"]: sorted(r["removed"]) for r in line_dedup.line_report(docs).collect() if r["n_lines"] == 2 or r["doc_id"] != 2}
    assert got[2] == [1] and got[None] == [] and got[1] == []
    assert line_dedup.line_report(docs.where("false")).count() == 0


@pytest.mark.parametrize("short", [48, 2])
def test_short_lines_match_brute_force(spark, short):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(9)]
    texts = ["\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 7))) for _ in range(4)) for _ in range(40)]
    texts += ["a b c d", "d c b a e", "x x x y", "y x", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_dedup.line_report(docs, line_dedup.LineRules(short=short, hot=20 if short == 2 else 1 << 20)).collect()
    want = brute_lines(texts, least=1)
    assert {(r["doc_id"], i) for r in rows for i in r["removed"]} == want and {(41, 0), (43, 0)} <= want


def test_pipeline_stage_removes_short_lines(spark, sf):
    rows = [(1, "Read more\nfirst own words", "en", "s", 25), (2, "read  MORE\na b c d", "en", "s", 17), (3, "a b c d e\nkept", "en", "s", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, sf).collect()}
    assert got == {1: "Read more\nfirst own words", 2: "a b c d", 3: "kept"}


def test_equal_lines_are_decided_by_whole_hashes(spark):
    """Words that share 44 bits of a 64-bit hash in some orders are still different words."""
    texts = ["alpha beta gamma delta w896827", "alpha beta gamma delta w7579430", "alpha beta gamma delta w7579431"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup.line_report(docs).collect()] == [0, 0, 0]


def test_word_hashes_of_long_and_odd_texts():
    hasher = columns.WordHasher(2)
    texts = [b"x" * (3 << 20), None, b"", b"A b\n\n\x0bC\r\n", "É é".encode(), b"a " * 700_000 + b"\nz"]
    line, (h, h2), first = hasher.lines(texts)
    assert first.tolist() == [0, 1, 2, 3, 7, 8, 10]
    word = lambda w: tuple(x[0] for x in columns.WordHasher(2).lines([w])[1])
    assert len(h) == 1 + 3 + 2 + 700_001 and line[1:6].tolist() == [3, 3, 5, 7, 7] and line[-1] == 9
    assert [(h[i], h2[i]) for i in (1, 2, 3, -2, -1)] == [word(w) for w in (b"a", b"b", b"c", b"a", b"z")] and h[4] != h[5]
    assert [c.tolist() for c in columns.unpack(columns.pack(h[:5], line[:5]))] == [h[:5].tolist(), line[:5].tolist()]


# The pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "near_dedup", "packing"]
    sizes, now = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    rows = now.collect()
    assert brute_lines([r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]) == set()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [c for i, (_, c) in enumerate(brute_components([r["text"] for r in rows], 5)) if c != i] == []
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}
    good = {r["doc_id"] for r in docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1").collect()}
    ruled = {r["doc_id"] for r in corpus_pipeline.quality_rules_stage(spark, docs, sf).collect()}
    base = {r["doc_id"] for r in registry.op2_quality_rules(spark, sf).where("base_failed").collect()}
    assert good - base <= ruled


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Null, empty, very long and repeated texts, null ids, extra columns whose names clash, and no rows at all."""
    plain = "The report describes how the river was measured over ten years by the same people."
    other = "A second text tells of a quiet harbour where boats of every size wait for the tide to turn."
    long = " ".join(f"stone{i} river{i} carries{i} sand{i} slowly." for i in range(20_000))
    rows = [(1, None), (2, ""), (3, plain), (3, plain), (4, plain + " More."), (5, other + "\n" + plain), (6, long), (7, " \n\t"), (8, "word"), (None, other), (9, other.upper()), (10, "x" * 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, removed int, n int, kept string"
    docs = spark.createDataFrame([(i, t, "en", None if i == 3 else "s", len(t or ""), "x", 1, 2, "y") for i, t in rows], schema)
    columns = list(corpus_pipeline.COLUMNS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert stage(spark, docs.where("false"), sf).count() == 0
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect() if name in ("quality_rules", "line_dedup"))
    ids = {name: collections.Counter(i for i, _ in found) for name, found in kept.items()}
    # Rules reject what has fewer than ten words; the classifier and near dedup judge rows of one id alike.
    assert not {1, 2, 7, 8, 10} & set(ids["quality_rules"]) and ids["quality_rules"][3] == 2 and ids["quality_rules"][6] == 1
    assert ids["quality_classifier"][3] in (0, 2)
    # The later place of a line goes; a document of which no word is left goes with it.
    assert (3, plain) in kept["line_dedup"] and (5, other) in kept["line_dedup"] and {1, 2, 7, 8} <= set(ids["line_dedup"]) | {1, 2, 7}
    assert ids["near_dedup"][3] == 2 and ids["near_dedup"][4] == 0 and ids["near_dedup"][9] == 1 and ids["near_dedup"][None] == 1
    pieces = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    tok = Tokenizer.from_file(TOKENS)
    assert sum(r["length"] for r in pieces) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert corpus_pipeline.packing_stage(spark, docs.where("false"), sf).count() == 0
