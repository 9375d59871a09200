"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import math
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loamgrid.llm import decontamination, html_extract, language_id, language_model, minhash_dedup, packing, quality_pu, quality_rules, token_counts, warc
from loamgrid.llm import queries as Q
from tests.llm.common import LOREM
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, name):
    got = rows(Q.QUERIES[name](spark, SF).toPandas())
    assert got == rows(connect(SF).sql(Q.ORACLE_SQL[name]).arrow().read_all().to_pandas())


def documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d, {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}


# language model


def test_base_scores_and_block_sizes(spark):
    d, texts = documents(spark)
    tokens = {k: [*t.encode().lower().split(), None] for k, t in texts.items()}
    seen = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    n, v = sum(seen.values()), len(seen)
    one = {r["doc_id"]: r for r in language_model.score_documents(d).collect()}
    for k, ws in tokens.items():
        assert one[k]["n_tokens"] == len(ws) and one[k]["train_tokens"] == n and one[k]["n_known"] == sum(w in seen for w in ws)
        assert one[k]["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    for fan_out in (256, 3):  # one level of shards, and several
        many = language_model.score_documents(d.repartition(7), block_tokens=3000, shard_entries=2000, fan_out=fan_out).collect()
        assert len(many) == len(one)
        for r in many:
            assert r["n_known"] == one[r["doc_id"]]["n_known"] and r["train_tokens"] == n
            assert r["score"] == pytest.approx(one[r["doc_id"]]["score"], rel=1e-6)
    held = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_shards_in_levels():
    for n, fan_out, sizes in ((1, 256, [1]), (224, 256, [224]), (257, 256, [17, 289]), (20, 3, [3, 9, 27])):
        assert language_model._shard_levels(n, fan_out) == sizes
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    of = lambda m: np.concatenate([[s] * (b - a) for s, a, b in language_model._ranges(keys, m)])
    assert (of(9 * 5) // 5 == of(9)).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_against_brute_force(spark, order):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d e".split()) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score_documents(d, order=order).collect()}
    fold = {k: zlib.crc32(str(k).encode()) % 10 for k in range(60)}

    def grams(ids):
        out = [Counter() for _ in range(order + 1)]
        for k in ids:
            seq = ["<s>"] * (order - 1) + texts[k].split() + ["</s>"]
            for t in range(order - 1, len(seq)):
                for m in range(order):
                    out[m + 1][tuple(seq[t - m : t + 1])] += 1
                    out[0]["context", tuple(seq[t - m : t])] += 1
        return out

    train = grams([k for k in fold if fold[k]])
    kept = grams([k for k in fold if fold[k] > 1])
    vocabulary = len(train[1])

    def parts(c, seq, t):
        p, last = [1 / (vocabulary + 1)], 0
        for m in range(order):
            last = c[0]["context", tuple(seq[t - m : t])] if m else sum(c[1].values())
            p.append(c[m + 1][tuple(seq[t - m : t + 1])] / last if last else 0.0)
        return min(int(math.log2(1 + last)), language_model.BUCKETS - 1), p

    def rows_of(c, ids):
        for k in ids:
            seq = ["<s>"] * (order - 1) + texts[k].split() + ["</s>"]
            for t in range(order - 1, len(seq)):
                yield k, *parts(c, seq, t)

    held = [(b, p) for _, b, p in rows_of(kept, [k for k in fold if fold[k] == 1])]
    w, last = np.full((language_model.BUCKETS, order + 1), 1 / (order + 1)), None
    for _ in range(language_model.ROUNDS):
        s, loss = np.full(w.shape, 0.1 / (order + 1)), 0.0
        for b, p in held:
            each = w[b] * p
            s[b] += each / each.sum()
            loss += math.log(each.sum())
        w = s / s.sum(1, keepdims=True)
        if last is not None and abs(loss - last) <= language_model.TOLERANCE * abs(last):
            break
        last = loss
    want = Counter()
    for k, b, p in rows_of(train, fold):
        want[k] += math.log10((w[b] * p).sum())
    for k in fold:
        assert got[k] == pytest.approx(want[k], rel=1e-4)


# packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(8, 64))
def test_best_fit_decreasing(lengths, window):
    lengths = [min(n, window) for n in lengths]
    got = packing.best_fit_decreasing(lengths, window)
    rooms, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[i]
        else:
            rooms.append(window - lengths[i])
    assert sorted(i for w in got for i in w) == list(range(len(lengths)))
    assert sorted(window - sum(lengths[i] for i in w) for w in got) == sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_layout_covers_each_token_once(lengths):
    seen = [[0] * n for n in lengths]
    for pieces in packing.lay_out(lengths, 64, 1 / 16):
        size = sum(n for _, _, n in pieces)
        assert size <= 64 and (64 - size <= 4 or size & (size - 1) == 0)
        for d, start, n in pieces:
            for k in range(start, start + n):
                seen[d][k] += 1
    assert all(x == 1 for s in seen for x in s)


def test_packed_ids(spark):
    d, texts = documents(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = {k: [*tok.encode(t, add_special_tokens=False).ids, 2] for k, t in texts.items()}
    held, sequences = Counter(), {}
    for r in packing.pack_documents(d, path, block_tokens=20_000).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(array("I", part).tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        held[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert held == {k: len(v) for k, v in ids.items()}
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096


# tokens


TRICKY = ["a  b\n c\t d ", "x<|endoftext|> y <|endoftext|>z", "don't stop, it's 12ab3 été z!!", "  lead", " \n\n a b ", "naïve—dash “q” ½ ²x  nb", "a\x1cb \x85c", "日本語 テキスト", "é É Ç'S"]


@pytest.mark.parametrize("text", TRICKY)
def test_tokens_of_tricky_texts(spark, text):
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = token_counts.token_counts(d, byte, limit=2).first()
    want = len(Tokenizer.from_file(byte).encode(text, add_special_tokens=False).ids)
    assert (got["n_tokens"], got["n_bytes"], got["over_limit"]) == (want, len(text.encode()), want > 2)
    piece = packing.pack_documents(d, word).first()
    assert piece["doc_tokens"] == len(Tokenizer.from_file(word).encode(text, add_special_tokens=False).ids) + 1


def test_token_counts(spark):
    d, texts = documents(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for r in token_counts.token_counts(d, path).collect():
        assert r["n_tokens"] == len(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


# rules


def test_rules_are_named(spark):
    text = "###$$$ *** " * 30
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert not r["kept"] and {"symbols", "stop_words"} <= set(r["failed_rules"])


# classifiers


def test_languages_of_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.identify(d, keep=("lang", "n_chars")).select("*", "kept_row.*").where("held_out and lang is not null and n_chars > 200").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in r) / len(r) > 0.97
    assert sum(x["rejected"] for x in r) <= 0.02 * len(r)


def test_quality_of_held_out_texts(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality_pu.classify(d, lab).where("held_out").join(lab, "doc_id").collect()
    good, bad = ([x["quality_score"] for x in r if x["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_prior_without_negatives():
    rng = np.random.default_rng(0)
    p, bad = rng.normal(1.5, 1, (400, 3)).astype(np.float32), rng.normal(-1.5, 1, (300, 3)).astype(np.float32)
    u = np.vstack([rng.normal(1.5, 1, (300, 3)).astype(np.float32), bad])
    net = quality_pu.train_network(p, u, 0.5)
    assert (net.score(bad) < 0.5).mean() > 0.9 and (net.score(p) > 0.5).mean() > 0.9


# near-duplicates


def jaccard_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        m = min(k, len(w))
        sets[i] = frozenset(tuple(w[j : j + m]) for j in range(len(w) - m + 1)) if w else frozenset()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(sets)
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            x, y = sets[keys[a]], sets[keys[b]]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(keys[a]), find(keys[b])
                label[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_near_duplicates_of_a_cloud(spark):
    """Copies that are linked only through their middle, which isn't the least id, and texts that share a passage."""
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(5000)
    base = [word() for _ in range(160)]
    texts = {500: " ".join(base)}
    for k in range(150):
        w = base[:]
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        texts[k if k % 2 else 900 + k] = " ".join(w)
    passage = [word() for _ in range(60)]
    for k in range(100):
        texts[2000 + k] = " ".join(passage + [word() for _ in range(90)])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = jaccard_components(texts, 5, 80)
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(d).collect()} == want


def test_near_duplicates_of_a_family_without_a_middle(spark):
    """Pairs at 0.8 in one family whose other members are just below it: every bucket is large and no member joins others than its own twin."""
    rng = random.Random(12)
    texts = {}
    for k in range(320):
        w = ["c%d" % j for j in range(1599)] + ["p%d" % (k // 2)] + ["o%d-%d" % (k, j) for j in range(200)]
        rng.shuffle(w)
        texts[k] = " ".join(w)
    want = jaccard_components(texts, 1, 80)
    assert want == {k: k - k % 2 for k in texts}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(d, k=1).collect()} == want


def test_near_duplicates_of_documents_with_several_texts(spark):
    """Document 1 has two texts; the near copies of both are linked with it, through whichever text."""
    rng = random.Random(3)
    one, two = ([f"{x}{rng.randrange(500)}" for _ in range(80)] for x in "xy")
    rows_ = [(1, one), (1, two), (2, one[:78] + ["z"]), (3, two[:78] + ["z"]), (4, one), (5, ["alone"] * 9), (5, []), (1, [])]
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in rows_], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash_dedup.near_duplicates(d).collect())
    assert got == [(1, 1)] * 3 + [(2, 1), (3, 1), (4, 1), (5, 5), (5, 5)]


def test_near_duplicates_of_repeated_rows(spark):
    base = [f"w{k}" for k in range(60)]
    d = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[:58] + ["z"]))], "doc_id long, text string")
    d = d.crossJoin(spark.range(2000)).drop("id")
    got = Counter((r["doc_id"], r["component_id"]) for r in minhash_dedup.near_duplicates(d).collect())
    assert got == {(1, 1): 2000, (2, 1): 2000}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 9), min_size=1), st.integers(0, 3), st.integers(0, 1)), min_size=1, max_size=12))
def test_links_of_a_cell(rows_):
    sets, comp, block = ([r[k] for r in rows_] for k in range(3))
    n = np.array([len(s) for s in sets])
    flat, at = np.array([x for s in sets for x in sorted(s)], np.int64), np.cumsum([0, *n])
    links = minhash_dedup.links_of_cell(np.arange(len(sets)), np.array(comp), n, n, np.array(block), flat, at, 60)

    def joined(pairs):
        label = list(comp)
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

    two = len(set(block)) > 1
    want = [(a, b) for a in range(len(sets)) for b in range(a) if (block[a] != block[b] or not two) and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])]
    assert joined(links) == joined(want) and set(links) <= {(b, a) for a, b in want}


# decontamination


def found_items(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    return {r["doc_id"]: (r["n_hit"], r["items"], r["near_items"]) for r in decontamination.decontaminate(d, i, slop=2).collect()}


def test_proximity(spark):
    docs = [(1, "x alpha y beta z gamma w"), (2, "alpha " + "q " * 30 + "beta gamma"), (3, "gamma beta alpha")]
    assert found_items(spark, docs, [("i", "alpha beta gamma")]) == {1: (0, [], ["i"]), 2: (0, [], []), 3: (0, [], ["i"])}


def test_proximity_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 40)))) for k in range(40)]
    items = [(f"i{k}", " ".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(1, 6)))) for k in range(25)]
    got = found_items(spark, docs, items)
    for k, t in docs:
        w = t.split()
        near = [i for i, x in items if any(set(x.split()) <= set(w[a : a + len(x.split()) + 2]) for a in range(len(w)))]
        assert got[k][2] == sorted(near)


def test_items_that_share_an_id_or_a_text(spark):
    one, two = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(12))
    mixed = " ".join(one.split()[:5] + two.split()[5:10])
    items = [("i", one), ("i", two), ("j", " ".join(one.split()[:10])), ("k", two), (None, "lone words")]
    got = found_items(spark, [(1, one), (2, two), (3, " ".join(one.split()[:10])), (4, mixed), (5, "some lone words")], items)
    assert [got[k][:2] for k in range(1, 6)] == [(12, ["i", "j"]), (12, ["i", "k"]), (10, ["i", "j"]), (0, []), (2, [])]


def test_rows_of_one_document_are_apart(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delta"), (None, "alpha x gamma"), (None, "y beta")], "doc_id long, text string")
    i = spark.createDataFrame([("i", "alpha beta gamma delta")], "item_id string, text string")
    assert [r["n_hit"] for r in decontamination.decontaminate(d, i).collect()] == [0] * 4


# pages


def page(k, nav, body):
    return f"<html><head><title>t{k}</title></head><body><div><b>{nav}</b></div><div>own {k}</div><div><p>{body}</div></body></html>"


@pytest.mark.parametrize("bound", [10, 0])
def test_templates_are_removed(spark, bound):
    rows_ = [(k, f"http://h.example/{k}", page(k, "Site menu", f"Text number {k}")) for k in range(6)] + [(9, "http://other.example/", page(9, "Site menu", "Alone"))]
    d = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(d, broadcast_keys=bound).collect()}
    assert got[3] == "own 3\nText number 3" and got[9] == "Site menu\nown 9\nAlone"


@pytest.mark.parametrize("bound", [10, 0])
def test_templates_of_pages_with_one_title(spark, bound):
    """A host's pages of one title without h1, and of one title with one h1; and copies of one page among them."""
    for heading in ("", "<h1>Shop</h1>"):
        same = lambda k: page(k, "Site menu", f"Text number {k}").replace(f"<title>t{k}</title>", "<title>Shop</title>").replace("<body>", "<body>" + heading)
        rows_ = [(k, f"http://h.example/{k}", same(k)) for k in range(6)] + [(10 + k, f"http://h.example/copy{k}", same(3)) for k in range(6)]
        d = spark.createDataFrame(rows_, "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in html_extract.extract_text(d, broadcast_keys=bound).collect()}
        want = "Shop\n" * bool(heading) + "own 3\nText number 3"
        assert got[3] == got[12] == want


def test_copies_are_no_template(spark):
    rows_ = [(k, f"http://h.example/{k}", page(1, "Menu", "Same text")) for k in range(20)]
    d = spark.createDataFrame(rows_, "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract_text(d).collect()} == {"Menu\nown 1\nSame text"}


def test_templates_within_articles(spark):
    """A block that recurs in the articles of most pages of a host goes, a passage that some of them share stays."""
    article = lambda k: f"<title>t{k}</title><article><h1>H{k}</h1><div>Follow us</div><p>Own {k}</p>" + "<p>Shared passage</p>" * (k < 9) + "</article>"
    rows_ = [(k, f"http://h.example/{k}", article(k)) for k in range(20)] + [(k, f"http://small.example/{k}", article(k)) for k in range(30, 33)]
    d = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(d).collect()}
    assert got[3] == "H3\nOwn 3\nShared passage" and got[15] == "H15\nOwn 15" and got[30] == "H30\nFollow us\nOwn 30"


def test_subtree_counts_against_brute_force(spark):
    """Deletions of random pages, against counts over nested tuples."""
    rng = random.Random(11)
    blocks = [["div", f"menu {k}"] for k in range(20)]

    def tree(depth):
        return ["div", *(rng.choice(blocks) if rng.random() < 0.5 or not depth else tree(depth - 1) for _ in range(rng.randrange(1, 4)))]

    def write(x):
        return x if isinstance(x, str) else f"<{x[0]}>" + "".join(map(write, x[1:])) + f"</{x[0]}>"

    pages_ = {k: ["body", tree(2), ["p", f"own {k}"], tree(1)] for k in range(40)}
    host = {k: k % 4 for k in pages_}

    def subtrees(x):
        if not isinstance(x, str):
            if x[0] != "body":
                yield repr(x)
            for c in x[1:]:
                yield from subtrees(c)

    seen = Counter((host[k], s) for k, x in pages_.items() for s in set(subtrees(x)))

    def lines(k, x):
        if isinstance(x, str):
            return [x]
        if x[0] != "body" and seen[host[k], repr(x)] >= 4:
            return []
        return [y for c in x[1:] for y in lines(k, c)]

    d = spark.createDataFrame([(k, f"http://h{host[k]}.example/{k}", write(x)) for k, x in pages_.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(d).collect()}
    assert got == {k: "\n".join(lines(k, x)) for k, x in pages_.items()}
    assert len({t for t in got.values()}) == 40 and any("menu" in t for t in got.values()) and any("menu" not in t for t in got.values())


def test_depth_has_no_effect():
    for depth in (1, 210, 3000):
        source = "<div>" * depth + "<nav>Menu</nav><p>Body"
        assert html_extract.main_text("http://x.example", source, lambda k: False) == "Body"


def test_article_rules():
    source = """<body class="has-sidebar"><header>Top</header><nav>N</nav><div class="cookie-notice">C</div>
    <article><header><h1>Head</h1></header><p>One<br>two <i>three</i><p>Four<div class="ad">buy</div><form>f</form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>
    <section id="comments"><p>no</p></section><aside>s</aside><footer>F</footer><script>var x="</p>"</script></body>"""
    assert html_extract.main_text("http://x.example", source, lambda k: False) == "Head\nOne two three\nFour\na\nb\nc\nd"


# archives


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(warc.loser_tree_merge(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_merge_is_global(spark):
    d = spark.createDataFrame([(k, f"http://h{k % 7}.example/p{k % 3}", f"body {k % 11}") for k in range(300)], "page_id long, url string, html string").repartition(5)
    from loamgrid.sources.scratch import new_path

    path = new_path(spark, "warc-test")
    warc.write_archives(d, path, records_per_file=20)
    merged = warc.merge_runs(warc.read_archives(spark, path), range_rows=40).collect()
    keys = [(r["urlkey"], r["captured"], r["page_id"]) for r in merged]
    assert len(keys) == 300 and keys == sorted(keys) and len({r["archive"] for r in merged}) >= 15
    assert sum(r["record_type"] == "response" for r in merged) == 11


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    """40 MB of pages of mixed sizes at one file a task: small pages share archives up to the bound, a long one is alone."""
    from loamgrid.sources.scratch import new_path

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4 << 20)
    d = spark.range(60).selectExpr("id AS page_id", "concat('http://h.example/', id) AS url", "repeat(cast(id AS string), IF(id % 20 = 10, 2500000, 50000)) AS html").coalesce(1)
    path = new_path(spark, "warc-bytes")
    warc.write_archives(d, path)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    import gzip

    for f in files:
        got = list(warc.parse_archive(gzip.decompress(f["content"])))
        assert len(got) == 1 or sum(len(p) for *_, p in got) <= 4 << 20
    assert len(files) < 40 and warc.read_archives(spark, path).count() == 60


def test_rows_without_page_id_revisit(spark):
    d = spark.createDataFrame([(7, "same"), (None, "same"), (3, "same"), (None, "alone"), (None, "alone")], "page_id long, html string").selectExpr("page_id", "'http://x.example/' AS url", "html")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(d).collect())
    assert got == [(0, "response", None), (0, "response", None), (0, "revisit", 3), (3, "response", None), (7, "revisit", 3)]


def made_sites():
    """Pages of three hosts whose furniture changes its words from page to page; the article's blocks are known."""
    rng = np.random.default_rng(4)
    some = lambda n: " ".join(rng.choice(LOREM, n))
    pages, k = [], 0
    for host, n, marked in (("a.example", 12, True), ("b.example", 9, False), ("c.example", 2, True)):
        for _ in range(n):
            blocks = [f"Title {k}", *[some(int(rng.integers(5, 60))) for _ in range(int(rng.integers(3, 6)))]]
            links = "".join(f'<li><a href="/{i}">{some(1)}</a></li>' for i in range(int(rng.integers(3, 9))))
            body = f"<h1>{blocks[0]}</h1>" + "".join(f'<p class="lead">{b}</p>' if i == 0 else f"<p>{b}</p>" for i, b in enumerate(blocks[1:]))
            body = f"<article>{body}</article>" if marked else f'<div class="post-{k}">{body}</div>'
            notice = f'<div class="box"><b>{some(3)}</b> {some(4)}</div>' if marked else ""
            comments = "".join(f'<section class="reply"><p>{some(9)}</p></section>' for _ in range(int(rng.integers(1, 4)))) if host != "c.example" else ""
            source = f'<body><ul class="m{k % 10}">{links}</ul><div class="top ads">{some(6)}</div>{notice if host != "c.example" else ""}{body}{comments}<div id="foot{k}">{some(5)}<a href="x">{some(1)}</a></div></body>'
            pages.append((k, f"http://{host}/{k}", source, "\n".join(blocks)))
            k += 1
    return pages


@pytest.mark.parametrize("bound", [10**6, 0])
def test_shapes_of_furniture(spark, bound):
    """Menus, adverts, boxes, replies and footers never share a text; their shapes recur on the large hosts."""
    pages = made_sites()
    d = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(d, broadcast_keys=bound).collect()}
    assert got == {k: text for k, _, _, text in pages}


def test_shapes_decide_on_large_hosts(spark):
    """Without any rule the recurring shapes alone give the article; without the recurring shapes nothing is right."""
    pages = [p for p in made_sites() if "a.example" in p[1]]
    seen = {}
    for k, url, source, _ in pages:
        for key in html_extract.subtree_keys(url, source)[0]:
            seen.setdefault(key, set()).add(k)
    recurring = {key for key, on in seen.items() if len(on) >= html_extract.MIN_PAGES}
    no_rules = lambda *_: False
    for _, url, source, text in pages:
        assert html_extract.main_text(url, source, recurring.__contains__, True, no_rules) == text
        assert html_extract.main_text(url, source, lambda k: False, True, no_rules) != text


def test_articles_lose_nothing_to_words(spark):
    source = '<article><h1>T</h1><p>a</p><div class="search-notes">b</div><section id="related"><p>c</p></section><div class="ad">x</div><nav>y</nav></article><p class="search">z</p>'
    d = spark.createDataFrame([(1, "http://one.example", source)], "page_id long, url string, html string")
    assert html_extract.extract_text(d).first()["text"] == "T\na\nb\nc"


def test_pages_of_the_table(spark):
    """Against the article cut out by hand from pages whose blocks are known."""
    import html
    import re

    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(d).collect()}
    for r in d.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)
