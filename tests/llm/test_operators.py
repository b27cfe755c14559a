import hashlib
import html as html_lib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import components, embedding_join, exact_dedup, html_text, langid, near_join, packing, quality, queries, sentencepiece_codec, shared, toxicity, warc

ODD = [None, "", " ", "  a  b ", "a", "a b c d", "x\n\ny  z", "ünïcode ▁ mark", "日本語 テキスト", "🙂 emoji here", "<|endoftext|> x", "don't we'll  1234 \t!?\r\n", "word " * 30_000, "a"]


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    model = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs_of(spark, ODD, ids="clash"), model), model).collect()
    assert len(out) == len(ODD)
    for r in out:
        want = sp.encode(ODD[r.doc_id] or "")
        assert r.ids == want and r.text == sp.decode(want)
    assert sentencepiece_codec.encode(empty_docs(spark), model).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.ids for r in sentencepiece_codec.encode(twice, model).collect()] == [sp.encode("a b")] * 3


def test_decode_of_broken_bytes(spark):
    import sentencepiece

    model = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    lists = [[3 + 0xE2, 3 + 0x82], [0, 1, 2, 500], [3 + 0x20, 400], []]
    got = sentencepiece_codec.decode_ids(pa.array(lists, pa.list_(pa.int32())), model).to_pylist()
    assert got[0] == sp.decode(lists[0]) and got[2] == sp.decode(lists[2]) and got[3] == ""


def test_packing_is_the_library_and_gapless(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert tok.encode("<|endoftext|> x", add_special_tokens=False).ids[0] == 50256
    texts = [*ODD, *(c * 1_000_000 + "a" for c in " \t\n"), " \n" * 500_000, "a-b 'tis it's1 é#x <|endoftext|>y", "x " * 2000 + "<|endoftext|>"]
    pieces = packing.checksum(packing.pack(docs_of(spark, texts, offset="clash"), path)).toPandas()
    for i, t in enumerate(texts):
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for k, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist()
        assert own.length.sum() == 1024 or k == pieces.sequence_id.max()
    assert packing.pack(empty_docs(spark), path).count() == 0
    twice = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x"), (1, "three")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in packing.pack(twice, path).collect()) == [(0, 2), (1, 2), (1, 3), (1, 3)]


def test_packing_pieces_apart(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    random = np.random.default_rng(6)
    parts = ["a", "b", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", "é", "1", "23", "!", "\u3000", "中", "<|", "\x85", "\x1c", " the", "-", "ÿ"]
    texts = ["".join(random.choice(parts, random.integers(0, 12))) for _ in range(4000)]
    monkeypatch.setattr(packing, "KEPT", 50)
    packing.library(path).known.clear()
    for at in range(0, len(texts), 500):
        ids, ends = packing.tokenise(pa.array(texts[at : at + 500]), path)
        assert [ids[p:q].tolist() for p, q in zip(ends[:-1], ends[1:], strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in texts[at : at + 500]]


def test_packing_words_as_bytes(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok, lib, got = Tokenizer.from_file(path), packing.library(path), []
    monkeypatch.setattr(packing, "KEPT", 3)
    monkeypatch.setattr(lib, "encode", lambda texts, f=lib.encode: (got.extend(texts), f(texts))[1])
    lib.known.clear()
    letters = [chr(c) for c in range(33, 0x250) if chr(c).isalpha()]
    texts = ["the cat's the end, of x9 and\xaa", " ".join(letters), " ".join("é" + c + "Zß" for c in letters), "the end, the cat"]
    for text in texts:
        ids, ends = packing.tokenise(pa.array([text, "the"]), path)
        assert [ids[p:q].tolist() for p, q in zip(ends[:-1], ends[1:], strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in (text, "the")]
        assert len(lib.known["pieces"]) == len(lib.known["ids"]) <= 3
    # Only the separator and what isn't a word passes the library's pattern.
    passed = [w for line in got for w in line.split("\n")]
    assert not [w for w in passed if packing.WORD.fullmatch(w)] and "'s" in passed and " and\xaa" in passed
    lib.known.clear()
    monkeypatch.setattr(packing, "KEPT", 2)
    for some in (["a", "b"], ["a"], ["c"]):
        packing.ids_of(pa.array(some), lib)
    assert lib.known["pieces"].to_pylist() == ["a", "c"]
    lib.known.clear()


def test_exact_dedup_brute(spark):
    texts = [*ODD, "a\tb", "a b", "a \n b", None, "A b", *["hot copy"] * 500]
    import re

    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    # Texts in one block, texts of some copies in several, all texts in as many as they have rows.
    for cut in ({}, {"run_rows": 100, "most_blocks": 3}, {"run_rows": 1}):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs_of(spark, texts, norm="clash"), **cut).collect()}
        for t, i in ((t, i) for t, own in groups.items() for i in own):
            own = groups[t]
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(own), len(own), i == min(own), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty_docs(spark)).count() == 0
    twice = exact_dedup.exact_dedup(docs_of(spark, ["x"]).union(docs_of(spark, ["x"]))).collect()
    assert [r.group_size for r in twice] == [2, 2]
    null = exact_dedup.exact_dedup(spark.createDataFrame([(None, "x"), (3, "x")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept) for r in null} == {(None, False), (3, True)}


def test_exact_dedup_is_decided_by_neighbours(spark, monkeypatch):
    """Texts of one hash stay apart, and without the comparison all rows are alone."""
    docs = docs_of(spark, ["same lead of many characters, x", "same lead of many characters, y", "same lead of many characters, x"])
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    for cut in ({}, {"run_rows": 1}):
        assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs, **cut).collect()} == {0: 0, 1: 1, 2: 0}
    whole = exact_dedup.neighbour_runs
    monkeypatch.setattr(exact_dedup, "neighbour_runs", lambda rows, *a, **k: whole(rows, *a, **k).withColumns({"starts": F.lit(True), "run": F.monotonically_increasing_id()}))
    assert {r.group_size for r in exact_dedup.exact_dedup(docs).collect()} == {1}


def brute_jaccard(texts):
    sets = []
    for t in texts:
        w = [x for x in (y.strip(near_join.PUNCTUATION) for y in (t or "").lower().split()) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}


def test_near_join_brute(spark):
    random = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    texts = list(ODD)
    for _ in range(12):
        base = list(random.choice(words, 200))
        texts.append(" ".join(base))
        for k in (1, 2, 3, 6):
            other = list(base)
            for at in random.choice(200, k, replace=False):
                other[at] = "changed"
            texts.append(" ".join(other))
    hot = list(random.choice(words, 150))
    for i in range(620):  # more than a block of a bucket and of a family
        other = list(hot)
        other[i % 150] = f"z{i}"
        texts.append(" ".join(other))
    texts += [texts[20]] * 5
    got = {r.doc_id: r for r in near_join.similarity_join(docs_of(spark, texts, key="clash")).collect()}
    links = brute_jaccard(texts)
    degree, root = defaultdict(int), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        degree[i] += 1
        degree[j] += 1
        a, b = sorted((find(i), find(j)))
        root[b] = a
    least = defaultdict(lambda: len(texts))
    for i in range(len(texts)):
        least[find(i)] = min(least[find(i)], i)
    assert len(got) == len(texts)
    assert {i: got[i].n_links for i in got} == {i: degree[i] for i in got}
    assert {i: got[i].component_id for i in got} == {i: least[find(i)] for i in got}
    assert near_join.similarity_join(empty_docs(spark)).count() == 0


def test_prefix_depth_reaches_recall():
    d = near_join.prefix_depth(0.8, 16, 5, 0.9995)
    assert d == 4 and 1 - (1 - 0.8**d) ** 16 >= 0.9995 and near_join.prefix_depth(0.5, 4, 5, 0.999) == 1
    # Pairs that are nearly equal need no shorter prefix, pairs at the threshold do.
    assert near_join.recall_at({94: 50.0}, 96, 16, 6) > 0.99999 > near_join.recall_at({77: 50.0}, 96, 16, 6) and near_join.recall_at({}, 96, 16, 6) == 0


def test_forest_finds_links_near_the_threshold(spark, monkeypatch):
    random = np.random.default_rng(8)
    texts, want = [], 0
    for g in range(400):
        base = [f"g{g}w{i}" for i in range(184)]
        other = list(base)
        for at in random.choice(36, 4, replace=False):  # 4 of 180 shingles' middles: similarity 160 / 200
            other[5 * at + 2] = "changed"
        texts += [" ".join(base), " ".join(other)]
        want += len(brute_jaccard(texts[-2:]))
    lengths = []
    kept = near_join.forest
    monkeypatch.setattr(near_join, "forest", lambda t, d, p, *a: lengths.append(p) or kept(t, d, p, *a))
    docs = docs_of(spark, texts).select("doc_id", "text")
    found = near_join.similarity_join(docs).where("n_links > 0").count() / 2
    # A link is missed with probability 0.0002, so two of them hardly ever.
    assert want > 300 and found > want - 2 and lengths == [6, 5, 4]
    # Fewer and longer prefixes lose some: the links come out of the tries.
    few = near_join.similarity_join(docs, trees=2, recall=0.0).where("n_links > 0").count() / 2
    assert 0 < few < 0.9 * want
    # Near copies alone: shortening ends where they say that nothing is left.
    lengths.clear()
    near = [" ".join([f"g{g}w{i}" for i in range(600)] + ["end"] * k) for g in range(60) for k in (0, 1)]
    assert near_join.similarity_join(docs_of(spark, near)).where("n_links = 1").count() == 120 and lengths == [6]


def test_near_join_null_and_repeated_ids(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (1, a), (None, a), (2, f"{a} end"), (2, "other words that stand here alone"), (3, None), (4, ""), (None, None)]
    got = sorted(((r.doc_id, r.n_links, r.component_id) for r in near_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 0, None), (2, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 0, None)], key=str)



def test_embedding_join_brute(spark):
    random = np.random.default_rng(2)
    rows = []
    for i in range(400):
        base = random.normal(size=16)
        rows += [(2 * i, base.tolist(), i % 3), (2 * i + 1, (base + random.normal(size=16) * 0.03).tolist(), i % 3)]
    centre = random.normal(size=16)
    rows += [(1000 + i, (centre + random.normal(size=16) * 0.04).tolist(), 1) for i in range(300)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, rows[0][1], None), (2005, [1.0, 2.0], 1), (2006, rows[0][1], 0), (2007, rows[0][1], 0), (2008, [], 1), (2009, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit("clash")).repartition(3)
    got = {r.vec_id: r for r in embedding_join.near_duplicates(df, block=64).collect()}
    good = [(i, np.asarray(v), k) for i, v, k in rows if k is not None and v and not any(c is None for c in v) and np.isfinite(np.asarray(v, dtype=float)).all() and any(v)]
    degree, edges = defaultdict(int), []
    for n, (i, a, k) in enumerate(good):
        for j, b, m in good[:n]:
            if k == m and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                degree[i] += 1
                degree[j] += 1
                edges.append((i, j))
    label = {i: i for i, _, _ in rows}
    for _ in range(50):
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    assert {i: got[i].n_links for i in got} == {i: degree[i] for i, _, _ in rows}
    assert {i: got[i].component_id for i in got} == label and len(got) == len(rows)
    assert embedding_join.near_duplicates(df.limit(0)).count() == 0


def test_embedding_join_extremes(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1.0, 2.0], 1), (3, [1e-200, 2e-200], 1), (4, [2.0, -1.0], 1), (4, [2.0, -1.0], 1), (None, [1.0, 2.0], 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (4, 1, 4), (None, 0, None)], key=str)


def test_components_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 901)], "src long, dst long")
    got = {r.id: r.component for r in components.connected_components(edges).collect()}
    assert set(got.values()) == {0, 900} and len(got) == 203


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>t<body><header><a href=/>home</a></header><nav><ul><li>menu</ul></nav><div class="cookie-notice">We use &amp; cookies</div>
<article><h1>Head &amp; tail</h1><p>One <b>bold</b>ness &#233;&nbsp;x<br>two<p>Ok.<div class="ad">buy</div><form><input>mail</form><script>var x='</p>'</script><section class=comments><p>nice post</section></article>
<aside>side</aside><footer>&copy; foot</footer></html>"""
    assert html_text.extract_text(page) == "Head & tail One boldness é x two Ok."
    plain = "<html><body><div id=menu><a>a</a></div><div class=post><p>" + "Long text of the page. " * 9 + "</p><p>Yes.</p><p>" + "More text of the page. " * 9 + "</p></div><div class=footer>f</div></body></html>"
    assert html_text.extract_text(plain) == " ".join([*["Long text of the page."] * 9, "Yes.", *["More text of the page."] * 9])
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", page), (4, "w", "<nav>only</nav>"), (5, "x", "<p>" * 3000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got[1] == got[2] == got[4] == ("", 0) and got[3][1] == len(got[3][0]) and got[5][0] == "deep"


LONG = "Long text of the page, as people write it. " * 6


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><a>m</a></nav><div class=legal><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><footer>f</footer>", f"{LONG} Yes. {LONG}"),
        (f"<form id=f class=form><div id=menu><a>a</a><a>b</a></div><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG} {LONG}"),
        (f"<div class='side'><h1>A title</h1><p>{LONG}</p></div><div class=sidebar><p>short</p></div>", f"A title {LONG}"),
        (f"<main><h1>A title</h1><p>{LONG}</p><h3>You may also like</h3><ul>" + "<li><a href=x>Some story</a></li>" * 5 + "</ul></main>", f"A title {LONG}"),
        (f"<div><a>Home</a><a>News</a></div><p>{LONG}</p><p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<div><ul>{'<li><a>Home</a></li>' * 5}</ul></div><p>{LONG}</p><p>Ok.</p><p>{LONG}</p>", f"{LONG} Ok. {LONG}"),
        (f"<article><p>{LONG}</p><ul>{'<li><a>one</a></li>' * 4}</ul><p>{LONG}</p></article>", f"{LONG} {'one ' * 4} {LONG}"),
        (f"<![foo[ x ]]><p>{LONG}</p><![CDATA[ a ]]><p>Yes.</p>", f"{LONG} Yes."),
        ("<article><h1>Two words</h1></article>", "Two words"),
    ],
)
def test_html_ratios_decide(page, want):
    assert html_text.extract_text(f"<html><body>{page}</body></html>") == " ".join(want.split())


def test_html_without_ratios_differs():
    page = f"<div><ul>{'<li><a>Home</a></li>' * 5}</ul></div><p>{LONG}</p><p>{LONG}</p>"
    assert html_text.extract_text(page, threshold=0.0) != html_text.extract_text(page)


def test_html_smoothing_brute():
    random = np.random.default_rng(9)
    for n in (1, 3, 20):
        r = random.random(n) * 50
        weight = [np.exp(-(k**2) / (2 * 1.5**2)) for k in range(-html_text.RADIUS, html_text.RADIUS + 1)]
        want = [sum(w * r[i + k] for k, w in zip(range(-html_text.RADIUS, html_text.RADIUS + 1), weight, strict=True) if 0 <= i + k < n) / sum(weight) for i in range(n)]
        assert np.allclose(html_text.smoothed(r, 1.5), want)


def test_html_broken_markup(spark):
    random = np.random.default_rng(10)
    parts = ["<", "<!", "<![", "]]>", "<!--", "-->", "<p", "<p>", "</p>", "</", "<a href='", "'>", "&amp", "&#", "&#x110000;", "text", "<script>", "</script>", "<title>", "<![if", "[", "<?", "?>", "\x00", "<!ELEMENT x>", "<plaintext>", "<svg>"]
    for _ in range(3000):
        html_text.extract_text("".join(random.choice(parts, random.integers(1, 14))))
    rows = [(1, "u", "<p>a</p>")] * 2 + [(None, None, "<p>b</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(df).collect()) == [(0, "b"), (1, "a"), (1, "a")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_tables_articles(spark):
    """The tables' pages name their article: the method finds just its text, also where the name is taken away."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert html_text.extract_text(r.html) == " ".join(html_lib.unescape(re.sub(r"<[^>]+>", " ", article)).split())


def test_warc_round_trip(spark):
    big, bigger = "x" * 1500, "é\r\n\r\n" * 900
    twice = warc.read_archives(warc.write_archives(spark.createDataFrame([(1, "u", big), (1, "u", big), (2, "v", "y" * 9_000_000)], "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in twice) == [(1, "response", 1500), (1, "response", 1500), (2, "response", 9_000_000)]
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c d", "s"), (4, "u", "s"), (5, "u", None), (6, "u", bigger), (7, "u", big), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).repartition(3)
    index = warc.write_archives(df)
    got = {r.page_id: r for r in warc.read_archives(index).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if i} == {1: ("revisit", 7), 2: ("revisit", 7), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha1(raw).hexdigest()
        assert got[i].payload == (raw if got[i].record_type == "response" else None)
    some = warc.read_archives(index, F.col("page_id").isin(3, 6)).collect()
    assert sorted(r.page_id for r in some) == [3, 6]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def trained(spark, n=240):
    random = np.random.default_rng(3)
    speech = {"aa": "alo ama ari asa atu", "bb": "oko olu ony ore ost"}
    texts, langs, labels = [], [], []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        words = list(random.choice(speech[lang].split(), 40))
        toxic = i % 5 == 0
        if toxic:
            for at in random.choice(40, 4, replace=False):
                words[at] = "vile"
        junk = i % 3 == 0
        texts.append(" ".join(w + "%%%" if junk and w != "vile" else w for w in words))
        langs.append(lang)
        labels.append((i, int(not junk), int(toxic)))
    rows = [(i, t, g, "s", len(t)) for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    rows += [(n, None, None, None, None), (n + 1, "", "aa", "s", 0), (n + 2, "123 !!", None, "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (n + 9, None, None)], "doc_id long, quality int, toxic int")


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language(spark):
    docs, _ = trained(spark)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == 243 and all(got[i].held_out == is_held_out(i) for i in got)
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(240))
    assert [(got[i].lang_pred, got[i].score) for i in (240, 241, 242)] == [("und", 0.0)] * 3
    model = langid.train(docs)
    mixed = spark.createDataFrame([(1, "alo ama ari asa atu alo ama oko olu ony ore ost oko olu ony")], "doc_id long, text string")
    assert [(r.first_word, r.words, r.lang) for r in langid.spans(mixed, model).collect()] == [(0, 7, "aa"), (7, 8, "bb")]
    with pytest.raises(ValueError, match="lang_pred"):
        langid.predict(docs.withColumn("lang_pred", F.lit(1)), model)
    assert {r.lang_pred for r in langid.identify(docs.where("doc_id < 0").union(docs.where("doc_id = 240"))).collect()} == {"und"}


PROSE = {
    "en": "The meeting was held on Tuesday morning, and although several members could not attend, the committee agreed to publish its report before the end of the month.",
    "de": "Die Sitzung fand am Dienstagmorgen statt, und obwohl einige Mitglieder nicht teilnehmen konnten, beschloss der Ausschuss, seinen Bericht zu veröffentlichen.",
    "fr": "La réunion a eu lieu mardi matin et, bien que plusieurs membres n'aient pas pu y assister, le comité a décidé de publier son rapport avant la fin du mois.",
    "en2": "hello world this is a short text", "ok": "ok", "de2": "Straße schön", "en3": "A.\nAll rights reserved.", "code": "a1",
}


def test_every_letter_has_a_learned_language(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    texts = [*PROSE.values(), "日本語", "я помню чудное мгновенье", "ß", "x" * 5000, None, "", "123 ?!", "\n"]
    planted = spark.createDataFrame([(10**9 + i, t, None, "s", 0) for i, t in enumerate(texts)], docs.schema)
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(planted)).collect()}
    und = {texts[i - 10**9] for i, r in got.items() if r.lang_pred == "und"}
    assert und == {None, "", "123 ?!", "\n"} and all(0 <= r.score <= 1 for r in got.values())
    assert [got[10**9 + i].lang_pred for i in range(2)] == ["en", "de"]


def test_pipeline_without_labels_or_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    for t in ("documents", "labels"):
        queries.table(spark, "/root/testdata/sf0.001", t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    assert pipeline.quality_filter(spark, docs, str(tmp_path)).count() == docs.count()
    assert pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_rejects_what_was_not_learned(spark):
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    by = {}
    for r in docs.where("n_chars > 400").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text[:400])
    random = np.random.default_rng(1)
    noise = " ".join("".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(3, 9))) for _ in range(40))
    finnish = "vaka vanha väinämöinen itse tuon sanoiksi virkkoi näistäpä toki tulisi kalanluinen kanteloinen kun oisi osoajata soiton luisen laatijata kun ei toista tullutkana"
    polish = "litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność twą w całej ozdobie widzę i opisuję bo tęsknię po tobie"
    russian = "я помню чудное мгновенье передо мной явилась ты как мимолётное виденье как гений чистой красоты"
    bad = [noise, finnish, polish, russian, "日本語 テキスト", f"{by['en'][:40]} {russian}"]
    good = [*by.values(), " ".join(by.values()), f"{by['en']} 日本語 q7Xz9kQw2vB8nM4tJ6hF3gD5sR1pLzXcVbNm", *PROSE.values()]
    planted = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(bad + good)], docs.schema)
    kept = {r.doc_id for r in pipeline.language_id(spark, docs.unionByName(planted), d).collect()}
    assert len(by) == 4 and kept == {r.doc_id for r in docs.collect()} | {10**9 + i for i in range(len(bad), len(bad) + len(good))}


def test_viterbi_brute():
    random = np.random.default_rng(4)
    for n in (1, 2, 7):
        s = random.normal(size=(n, 3)) * 3
        best = max(np.ndindex(*[3] * n), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert langid.viterbi(s, np.asarray([0, n, n]), 2.0).tolist() == list(best)


def test_word_scores_brute():
    """Scores of a word against trigram counts taken one by one."""
    texts = pa.array(["alo ama", "oko, olu", "x1 alo"])
    _, codes, distinct = shared.distinct_words(texts)
    words = langid.analyse(distinct)
    plain = [w.lower().strip(langid.TRIM) for w in distinct.to_pylist()]
    assert words.letters.tolist() == [sum(c.isalpha() for c in w) for w in plain]
    assert np.diff(words.offsets).tolist() == [len(w) for w in plain]
    bins = {}
    for w, a, b in zip(plain, words.offsets[:-1], words.offsets[1:], strict=True):
        marked = f"\x01{w}\x02"
        for i, h in enumerate(words.bins[a:b].tolist()):
            assert bins.setdefault(marked[i : i + 3], h) == h
    random = np.random.default_rng(3)
    grams = random.integers(0, 9, (1 << langid.TRIGRAM_BITS, 2)).astype(float)
    scripts = np.full((len(langid.SCRIPT_NAMES), 2), 5.0)
    model = langid.model_of(["aa", "bb"], grams, scripts)
    every = (grams.sum(axis=1) + 0.5) / (grams.sum(axis=1) + 0.5).sum()
    for w, got in zip(plain, model.word_scores(words), strict=True):
        marked, want = f"\x01{w}\x02", np.zeros(2)
        for i in range(len(w)):
            h = bins[marked[i : i + 3]]
            p = np.log((grams[h] + 200 * every[h]) / (grams.sum(axis=0) + 200))
            want += p - p.mean()
        assert np.allclose(got, want * any(c.isalpha() for c in w), atol=1e-3)


def slow_tree(x, g, h, leaves, ridge):
    """Greedy splits of rows by one ordered bin, every cut tried."""
    parts = [np.arange(x.max() + 1)]
    gain = lambda bins: g[np.isin(x, bins)].sum() ** 2 / (h[np.isin(x, bins)].sum() + ridge)
    while len(parts) < leaves:
        options = [(gain(p[:c]) + gain(p[c:]) - gain(p), p[c], k, c) for k, p in enumerate(parts) for c in range(1, len(p))]
        if not options or max(options)[0] <= 1e-9:
            break
        _, _, k, c = max(options)
        parts[k : k + 1] = [parts[k][:c], parts[k][c:]]
    return {int(b): g[np.isin(x, p)].sum() / (h[np.isin(x, p)].sum() + ridge) for p in parts for b in p}


def test_booster_against_a_slow_one():
    random = np.random.default_rng(11)
    x = random.integers(0, 5, (120, 2)).astype(float)
    y = ((x[:, 0] > 2) ^ (random.random(120) < 0.1)).astype(float)
    model = quality.fit_additive(x, y, rounds=6, pair_rounds=0, pairs=0, bins=8)
    b = model.bins(x)
    tables = [dict.fromkeys(range(b[:, j].max() + 1), 0.0) for j in range(2)]
    margin = np.full(120, np.log((y.sum() + 0.5) / (121 - y.sum() - 0.5)))
    for _ in range(6):
        for j in range(2):
            p = 1 / (1 + np.exp(-margin))
            step = slow_tree(b[:, j], y - p, p * (1 - p), 3, 2.0)
            for k in tables[j]:
                tables[j][k] += 0.15 * step[k]
            margin += 0.15 * np.asarray([step[k] for k in b[:, j]])
    assert np.allclose(model.margin(b), margin)
    assert all(np.isclose(model.tables[j][k], v) for j in range(2) for k, v in tables[j].items())
    paired = quality.fit_additive(x, ((x[:, 0] > 2) ^ (x[:, 1] > 2)).astype(float), rounds=6, pairs=1)
    assert paired.pairs[0][:2] == (0, 1) and np.mean((paired.score(x) > 0.5) == ((x[:, 0] > 2) ^ (x[:, 1] > 2))) == 1


def test_scores_of_odd_rows(spark):
    """Repeated rows, null ids, very long texts, clashing names and empty tables of the three classifiers."""
    docs, labels = trained(spark)
    long = "alo vile ama " * 100_000
    odd = spark.createDataFrame([(7, "alo"), (7, "alo"), (None, "alo"), (900, long), (901, None), (902, "")], "doc_id long, text string").withColumns({c: F.lit(None).cast("string") if c == "lang" else F.lit("clash") for c in ("lang", "score", "y", "x", "predicted")})
    rows = docs.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang")).withColumns({"score": F.lit("clash"), "y": F.lit(1), "held_out": F.lit(2)})
    for got in (quality.classify(rows, labels), toxicity.classify(rows, labels), langid.identify(rows)):
        assert got.columns[:2] == ["doc_id", "held_out"]
        out = got.collect()
        by = {r.doc_id: r.score for r in out}
        assert len(out) == 243 + 6 and sum(r.doc_id == 7 for r in out) == 3 and all(0 <= r.score <= 1 for r in out)
        assert np.allclose([by[901], by[902]], by[240]) and not [r for r in out if r.doc_id is None][0].held_out
    for classify in (quality.classify, toxicity.classify):
        assert classify(docs.limit(0), labels).count() == 0
    assert langid.identify(docs.limit(0)).count() == 0


def test_document_scores_brute(spark):
    """A document's score from marginals that are enumerated path by path."""
    docs, labels = trained(spark)
    field = toxicity.train(docs, labels)
    text = "alo vile, ama ari vile"
    words = [w.lower().strip(toxicity.TRIM) for w in text.split()]
    e = field.emissions(toxicity.word_features(pa.array(words)))
    p, z = np.zeros(len(words)), 0.0
    for path in np.ndindex(*[2] * len(words)):
        w = np.exp(sum(e[i] * k for i, k in enumerate(path)) + sum(field.transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        z += w
        p += w * np.asarray(path)
    p /= z
    x = np.asarray([1, np.log1p(p.sum()), p.max(), np.log1p(len(words))])
    want = 1 / (1 + np.exp(-x @ field.document))
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).first().score
    assert np.isclose(got, want)


def test_quality(spark):
    docs, labels = trained(spark)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 243 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(240) if is_held_out(i)]
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in held]) > 0.95
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), labels).collect()}
    assert again == {i: r.score for i, r in got.items()}
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_toxicity(spark):
    docs, labels = trained(spark)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [i for i in range(240) if is_held_out(i)]
    assert np.mean([got[i].predicted == int(i % 5 == 0) for i in held]) > 0.95 and len(got) == 243
    field = toxicity.train(docs, labels)
    spans = toxicity.spans(spark.createDataFrame([(1, " alo vile, ama")], "doc_id long, text string"), field).collect()
    assert [(r.start, r.end, r.span) for r in spans] == [(5, 10, "vile,")]
    assert toxicity.classify(docs, labels.limit(0)).count() == 243


def test_held_out_labels_change_no_score(spark):
    docs, labels = trained(spark)
    other = labels.withColumns({c: F.when(shared.held_out(F.col("doc_id")), 1).otherwise(F.col(c)) for c in ("quality", "toxic")})
    assert quality.train(docs, labels).base == quality.train(docs, other).base
    one, two = ({r.doc_id: r.score for r in toxicity.classify(docs, x).collect()} for x in (labels, other))
    assert one == two


def test_forward_backward_brute():
    random = np.random.default_rng(5)
    e, t, n = random.normal(size=6), random.normal(size=(2, 2)), 6
    total = np.zeros(n)
    z = 0.0
    for p in np.ndindex(*[2] * n):
        w = np.exp(sum(e[i] * k for i, k in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)))
        z += w
        total += w * np.asarray(p)
    got, _, norm = toxicity.marginals(e[None], np.ones((1, n), bool), t)
    assert np.allclose(got[0], total / z) and np.isclose(norm, np.log(z))


def test_slices_cover_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, None, "y" * 500, "", "z"])], names=["text"])
    assert sum((s.column(0).to_pylist() for s in shared.slices(batch, most=100)), []) == batch.column(0).to_pylist()


def test_pipeline_against_brute_force(spark):
    """Each stage of run() on the smallest tables against its definition on what the stage before kept."""
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    at = docs
    kept = []
    for name, stage in pipeline.STAGES:
        out = shared.saved(stage(spark, at, d), name)
        if stage is not pipeline.pack_sequences:
            assert out.columns == docs.columns
            kept.append({r.doc_id: r.text for r in out.collect()})
        at = out
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept[0]) == {i for i, t in whole.items() if any(c.isalpha() for c in t)}
    labels = {r.doc_id: r.quality for r in queries.table(spark, d, "labels").collect()}
    assert np.mean([(i in kept[1]) == bool(labels[i]) for i in kept[0] if i in labels]) > 0.95
    import re

    first = {}
    for i in sorted(kept[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[1][i]), i)
    assert set(kept[2]) == set(first.values())
    order = sorted(kept[2])
    root = {i: i for i in order}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute_jaccard([kept[2][i] for i in order]):
        a, b = sorted((find(order[i]), find(order[j])))
        root[b] = a
    assert set(kept[3]) == {find(i) for i in order}
    pieces = at.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in pieces} == set(kept[3]) and all(r.n == r.m for r in pieces)
    assert pipeline.run(spark, d).count() == at.count()


def test_duplicates_by_row(spark):
    import corpus_pipeline as pipeline

    kept = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()), key=str)
    rows = [(3, "x"), (5, "x"), (5, "y"), (7, "z"), (7, "z"), (None, "y"), (None, "w"), (None, "w")]
    assert kept(pipeline.exact_duplicates, rows) == [(3, "x"), (5, "y"), (7, "z"), (None, "w")]
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, a), (5, f"{a} end"), (5, b), (None, f"{b} end"), (None, "c d e f g"), (9, "q")]
    assert kept(pipeline.near_duplicates, rows) == sorted([(3, a), (5, b), (9, "q"), (None, "c d e f g")], key=str)


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline as pipeline

    docs, _ = trained(spark)
    docs = docs.select("doc_id", "text", "lang").withColumns({c: F.lit(7) for c in ("lang_pred", "Lang_Score", "_lang_score", "id", "kept", "sha")})
    for stage in (pipeline.language_id, pipeline.exact_duplicates, pipeline.near_duplicates):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r["Lang_Score"] for r in out.collect()} == {7}
    assert shared.free_name(docs, "KEPT") == "_KEPT" and shared.free_name(docs, "lang_score") == "__lang_score"
    scored = quality.score(docs.withColumn("Score", F.lit(7)), quality.train(docs, trained(spark)[1]), out=shared.free_name(docs.withColumn("Score", F.lit(7)), "score"))
    assert scored.columns[-2:] == ["Score", "_score"] and scored.count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    key = lambda f: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f.itertuples(index=False))
    assert key(got) == key(want)
