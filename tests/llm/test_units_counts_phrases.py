"""Fill-in-middle, token counts and phrase collocations against brute force, the library and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import collocations, fill_in_middle, queries, shared, token_counts

ODD = [None, "", " ", "  a  b ", "a", "a b c d", "x\n\ny  z", "ünïcode ▁ mark", "日本語 テキスト", "🙂 emoji here", "has <P> in it", "<S>", "a<M>", "<", "<P", "word " * 30_000, "a", "\x01͸ȡ ͸͸", "\r\n\t \x0b"]


def docs_of(spark, texts, lang="en"):
    rows = [(i, t, lang, "clash", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, form string, n long").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 5, size).astype(np.uint8)
        matrix, at = fill_in_middle.WaveletMatrix(symbols), np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]
        ones = np.flatnonzero(np.isin(symbols, (1, 3)))
        k = np.arange(len(ones))
        assert matrix.locate((1, 3), k, np.zeros(len(k), np.int64), np.full(len(k), size)).tolist() == ones.tolist()


def units_of(text: str, unit: str) -> list[str]:
    """The units of a text, which spell it."""
    if unit == "char" or not text:
        return list(text)
    cut = [m.start() for m in re.finditer(r"(?<![^\t-\r ])[^\t-\r ]" if unit == "word" else r"(?<=\n)[\s\S]", text)]
    cut = sorted({0, *cut})
    return [text[a:b] for a, b in zip(cut, [*cut[1:], len(text)], strict=True)]


def fim_brute(doc_id, text, unit="char"):
    text = text or ""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = units_of(text, unit)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle_brute(spark, unit):
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choices(["a", "é", "日", "🙂", " ", "\n", "<", "P>", "<S", "."], k=rng.randint(0, 40))) for _ in range(300))]
    made = fill_in_middle.transform(docs_of(spark, texts), unit=unit)
    rows = made.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim_brute(r.doc_id, texts[r.doc_id], unit), texts[r.doc_id]
        assert r.back == (texts[r.doc_id] or "")


def test_fill_in_middle_odd_rows(spark):
    assert fill_in_middle.transform(empty(spark)).count() == 0
    rows = fill_in_middle.transform(spark.createDataFrame([(None, "abc"), (7, "abc def"), (7, "abc def")], "doc_id long, text string")).collect()
    assert [r.output for r in rows if r.doc_id is None] == ["abc"] and len({r.output for r in rows if r.doc_id == 7}) == 1 and len(rows) == 3


def library():
    import sentencepiece

    model = queries.tokenizer("piece_bpe_32k.model")
    return model, sentencepiece.SentencePieceProcessor(model_file=model)


def test_token_counts_are_the_librarys(spark):
    model, sp = library()
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "the", " of", "ing", "é", "日本", "🙂", "<s>", "▁", "1", "͸", "ȡ", "tion", "-", "."]
    texts = [*ODD, "a" * 5000, " " * 3000, "ab" * 2500, "the end. " * 900, *("".join(rng.choices(parts, k=rng.randint(0, 900))) for _ in range(60))]
    for chunk, overlap in ((token_counts.CHUNK, token_counts.OVERLAP), (64, 16), (40, 20)):
        got = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, texts), model, limit=100, chunk=chunk, overlap=overlap).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            n = len(sp.encode(t or ""))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100), (chunk, i)


def test_splices_are_decided_by_proven_boundaries(spark):
    """Most documents are spliced at the first widths; overlaps without a proven boundary give no count, never a wrong one."""
    model, sp = library()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 600").select(F.col("doc_id").alias("key"), "text")
    text = {r.key: r.text for r in docs.collect()}
    found = {r.key: r.n_tokens for r in token_counts.huge_counts(docs, model, 256, 64).collect()}
    right = [found[k] == len(sp.encode(t)) for k, t in text.items() if found[k] is not None]
    assert all(right) and len(right) > 0.9 * len(text)
    same = spark.createDataFrame([(1, "a" * 3000)], "key long, text string")
    n = token_counts.huge_counts(same, model, 128, 8).first().n_tokens
    assert n is None or n == len(sp.encode("a" * 3000))


def test_token_counts_odd_rows(spark):
    model, _ = library()
    assert token_counts.count_tokens(empty(spark), model).count() == 0
    rows = token_counts.count_tokens(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (1, 2), (1, 2), (2, 0)]
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty(spark), model, chunk=10, overlap=6)


def phrases_brute(docs, longest, least, top, replaced):
    """By language: rows as collocations() returns them, from counts of all phrases of all lengths."""
    out = []
    by = defaultdict(Counter)
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                by[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in by.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: v for p, v in f.items() if 2 <= len(p) and v >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= replaced * a for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


PHRASES = [
    (None, "en"), ("", "en"), ("New York is big. new york; NEW YORK city\tnew  york city", "en"), ("new york city, new york city", None),
    ("a a a a a a", "en"), ("a a", "und"), ("É é É é", "fr"), ("x\x0by z\x0cq", "fr"), ("日本 語 日本 語", "ja"), ("only. one, word! here? yes", "en"),
]


@pytest.mark.parametrize(("longest", "least", "top", "shipped"), [(3, 2, 2000, collocations.SHIPPED), (3, 2, 2000, 0), (4, 1, 2000, 0), (2, 2, 3, 5), (4, 2, 4, 3)])
def test_collocations_brute(spark, monkeypatch, longest, least, top, shipped):
    rng = random.Random(9)
    docs = [*PHRASES, *((" ".join(rng.choices(["the", "of", "Of", "a", "b", "c.", "d\n", ",", "e\t"], k=rng.randint(0, 25))), rng.choice(["en", "fr", None])) for _ in range(60))]
    df = spark.createDataFrame([(i, t, lang, "clash") for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, phrase string").repartition(3)
    monkeypatch.setattr(collocations, "ORDERED", 10)
    got = collocations.collocations(df, longest=longest, least=least, top=top, shipped=shipped).collect()
    assert sorted(map(tuple, got)) == phrases_brute(docs, longest, least, top, 50)


def test_collocations_odd_rows(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(docs_of(spark, [None, "", "one two"])).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(empty(spark), longest=1)


def test_scores_past_64_bits(spark):
    rows = [(10**12, 10**12, 10**12 + 1), (3, 7, 11), (10**13, 2 * 10**13, 3 * 10**13)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select(collocations.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r.s for r in df.collect()] == [1_000_000 * a * a // (left * r) for a, left, r in rows]


def test_numbered_is_gapless(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "v long")
    got = sorted((r.v, r.at) for r in shared.numbered(df, ["v"], "at").collect())
    assert [at for _, at in got] == list(range(300))
    assert shared.numbered(df.limit(0), ["v"], "at").count() == 0


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_collocations"])
def test_new_queries_match_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    key = lambda f: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f.itertuples(index=False))
    assert key(got) == key(want)


def test_words_of_slices():
    text = pa.array(["skip", "A b.c", "", " D\te ", "f", "g"])[1:]
    row, at, words = collocations.words_of(text)
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f", "g"] and row.tolist() == [0, 0, 0, 2, 2, 3, 4]
    assert (np.diff(at) == 1).tolist() == [True, False, False, True, False, False]
