"""Each operator against a plain version, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigrain.llm import (
    _bpe,
    _text,
    ball_tree,
    html_crf,
    kn_lm,
    line_dedup,
    minhash,
    multi_index,
    packing,
    quality,
    sp_codec,
    token_store,
)

from . import brute

DOCS = "doc_id long, text string, lang string, score double, n_lines string, key string, shard long, rank int"


def documents(rows):
    return [(i, t, "en", 0.5, "x", "k", 7, 1) for i, t in rows]


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.05:
            text = rnd.choice([None, "", " \n\t ", "one", "\n\n"])
        elif kind < 0.35 and rows:
            w = (rnd.choice(rows)[1] or "a b").split(" ")
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            text = " ".join(w)
        else:
            text = "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 25))).capitalize() for _ in range(rnd.randint(1, 5)))
        rows.append((i * 3, text))
    rows.append((n * 3 + 1, " ".join(rnd.choice(vocabulary) for _ in range(60_000))))
    rows.append((n * 3 + 2, "x" * 100_000))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(documents(rows), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_follow_words():
    texts = ["A b\x0bc", None, "", "a  B", "é\tÉ a", " "]
    found = {}
    for first, last, data, offsets in _text.chunks(pa.array(texts)):
        h, at = _text.word_hashes(data, offsets)
        for r in range(first, last):
            own = brute.words(texts[r])
            assert at[r - first + 1] - at[r - first] == len(own)
            for w, x in zip(own, h[at[r - first] : at[r - first + 1]].tolist(), strict=True):
                assert found.setdefault(w, x) == x
    assert len(set(found.values())) == len(found)


def thue_morse(n, a="a", b="b"):
    """Two unlike words of the letters a and b whose polynomial hashes modulo 2 ** 64 are equal."""
    x = [k.bit_count() & 1 for k in range(n)]
    return "".join(a if y else b for y in x), "".join(b if y else a for y in x)


def test_hashes_see_every_byte():
    texts = [w for n in (1024, 2048, 4096, 8192) for w in thue_morse(n)] + ["ab", "ab\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "x" * 1024, "x" * 1025, "abcdefgh" * 2, "abcdefgh" * 3]
    for texts in (texts, [" ".join(texts)]):
        data, offsets = _text.buffers(pa.array(texts))
        hashes, _ = _text.word_hashes(data, offsets)
        assert len(set(hashes.tolist())) == 17
    starts, sizes = np.array([0, 9, 18, 27, 0]), np.array([9, 9, 9, 9, 2000])
    runs = _text.Blocks(np.frombuffer(b"abcdefghi" * 2 + b"abcdefghiabcdefghj" * 2 + b"z" * 2000, np.uint8), starts, sizes)
    assert runs.unlike(np.array([1, 1, 3, 3, 4])).tolist() == [2]


def test_colliding_words_are_kept_apart(spark, monkeypatch):
    rows = [(2 * k + i, f"one two {w} three") for k, n in enumerate((1024, 4096, 8192)) for i, w in enumerate(thue_morse(n))]
    docs = spark.createDataFrame(documents(rows), DOCS)
    assert sorted(map(tuple, minhash.near_duplicates(docs, 2).collect())) == sorted(brute.components(rows, 2))
    got = sorted(map(tuple, kn_lm.score_documents(docs).collect()))
    for a, b in zip(got, sorted(brute.kneser_ney(rows)), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_with_equal_hashes_get_their_own_ids(name, monkeypatch):
    """With a hash that knows the length only, every piece of the same length collides."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(_bpe.vocabulary(name))
    texts = [[w for n in (1024, 2048, 4096, 8192) for w in thue_morse(n)], ["one two", "six ten", "one two abcdefghijkl abcdefghijkm", "two"], ["ten six", "abcdefghijkm"]]
    for hashes in (None, lambda self: self.sizes.astype(np.uint64)):
        if hashes:
            monkeypatch.setattr(_text.Blocks, "hashes", hashes)
        t = _bpe.PieceTokenizer(_bpe.vocabulary(name))
        for part in texts:
            for x, y in zip(part, t.encode(pa.array(part)), strict=True):
                assert y.tolist() == lib.encode(x, add_special_tokens=False).ids


# -- 1


def test_html_extraction(spark, monkeypatch):
    article = "<article><h1>Head &amp; more</h1><p>One  <b>two</b>\n three<p>Four &lt;x&gt;<br>five.</article>"
    page = f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><div class=ad>Buy now.</div>{article}<footer>&copy; me</footer>"
    pages = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<nav><a>only</a></nav>", "x"), (5, "u", "plain <", "x"), (1, "u", page, "x")]
    out = html_crf.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect())
    want = "Head & more One two three Four <x> five."
    assert [g for g in got if g[0] == 1] == [(1, want, len(want))] * 2
    assert (2, "", 0) in got and (3, "", 0) in got and (0, "", 0) in got and len(got) == 6
    assert html_crf.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    "head",
    [
        "<head><script>for(i=0;i<n;i++){f(i)}</script></head><body>",
        "<head><SCRIPT>if(a<b)f('x')</SCRIPT ></head><body><script>g()</script>",
        "<head><script><!-- unclosed </script></head><body>",
        "<head><script><!--> f() <script </script></head><body>",
        "<head><script><!-- w('<script>f()</script>') --></script></head><body>",
        "<head><script>s='</scripts>'+'<p>no</p>'</script></head><body>",
        "<head><title>a <b or c</title></head><body>",
        "<head><style>a:before{content:'<x'}</style></head><body>",
        "<head><title>T</title>",
        "<head><meta charset=utf-8><link rel=x><noscript><style>p{}</style></noscript>",
    ],
)
def test_html_raw_text_and_open_heads(head):
    page = f"<html>{head}<article><h1>One two</h1><p>Three four.</p></article><script>h()</script></html>"
    assert [b.text for b in html_crf.blocks(page)] == ["One two", "Three four."]


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000, "<a " * 300_000 + ">", "<div>x " * 60_000, "<div>x " * 60_000 + "</b>" * 60_000, "<b>" * 60_000 + "<div>x</div>" * 30_000, '<a t=">"' * 200_000, '<a t="x ' * 200_001, "<script><!--" * 100_000, "&#" + "9" * 20_000 + ";", "".join(f"<div class=k{i}>x" for i in range(50_000))],
    ids=range(10),
)
def test_html_long_and_deep_pages_take_seconds(page):
    import time

    began = time.perf_counter()
    html_crf.main_text(page, html_crf.model())
    assert time.perf_counter() - began < 20


def test_html_tags_and_references():
    def texts(page):
        return [b.text for b in html_crf.blocks(page)]

    assert texts("<p title='a>b'>one</p><p title=a\">two</p><!-->three<!--->four") == ["one", "two", "threefour"]
    assert texts('<p title="a>one</p><p>two</p>') == ["one", "two"]  # a quote that is never closed
    assert texts("<p>a &#0065; &#x41; &amp; &lt;b&gt; &#99999999999999999999; &#" + "0" * 5000 + "66;") == ["a A A & <b> \ufffd B"]
    assert texts("</ x>one<!doctype>two<?x?></>three <") == ["onetwothree <"]
    assert texts("<p>one <b") == ["one"]


def test_html_weights_are_summed_as_features_are():
    chain = html_crf.model()
    for page, _ in html_crf.labelled_pages(40, seed=5):
        plain, summed = html_crf.blocks(page), html_crf.blocks(page, chain.weights)
        assert [b.text for b in plain] == [b.text for b in summed]
        if plain:
            want = chain.emissions([b.features for b in plain])
            assert np.allclose(want, [b.sums for b in summed])


def test_html_text_ends_a_head():
    assert [b.text for b in html_crf.blocks("<head> <title>T</title>\nPlain words<p>and more")] == ["Plain words", "and more"]
    assert [b.text for b in html_crf.blocks("<p>Before<script>if(a<b)f()")] == ["Before"]


def test_crf_on_fresh_pages_and_viterbi():
    chain, right, total = html_crf.model(), 0, 0
    for page, labels in html_crf.labelled_pages(60, seed=123):
        found = html_crf._features(html_crf.blocks(page))
        if found:
            got = chain.decode(found)
            right += sum(int(a == b) for a, b in zip(got, labels, strict=True))
            total += len(labels)
            if len(found) <= 9:  # all labellings
                e = chain.emissions(found)
                def worth(y, e=e):
                    return sum(e[k, v] for k, v in enumerate(y)) + sum(chain.t[a, b] for a, b in zip(y[:-1], y[1:], strict=True))
                best = max(worth([(m >> k) & 1 for k in range(len(found))]) for m in range(1 << len(found)))
                assert abs(worth(got) - best) < 1e-9
    assert right / total > 0.98


# -- 2


def test_kneser_ney(docs, rows, empty):
    got = sorted(map(tuple, kn_lm.score_documents(docs).collect()))
    for a, b in zip(got, sorted(brute.kneser_ney(rows)), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert kn_lm.score_documents(empty).collect() == []


def test_kneser_ney_odd_rows(spark):
    """Rows that come twice are learned twice; a null id is in no fold."""
    base = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c c a", "a b", None, ""] * 4)]
    twice = [*base, *base]
    got = {tuple(r) for r in kn_lm.score_documents(spark.createDataFrame(documents([*twice, (None, "a b q")]), DOCS)).collect() if r.doc_id is not None}
    import evigrain.llm.kn_lm as module

    held = [r for r in module.score_documents(spark.createDataFrame(documents([*twice, (None, "a b q")]), DOCS)).collect() if r.doc_id is None]
    assert len(held) == 1 and held[0].held_out is None and held[0].n_tokens == 4 and held[0].n_known == 3
    want = {r[0]: r for r in brute.kneser_ney(twice, repeated=True)}
    assert len(got) == len(base)
    for r in got:
        assert r[:5] == want[r[0]][:5] and r[5:] == pytest.approx(want[r[0]][5:], rel=1e-9)


def test_kneser_ney_sums_to_one(spark):
    """Over all known words, the end and one unknown word, after any word."""
    texts = ["a b a c", "b a", "c c c a", "a"]
    model = kn_lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    kinds = ["a", "b", "c", "zzz"]
    for before in ("a", "b", "q"):
        p = 0.0
        for w in kinds:
            _, _, stream, ends = next(kn_lm._stream(pa.array([f"{before} {w}"])))
            p += 10 ** model.score(stream, ends)[2][1]
        _, _, stream, ends = next(kn_lm._stream(pa.array([before])))
        p += 10 ** model.score(stream, ends)[2][1]
        assert p == pytest.approx(1)


def test_kneser_ney_frequent_words_are_dealt_out(docs, rows, monkeypatch):
    monkeypatch.setattr(kn_lm, "SHARD_BIGRAMS", 1 << 12)
    monkeypatch.setattr(kn_lm, "FLUSH_TOKENS", 5000)
    got = sorted(map(tuple, kn_lm.score_documents(docs).collect()))
    assert [r[6] for r in got] == pytest.approx([r[6] for r in sorted(brute.kneser_ney(rows))])


# -- 3


def brute_lines(rows, least=10):
    ws = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(ws))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark, docs, rows, empty):
    more = rows + [(900, "  The same LINE here\nshort\nthe same line HERE\nown line number one"), (901, "x\nthe same line here\nshort"), (902, "éééééééééé\n"), (903, "\tÉééééééééé\x0b\néééééééééé"), (901, "x\nthe same line here\nshort")]
    out = line_dedup.dedup_lines(spark.createDataFrame(documents(more), DOCS)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted(map(tuple, out.collect())) == brute_lines(more)
    assert line_dedup.dedup_lines(empty).collect() == []
    below = [(-5, "a long enough line\nx"), (-3, "a long enough line\ny"), (-1, "a long enough line"), (0, "a long enough line\nz"), (-7, "another line of text"), (4, "another line of text")]
    out = line_dedup.dedup_lines(spark.createDataFrame(documents(below), DOCS)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted(map(tuple, out.collect())) == brute_lines(below)
    nulls = line_dedup.dedup_lines(spark.createDataFrame(documents([(None, "a line of text\nb"), (None, "a line of text"), (5, "a line of text")]), DOCS))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in nulls.collect()) == [(0, 1), (0, 1), (5, 0)]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 20_000, dtype=np.uint64))
    a = line_dedup.PerfectHash.build(keys)
    assert sorted(line_dedup.PerfectHash.find(a, keys).tolist()) == list(range(len(keys)))
    for few in (keys[:0], keys[:1]):
        a = line_dedup.PerfectHash.build(few)
        assert line_dedup.PerfectHash.find(a, few).tolist() == list(range(len(few)))


# -- 4


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(spark, docs, rows, empty, width):
    got = sorted(map(tuple, minhash.near_duplicates(docs, width).collect()))
    assert got == sorted(brute.components(rows, width))
    assert minhash.near_duplicates(empty, width).collect() == []


def test_minhash_chains_and_copies(spark):
    """Neighbours in a chain are alike, its ends aren't; many exact and near copies; repeated rows, null ids."""
    w = [f"w{k}" for k in range(400)]
    chain = [(1000 - k, " ".join(w[k * 15 : k * 15 + 200])) for k in range(12)]
    base = [f"v{k}" for k in range(100)]
    near = [(2000 + k, " ".join([*base[:k], "zz", *base[k + 1 :]])) for k in range(100)]
    same = [(3000 + k, " ".join(base)) for k in range(200)]
    rows = chain + near + same
    got = minhash.near_duplicates(spark.createDataFrame(documents([*rows, rows[0], (None, "w1 w2"), (None, None)]), DOCS), 2)
    got = sorted(map(tuple, got.where("doc_id is not null").distinct().collect()))
    assert got == sorted(brute.components(rows, 2))
    assert len({r[2] for r in got}) == 2


def test_minhash_of_a_shared_template(spark, monkeypatch):
    """Many texts share most of a template and no two are alike, but for a few pairs that differ from every centre."""
    monkeypatch.setattr(minhash, "GROUP", 5)
    rnd = random.Random(6)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for i in range(120):
        own = [f"o{i}x{k}" for k in range(50)]
        rows.append((i, " ".join(base + own)))
        if i % 10 == 0:
            for c in range(3):
                own[rnd.randrange(50)] = f"c{i}x{c}"
                rows.append((1000 + 10 * i + c, " ".join(base + own)))
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(documents(rows), DOCS), 2).collect()))
    want = sorted(brute.components(rows, 2))
    assert got == want and len({r[2] for r in want}) == 120


def test_minhash_hot_keys(spark, monkeypatch):
    """Many equal texts, many empty ones and a text with many that differ a little from it: the same rows, dealt out."""
    monkeypatch.setattr(minhash, "GROUP", 5)
    base = [f"w{i}" for i in range(40)]
    near = [" ".join([*base[: k + 1], "x", *base[k + 1 :]]) for k in range(38)]
    rows = [*["a copy of one page"] * 300, *["", None, "  "] * 100, " ".join(base), *near]
    rows = [(k + 1, x) for k, x in enumerate(rows)]
    docs = spark.createDataFrame([(None, "a copy of one page"), *rows], "doc_id long, text string")
    got = minhash.near_duplicates(docs, 2).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(brute.components(rows, 2))
    assert [tuple(r)[1:] for r in got if r.doc_id is None] == [(4, None, True)]
    # a key of more rows than its share is in no shuffled side
    links = spark.createDataFrame([(1, k) for k in range(2, 60)] + [(k, k + 1) for k in range(100, 120)], "u long, v long")
    one = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    dealt = minhash._joined(links, one, ["u"], 5)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, links.join(one.drop("k"), "u").collect()))


def test_minhash_components_take_few_exchanges(spark, monkeypatch):
    # a hub of many links, a chain, a pair; the driver keeps threads and tasks of every exchange
    monkeypatch.setattr(minhash, "ARRAY_LINKS", 10)
    pairs = [*((-7, i) for i in range(100, 160)), *((i, i + 1) for i in range(20)), (900, 901), (901, 900), (901, 901)]
    from evigrain.llm import _store

    plans, table = [], _store.Store.table
    monkeypatch.setattr(_store.Store, "table", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(self, df, name))
    store = _store.Store(spark, "test")
    got = minhash.components(spark.createDataFrame(pairs, "a long, b long").repartition(3), store, "roots").collect()
    assert sorted(map(tuple, got)) == sorted([(-7, -7), *((i, -7) for i in range(100, 160)), *((i, 0) for i in range(21)), (900, 900), (901, 900)])
    assert plans and all("Join" not in p and p.count("Exchange") <= 2 for p in plans)  # the first has the repartition of this test
    assert minhash.components(spark.createDataFrame([(5, 5)], "a long, b long"), store, "none").collect() == []


def test_minhash_prefixes_part_no_pair_that_is_alike(spark, docs, rows):
    """The filter alone, over all documents as components of their own, against all pairs."""
    from evigrain.llm import _store

    store = _store.Store(spark, "test")
    profiles = store.table(minhash._profiles(docs.select("doc_id", "text"), 2), "profiles").where("n > 0").withColumnRenamed("doc_id", "id")
    sets = store.table(minhash._sets(docs.select("doc_id", "text"), 2, minhash._wanted(profiles.select("id"), store, "wanted")), "sets")
    bits = profiles.select("id", "n", *[F.col("bits")[i].alias(f"w{i}") for i in range(minhash.BITMAP_WORDS)])
    pairs = minhash._missed(profiles.select(F.lit(0).alias("key"), "id", F.col("id").alias("root"), "n"), sets, bits, store, 80)
    found = {tuple(r) for r in minhash._confirm(pairs, sets, 80).collect()}
    own = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or {tuple(w)} for i, w in ((i, brute.words(t)) for i, t in rows) if w}
    want = {(a, b) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])}
    assert found == want and want
    live = {r.id for r in minhash._partnered(profiles.select("id", F.col("id").alias("root"), "n"), sets, _store.Store(spark, "test"), 80).collect()}
    assert {i for p in want for i in p} <= live and len(live) < len(own)
    store.remove()


def test_minhash_one_id_with_other_texts(spark):
    w = [f"w{k}" for k in range(60)]
    rows = [(5, " ".join(w)), (9, " ".join(w[:58])), (5, "quite other words here"), (7, "quite other words here"), (11, "alone"), (5, "alone")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(documents(rows), DOCS), 2).collect()}
    assert got == {(5, 59): (5, True), (9, 57): (5, False), (5, 3): (5, True), (7, 3): (5, False), (11, 1): (5, False), (5, 1): (5, True)}


# -- 5


def test_token_store(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = _bpe.vocabulary("byte_bpe_50k.json")
    t, start, want = Tokenizer.from_file(path), 0, []
    for i, x in sorted(rows):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for size in (1 << 24, 4096):
        assert sorted(map(tuple, token_store.token_store(docs, path, shard_bytes=size).collect())) == want
    assert token_store.token_store(empty, path).collect() == []
    odd = token_store.token_store(spark.createDataFrame(documents([(None, "a"), (-5, "b"), (None, None), (2, "c"), (2, "c")]), DOCS), path).collect()
    assert [r.doc_id for r in sorted(odd, key=lambda r: r.start)] == [None, None, -5, 2, 2]
    # one id, and null ids, over several shards
    many = spark.createDataFrame(documents([(i, f"text {k} " * 30) for k in range(300) for i in (None, 7)] + [(1, "a"), (9, "b")]), DOCS)
    got = sorted(token_store.token_store(many, path, shard_bytes=4096).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [1] + [7] * 300 + [9]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_elias_fano():
    rnd = np.random.default_rng(2)
    for values in (np.zeros(1), np.cumsum(rnd.integers(0, 5000, 3000)), np.cumsum(rnd.integers(0, 2, 1000)), np.array([0, 2**40])):
        values = values.astype(np.int64)
        e = token_store.EliasFano(token_store.EliasFano.encode(values, "x"), "x")
        assert e.slice(0, len(values)).tolist() == values.tolist()
        for i in {0, len(values) // 2, len(values) - 1}:
            assert e.select(i) == values[i]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(name):
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    signs = "ab Z1.'\n\t\x0b\x0c\r\x1c\x1f \x85\xa0 　​᠎\x00éÉ́Σσçßİ½²中😀's|<>_"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [None, "", "a<|endoftext|>b", "don't it's we'LL", "x" * 5000]
    t = _bpe.PieceTokenizer(_bpe.vocabulary(name))
    lib = Tokenizer.from_file(_bpe.vocabulary(name))
    for x, y in zip(texts, t.encode(pa.array(texts)), strict=True):
        assert y.tolist() == lib.encode(x or "", add_special_tokens=False).ids, repr(x)


# -- 6


def test_sentencepiece(spark, docs, rows, empty):
    import sentencepiece

    path = _bpe.vocabulary("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sp_codec.load(path)
    rnd = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日", "😀", "<s>", "<0x0A>", "▁", "23", "...", "://", " " * 17, "\r\n", "_"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(3000)]
    for x in texts:
        ids = np.frombuffer(own.encode(x), own.dtype)
        assert ids.tolist() == library.encode(x), repr(x)
        assert own.decode(ids) == library.decode(ids.tolist())
    got = {r.doc_id: r for r in sp_codec.round_trip(docs, path).collect()}
    for i, x in rows:
        ids = library.encode(x or "")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    assert sp_codec.round_trip(empty, path).collect() == []
    odd = sp_codec.round_trip(spark.createDataFrame(documents([(None, "a b"), (None, None), (3, "a b"), (3, "a b")]), DOCS), path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in odd) == sorted((i, len(library.encode(x))) for i, x in ((0, "a b"), (0, ""), (3, "a b"), (3, "a b")))


def test_unigram_viterbi():
    """A small unigram model against all segmentations."""
    import struct

    def message(fields):
        out = b""
        for f, v in fields:
            if isinstance(v, bytes):
                out += bytes([f << 3 | 2, len(v)]) + v
            elif isinstance(v, float):
                out += bytes([f << 3 | 5]) + struct.pack("<f", v)
            else:
                out += bytes([f << 3, v])
        return out

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.5, 1), ("▁a", -4.25, 1), ("ba", -3.75, 1), ("bab", -5.125, 1)]
    raw = message([(1, message([(1, p.encode()), (2, s), (3, t)])) for p, s, t in pieces] + [(2, message([(3, 1)])), (3, message([(3, 1), (4, 0)]))])
    m = sp_codec.Model(raw)
    score = {p: s for p, s, t in pieces if t == 1}

    def best(s):
        return 0.0 if not s else max(score[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in score)

    rnd = random.Random(4)
    for _ in range(200):
        x = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 9)))
        ids = np.frombuffer(m.encode(x), m.dtype).tolist()
        assert "".join(m.pieces[i] for i in ids) == "▁" + x.replace(" ", "▁")
        segment = "▁" + x.replace(" ", "▁")
        assert sum(m.scores[i] for i in ids) == pytest.approx(best(segment))


# -- 7 and 8

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score double"


def vectors(n=700, size=16, seed=5):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, size))
    x[100:300] = x[100]  # a large group of copies
    rows = [(int(i), [float(v) for v in row], 0, 1, 0.0) for i, row in enumerate(x.astype(np.float32))]
    odd = [(5000, None), (5050, [0.0] * size), (5100, [None, *[1.0] * (size - 1)]), (5150, [float("nan"), *[1.0] * (size - 1)]), (5200, [float("inf"), *[1.0] * (size - 1)]), (5250, []), (None, [1.0] * size)]
    return rows + [(i, v, 0, 1, 0.0) for i, v in odd] + [rows[7]]


def test_multi_index(spark):
    rows = vectors()
    out = multi_index.nearest(spark.createDataFrame(rows, VECTORS)).collect()
    x = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and i < 5000]
    hits = total = 0
    for q, v in x:
        if q % 50 == 0:
            def cosine(w, v=v):
                return float((w * v).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum())))
            want = sorted(((-cosine(w), i) for i, w in x if i != q))[:5]
            got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
            assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
            assert all(s == pytest.approx(cosine(dict(x)[i]), abs=1e-12) for _, i, s in got)
            hits += len({i for _, i, _ in got} & {i for _, i in want})
            total += 5
    assert len(out) == total and hits / total >= 0.9
    whole = multi_index.nearest(spark.createDataFrame(rows, VECTORS), share=1.0).where("query_id = 150").orderBy("rank").collect()
    assert [r.vec_id for r in whole] == [100, 101, 102, 103, 104]  # ties to the smaller id
    assert multi_index.nearest(spark.createDataFrame(rows[:3], VECTORS)).count() == 2
    assert multi_index.nearest(spark.createDataFrame([], VECTORS)).collect() == []


def test_walk_is_in_order():
    rnd = np.random.default_rng(3)
    a, b = rnd.random(7), rnd.random(5)
    walked = list(multi_index.walk(a, b))
    sums = [d for d, _, _ in walked]
    assert len({(i, j) for _, i, j in walked}) == 35 and sums == sorted(sums)
    assert all(d == a[i] + b[j] for d, i, j in walked)


def test_multi_index_leaves_most_of_a_clustered_table_unread(spark):
    rnd = np.random.default_rng(8)
    n, size = 50_000, 32
    centres = rnd.normal(size=(400, size))
    x = (centres[rnd.integers(0, 400, n)] + 0.25 * rnd.normal(size=(n, size))).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))
    out = multi_index.nearest(rows, every=500).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 500):
        s = u @ u[q]
        s[q] = -2
        hits += len({r.vec_id for r in out if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert hits / (n / 500 * 5) >= 0.9
    read = [r.reranked for r in out if r.rank == 1]
    assert len(read) == n / 500 and np.mean(read) < 0.1 * n and max(read) < 0.5 * n


def test_ball_tree_cuts_branches(tmp_path):
    from evigrain.llm import _store

    rnd = np.random.default_rng(9)
    x = np.floor(256 * (np.repeat(rnd.normal(size=(40, 16)), 200, axis=0) + 0.05 * rnd.normal(size=(8000, 16)))).astype(np.int64)
    files = []
    for s in range(2):
        tree = ball_tree.build(x[s::2], np.arange(s, 8000, 2))
        files.append((_store.write_arrays(f"file://{tmp_path}", f"t{s}", tree), tree["centre"][:16], float(tree["radius"][0])))
    queries = np.arange(0, 8000, 250)
    found, work = ball_tree.search_shards(queries, x[queries], files, 5)
    for q, ids, scores in found:
        s = x @ x[q]
        s[q] = -(2**62)
        want = np.lexsort((np.arange(8000), -s))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
    assert work < 0.5 * len(queries) * len(x)


def test_ball_tree_refuses_to_overflow(spark):
    rows = [(i, [2.0**40, 1.0], 0, 1, 0.0) for i in range(3)]
    with pytest.raises(Exception, match="64 bits"):
        ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank int, score double")).collect()


def test_ball_tree(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 200)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 16)
    rows = vectors()
    out = ball_tree.top_k(spark.createDataFrame(rows, VECTORS)).collect()
    x = [(i, [int(np.floor(256 * c)) for c in v]) for i, v, *_ in rows if i is not None and (i < 5000 or i == 5050)]
    want = []
    for q, v in x:
        if q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in x if i != q)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    assert sorted(map(tuple, out)) == sorted(want)
    assert ball_tree.top_k(spark.createDataFrame(rows[:2], VECTORS)).count() == 1
    assert ball_tree.top_k(spark.createDataFrame([], VECTORS)).collect() == []


# -- 9


def check_packing(out, want, size):
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    room = {}
    for r in out:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(room)


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = _bpe.vocabulary("word_bpe_49k.json")
    t, want = Tokenizer.from_file(path), []
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    used = check_packing(packing.pack(docs, path).collect(), want, 2048)
    assert used <= 1 + -(-sum(w[3] for w in want) // 2048) * 1.02
    assert packing.pack(empty, path).collect() == []
    odd = packing.pack(spark.createDataFrame(documents([(None, None), (None, "a"), (3, "b"), (3, "b")]), DOCS), path).collect()
    assert len(odd) == 4 and {r.sequence_id for r in odd} == {0} and sorted(r.offset for r in odd)[0] == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rnd = random.Random(seed)
    size = rnd.choice([2048, 100, 7])
    histogram = {rnd.randint(1, size): rnd.choice([1, 3, 50, 10_000]) for _ in range(rnd.choice([1, 5, 200]))}
    plan = packing.Plan(size, histogram)
    fill, taken = {}, {}
    for length, first, count, sequence, offset in plan.runs:
        assert taken.get(length, 0) == first
        taken[length] = first + count
        for k in range(count):
            fill.setdefault(sequence + k, []).append((offset, length))
    assert taken == histogram and len(fill) == plan.sequences
    for parts in fill.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= size


def test_nnls():
    rnd = np.random.default_rng(1)
    a, x = rnd.random((20, 8)), np.array([0, 1, 0, 2, 3, 0, 0, 0.5])
    assert packing.nnls(a, a @ x) == pytest.approx(x, abs=1e-6)


# -- 10


def test_quality(spark, empty):
    import duckdb

    sf = "/root/testdata/sf0.01"
    out = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df()
    both = out.merge(labels, on="doc_id")
    apart = both[both.held_out]
    assert out.held_out.tolist() == [brute.fold(i, 5) == 0 for i in out.doc_id]
    assert ((apart.predicted == apart.quality).mean()) > 0.93 and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.3)).all()
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    odd = spark.createDataFrame(documents([(1, "a b"), (2, None), (None, ""), (4, "x " * 50_000), (1, "a b")]), DOCS)
    rows = quality.score_quality(odd, marks).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [None]
    assert {r.score for r in quality.score_quality(odd, marks.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, marks).collect() == []


def test_quality_learns_from_whole_texts(spark):
    # the mark of a class lies behind 2,000 common words (more than 10,000 characters)
    ids = [i for i in range(1, 160) if brute.fold(i, 5)]
    rows = [(i, "common " * 2_000 + ("good " if i % 2 else "poor ") * 200) for i in ids]
    marks = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    out = quality.score_quality(spark.createDataFrame(documents(rows), DOCS), marks).collect()
    assert all((r.score > 0.8) == bool(r.doc_id % 2) and (r.score < 0.2) != bool(r.doc_id % 2) for r in out)


def test_quality_is_the_same_however_rows_are_dealt(spark, docs):
    marks = docs.select("doc_id", F.pmod("doc_id", F.lit(2)).cast("int").alias("quality"))
    one, many = (quality.context_vectors(docs.repartition(n)) for n in (1, 7))
    assert np.array_equal(one, many) and np.allclose(np.linalg.norm(one, axis=1).max(), 1, atol=1e-5)
    a, b = (dict(quality.score_quality(docs.repartition(n), marks).select("doc_id", "score").collect()) for n in (1, 7))
    assert a == pytest.approx(b, abs=1e-5)  # products of batches of other sizes round otherwise


def test_quality_learns_from_one_row_an_id(spark):
    ids = [i for i in range(1, 40) if brute.fold(i, 5)]
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], t) for t in [f"copy {k}" for k in range(50)] + ["same"] * 50 + [None, ""]]
    marks = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[1], 1)], "doc_id long, quality int")
    found = [sorted(map(tuple, quality.labelled_sample(spark.createDataFrame(documents(rows), DOCS).repartition(n), marks).collect())) for n in (1, 5)]
    assert found[0] == found[1] and [r[0] for r in found[0]] == ids
    small = quality.labelled_sample(spark.createDataFrame(documents(rows), DOCS), marks, sample=7).collect()
    assert len(small) == 7 and {tuple(r) for r in small} <= set(found[0])


def test_quality_of_a_document_labelled_twice(spark):
    docs = spark.createDataFrame(documents([(i, "good one" if i % 2 else "poor two") for i in range(1, 80)]), DOCS)
    marks = [(i, i % 2) for i in range(1, 80)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    a, b = (dict(quality.score_quality(docs, frame(m)).select("doc_id", "score").collect()) for m in (marks, [*marks, *[(i, 0) for i, q in marks if q], *marks]))
    assert a == pytest.approx(b)  # the higher label counts


def test_quality_features_and_network_against_plain_loops(docs, rows):
    """Context sums, pooled features and the forward pass, word by word."""
    texts = [t for _, t in rows if len(t or "") < 3000]
    column = pa.array(texts)
    index = quality.index_vectors()
    words, forms = {}, {}
    for first, last, w, f, at in quality.tokens(column):
        for r in range(first, last):
            words[r], forms[r] = w[at[r - first] : at[r - first + 1]].tolist(), f[at[r - first] : at[r - first + 1]].tolist()
    for r, t in enumerate(texts):
        own = brute.words(t)
        assert len(words[r]) == len(forms[r]) == len(own)
    context = np.zeros((quality.BUCKETS, quality.DIM))
    for r in words:
        for i, w in enumerate(words[r]):
            context[forms[r][i]] += index[w]
            for j in range(max(0, i - quality.WINDOW), min(len(words[r]), i + quality.WINDOW + 1)):
                if j != i:
                    context[w] += index[words[r][j]]
    sums = np.zeros((quality.BUCKETS, quality.DIM), np.int64)
    quality.context_sums(sums, column)
    assert np.array_equal(sums, context)
    unit = (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    x = quality.features(column, unit)
    for r in words:
        n = max(1, len(words[r]))
        zero = np.zeros(quality.DIM)
        want = [*(sum(unit[w] for w in words[r]) + zero) / n, *(sum(index[w] for w in words[r]) + zero) / n, *(sum(unit[f] for f in forms[r]) + zero) / n, *(sum(index[f] for f in forms[r]) + zero) / n, np.log1p(len(words[r])) / 10]
        assert np.allclose(x[r], want, atol=1e-4)
    net = quality.Network.train(x, np.arange(len(texts)) % 2.0, epochs=2)
    for row, score in zip(x.tolist(), net.score(x).tolist(), strict=True):
        hidden = [max(0.0, sum((v - m) / s * a for v, m, s, a in zip(row, net.w["mean"].tolist(), net.w["std"].tolist(), net.w["a"][:, h].tolist(), strict=True)) + float(net.w["b"][h])) for h in range(quality.HIDDEN)]
        logit = sum(h * float(c) for h, c in zip(hidden, net.w["c"], strict=True)) + float(net.w["d"])
        assert score == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)), abs=1e-4)


def test_shared_folder_and_scope(spark, tmp_path):
    import os

    from evigrain.llm import _store

    class Cluster:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        _store.shared_folder(Session())
    with _store.scope():
        store = _store.Store(spark, "scoped")
        store.table(spark.range(3), "x")
        store.table(spark.range(3), "y")
        store.keep_only("y")
        folder = store.uri.removeprefix("file://")
        assert sorted(os.listdir(folder)) == ["y"]
    assert not os.path.exists(folder)


def test_sizes_are_measured_where_estimates_mislead(spark):
    from evigrain.llm import _store

    a = spark.createDataFrame(documents([(i, "abcdefghij") for i in range(50)]), DOCS)
    joined = a.join(a.select("doc_id").distinct(), "doc_id").select("doc_id", "text")
    assert _store.input_bytes(joined) == 500
    assert _store.input_bytes(spark.createDataFrame(a.rdd, DOCS).select("text")) == 500
    assert 0 < _store.input_bytes(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")) < 10_000_000


@pytest.mark.parametrize("search", [multi_index.nearest, ball_tree.top_k])
def test_vectors_of_other_lengths_take_no_part(spark, search):
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    schema = "vec_id long, embedding array<double>"
    want = sorted(map(tuple, search(spark.createDataFrame(rows, schema)).select("query_id", "rank", "vec_id", "score").collect()))
    odd = [(1000, [1.0] * 5), (1050, [1.0] * 9), (1100, [2.0]), (1150, []), (1200, None), (1250, [1.0, 2.0, None, 4.0])]
    got = sorted(map(tuple, search(spark.createDataFrame(rows + odd, schema)).select("query_id", "rank", "vec_id", "score").collect()))
    assert len(want) == 30 and got == want
    even = [(1, [1.0, 0.5]), (50, [1.0, 0.0]), (2, [1.0, 0.0, 3.0]), (100, [1.0, 0.0, 3.0])]
    assert [r.query_id for r in search(spark.createDataFrame(even, schema)).collect()] == [50]
