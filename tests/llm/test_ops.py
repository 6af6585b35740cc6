"""The training-data operators against brute force, round trips and planted cases, and on odd inputs."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillmark.llm import decontamination, langid, lm_score, media, mixing, near_dedup, pii, sst, toxicity, url_filter, util
from rillmark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog while seventeen grey cats watch from a warm stone wall near the old mill pond and nobody says a word until the evening bell rings twice over the quiet valley"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}" if i % 5 else None, 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated, one very long text, an extra column with a clashing name."""
    rows = [(0, None, None, None, 0), (1, "", "en", "", 0), (2, " \t\n", "en", "x", 3), (3, BASE, "en", "x", 9), (3, BASE, "en", "x", 9), (4, "word " * 60_000, None, None, 0), (5, "é中\U0001f600 a.b", "fr", "y", 0), (None, BASE, "en", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("row", df.doc_id * 2).withColumn("h", df.text)


@given(st.lists(st.text(alphabet="aB1é .'\n-", max_size=20), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    import re

    w = util.words(pa.array(texts, pa.string()))
    want = [(i, m.lower()) for i, t in enumerate(texts) for m in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
    got = [(int(r), w.text(k).decode()) for k, r in enumerate(w.row)]
    assert got == want
    assert len({int(h) for h in w.hash}) == len({x for _, x in want})


def test_packing():
    x = np.array([0, 5, 2**63, 2**64 - 1, 7], np.uint64)
    assert (util.unpack(util.pack(x)) == x).all()
    assert (util.unpack_sorted(util.pack_sorted(np.sort(x))) == np.sort(x)).all()
    assert len(util.unpack(util.pack(x[:0]))) == 0


def test_url_rules(spark):
    rows = [("http://a.example.org/es/1", "block"), ("HTTP://A.EXAMPLE.ORG/es/1?x", "block"), ("http://example.org/en/12", "block"), ("http://x.org/en/2", "allow"), ("http://x.com/fr/9", "allow"), ("http://x.com/de/9#q", "block"), ("http://notorg/x", None), (None, None), ("no scheme", None)]
    out = url_filter.ruled(spark.createDataFrame(rows, "url string, want string")).collect()
    assert [r.ruling for r in out] == [w for _, w in rows]
    assert (out[1].host, out[1].path, out[0].rule) == ("a.example.org", "/es/1", "example.org/es/") and out[7].host == ""


def test_url_model_tells_classes(spark):
    good = [(i, f"http://news{i}.org/story/{i}") for i in range(60)]
    bad = [(100 + i, f"http://x{i}.com/de/casino-{i}-xxx") for i in range(60)]
    new = [(300, "http://news7.net/story/3"), (301, "http://x9.net/casino-7-xxx")]
    got = {r.page_id: r.verdict for r in url_filter.report(spark.createDataFrame(good + bad + new, "page_id long, url string")).collect()}
    assert got[300] == "allow" and got[301] == "block" and got[0] == "allow" and got[100] == "block"


def test_url_model_sees_whole_urls(spark):
    good = [(i, f"http://x{i}.org/page?u=story-{i}") for i in range(60)]
    bad = [(100 + i, f"http://x{i}.com/de/page?u=casino-{i}-xxx") for i in range(60)]
    new = [(300, "HTTP://X.net/page?u=story-7"), (301, "http://x.net/page?u=casino-7-xxx"), (302, "casino-7-xxx"), (303, None), (304, "http://x.net/page#casino-7-xxx")]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(good + bad + new, "page_id long, url string")).collect()}
    assert got[300].score > 0 > max(got[301].score, got[302].score, got[304].score) and got[303].score == 0
    assert got[301].path == "/page" and got[302].host == ""
    same = spark.createDataFrame([("HTTP://A.Net/P?Q#F",), ("x/Y",)], "url string")
    assert [r[0] for r in url_filter.ruled(same).select(url_filter._text(url_filter.F.col("url"))).collect()] == ["a.net/P?Q#F", "x/Y"]


def test_decontamination_is_brute_force(spark, docs, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for d in (docs, odd):
        rows, want = [(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in items.collect()]
        plain = sorted(decontamination.brute_force(rows, want), key=repr)
        assert sorted((tuple(r) for r in decontamination.report(d, items).collect()), key=repr) == plain
    small = sorted((tuple(r) for r in decontamination.report(docs, items, block_bytes=500).collect()), key=repr)
    assert small == sorted(decontamination.brute_force([(r.doc_id, r.text) for r in docs.collect()], want), key=repr)


def test_short_items_and_touching_documents(spark):
    d = _docs(spark, ["alpha beta", "beta alpha beta", "gamma", None, "alpha"])
    items = spark.createDataFrame([(1, "Alpha, BETA!"), (2, "gamma"), (3, ""), (4, None)], "item_id long, text string")
    assert sorted(tuple(r) for r in decontamination.report(d, items).collect()) == sorted(decontamination.brute_force([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert sorted(r.doc_id for r in decontamination.decontaminate(d, items).collect()) == [3, 4]


def test_lm_is_brute_force(docs, odd):
    by_id = lambda r: (r[0] is None, r[0] or 0, r[2])
    for d in (docs, odd):
        got = sorted((tuple(r) for r in lm_score.score(d).collect()), key=by_id)
        want = sorted(lm_score.brute_force([(r.doc_id, r.text) for r in d.collect()]), key=by_id)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5] for r in got], [r[5] for r in want]) and np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-5)


def test_mix(docs, odd, spark):
    assert mixing.targets([10, 10, 100], [5, 2, 1]) == [20.0, 20.0, 140.0]
    got = mixing.taken(docs).collect()
    by = {}
    for r in got:
        x = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        x[0], x[1] = x[0] + r.taken, x[1] + r.size
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(x[0] - x[2]) <= 0.01 * x[2] + 20 and x[1] == x[3] for x in by.values())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.taken(docs.repartition(5)).collect()))
    assert len(mixing.taken(odd).collect()) == 8
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and abs(kept.count() / docs.count() - 1.5) < 0.2


def test_mix_is_brute_force(docs, odd):
    for d in (docs, odd, odd.unionByName(odd)):
        want = mixing.brute_force([(r.doc_id, r.text, r.source) for r in d.collect()])
        got = [tuple(r) for r in mixing.taken(d).drop("slot").collect()]
        by_row = lambda rows: sorted(rows, key=repr)
        assert by_row(g[:4] for g in got) == by_row(w[:4] for w in want)
        assert by_row((g[0], g[1], g[2], g[5]) for g in got) == by_row((w[0], w[1], w[2], w[5]) for w in want)
        assert np.allclose(sorted(g[4] for g in got), sorted(w[4] for w in want))


def test_mix_schedule(spark, monkeypatch):
    blocks, ends, slots = mixing.plan([900_000, 70_000, 0, 300], mixing.targets([900_000, 70_000, 0, 300], [5, 2, 1, 5]))
    rows = sorted(tuple(r) for r in mixing.schedule(spark, blocks, ends, slots).collect())
    monkeypatch.setattr(mixing, "RANGE", 1000)
    ranks, at = [0] * 4, 0
    for slot, source, rank, block in rows:
        while at <= slot:
            s = next(i for i, e in enumerate(ends) if at * mixing.GOLDEN % 2**64 < e)
            ranks[s] += 1
            at += 1
        assert (s, ranks[s] - 1, (ranks[s] - 1) % blocks[s]) == (source, rank, block)
    assert sorted(tuple(r) for r in mixing.schedule(spark, blocks, ends, slots).collect()) == rows


def test_mix_of_small_sources_in_a_large_input():
    cuts = [0, 1, 2**64 // 3, 2**63, 2**64 - 1]
    assert [mixing.below(999, c) for c in cuts] == [int((mixing.points(999) < np.uint64(c)).sum()) for c in cuts]
    sizes = [50, 200, 500, 2_000, 5_000, 4 * 10**9, 10**9]
    target = mixing.targets(sizes, [1.0] * len(sizes))
    blocks, ends, slots = mixing.plan(sizes, target)
    marks = [0, *(mixing.below(slots, e) if e < 2**64 else slots for e in ends)]
    for size, t, n, lo, hi in zip(sizes, target, blocks, marks[:-1], marks[1:], strict=True):
        assert abs(min(hi - lo, 2 * n) * size / n - t) <= max(8, 0.005 * t)


@given(st.binary(max_size=900))
@settings(max_examples=30, deadline=None)
def test_png_round_trip(data):
    p = media.padded(data)
    png = media.to_png(p)
    assert media.from_png(png).tobytes() == p
    broken = bytearray(png)
    broken[len(png) // 2] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))


@given(st.integers(0, 2**32))
@settings(max_examples=10, deadline=None)
def test_png_filters(seed):
    rng = np.random.default_rng(seed)
    image = rng.integers(0, 256, (6, 9), dtype=np.uint8)
    rows, before = [], np.zeros(9, int)
    for y, row in enumerate(image.astype(int)):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], before[:-1]])
        e = left + before - corner
        d = np.stack([abs(e - left), abs(e - before), abs(e - corner)])
        guess = [np.zeros(9, int), left, before, (left + before) // 2, np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], before, corner))][y % 5]
        rows.append(np.concatenate([[y % 5], (row - guess) % 256]))
        before = row
    assert (media.unfiltered(np.array(rows, np.uint8)) == image).all()


def test_media_columns(odd):
    rows = media.described(media.with_media(odd)).collect()
    assert len(rows) == 8 and all(r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes) for r in rows)
    assert len({r.feature for r in rows if r.doc_id == 3}) == 1


def test_toxicity(spark, odd):
    m = toxicity.Model(dict(toxicity.SEEDS))
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") and toxicity.fold("ѕtuрid") == "stupid" and toxicity.fold("$cum") == "scum"
    hit = lambda t: bool(m.matches(toxicity.fold(t)))
    assert hit("you 1d10t!") and hit("L0SER") and not hit("idiots") and not hit("the trash can") and hit("trash, can")
    for t in ("", None, "you idiot " * 5, "a trash can", BASE):
        n, total = util.words(pa.array([t or ""])).counts(), sum(x for _, _, x in m.matches(toxicity.fold(t or "")))
        assert abs(float(m.score(np.array([total]), n)[0]) - toxicity.brute_force(m, t)) < 1e-9
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.report(d, labels).join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows if r.held_out) / sum(r.held_out for r in rows)
    assert right > 0.93
    assert len(toxicity.report(odd, labels.limit(0)).collect()) == 8


def test_language(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.report(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    got = langid.report(odd).collect()
    assert len(got) == 8 and {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in langid.report(odd.limit(0)).collect()} == set()


TEXTS = st.text(alphabet="a.b@c-1234 +()9\n", max_size=80)


def test_pii_base_is_the_plain_expressions(spark, docs):
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("a.b@c-12 +()9_\n"), rng.integers(1, 120))) for _ in range(400)]
    made += ["a@b.c-x_y@d.e", "4111 1111-1111 1111", "5  4111111111111111", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.1.1.1", "+1 (017) 555-7713.", "9" * 50_000, "1-" * 30_000, None, ""]
    d = _docs(spark, made)
    for rows, frame in (([(r.doc_id, r.text) for r in x.collect()], x) for x in (d, docs)):
        got = {r.doc_id: [tuple(b) for b in r.base] for r in pii.spans(frame).collect()}
        assert got == {i: pii.brute_force(t) for i, t in rows}


def test_pii_patterns_find_unseen(spark):
    texts = [f"{BASE[: i % 50]} reach passport +49 (30) 555-{1000 + i} today" for i in range(12)] + ["reach passport 030 555 9999 today", BASE]
    rows = {r.doc_id: r for r in pii.spans(_docs(spark, texts)).collect()}
    assert not rows[12].base and [s.kind for s in rows[12].spans] == [3] and not rows[13].spans


def test_pii_keeps_all_patterns(spark):
    name = lambda i: "q" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = [" . ".join(f"{name(i)} user{i}x{k}@mail.example.org" for k in range(5)) for i in range(600)]
    texts += [f"ringme call{k}@mail.example.org" for k in range(5)] + ["ringme bob@local"]
    rows = {r.doc_id: r for r in pii.spans(_docs(spark, texts)).collect()}
    assert [tuple(s) for s in rows[605].spans] == [(0, 7, 16)]


def test_near_duplicates(spark):
    words = BASE.split()
    near = " ".join(["changed", *words[1:]])
    rng = np.random.default_rng(1)
    others = [" ".join(rng.permutation(words)) for _ in range(20)]
    texts = [BASE, BASE.upper() + ".", BASE, near, *others, None, None, "", "", "one two", "one two", "two one"]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(_docs(spark, texts)).collect()}
    assert got[1] == got[2] == 0 and got[3] == 0
    assert all(got[i] == i for i in range(4, 26)) and got[27] == 26 and got[29] == 28 and got[30] == 30
    kept = [r.doc_id for r in near_dedup.deduplicate(_docs(spark, texts)).collect()]
    assert sorted(kept) == sorted(i for i in got if got[i] == i)


def test_near_duplicates_of_a_template(spark):
    rng = np.random.default_rng(3)
    template, texts = [f"t{i}" for i in range(55)], []
    for _ in range(400):
        tail = [f"w{x}" for x in rng.integers(0, 1 << 40, 9)]
        changed = template.copy()
        changed[rng.integers(5, 50)] = f"c{rng.integers(0, 1 << 40)}"
        texts += [" ".join(template + tail), " ".join(changed + tail)]
    rows = list(enumerate(texts[i] for i in rng.permutation(len(texts))))
    parts = near_dedup._parts(pa.array([t for _, t in rows]))
    opened = [(parts[0].hash[parts[1][i] : parts[1][i + 1]], np.sort(parts[2][parts[3][i] : parts[3][i + 1]])) for i in range(len(rows))]
    least = list(range(len(rows)))  # of a pair; a text is like its copy only
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.alike(opened[i], opened[j]):
                least[i] = min(least[i], j)
    assert sum(i != x for i, x in enumerate(least)) == 400
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(least))


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64)
        b = rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64)
        t = np.arange(len(b) + 1)
        for i, x in enumerate(a):
            n = [i + 1]
            for j, y in enumerate(b):
                n.append(min(n[j] + 1, t[j + 1] + 1, t[j] + (x != y)))
            t = n
        want = int(t[-1])
        assert near_dedup.edit_distance(a, b, 40) == want
        assert near_dedup.edit_distance(a, b, want - 1) is None if want else True


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abZé'<|>1 .,!-\n ıİΣ…")), st.characters(codec="utf-8")), max_size=24) | st.sampled_from(["<|endoftext|> x", "<|ENDOFTEXT|>", "don't 'sun ..'s", "a.'s5's", "éa 5́ ≠"]), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoding_is_the_tokenizers(texts):
    e = sst.encoder(tokenizer_path())
    ids, bounds = e.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_shard_lookup():
    rng = np.random.default_rng(3)
    keys = sorted(rng.integers(-(2**40), 2**40, 500).tolist() + [7, 7, 7])
    w = sst.ShardWriter(2, 400)
    rows = [(k, rng.integers(0, 49408, rng.integers(0, 60)).astype(np.uint32)) for k in [None, *keys]]
    for k, ids in rows:
        w.add(sst.key_of(k), ids)
    data = w.close()
    r = sst.ShardReader(io.BytesIO(data))
    assert [(k, ids.tolist()) for k, _, ids in r] == [(k, ids.tolist()) for k, ids in rows]
    assert len(r.get(7)) == 3 and r.get(None)[0].tolist() == rows[0][1].tolist() and r.get(2**50) == []
    assert sum(r.may_have(sst.key_of(2**45 + i)) for i in range(1000)) < 40
    broken = bytearray(data)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        list(sst.ShardReader(io.BytesIO(bytes(broken))))


def test_token_table(docs, odd):
    e = sst.encoder(tokenizer_path()).tokenizer
    for d in (docs, odd):
        at, want = 0, []
        for r in sorted(d.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
            ids = [*e.encode(r.text or "", add_special_tokens=False).ids, 2]
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted((tuple(r) for r in sst.token_table(d, tokenizer_path()).collect()), key=repr) == sorted(want, key=repr)
    assert sst.token_table(docs.limit(0), tokenizer_path()).count() == 0


def test_empty_tables(spark, docs):
    none, items, pages = docs.limit(0), spark.read.parquet(f"{SF}/benchmark.parquet").limit(0), spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    for df in (url_filter.report(pages), decontamination.report(none, items), lm_score.score(none), mixing.taken(none), mixing.mixed(none), media.described(media.with_media(none)), pii.report(none), near_dedup.near_duplicates(none)):
        assert df.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        before, docs = docs, util.written(stage(spark, docs, SF), "test")
        assert docs.count() > 0, name
        assert name == "token output" or docs.columns == before.columns
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
