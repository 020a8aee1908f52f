"""Each operator on small tables, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from linkloom.llm import bpe, decontaminate, jaccard, langid, pieces, quality, sharding, suffixes, tokenfile, toxicity, urlfilter, words
from linkloom.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [None, "", " \n\t ", "a", "one two", "x" * 200_000, LONG, "ß é 日本　語", "same text here twice", "same text here twice"]


def prose(seed, n, vocabulary=400):
    rng = random.Random(str(seed))
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, texts, extra=True):
    """doc_id, text and columns whose names operators use inside."""
    rows = [(i, t, 1, "x", 0.5, "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint, block string, score double, lang string")
    return df if extra else df.select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


# --- words ----------------------------------------------------------------------------


def test_words_do_not_depend_on_slices(monkeypatch):
    texts = pa.array([*ODD[:5], "Hello  World", "", "hello world", "é à"])
    whole = words.split_words(texts, words.NOT_BLANK, fold=True)
    monkeypatch.setattr(words, "SLICE", 5)
    parts = words.split_words(texts, words.NOT_BLANK, fold=True)
    assert whole.first.tolist() == parts.first.tolist() == [0, 0, 0, 0, 1, 3, 5, 5, 7, 9]
    assert (whole.hash == parts.hash).all()
    assert whole.hash[3:5].tolist() == whole.hash[5:7].tolist()


# --- quality --------------------------------------------------------------------------


def plain_quality(text):
    found = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    places = defaultdict(list)
    for i in range(len(found) - 4):
        places[tuple(found[i : i + 5])].append(i)
    repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    return (len(found), sum(map(len, found)), sum((text or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(repeated))


def test_quality_counts(spark, none):
    texts = [*ODD, "a b c d e a b c d e f", "a a a a a a a", "l1 x\nl1 x\n\n l1 x\nl1 x", "## $ | <>", prose(1, 60) + " " + prose(1, 60)]
    rows = quality.judge(quality.statistics(table(spark, texts))).orderBy("doc_id").collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(r[n] for n in names) for r in rows] == [plain_quality(t) for t in texts]
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(quality.statistics(none)).count() == 0


def test_quality_rules_decide(spark):
    clean = "the report of the day was read to all and it had some words in it that were new"
    texts = [clean, clean.upper(), clean.replace(" ", "### "), "zq xv bn wq pl mk jh gf ds az qw er"]
    rows = quality.judge(quality.statistics(table(spark, texts, extra=False))).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, False, False, False]
    assert rows[1].failed_rules == ["shout_ratio"]


# --- sharding -------------------------------------------------------------------------


def test_longest_first_takes_the_least_load():
    assert sharding.longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert sharding.longest_first([], 3) == {}


def test_shards(spark, none, odd):
    texts = [*ODD, *(prose(i % 90, 5 + i % 40) for i in range(300))]
    rows = sharding.shard(table(spark, texts), shards=7).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(by_id) == len(texts)
    homes = defaultdict(set)
    for i, t in enumerate(texts):
        body = (t or "").encode()
        assert by_id[i].size == len(body) + 16 and by_id[i].text_crc32 == zlib.crc32(body)
        homes[body].add(by_id[i].shard)
    assert all(len(h) == 1 for h in homes.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none).count() == 0


def test_loads_are_near_equal(spark):
    rows = sharding.shard(table(spark, [prose(i, 20 + i % 100) for i in range(600)]), shards=6).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.02 * max(load.values())


def test_slots_of_small_cells(spark):
    placed = sharding.place(sharding.sized(table(spark, [prose(i, 9) for i in range(100)])), shards=3)
    rows = sharding.number_slots(placed, rows_per_cell=2).collect()
    for shard in range(3):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


# --- URL filters ----------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "http://example.org", "http://a.example.org/en/12?x=1#y",
    "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/2", "http://bad.net/p/?utm_source=a", "https://m.bad.net/p.html#t",
    "http://good.net/p", "http://bad.net/p", "http://bad.net/p",
]


def test_url_rules_and_list(spark):
    rules = [urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "com", "/de/")]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id int, url string, host string, rule string")
    listed = spark.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,)], "canonical string")
    rows = {r.page_id: r for r in urlfilter.judge(pages, rules, listed).collect()}
    assert len(rows) == len(URLS)
    assert [rows[i].host for i in range(5)] == ["", "", "", "", "www.example.org"]
    assert rows[5].path == "" and rows[5].rule is None  # no path, so no rule's path begins it
    assert (rows[4].rule, rows[4].verdict) == ("example.org/es/", "block")
    assert (rows[6].path, rows[6].rule, rows[6].verdict) == ("/en/12", "org/", "allow")
    assert rows[7].rule == "org/"
    assert rows[8].verdict == "allow" and rows[9].verdict == "block"
    assert [rows[i].verdict for i in range(10, 15)] == ["block", "block", "allow", "block", "block"]
    assert urlfilter.judge(pages.limit(0), rules, listed.limit(0)).count() == 0


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(3000).selectExpr("concat('u', id) AS k")
    listed = keys.where("crc32(k) % 3 = 0")
    for blocks in (4, 512):  # a full filter lets all pass, and the join decides
        rows = urlfilter.listed_flag(keys, "k", listed, blocks).collect()
        assert {r.k for r in rows if r.is_listed} == {r.k for r in listed.collect()} and len(rows) == 3000
    probed = urlfilter.may_be_listed(keys, "k", urlfilter.bloom(listed, "k", 512), 512)
    assert probed.where("__maybe").count() < 1500


# --- repeated passages ----------------------------------------------------------------


def plain_passages(texts, length):
    places = defaultdict(list)
    for d, t in enumerate(texts):
        found = WORD.findall(t or "")
        for i in range(len(found) - length + 1):
            places[tuple(found[i : i + length])].append((d, i))
    whole, copies = defaultdict(set), defaultdict(set)
    for p in places.values():
        for d, i in p if len(p) > 1 else ():
            whole[d].update(range(i, i + length))
            if (d, i) != min(p):
                copies[d].update(range(i, i + length))
    return whole, copies


def word_set(ranges):
    return {i for r in ranges for i in range(r.start, r.end)}


def test_passages(spark, none):
    shared = prose("s", 70)
    texts = [
        *ODD, prose(1, 90), prose(1, 90), prose(2, 30) + " " + shared + " " + prose(3, 40), shared, prose(4, 49) + "\n" + shared,
        prose(5, 60) + " " + prose(6, 20) + " " + prose(5, 60), "na " * 80, " ".join(shared.split()[:49]),
        prose(7, 20) + " " + " ".join(shared.split()[10:65]),
    ]
    whole, copies = plain_passages(texts, 50)
    rows = {r.doc_id: r for r in suffixes.passages(table(spark, texts, extra=False)).collect()}
    assert {d: word_set(r.passages) for d, r in rows.items()} == dict(whole)
    assert {d: word_set(r.copies) for d, r in rows.items() if r.copies} == {d: c for d, c in copies.items() if c}
    assert suffixes.passages(none).count() == 0


def test_copies_are_cut(spark):
    shared = prose("s", 60)
    texts = ["begin " + shared + " end", shared, None, "", "Ünd " + shared + "\nrest", "short"]
    docs = table(spark, texts)
    kept = {r.doc_id: r.text for r in suffixes.without_copies(docs, suffixes.passages(docs)).collect()}
    assert kept == {0: texts[0], 2: None, 3: "", 4: "Ünd rest", 5: "short"}


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_random_texts(spark, seed):
    rng = random.Random(seed)
    stock = [prose((seed, i), 40) for i in range(12)]
    texts = [" ".join(rng.choice(stock) for _ in range(rng.randrange(5))) + " " + prose((seed, "t", i), rng.randrange(9)) for i in range(40)]
    whole, _ = plain_passages(texts, 50)
    rows = suffixes.passages(table(spark, texts, extra=False)).collect()
    assert {r.doc_id: word_set(r.passages) for r in rows} == dict(whole)


# --- language -------------------------------------------------------------------------


def test_language(spark, none, odd):
    rng = random.Random(4)
    stems = {"aa": ["kala", "tuli", "meri"], "bb": ["stone", "water", "light"]}
    texts, langs = [], []
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        texts.append(" ".join(rng.choice(stems[lang]) for _ in range(12)))
        langs.append(lang)
    docs = spark.createDataFrame(list(zip(texts, langs)), "text string, lang string")
    model = langid.fit(docs)
    names, score, _ = model.predict(pa.array(["Kala meri!", "Light, stone", None, "", "123 ++", "tuli"]))
    assert names == ["aa", "bb", "und", "und", "und", "aa"]
    assert ((score >= 0) & (score <= 1)).all() and score[2] == 0
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows} <= {"aa", "bb", "und"}
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_language_probabilities_add_up():
    key, _ = langid.grams_of([b"abba", b"baa", b"ab"])
    keys, n = np.unique(key, return_counts=True)
    model = langid.build({"x": (keys, n.astype(float))})
    letters = np.array([0, ord("a"), ord("b"), ord("z")], np.uint64)  # the last stands for all that were never seen
    for before in (0, ord("a"), ord("b") << 16 | ord("a"), ord("q")):
        p = np.exp2(model.log_probabilities((np.uint64(before) << np.uint64(16)) | letters))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_language_keeps_every_gram(spark):
    """Shards of any size give what all counts give together; a cut list of frequent grams does not."""
    rng = random.Random(9)
    langs = ["aa", "bb", "cc"]
    letter = lambda i: chr(0x4E00 + max(0, rng.randrange(-20, 20 + 20 * i)))
    rows = [(" ".join("".join(letter(i % 3) for _ in range(3)) for _ in range(20)), langs[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    counted = defaultdict(Counter)
    for text, lang in rows:
        for word in text.split():
            counted[lang].update(langid.grams_of([word.encode()])[0].tolist())
    whole = {}
    for lang, grams in counted.items():
        keys = np.array(sorted(grams), np.uint64)
        whole[lang] = (keys, np.array([grams[k] for k in keys.tolist()], float))
    texts = pa.array([t for t, _ in rows[:9]] + ["never seen", "", None])
    expected, told = langid.build(whole).bits(texts, langid.Span())
    expected = expected / np.maximum(told, 1)[:, None]
    for cells in (langid.SHARD_CELLS, 1_500):
        model = langid.fit(docs, shard_cells=cells)
        assert (len(model.parts) > 1) == (cells == 1_500) == any(span.of > 1 for span, _ in model.parts)
        found = sum(shared.value.bits(texts, span)[0] for span, shared in model.parts)
        assert found / np.maximum(told, 1)[:, None] == pytest.approx(expected, rel=1e-5)
        assert model.predict(texts)[0][:9] == [lang for _, lang in rows[:9]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "doc_id bigint, text string")
    found = langid.predict(frame, model).orderBy("doc_id").collect()
    names, score, rejected = model.predict(texts)
    assert [(r.lang_pred, r.rejected) for r in found] == list(zip(names, rejected.tolist()))
    assert [r.score for r in found] == pytest.approx(score.tolist())


def test_language_spans_hold_every_key():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    for sizes, most in (({}, 5), ({0: 3, 7: 2, 9: 30, 0xFFFF: 30}, 10), ({0: 50, 1: 1}, 10)):
        assert (sum(s.holds(keys).astype(int) for s in langid.spans(sizes, most)) == 1).all()


def test_language_limits_come_from_all_texts(spark):
    """A rare language has its own limit, which few of its texts pass."""
    rng = random.Random(3)
    rare = [" ".join("".join(rng.choice("klmnuvwi") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 40))) for _ in range(40)]
    rows = [(prose(i, 6, 9), "often") for i in range(8000)] + [(t, "rare") for t in rare] + [("123", "signs"), (None, "rare")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    model = langid.fit(docs)
    assert model.langs == ["often", "rare"] and np.isfinite(model.limit).all()
    names, _, rejected = model.predict(pa.array(rare))
    assert names == ["rare"] * 40 and not rejected.any()
    own = spark.createDataFrame([(t,) for t, lang in rows if lang == "often"], "text string")
    refused = langid.predict(own, model).where("rejected").count()
    assert 0 < refused <= 60


# --- near duplicates ------------------------------------------------------------------


def plain_components(texts, size, percent):
    sets = []
    for t in texts:
        found = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(found[i : i + size]) for i in range(len(found) - size + 1)} or ({tuple(found)} if found else set()))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            shared = len(s & sets[j])
            if shared and 100 * shared >= percent * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def edited(text, rng, edits):
    found = text.split()
    for _ in range(edits):
        found[rng.randrange(len(found))] = f"new{rng.randrange(10**6)}"
    return " ".join(found)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rng = random.Random(9)
    base, other, short = prose("b", 150), prose("o", 60), prose("h", 9)
    texts = [*ODD, base, base.upper(), short, short, short + " x"]
    texts += [edited(base, rng, k % 9) for k in range(90)]  # a group whose lists are long
    texts += [edited(other, rng, k % 3) for k in range(12)]
    texts += [prose(("p", k), 30) + " " + base[: len(base) // 3] for k in range(45)]  # much in common, yet different
    texts += [f"{short} tail{k}" for k in range(4)]
    rows = jaccard.near_duplicates(table(spark, texts), size, percent).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == plain_components(texts, size, percent)


def test_near_duplicates_of_nothing(spark, none):
    assert jaccard.near_duplicates(none).count() == 0
    rows = jaccard.near_duplicates(table(spark, [None, "", "a b"])).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    parent = {n: n for link in links for n in link}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    rows = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in rows} == {n: find(n) for n in linked}


# --- decontamination ------------------------------------------------------------------


def plain_hits(texts, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for t in texts:
        found, hit, names = split(t), set(), set()
        for name, item in items:
            own = split(item)
            n = min(13, len(own))
            runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(found) - n + 1):
                if n and tuple(found[i : i + n]) in runs:
                    hit.update(range(i, i + n))
                    names.add(str(name))
        out.append((len(found), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination(spark, block_bytes):
    item = prose("i", 30)
    items = [(1, item), (2, "Short one"), (3, None), (10, "!!"), (2, "short ONE"), (4, "na " * 40), (5, item[: len(item) // 2])]
    texts = [*ODD, prose(1, 50) + " " + item, "a short, one b", " ".join(item.split()[3:17]), " ".join(item.split()[3:15]), "na " * 20, item.upper()]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.judged(decontaminate.contamination(table(spark, texts), bench, block_bytes=block_bytes)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in rows] == plain_hits(texts, items)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in rows)


def test_contamination_of_nothing(spark, none, odd):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    rows = decontaminate.judged(decontaminate.contamination(odd, bench)).collect()
    assert len(rows) == len(ODD) and not any(r.contaminated for r in rows)


def test_winnowing_keeps_a_hash_of_every_window():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 50, 500).astype(np.uint64)
    kept = set(decontaminate.winnowed(hashes, 9).tolist())
    for i in range(len(hashes) - 8):
        window = hashes[i : i + 9]
        assert {i + j for j in np.flatnonzero(window == window.min())} <= kept


# --- tokens ---------------------------------------------------------------------------

MIXED = ["a", "B", " ", "\n", "  ", "é", "É", " ", "1", "!", "'s", "'S", "The", "　", "\t", "日", "<|endoftext|>", "ß", "\x85", "́", ".", ",", "İ", "🎉", "\x1c"]


def mixed(n):
    rng = random.Random(n)
    return ["".join(rng.choice(MIXED) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*(t or "" for t in ODD), "aaaaaaaaaaa aaaa", *mixed(400)]
    ids, bounds = bpe.token_lists(pa.array(texts), path)
    vocab, _ = bpe.vocabulary(path)
    for i, t in enumerate(texts):
        expected = library.encode(t, add_special_tokens=False).ids
        own = ids[bounds[i] : bounds[i + 1]]
        assert own.tolist() == expected
        assert vocab.decode(own).decode() == library.decode(expected, skip_special_tokens=False)


def test_bpe_round_trip(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(odd, path), path).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == [t or "" for t in ODD]
    assert [r.text for r in rows] == ODD and rows[0].lang == "en"
    told = bpe.digests(odd, path).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_sha256) for r in told] == [
        (len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()) for r in rows
    ]
    assert bpe.digests(none, path).count() == 0


def test_token_files(spark, tmp_path, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, *mixed(150), *(prose(i, 80) for i in range(60))]
    docs = table(spark, texts).selectExpr("(doc_id * 37) % 1009 AS doc_id", "text", "n")
    folder = f"file://{tmp_path}/a"
    tokenfile.write(docs, folder, path, end_id=1, block_bytes=3000)
    rows = sorted(tokenfile.read(spark, folder).collect())
    start = 0
    for row, doc in zip(rows, sorted(docs.collect(), key=lambda d: d.doc_id), strict=True):
        ids = library.encode(doc.text or "", add_special_tokens=False).ids + [1]
        assert tuple(row) == (doc.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = {r.doc_id: r.ids for r in tokenfile.fetch(spark, folder, [3 * 37, 4 * 37, 5000]).collect()}
    assert found == {111: library.encode("a", add_special_tokens=False).ids + [1], 148: library.encode("one two", add_special_tokens=False).ids + [1]}
    tokenfile.write(none, f"file://{tmp_path}/b", path)
    assert tokenfile.read(spark, f"file://{tmp_path}/b").count() == 0


def test_token_files_reject_another_dictionary():
    payload = tokenfile._packed([1], [1], [b""], 2, hashlib.sha256(b"x").digest())
    with pytest.raises(ValueError):
        tokenfile.BlockReader(payload, b"y")


def test_pieces_make_up_the_texts():
    texts = [t or "" for t in ODD] + mixed(50)
    found = pieces.cut(pa.array(texts))
    for i, t in enumerate(texts):
        assert b"".join(found.distinct[k] for k in found.index[found.first[i] : found.first[i + 1]]).decode() == t


# --- toxicity -------------------------------------------------------------------------


def toxic_rows(n, seed):
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        found = prose((seed, i), rng.randrange(20, 200), 60).split()
        if i % 3 == 0:
            for _ in range(3):
                found[rng.randrange(len(found))] = "vilest" + rng.choice(["", "a", "en", "um", "is"])
        texts.append(" ".join(found))
        marks.append(int(i % 3 == 0))
    return texts, marks


def test_toxicity_learns_subwords():
    model = toxicity.train(*toxic_rows(240, 1))
    texts, marks = toxic_rows(90, 2)
    texts[0] = texts[0].replace("vilest", "vilestox")  # never seen
    called = model.scores(pa.array(texts)) >= 0.7
    assert (called == np.array(marks, bool)).mean() > 0.95
    assert model.scores(pa.array(texts[:1]))[0] > 0.5


def test_toxicity_does_not_depend_on_slices(monkeypatch):
    texts, marks = toxic_rows(120, 1)
    texts[:4] = ["", None, "one", " "]
    whole = toxicity.train(texts, marks, rounds=5).weights
    monkeypatch.setattr(toxicity, "SLICE", 2000)
    assert (toxicity.train(texts, marks, rounds=5).weights == whole).all()


def test_toxicity_of_odd_texts(spark, odd, none):
    model = toxicity.train(*toxic_rows(120, 1))
    rows = toxicity.score(odd, model).orderBy("doc_id").collect()
    assert [r.score for r in rows[:3]] == [0, 0, 0] and all(0 <= r.score <= 1 for r in rows)
    assert rows[8].score == rows[9].score
    assert toxicity.score(none, model).count() == 0


def test_toxicity_sample_is_not_lowered(spark):
    ids = spark.range(5200)
    docs, labels = ids.selectExpr("id AS doc_id", "concat('text ', id) AS text"), ids.selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    assert Counter(toxic for _, toxic in toxicity.sample(docs, labels)) == {0: 2500, 1: 2500}


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([(4, None), (None, 1), (77, 1)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect()} == {0.0}
    one_class = spark.createDataFrame([(4, 1), (4, 0)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, one_class)).collect()} == {0.0, 1.0}
