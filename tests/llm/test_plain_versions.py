"""Operators that SQL cannot state, against versions in plain Python that share nothing with them."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import bpe, langid, sharding, toxicity, words
from tests.llm.test_operators import ODD, prose

# --- sharding -----------------------------------------------------------------------


def test_shards_are_those_of_a_plain_greedy_run(spark):
    texts = [prose(i % 23, 3 + 5 * (i % 23) ** 2) for i in range(150)] + [None, "", "", "x" * 9000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    shards, fineness = 4, 5
    bundle = F.pmod(F.xxhash64("group"), F.lit(shards * fineness)).alias("bundle")
    found = sharding.shard(rows, shards, fineness).select("doc_id", "shard", "size", bundle).collect()
    sizes = defaultdict(int)
    for r in found:
        assert r.size == 16 + len((texts[r.doc_id] or "").encode())
        sizes[texts[r.doc_id] or ""] += r.size
    total, jobs, job_of = sum(sizes.values()), defaultdict(int), {}
    by_text = {texts[r.doc_id] or "": r for r in found}
    for text, size in sizes.items():
        job_of[text] = text if size * shards * fineness > total else by_text[text].bundle
        jobs[job_of[text]] += size
    assert len({type(j) for j in jobs}) == 2  # groups of their own, and bundles
    loads, shard_of = [0] * shards, {}
    for job, size in sorted(jobs.items(), key=lambda x: -x[1]):  # sizes differ, so no tie decides
        least = loads.index(min(loads))
        shard_of[job] = least
        loads[least] += size
    assert len(set(jobs.values())) == len(jobs)
    assert all(r.shard == shard_of[job_of[texts[r.doc_id] or ""]] for r in found)


# --- languages ------------------------------------------------------------------------


def plain_kneser_ney(texts_by_lang):
    """Interpolated Kneser-Ney of four letters in dictionaries: bits of a text in each language."""

    def grams(text):
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = "\0\0\0" + word + "\0"
            for i in range(3, len(padded)):
                yield padded[i - 3 : i + 1]

    models = {}
    for lang, texts in texts_by_lang.items():
        levels = {4: Counter(g for t in texts for g in grams(t))}
        for depth in (3, 2, 1):
            levels[depth] = Counter(g[1:] for g in levels[depth + 1])
        models[lang] = levels
    floor = 1 / (1 + max(len(levels[1]) for levels in models.values()))

    def probability(levels, gram):
        p = floor
        for depth in (1, 2, 3, 4):
            short, n = gram[-depth:], levels[depth]
            once, twice = (sum(v == k for v in n.values()) for k in (1, 2))
            discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
            same = [v for g, v in n.items() if g[:-1] == short[:-1]]
            if same:
                p = max(n[short] - discount, 0) / sum(same) + min(discount * len(same) / sum(same), 1) * p
        return p

    def bits(text):
        return {lang: sum(-math.log2(probability(levels, g)) for g in grams(text)) for lang, levels in models.items()}

    return bits


def test_language_models_are_plain_kneser_ney(spark):
    rng = random.Random(8)
    letters = {"aa": "abcde", "bb": "bcdefgß", "cc": "äöaxyz"}
    rows = [(" ".join("".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))) for _ in range(8)), lang) for lang, pool in letters.items() for _ in range(6)]
    bits = plain_kneser_ney({lang: [t for t, other in rows if other == lang] for lang in letters})
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    texts = [rows[0][0], rows[7][0], rows[14][0], "Abc, ßed!", "unseen wörds qq", "a"]
    found = sum(shared.value.bits(pa.array(texts), span)[0] for span, shared in model.parts)
    expected = [[bits(t)[lang] for lang in model.langs] for t in texts]
    assert found == pytest.approx(np.array(expected), rel=1e-4)
    names, _, _ = model.predict(pa.array(texts))
    assert names == [model.langs[int(np.argmin(e))] for e in expected]


# --- toxicity --------------------------------------------------------------------------


def _mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def plain_toxicity(model, text):
    """A text's score, n-gram by n-gram."""
    spelled = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    if not spelled:
        return 0.0
    letter = [int(x) for x in toxicity._LETTERS]

    def of_word(word):
        marked, found = b"<" + word + b">", []
        for n in (3, 4, 5, 6):
            for i in range(len(marked) - n + 1):
                rolling = 0
                for b in marked[i : i + n]:
                    rolling = (rolling * words.BASE + letter[b]) % 2**64
                found.append(float(model.weights[_mixed((rolling + n) % 2**64) % toxicity.BUCKETS]))
        return sum(found) / len(found) if found else 0.0

    values = [of_word(w) for w in spelled]
    passages = [values[i : i + 8] for i in range(0, len(values), 8)]
    logits = [sum(p) / len(p) for p in passages]
    share = [math.exp(model.sharpness * (x - max(logits))) for x in logits]
    pooled = sum(s * x for s, x in zip(share, logits)) / sum(share)
    return 1 / (1 + math.exp(-(pooled + model.bias)))


def test_toxicity_scores_are_plain_bags_of_subwords():
    texts = [prose(i, 30, 50) + (" vile gorvath scum" if i % 2 else " kind words") for i in range(60)]
    model = toxicity.train(texts, [i % 2 for i in range(60)], rounds=20)
    asked = [*(t for t in ODD if t is None or len(t) < 1000), texts[0], texts[1], "a ab gorvathh scüm " * 9]
    assert model.scores(pa.array(asked)) == pytest.approx([plain_toxicity(model, t) for t in asked], abs=1e-9)
    assert model.scores(pa.array(texts))[1::2].mean() > model.scores(pa.array(texts))[::2].mean() + 0.1


# --- column names ------------------------------------------------------------------------


def test_columns_of_the_same_name_in_other_letters_are_replaced(spark):
    docs = spark.createDataFrame([(1, "some words here", 0.5, [1], "x", True)], "doc_id int, text string, Score double, IDS array<int>, Lang_Pred string, Rejected boolean")
    model = toxicity.train(["kind words"] * 3 + ["vile scum"] * 3, [0, 0, 0, 1, 1, 1], rounds=2)
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "IDS", "Lang_Pred", "Rejected", "score"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(docs, path)
    assert [c for c in coded.columns if c.lower() == "ids"] == ["ids"] and len(coded.first().ids) == 3
    back = bpe.decode(coded.withColumnRenamed("text", "Decoded"), path)
    assert [c for c in back.columns if c.lower() == "decoded"] == ["decoded"] and back.first().decoded == "some words here"
    languages = langid.fit(spark.createDataFrame([("some words", "en"), ("ein paar", "de")], "text string, lang string"))
    found = langid.predict(docs, languages)
    assert found.columns == ["doc_id", "text", "IDS", "lang_pred", "score", "rejected"] and found.first().lang_pred == "en"
