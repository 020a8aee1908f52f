"""Line dedup, importance resampling and tokenizer alignment against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from linkloom.llm import alignment, linededup, resampling
from tests.llm.test_operators import LONG, ODD, prose

BYTE_LEVEL, PIECE_LEVEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHING = "doc_id bigint, text string, N int, Kept_Text string, __block int, chunk int, rank int, Score double, pos int"


def rows_of(spark, texts, ids=None):
    """Texts with columns whose names operators use inside, in other letters too."""
    rows = [(i, t, 1, "x", 2, 3, 4, 0.5, 6) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, CLASHING)


# --- lines ------------------------------------------------------------------------------


def plain_lines(pairs, least_chars=40, least_documents=5):
    lower = str.maketrans(linededup.CAPITALS, linededup.CAPITALS.lower())
    key = lambda line: line.strip(linededup.BLANKS).translate(lower)
    holders = defaultdict(set)
    for row, (_, text) in enumerate(pairs):
        for line in (text or "").split("\n"):
            holders[key(line)].add(row)
    out = []
    for doc_id, text in pairs:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            found = holders[key(line)]
            greatest = max((pairs[r][0] for r in found if pairs[r][0] is not None), default=None)
            if len(key(line)) < least_chars or len(found) < least_documents or doc_id == greatest:
                kept.append(line)
        out.append((doc_id, text, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LINE = "All rights reserved, see the licence for details"
SHARED = [
    f"a\n {LINE} \nb", f"{LINE.upper()}", f"{LINE}\n{LINE}\n\n", f"x\n{LINE}\r\ny\n", f"\v{LINE}\n", f"{LINE[:39]}\nshort",
    f"{LINE} É", f"{LINE} é", "q" * 40, "Q" * 40, "q" * 40 + "\n" + "q" * 40, "q" * 40, f"{LINE} ", "q" * 39, "\n",
]


def test_lines(spark):
    texts = [*ODD, *SHARED, *[f"{LONG}\n{LINE}"] * 2]
    pairs = [(i, t) for i, t in enumerate(texts)] + [(3, SHARED[0]), (3, SHARED[0]), (None, SHARED[2]), (None, SHARED[2]), (None, None)]
    df = rows_of(spark, [t for _, t in pairs], [i for i, _ in pairs])
    found = linededup.drop_common_lines(df)
    assert [c for c in found.columns if c.lower() == "kept_text"] == ["kept_text"] and "__block" in found.columns
    got = [tuple(r) for r in found.select("doc_id", "text", "kept_text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == sorted(plain_lines(pairs), key=repr)


def test_lines_hot_and_rare_ways_agree(spark, monkeypatch):
    texts = [f"{LINE} {i % 3}\n{prose(i, 12)}\n{LINE}" for i in range(60)] + [prose(i % 7, 20) for i in range(40)]
    pairs = list(enumerate(texts))
    wanted = sorted(plain_lines(pairs), key=repr)
    for hot in (1, 30, 10**9):
        monkeypatch.setattr(linededup, "HOT_LINES", hot)
        found = linededup.drop_common_lines(rows_of(spark, texts)).select("doc_id", "text", "kept_text", "n_lines", "n_dropped")
        assert sorted(map(tuple, found.collect()), key=repr) == wanted


def test_lines_stay_in_the_jvm(spark):
    plan = linededup.drop_common_lines(rows_of(spark, SHARED))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert linededup.drop_common_lines(rows_of(spark, [])).count() == 0
    only_null = linededup.drop_common_lines(spark.createDataFrame([(None, LINE)] * 6, "doc_id bigint, text string"))
    assert [r.n_dropped for r in only_null.collect()] == [0] * 6


# --- resampling --------------------------------------------------------------------------


def plain_features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2) for i in range(len(words) - n + 1)]


def plain_resample(pairs, target):
    s = Counter(b for _, t in pairs for b in plain_features(t)[1])
    t = Counter(b for text in target for b in plain_features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in pairs:
        n_words, found = plain_features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {r: i for i, r in enumerate(enough[: 25 * len(enough) // 100], 1)}
    return [(*r, drawn.get(r)) for r in rows]


def test_running_crcs_give_every_run():
    texts = [*ODD, "Hello, wörld hello", " one  TWO three-four ", "x" * 100_000 + " y " + "z" * 65, "é" * 33 + " a", "\x7f{}", "9 a"]
    runs = resampling.Runs(pa.array(texts))
    for most in (1, 2, 4):
        found, owner = runs.buckets(most, 1 << 31)
        for i, text in enumerate(texts):
            words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
            plain = [zlib.crc32(b" ".join(words[k : k + n])) % (1 << 31) for n in range(1, most + 1) for k in range(len(words) - n + 1)]
            assert sorted(found[owner == i].tolist()) == sorted(plain)


def test_shift_is_the_crc_of_a_longer_text():
    sizes = np.array([0, 1, 63, 64, 65, 4095, 70_001])
    crcs = np.array([zlib.crc32(b"prefix")] * len(sizes), np.uint32)
    behind = np.array([zlib.crc32(b"prefix" + b"q" * n) for n in sizes], np.uint32)
    assert resampling.substring_crc(crcs, behind, sizes).tolist() == [zlib.crc32(b"q" * n) for n in sizes]


def test_resampling(spark):
    texts = [*ODD, *(prose(i, 15 + i % 12) for i in range(120)), *(prose("t", 30),) * 3, "Ärger und Größe " * 12]
    target = [prose(i, 40) for i in range(5)] + [None, ""]
    pairs = list(enumerate(texts))
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = resampling.resample(rows_of(spark, texts), items).collect()
    assert sorted(map(tuple, got)) == sorted(plain_resample(pairs, target))
    assert max(r.rank or 0 for r in got) == sum(r.n_words >= 20 for r in got) * 25 // 100
    odd = spark.createDataFrame([(None, prose(1, 30)), (7, prose(1, 30)), (7, prose(1, 30)), (None, None)] * 3, "doc_id bigint, text string")
    rows = resampling.resample(odd, items).collect()
    assert sorted(r.rank for r in rows if r.rank) == [1, 2] and len(rows) == 12
    assert resampling.resample(rows_of(spark, []), items).count() == 0
    assert resampling.resample(rows_of(spark, texts), items.limit(0)).count() == len(texts)


# --- alignment ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    byte_level = Tokenizer.from_file(BYTE_LEVEL)
    byte_level.encode_special_tokens = True
    return byte_level, sentencepiece.SentencePieceProcessor(model_file=PIECE_LEVEL)


def plain_alignment(texts, tokenizers):
    """Whole texts through the libraries, groups by the set of common ends."""
    byte_level, pieces = tokenizers
    shown = {**{chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    spare = iter(range(256, 512))
    shown |= {chr(next(spare)): b for b in range(256) if b not in shown.values()}
    docs = []
    for text in texts:
        groups = []
        if text:
            coded = byte_level.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(shown[c] for c in token)) for i, token in zip(coded.ids, coded.tokens)]
            b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode())
                 for i in pieces.encode(text)]
            whole = (" " + text).encode()
            if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b):
                ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (a, b)]
                shared = np.array(sorted(ends[0] & ends[1]))
                groups = [([], []) for _ in shared]
                for side, tokens in enumerate((a, b)):
                    at = 0
                    for i, t in tokens:
                        at += len(t)
                        groups[np.searchsorted(shared, at)][side].append(i)
        docs.append(groups)
    count = Counter(pair for groups in docs for pair in {(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in enumerate(docs):
        links = [(x, y) for a, b in groups for x in a for y in b]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), told))
    return out


MIXED = [
    *ODD, " leading", "trailing ", "two  blanks   three", "a\n\nb\tc\r\n d", "<|endoftext|> and <s> </s> <unk> <0x0A>", "a▁b", "▁", "😀😀 👩‍👩‍👧 x",
    "日本語のテキスト 中文 한국어", "  x  y 　z", "it's we'll I'd 3rd x1y2", "ﬁ Å Å", "a" * 3000, "1234567890 " * 20,
    "ab\x00c \x1c d", "don't’stop — “quoted”", "x  y  z", "Ünïcödé " * 5, " ", "\n", "é",
]


def test_alignment(spark, tokenizers, monkeypatch):
    texts = [t for t in MIXED if t != LONG] + [prose(i, 30) for i in range(20)] + [LONG[:5000]]
    wanted = plain_alignment(texts, tokenizers)
    assert any(r[3] for r in wanted) and any(r[1] == 0 and texts[r[0]] for r in wanted)
    df = rows_of(spark, texts)
    assert sorted(map(tuple, alignment.align(df, BYTE_LEVEL, PIECE_LEVEL).collect())) == wanted
    made = alignment.chunks(df, BYTE_LEVEL, PIECE_LEVEL, size=200)
    assert made.count() > 4
    small = alignment.chunks
    monkeypatch.setattr(alignment, "chunks", lambda *args: small(*args, size=200))
    assert sorted(map(tuple, alignment.align(df, BYTE_LEVEL, PIECE_LEVEL).collect())) == wanted
    assert alignment.align(rows_of(spark, []), BYTE_LEVEL, PIECE_LEVEL).count() == 0
    assert alignment.align(rows_of(spark, [None, ""]), BYTE_LEVEL, PIECE_LEVEL).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_division_finds_exactly_the_shared_cuts():
    random = np.random.default_rng(3)
    ends = [[], []]
    first, base, wanted = [[0], [0]], 0, []
    for text in range(60):
        size = int(random.integers(0, 400))
        sides = [np.unique(np.append(random.integers(1, size + 1, int(size * share)), size)) if size else np.zeros(0, int)
                 for share in (random.choice([0.02, 0.3, 0.9]), random.choice([0.02, 0.3, 0.9]))]
        shared = np.intersect1d(*sides)
        wanted += (base + shared).tolist()
        for side in range(2):
            ends[side] += (base + sides[side]).tolist()
            first[side].append(len(ends[side]))
        base += size
    a, b = (np.array(e) for e in ends)
    found = alignment.divide(a, b, *(np.array(f) for f in first))
    assert a[found[:, 1] - 1].tolist() == b[found[:, 3] - 1].tolist() == wanted
    assert found[1:, 0].tolist() == found[:-1, 1].tolist() and found[1:, 2].tolist() == found[:-1, 3].tolist()


def test_long_stretches_without_shared_cuts_are_divided_fast():
    n = 200_000
    a, b = np.arange(2, 2 * n + 1, 2), np.append(np.arange(1, 2 * n - 1, 2), 2 * n)
    assert len(alignment.divide(a, b, np.array([0, n]), np.array([0, len(b)]))) == 1
    b = np.sort(np.concatenate([b, a[n // 2 : n // 2 + 1000]]))  # cuts crowded at one place
    assert len(alignment.divide(a, b, np.array([0, n]), np.array([0, len(b)]))) == 1001
