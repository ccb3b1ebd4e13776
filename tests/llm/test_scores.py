"""Features and scores of the two classifiers against plain Python, character counts, and url rules that are many or have many labels."""

import math
import random
import time

import numpy as np

from trackloom.llm import quality, toxicity, url_filter
from trackloom.llm.textbytes import MULT

MASK = (1 << 64) - 1
TEXTS = ["", " ", "One", "one ONE one", "Café 12 naïve!", "a b\tc\nd  e", "$$$ BUY now!!! n0w 99", "x" * 300, "Hello, world. " * 40, "日本 語 é.", "tail word", "v1ll41n l33t w o r d"]


def scrambled(h):
    h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & MASK
    h = (h ^ (h >> 32)) * 0xCA5A826395121157 & MASK
    return h ^ (h >> 29)


def word_hash(w):
    return scrambled(sum((b + 1) * pow(int(MULT), k, 1 << 64) for k, b in enumerate(w)) & MASK)


def is_letter(b):
    return 97 <= (b | 32) <= 122 and b < 128 or b >= 128


def shape(w, again):
    n_upper, n_letter = sum(65 <= b <= 90 for b in w), sum(map(is_letter, w))
    n_digit = sum(48 <= b <= 57 for b in w)
    case = 0 if n_upper == 0 else 1 if n_upper == 1 else 3 if 2 * n_upper >= n_letter else 2
    last = 0 if is_letter(w[-1]) else w[-1]
    code = ((((again * 8 + min(int(math.log2(len(w))), 7)) * 4 + case) * 4 + min(len(w) - n_letter - n_digit, 3)) * 2 + (n_digit > 0)) * 256 + last
    return scrambled(code + 1)


def grams(hashes, n):
    for k in range(len(hashes) - n + 1):
        h = 0
        for v in hashes[k : k + n]:
            h = (h * int(MULT) + v) & MASK
        yield scrambled(h)


def quality_features(text):
    """Lists of buckets, one for each kind."""
    raw = text.encode().split()
    words = [word_hash(w.lower()) for w in raw]
    shapes = [shape(w, int(k > 0 and words[k] == words[k - 1])) for k, w in enumerate(raw)]
    out = []
    for kind, (h, n) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        out.append([scrambled((g + kind) & MASK) >> (64 - quality.BITS) or 1 for g in grams(h, n)])
    return out


def test_quality_features_and_score(spark):
    found = quality.features([t.encode() for t in TEXTS])
    for k, t in enumerate(TEXTS):
        for (bucket, bounds), want in zip(found, quality_features(t)):
            assert bucket[bounds[k] : bounds[k + 1]].tolist() == want, t
    weights = np.random.default_rng(5).normal(size=quality.SIZE).astype(np.float32).astype(np.float64)
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id int, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    for k, t in enumerate([*TEXTS, ""]):
        z = weights[quality.BIAS] + sum(quality.SCALE * sum(weights[b] for b in kind) / len(kind) for kind in quality_features(t) if kind)
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9
    for t in TEXTS:  # what training sees of a text is what its score sums
        i, x = quality.example(t.encode())
        z = weights[i] @ x
        assert abs(z - quality.margins([t.encode()], weights)[0]) < 1e-3 * max(1, abs(z))


def toxicity_features(text):
    raw, word, words = text.encode(), b"", []
    for b in [*raw, 32]:
        b = b + 32 if 65 <= b <= 90 else b
        if 97 <= b <= 122 or b >= 128:
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    hashes = [scrambled((word_hash(w) + 1) & MASK) for w in words]
    hashes += [scrambled((word_hash(w[:n]) + n) & MASK) for n in (4, 5, 6) for w in words if len(w) > n]
    return {h >> (64 - toxicity.BITS) or 1 for h in hashes}


def test_toxicity_features_and_margins():
    texts = [t.encode() for t in TEXTS]
    bucket, own = toxicity.features(texts)
    weights = np.random.default_rng(6).normal(size=toxicity.SIZE)
    got = toxicity.margins(texts, weights)
    for k, t in enumerate(TEXTS):
        want = toxicity_features(t)
        assert set(bucket[own == k].tolist()) == want, t
        assert abs(got[k] - weights[toxicity.BIAS] - sum(weights[b] for b in want)) < 1e-9


def test_toxicity_score_is_the_sum_of_learnt_features(spark):
    r = random.Random(3)
    plain = "the old stone bridge over green water keeps many quiet stories for patient people".split()
    rows = [(k, " ".join([*r.sample(plain, 8), *(["scoundrel"] if k % 4 == 0 else []), r.choice(plain)])) for k in range(120)]
    docs = spark.createDataFrame([*rows, (500, "the 5c0undr3l sits"), (501, "the stone sits"), (502, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, labels, lambda i: i < 0).collect()}
    counts = np.zeros(toxicity.LETTERS**4, dtype=np.int64)
    for x in toxicity.character_counts(docs).collect():
        counts[x.gram] = x.n
    restored = toxicity.Restorer(counts).texts([b"the 5c0undr3l sits"])[0]
    assert restored == b"the scoundrel sits"
    assert got[500] > 0.5 > got[501] and got[502] == min(got.values())
    same = toxicity_features("the scoundrel sits") - toxicity_features("the stone sits")
    toxic = {x for k, t in rows if k % 4 == 0 for x in toxicity_features(t)}
    assert same & toxic  # the learnt features are the restored word's


def test_characters_count_once_whatever_their_bytes(spark):
    texts = ["café", "日本語 ab", "née — x", None, ""]
    want = {}
    for t in texts:
        s, out = " " + (t or "") + " ", []
        for c in s:
            v = ord(c.lower()) - 96 if c.isascii() and c.isalpha() else toxicity.OTHER if ord(c) >= 128 else toxicity.SPACE
            if v != toxicity.SPACE or not out or out[-1] != toxicity.SPACE:
                out.append(v)
        for a, b, c, d in zip(out, out[1:], out[2:], out[3:]):
            g = ((a * 28 + b) * 28 + c) * 28 + d
            want[g] = want.get(g, 0) + 1
    found = [toxicity.character_counts(spark.createDataFrame([(t,)], "text string")).collect() for t in texts]
    got = {}
    for rows in found:
        for x in rows:
            got[x.gram] = got.get(x.gram, 0) + x.n
    assert got == want
    lattice, others = toxicity.lattice("café")
    assert len(lattice) == 4 and others == ["é"]


def test_many_rules_are_shuffled_with_equal_results(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("Example.com", "/en/7", "allow"), ("example.com", "/en/7", "block"), ("a.b.c.d", None, "block"), ("", "/x", "block"), (None, "/y", "block"), (".org", "/", "block")], "host string, path string, verdict string")
    hosts = ["example.com", "x.example.com", "a.b.c.d", "z.a.b.c.d", "b.c.d", "com", "a..org", "x.org", "com.", "."]
    pages = spark.createDataFrame([(k, f"http://{hosts[k % 10]}/en/{k % 13}") for k in range(400)], "page_id long, url string")
    one = sorted(map(tuple, url_filter.with_verdicts(pages, rules).collect()))
    two = url_filter.with_verdicts(pages, rules, broadcast_rules=0)
    assert sorted(map(tuple, two.collect())) == one

    def judge(host, path):
        labels, fits = host.split("."), []
        for rh, rp, v in [("com", "/en/", "block"), ("example.com", "/en/7", "block"), ("a.b.c.d", "", "block"), (".org", "/", "block")]:
            n = len(rh.split("."))
            if n <= len(labels) and ".".join(labels[-n:]) == rh and path.startswith(rp):
                fits.append((len(rh + rp), rh + rp, v))
        return (max(fits)[1:] if fits else (None, "allow"))

    assert [(r[3], r[4]) for r in one] == [judge(r[1], r[2]) for r in one]


def test_host_of_many_labels(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("a.com", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "com/en/1"), (2, "http://" + "a." * 20_000 + "org/en/1")], "page_id long, url string")
    start = time.time()
    assert [(r.page_id, r.rule) for r in url_filter.with_verdicts(pages, rules).orderBy("page_id").collect()] == [(1, "com/en/"), (2, None)]
    assert time.time() - start < 20
