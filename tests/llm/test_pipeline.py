"""Each stage of the pipeline against brute force on what the stage before kept."""

import base64
import random
import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_edges import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, d = random.Random(12), tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    passage, item = words(500, 70), words(600, 40)
    for i in range(120):
        w = words(1000 + i, r.randrange(40, 200), 3000)
        bad = i % 8 == 0
        if bad:
            w = [x.upper() + "!!" for x in w]
        if i % 9 == 4 and not bad:
            w[10:10] = passage
        if i % 30 == 7:
            w = w[:100] + item
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 0 if bad else 1, 0))
    for i in range(120, 150):
        w = rows[i - 119][1].split()
        w[r.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w), "en", "copy", 0))
    rows += [(150, None, None, None, None), (151, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def brute_near(rows):
    sets = {}
    for i, t in rows.items():
        w = lower_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def brute_cut(rows, window=13):
    seen, out = {}, {}
    split = {i: [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for i, t in rows.items()}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(x for _, x in w[k : k + window])
            seen[key] = min(i, seen.get(key, i))
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(x for _, x in w[k : k + window])] < i for j in range(window)}
        ends = [s for s, _ in w[1:]] + [len(rows[i] or "")]
        out[i] = rows[i] if not gone else rows[i][: w[0][0]] + "".join(rows[i][s:e] for k, ((s, _), e) in enumerate(zip(w, ends)) if k not in gone)
    return out


def brute_clean(rows, items, window=13):
    windows = set()
    for t in items:
        w = lower_words(t)
        windows |= {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w else set()
    kept = {}
    for i, t in rows.items():
        w = lower_words(t)
        hit = set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept[i] = t
    return kept


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, tables)
    kept = read(good)
    assert good.columns == columns and set(kept) == {i for i in range(152) if not (i < 120 and i % 8 == 0) and not (i >= 120 and (i - 119) % 8 == 0 and i < 150)}
    docs = spark.createDataFrame(good.collect(), good.schema)
    near = stages["n-gram Jaccard join"](spark, docs, tables)
    assert near.columns == columns and set(read(near)) == brute_near(kept)
    docs = spark.createDataFrame(near.collect(), near.schema)
    cut = stages["substring dedup"](spark, docs, tables)
    before = read(docs)
    assert cut.columns == columns and read(cut) == brute_cut(before) and read(cut) != before
    docs = spark.createDataFrame(cut.collect(), cut.schema)
    clean = stages["benchmark decontamination"](spark, docs, tables)
    want = brute_clean(read(docs), [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()])
    assert clean.columns == columns and read(clean) == want and len(want) < docs.count()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, tables).collect()}
    assert got == {i: len(theirs.encode_ordinary(t or "")) for i, t in want.items()}
