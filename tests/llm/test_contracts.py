"""The opN queries themselves: against their SQL where there is some, else against plain Python; and the pipeline on awkward tables."""

import base64
import hashlib
import itertools
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_edges import words
from trackloom.llm import ftrl, ngram_join, quality, queries, reference_sql, toxicity

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


@needs_tables
@pytest.mark.parametrize("name", sorted(reference_sql.SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want = duck.execute(reference_sql.SQL[name]).df()
    got = queries.queries()[name](spark, SF).select(*want.columns).toPandas()
    assert sorted(tuple(map(plain, r)) for r in got.itertuples(index=False)) == sorted(tuple(map(plain, r)) for r in want.itertuples(index=False))


TEXTS = [(1, "The quick brown fox, it's 12345 o'clock."), (2, None), (3, ""), (4, "日本語 é <|endoftext|> \n\n x"), (5, "same text"), (6, "same text"), (7, "z" * 3000), (8, "b" * 64)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_op1_digests(spark, sf_dir):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, t in TEXTS:
        ids = theirs.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert set(map(tuple, queries.op1_bpe(spark, sf_dir).collect())) == want


def gray_image(raw):
    """Samples of an 8-bit gray PNG without filters, by the format's description."""
    at, data = 8, b""
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        if kind == b"IHDR":
            width, height = int.from_bytes(raw[at + 8 : at + 12], "big"), int.from_bytes(raw[at + 12 : at + 16], "big")
        data += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    lines = zlib.decompress(data)
    assert len(lines) == height * (width + 1)
    return b"".join(lines[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def test_op8_stored_bytes_and_features(spark, sf_dir):
    from trackloom.llm import media
    from trackloom.plans.lineage import shared_dir

    folder = f"{shared_dir(spark)}/media-test-{os.getpid()}"
    media.write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    stored = {r.member.split("/")[1]: bytes(r.media) for r in media.read_archives(spark, folder).collect()}
    got = {r.doc_id: r for r in queries.op8_media(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in TEXTS}
    for i, t in TEXTS:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        file, x = stored[f"id-{i}.png"], list(payload)
        assert gray_image(file) == payload
        mean = sum(x) / len(x)
        spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        cuts = [k * len(x) // 64 for k in range(64)] + [len(x)]
        bits = "".join("1" if sum(x[a:b]) / (len(x) // 64) > mean else "0" for a, b in zip(cuts, cuts[1:]))
        want = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), f"{mean:.3f} {spread:.3f} {int(bits, 2):016x}")
        assert tuple(got[i]) == want
    assert tuple(got[5])[1:] == tuple(got[6])[1:]


def test_viterbi_finds_the_cheapest_letters():
    r = random.Random(8)
    counts = np.zeros(toxicity.LETTERS**4, dtype=np.int64)
    text = "the villain runs to the old stone bridge and the scoundrel sits still "
    symbols = [0 if c == " " else ord(c) - 96 for c in text * 3]
    for a, b, c, d in zip(symbols, symbols[1:], symbols[2:], symbols[3:]):
        counts[((a * 28 + b) * 28 + c) * 28 + d] += 1
    model = toxicity.CharacterModel(counts)

    def cost(path, extra):
        total, at = extra, 0
        for s in [*path, 0]:
            total += float(model.cost[at * 28 + s])
            at = (at * 28 + s) % 28**3
        return total

    for word in ["v1ll41n", "$c0undr3l", "st1ll", "br1dg3", "t.h.e", "0ld", "aabb1", "x9z", *("".join(r.choice("abt1034.$") for _ in range(6)) for _ in range(20))]:
        lattice, _ = toxicity.lattice(word)
        every = [(cost([s for symbols, _ in way for s in symbols], sum(e for _, e in way)), [s for symbols, _ in way for s in symbols]) for way in itertools.product(*lattice)]
        got = model.decode(lattice)
        assert any(path == got and c <= min(every)[0] + 1e-4 for c, path in every), word


def test_ftrl_follows_the_update_rule():
    r = np.random.default_rng(2)
    model = ftrl.Ftrl(6, alpha=0.3, beta=1.0, l1=0.05, l2=1e-3)
    z, n = [0.0] * 6, [0.0] * 6
    weight = lambda i: 0.0 if abs(z[i]) <= 0.05 else (math.copysign(0.05, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / 0.3 + 1e-3)
    for _ in range(60):
        i = np.sort(r.choice(6, 3, replace=False))
        x, y = r.random(3), float(r.integers(0, 2))
        p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in zip(i, x))))
        for k, v, w in [(int(k), v, weight(k)) for k, v in zip(i, x)]:
            g = (p - y) * v
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.3 * w
            n[k] += g * g
        model.update(i, x, y)
    assert np.allclose(model.weights(), [weight(k) for k in range(6)])


def test_copies_of_a_labelled_text_count_once(spark):
    rows = [(1, "good words here")] * 50 + [(k, f"text {k} of the rest") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)] * 2, "doc_id long, quality int")
    found = quality.training_examples(docs, labels, "quality", lambda i: i < 0, 20, quality._examples)
    assert found.count() == 20
    assert quality.training_examples(docs, labels, "quality", lambda i: i < 0, 1000, quality._examples).count() == 29


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _id int, _hash int, _spans int, _key_id int, _score int, score int, row int, key int, spans int, hits int, items int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(1, 12)) for i, t in rows], CLASHING)


def test_near_copies_without_ids(spark):
    base = words(70, 80)
    edited = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (5, 40)]
    rows = [(None, " ".join(base)), (None, edited[0]), (None, edited[0]), (7, " ".join(words(71, 50))), (7, " ".join([*words(71, 50), "more"])), (8, " ".join(words(72, 50))), (None, None), (None, None)]
    kept = ngram_join.keep_first_of_each(clashing(spark, rows))
    assert kept.columns == clashing(spark, rows).columns
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "8", "None", "None", "None"] and {r._id for r in got} == {1}
    alone = ngram_join.keep_first_of_each(clashing(spark, [*rows, (3, edited[1])])).collect()
    assert sorted(str(r.doc_id) for r in alone) == ["3", "7", "8", "None", "None"]
    named = ngram_join.near_duplicates(spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string"))
    assert {r.class_id for r in named.where("doc_id = '7'").collect()} == {"7"}


def test_links_at_many_hubs_are_counted_once(spark):
    r, base = random.Random(31), words(32, 90)
    rows = []
    for i in range(40):
        w = base[:]
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"edit{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(86)} for t, i in first.items()}
    want = {i: sum(1 for j, s in sets.items() if j != first[t] and 5 * len(s & sets[first[t]]) >= 4 * len(s | sets[first[t]])) for i, t in rows}
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), max_hashes=400, recall=0.99999999, block_rows=9).collect()
    assert {x.doc_id: x.n_links for x in got} == want and max(want.values()) >= 7


def test_pipeline_on_awkward_tables(spark, tmp_path):
    rows = [(k, " ".join(words(800 + k, 60, 900))) for k in range(30)] + [(None, " ".join(words(800, 60, 900))), (None, None), (None, None), (4, ""), (5, " ".join(words(805, 60, 900)))]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this"), (None, None)], "item_id long, text string")
    for name, some in (("all", clashing(spark, rows)), ("none", clashing(spark, rows).limit(0))):
        d = str(tmp_path / name)
        some.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == clashing(spark, rows).columns
        left = corpus_pipeline.run(spark, d).collect()
        assert len(left) == (33 if name == "all" else 0)
    assert sorted(str(r.doc_id) for r in left) == []
    twice = quality.score(clashing(spark, rows[:3]), np.zeros(quality.SIZE))
    assert twice.columns.count("score") == 1 and {r.score for r in twice.collect()} == {0.5}
