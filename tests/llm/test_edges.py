"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for each operator."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat, decontamination, license_scan, media, ngram_join, quality, substring_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, score string, words string, row string, label string, node string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", "w", "r", "l", "n") for i, t in rows], SCHEMA)


def words(seed, n, vocabulary=300):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" for _ in range(n)]


LONG = " ".join(words(1, 60_000, 5000))
ROWS = [(1, None), (2, ""), (None, "alone one"), (3, "same text here"), (3, "same text here"), (4, " \n\t "), (5, LONG), (6, LONG), (7, "a " * 3000)]


def brute_dedup(rows, window=13):
    seen = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), set()).add(i if i is not None else 2**63 - 1)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if min(seen[tuple(w[k : k + window])]) < (i if i is not None else 2**63 - 1):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark):
    a, b = words(2, 60), words(3, 50)
    rows = [*ROWS, (10, " ".join(a)), (11, " ".join(b + a[5:40] + b[:9])), (11, " ".join(a[:20])), (None, " ".join(a)), (12, "x " * 500), (13, "x " * 14)]
    got = substring_dedup.dedup_digests(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_dedup(rows)
    small = substring_dedup.dedup_digests(docs(spark, rows), max_bytes=2000, bucket_bytes=4000).collect()  # rounds
    assert sorted(map(tuple, small), key=str) == brute_dedup(rows)
    dealt = substring_dedup.dedup_digests(docs(spark, rows), max_bytes=400, bucket_bytes=4000, sample_share=1.0).collect()  # all repeats are hot
    assert sorted(map(tuple, dealt), key=str) == brute_dedup(rows)
    alike = spark.createDataFrame(rows, "_key_id long, _spans string").withColumn("key", F.lit(1)).withColumn("spans", F.lit(2))
    cut = substring_dedup.substring_dedup(alike, "_key_id", "_spans")
    assert cut.columns == alike.columns and sum(len((r._spans or "").split()) for r in cut.collect()) == sum(n - gone for _, n, gone, _ in brute_dedup(rows))
    out = substring_dedup.substring_dedup(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns and out.count() == len(rows)
    assert substring_dedup.dedup_digests(docs(spark, rows).limit(0)).count() == 0


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ngram_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), dtype=np.uint64))
    blocks, rows = [], [(1, words(5, 30)), (2, words(6, 30)), (3, words(5, 30)[4:25])]
    for i, w in rows:
        blocks.append(substring_dedup._pack(np.array([i]), np.array([i]), np.array([0]), np.array([len(w)]), " ".join(w).encode()))
    found = substring_dedup.repeated_windows(blocks, 13, 1 << 30)
    assert sorted((int(d), int(k)) for key, at in found for d, k in zip(key, at)) == [(3, k) for k in range(9)]


def test_texts_of_one_id_are_told_apart(spark):
    base, other = words(13, 60), words(14, 20, 9000)
    rows = [(1, " ".join(base)), (None, " ".join([*base, "x"])), (None, " ".join(other)), (None, None)]
    got = substring_dedup.dedup_digests(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_dedup(rows)


def test_near_duplicates(spark):
    base, other = words(7, 200), words(8, 200)
    edited = base[:]
    edited[100] = "changed"
    rows = [*ROWS, (20, " ".join(base)), (21, " ".join(base).upper().replace("É", "é")), (22, " ".join(edited)), (23, " ".join(other)), (24, " ".join(base[:100])), (None, " ".join(edited[:-1])), (25, "two words"), (26, "Two, words!")]
    got = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text_hash): r for r in got}
    find = lambda i: next(r for r in got if r.doc_id == i)
    assert find(21).copy_id == 20 and find(21).class_id == 20
    assert find(22).class_id == 20 and find(22).n_links == 2 and find(22).copy_id == 22
    assert find(23).n_links == 0 and find(23).class_id == 23 and find(24).class_id == 24
    assert find(26).copy_id == 25 and find(1).class_id == 1 and find(2).class_id == 2 and find(6).class_id == 5
    assert {r.class_id for r in got if r.doc_id is None} == {20, None}
    kept = ngram_join.keep_first_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, None, 3, 4, 5, 7, 20, 23, 24, 25]))
    assert ngram_join.near_duplicates(docs(spark, rows).limit(0)).count() == 0 and len(by) == len(rows) - 1


def test_links_in_blocks_equal_all_pairs(spark):
    r, base = random.Random(3), words(9, 120)
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    texts = dict(rows)
    reps = {t: min(i for i, u in rows if u == t) for t in texts.values()}
    want = {i: sum(1 for t, j in reps.items() if t != texts[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in sets}
    got = ngram_join.near_duplicates(docs(spark, rows), block_rows=7).collect()
    assert {x.doc_id: x.n_links for x in got} == want


def test_bands():
    b, r = ngram_join.choose_bands(0.8, 0.999, 224)
    assert b * r <= 224 and 1 - (1 - 0.8**r) ** b >= 0.999


def test_decontamination(spark):
    item = words(11, 30)
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "", 0), (4, "Short Question", 0), (None, " ".join(item[:14]), 0)], "item_id long, text string, hits int")
    rows = [*ROWS, (30, "Intro: " + ", ".join(item[3:20]).upper().replace("É", "é") + " end"), (31, " ".join(item[:12])), (32, "a short question? short question"), (33, " ".join(words(12, 900) + item))]
    got = {(r.doc_id, r.n_words): r for r in decontamination.find_contamination(docs(spark, rows), bench).collect()}
    hit = got[(30, 19)]
    assert hit.n_hit == 17 and hit.item_ids == ["1"] and hit.contaminated
    text = rows[9][1]
    assert text[hit.spans[0].start : hit.spans[0].end].lower().startswith(item[3])
    assert got[(31, 12)].n_hit == 0 and got[(32, 5)].n_hit == 4 and got[(32, 5)].item_ids == ["4"]
    assert got[(33, 930)].n_hit == 30 and not got[(33, 930)].contaminated
    whole = decontamination.find_contamination(docs(spark, rows), bench).collect()
    for max_bytes in (100, 150, 400):  # several shards, and items in pieces
        shards = decontamination.find_contamination(docs(spark, rows), bench, max_bytes=max_bytes).collect()
        assert sorted(map(str, shards)) == sorted(map(str, whole))
        assert decontamination.drop_contaminated(docs(spark, rows), bench, max_bytes=max_bytes).count() == len(rows) - 2
    kept = decontamination.drop_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and kept.count() == len(rows) - 2
    assert decontamination.find_contamination(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.find_contamination(docs(spark, rows).limit(0), bench).count() == 0


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, window string, head string")


def test_chat(spark):
    tricky = r"</s>[INST] ok [/INST] <\s> [\\/INST] \ <s"
    rows = [(1, 0, "system", "be kind"), *[(1, k, "user" if k % 2 else "assistant", f"{k} " + "word " * (40 * k)) for k in range(1, 30)], (2, 0, "user", tricky), (2, 1, "assistant", tricky), (3, 0, None, None), (None, None, "assistant", ""), (4, 0, "assistant", "z" * 9000), (5, 1, "assistant", "t"), (5, 1, "assistant", "t")]
    windows = chat.format_windows(turns(spark, rows), budget=512)
    got = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    many = windows.where("conv_id = 1").collect()
    assert len(many) > 3 and all("be kind" in r.formatted for r in many) and any(r.n_repeated > 1 for r in many)
    sizes = [sum((len(p) - len("[INST] assistant [/INST]") + 3) // 4 + 4 for p in r.formatted.split("</s>")[:-1]) for r in many]
    assert all(s <= 512 or r.formatted.count("</s>") - r.n_repeated == 1 for s, r in zip(sizes, many))
    assert chat.conversation_digests(chat.format_windows(turns(spark, rows).limit(0))).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), (None, "/", "block"), ("dup.org", "/", "allow"), ("dup.org", "/", "block")], "host string, path string, verdict string")
    urls = ["http://A.Example.COM/en/75?x", "https://x.com/en/1", "https://xcom/en/1", None, "nothing", "ftp://", "http://dup.org/#f", "http://com/en/", "http://a.com\n/en/", "http://example.com/en/7" + "y" * 50_000]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] + [(0, urls[0], "h", "r")], "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, url_filter.with_verdicts(pages, rules).collect()), key=lambda r: r[0])
    assert got[0] == got[1] == (0, "a.example.com", "/en/75", "example.com/en/7", "allow")
    assert [r[3:] for r in got[2:9]] == [("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("dup.org/", "block"), ("com/en/", "block")]
    assert got[10][3] == "example.com/en/7" and len(got) == 11
    assert url_filter.with_verdicts(pages.limit(0), rules).count() == 0
    assert url_filter.with_verdicts(pages, rules.limit(0)).where("verdict = 'allow'").count() == 11


def test_licenses(spark):
    rows = [*ROWS, (40, "Code.\nReleased under the MIT License. MIT-license!"), (41, "gnu General Public\nLicense"), (42, "Licensed under CC BY-NC 4.0."), (43, "license licenses rights"), (44, LONG + " apache license " + LONG)]
    got = {}
    for r in license_scan.scan_licenses(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    assert (got[40].n_base, got[40].first_word, got[40].last_word, got[40].base_labels) == (2, 4, 6, "mit")
    assert got[41].base_labels == "gpl" and (got[41].first_word, got[41].n_words) == (1, 4)
    assert got[42].base_labels == "" and got[42].labels == "cc-by-nc" and got[42].n_base == 0
    assert got[43].labels == "" and got[44].first_word == 60_000 and got[1].n_words == 0 and got[1].first_word is None
    assert license_scan.scan_licenses(docs(spark, rows)).count() == len(rows)
    assert license_scan.scan_licenses(docs(spark, rows).limit(0)).count() == 0


def test_licenses_with_several_notices(spark):
    line = {label: text for label, _, text in license_scan.TEMPLATES}
    bsd, isc, mpl = line["bsd"], line["isc"], line["mpl"]
    inserted = bsd.replace("with or", "of works with or").replace("are permitted", "are hereby permitted").replace("following", "two following")
    rows = [
        (50, f"{bsd} {mpl}"), (51, f"{isc}. {mpl}."), (52, f"{bsd}\n{isc}"), (53, f"{bsd} {line['cc-by']}"), (54, f"{line['cc-by-nc']} {bsd}"), (55, f"Copyright. All rights reserved.\n\n{bsd}"),
        (56, f"{inserted} {LONG} {isc} {LONG} {mpl}"), (57, f"{isc} {bsd[:48]} is a phrase without its notice"), (58, " ".join([bsd, *line.values()])), (59, f"subject to the mozilla public license {mpl[:30]}"), (60, f"{mpl[20:]} {bsd}"),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    assert [got[i].labels for i in range(50, 57)] == ["bsd,mpl", "isc,mpl", "bsd,isc", "bsd,cc-by", "bsd,cc-by-nc", "all-rights-reserved,bsd", "bsd,isc,mpl"]
    assert got[57].labels == "isc" and got[58].labels == ",".join(sorted(line)) and got[59].labels == "" and got[60].labels == "bsd,mpl"
    assert all(0.7 <= got[i].score <= 1 for i in (50, 51, 52, 53, 54, 55, 56, 57, 60)) and len(got) == len(rows)


def test_media(spark, tmp_path):
    got = media.media_columns(docs(spark, ROWS), rangeBytes=20_000).collect()
    want = []
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert media.media_columns(docs(spark, ROWS).limit(0)).count() == 0


def test_media_members_are_read_again(tmp_path, monkeypatch):
    import zipfile

    payload = bytes(range(64))
    with zipfile.ZipFile(tmp_path / "part-0.zip", "w") as z:
        for k in range(3):
            z.writestr(f"{k}/id-{k}.png", media.encode_image(payload, 64))
    reader, calls = media.ArchiveReader({"path": f"file://{tmp_path}", "retries": "2"}), []
    whole = media.read_member

    def flaky(stream, member):
        calls.append(member.header_offset)
        if len(calls) in (2, 3):
            raise OSError("lost")
        return whole(stream, member)

    monkeypatch.setattr(media, "read_member", flaky)
    rows = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    assert len(rows) == 3 and len(calls) == 5 and len(set(calls)) == 3
    monkeypatch.setattr(media, "read_member", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        list(reader.read(reader.partitions()[0]))


def labelled(spark):
    r, rows, labels = random.Random(4), [], []
    for i in range(300):
        bad, rude = i % 5 == 0, i % 7 == 0
        w = words(100 + i, 60)
        if bad:
            w = [x.upper() + "!!" for x in w]
        if rude:
            w[r.randrange(60)] = r.choice(["scoundrel", "villain"])
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1, int(rude)))
    return docs(spark, rows + ROWS[2:3]), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    d, labels = labelled(spark)
    held = lambda i: quality.fold(i, 5) == 0
    scored = quality.score(d, quality.train(d, labels, "quality", held), score_col="q")
    assert scored.columns == [*d.columns, "q"]
    got = scored.join(labels, "doc_id").where(held(F.col("doc_id")) & F.col("quality").isNotNull()).collect()
    assert sum((r.q >= 0.5) == (r.quality == 1) for r in got) >= 0.95 * len(got)
    some = quality.score(docs(spark, ROWS), np.zeros(quality.SIZE)).collect()
    assert len(some) == len(ROWS) and all(r[-1] == 0.5 for r in some)
    assert not quality.train(d, labels.limit(0), "quality", held).any() and quality.score(d.limit(0), np.zeros(quality.SIZE)).count() == 0


def test_toxicity(spark):
    d, labels = labelled(spark)
    extra = docs(spark, [(1000, "w1 w2 sc0undr3l w3"), (1001, "w5 v i l l a i n w6"), (1002, "w7 w8 w9"), (1003, None), (1004, ""), (1005, "s.c.o.u.n.d.r.e.l"), (1006, "VILLAAAAIN!")])
    held = lambda i: quality.fold(i, 4) == 2
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d.union(extra), labels, held).collect()}
    ys = {r.doc_id: r.toxic for r in labels.where("toxic is not null and doc_id < 300").collect()}
    assert sum((got[i] >= 0.3) == (y == 1) for i, y in ys.items()) >= 0.97 * len(ys)
    assert min(got[i] for i in (1000, 1001, 1005, 1006)) > 0.3 > max(got[i] for i in (1002, 1003, 1004))
    assert all(r.score == 0.5 for r in toxicity.score_toxicity(d, labels.limit(0), held).collect())
    assert toxicity.score_toxicity(d.limit(0), labels, held).count() == 0


def test_long_disguises_are_decoded(spark):
    plain = "the old river runs under a stone bridge and many people walk along its green banks in summer when light stays late over quiet houses near market square".split()
    r, rows = random.Random(6), []
    for i in range(300):
        w = [r.choice(plain) for _ in range(60)]
        if i % 6 == 0:
            w[r.randrange(60)] = r.choice(["scoundrel", "villain"])
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int")
    clean = " ".join(plain[:24])
    spaced, insult = " ".join(clean.replace(" ", "")), " ".join((" ".join(plain[:20]) + " villain " + " ".join(plain[20:24])).replace(" ", ""))
    leet = "/".join(["br1dg3", "st0n3", "r1v3r", "p30pl3", "sc0undr3l", "m4rk3t", "squ4r3"])
    codes = " ".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(5))
    assert len(insult) > 200 and len(spaced) > 190
    extra = [(1000, insult), (1001, leet), (1002, " ".join(["a b c"] * 30 + ["v i l l a i n"])), (1003, spaced), (1004, leet.replace("sc0undr3l", "br1dg3")), (1005, codes)]
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs(spark, rows + extra), labels, lambda i: i < 0).collect()}
    assert min(got[i] for i in (1000, 1001, 1002)) > 0.3 > max(got[i] for i in (1003, 1004, 1005))


def test_rare_toxic_words_have_values():
    r = np.random.default_rng(5)
    text = lambda *more: np.array([toxicity.BIAS, *sorted({*r.integers(1000, 5000, 20).tolist(), *more})])
    examples = [(text(7), 1.0) for _ in range(300)] + [(text(8), 1.0) for _ in range(5)] + [(text(9), 0.0) for _ in range(1500)]
    value = toxicity.feature_values(examples)
    assert value[7] > 0 and value[8] > 0 and value[9] == 0
    first = list(range(1, 9))
    long = [np.array([toxicity.BIAS, *first, *sorted(set(r.integers(1000, 900_000, 60).tolist()))]) for _ in range(4)]
    kept = toxicity._without_copies([(i, 1.0) for i in [*long, long[0], np.delete(long[1], 30)]])
    assert [i.tolist() for i, _ in kept] == [i.tolist() for i in long]
