"""License scan, line dedup, BPE, MPEG audio, packing and toxicity: brute force, round trips, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import backtracking_bpe, best_two_fit, license_scan, mpeg_audio, pu_toxicity, template_dedup

ODD = [(1, None), (2, ""), (3, "  \n "), (4, "MIT License, the mit-license: MIT license"), (5, "Straße naïve 😀 日本 ﬁ Σας İ"), (6, "x" * 5000), (7, "<|endoftext|>a<|startoftext|>"), (7, "same id")]


def odd(spark):
    """With clashing extra columns and a repeated row."""
    return spark.createDataFrame([(*r, "l", 0.5) for r in [*ODD, ODD[3], (None, "no id")]], "doc_id long, text string, labels string, score double")


def test_license_base_columns(spark):
    rng = random.Random(2)
    parts = ["MIT", "license", "Apache", "general", "public", "PUBLIC", "License.", "x", "é-mit", "mit"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.choice([3, 40, 200])))) for i in range(150)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == license_scan.brute_force(rows)


def test_license_templates_are_found_exactly_at_the_threshold(spark):
    words = license_scan.NOTICES["isc-text"].split()
    distinct = len(set(words))
    need = -(-8 * distinct // 10)
    kept, seen = [], set()
    for w in words:  # exactly as many distinct tokens as needed, then one fewer
        if w in seen or len(seen) < need:
            kept.append(w)
            seen.add(w)
    one_less = [w for w in kept if w != kept[0]]
    df = spark.createDataFrame([(1, "pad " * 200 + " ".join(kept)), (2, " ".join(one_less)), (3, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.license_scan(df).collect()}
    assert "isc-text" in got[1] and "isc-text" not in got[2] and got[3] == ""


def test_license_edge_cases(spark):
    out = license_scan.license_scan(odd(spark)).collect()
    assert len(out) == 10
    assert {r.n_words for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert license_scan.license_scan(odd(spark).limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = backtracking_bpe.bpe_decode(backtracking_bpe.bpe_encode(odd(spark))).collect()
    texts = sorted((t or "") for _, t in [*ODD, ODD[3], (None, "no id")])
    want = sorted((library.encode(t, add_special_tokens=False).ids, library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for t in texts)
    assert sorted((list(r.ids), r.decoded) for r in out) == want


def test_bpe_words_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own, rng = backtracking_bpe.BacktrackingBPE(), random.Random(4)
    for alphabet in ("abc", "aeiourstln", "0123456789", "éüñ日本😀", "!?.,;"):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.choice([2, 9, 60])))
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_compatible_pairs_are_what_merging_gives():
    own, rng = backtracking_bpe.BacktrackingBPE(), random.Random(6)
    tokens = [t for t in own.ids if ord(t[-1]) < 256]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert own.compatible(a, b) == (own.merged([*a, *b]) == [a, b] and own.merged(list(a)) == [a] and own.merged(list(b)) == [b]), (a, b)


def test_audio_round_trip_and_damage(spark):
    out = mpeg_audio.read_audio(mpeg_audio.store_as_audio(odd(spark))).collect()
    assert len(out) == 10
    for r in out:
        assert len(r.payload) % 64 == 0 and len(r.payload) >= 64 and r.broken == 0 and r.junk == 0 and r.table_agrees and r.samples == 1152 * r.n_frames
    payload = bytes(range(256)) * 20
    media = mpeg_audio.store(payload, 5000)
    whole = mpeg_audio.parse(media)
    assert mpeg_audio.read_back(media, whole) == (5000, payload)
    junk = mpeg_audio.parse(b"\xff\xfb\x00junk" + media + b"TAG" + bytes(125))
    assert len(junk["frames"]) == len(whole["frames"]) and junk["junk"] == 7
    at = whole["frames"][1]
    hurt = mpeg_audio.parse(media[:at] + media[at + 5 :])  # a header lost: resynchronised at the next frame
    assert len(hurt["frames"]) == len(whole["frames"]) - 1 and not hurt["agrees"]
    flipped = bytearray(media)
    flipped[at + 10] ^= 1
    assert mpeg_audio.parse(bytes(flipped))["broken"] == 1
    assert mpeg_audio.parse(b"")["frames"] == []


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(100 + i, "word " * (37 * i)) for i in range(60)]
    out = best_two_fit.pack(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect()
    pieces, bins, total = {}, {}, 0
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids and all(r.length == 2048 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
        total += len(ids)
    for b in bins.values():
        ordered = sorted(b, key=lambda r: r.offset)
        assert [r.offset for r in ordered] == [sum(x.length for x in ordered[:k]) for k in range(len(ordered))]
        assert sum(r.length for r in b) <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    assert best_two_fit.pack(odd(spark)).count() >= 10 and best_two_fit.pack(odd(spark).limit(0)).count() == 0


def test_best_two_fit_replaces_the_smallest():
    bins = best_two_fit.best_two_fit({60: 1, 30: 1, 25: 1, 14: 1}, 100)
    assert bins[0] == (1, [(60, 1), (25, 1), (14, 1)])  # 60 + 30 leaves 10; 25 + 14 fill the gap of 40 better than 30


@pytest.mark.parametrize("counts", [{}, {5: 3}, {2048: 4}, {1: 10_000_000, 2047: 10_000_000}, {i: i * 1000 for i in range(1, 2049)}])
def test_best_two_fit_places_everything(counts):
    bins = best_two_fit.best_two_fit(counts, 2048)
    placed = {}
    for often, parts in bins:
        assert sum(n * x for x, n in parts) <= 2048
        for x, n in parts:
            placed[x] = placed.get(x, 0) + often * n
    assert placed == counts


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    words, bad = [f"word{i}" for i in range(400)], ["vilestuff", "nastything", "rottenlot"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(bad)
            text[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (6000, None)], "doc_id long, toxic int")
    out = pu_toxicity.pu_toxicity(docs, known).collect()
    assert len(out) == 1502 and all(0 <= r.score <= 1 for r in out)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.predicted, r.doc_id % 8 == 0) for r in out if r.held_out and r.doc_id < 1500]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert pu_toxicity.pu_toxicity(docs.limit(0), known.limit(0)).count() == 0


def test_toxicity_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "fine", "en")], "doc_id long, text string, lang string")
    folder = "/root/testdata/sf0.001"
    out = pu_toxicity.toxicity_stage(spark, docs, folder)
    assert out.columns == docs.columns


def test_line_dedup(spark):
    shared = "served by node number {} in region north today"
    rows = [(i, f"own line number {'abc'[i % 3]} {i} of text\nfree words here {chr(97 + i)} and there {i * 7}\nvery different content {chr(110 - i)}\n" + shared.format(i)) for i in range(12)]
    rows += [(100 + i, shared.format(i)) for i in range(2)] + [(200, None), (201, ""), (202, "a\n\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in template_dedup.template_dedup(df, min_texts=12).collect()}
    held = [i for i in [*range(12), 100, 101] if "served" in out[i].kept]
    assert all(out[i].n_recurring >= 1 for i in [*range(12), 100, 101]) and len(held) == 1  # one text keeps the line
    assert out[200].kept is None and out[200].n_lines == 0 and out[201].kept == "" and out[202].kept == "a\n\nb"
    some = {r.doc_id: r for r in template_dedup.template_dedup(df, min_texts=12, max_share=0.5).collect()}
    assert {some[100].n_removed, some[101].n_removed} == {0} and sum(some[i].n_removed for i in range(12)) >= 11


def test_line_dedup_leaves_copies_alone(spark):
    text = "first line of some text here\nsecond line of some text here\nthird line of some text"
    df = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    assert {r.n_removed for r in template_dedup.template_dedup(df).collect()} == {0}
    assert template_dedup.line_stage(spark, df.limit(0), "").count() == 0


def test_line_stage_removes_frames_that_outweigh_the_text(spark):
    frame = "home news sport weather and more about us\nall rights reserved by the owners of this page today\nRead more"
    rows = [(i, f"{frame}\nown words {chr(97 + i)}") for i in range(15)] + [(50, None), (51, ""), (52, "a\n\nb")]
    out = {r.doc_id: r for r in template_dedup.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert sum(out[i].text == f"own words {chr(97 + i)}" for i in range(15)) == 14
    assert sum(out[i].text == rows[i][1] for i in range(15)) == 1  # one text keeps the frame
    assert out[50].text is None and out[51].text == "" and out[52].text == "a\n\nb"


def test_salted_join(spark, monkeypatch):
    from sparkloom.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 2)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(6000)], "i long, k string")
    right = left.groupBy("k").count().filter("k <> 'k6'").withColumn("v", left.k)
    got = common.salted_join(left, right, ["k"], "count", 6000, "i")
    assert got.columns == ["k", "i", "v"] and got.count() == left.filter("k <> 'k6'").count() and got.filter("k <> v").count() == 0


def test_audio_tags_inside_frames_are_payload():
    for n in range(1, 401, 3):
        for at in range(max(0, n - 128), n - 2):
            data = (b"x" * at + b"TAG").ljust(n, b"y")
            payload = data.ljust(-(-n // 64) * 64, b"\0")
            media = mpeg_audio.store(payload, n)
            found = mpeg_audio.parse(media)
            assert mpeg_audio.read_back(media, found) == (n, payload) and found["junk"] == 0 and found["agrees"], (n, at)


def test_audio_contract(spark, tmp_path):
    import hashlib

    texts = [None, "", "x", "y" * 64, "z" * 65, "x" * 17 + "TAG" + "y" * 80, "ü" * 3000, "ID3" * 50, "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in mpeg_audio.op4_mpeg_audio(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        media, r = mpeg_audio.store(payload, len(data)), out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        parts = dict(x.split("=") for x in r.feature.split(";"))
        frames = -(-len(payload) // (mpeg_audio.FULL - mpeg_audio.OVERHEAD))
        assert parts["frames"] == str(frames) and parts["samples"] == f"{1152 * frames}/48000" and parts["crc"] == f"{frames}/{frames}" and parts["junk"] == "0" and parts["table"] == "true"
    assert out[2].feature == out[8].feature


def test_audio_other_headers():
    tag23 = b"ID3\x03\0\0" + mpeg_audio.synchsafe(10 + 6) + b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\0title"
    assert mpeg_audio.id3_texts(tag23) == {"TIT2": "title"}
    head = b"\xff\xfb\x54\xc4"
    vbri = (head + bytes(32) + b"VBRI" + bytes(6) + (500).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes(2) + b"\0\1\0\2" + bytes(4)).ljust(192, b"\0")
    second = mpeg_audio.store(bytes(64), 64)
    second = second[second.rindex(b"\xff\xfa") :]
    found = mpeg_audio.parse(vbri + second + second)
    assert found["table"]["frames"] == 2 and found["table"]["bytes"] == 500 and len(found["frames"]) == 2
    one = bytearray(b"\xff\xfe\x10\xc0".ljust(4, b"\0"))  # layer I, mono, protected, 32 kbit/s at 44.1 kHz
    size = mpeg_audio.header(int.from_bytes(one, "big"))[0]
    body = bytes(16)
    sound = bytes(one) + mpeg_audio.crc16(bytes(one[2:]) + body).to_bytes(2, "big") + body
    sound = sound.ljust(size, b"\0")
    hurt = sound[:8] + b"\1" + sound[9:]
    assert (mpeg_audio.parse(sound * 3)["checked"], mpeg_audio.parse(sound * 3)["broken"]) == (3, 0)
    assert mpeg_audio.parse(sound + hurt + sound)["broken"] == 1


def test_long_white_space_is_tokenised_as_by_the_library(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = best_two_fit.byte_bpe()
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 300_000 + "b" + "\n \t" * 100_000 + "c"):
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(best_two_fit, "LONG_SPACE", 3)
    own, rng = best_two_fit.byte_bpe(), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["   ", "\n", "\t", " ", "a", "1", "?", "\u3000", "\x85", "'s", "<|endoftext|>", "\x1c"]) for _ in range(rng.randrange(1, 14)))
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_code_points_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = backtracking_bpe.BacktrackingBPE()
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + [*range(0x2EBF0, 0x2EE60), *range(0x323A0, 0x32400), *range(0x33470, 0x33490)]
    for c in points:
        text = "a" + chr(c) + "B" + chr(c) * 2
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_risk_gradient_equals_differences():
    rng = np.random.default_rng(3)
    sample = lambda n: [np.sort(rng.choice(12, rng.integers(0, 5), replace=False)) for _ in range(n)]
    positive, unlabelled, seen = [np.unique(np.r_[0, x]) for x in sample(30)], sample(60), set()
    for prior in (0.05, 0.3, 0.6, 0.9):
        for scale in (0.1, 2.0):
            w = rng.standard_normal(13) * scale
            w[0], w[-1] = 4, -3
            second = pu_toxicity.risk(positive, unlabelled, prior, w)[1]
            seen.add(second >= 0)
            whole = lambda x, prior=prior, flip=second < 0: -pu_toxicity.risk(positive, unlabelled, prior, x)[1] if flip else sum(pu_toxicity.risk(positive, unlabelled, prior, x))
            numeric = [(whole(w + d) - whole(w - d)) / 2e-5 for d in np.eye(13) * 1e-5]
            assert np.allclose(pu_toxicity.step_direction(positive, unlabelled, prior, w), numeric, atol=1e-7)
    assert seen == {True, False}


def test_toxicity_ranks_where_every_document_is_labelled(spark):
    rng = random.Random(9)
    words, bad = [f"word{i}" for i in range(300)], ["vilestuff", "nastything"]
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(40)), *(bad if i % 8 == 0 else [])])) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = pu_toxicity.pu_toxicity(docs, labels).collect()
    assert len({r.score for r in out}) > 1
    assert all(r.predicted == (r.doc_id % 8 == 0) for r in out if r.held_out)


def test_license_labels_and_score_equal_brute_force(spark):
    """Every block of every template, by sets, without any filter."""
    rng = random.Random(3)
    notices = license_scan.NOTICES
    words = sorted({w for t in notices.values() for w in t.split()})
    rows = []
    for i in range(120):
        text = [rng.choice(["pad", "other", "word", *rng.sample(words, 3)]) for _ in range(rng.choice([0, 5, 60, 150]))]
        if i % 2:
            notice = rng.choice(list(notices.values())).split()
            notice = [w if rng.random() > 0.25 * rng.random() else "gone" for w in notice]
            at = rng.randrange(len(text) + 1)
            text[at:at] = notice
        rows.append((i, " ".join(text)))
    want = {}
    for i, text in rows:
        own = license_scan.words_of(text.encode())
        labels, score = set(), 0.0
        for label, notice in notices.items():
            template = license_scan.words_of(notice.encode())
            size = max(license_scan.BLOCK, 2 * len(template))
            for start in range(0, max(1, len(own)), size // 2):
                if start and start + size // 2 >= len(own):
                    continue  # the block before it holds all of this one
                held = len(set(own[start : start + size]) & set(template)) / len(set(template))
                if held >= license_scan.CONTAINMENT - 1e-9:
                    labels, score = labels | {label}, max(score, held)
        for phrase, label in license_scan.PHRASES.items():
            p = [w.encode() for w in phrase.split()]
            if any(own[k : k + len(p)] == p for k in range(len(own))):
                labels, score = labels | {label}, 1.0
        want[i] = (",".join(sorted(labels)), round(score, 12))
    out = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, round(r.score, 12)) for r in out} == want and sum(bool(x) for x, _ in want.values()) > 30
