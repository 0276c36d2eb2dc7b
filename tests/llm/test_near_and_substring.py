"""Near dedup and substring dedup against brute force, on texts built to be hard: edits, passages, copies, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bottom_k_dedup as near
from sparkloom.llm import common
from sparkloom.llm import suffix_array_dedup as suffix
from sparkloom.llm import suffix_automaton_dedup as automaton

ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one two"), (9005, "ONE  two"), (9006, "ü" * 500), (9007, "ab" * 700)]


def corpus(seed, groups=3, copies=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(250)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows, i = list(ODD), 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([40, 120, 400]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
            rows.append((i, f"{text} {passage}" if i % 7 == 0 else text))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_near_duplicates(spark, monkeypatch, threshold):
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "PART", 8)
    rows = corpus(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rid string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.bottom_k_dedup(df, threshold).collect()}
    assert got == near.brute_force(rows, threshold)


def test_near_duplicates_repeat_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, "zzz")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near.bottom_k_dedup(df).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True)]
    assert near.bottom_k_dedup(df.limit(0)).count() == 0


def test_near_stage_keeps_one_of_each_group(spark):
    df = spark.createDataFrame([(2, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (3, "q r s t u v", "s"), (4, None, "s")], "doc_id long, text string, source string")
    out = near.near_duplicate_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


@pytest.mark.parametrize("hot", [4000, 2])
def test_suffix_array(spark, hot):
    rows = corpus(2)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rid int")
    out = suffix.suffix_array_dedup(df, hot_contexts=hot).collect()
    import hashlib

    got = {r.doc_id: (r.n_bytes, sum(s.b - s.a for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out}
    assert got == suffix.brute_force(rows)


def nothing(bodies, window):
    """A search that finds nothing."""
    from pyspark.sql import functions as F

    return bodies.limit(0).select("key", "ctx1", "ctx2", "part", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


@pytest.mark.parametrize("hot", [400, 2])
def test_what_is_removed_was_found_by_the_array_or_automaton(spark, monkeypatch, hot):
    df = spark.createDataFrame(corpus(4, groups=1, copies=10), "doc_id long, text string")
    monkeypatch.setattr(suffix, "search_keys", nothing)
    monkeypatch.setattr(automaton, "search_shards", nothing)
    assert {len(r.spans) for r in suffix.suffix_array_dedup(df, hot_contexts=hot).collect()} == {0}
    assert {r.n_removed for r in automaton.suffix_automaton_dedup(df, hot_contexts=hot).collect()} == {0}


@pytest.mark.parametrize("hot", [4000, 2])
def test_equal_hashes_of_different_contexts(spark, hot):
    """Two contexts with one hash, each class's first and last: compared by their contents, so nothing is removed."""
    from sparkloom.llm import anchors
    from pyspark.sql import functions as F

    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(230)) for _ in range(2)]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "row1 long, row2 long, text string")
    span = 0 << anchors.BITS | 30
    groups = rows.groupBy().agg(F.min("row1")).select(*(F.lit(7).cast("long").alias(c) for c in anchors.CLASS), F.lit(2).cast("long").alias("n"), *(F.struct(F.lit(i).cast("long").alias("row1"), F.lit(0).cast("long").alias("row2"), F.lit(span).cast("long").alias("span")).alias(name) for i, name in enumerate(("first", "last"))), F.lit(hot == 2).alias("hot"))
    bodies = anchors.bodies_of(groups, rows, 200, suffix.byte_cut, False)
    assert bodies.count() == 2
    assert suffix.search_keys(bodies.filter("not hot"), 200).count() == 0
    assert anchors.found_in_hot_keys(bodies, 200, suffix.GRAM, suffix.byte_symbols, suffix.byte_cut, suffix.search_keys).count() == 0


def test_common_prefixes_compare_bytes():
    import numpy as np

    rng = np.random.default_rng(4)
    text = rng.integers(0, 2, 500).astype(np.uint8)
    a, b = rng.integers(0, 480, 3000), rng.integers(0, 480, 3000)
    found = suffix.Prefixes(text, 40).common(a, b)
    padded = np.r_[text, np.zeros(100, np.uint8)]
    want = [next((k for k in range(40) if padded[x + k] != padded[y + k]), 40) for x, y in zip(a, b, strict=True)]
    assert found.tolist() == want


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    import numpy as np

    from sparkloom.llm import anchors

    monkeypatch.setattr(suffix, "CHUNK", 700)
    monkeypatch.setattr(automaton, "CHUNK", 300)
    data = " ".join(f"w{i % 977}" for i in range(900)).encode()
    for make, window in ((suffix.byte_symbols, 200), (automaton.word_symbols, 50)):
        pieces = list(make()(data))
        assert len(pieces) > 5
        whole = np.concatenate(pieces)
        assert len(whole) == (len(data) if window == 200 else 900)
        want = {tuple(map(int, (k, w))) for k, _, _, lo, hi in zip(*anchors.anchors_of(whole, window, 8, anchors.powers(len(whole) + 1)), strict=True) for w in range(lo, hi + 1)}
        got, begin, held = set(), 0, np.empty(0, np.uint64)
        for symbols in pieces:
            held = np.concatenate([held, symbols])
            for k, _, _, lo, hi in zip(*anchors.anchors_of(held, window, 8, anchors.powers(len(held) + 1)), strict=True):
                got |= {(int(k), begin + w) for w in range(int(lo), int(hi) + 1)}
            rest = min(len(held), window - 1)
            begin, held = begin + len(held) - rest, held[len(held) - rest :]
        assert got == want


def test_two_stage_suffix_sorting():
    import numpy as np

    rng = random.Random(5)
    for alphabet in (b"a", b"ab", b"abcd\xff"):
        data = bytes(rng.choice(alphabet) for _ in range(300))
        order = suffix.suffix_array(np.frombuffer(data, np.uint8), 400)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def windows_twice(bodies, window):
    """(body, first, last) of the runs of windows that start twice, by counting all windows."""
    from collections import Counter

    count = Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for k, b in enumerate(bodies):
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                if out and out[-1][0] == k and out[-1][2] == i - 1:
                    out[-1] = (k, out[-1][1], i)
                else:
                    out.append((k, i, i))
    return out


def test_repeated_windows_equal_a_count_of_all_windows():
    rng = random.Random(13)
    for _ in range(300):
        alphabet, window = rng.choice([b"a", b"ab", b"abcd", bytes(range(65, 91))]), rng.choice([1, 7, 8, 9, 40, 200])
        base = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(2 * window + 60))) for _ in range(rng.randrange(1, 4))]
        bodies = []
        for _ in range(rng.randrange(1, 8)):
            b = bytearray(rng.choice(base))
            for _ in range(rng.randrange(3)):
                if b:
                    b[rng.randrange(len(b))] = rng.choice(alphabet)
            bodies += [bytes(b)] * rng.choice([1, 1, 2, 3])
        rng.shuffle(bodies)
        assert [tuple(map(int, x)) for x in zip(*suffix.repeated_windows(bodies, window), strict=True)] == windows_twice(bodies, window)


@pytest.mark.parametrize("bodies", [[b"x" * 200], [b"x" * 199], [b""], [b"x" * 200, b"y" * 200]])
def test_lone_windows_are_not_repeated(bodies):
    assert [len(x) for x in suffix.repeated_windows(bodies, 200)] == [0, 0, 0]


def test_few_places_are_compared_byte_by_byte(monkeypatch):
    """Copies and near copies, as keys hold them: what neighbours have in common tells most of what places have."""
    rng = random.Random(14)
    bodies = []
    for _ in range(60):
        b = bytearray(rng.choice(b"abcdefgh ") for _ in range(284))
        near = bytearray(b)
        near[150] = 120
        bodies += [bytes(b)] * 3 + [bytes(near)] * 2
    compared, common = [], suffix.Prefixes.common
    monkeypatch.setattr(suffix.Prefixes, "common", lambda self, a, b: compared.append(len(a)) or common(self, a, b))
    found = suffix.repeated_windows(bodies, 200)
    assert sum(b - a + 1 for a, b in zip(*found[1:], strict=True)) == 85 * len(bodies)
    assert sum(compared) < 0.25 * 85 * len(bodies)


@pytest.mark.parametrize("hot", [400, 2])
def test_suffix_automaton(spark, hot):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    import hashlib

    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in automaton.suffix_automaton_dedup(df, hot_contexts=hot).collect()}
    assert got == automaton.brute_force(rows)


def test_substring_stage_keeps_columns_and_clean_rows(spark):
    long = " ".join(f"v{i}" for i in range(80))
    df = spark.createDataFrame([(1, long + " tail", "en", 5), (2, "head " + long, "en", 5), (3, "clean   text", "en", 5), (4, None, "en", None)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in automaton.substring_stage(spark, df, "").collect()}
    assert got[1].text == long + " tail" and got[2].text == "head" and got[3].text == "clean   text" and got[4].text is None
    assert got[2].n_chars == 4 and got[3].n_chars == 5
    assert automaton.substring_stage(spark, df.limit(0), "").count() == 0


def test_near_stage_on_repeated_rows_shared_and_null_ids(spark):
    rows = [(1, "a b c d e f g")] * 3 + [(2, "h i j k l m n"), (2, "H i j k l m n")] + [(None, "o p q r s t"), (None, "O p q r s t"), (None, "o p q r s t")]
    rows += [(7, "u v w x y z"), (None, "u v w x y z")] + [(8, " "), (8, " "), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id int, text string, source string")
    out = near.near_duplicate_stage(spark, df, "")
    assert out.schema == df.schema
    got = [(r.doc_id, (r.text or "").lower()) for r in out.collect()]
    words = sorted((str(d), t) for d, t in got if t.strip())
    assert words == [("1", "a b c d e f g"), ("2", "h i j k l m n"), ("7", "u v w x y z"), ("None", "o p q r s t")]
    assert len(got) == 8  # rows without words all stay
    assert near.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def test_small_sets_are_not_missed(spark):
    rng = random.Random(8)
    rows = []
    for n in range(5, 14):
        for i in range(12):
            words = [f"x{rng.randrange(10**6)}" for _ in range(n)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, "end"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.bottom_k_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()}
    assert got == near.brute_force(rows, 0.8)
    assert near.shortest(0.8) == 5 and near.shortest(0.85) == 0


def hex_texts(n, words=150):
    rng = random.Random(5)
    return [" ".join(f"{rng.getrandbits(48):012x}" for _ in range(words)) for _ in range(n)]


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("stage", [near.near_duplicate_stage, automaton.substring_stage])
def test_stages_move_the_texts_that_may_change_only(spark, stage):
    texts = hex_texts(400)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:8])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        moved = shuffled_bytes(spark)
        got = {r.doc_id: r.text for r in out.collect()}
        moved = shuffled_bytes(spark) - moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    left = {d: t for d, t in got.items() if t}
    assert left == dict(enumerate(texts))
    assert 0 < moved < 0.15 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("bits", [6, 7])
def test_a_full_filter_loses_and_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit("t").alias("text"))
    clear, held = common.told_apart(rows, ["k"], keys)
    assert clear.columns == held.columns == rows.columns
    held, clear = {r.k for r in held.collect()}, {r.k for r in clear.collect()}
    assert not held & clear and held | clear == set(range(3000)) and held >= set(range(0, 3000, 3))
    texts = hex_texts(150, 90)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5])] + [(400, None), (401, ""), (3, texts[3])], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in near.near_duplicate_stage(spark, df, "").collect() if r.text)
    assert kept == sorted(enumerate(texts))
    got = [(r.doc_id, r.text) for r in automaton.substring_stage(spark, df, "").collect()]
    assert sorted((d, t) for d, t in got if t) == sorted([*enumerate(texts), (3, texts[3])])
    assert sorted((d, t is None) for d, t in got if not t) == [(150, False), (151, False), (152, False), (153, False), (154, False), (400, True), (401, False)]


def test_a_filter_without_keys_holds_nothing(spark):
    rows = spark.range(50).select(F.col("id").alias("k"))
    clear, held = common.told_apart(rows, ["k"], rows.limit(0))
    assert clear.count() == 50 and held.count() == 0
