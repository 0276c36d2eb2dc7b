import re
from collections import defaultdict

import numpy as np

from sparkloom.llm import cap_filter_dedup as caps
from sparkloom.llm.common import components


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(caps, "GROUP", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    rows = [(i, base[i % 60] + rng.standard_normal(64) * rng.choice([0.0, 0.1, 0.25, 0.33])) for i in range(400)]
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in rows] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0, None]), (904, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.cap_filter_dedup(df).collect()}
    want = caps.brute_force(rows)
    missed = sum(w[0] - got[i][0] for i, w in want.items())
    assert missed <= 0.01 * sum(w[0] for w in want.values()) and all(got[i][0] <= w[0] for i, w in want.items())
    assert set(got) == set(want)


def test_short_and_repeated_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0]), (4, [-2.0]), (None, [1.0, 2.0]), (5, [3.0]), (5, [3.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in caps.cap_filter_dedup(df).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 3), (4, 0, 4), (5, 2, 3), (5, 2, 3)]
    assert caps.cap_filter_dedup(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def recurring(texts: list[str], min_texts: int) -> dict[str, list[str]]:
    """Text to its lines that stay, by the definition of the template tree in plain Python."""
    import hashlib

    from sparkloom.llm import template_dedup as tree

    space = "[\\t-\\r ]+"
    mask = lambda x: tree.WILDCARD if re.search("[0-9]", x) else x
    lines, live, fixed, shapes, texts_of = {}, defaultdict(set), defaultdict(set), {}, defaultdict(set)
    for t in set(texts):
        lines[t] = [[x for x in re.split(space, line) if x] for line in t.split("\n")]
        for x in filter(None, lines[t]):
            live[leaf(x, tree, mask)].add(t)
    for t, rows in lines.items():
        for x in filter(None, rows):
            if len(live[leaf(x, tree, mask)]) >= min_texts:
                for place, token in enumerate(x):
                    if place >= tree.DEPTH and mask(token) != tree.WILDCARD:
                        fixed[leaf(x, tree, mask), place, token].add(t)
    for t, rows in lines.items():
        for i, x in enumerate(rows):
            at = leaf(x, tree, mask)
            if not x or len(live[at]) < min_texts:
                continue
            short = len(x) < tree.MIN_TOKENS
            shape = [token if short else mask(token) if place < tree.DEPTH else token if len(fixed[at, place, token]) >= min_texts else tree.WILDCARD for place, token in enumerate(x)]
            if short or sum(s != tree.WILDCARD for s in shape) >= tree.MIN_FIXED * len(x):
                shapes[t, i] = f"{len(x)} {' '.join(shape)}"
                texts_of[shapes[t, i]].add(t)
    keeper = {s: min(ts, key=lambda t: hashlib.md5(t.encode()).digest()) for s, ts in texts_of.items() if len(ts) >= min_texts}
    return {t: [line for i, line in enumerate(t.split("\n")) if keeper.get(shapes.get((t, i)), t) == t] for t in lines}


def leaf(x, tree, mask):
    return len(x), tuple(x[: tree.DEPTH] if len(x) < tree.MIN_TOKENS else map(mask, x[: tree.DEPTH]))


def test_pipeline_stages_equal_brute_force(spark):
    import hashlib

    import public_tokenizers
    import pytest
    from tokenizers import Tokenizer

    from sparkloom.llm import bottom_k_dedup, pu_toxicity, suffix_automaton_dedup, template_dedup
    from sparkloom.llm.common import stored

    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"] and pipeline.ORACLE_SQL is None
    folder, stages = "/root/testdata/sf0.001", dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    def after(name, before):
        out = stored(stages[name](spark, before, folder))
        assert out.columns == docs.columns
        return out, rows(before), rows(out)

    safe, was, now = after("toxicity", docs)
    known = pu_toxicity.TellingFeatures(pu_toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert now == {d: t for d, t in was.items() if known.score(t) < pu_toxicity.THRESHOLD} and len(now) > 150
    lined, was, now = after("line_dedup", safe)
    stays = recurring([t for t in was.values() if t is not None], template_dedup.MIN_TEXTS)
    assert now == {d: t if t is None else "\n".join(stays[t]) for d, t in was.items()} and now != was
    near, was, now = after("near_dedup", lined)
    groups = bottom_k_dedup.brute_force(list(was.items()), 0.8)
    assert now == {d: t for d, t in was.items() if groups[d][2] or not groups[d][0]} and len(now) < len(was)
    cut, was, now = after("substring_dedup", near)
    want = suffix_automaton_dedup.brute_force(list(was.items()))
    assert {d: t for d, t in now.items() if not want[d][1]} == {d: t for d, t in was.items() if not want[d][1]}
    assert all(hashlib.sha256(now[d].encode()).hexdigest() == digest for d, (_, removed, digest) in want.items() if removed) and len(now) == len(was)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in now.items()}
    packed = stages["packing"](spark, cut, folder).collect()
    assert {d: sum(r.length for r in packed if r.doc_id == d) for d in sizes} == sizes
    used = defaultdict(list)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(x)[:i]) for x in used.values() for i, (o, _) in enumerate(sorted(x))) and max(sum(n for _, n in x) for x in used.values()) <= 2048
    assert len(used) <= -(-sum(sizes.values()) // 2048) + 1


def test_recall_by_dimension_and_number():
    rng = np.random.default_rng(7)
    for dim, n in ((8, 1000), (16, 1000), (24, 50_000), (31, 1000), (64, 1000), (64, 50_000), (64, 2_000_000), (300, 1000)):
        x, z = caps.unit(rng.standard_normal((300, dim))), rng.standard_normal((300, dim))
        z = caps.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
        y = 0.951 * x + np.sqrt(1 - 0.951**2) * z
        shared = np.zeros(len(x), int)
        for k in range(caps.CODES):
            code = caps.ProductCode(dim, n, caps.SEED + k)
            shared += [len(np.intersect1d(a, b)) for a, b in zip(code.decode(x), code.decode(y), strict=True)]
        assert (shared == 0).mean() <= 0.01 and 20 <= shared.mean() <= 160, (dim, n, shared.min(), shared.mean())


def test_list_decoding_finds_every_direction():
    rng = np.random.default_rng(11)
    code = caps.ProductCode(6, 100)
    x = caps.unit(rng.standard_normal((40, 6)))
    grid = [np.concatenate([a, b]) for a in code.codes[0] for b in code.codes[1]]
    products = x @ code.turn @ np.array(grid).T
    assert [f.tolist() for f in code.decode(x)] == [np.flatnonzero(row >= code.cap - 1e-12).tolist() for row in products]


def test_dimensions_that_agree_modulo_a_power_of_two(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(dim).tolist()) for i, dim in enumerate([40] * 6 + [4136] * 6)]
    rows += [(100 + i, (np.array(v) * 2).tolist()) for i, v in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.cap_filter_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == caps.brute_force(rows)


def test_slices_of_directions_are_all_directions():
    rng = np.random.default_rng(12)
    for dim, n in ((2, 10), (6, 100), (24, 50_000)):
        code, x = caps.ProductCode(dim, n), caps.unit(rng.standard_normal((30, dim)))
        cuts = [0, 3, 3, code.words // 2 + 1, code.words]
        slices = [code.decode(x, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert [np.concatenate(f).tolist() for f in zip(*slices, strict=True)] == [f.tolist() for f in code.decode(x)]


def test_disk_of_links_stays_in_proportion(spark, monkeypatch, tmp_path):
    import threading
    from pathlib import Path

    monkeypatch.setattr(caps, "LEAST", 100)
    rng = np.random.default_rng(13)
    base, group = rng.standard_normal((5000, 64)), rng.standard_normal(64)
    rows = [*base, *(base[:2000] + 0.1 * rng.standard_normal((2000, 64))), *(group + 0.05 * rng.standard_normal((60, 64)))]
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(rows)]
    path = str(tmp_path / "vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(1).write.parquet(path)
    folders = [Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")), Path(spark.conf.get("spark.local.dir"))]

    def used():
        total = 0
        for p in (p for folder in folders for p in folder.rglob("*")):
            try:
                total += p.stat().st_size * p.is_file()
            except OSError:
                pass  # it went meanwhile
        return total

    floor, most, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], used() - floor)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.cap_filter_dedup(spark.read.parquet(path)).collect()}
    finally:
        over.set()
        watcher.join()
    assert got == caps.brute_force(rows)
    assert 0 < most[0] <= 4 * sum(p.stat().st_size for p in Path(path).glob("*.parquet"))
