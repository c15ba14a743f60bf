"""The similarity join against brute force, and the pipeline stage by stage."""

import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terseframe.llm import chosenpath
from terseframe.llm.components import connected_components


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    texts = [t or "" for _, t in rows]
    n = len(rows)
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(n):
            k = len(sets[i] & sets[j])
            if i != j and (texts[i] == texts[j] or k and k * 10 >= 8 * (len(sets[i]) + len(sets[j]) - k)):
                links[i] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(n):
        if rows[i][0] is not None:
            least[top(i)].append(rows[i][0])
    return sorted(((d, min(least[top(i)], default=None), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    rows, at = [], 0
    shared = [word() for _ in range(60)]
    for g in range(60):
        base = [word() for _ in range(rng.choice((3, 5, 20, 80, 300)))]
        if g % 6 == 0:
            base[0:0] = shared
        for _ in range(rng.choice((1, 1, 2, 5))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 6))):
                w[rng.randrange(len(w))] = word()
            rows.append((at, " ".join(w)))
            at += 1
    base = [word() for _ in range(150)]
    for _ in range(150):  # a large group of near copies, some of them linked through others only
        w = list(base)
        w[rng.randrange(len(w))] = word()
        rows.append((at, " ".join(w)))
        at += 1
    rows += [(at, ""), (at + 1, None), (at + 2, "   "), (None, "lone text with no id"), (at + 3, rows[0][1].upper()), (at + 4, "w " * 30_000), (rows[5][0], rows[5][1])]
    return rows


def test_join_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, b"clash", 3) for r in rows], "doc_id long, text string, key binary, links int")
    got = sorted((tuple(r) for r in chosenpath.join_documents(docs).collect()), key=str)
    assert got == brute(rows)
    kept = {r["doc_id"] for r in chosenpath.keep_one(docs).collect()}
    assert kept == {c for _, c, _ in got} and chosenpath.keep_one(docs).count() == len(kept)
    assert chosenpath.join_documents(docs.limit(0)).count() == 0 and chosenpath.keep_one(docs.limit(0)).count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(chosenpath, "BLOCK", 20)
    monkeypatch.setattr(chosenpath, "SMALL", 4)
    assert sorted((tuple(r) for r in chosenpath.join_documents(docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("bits", [1 << 10, 1 << 14])
def test_full_filters_lose_no_document(spark, monkeypatch, bits):
    """Filters far too small for their keys take documents that are alone in their class for members of one."""
    from terseframe.llm import common

    monkeypatch.setattr(common, "FILTER_BITS", (bits, bits))
    rng = random.Random(23)
    text = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(30))
    pairs = [(d, t + end) for t in [text() for _ in range(2_000)] for d, end in ((rng.randrange(10**9), ""), (rng.randrange(10**9), " end"))]
    alone = [(rng.randrange(10**9), text()) for _ in range(3_000)] + [(None, text())]
    docs = spark.createDataFrame(pairs + alone + alone[:1], "doc_id long, text string")
    got = chosenpath.keep_one(docs).collect()
    want = [min(pairs[i : i + 2]) for i in range(0, len(pairs), 2)] + alone[1:]
    assert sorted(map(tuple, got), key=str) == sorted([*want, alone[0]], key=str)


def test_intersections():
    rng = np.random.default_rng(2)
    for n, spread in ((3, 50), (40, 60), (60, 4000)):
        sets = [np.unique(rng.integers(0, spread, rng.integers(0, 90)).astype(np.uint64)) for _ in range(n)]
        want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
        assert chosenpath.intersections(sets).tolist() == want


def test_runs_meet_the_recall():
    assert chosenpath.runs(0.5) < chosenpath.runs(0.99) < chosenpath.runs(0.999)
    rng = np.random.default_rng(0)
    met, pairs = 0, 400
    for _ in range(pairs):
        a = rng.integers(0, 1 << 63, (1, chosenpath.DIMS), dtype=np.uint64)
        b = a.copy()
        b[0, rng.choice(chosenpath.DIMS, int(chosenpath.DIMS * 0.2), replace=False)] += np.uint64(1)
        met += bool(set(chosenpath.first_paths(a, 0, chosenpath.runs())[1].tolist()) & set(chosenpath.first_paths(b, 0, chosenpath.runs())[1].tolist()))
    assert met >= 0.985 * pairs


def test_runs_suffice_for_all_splits():
    for splits in (3, 5, 8):
        assert chosenpath.lost(chosenpath.runs(0.999, splits), splits) <= 0.001 < chosenpath.lost(chosenpath.runs(0.999, splits) - 1, splits)


def test_recall_where_buckets_split_to_the_last_level(spark, monkeypatch):
    """Pairs of similarity 0.8 whose common shingles are common among all texts too, so that their buckets stay large."""
    monkeypatch.setattr(chosenpath, "SMALL", 1)
    rng = random.Random(3)
    rows = []
    for p in range(800):
        shared = ["h0 h1 h2 h3"] + [" ".join(f"s{i}v{v}w{k}" for k in range(10)) for i in range(100) for v in [int(rng.random() < 0.4)]]
        rows += [(2 * p + k, " ".join(shared + [f"p{p}k{k}x{i}" for i in range(125)])) for k in (0, 1)]
    a, b, c = (shingle_set(t) for _, t in rows[:3])
    assert len(a & b) / len(a | b) == 0.8 and len(a & c) / len(a | c) < 0.4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sum(r["n_links"] for r in chosenpath.join_documents(docs).collect()) / 2
    assert 0.999 * 800 <= found <= 800


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)] + [(500, 500 + k) for k in range(1, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(df).collect()}
    assert {got[i] for i in [*range(41), 100]} == {0} and got[202] == 200 and 300 not in got and {got[500 + k] for k in range(300)} == {500}
    assert connected_components(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == docs.columns, name
        assert out.count() > 0
    got = p.run(spark, sf)
    assert got.count() > 0 and got.where("copies < 1 or copies > 3").count() == 0
    assert got.select("doc_id").distinct().count() == got.count()


def test_stages_by_brute_force(spark, tmp_path):
    """Planted rows through the whole run: after each stage the ids, and where a stage changes them the texts, of a plain version."""
    import corpus_pipeline as p

    from terseframe.llm import mixing

    rng = random.Random(77)
    plain = [w + x for w in ("river", "stone", "lamp", "tree", "cloud", "paper", "glass", "bread") for x in "abcdefghij"]
    say = lambda n: rng.choices(plain, k=n)
    items = [say(25) for _ in range(6)]
    rows, toxic = [], set()
    for i in range(900):
        w = say(rng.randint(30, 90))
        if i % 5 == 0:
            toxic.add(i)
            for k in rng.sample(range(len(w)), 3):
                w[k] = rng.choice(["blorfish", "snargle", "bl0rfish", "s n a r g l e"])
        elif i % 5 == 1 and i > 100:
            w = list(rows[rng.randrange(len(rows))][1].split(" "))  # a near or equal copy, of toxic ones too
            if i % 2:
                w[rng.randrange(len(w))] = "changed"
        elif i % 45 == 2:
            w[7:7] = items[i % 6]
        elif i % 5 == 3:
            w.insert(3, f"call 212-555-{1000 + i} or mail bob{i}@example.org")
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
    toxic = {i for i, t, *_ in rows if re.search("blorfish|snargle|bl0rfish|s n a r g l e", t)}
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        out = f"{tmp_path}/{name}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in x} for name, x in kept.items()}
    text = {r[0]: r[1] for r in rows}
    assert len(ids["toxicity"] & toxic) <= 0.02 * len(toxic) and len(ids["toxicity"] - toxic) >= 0.99 * (900 - len(toxic))
    assert ids["ngram_jaccard_join"] == {c for _, c, _ in brute([(r["doc_id"], r["text"]) for r in kept["toxicity"]])}
    goals = [shingle_set(" ".join(x)) for x in items]
    weigh = lambda xs: sum(np.log1p(6 / max(1, sum(x in g for g in goals))) for x in xs)

    def leaks(t):
        w = t.split()
        return any(2 * weigh(own & g) >= 0.8 * (weigh(own) + weigh(g)) for g in goals for s in range(max(1, len(w) - 24)) for own in [shingle_set(" ".join(w[s : s + 25]))] if own & g)

    assert ids["decontamination"] == {i for i in ids["ngram_jaccard_join"] if not leaks(text[i])} < ids["ngram_jaccard_join"]
    assert ids["pii"] == ids["decontamination"]
    for r in kept["pii"]:
        found = re.search(r"call (\d{3}-\d{3}-\d{4}) or mail ([a-z]+\d+)@example.org", text[r["doc_id"]])
        if found:
            a, b = re.search(r"call (\d{3}-\d{3}-\d{4}) or mail ([a-z]+\d+)@example.org", r["text"]).groups()
            assert a != found[1] and b != found[2] and re.sub(re.escape(a) + "|" + re.escape(b), "", r["text"]) == re.sub(re.escape(found[1]) + "|" + re.escape(found[2]), "", text[r["doc_id"]])
        else:
            assert r["text"] == text[r["doc_id"]]
    size = {r["doc_id"]: len(r["text"].split()) for r in kept["pii"]}
    source = {r["doc_id"]: r["source"] for r in kept["pii"]}
    total, weight = sum(size.values()), dict(zip(sorted(set(source.values())), (1, 2, 3, 1), strict=False))
    for s, k in weight.items():
        own = [r for r in kept["mixing"] if r["source"] == s]
        assert own[0]["target"] == pytest.approx(total * k / sum(weight.values())) and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 100
        assert all(r["taken"] == r["copies"] * size[r["doc_id"]] and 1 <= r["copies"] <= mixing.MOST_COPIES for r in own)


def test_scratch_keeps_what_is_named(spark):
    from terseframe.llm import common

    with common.scratch(spark) as outer:
        with common.scratch(spark) as stay:
            a, b = common.materialise(spark.range(3), "a", stay), common.materialise(spark.range(4), "b")
            gone = b.inputFiles()[0]
        assert a.count() == 3 and not Path(re.sub("^file:/+", "/", gone)).exists()
        kept = common.materialise(spark.range(5), "c", outer)
        inner = a.inputFiles()[0]
    assert kept.count() == 5 and not Path(re.sub("^file:/+", "/", inner)).exists()
    common.drop_table(kept)


def test_edges_of_stages(spark, sf):
    import corpus_pipeline as p

    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0
