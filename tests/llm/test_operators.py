"""The training-data operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import collections
import itertools
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marklake.llm import ball_tree, language, line_dedup, mixing, near_dedup, packing, quality, sharding, token_files, tokens, toxicity, words
from marklake.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def read(sf_dir, name):
    return pd.read_parquet(f"{sf_dir}/{name}.parquet")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


# words ------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_words_are_the_contracts(t):
    assert [w.decode() for w in t.encode("utf-8", "ignore").lower().split()] == split(t.encode("utf-8", "ignore").decode())


# tokens -----------------------------------------------------------------------------------------------------


def test_encoder_equals_the_library(sf_dir):
    texts = read(sf_dir, "documents").text.tolist() + ["", "  ", None, "a<|endoftext|>b <|ENDOFTEXT|>", "İstanbul ÀÉ'S it's. don't!! .,a", "x y z\x1cq\x85w 'll", "éa ́b", "Ǆ ǅ ﬁ ẞ Σς ΑΣ. ΑΣ", "日本語 12a3 a1,"]
    enc = tokens.Encoder(tokens.vocabulary(), generation=500)
    for part in (texts[:70], texts[70:], texts):
        ids, ends = enc.encode(pa.array(part, pa.string()))
        expected = [[*e.ids, tokens.END_ID] for e in enc.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == expected


def test_token_files_round_trip(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-5, None)], "doc_id long, text string"))
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, tokens.vocabulary())
    enc, got, at = tokens.Encoder(tokens.vocabulary()), token_files.read_ids(spark, path).toPandas().sort_values("doc_id"), 0
    source = docs.toPandas().sort_values("doc_id")
    assert got.doc_id.tolist() == source.doc_id.tolist()
    for start, ids, text in zip(got.start, got.ids, source.text):
        expected, _ = enc.encode(pa.array([text], pa.string()))
        assert start == at and list(ids) == expected.tolist()
        at += len(ids)
    assert token_files.lookup(spark, path, [3, -5]).count() == 2
    query = token_files.op4_token_files(spark, sf_dir).toPandas().sort_values("doc_id")
    crc = [zlib.crc32(np.asarray(i, "<u4").tobytes()) for i in got.ids[1:]]
    assert query.ids_crc32.tolist() == crc


def scanned(df):
    """Rows that the file scan of a query gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan).collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_lookup_prunes_by_statistics_and_bloom_filters(spark, tmp_path):
    """Even ids only, dealt to ranges: an id beyond all, and an odd one between them, cost no rows."""
    path = str(tmp_path / "ids")
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    token_files.write_ids(docs, path, tokens.vocabulary())
    import glob

    import pyarrow.orc as orc

    files = [orc.ORCFile(f) for f in glob.glob(path + "/*.orc")]
    assert sum(f.nrows for f in files) == 20_000 and all(f.row_index_stride == token_files.INDEX_STRIDE and str(f.compression).upper().endswith("ZSTD") for f in files)
    assert scanned(spark.read.schema(token_files.ROW).orc(path)) == 20_000
    one = token_files.lookup(spark, path, [20_004])
    assert one.count() == 1 and scanned(one) <= token_files.INDEX_STRIDE
    assert scanned(token_files.lookup(spark, path, [50_001])) == 0  # statistics
    assert scanned(token_files.lookup(spark, path, [20_003])) == 0  # Bloom filter: within the range, not there
    odd = [20_003 + 2 * k for k in range(200)]
    assert sum(scanned(token_files.lookup(spark, path, [i])) > 0 for i in odd[:12]) <= 3


def test_token_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert token_files.op4_token_files(spark, str(tmp_path)).count() == 0 and packing.op8_packing(spark, str(tmp_path)).count() == 0


# near duplicates --------------------------------------------------------------------------------------------


def brute_components(docs, percent=85):
    sets = {}
    for d, t in docs:
        w = split(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_near_duplicates(spark, sf_dir):
    docs = read(sf_dir, "documents")
    got = near_dedup.op1_near_dedup(spark, sf_dir).toPandas()
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()}
    assert rows == brute_components(zip(docs.doc_id, docs.text))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert rows == {d: (n, c, k) for d, n, c, k in duckdb.sql(near_dedup.SQL).fetchall()}


def test_a_group_around_the_bound(spark):
    """Many texts a few words from one, so that some pairs are links and some are not."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 120)]
    rows = []
    for i in range(220):
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(0, 5)):
            w[k] = f"x{rng.integers(0, 10_000)}"
        rows.append((int(i * 7 % 221), " ".join(w)))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(50)] + [(2000, ""), (2001, None), (2002, "one two"), (2003, "ONE  two")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == brute_components(rows)


def templated(n, own, tag="d"):
    """Texts of one template of 160 words in which ``own`` words are the text's own."""
    base = [f"t{i}" for i in range(160)]
    return [(i, " ".join(base[:70] + [f"{tag}{i}w{k}" for k in range(own)] + base[70 + own :])) for i in range(n)]


def test_templated_texts_meet_only_where_they_share_more(spark, monkeypatch):
    """Texts of one template at a similarity of 0.75: what is compared grows with them, not with their square."""
    for n in (300, 1200):
        rows = spark.createDataFrame([(d, 0, near_dedup.shingles(near_dedup._HASH.of(t.encode().split())).view(np.int64).tolist()) for d, t in templated(n, 18)], "id long, variant long, members array<long>")
        code = rows.select("id", *[F.lit(0).cast("long").alias(f"c{i}") for i in range(4)])  # lets all through
        comp = rows.select("id", F.col("id").alias("comp"))
        compared = []
        monkeypatch.setattr(near_dedup, "_linked", lambda x, y, percent: F.lit(True))  # what is compared in full
        for percent in (85, 70):
            compared.append(near_dedup.sharing_rare(near_dedup.by_rarity(rows, percent), comp, code, rows, percent).count())
        assert compared == [0, n * (n - 1) // 2]
    monkeypatch.undo()
    docs = [*templated(400, 18), *((1000 + d, t) for d, t in templated(100, 2, "e")), (2000, templated(8, 18)[7][1] + " and more")]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == brute_components(docs)


def test_copies_of_one_original_meet_in_the_middle(spark, monkeypatch):
    """Copies that each differ from the original in their own way, and from each other too much: no pairs are left to compare."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(200)]
    rows = [(777, " ".join(base))]
    for d in range(300):
        w = list(base)
        for at in rng.choice(40, 3, replace=False) * 5:
            w[at] = f"d{d}at{at}"
        rows.append((d, " ".join(w)))
    pairs = []
    monkeypatch.setattr(near_dedup, "sharing_rare", lambda *a, was=near_dedup.sharing_rare: pairs.append(a[1].count()) or was(*a))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sum(pairs) <= 30
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == brute_components(rows)


@pytest.mark.parametrize("bits", [20, 6])
def test_the_first_shared_shingle_is_among_the_first_few(bits, monkeypatch):
    """Pairs just at the bound, of equal and of different sizes, however coarse the counts."""
    monkeypatch.setattr(near_dedup, "SKETCH", bits)
    rng = np.random.default_rng(bits)
    for _ in range(200):
        n, m = np.sort(rng.integers(1, 120, 2))
        shared = -(-85 * (n + m) // 185)
        if shared > n:
            continue
        pool = rng.integers(-(1 << 62), 1 << 62, n + m).astype(np.int64)
        x, y = np.sort(pool[:n]), np.sort(pool[n - shared : n - shared + m])
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([x.tolist(), y.tolist()])], ["id", "variant", "members"])
        often = np.bincount(near_dedup._slots(np.concatenate([x, y])), minlength=1 << bits)
        a, b = next(near_dedup._rarest(type("B", (), {"value": often}), 85)(iter([batch]))).to_pylist()
        common = set(a["rare"][: a["smaller"]]) & set(b["rare"])
        assert common and {a["rare"].index(c) for c in common} <= set(a["places"])
        i, j = min((a["rare"].index(c), b["rare"].index(c)) for c in common)
        assert min(n - i, m - j) * 185 >= (n + m) * 85


@pytest.mark.parametrize("tile", [0, 3])
def test_rare_shingles_lose_no_link(spark, monkeypatch, tile):
    """All buckets split by rare shingles, one round of leaders: sizes and similarities on both sides of the bound."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "MIDDLES", tile // 3)
    rng = np.random.default_rng(12)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(20, 200)))]
        for _ in range(25):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                a = int(rng.integers(0, len(w)))
                w[a : a + int(rng.integers(1, 6))] = [f"x{rng.integers(0, 30)}" for _ in range(int(rng.integers(0, 6)))]
            rows.append((len(rows), " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == brute_components(rows)


def test_an_id_of_several_texts_has_the_links_of_each(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(9, a), (5, a), (5, b), (5, b), (7, b + " more"), (3, a + " x"), (8, "other words that stand alone here"), (5, None), (None, a)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got.collect()) == sorted([(9, 36, 3), (5, 36, 3), (5, 36, 3), (5, 36, 3), (7, 37, 3), (3, 37, 3), (8, 2, 8), (5, 0, 5), (0, 36, None)], key=lambda r: (r[0], r[1], r[2] or 0))


def test_codes_estimate_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (850, 75, 75))
    code = near_dedup.codes(near_dedup.signatures([np.concatenate([shared, a]), np.concatenate([shared, b])]))
    x = code[0] ^ code[1]
    differ = sum(bin(int((v | (v >> np.uint64(1))) & np.uint64(0x5555555555555555))).count("1") for v in x)
    estimate = ((near_dedup.HASHES - differ) / near_dedup.HASHES - 0.25) / 0.75
    assert abs(estimate - 0.85) < 0.2 and differ <= near_dedup.most_differences(85)


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(40)]
    root = {x: x for p in links for x in p}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


# mixing -----------------------------------------------------------------------------------------------------


def test_mix(spark, sf_dir):
    docs = read(sf_dir, "documents")
    got = mixing.op2_mixing(spark, sf_dir).toPandas()
    again = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again["size"] * again.copies))
    assert dict(zip(got.doc_id, got["size"])) == {d: len(WORD.findall(t)) for d, t in zip(docs.doc_id, docs.text)}
    sizes = got.merge(docs[["doc_id", "source"]], on="doc_id").groupby("source")["size"].sum()
    target, total = {}, float(sizes.sum())
    order = sorted(sizes.index)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_ = set(order)
    while True:
        rest = total - sum(target.values())
        share = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share >= 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.remove(s)
    target |= {s: weight[s] * share for s in open_}
    got = got.merge(docs[["doc_id", "source"]], on="doc_id")
    for s, g in got.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - target[s]) <= max(60, 0.02 * target[s])
        rate = target[s] / sizes[s] if sizes[s] else 0
        assert abs((g.taken / g["size"].clip(lower=1)).round().sum() - rate * (g["size"] > 0).sum()) <= 3  # documents
    assert (got.taken <= 3 * got["size"]).all()


def test_many_sources_are_ranked_by_ranges(spark):
    rows = [(i, "w " * (i % 7 + 1), f"host{i * 37 % 501:04d}é" if i % 501 else None) for i in range(1503)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).toPandas()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    order = sorted(sizes.index[sizes.index.notna()]) + [None]
    rank = {s: i for i, s in enumerate(order)}
    weight = {s: (5, 2, 1)[rank[s] % 3] for s in order}
    size = {s: int(sizes[s]) if s is not None else int(sizes[sizes.index.isna()].iloc[0]) for s in order}
    held, share = set(), 0.0
    while True:
        share = (sum(size.values()) - sum(3 * size[s] for s in held)) / sum(weight[s] for s in order if s not in held)
        over = {s for s in order if 3 * size[s] <= weight[s] * share}
        if over == held:
            break
        held = over
    for r in got.itertuples():
        s = r.source if isinstance(r.source, str) else None
        assert r.target == pytest.approx(3.0 * size[s] if s in held else weight[s] * share)


def test_take_tells_sources_apart(spark):
    rows = [(1, "same text here", "a")] * 3 + [(1, "same text here", "b"), (2, "b " * 30, "b"), (3, "a " * 5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = collections.Counter((r.doc_id, r.source) for r in mixing.take(docs).collect())
    mixed = mixing.mix(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()
    assert times == {(r.doc_id, r.source): r.n for r in mixed if r.n}


def test_flight_keeps_the_totals():
    """And landing changes nothing that the flight decided: words come out within a few, documents within one."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        p, s = rng.random(400), np.sort(np.exp(rng.normal(5, 1, 400)).astype(int) + 1)[::-1]
        wait = mixing.reserve(p, s)
        after = p.copy()
        after[~wait] = mixing.flight(p[~wait], s[~wait], rng)
        assert after.sum() == pytest.approx(p.sum()) and (after * s).sum() == pytest.approx((p * s).sum())
        open_ = (after > 1e-9) & (after < 1 - 1e-9)
        assert open_.sum() <= 2 + mixing.RESERVE and (after == p)[wait].all()
        landed = mixing.land(after, s)
        assert set(landed) <= {0.0, 1.0} and (landed == np.round(after))[~open_].all()
        assert abs((landed * s).sum() - (p * s).sum()) <= 3 and abs(landed.sum() - p.sum()) < 1 + 1e-6


def test_landing_is_the_nearest():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 9):
        p, s = rng.random(n), rng.integers(0, 90, n)
        ways = [np.array(w) for w in itertools.product((0, 1), repeat=n)]
        over = lambda w: abs((w * s).sum() - (p * s).sum())  # noqa: E731, B023
        got = mixing.land(p, s)
        for slack in range(n + 1):
            fit = min((over(w) for w in ways if abs(w.sum() - p.sum()) < 1 + slack), default=np.inf)
            if fit <= max(1.0, mixing.NEAR * (p * s).sum()):
                break
        assert over(got) == pytest.approx(fit)


def test_flight_is_unbiased():
    p, s = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3]), np.array([3, 5, 8, 2, 9, 4])
    mean = np.mean([mixing.flight(p, s, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "MERGE", 2)
    rows = [(i, "w " * (i % 23 + 1), "a" if i % 3 else None) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("source", dropna=False):
        assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= 12


# language, toxicity -----------------------------------------------------------------------------------------


def test_language(spark, sf_dir):
    docs = read(sf_dir, "documents")
    got = language.op3_language(spark, sf_dir).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() >= 0.95 and got.score.between(0, 1).all()


def test_code_lengths():
    """Against the definition, letter by letter; all bytes after a context share one unit of probability."""
    counts = {"a": collections.Counter({b"abra": 3, b"cadabra": 2}), "b": collections.Counter({b"bad": 4})}
    trees = language.grow(counts)

    def cost(lang, context, symbol):
        seen = collections.Counter()
        for word, n in counts[lang].items():
            s = b" " + word + b" "
            for i in range(1, len(s)):
                if s[max(0, i - len(context)) : i] == context and len(s[:i]) >= len(context):
                    seen[s[i]] += n
        below = (lambda: cost(lang, context[1:], symbol)) if context else (lambda: 8.0)
        if not seen:
            return below()
        total, kinds = sum(seen.values()), len(seen)
        return -np.log2(seen[symbol] / (total + kinds)) if seen[symbol] else -np.log2(kinds / (total + kinds)) + below()

    for word in (b"abra", b"cad", b"zzz", b"bad", b"d"):
        s = b" " + word + b" "
        expected = [sum(cost(x, s[max(0, i - language.ORDER) : i], s[i]) for i in range(1, len(s))) for x in trees.names]
        assert trees.lengths([word])[0] == pytest.approx(expected, rel=1e-5)


def test_toxicity(spark, sf_dir):
    got = toxicity.op6_toxicity(spark, sf_dir.replace("0.001", "0.01")).toPandas()
    m = got.merge(read(sf_dir.replace("0.001", "0.01"), "labels"), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = m[m.held_out]
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.3


def brute_cosines(examples, toxic, texts):
    """By the definition: term weights from counts, unit vectors, all products."""
    split_ = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.translate(LOWER))
    bags, n, n_toxic = [collections.Counter(split_(t)) for t in examples], len(examples), sum(toxic)
    weight = {}
    for w in set().union(*bags):
        a, b = sum(w in x for x, y in zip(bags, toxic) if y), sum(w in x for x, y in zip(bags, toxic) if not y)
        c, d = n_toxic - a, n - n_toxic - b
        phi2 = (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * (a + c) * (b + d))
        weight[w] = np.log(1 + n / (a + b)) * (toxicity.FLOOR + (np.sqrt(phi2) if n * phi2 >= toxicity.CHI else 0))

    def unit(bag):
        v = {w: (1 + np.log(k)) * weight[w] for w, k in bag.items() if w in weight}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = [unit(b) for b in bags]
    for t in texts:
        q = unit(collections.Counter(split_(t)))
        yield [sum(x * v.get(w, 0.0) for w, x in q.items()) for v in vectors]


@pytest.mark.parametrize("words_", [30, 400])
def test_block_max_search_is_exact(words_, monkeypatch):
    """In the production configuration, with all terms; small groups change nothing."""
    rng = np.random.default_rng(2)
    vocabulary = [f"t{i}" for i in range(words_)]
    draw = lambda: " ".join(rng.choice(vocabulary, rng.integers(1, 40), p=np.arange(words_, 0, -1) / (words_ * (words_ + 1) / 2)))
    texts = [draw() for _ in range(500)]
    toxic = np.array([("t1" in t.split()) or ("t20" in t.split()) for t in texts], int)
    ids = rng.permutation(5000)[:500]
    index = toxicity.build(ids, pa.array(texts), toxic)
    assert len(index.terms) == len(set(" ".join(texts).split()))
    asked = [draw() for _ in range(60)] + texts[:20] + ["", "zzz", "t1 " * 500]
    for cells in (1 << 20, 50):
        monkeypatch.setattr(toxicity, "CELLS", cells)
        got = [x for found, cos in index.neighbours(pa.array(asked)) for x in zip(found.tolist(), cos.tolist())]
        for (found, cos), all_ in zip(got, brute_cosines(texts, toxic, asked)):
            best = sorted(((-round(c, 10), int(i)) for c, i in zip(all_, ids) if c > 0))[: toxicity.K]
            assert [round(c, 9) for c, e in zip(cos, found) if e >= 0] == pytest.approx([-c for c, _ in best], abs=1e-8)
            strict = {i for c, i in best if c < best[-1][0] - 1e-8}  # those that no tie at the end decides
            assert strict <= {int(index.ids[e]) for e in found if e >= 0}


def test_votes_are_calibrated():
    rng = np.random.default_rng(8)
    share = rng.random(4000)
    y = (rng.random(4000) < share**3).astype(float)
    x, p = toxicity.monotone(share, y, np.ones(4000), y.mean())
    assert (np.diff(p) >= 0).all() and np.abs(np.interp(np.linspace(0.1, 0.9, 9), x, p) - np.linspace(0.1, 0.9, 9) ** 3).max() < 0.1
    few = toxicity.learn(np.arange(3), ["a b", "c d", "a"], np.array([1, 0, 1]), {0: 9, 1: 1})
    score, near, _ = few.scores(pa.array(["a", "c", "", None], pa.string()))
    assert score[0] > score[2] == score[3] > score[1] and near[0].tolist() == [2, 0] and not len(near[2])
    assert toxicity.learn(np.arange(2), ["a", "b"], np.array([1, 1]), {1: 2}).scores(pa.array(["a", None]))[0].tolist() == [1.0, 1.0]


# quality ----------------------------------------------------------------------------------------------------


def test_quality_measures(spark, sf_dir):
    def brute(t):
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed

    docs = read(sf_dir, "documents")
    got = quality.op5_quality(spark, sf_dir).toPandas().merge(docs, on="doc_id")
    for r in got.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
    m = got.merge(read(sf_dir, "labels"), on="doc_id")
    assert not (got.kept & got.base_failed).any() and m[(m.quality == 1) & ~m.base_failed].kept.mean() > 0.9


@pytest.mark.parametrize("t", ["a\n\na\n", "\n", "", "x y\nx y\n x y", "é  #1\r\né  #1", "a b c d e a b c d e", "ñ b\x0b\n\x0bz"])
def test_quality_of_odd_texts(t):
    x = quality.measure(pa.array(["pre fix\nb", t, None, "pre fix\nb"], pa.string()))
    lines = [y for y in t.split("\n") if WORD.search(y)]
    w = WORD.findall(t)
    assert (x.n_words[1], x.word_chars[1], x.n_dup_lines[1]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
    assert x.n_dup_lines[0] == x.n_dup_lines[3] == 0 and x.n_words[2] == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    doc = np.repeat([0, 2, 5, 6], [6, 1, 4, 9])
    x = rng.normal(size=(len(doc), 3))
    got = quality.viterbi(field, x, doc)
    for d in np.unique(doc):
        gain = x[doc == d] @ field.weights
        paths = itertools.product((0, 1), repeat=len(gain))
        score = lambda p: sum(g for g, y in zip(gain, p) if y) + sum(field.steps[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(got[doc == d]) == max(paths, key=score)


# ball tree --------------------------------------------------------------------------------------------------


def test_top_products(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD", 90)
    monkeypatch.setattr(ball_tree, "QUERIES", 4)
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = duckdb.sql(ball_tree.SQL).df()
    got = ball_tree.op7_top_products(spark, sf_dir).toPandas()
    key = ["query_id", "rank"]
    assert got.sort_values(key).astype("int64").values.tolist() == expected.sort_values(key)[got.columns].astype("int64").values.tolist()


def test_cells_prune_and_copies_are_split(spark, monkeypatch):
    """Clustered vectors, one of them a third of all rows, against all products."""
    monkeypatch.setattr(ball_tree, "SHARD", 50)
    monkeypatch.setattr(ball_tree, "QUERIES", 6)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8)) * 4
    x = (centre[rng.integers(0, 6, 600)] + 0.3 * rng.normal(size=(600, 8))).astype(np.float32)
    x[rng.random(600) < 0.33] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ball_tree.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), F.col("vec_id") % 20 == 0).toPandas()
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    expected = [(q, r + 1, v, -s) for q in range(0, 600, 20) for r, (s, v) in enumerate(sorted((-int(whole[q] @ whole[v]), v) for v in range(600) if v != q)[:5])]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].values.tolist())) == expected
    shards = [pa.RecordBatch.from_pylist([{"home": 0, "block": 0, "q_width": 8, "q_ids": np.arange(1).tobytes(), "q": centre[:1].tobytes(), "floors": np.array([0.9 * float(centre[0] @ centre[0])]).tobytes()}])]
    aimed = pa.Table.from_batches(ball_tree._aim(centre, np.full(6, 0.1))(iter(shards))).to_pylist()
    assert {r["cell"] for r in aimed} == set(np.flatnonzero(centre @ centre[0] + 0.1 * np.linalg.norm(centre[0]) >= 0.9 * centre[0] @ centre[0]).tolist())


def test_products_beyond_doubles(spark):
    """Exact up to 64 bits, at its ends beyond them."""
    rows = [(0, [1.5 * 2.0**20, 3.0]), (1, [2.0**20, 1 / 256]), (2, [2.0**20, 2 / 256]), (3, [1e18, 0.0]), (4, [-1e18, 0.0]), (5, [2.0**20, -(2.0**20)])]
    got = ball_tree.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    q = [int(256 * v) for v in rows[0][1]]
    exact = {i: min(max(sum(a * int(256 * b) for a, b in zip(q, v)), -(2**63)), 2**63 - 1) for i, v in rows[1:]}
    assert [(r.vec_id, r.score) for r in got] == sorted(exact.items(), key=lambda x: (-x[1], x[0])) and exact[3] == 2**63 - 1 and exact[2] == exact[1] + 768


def test_odd_vectors(spark):
    rows = [(0, [1.0, 1.0]), (50, [1.0, None]), (100, [float("nan"), 1.0]), (150, None), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [float("inf"), 0.0]), (None, [1.0, 1.0]), (4, [-1.0, 0.001])]
    got = ball_tree.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 131072), (0, 2, 2, 131072), (0, 3, 4, -65536)]
    assert ball_tree.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


# packing ----------------------------------------------------------------------------------------------------


def test_packing(spark, sf_dir):
    docs, enc = read(sf_dir, "documents"), tokens.Encoder(tokens.vocabulary())
    got = packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.vocabulary()).toPandas()
    for d, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        expected, _ = enc.encode(pa.array([docs.set_index("doc_id").text[d]], pa.string()))
        assert np.concatenate(g.ids.tolist()).tolist() == expected.tolist() and (g.doc_tokens == len(expected)).all()
        assert (g.start == g.length.cumsum() - g.length).all()
    assert (got.ids_crc32 == [zlib.crc32(np.asarray(i, "<u4").tobytes()) for i in got.ids]).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        total = g.length.sum()
        assert (g.offset == g.length.cumsum() - g.length).all() and total <= 2048 and total & (total - 1) == 0
    query = packing.op8_packing(spark, sf_dir).toPandas()
    assert query.length.sum() == got.length.sum() and set(got.doc_id) == set(docs.doc_id)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=40))
def test_packs_fill_their_sequences(lengths):
    found = packing.pack(np.array(lengths), 64)
    room = packing.capacities(sum(lengths), 64)
    used = collections.Counter()
    for _, _, n, k, offset in sorted(found, key=lambda x: (x[3], x[4])):
        assert offset == used[k]
        used[k] += n
    assert [used[k] for k in range(len(room))] == room and sum(room) == sum(lengths)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=30))
def test_pieces_go_where_it_costs_least(lengths):
    """Step by step: descending documents, each to the cheapest sequence that has room for it, else cut at the cheapest with any."""
    cost, room = collections.defaultdict(float), dict(enumerate(packing.capacities(sum(lengths), 64)))
    left = {i: n for i, n in enumerate(lengths)}
    order = sorted(left, key=lambda i: (-lengths[i], i))
    for i, start, n, k, _ in packing.pack(np.array(lengths), 64):
        assert i == order[0] and start == lengths[i] - left[i]
        whole = [j for j in room if room[j] >= left[i]]
        best = min(whole or [j for j in room if room[j] > 0], key=lambda j: (cost[j], j))
        assert k == best and n == min(left[i], room[best])
        room[k], left[i] = room[k] - n, left[i] - n
        cost[k] += packing.LINEAR * n + packing.QUADRATIC * n**2
        if not left[i]:
            order.pop(0)
    assert not order


# line dedup -------------------------------------------------------------------------------------------------


def brute_lines(docs):
    lines = [(d, k, x.encode()) for d, t in sorted(docs) if t is not None for k, x in enumerate(t.split("\n")) if len(x.encode().lower().split()) >= line_dedup.MIN_WORDS]
    return {(d, k) for i, (d, k, x) in enumerate(lines) if any(line_dedup.alike(x, y) for _, _, y in lines[:i])}


def test_duplicate_lines(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary, n)) for n in (5, 7, 10, 12, 18, 25, 33, 39, 41, 60, 80, 150)]
    rows = []
    for d in range(60):
        out = []
        for k in rng.integers(0, len(base), 4):
            w = base[k].split()
            if rng.random() < 0.6:
                at = int(rng.integers(0, len(w)))
                w = w[:at] + ([] if rng.random() < 0.3 else ["NEW" + str(rng.integers(0, 50))]) + w[at + int(rng.random() < 0.6) :]
            out.append("  ".join(w) if d % 5 else " ".join(w).upper())
        rows.append((int(d * 7 % 61), "\n".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {(r.doc_id, r.line_no) for r in line_dedup.duplicate_lines(df).collect()}
    assert found == brute_lines(rows)
    left = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_duplicate_lines(df).collect()}
    for d, t in rows:
        keep = [x for k, x in enumerate(t.split("\n")) if (d, k) not in found]
        assert left[d] == ("\n".join(keep), 4, 4 - len(keep))


def word_edits(docs, shortest, near):
    """Lines with an earlier line equal or one word edit away, of lines with so many words."""
    lines = [(d, k, x.lower().split()) for d, t in sorted(docs) for k, x in enumerate(t.split("\n")) if len(x.split()) >= shortest]

    def one(x, y):
        x, y = sorted((x, y), key=len)
        return len(y) - len(x) < 2 and any(x[:i] + x[i + len(x) + 1 - len(y) :] == y[:i] + y[i + 1 :] for i in range(len(y)))

    return {(d, k) for i, (d, k, x) in enumerate(lines) if any(x == y or min(len(x), len(y)) >= near and one(x, y) for _, _, y in lines[:i])}


@pytest.mark.parametrize("n", [12, 19, 20, 25, 41, 80, 150, 700])
def test_every_word_edit_is_found(spark, n):
    base = [f"w{n}x{i}" for i in range(n)]
    rows = [(0, " ".join(base))]
    for i in range(0, n, max(1, n // 40)):
        other = [f"{i}y{w}" for w in base]  # a line of its own for each edit, so that only that edit can find it
        for k, changed in enumerate((other[:i] + ["NEW"] + other[i + 1 :], other[:i] + other[i + 1 :], other[:i] + ["NEW"] + other[i:])):
            mark = [f"{x}{k}" for x in changed]
            rows += [(10 * i + 2 * k + 1, " ".join(f"{x}{k}" for x in other)), (10 * i + 2 * k + 2, " ".join(mark))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.line_no) for r in line_dedup.drop_duplicate_lines(df).filter("n_dropped = 1").selectExpr("doc_id", "0 AS line_no").collect()}
    assert found == {(d, 0) for d, _ in rows if d and d % 2 == 0}
    if n < 100:
        assert found == word_edits(rows, 5, 10)


def test_lines_with_a_passage_of_their_own_stay(spark):
    """Templated lines that differ in a passage, at each place and of each length from two words up."""
    for n in (20, 40, 49, 100, 400):
        base = [f"t{n}x{i}" for i in range(n)]
        rows = [(0, " ".join(base))]
        for k, size in enumerate((2, 3, 6, n // 3)):
            rows += [(1000 * (k + 1) + at, " ".join(base[:at] + [f"own{k}p{at}q{i}" for i in range(size)] + base[at + size :])) for at in range(0, n - size, max(1, n // 25))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = line_dedup.drop_duplicate_lines(df).filter("n_dropped > 0").collect()
        assert not got, (n, got[0])


def test_short_lines(spark):
    """Equal lines of any length and one-word edits from five words up; an exact copy leaves nothing in the pipeline."""
    import corpus_pipeline as p

    mixed = "Title\n\nA short line\nHere is a line of rather more than nine words in all\nsix words stand in this line\nEnd"
    rows = [(1, mixed), (2, mixed), (3, mixed.upper()), (4, "A short lane\nTitles"), (5, "six words stood in this line\nsix words stand in line\nfour words of this\nfour words of that")]
    rng = np.random.default_rng(4)
    rows += [(6 + d, "\n".join(" ".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 10, 12))) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.line_no) for r in line_dedup.duplicate_lines(df).collect()}
    assert found == word_edits(rows, 1, 5)
    assert found >= {(2, k) for k in (0, 2, 3, 4, 5)} | {(5, 0), (5, 1)} and not found & {(4, 0), (4, 1), (5, 3)}
    left = {r.doc_id: r.text for r in p.drop_lines(spark, df, None).collect()}
    assert left[1] == mixed and left[4] == rows[3][1] and not {2, 3} & set(left)


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_rows_keep_their_lines(spark, parts):
    """Rows with one id and text are one document, in one batch or in several."""
    text = "one two three four five six\nseven eight nine ten eleven twelve"
    rows = [(1, text)] * 2 + [(4, text.upper())] * 2 + [(2, "one two three four five six seven"), (0, "a line of its own that is here"), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    left = collections.Counter((r.doc_id, r.text, r.n_dropped) for r in line_dedup.drop_duplicate_lines(df).collect())
    assert left == collections.Counter([(1, text, 0)] * 2 + [(4, "", 2)] * 2 + [(2, "", 1), (0, rows[5][1], 0), (None, text, 0)])


def test_a_batch_settles_what_its_lines_share():
    """A line, a half and a deletion that very many lines share send few rows, and every line is still accounted for."""
    n = 3000
    part = [f"this line is the same in all\na half that is shared by all of these then n{i} its own words a{i} b{i} c{i} d{i}\npage {i} of the very same document" for i in range(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 1000)), pa.array(part[k : k + 1000])], ["doc_id", "text"]) for k in range(0, n, 1000)]
    out = pa.Table.from_batches(line_dedup._emit(iter(batches))).to_pandas()
    emitted = out[out.place.isin([line_dedup.WHOLE, line_dedup.HALF])]
    assert emitted.groupby("key").size().max() <= 2 * len(batches)
    assert ((out.place == line_dedup.KNOWN) & (out.line_no == 0)).sum() == n - 1
    known = out[out.place == line_dedup.KNOWN]
    assert (known.m_doc < known.doc_id).all()
    lines = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([2] * n, pa.int32()), pa.array([t.split("\n")[2] for t in part])], ["l_doc", "l_line", "l_text"])
    out = pa.Table.from_batches(line_dedup._emit_words(iter([lines]))).to_pandas()
    assert out[out.place != line_dedup.KNOWN].groupby(["key", "place"]).size().max() == 1
    assert set(out[out.place == line_dedup.KNOWN].doc_id) == set(range(1, n))


@pytest.mark.parametrize("words_", [(5, 12), (12, 40), (40, 200)])
def test_every_kind_of_edit_at_any_length(spark, words_):
    """Random replacements, deletions and insertions against a plain comparison of all lines."""
    rng = np.random.default_rng(words_[1])
    rows = []
    for g in range(60):
        base = [f"b{g}w{i}" for i in range(int(rng.integers(*words_)))]
        rows.append((3 * g, " ".join(base)))
        for k in (1, 2):
            at, kind = int(rng.integers(0, len(base))), int(rng.integers(0, 4))
            w = base[:at] + [f"e{rng.integers(0, 3)}"] * (kind != 1) + base[at + (kind != 2) :]
            rows.append((3 * g + k, "  ".join(w[:-2] if kind == 3 else w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r.doc_id, r.line_no) for r in line_dedup.duplicate_lines(df).collect()}
    assert found == word_edits(rows, 1, 5) and len(found) > 60


def test_one_edit():
    brute = lambda x, y: any(x[:i] + x[i + 1 :] == y[:j] + y[j + 1 :] and i == j for i in range(len(x)) for j in range(len(y))) or any(x[:i] + x[i + 1 :] == y for i in range(len(x))) or any(y[:i] + y[i + 1 :] == x for i in range(len(y))) or x == y
    for n, m in itertools.product(range(4), repeat=2):
        for x in itertools.product("ab", repeat=n):
            for y in itertools.product("ab", repeat=m):
                assert line_dedup.one_edit(list(x), list(y)) == brute(list(x), list(y)), (x, y)


# sharding ---------------------------------------------------------------------------------------------------


def test_lookup_table():
    names = [f"s{i}" for i in range(20)]
    t = sharding.lookup_table(names, 2003)
    count = np.bincount(t, minlength=20)
    assert count.max() - count.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 2003)
    stayed = t != 19
    assert (t[stayed] == fewer[stayed]).mean() > 0.8
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8), (["a", "b"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


@pytest.mark.parametrize("n,size", [(1, 7), (3, 11), (7, 101)])
def test_lookup_table_turn_by_turn(n, size):
    """Each shard's permutation written out; then turns."""
    import hashlib

    names = [f"shard {i}" for i in range(n)]
    draw = lambda t, m: int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little") % m
    prefers = [[(draw("offset:" + s, size) + j * (draw("skip:" + s, size - 1) + 1)) % size for j in range(size)] for s in names]
    assert all(sorted(p) == list(range(size)) for p in prefers)
    owner = {}
    for turn in range(size):
        owner[next(slot for slot in prefers[turn % n] if slot not in owner)] = turn % n
    assert sharding.lookup_table(names, size).tolist() == [owner[i] for i in range(size)]


def test_shards(spark, sf_dir):
    got = sharding.op10_sharding(spark, sf_dir).toPandas()
    table = sharding.lookup_table([f"shard-{i:03d}" for i in range(96)])
    assert (got.shard == table[got.slot]).all() and got.doc_id.is_unique and len(got) == len(read(sf_dir, "documents"))


# odd tables -------------------------------------------------------------------------------------------------

ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words in here, more than ten of them, so there", "en", "a", 5), (3, "x" * 300_000, "en", None, 1), (4, "a b " * 60_000, None, "b", 1), (4, "a b " * 60_000, None, "b", 1), (5, "日本 \n\n語", "ja", "b", 3), (6, "The same line of words here\n" * 3, "en", "c", 9), (7, "The same line of words here", "en", "c", 9)]


def every_operator(spark, docs, labels):
    yield "near", near_dedup.near_duplicates(docs)
    yield "mix", mixing.mix(docs)
    yield "take", mixing.take(docs)
    yield "language", language.predict(docs.withColumn("held_out", F.lit(False)), language.fit(docs))
    yield "toxicity", toxicity.score(docs.withColumn("held_out", F.lit(False)), toxicity.fit(docs, labels))
    yield "quality", quality.judge(docs, quality.fit(docs, labels))
    yield "keep", quality.keep_good(docs, quality.fit(docs, labels))
    yield "pack", packing.pack_documents(docs, tokens.vocabulary())
    yield "lines", line_dedup.drop_duplicate_lines(docs)
    yield "shard", sharding.shard_rows(docs, "doc_id", ["a", "b"])


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_tables(spark, tmp_path, rows):
    extra = ", n_lines string, slot string, key int, id string, component_id int, held_out string, __found int"
    docs = spark.createDataFrame([(*r, "x", "y", 1, "z", 2, "h", 3) for r in rows], DOCS + extra)
    labels = spark.createDataFrame([(2, 1, 0), (6, 0, 1), (None, 1, None)] if rows else [], "doc_id long, quality int, toxic int")
    got = {name: df.toPandas() for name, df in every_operator(spark, docs, labels)}
    for name in ("near", "mix", "language", "toxicity", "quality", "lines", "shard"):
        assert len(got[name]) == len(rows), name
    token_files.write_ids(docs, str(tmp_path / "ids"), tokens.vocabulary())
    assert token_files.read_ids(spark, str(tmp_path / "ids")).count() == len(rows)
    if rows:
        near = got["near"].set_index("n_shingles")
        assert got["near"].component_id.isna().sum() == 1 and near.index.min() == 0
        assert got["language"].set_index("doc_id").lang_pred[1] == "und" and len(got["pack"]) > len(rows)
        assert got["lines"].set_index("doc_id").text[6] == "The same line of words here\n" and got["lines"].set_index("doc_id").n_dropped[7] == 1
        assert got["mix"]["size"].sum() == sum(len(WORD.findall(r[1] or "")) for r in rows)


# the pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, at, texts = docs.columns, docs, {}
    for name, stage in p.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        at = spark.createDataFrame(at.toPandas(), docs.schema)
        assert at.columns == columns, name
        texts[name] = at.toPandas()
    rules, lines, near, mixed = texts.values()
    judged = quality.op5_quality(spark, sf_dir).toPandas()
    assert set(rules.doc_id) == set(judged[judged.kept].doc_id)
    gone = brute_lines([(d, t) for d, t in zip(rules.doc_id, rules.text)])
    expected = {}
    for d, t in zip(rules.doc_id, rules.text):
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        if kept == t or WORD.search(kept):
            expected[d] = kept
    assert dict(zip(lines.doc_id, lines.text)) == expected and (lines.n_chars == lines.text.str.len()).all()
    assert set(near.doc_id) == {d for d, (_, _, kept) in brute_components(zip(lines.doc_id, lines.text)).items() if kept}
    assert set(mixed.doc_id) <= set(near.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    packed = p.run(spark, sf_dir).toPandas()
    assert packed.groupby(["doc_id"]).doc_tokens.first().sum() > 0 and packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()


CLASH = [("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"), ("n_dropped", "int"), ("kept", "string"), ("component_id", "int"), ("__found", "int"), ("size", "string"), ("__copy", "int"), ("key", "string")]


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_of_odd_tables(spark, tmp_path, kind):
    """Nulls, repeated rows, ties, empty and long texts and clashing columns, through every stage; and no rows at all."""
    import corpus_pipeline as p

    own = lambda k: f"Document {k} says that " + ", ".join(f"thing{k}x{i} is near place{k}y{i}" for i in range(60)) + f".\nIts last line has word{k}a and word{k}b and then word{k}c."
    rows = [(k, own(k), "en", "s" if k % 2 else None, 5) for k in range(6)]
    rows += [rows[3], (30, own(3), "en", "s", 5), (None, own(7), None, "s", None), (8, None, None, None, None), (9, "", "en", "s", 0), (31, own(4).replace("says that", "told us").replace("last line has", "end got"), "en", "t", 7), (32, own(8) + "\n" + "w1 w2 w3 " * 40_000 + "\n" + own(9), "en", "t", 1)]
    schema = ", ".join(" ".join(c) for c in CLASH)
    docs = spark.createDataFrame([(*r, 1, "k", 2, 3, "z", 4, "y") for r in rows] if kind == "odd" else [], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(6)] + [(8, 0, 0)] if kind == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in p.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, str(tmp_path)).collect(), docs.schema)
        assert at.columns == docs.columns, name
        kept.append(at.toPandas())
    packed = p.run(spark, str(tmp_path)).toPandas()
    if kind == "empty":
        assert not len(packed) and not any(map(len, kept))
        return
    rules, lines, near, mixed = kept
    assert {8, 9, 32}.isdisjoint(rules.doc_id.dropna()) and set(range(6)) <= set(rules.doc_id.dropna()) and (rules.doc_id == 3).sum() == 2
    assert 30 not in set(lines.doc_id) and (lines[lines.doc_id == 3].text == own(3)).all() and lines.doc_id.isna().sum() == 1
    assert set(near.doc_id.dropna()) == set(lines.doc_id.dropna()) - {31} and near.doc_id.isna().sum() == 1
    assert len(mixed) and set(mixed.doc_id.dropna()) <= set(near.doc_id.dropna()) and set(packed.doc_id.dropna()) == set(mixed.doc_id.dropna())
