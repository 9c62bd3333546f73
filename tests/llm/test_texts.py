"""Classifiers, near-duplicates, tokens, contamination and substrings."""

import hashlib
import os
import random
import tracemalloc
import zlib
from collections import defaultdict
from itertools import combinations

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import binary, bpe, bwt, common, compression, decontaminate, neardup, rans, substrings, toxicity
from gaugeflow.llm.queries import tokenizer_path
from gaugeflow.llm.words import find_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def _packed(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_words():
    texts = ["Ab, cD1é", "", None, "x", "...", "e nd", "start ÜÄ-z", "a" * 9]
    data, offsets = _packed(texts)
    starts, ends, hashes, bounds = find_words(data, offsets)
    got = [data[s:e].tobytes().decode().translate(corpus.LOWER) for s, e in zip(starts, ends)]
    assert got == [w for t in texts for w in corpus.words(t)]
    assert np.diff(bounds).tolist() == [len(corpus.words(t)) for t in texts]
    again = find_words(*_packed(["zz ab"]))[2]
    assert again[1] == hashes[0]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(300):
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = corpus.prose(rng, rng.randrange(20, 90))
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        if toxic:
            text += rng.choice([" vilegrub", " nastytoad"]) + " " + corpus.prose(rng, 9)
        docs.append((i, text, "a"))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 0), (2, None, None), (7777, 0, 1)]
    docs += [(900, None, None), (901, "", "a"), (902, "x" * 200_000, "a"), (3, docs[3][1], "a"), (None, "odd", "a")]
    return (
        corpus.documents(spark, docs),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {i: (q, t) for i, q, t in labels},
    )


def _held_out(n):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == 1


@pytest.mark.parametrize("module,column,least", [(compression, 0, 0.95), (toxicity, 1, 0.95)])
def test_classifier_on_held_out_rows(spark, labelled, module, column, least):
    docs, labels, truth = labelled
    model = module.train(docs, labels, _held_out(3))
    got = module.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] in range(300) and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [(r["score"] >= 0.5) == truth[r["doc_id"]][column] for r in held if truth[r["doc_id"]][column] is not None]
    assert sum(right) / len(right) >= least
    assert sorted(map(str, module.score(docs.repartition(7), model).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("module", [compression, toxicity])
def test_classifier_without_labels_or_rows(spark, labelled, module):
    docs, labels, _ = labelled
    model = module.train(docs, labels.limit(0), _held_out(3))
    assert {round(r["score"], 6) for r in module.score(docs, model).collect()} == {0.5}
    assert module.score(corpus.empty(spark), model).count() == 0


def _shingles(text):
    w = corpus.words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_lose_no_link(spark):
    rng = random.Random(3)
    data = corpus.rows()
    base = corpus.prose(rng, 120).split(" ")
    for i in range(40):  # chains and groups around the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(99)}"
        data.append((500 + i, " ".join(w), "a"))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(corpus.documents(spark, data)).collect()}
    sets = {i: _shingles(t) for i, t, _ in data}
    text = {i: t or "" for i, t, _ in data}
    for a, b in combinations(sorted(sets), 2):
        same = got[a]["class_id"] == got[b]["class_id"]
        whole = len(sets[a] | sets[b])
        if text[a] == text[b] or (whole and len(sets[a] & sets[b]) / whole >= 0.85):
            assert same, (a, b)
    for r in got.values():
        assert r["kept"] == (r["doc_id"] == r["class_id"])
        near = [i for i, o in got.items() if o["class_id"] == r["class_id"]]
        if len(near) > 1 and sets[r["doc_id"]]:
            best = max(len(sets[r["doc_id"]] & sets[i]) / len(sets[r["doc_id"]] | sets[i]) for i in near if i != r["doc_id"])
            assert best >= 0.7
    assert neardup.near_duplicates(corpus.empty(spark)).count() == 0


def test_few_rows_pass_a_sieve(spark):
    rows = spark.range(-10_000, 10_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = rows.where("doc_id % 5 = 0")
    ids = ids.select("doc_id").union(ids.select("doc_id").limit(7))
    left = neardup._sieved(rows, ids)
    assert left.columns == ["doc_id", "text"]
    got = [r["doc_id"] for r in left.collect()]
    assert len(got) == len(set(got)) and {i for i in range(-10_000, 10_000) if i % 5 == 0} <= set(got)
    assert len(got) < 4_000 + 16_000 / 8
    assert neardup._sieved(rows, ids.where("false")).count() == 0


def test_texts_of_no_bucket_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(6)
    data = [(i, corpus.prose(rng, 200), "a") for i in range(300)]
    data += [(1000 + i, data[i][1] + " end", "b") for i in range(10)]
    profiled = []

    def watched(df, name="table", keep=neardup.saved):
        if name == "profiles":
            plan = df._jdf.queryExecution().optimizedPlan()
            profiled.append(plan.toString())
        return keep(df, name)

    monkeypatch.setattr(neardup, "saved", watched)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(corpus.documents(spark, data)).collect()}
    assert all(got[1000 + i] == i for i in range(10))
    assert "broadcast" in profiled[0] and "_bitmap" in profiled[0]


def test_far_pairs_of_a_bucket_are_compared(spark):
    star = spark.createDataFrame(
        [(1, 2, 0.9), (1, 3, 0.7), (1, 4, 0.65), (1, 5, 0.1), (1, 6, 0.05)], "a long, b long, similarity double"
    )
    members = spark.createDataFrame([(7, i, 1) for i in range(1, 7)], "bucket long, doc_id long, leader long")
    pool = np.sort(np.random.default_rng(4).integers(1, 2**63, 300).astype(np.uint64))
    hashes = [pool[:200] if i < 6 else pool[60:260] for i in range(1, 7)]
    profiles = spark.createDataFrame(
        [(i, bytearray(h.tobytes()), bytearray(np.ones(200, np.float32).tobytes())) for i, h in enumerate(hashes, 1)],
        "doc_id long, hashes binary, weights binary",
    )
    got = {tuple(r) for r in neardup._pairs_left(members, star, profiles, 0.8, 32).collect()}
    assert got == {(2, 3), (3, 4)}  # (5, 6) differ in about half of their draws


def test_draws_agree_as_often_as_the_texts_are_similar():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 900).astype(np.uint64)
    a, b = np.sort(pool[:700]), np.sort(pool[200:])
    weight = dict(zip(pool.tolist(), rng.choice([1.0, 1.2, 2.5, 4.0], 900)))
    wa, wb = (np.array([weight[x] for x in s.tolist()]) for s in (a, b))
    wb[::7] *= 2
    one = neardup.draws(a, wa, np.array([0, len(a)]), 4000)
    two = neardup.draws(b, wb, np.array([0, len(b)]), 4000)
    similarity = neardup.weighted_jaccard(a, wa, b, wb)
    assert (one == two).mean() == pytest.approx(similarity, abs=0.04)


def test_pieces_give_the_tokenizers_ids():
    rng = random.Random(2)
    texts = ["", "it's  we'll", "é × ÷ a×b", "<|endoftext|> hi", "a b c　d", "日本 語", "A " * 50, None]
    texts += ["".join(rng.choice("ab é×.,'! \n\t1ß <|>sS") for _ in range(50)) for _ in range(400)]
    own = bpe.PieceEncoder(tokenizer_path())
    ids, counts = own.encode(*_packed(texts))
    expected = [e.ids for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert np.split(ids, np.cumsum(counts)[:-1])[3].tolist() == expected[3]
    assert ids.tolist() == [i for e in expected for i in e] and counts.tolist() == [len(e) for e in expected]


def test_known_pieces_take_little_memory(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{a:x}y" for a in rng.integers(0, 2**40, 10_000)) for _ in range(4)]
    data, offsets = _packed(texts)
    bpe.PieceEncoder(tokenizer_path()).encode(data, offsets)  # fills tables that all share
    own = bpe.PieceEncoder(tokenizer_path())
    tracemalloc.start()
    try:
        ids, counts = own.encode(data, offsets)
        found = ids.nbytes + counts.nbytes
        held = tracemalloc.get_traced_memory()[0] - found
    finally:
        tracemalloc.stop()
    assert len(own.known) > 39_000
    assert held - own.flat.nbytes < 50 * len(own.known)
    again = own.encode(data, offsets)[0]
    monkeypatch.setattr(bpe, "MOST_PIECES", 5_000)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 20_000)
    fresh = bpe.PieceEncoder(tokenizer_path()).encode(data, offsets)[0]
    assert ids.tolist() == again.tolist() == fresh.tolist()


def test_tasks_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "_give_back", lambda: given.append(1))
    assert list(common.tidy(lambda rows: (2 * r for r in rows))(iter([1, 2]))) == [2, 4]
    assert given == [1]


@pytest.mark.parametrize("n", [0, 1, 1023, 1025, rans.LANES * rans.CHECK_STEPS + 7])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint32)
    table = rans.Table.from_bytes(rans.Table.of(ids).to_bytes())
    block = rans.Block.from_bytes(rans.encode_block(ids, table).to_bytes())
    assert (rans.decode_block(block, table) == ids).all()
    if n > rans.LANES * rans.CHECK_STEPS:  # from a checkpoint alone
        assert (rans.decode_part(block, 1, table, table.slots()) == ids[-7:]).all()
    if n > 1:
        raw = rans.encode_block(ids, table).to_bytes()
        head = 24 + 8 * (2 * len(block.checks) + 1)
        words = raw[:head] + bytes(b ^ 0x15 for b in raw[head:])
        with pytest.raises((rans.Corrupt, IndexError, ValueError)):
            rans.decode_block(rans.Block.from_bytes(words), table)


def test_token_files(spark):
    data = corpus.rows() + [(None, "no id", "a")]
    path = binary.write_tokens(corpus.documents(spark, data), tokenizer_path(), segment_ids=3000)
    got = binary.token_index(spark, path).collect()
    own = bpe.PieceEncoder(tokenizer_path()).tokenizer
    start = 0
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (i, t, _) in zip(sorted(got, key=lambda r: r["start"]), ordered):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(data)
    nothing = binary.write_tokens(corpus.empty(spark), tokenizer_path())
    assert binary.token_index(spark, nothing).count() == 0


@pytest.mark.parametrize("most_words", [10**6, 30])
def test_contamination(spark, most_words):
    rng = random.Random(8)
    items = [(i, corpus.prose(rng, n)) for i, n in enumerate((30, 20, 13, 5, 1, 40))]
    items += [(10, None), (11, ""), (12, items[1][1]), (13, items[0][1] + " tail " + items[1][1]), (None, "rare word")]
    data = corpus.rows() + [(800, f"x {items[0][1].upper()} y", "a"), (801, items[1][1] * 2, "a")]
    data += [(802, " ".join(items[5][1].split(" ")[3:17]), "a"), (803, "a rare\nWORD " * 3, "a"), (804, items[3][1], "a")]
    df = spark.createDataFrame(items, "item_id long, text string")
    automata = decontaminate.item_automata(df, most_words=most_words)
    assert (automata.count() > 1) == (most_words == 30)
    docs = corpus.documents(spark, data).withColumn("_hits", F.lit("mine")).withColumn("_items", F.lit("too"))
    columns = ["doc_id", "_hits", "_items"]
    got = decontaminate.contamination(docs, df, columns=columns, most_words=most_words).collect()
    assert all(r["_hits"] == "mine" and r["_items"] == "too" for r in got)
    windows = defaultdict(set)
    for i, t in items:
        w = corpus.words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    text = {i: t for i, t, _ in data}
    for r in got:
        w, found, hit = corpus.words(text[r["doc_id"]]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit |= set(range(k, k + n))
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(found))
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        raw = (text[r["doc_id"]] or "").encode()
        assert sum(len(corpus.words(raw[s["start"] : s["end"]].decode())) for s in r["spans"]) == len(hit)
    assert len(got) == len(data)
    assert decontaminate.contamination(corpus.empty(spark), df, most_words=most_words).count() == 0
    none = decontaminate.contamination(corpus.documents(spark, data), df.limit(0)).collect()
    assert len(none) == len(data) and not any(r["n_hit"] or r["contaminated"] for r in none)


def test_spans_are_cut_out(spark):
    rng = random.Random(4)
    item = corpus.prose(rng, 15)
    docs = corpus.documents(spark, [(1, f"é start {item}; end", "a"), (2, "clean", "a"), (3, None, "a")])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs, items).collect()}
    left = got[1].replace(" ", "")
    assert left.startswith("éstart") and left.endswith(";end") and len(got[1]) < 20
    assert got[2] == "clean" and got[3] is None


def _repeats(data, length):
    first = {}
    for i, raw in data:
        for s in range(len(raw) - length + 1):
            key = raw[s : s + length]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, raw in data:
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("symbols", [2 << 20, 3000])
def test_repeated_substrings(spark, monkeypatch, symbols):
    monkeypatch.setattr(substrings, "MERGED_SYMBOLS", symbols)
    data = [r for r in corpus.rows() if len(r[1] or "") < 20_000]
    rng = random.Random(6)
    shared = corpus.prose(rng, 12)
    data += [(300 + i, corpus.prose(rng, 5) + shared[i : i + 60] + corpus.prose(rng, 5), "a") for i in range(9)]
    data += [(400, "ab" * 90, "a"), (401, "ab" * 80 + "b\x00a" * 30, "a"), (402, "b\x00a" * 40, "a")]
    got = substrings.without_repeats(corpus.documents(spark, data), parts=3).collect()
    mine = [
        (r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in got
    ]
    assert sorted(mine) == sorted(_repeats([(i, (t or "").encode()) for i, t, _ in data], 50))
    assert substrings.without_repeats(corpus.empty(spark), parts=2).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_merged_transforms(seed):
    rng = random.Random(seed)
    sets = [[bytes(rng.choices(b"\x01\x02\x03", k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))] for _ in range(4)]
    shards, texts = [], []
    for strings in sets:
        text = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8)
        shards.append(bwt.transform(text, np.flatnonzero(text == 0)))
        texts.append(text.tobytes())
    for depth in (1, 4, 40):
        source, interval = bwt.merge(shards, depth)
        suffixes = []
        for shard, text in zip(shards, texts):
            for s in shard.suffixes.tolist():
                suffixes.append(text[s : text.index(b"\x00", s)])
        prefixes = [suffixes[s][:depth] for s in source.tolist()]
        assert prefixes == sorted(prefixes)
        for i in range(1, len(prefixes)):
            same = prefixes[i] == prefixes[i - 1] and len(prefixes[i]) == depth
            assert same == (interval[i] == interval[i - 1])


def _edited(n, seed):
    """Two texts' shingles, a share of them with unequal counts, and a share edited."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(1, 2**63, int(n * 1.05)).astype(np.uint64)
    a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[: int(n * 0.97)], pool[n : n + int(n * 0.03)]]))
    heavy = pool[: int(0.03 * n)]
    return a, np.where(np.isin(a, heavy), 5.0, 1.25), b, np.where(np.isin(b, heavy), 3.0, 1.25)


@pytest.mark.parametrize("n", [1_000, neardup.LONG_TEXT, 2 * neardup.LONG_TEXT])
def test_table_draws_agree_up_to_twice_the_length_they_serve(n):
    a, wa, b, wb = _edited(n, seed=n)
    one, two = (neardup.draws(h, w, np.array([0, len(h)]), 1500) for h, w in ((a, wa), (b, wb)))
    assert (one == two).mean() == pytest.approx(neardup.weighted_jaccard(a, wa, b, wb), abs=0.03)


@pytest.mark.parametrize("n", [300, 100_000])
def test_long_draws_agree_at_any_length(n):
    a, wa, b, wb = _edited(n, seed=5)
    count = 1500 if n < 1000 else 300
    one, two = neardup.long_draws(a, wa, count), neardup.long_draws(b, wb, count)
    similarity = neardup.weighted_jaccard(a, wa, b, wb)
    assert (one == two).mean() == pytest.approx(similarity, abs=4 * (similarity * (1 - similarity) / count) ** 0.5)


def test_long_texts_and_rows_without_id_are_classed(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LONG_TEXT", 150)
    rng = random.Random(12)
    base = corpus.prose(rng, 900).split(" ")
    data = [(9, " ".join(base), "a"), (4, " ".join([*base[:300], "odd", *base[301:]]), "a"), (7, corpus.prose(rng, 900), "a")]
    data += [(None, data[0][1], "b"), (None, data[0][1], "b"), (None, "alone and without a number at all", "b")]
    data += [(None, "alone and without a number at all", "b"), (None, None, "b"), (None, "", "b"), (None, "others of it", None)]
    other = " ".join([*base[:600], "strange", *base[601:]])
    data += [(None, other, "b")]
    got = neardup.near_duplicates(corpus.documents(spark, data)).collect()
    assert len(got) == len(data)
    by_class = defaultdict(list)
    for r in got:
        by_class[r["class_id"], r["class_size"]].append(r)
    assert len(by_class[4, 5]) == 5 and [r["doc_id"] for r in by_class[4, 5] if r["kept"]] == [4]
    assert [r["doc_id"] for r in by_class[7, 1]] == [7]
    assert sorted(r["text_id"] is None for r in by_class[4, 5]) == [False] * 4 + [True]
    # Two texts of two rows each, of which nothing else is alike, and one of one row.
    assert sorted((size, len(rows)) for (class_id, size), rows in by_class.items() if class_id is None) == [(1, 1), (2, 4)]
    assert all(r["kept"] for (class_id, _), rows in by_class.items() if class_id is None for r in rows)


def test_weighted_links_at_the_threshold_are_found(spark):
    """Against all pairs, with the weights the operator gives; repeated lines weigh more."""
    rng = random.Random(21)
    data, n = [], 0
    for _ in range(12):
        base = corpus.prose(rng, 150).split(" ")
        line = corpus.prose(rng, 9).split(" ")
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(999)}"
            data.append((n, " ".join(words + line * rng.randrange(1, 5)), "a"))
            n += 1
    docs = corpus.documents(spark, data)
    rarity = neardup.Rarity.of(docs)
    profile = {}
    for i, text, _ in data:
        h, counts, _ = neardup.distinct_shingles(*_packed([text]))
        profile[i] = (h, rarity.weight(rarity.level(h), counts).astype(np.float32))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    parent = {i: i for i in profile}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(a, b) for a, b in combinations(profile, 2) if neardup.weighted_jaccard(*profile[a], *profile[b]) >= 0.8]
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    lost = sum(got[a] != got[b] for a, b in links)
    assert len(links) > 100 and lost <= 0.01 * len(links)
    assert all(root(i) == root(c) for i, c in got.items())


def test_learning_does_not_depend_on_the_order_of_repeats(spark, labelled):
    docs, labels, _ = labelled
    again = docs.where("doc_id < 60").withColumn("text", F.concat(F.lit("zzz "), "text"))
    other = labels.where("doc_id < 90").withColumns({"quality": F.lit(0), "toxic": F.lit(0)})
    for module in (compression, toxicity):
        got = []
        for seed in (1, 2, 3):
            d, lab = (x.orderBy(F.rand(seed)).repartition(5) for x in (docs.unionByName(again), labels.unionByName(other)))
            model = module.train(d, lab, _held_out(3))
            got.append(sorted(map(str, module.score(docs, model).collect())))
        assert got[0] == got[1] == got[2]


def test_toxicity_equals_a_plain_model(spark, labelled):
    """Features by slicing, ratios by counting, scores by adding up."""
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels, _held_out(3))
    texts = {r["doc_id"]: (r["text"] or "").translate(corpus.LOWER) for r in docs.collect()}

    def grams(text):
        return {text[i : i + n] for n in toxicity.ORDERS for i in range(len(text) - n + 1)}

    def feature(gram):
        return int(toxicity.gram_hashes(np.array([ord(c) for c in gram], np.uint64), len(gram))[0])

    own = {i: {feature(g) for g in grams(t)} for i, t in texts.items() if len(t) < 1000}
    for i, found in list(own.items())[:40]:
        raw = np.frombuffer(texts[i].encode(), np.uint8)
        assert set(toxicity.distinct_features(toxicity._codes(raw)).tolist()) == found
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, found in own.items():
        z = model.intercept + sum(model.weights[f] for f in found)
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    counts = np.array([[3, 0, 5], [1, 4, 5]])
    ratio = toxicity.log_count_ratio(counts, np.array([10, 5]))
    expected = [np.log((c1 + 1) / 7) - np.log((c0 + 1) / 12) for c0, c1 in counts.T]
    assert ratio == pytest.approx(expected)


def test_compression_features_equal_plain_compression(spark, labelled):
    docs, labels, _ = labelled
    model = compression.train(docs, labels, _held_out(3))
    import zstandard

    def size(raw, dictionary):
        made = zstandard.ZstdCompressor(
            level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False,
            write_content_size=False, write_dict_id=False,
        )
        return sum(len(made.compress(raw[i : i + 1024])) for i in range(0, max(1, len(raw)), 1024))

    scores = {r["doc_id"]: r["score"] for r in compression.score(docs, model).collect()}
    for row in docs.limit(60).collect():
        raw = (row["text"] or "").encode()
        good, bad = size(raw, model.good), size(raw, model.bad)
        x, rate = (bad - good) / (good + bad), (good + bad) / (2 * (len(raw) + 16))
        parts = np.array([x, rate, rate * rate, x * rate, x * abs(x)])
        z = model.weights[0] + ((parts - model.center) / model.scale) @ np.array(model.weights[1:])
        assert scores[row["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)
