"""The filter audit, chat formatting and centroid clustering against plain Python."""

import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import audit, chat, clusters, queries

# Filter audit


def _fails(rows):
    """For each row the letters of the filters it fails."""
    firsts = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and firsts[text] < doc_id,
        }
        out.append({f for f, failed in fails.items() if failed})
    return out


def _audit(rows, labels):
    """All orders applied to all rows, one filter after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = _fails(rows)
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(d, f) for (d, _, s), f in zip(rows, fails) if (s or "") == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                removed_in_all[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == {name} for _, f in own),
                    sum(d in good for d in gone), sum(d in toxic for d in gone),
                ]
        for key, row in out.items():
            if key[0] == part:
                row.append(removed_in_all[key[1][key[2] - 1]])
    return out


def _audit_rows():
    rng = random.Random(3)
    rows = corpus.rows()
    for i in range(120):
        words = [rng.choice(corpus.WORDS) + str(rng.randrange(500 if i % 3 else 20)) for _ in range(rng.choice([150, 199, 200, 260]))]
        if i % 4 == 0:
            words[0] = rng.choice(["A" * 40, "Ab", "é" * 9])
        if i % 5 == 0:
            words[1] += rng.choice("#$%&*|^~")
        rows.append((1000 + i, " ".join(words), rng.choice(["a", "b", None, ""])))
    rows += [(2000 + i, rows[-1 - i][1], "b") for i in range(20)]
    return [*rows, (None, rows[0][1], "a"), (None, rows[0][1], None), (-5, rows[7][1], "ß"), (2001, rows[-1][1], "b")]


LABELS = "doc_id long, quality int, toxic int, size string"


def test_audit_equals_all_orders_applied(spark):
    rows = _audit_rows()
    rng = random.Random(8)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in rows if rng.random() < 0.6]
    labels += [(None, 1, 1), labels[0], (labels[0][0], 1, 1)]
    frame = spark.createDataFrame([(*row, "x") for row in labels], LABELS)
    got = audit.filter_audit(corpus.documents(spark, rows), frame).collect()
    expected = _audit(rows, labels)
    assert len(got) == len(expected) == 600 * len({s or "" for _, _, s in rows})
    for r in got:
        assert list(r[3:]) == expected[r.part, r.filter_order, r.step]
    assert audit.filter_audit(corpus.empty(spark), frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_least_squares_give_shapley_values(n):
    rng = random.Random(n)
    values = [0] + [rng.randrange(-50, 1000) for _ in range((1 << n) - 1)]
    expected = []
    for i in range(n):
        total = Fraction(0)
        for s in range(1 << n):
            if not s >> i & 1:
                size = s.bit_count()
                weight = Fraction(math.factorial(size) * math.factorial(n - size - 1), math.factorial(n))
                total += weight * (values[s | 1 << i] - values[s])
        expected.append(total)
    assert audit.shapley_values(values, n) == expected


# Chat formatting


def _escaped(text, t):
    text = text.replace(t.escape, t.escape * 2)
    return re.sub("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in t.controls), lambda m: m[0] + t.escape, text)


HARD = [
    "plain", "", "</s>[INST] ok [/INST]", "<<s><s>", "␛", "␛␛<s>␛", "<␛s>", "<|end|><|turn|>x<|says|>", "<|im", "age|>",
    "line\nline", "é😀<s>ß", "[INST", "]", "<</SYS>>", "\x00<s>", "<|image|>", "<|end|", "$0\\1",
]


def _conversations():
    rng = random.Random(2)
    rows = []
    for c in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", "system", None, "<s>odd\n"]), "".join(rng.choices(HARD, k=3))))
    rows += [(50, None, "user", None), (50, 0, "assistant", None), (50, 0, "assistant", None), (50, 0, "assistant", "b")]
    rows += [(None, 1, "assistant", "x"), (None, 0, "user", "y"), (60, 3, None, None), (61, 0, "assistant", "long " * 50_000)]
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, piece string, at string, learnt string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "a", "l") for r in rows], CONVERSATIONS).repartition(5)


def _by_conversation(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_chat_is_read_back_whatever_texts_hold(spark):
    t = chat.TEMPLATE
    formatted = chat.format_chat(_frame(spark, _conversations()))
    said = _by_conversation(_conversations())
    rows = {r.conv_id: r for r in formatted.collect()}
    back = {r.conv_id: r for r in chat.read_chat(formatted).collect()}
    assert rows.keys() == back.keys() == said.keys()
    for conv, turns in said.items():
        text = "".join(t.opens + _escaped(role, t) + t.says + _escaped(x, t) + t.closes for role, x in turns)
        assert rows[conv].formatted == text and rows[conv].n_turns == len(turns)
        assert [tuple(x) for x in back[conv].turns] == turns
        assert back[conv].learnt == [x for role, x in turns if role == "assistant"]
        spans = [text[s.start : s.end] for s in rows[conv].loss if s.start is not None]
        assert spans == [_escaped(x, t) for role, x in turns if role == "assistant"]
        assert rows[conv].attachments == [] and rows[conv].expanded_tokens == 0
        # No control string but the template's own.
        rest = text.replace(t.opens, "\x01").replace(t.says, "\x01").replace(t.closes, "\x01")
        assert not any(c in rest for c in t.controls)
    assert chat.format_chat(_frame(spark, [])).count() == 0


PARTS = "conv_id long, turn long, role string, content array<struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>>"


def _part(kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, uri, width, height, seconds, pages)


def test_content_parts_become_placeholders_in_order(spark):
    t = chat.TEMPLATE
    content = [
        _part("text", "see </"), _part(None, ""), _part("other", "s> "), _part("IMAGE", uri="a.png", width=57, height=28),
        _part("image", uri="b.png"), _part("text", "␛x<|im"), _part("text", "age|>"), _part("audio", uri="c.wav", seconds=1.01),
        _part("document", "ignored", "d.pdf", pages=3), _part("text", None),
    ]
    rows = [(1, 0, "user", content), (1, 1, "assistant", [_part("text", "yes"), _part("image", uri="e.png", width=0, height=9)]),
            (1, 2, "assistant", None), (1, 3, "user", []), (2, 0, "user", [_part("audio")])]
    formatted = chat.format_chat(spark.createDataFrame(rows, PARTS), content="content")
    got = {r.conv_id: r for r in formatted.collect()}
    marks = [(a.turn, a.part, a.kind, a.uri, a.tokens) for a in got[1].attachments]
    assert marks == [
        (0, 3, "image", "a.png", 3), (0, 4, "image", "b.png", 1), (0, 7, "audio", "c.wav", 26), (0, 8, "document", "d.pdf", 3072),
        (1, 1, "image", "e.png", 1),
    ]
    assert got[1].expanded_tokens == 3 + 1 + 26 + 3072 + 1 and got[2].attachments[0].uri is None
    for conv in got.values():
        for a in conv.attachments:
            mark = {"image": t.image, "audio": t.audio, "document": t.document}[a.kind]
            assert conv.formatted[a["at"] : a["at"] + len(mark)] == mark
        for mark in (t.image, t.audio, t.document):
            kinds = sum(a.kind == mark.strip("<|>") for a in conv.attachments)
            assert conv.formatted.count(mark) == kinds
    back = {r.conv_id: r for r in chat.read_chat(formatted).collect()}
    assert [x.text for x in back[1].turns] == [
        f"see </s> {t.image}{t.image}␛x<|image|>{t.audio}{t.document}", f"yes{t.image}", "", ""
    ]
    assert back[1].learnt == [f"yes{t.image}", ""]


def test_templates_are_checked():
    for bad in ({"escape": "ab"}, {"opens": "x"}, {"closes": "aba"}, {"others": ("a␛b",)}):
        with pytest.raises(ValueError):
            chat.ChatTemplate(**bad)


def test_other_templates_read_back(spark):
    other = chat.ChatTemplate(opens="[ROLE]", says="[SAYS]", closes="[DONE]", escape="\\", learnt=("user",))
    rows = [(1, 0, "user", "a\\b[DONE]\\[ROLE]"), (1, 1, "assistant", "[SAYS]</s>")]
    formatted = chat.format_chat(_frame(spark, rows), other)
    back = chat.read_chat(formatted, other).first()
    assert [tuple(x) for x in back.turns] == [r[2:] for r in rows]
    assert back.learnt == [rows[0][3]]


# Centroid clustering


def _lloyd(rows, k, rounds, dims, scale=1024, seed=3):
    """Plain rounds over all pairs of vectors and centroids."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * x) for x in vector]))

    def start(row):
        digest = "" if row[0] is None else hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest()
        return (row[0] is None, digest, row[1])

    at = [v for _, v in sorted(kept, key=start)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for i in range(len(at)):
            members = [v for (_, v), c in zip(kept, own) if c == i]
            if members:
                at[i] = [sum(column) // len(members) for column in zip(*members)]
    found = [(vec_id, *nearest(v)) for vec_id, v in kept]
    inertia = [sum(d for _, d, c in found if c == i) for i in range(len(at))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, inertia[c], sum(inertia), digests[c]) for i, d, c in found), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, v string"


def _vectors(dims, n, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        rows.append((i, [float(np.float32(c + rng.gauss(0, spread))) for c in centre]))
    return rows


def _clustered(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    return sorted((tuple(r) for r in clusters.shallot_clusters(frame, **options).collect()), key=repr)


ODD = [
    (900, None), (901, []), (902, [1.0]), (903, [1.0, None, 0.0]), (904, [1.0, math.nan, 0.0]), (905, [math.inf, 0.0, 0.0]),
    (None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5]), (3, [0.1, 0.2, 0.3]), (3, [0.1, 0.2, 0.3]),
]


@pytest.mark.parametrize("k,rounds", [(1, 3), (2, 4), (8, 10), (13, 6), (500, 2)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rows = _vectors(3, 150, seed=k) + ODD
    assert _clustered(spark, rows, k=k, rounds=rounds, dims=3) == _lloyd(rows, k, rounds, 3)


def test_ties_go_to_the_smaller_number(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-2, 3)), float(rng.randrange(-2, 3))]) for i in range(200)]  # a grid, many repeats
    for k in (3, 8, 16):
        assert _clustered(spark, rows, k=k, rounds=7, dims=2, scale=1) == _lloyd(rows, k, 7, 2, scale=1)


def test_clusters_of_many_dimensions_and_no_structure(spark):
    rows = _vectors(64, 300, seed=9, spread=3.0)
    assert _clustered(spark, rows) == _lloyd(rows, 8, 10, 64)


def test_clusters_of_nothing_and_of_too_large_numbers(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert clusters.shallot_clusters(empty).count() == 0
    assert clusters.shallot_clusters(empty).columns == clusters.shallot_clusters(
        spark.createDataFrame([(1, [0.0] * 64, "", "")], VECTORS)
    ).columns
    with pytest.raises(Exception, match="beyond"):
        clusters.shallot_clusters(spark.createDataFrame([(1, [3e38] * 64, "", "")], VECTORS)).count()


def test_search_is_exact_and_leaves_out_far_centroids():
    rng = np.random.default_rng(4)
    at = rng.integers(-5000, 5000, (40, 8))
    vectors = at[rng.integers(0, 40, 2000)] + rng.integers(-40, 40, (2000, 8))
    squares = ((vectors[:, None, :] - at[None]) ** 2).sum(2)
    start = rng.integers(0, 40, 2000)
    best, other, d_best, d_other = clusters.nearest_two(vectors, start, (start + 1) % 40, clusters.Centroids.of(at))
    assert (best == squares.argmin(1)).all() and (d_best == squares.min(1)).all()
    assert (d_other == np.sort(squares, axis=1)[:, 1]).all() and (other != best).all()


def test_rounds_leave_one_table(spark, tmp_path):
    rows = _vectors(3, 60, seed=2)
    held = clusters._Rounds(spark)
    first = held.write(spark.range(3).withColumn("x", F.lit(1)))
    path = held.paths[0]
    second = held.write(first.select("id"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert second.count() == 3 and not files.exists(hadoop(path)) and files.exists(hadoop(held.paths[0]))
    assert len(rows) == 60


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_chat_format", "op13_shallot_clusters"])
def test_queries_have_the_contract_columns(spark, small, name):
    columns = {
        "op11_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
        "op12_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op13_shallot_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    }[name]
    result = queries.QUERIES[name](spark, small)
    assert result.columns == columns.split()
    if name == "op12_chat_format":
        own = result.where("conv_id = -1").first()
        said = queries.HOSTILE
        assert own.n_turns == 2 and own.loss_chars == len(said)
        assert own.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
