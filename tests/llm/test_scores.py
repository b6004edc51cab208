from __future__ import annotations

import math
import random
import re
import textwrap
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dueline.llm import quality, topk
from dueline.llm.licenses import TEMPLATES, scan_licenses, scan_sql
from dueline.llm.mixing import mix
from dueline.llm.pii import PATTERNS, candidates, find_personal_data, reliabilities
from dueline.llm.quality import keep_good, score
from tests.compare import differences
from tests.llm import brute
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def auc(scores: np.ndarray, labels: np.ndarray) -> float:
    rank = np.argsort(np.argsort(scores))
    return (rank[labels == 1].mean() - rank[labels == 0].mean()) / len(scores) + 0.5


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()
    assert (got.predicted == got.quality).mean() > 0.95 and auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.97


def test_quality_votes_equal_brute_force(spark):
    """Features, projection, cosines and votes of each document by plain loops; only the space is the model's."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.sample(docs, labels, ~quality.held_out(F.col("id")), "doc_id", "text", "quality")
    own = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in own and zlib.crc32(str(r.doc_id).encode()) % 5}
    assert len(model.labels) == len(known) < quality.SAMPLE

    def features(text: str) -> np.ndarray:
        out, before = np.zeros(quality.FEATURES), None
        for w in re.split(r"[ \t\n\v\f\r]+", text):
            if not w:
                before = None
                continue
            s = zlib.crc32(quality.shape(w).encode()) % (quality.SHAPES - 1)
            out[s] += 1
            out[quality.SHAPES + quality.PAIRS + zlib.crc32(w.encode()) % quality.WORDS] += 1
            if before is not None:
                out[quality.SHAPES - 1] += before[0] == w
                out[quality.SHAPES + (before[1] * 1_000_003 + s * 7919) % quality.PAIRS] += 1
            before = (w, s)
        return out

    def latent(text: str) -> np.ndarray:
        x = np.sqrt(features(text)) * model.idf
        at = 0
        for size, weight in zip((quality.SHAPES, quality.PAIRS, quality.WORDS), quality.WEIGHTS):
            length = math.sqrt(sum(v * v for v in x[at : at + size]))
            x[at : at + size] *= weight / length if length else 0
            at += size
        x = x @ model.axes - model.mean
        length = math.sqrt((x * x).sum())
        return x / length if text.split() and length > 1e-9 else np.zeros(len(x))

    vectors = {i: latent(own[i]) for i in known}
    for r in score(docs, labels).collect():
        mine = latent(own[r.doc_id])
        cosines = sorted(((float(mine @ v), known[i]) for i, v in vectors.items()), reverse=True)[: quality.K]
        weights = [max(c, 0.0) ** quality.SHARPNESS for c, _ in cosines]
        expected = sum(w * y for w, (_, y) in zip(weights, cosines)) / sum(weights) if sum(weights) else model.prior
        assert abs(r.score - expected) < 1e-3 and r.predicted == (r.score >= 0.3)


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (score(docs, x).toPandas().sort_values("doc_id").score for x in (labels, turned))
    assert (a.to_numpy() == b.to_numpy()).all()


def test_quality_of_odd_tables(spark, make):
    docs = make(ODD, {"score": "x", "predicted": 2, "quality_text": None})
    labels = spark.createDataFrame([(2, 1, 0), (7, 0, 0), (7, 1, 0), (9, None, 0), (None, 1, 0), (12, 5, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = score(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
    assert score(make([]), labels).collect() == [] and keep_good(make([]), labels).collect() == []


def test_quality_holds_few_rows_of_counts_and_each_text_once(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["ab", "Ab", "x1", ",", "é"], k=rng.randrange(6))) for _ in range(quality.ROWS * 2 + 3)] + ["", "a\x00 a"]
    blocks = list(quality.counts(pa.array(texts)))
    assert [len(b) for b in blocks] == [quality.ROWS, quality.ROWS, 5]
    alone = [next(quality.counts(pa.array([t])))[0] for t in texts]
    assert (np.concatenate(blocks) == np.array(alone)).all()
    assert list(quality.counts(pa.array([], pa.string()))) == []
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id bigint, text string")
    kept = keep_good(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert "quality_text" not in kept._jdf.queryExecution().toString()


def test_mixture_has_its_shares(make):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randrange(10, 100), rnd.choice(["a"] * 8 + ["b", "c", None])) for i in range(4000)]
    recipe = {"a": 0.2, "b": 0.5, "never": 0.1}
    docs = make(rows, {"mix_key": 1, "mix_copy": "x"})
    got = mix(docs, recipe, other=0.3, epochs=2.0)
    assert got.columns == docs.columns
    n = {r.s: r.n for r in got.groupBy(F.coalesce("source", F.lit("none")).alias("s")).agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(len(t) for _, t, _ in rows)
    aim = {k: 2 * total * w / 1.1 for k, w in {"a": 0.2, "b": 0.5}.items()} | {"c": 0, "none": 0}
    assert abs(n["a"] / aim["a"] - 1) < 0.1 and abs(n["b"] / aim["b"] - 1) < 0.1
    assert abs((n["c"] + n["none"]) / (2 * total * 0.3 / 1.1) - 1) < 0.1


def test_copies_follow_the_inverted_distribution(make):
    import hashlib

    rows = [(i, "x" * 10, "a" if i % 3 else "b") for i in range(300)] + [(None, "x" * 10, "a"), (1, "x" * 10, "a")]
    got = mix(make(rows), {"a": 0.02, "b": 0.9}, other=0.0, epochs=100.0, details=True).collect()
    total, size = 10 * len(rows), {s: sum(10 for r in rows if r[2] == s) for s in "ab"}
    copies: dict = {}
    for r in got:
        copies.setdefault((r.doc_id, r.source_key), []).append(r.copy)
    for i, text, source in rows:
        rate = 100 * total * {"a": 0.02, "b": 0.9}[source] / 0.92 / size[source]
        draws = max(1, math.ceil(rate / 64))
        key, n = str(i) if i is not None else hashlib.md5(text.encode()).hexdigest(), 0
        for d in range(1, draws + 1):
            u = int(hashlib.md5(f"42|{key}|{d}".encode()).hexdigest()[:13], 16) / 2**52
            k, p, s = 0, math.exp(-rate / draws), math.exp(-rate / draws)
            while s <= u:
                k += 1
                p *= rate / draws / k
                s += p
            n += k
        times = sum(r[0] == i and r[2] == source for r in rows)
        assert sorted(copies.get((i, source), [])) == sorted(list(range(1, n + 1)) * times)


def test_odd_mixtures(make):
    assert mix(make([]), {"a": 1.0}).collect() == []
    assert mix(make([(1, None, "a"), (2, "", "a")]), {"a": 1.0}, epochs=50.0).count() > 50  # no characters at all
    assert mix(make([(1, "x", "a"), (2, "x", None)]), {}, other=1.0, epochs=50.0).count() > 50
    with pytest.raises(ValueError):
        mix(make([]), {"a": 0.0})


def test_licenses_equal_sql(spark, make):
    rows = ODD + [
        (20, "Permission is hereby granted\nLicensed  under the Apache License, version 2.0!\nThis work is licensed under the GNU General Public License, version 3."),
        (21, "licensed under cc by nc 4 0"), (22, "Licensed under CC BY-ND 4.0."), (23, "x\n" * 3000), (24, "one"),
    ]
    got = scan_licenses(make(rows, {"license": 1, "dice": 2})).toPandas()
    documents = make(rows).toPandas()  # noqa: F841
    with duckdb.connect() as con:
        con.register("documents", documents)
        assert differences(got, con.sql(scan_sql()).df()) is None
    found = {r.doc_id: r.license for r in got.itertuples()}
    assert found[16] == "mit" and found[20] in ("apache-2.0", "gpl-3.0") and found[21] == "cc-by-nc-4.0" and found[24] is None
    assert scan_licenses(make([])).collect() == []


def test_wrapped_commented_and_embedded_licenses(make):
    """Each notice in the forms that files have it in, and complete licence texts."""
    code = "\n".join(f"x{i} = f(y{i}, {i})" for i in range(60))
    rows, expected = [], {}
    for name in ("apache-2.0", "gpl-3.0", "isc", "mit", "mpl-2.0"):
        notice = max(TEMPLATES[name], key=len)
        wrapped = textwrap.wrap(notice, 75)
        forms = [
            "\n".join(wrapped) + "\n\n" + code,
            "/*\n" + "\n".join(f" * {line}" for line in wrapped) + "\n */\n" + code,
            "\n".join(f"# {line}" for line in wrapped) + "\n" + code,
            f"Some words before it. {notice} And some more words that stand behind it.",
            " ".join(TEMPLATES[name]) + "\n" + code,
        ]
        for form in forms:
            rows.append((len(rows), form))
            expected[len(rows) - 1] = name
    rows += [(100, "This library is Released under the MIT License. and you can have it."), (101, code), (102, "released under the terms of mit"), (103, "word " * 50_000 + "Released under the\nMIT License")]
    expected |= {100: "mit", 101: None, 102: None, 103: "mit"}
    got = {r.doc_id: r.licenses.split(",") if r.licenses else [None] for r in scan_licenses(make(rows)).collect()}
    assert all(name in got[i] for i, name in expected.items())
    documents = make(rows).toPandas()  # noqa: F841
    with duckdb.connect() as con:
        con.register("documents", documents)
        assert differences(scan_licenses(make(rows)).toPandas(), con.sql(scan_sql()).df()) is None


PII = [
    "a@b.c-d@e.f x@y a@b.c_d@e.f .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 12",
    "+1 (377) 555-0271. +12345678 +1--------9 +99999999999999999", "7" * 4_000, "a" * 4_000 + "@", "a@" + "b." * 4_000 + "c", "+" + "1 " * 30_000,
    "\u0001a@b.co\u0001 \U0001f600 1.1.1.1", "call (212) 555-0101 token = \"" + "ab12" * 10 + "\"", "no personal data", "1.1.1.1" * 300,
]


def test_base_spans_equal_brute_force(make):
    rows = ODD + list(enumerate(PII, 100)) + [(None, PII[0]), (100, PII[0])]
    got = find_personal_data(make(rows, {"found": 1, "spans": "x"})).collect()
    assert sorted(repr((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got) == sorted(
        repr((i, *brute.base_digest(t or ""))) for i, t in rows
    )
    texts = {i: t or "" for i, t in rows if i is not None}
    for r in (r for r in got if r.doc_id is not None):
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = [s for s in spans if s[0] in ("email", "ip", "card", "phone")]
        assert [(k, int(s), int(e)) for k, s, e in base] == brute.base_spans(texts[r.doc_id])
    assert find_personal_data(make([])).collect() == []


def planted_documents(seed: int, n: int = 400) -> tuple[list[tuple], dict[int, set], dict[str, int]]:
    """Documents with planted secrets and local numbers, and others with runs that look a little like them."""
    rnd, rows, truth = random.Random(seed), [], {}
    words = "the rain fell on the old town and people went home".split()
    planted = {"secret": 0, "local_phone": 0}
    for i in range(n):
        text = " ".join(rnd.choices(words, k=rnd.randrange(5, 40))) + " "
        kind = rnd.choice(["secret", "local_phone", "decoy", "none"])
        if kind == "secret":
            own = "".join(rnd.choices("0123456789abcdef", k=rnd.choice([32, 40, 64])))
            text += f'{rnd.choice(["token", "api_key", "password"])} = "'
        elif kind == "local_phone":
            own = f"({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"
            text += rnd.choice(["call ", "phone: ", "Tel. "])
        elif kind == "decoy":
            own = rnd.choice(["0" * 40, "f" * 32, "(000) 000-0000", "(111) 111-1111"])
            text += rnd.choice(["version ", "order ", "invoice "])
        else:
            own = ""
        if kind in planted:
            planted[kind] += 1
            truth[i] = {(kind, len(text), len(text) + len(own))}
        rows.append((i, text + own + ('"' if kind == "secret" else "") + " " + " ".join(rnd.choices(words, k=5))))
    return rows, truth, planted


def test_added_spans_have_precision_and_recall(make):
    rows, truth, planted = planted_documents(5)
    found: dict[str, list[bool]] = {"secret": [], "local_phone": []}
    for r in find_personal_data(make(rows)).collect():
        spans = [tuple(int(x) if x.isdigit() else x for x in s.split(":")) for s in r.spans.split(",") if s]
        assert (r.n_secret, r.n_local_phone, r.n_number) == tuple(sum(s[0] == k for s in spans) for k in ("secret", "local_phone", "number"))
        assert r.n_all == len(spans)
        for s in spans:
            if s[0] in found:
                found[s[0]].append(s in truth.get(r.doc_id, set()))
    for kind, right in found.items():
        assert sum(right) / planted[kind] >= 0.95, f"recall of {kind}"
        assert sum(right) / len(right) >= 0.9, f"precision of {kind}"


def test_reliabilities_tell_good_from_bad(spark):
    good, bad = [1, 1, 0, 1, 1], [-1, -1, 0, -1, 0]
    rows = [(0, good)] * 80 + [(0, bad)] * 60 + [(0, [1, -1, 0, 1, 1])] * 5
    got = {tuple(r.votes): r.p for r in reliabilities(spark.createDataFrame(rows, "kind int, votes array<int>")).collect()}
    assert got[tuple(good)] > 0.95 and got[tuple(bad)] < 0.05 and got[1, -1, 0, 1, 1] > 0.5


def test_no_python_on_the_main_path_of_native_operators(spark, make):
    for frame in (find_personal_data(make(ODD)), scan_licenses(make(ODD)), mix(make(ODD), {"s": 1.0})):
        plan = frame._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert len(PATTERNS) == 6 and candidates(make([]), "doc_id", "text").collect() == []


def brute_top(rows: list[tuple], k: int) -> list[tuple]:
    clean = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in sorted({c for c in clean if c[0] % 20 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in clean if i != q and len(v) == len(qv))
        out += [(q, r, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("small_blocks", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(topk, "VECTORS_PER_BLOCK", 20)
        monkeypatch.setattr(topk, "TOGETHER", 3)
    rnd = random.Random(9)
    rows = [(i, [float(np.float32(rnd.gauss(0, 0.2))) for _ in range(12)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 12) for i in range(30)]  # ties
    rows += [(40, rows[40][1]), (41, rows[41][1]), (None, [1.0] * 12), (1100, None), (1120, [math.nan] * 12), (1140, [None] + [1.0] * 11)]
    rows += [(1160, [1.0, 2.0]), (1161, [1.0, 2.5]), (1180, [math.inf] * 12), (1200, [0.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    # Partitions that stay apart show whether both sides of a group meet.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = topk.top_k(table, table.where("vec_id % 20 = 0"), k=7).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == sorted(brute_top(rows, 7))


def test_levels_stop_on_proof_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    vectors = np.floor(64 * rng.standard_normal((3000, 16)) * rng.choice([0.1, 1.0], (3000, 16))).astype(np.int64)
    index = topk.Index(np.arange(3000), vectors)
    queries = vectors[:40]
    exact = queries @ vectors.T
    bounds = np.sort(exact, axis=1)[:, -40]
    used = []
    monkeypatch.setattr(topk.Index, "_top", lambda self, q, places, *a, top=topk.Index._top: used.append(len(places)) or top(self, q, places, *a))
    for q, ids, scores in index.best(np.arange(40), queries, bounds, 7):
        best = sorted((-s, i) for i, s in enumerate(exact[q].tolist()) if i != q)[:7]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == best
    assert max(used) <= 0.05 * 3000 and np.mean(used) < 100  # the rest was proven out


def test_top_k_of_huge_and_no_vectors(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [-1e9, 0.0]), (20, [0.25, -0.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.top_k(table, table.where("vec_id % 20 = 0"), k=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute_top(rows, 3))
    empty = table.limit(0)
    assert topk.top_k(empty, empty, k=3).collect() == []




def test_quality_fits_in_little_more_than_one_matrix():
    rng = np.random.default_rng(0)
    places = [np.sort(rng.choice(quality.FEATURES, rng.integers(0, 300), replace=False)) for _ in range(1500)]
    rows = [(p, rng.integers(1, 9, len(p))) for p in places]
    tracemalloc.start()
    model = quality.fit(rows, np.arange(1500) % 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.7 * 1500 * quality.FEATURES * 4
    found = np.zeros((1500, quality.FEATURES), np.float32)
    for out, (place, n) in zip(found, rows):
        out[place] = n
    assert np.array_equal(model.project(found), model.vectors)


def test_quality_features_travel_as_bytes_that_sort_as_numbers():
    lists = [[], [0], [1], [1, 2], [255], [256], [256, 1], [6143]]
    for kind in (quality.PLACE, quality.TIMES):
        assert sorted(lists) == sorted(lists, key=lambda x: np.array(x, kind).tobytes())
    assert quality.FEATURES <= np.iinfo(quality.PLACE).max + 1
