"""Every dealt query: against its SQL or brute force over the smallest tables, and on the edge cases of its docstring."""

import glob
import hashlib
import itertools
import os
import random
import re
import sys
import textwrap
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from oracle_check import compare, connect  # noqa: E402
from trackspan.llm import (components, decontaminate, licenses, order_minhash, pareto, queries, rotation_codes, rules,  # noqa: E402
                           sanitise, snapshots, token_counts, token_files)
from trackspan.staging import shared_dir  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, rank double, H string"
EDGE = ["", None, "a", "Released under the MIT License.", "one two three four five six", "one two three four five six", "\n \t\r\n", "é" * 50]


def docs_of(spark, texts, source=lambda i: "s"):
    """Documents with extra columns that bear names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", source(i), 0, 1, 0.5, "h") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", ["b", None, "a"][i % 3], 0, 1, 0.5, "h") for i, t in enumerate(EDGE)]
    rows += [rows[4], rows[4], (None, "one two three four five six", None, None, None, None, None, None), (99, " ".join(f"w{i}" for i in range(30_000)), "en", "b", 0, 1, 0.5, "h")]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, queries.QUERIES[name], queries.ORACLE[name], FOLDER) is None


# -- near-duplicate documents ---------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_banded_distance_is_the_edit_distance():
    rnd = random.Random(1)
    for _ in range(1500):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 24))]
        b = list(a) if rnd.random() < 0.5 else [rnd.choice("abcd") for _ in range(rnd.randint(0, 24))]
        for _ in range(rnd.randint(0, 5)):
            if b:
                b[rnd.randrange(len(b))] = rnd.choice("abcd")
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        true, limit = edit_distance(a, b), rnd.randint(0, 12)
        assert order_minhash.banded_distance(a, b, limit) == (true if true <= limit else None)


def test_word_counts_never_rule_out_a_similar_pair():
    rnd = random.Random(2)
    for _ in range(300):
        a = [str(rnd.randint(0, 400)) for _ in range(rnd.randint(5, 80))]
        b = [w if rnd.random() < 0.9 else str(rnd.randint(0, 400)) for w in a][: rnd.randint(4, 90)]
        packed = []
        for text in (a, b):
            codes = np.fromiter((zlib.crc32(w.encode()) for w in text), np.uint32)
            packed.append(np.array([len(text)], "<u4").tobytes() + np.minimum(np.bincount(codes % order_minhash.BINS, minlength=order_minhash.BINS), 255).astype(np.uint8).tobytes())
        (nx, x), (ny, y) = (order_minhash._counts([p]) for p in packed)
        if order_minhash.similar(a, b):
            assert order_minhash._may_match(nx, x, ny, y, 0.8)[0]


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(60, 160))) for _ in range(25)]
    for t in list(texts):
        for _ in range(rnd.randint(0, 4)):
            own = t.split()
            for _ in range(len(own) // 20):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [f"{passage} {' '.join(rnd.choice(vocabulary) for _ in range(40))}" for _ in range(30)] + [texts[0].upper() + "!"]
    split = [words(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = split[i], split[j]
        if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and order_minhash.similar(a, b):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    docs = docs_of(spark, texts)
    for tile in (order_minhash.TILE, 3):
        got = {r.doc_id: r for r in order_minhash.near_duplicates(docs, tile=tile).collect()}
        assert [got[i].class_id for i in range(len(texts))] == root
        assert all(r.kept == (r.doc_id == r.class_id) and r.class_size == root.count(r.class_id) for r in got.values())
    kept = order_minhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(root)


def test_near_duplicates_of_short_texts(spark):
    """Every pair of short texts at the threshold meets: each text below has one edit, or few, and no other text near it."""
    rnd, texts, partner = random.Random(5), [], []
    for n in list(range(4, 16)) * 8:
        limit = max(x - n for x in range(n, 16) if x - n <= order_minhash.distance_limit(x, 0.8)) if n % 2 else 0
        own = [f"s{rnd.randrange(10**9)}" for _ in range(n)]
        other = list(own)
        if limit:
            for _ in range(limit):
                other.insert(rnd.randrange(len(other) + 1), f"s{rnd.randrange(10**9)}")
        else:
            for at in rnd.sample(range(n), order_minhash.distance_limit(n, 0.8)):
                other[at] = f"s{rnd.randrange(10**9)}"
        partner += [len(texts), len(texts)]
        texts += [" ".join(own), " ".join(other)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == partner


def test_few_pairs_are_aligned_where_a_class_meets_single_texts(spark, monkeypatch):
    """Texts near the limit meet a large class in many pairs; the likeliest of them settle it."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]

    def moved(n):  # word counts stay as they are, and each move takes two edits
        words = list(base)
        for _ in range(n):
            words.insert(rng.randrange(100), words.pop(rng.randrange(100)))
        return " ".join(words)

    texts = {**{i: moved(4) for i in range(60)}, **{i: moved(7) for i in range(100, 130)}, **{i: moved(1) for i in range(200, 206)}}
    aligned = []
    plain = order_minhash.verified
    monkeypatch.setattr(order_minhash, "verified", lambda near, *rest: aligned.append(near.count()) or plain(near, *rest))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert found == dict.fromkeys(texts, 0)
    assert sum(aligned) < 240  # 374 when all pairs were aligned at once


def test_sketches_go_before_the_classes_are_found(spark):
    """The largest intermediate table does not stay on disk beside those made from it."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/trackspan-sketches-*"))
    order_minhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d e f")], "doc_id long, text string"))
    assert set(glob.glob(f"{folder}/trackspan-sketches-*")) <= before


def test_near_duplicates_edges(edge, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.class_size) for r in order_minhash.near_duplicates(edge).collect())
    assert got == [(-1, None, 1), (0, 0, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 4), (4, 4, 4), (4, 4, 4), (5, 4, 4), (6, 6, 1), (7, 7, 1), (99, 99, 1)]
    kept = order_minhash.one_of_each(edge)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 1, 2, 3, 4, 6, 7, 99]
    assert order_minhash.near_duplicates(empty).count() == 0 and order_minhash.one_of_each(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(rnd.randint(600, 640), rnd.randint(600, 640)) for _ in range(30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links + [(7, 7)], "a long, b long")).collect()}
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if list(root.values()).count(r) > 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- licences -------------------------------------------------------------------------------------------


def test_licenses(spark, edge, empty):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses.TEMPLATES["MIT"]
    docs = docs_of(spark, ["x y z\nReleased under the MIT licence.\nmore", "prose\n\n" + licenses.TEMPLATES["ISC"] + "\n\nprose", mit, "released mit"])
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan_licenses(docs).collect()}
    assert set(got) == {(1, "ISC"), (2, "MIT")} and got[2, "MIT"] == 1.0
    assert {(r.doc_id, r.license, r.dice) for r in licenses.scan_licenses(edge).collect()} == {(3, "MIT notice", 1.0)}
    assert licenses.scan_licenses(empty).count() == 0
    assert {r.doc_id for r in licenses.without_licenses(docs, ["MIT"]).collect()} == {0, 1, 3}
    with pytest.raises(ValueError):
        licenses.scan_licenses(edge, {"x": "one"})
    assert "Python" not in licenses.scan_licenses(edge)._jdf.queryExecution().toString()


def test_licenses_of_several_paragraphs(spark):
    """Standard texts in their usual paragraphs, between prose and in comments; each is lost to lines and paragraphs alone."""
    cuts = {"MIT": ["The above copyright notice and", "THE SOFTWARE IS"], "ISC": ["THE SOFTWARE IS"],
            "BSD-2-Clause": ["1. Redis", "2. Redis", "THIS SOFTWARE IS"], "BSD-3-Clause": ["1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE IS"]}
    rnd, texts, want = random.Random(11), [], []
    for name, marks in cuts.items():
        text = " ".join(licenses.ALL_TEMPLATES[name].split())
        for mark in marks:
            assert mark in text
            text = text.replace(mark, "\n\n" + mark)
        prose = ["\n\n".join(" ".join(f"p{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(5)) for _ in range(2)]
        comment = "\n".join(f"# {line}".rstrip() for part in text.split("\n\n") for line in [*textwrap.wrap(part, 70), ""])
        texts += [f"{prose[0]}\n\nLicense\n\n{text}\n\n{prose[1]}", f"{prose[0]}\n\nCopyright (c) 2020 X\n\n{text}", f"{comment}\n\nimport os\n\n{prose[1]}"]
        want += [name] * 3
    texts.append(prose[0] + "\n\n" + prose[1])
    docs = docs_of(spark, texts)
    best = {r.doc_id: (r.license, r.dice) for r in licenses.best_licenses(docs).collect()}
    assert [best[i][0] for i in range(len(want))] == want and set(best) == set(range(len(want)))
    assert all(dice > 0.94 for _, dice in best.values()), best  # a line of the BSD-2-Clause template begins like an owner line and is left out
    found = licenses.scan_licenses(docs)
    assert all(r.n_units == 1 for r in found.collect()) and "Python" not in found._jdf.queryExecution().toString()


# -- decontamination ------------------------------------------------------------------------------------


def test_decontamination(spark, edge, empty):
    long_item = " ".join(f"w{i}" for i in range(100, 115))
    bench = spark.createDataFrame([(1, long_item), (2, "Five SIX"), (3, None), (4, ""), (None, "w7 w8"), (2, "five six"), (11, "six")], "item_id long, text string")
    for block in (decontaminate.BLOCK_WINDOWS, 2):
        got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(edge, bench, block=block).collect()}
        named = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
        assert {(4, 6, 2, 2, named("11,2")), (None, 6, 2, 2, named("11,2")), (99, 30_000, 17, 1, named("1")), (1, 0, 0, 0, named(""))} <= got
        assert {r.doc_id for r in decontaminate.clean_documents(edge, bench, block=block).collect()} == {0, 1, 2, 3, 6, 7}
        cut = {r.doc_id: r.text for r in decontaminate.cut_spans(edge, bench, block=block, put="#").collect()}
        assert cut[4] == "one two three four #" and cut[1] is None and cut[99].count("#") == 2
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(edge, bench.limit(0)).where("contaminated").count() == 0


# -- vectors --------------------------------------------------------------------------------------------


def test_vectors_equal_brute_force(spark):
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal((60, 16))
    rows = []
    for i in range(400):
        v = base[i % 60] + rnd.standard_normal(16) * rnd.choice([0.05, 0.25, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32)], [1, 2, None][int(rnd.integers(0, 8)) // 4]))
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(20)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0], 1), (905, [], 1), (906, rows[0][1], None), (None, rows[1][1], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("node", rotation_codes.F.lit(1))
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([-1 if r[2] is None else r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels) & (labels >= 0)
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    for _ in rows:
        root = np.array([min(root[i], *(root[near[i]])) if near[i].any() else root[i] for i in range(len(rows))])
    for tile, bucket in ((rotation_codes.TILE, rotation_codes.BUCKET), (20, 8)):
        got = {r.vec_id: r for r in rotation_codes.near_vectors(frame, tile=tile, bucket=bucket).collect()}
        assert len(got) == len(rows) + len(odd)
        recall = sum(got[i].n_links for i in range(len(rows))) / near.sum()
        assert recall >= 0.99 and all(got[i].n_links <= near[i].sum() for i in range(len(rows)))
        assert np.mean([got[i].component_id == root[i] for i in range(len(rows))]) >= 0.98
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907)) and got[None].n_links == 0
    assert rotation_codes.near_vectors(frame.limit(0)).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(6)
    x = rotation_codes.unit_rows(rnd.standard_normal((400, 64)))
    y = rotation_codes.unit_rows(x + 0.15 * rnd.standard_normal((400, 64)))
    codes, factors = rotation_codes.coded(x)
    guess, error = rotation_codes.estimates(codes, factors, (y @ rotation_codes.rotation(64, 0).T).astype(np.float32))
    off = guess - x @ y.T
    assert abs(off.mean()) < 0.002 and (np.abs(off) > error[:, None]).mean() < 1e-3


# -- quality --------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_rule_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    good, bad = ([got[i].score for i in held if labels[i] == q] for q in (1, 0))
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.9
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.9


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = rules.scored(edge, labels).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in rules.scored(edge, labels.limit(0)).collect()} == {0.5}
    assert rules.scored(empty, labels).count() == 0
    assert rules.accepted(edge, labels.limit(0)).columns == edge.columns


# -- sanitisation ---------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(7)
    for _ in range(6000):
        text = "".join(rnd.choice(["a", "Z.", "@", "@b.c", ".", "-", " ", "+", "1", "25", "4111 1111 1111 1111", "(0)", "é", "10.0.0.", "+49 30 ", "000"]) for _ in range(rnd.randint(0, 14)))
        assert sanitise.base_spans(text) == plain_spans(text), text


def test_sanitise_disclosing_terms(spark, edge, empty):
    texts = [f"note {i} w{i}: Secretword belongs to boss@example.com the end" for i in range(6)] + [f"the end of note {i}, other w{i}{i}" for i in range(60)]
    docs = docs_of(spark, texts + texts[:1] + ["rare zebra x@y.zz", "rare zebra x@y.zz"])
    for most in (sanitise.MOST_BROADCAST, 0):
        got = {r.doc_id: r for r in sanitise.sanitise(docs, most_broadcast=most).collect()}
        assert "term" in got[0].spans and got[0].spans.startswith("email:33:49,term:") and got[0].n_email == 1
        assert "Secretword" not in got[0].sanitised and got[0].sanitised.endswith("[EMAIL] the end")
        assert got[20].spans == "" and got[20].sanitised == texts[20]
        assert "term" not in got[67].spans  # two copies of one text
    got = sanitise.sanitise(edge).collect()
    assert len(got) == 12 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert sanitise.sanitise(empty).count() == 0


def test_sanitise_protects_entities_seen_once(spark):
    """Each kind in one text each, an entity of two texts, and common words beside them that stay."""
    once = ["the note of Quagfire goes to jane@example.org the end", "the note of Brindlemoor goes to 10.20.30.40 the end",
            "the note of Vexley goes to 4111 1111 1111 1111 the end", "the note of Thrumble goes to +49 30 1234567 the end"]
    twice = [f"the note {i} of Oskarven goes to both@example.net the end" for i in range(2)]
    plain = [f"the note {i} of w{i} goes to nobody the end" for i in range(400)]
    got = {r.doc_id: r for r in sanitise.sanitise(docs_of(spark, once + twice + plain + plain[:1])).collect()}
    for i, word in enumerate(["Quagfire", "Brindlemoor", "Vexley", "Thrumble", "Oskarven", "Oskarven"]):
        assert word not in got[i].sanitised and got[i].spans.count("term") == 1, got[i]
        assert got[i].sanitised.startswith("the note") and got[i].sanitised.endswith("the end") and "[NAME] goes to [" in got[i].sanitised
    assert all(got[i].spans == "" and got[i].sanitised == plain[i - 6] for i in range(6, 406))


# -- mixing ---------------------------------------------------------------------------------------------


def test_mix(spark, edge, empty):
    rnd = random.Random(8)
    docs = docs_of(spark, ["w " * rnd.randint(0, 40) for _ in range(900)], lambda i: ["a", "b", "c", None][min(3, i % 7)])
    got = pareto.mix(docs).collect()
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 20 and own[0].target <= 2 * own[0].source_size
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, pareto.mix(docs.repartition(5)).collect()))
    mixed = pareto.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    weighted = pareto.mix(docs, share=0.5, weight=rules.F.when(rules.F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    for source in ("a", "b", "c", None):
        own = [r for r in weighted if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 20
    odd, even = (sum(r.copies for r in weighted if r.doc_id % 2 == k) for k in (1, 0))
    assert even > 2 * odd
    assert pareto.mix(edge).count() == 12 and pareto.mix(empty).count() == 0 and pareto.mixed_documents(empty).count() == 0


# -- conversations --------------------------------------------------------------------------------------


def test_collapse(spark):
    turns = [(c, t, r, x) for c, chat in {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "x", 6: "a"}.items() for t, x in enumerate(chat) for r in ["user"]]
    turns += [(7, 0, None, "p"), (8, 0, "p", None), (8, None, "q", "r"), (None, 0, "user", "zz"), (9, 1, "user", "same"), (9, 1, "user", "same"), (10, 1, "user", "same")]
    turns += [(50, t, "user", f"t{t}") for t in range(600)] + [(51, t, "user", f"t{t}") for t in range(599)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("position", rules.F.lit(1)).repartition(3)
    got = {(r.conv_id, r.block): r for r in snapshots.collapse_and_render(frame).collect()}
    assert set(got) == {(2, 0), (4, 0), (5, 0), (7, 0), (8, 0), (9, 0), (50, 0), (50, 1), (50, 2)}
    assert got[2, 0].copies == 2 and got[50, 2].n_turns == 600
    assert got[2, 0].text == "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for x in "abc")
    assert got[50, 1].text.startswith("<|im_start|>user\nt256<") and got[8, 0].text.startswith("<|im_start|>q\nr<")
    assert snapshots.collapse_and_render(frame.limit(0)).count() == 0


def test_collapse_orders_ties_by_the_whole_text(spark):
    """Turns of one number that share a long start, in many pairs so that no hash orders all of them by chance."""
    start = "s" * 80
    turns = [(c, 0, "user", start + x) for c in range(12) for x in (f"b{c}", f"a{c}", f"c{c}")]
    got = {r.conv_id: r.text for r in snapshots.collapse_and_render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert got == {c: "".join(f"<|im_start|>user\n{start}{x}{c}<|im_end|>\n" for x in "abc") for c in range(12)}


# -- tokens ---------------------------------------------------------------------------------------------

ODD = ["<|endoftext|>", "x<|ENDOFTEXT|> <|endoftext|>.", "It's THE'RE, don't. İstanbul, ΣΑΣ Σ. é́ ́a", "a\tb c  d\r\n", " ", "a ", " a", "a   ", "▁a ▁ b▁ c", "日本語。テスト, x", "</s><s>"]


def odd_docs(spark, edge):
    rnd = random.Random(9)
    random_texts = ["".join(rnd.choice("aAbÉßİΣσ'.,<|>end 9\n\t́ ﬁ日▁") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return edge.union(docs_of(spark, ODD + random_texts))


def test_token_files_round_trip(spark, edge, empty, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    docs = odd_docs(spark, edge)
    (tmp_path / "t").mkdir()
    token_files.write_tokens(docs, str(tmp_path / "t"), path)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect())
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    tokenizer = Tokenizer.from_file(path)
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    (tmp_path / "e").mkdir()
    token_files.write_tokens(empty, str(tmp_path / "e"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        token_files.mounted("s3a://bucket/x")


def test_parts_of_long_texts_add_up(monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_TOKENIZER))
    count = token_counts.PieceCounter(queries.tokenizer_path(queries.PIECE_TOKENIZER))
    rnd = random.Random(10)
    for _ in range(500):
        text = "".join(rnd.choice("ab  ▁\n.") for _ in range(rnd.randint(0, 80)))
        assert sum(count.counts([p])[0] for p in token_counts.safe_parts(text, 20)) == len(model.encode(text)) == count.counts([text])[0]
    encoder = token_files.WordEncoder(queries.tokenizer_path(queries.WORD_TOKENIZER))
    monkeypatch.setattr(token_files, "CACHE_PIECES", 40)  # generations change all the time
    for text in ODD * 3:
        whole = np.array(encoder.tokenizer.encode(text * 9, add_special_tokens=False).ids, "<u2").tobytes()
        assert b"".join(encoder.packed([p])[0] for p in token_files.long_pieces(text * 9, 10)) == whole


def test_token_counts(spark, edge, empty):
    import sentencepiece

    path = queries.tokenizer_path(queries.PIECE_TOKENIZER)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd_docs(spark, edge)
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 4096) for r in docs.collect()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in token_counts.count_tokens(docs, path).collect())
    assert token_counts.count_tokens(empty, path).count() == 0
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    want = [(r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens)) for r in token_counts.count_tokens(docs, path).collect())


# -- pipeline -------------------------------------------------------------------------------------------


def test_pipeline_stages_equal_their_operators(spark):
    docs, kept = table(spark, "documents"), []
    for name, fn in corpus_pipeline.STAGES[:-1]:
        out = fn(spark, docs, FOLDER)
        assert out.columns == docs.columns
        kept.append((docs.collect(), out.collect()))
        docs = spark.createDataFrame(kept[-1][1], docs.schema)
    (all_docs, good), (_, single), (_, clean), (_, mixed) = kept
    predicted = {r.doc_id: r.predicted for r in queries.op5_rule_quality(spark, FOLDER).collect()}
    assert {r.doc_id for r in good} == {i for i, p in predicted.items() if p}
    split = {r.doc_id: words(r.text) for r in good}
    for r in good:  # what is gone is similar to something, what stayed is similar to nothing that stayed
        if r not in single:
            assert any(order_minhash.similar(split[r.doc_id], split[o]) for o in split if o != r.doc_id and abs(len(split[o]) - len(split[r.doc_id])) <= 0.2 * max(len(split[o]), len(split[r.doc_id])))
    for a, b in itertools.combinations([split[r.doc_id] for r in single], 2):
        assert abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)) or not order_minhash.similar(a, b)
    windows = {tuple(w[i:i + 10]) for w in (words(r.text) for r in table(spark, "benchmark").collect()) for i in range(max(1, len(w) - 9)) if w}
    has = lambda w: any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not has(split[r.doc_id])}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and len(mixed) > len(clean)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in mixed)
